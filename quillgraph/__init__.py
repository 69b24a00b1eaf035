"""quillgraph: a PySpark-native engine over collections of linked text documents."""
