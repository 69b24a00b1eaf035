"""Column builders: text, Markdown, tokens, scores."""
