"""Operators over notes, chunks, vectors and edges."""
