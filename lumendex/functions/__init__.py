"""Column functions: text analysis and BM25."""
