"""Parsing of web pages: a tolerant tree, a selector subset and the extractors over them."""
