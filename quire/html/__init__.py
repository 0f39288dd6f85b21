"""HTML: a tree on the standard parser, a small selector engine, and conversion to Markdown."""
