"""Markdown: fences, prose, segments, images, tables, MDX and site clean-ups."""
