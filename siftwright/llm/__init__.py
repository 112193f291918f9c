"""Training-data operators: deduplication, quality, safety and mixing of text corpora.

Nothing else in the library imports this subpackage.
"""
