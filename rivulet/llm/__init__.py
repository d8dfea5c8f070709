"""Training-data operators: packing, scanning, filtering, scoring and deduplication of documents.

Nothing else in the library imports this subpackage.
"""
