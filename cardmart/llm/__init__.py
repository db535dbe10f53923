"""Training-data operators: filtering, deduplication, packing and encoding of text.

Nothing outside this subpackage imports it.
"""
