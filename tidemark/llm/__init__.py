"""Training-data operators: tokenising, packing, fingerprints, duplicate removal, filtering and vector search.

Nothing outside this subpackage imports it.
"""
