"""Training-data operators: fingerprints, tokenisation, extraction, filtering, de-duplication, packing.

Nothing outside this subpackage imports it.
"""
