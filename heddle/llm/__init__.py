"""Training-data operators: packing, search, de-duplication, quality, privacy and tokenisation.

Nothing outside this subpackage imports it.
"""
