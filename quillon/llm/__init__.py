"""Training-data operators: extraction, deduplication, packing, archives, tokens, toxicity, media.

Nothing outside this subpackage imports it.
"""
