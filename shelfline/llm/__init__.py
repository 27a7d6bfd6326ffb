"""Operators for preparing training data: dedup, mixing, sharding, packing, archives, token counts, quality rules, prefix tries, licences, search."""
