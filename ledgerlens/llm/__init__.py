"""Operators for preparing training text at scale (mixing, token files,
packing, near-duplicate joins, fingerprints, quality rules, sharding, token
counts, chat formatting, URL filters).  Nothing else in the library imports
this subpackage."""
