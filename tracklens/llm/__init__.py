"""Training-data operators: de-duplication, sharding, packing, scoring, sanitising.

Nothing outside this subpackage imports it.
"""
