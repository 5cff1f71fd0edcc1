"""DataFrame operators: patterns, windows, joins, buckets, triple sets, registry, delivery."""
