"""Results as events and triples, published in batches and time buckets."""
