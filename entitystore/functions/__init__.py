"""Column builders: time buckets, shard numbers, predicates."""
