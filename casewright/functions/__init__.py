"""Column expressions and the distributed-order helpers the operators share."""
