"""Query registry over the benchmark tables and its SQL counterparts."""
