"""Query plans: named queries with their SQL counterparts."""
