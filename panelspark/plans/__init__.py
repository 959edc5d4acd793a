"""End-to-end dataflows and the registered queries with their SQL counterparts."""
