"""Plan-level helpers: table access, lineage cuts, code shipping, the query registry."""
