"""Reserved for incremental indexing; the covered feature set is batch only."""
