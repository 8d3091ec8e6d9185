"""Analysis and compaction of conversation logs on Spark."""
