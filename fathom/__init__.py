"""Storage-metadata analytics on Spark: heat maps, rollups, path search, retention and shard tools."""
