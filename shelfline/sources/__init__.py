"""Readers and writers for stored tables, snapshots, sitemaps, shards, work lists and watch lists."""
