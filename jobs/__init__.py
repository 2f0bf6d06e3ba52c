"""Runnable jobs: each reads tables with Spark's readers, writes partitioned tables with its writers, and may be run again."""
