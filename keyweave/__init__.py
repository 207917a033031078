"""Keyed table reconciliation and terminology mining as Spark jobs."""
