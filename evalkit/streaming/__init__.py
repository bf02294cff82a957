"""Structured Streaming: progress, deduplication, throughput and job state over append-only logs."""
