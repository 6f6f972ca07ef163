"""Reads, writes, statistics, workloads and evaluations over the log."""
