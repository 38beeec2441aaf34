"""Registered queries, one module per workload."""
