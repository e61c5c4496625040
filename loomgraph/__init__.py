"""Workspace-graph analytics on Spark: code graph, work plan, event log."""
