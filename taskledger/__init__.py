"""Spark jobs over the data behind a task-run platform: logs, runs, graphs, content, memo tables."""

__version__ = "0.1.0"
