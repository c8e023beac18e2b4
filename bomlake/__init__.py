"""Spark-first analytics for software bills of materials and container images."""

__version__ = "0.3.0"
