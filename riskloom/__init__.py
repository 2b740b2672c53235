"""Content-risk analytics as Spark jobs: text scoring, verdict rules, metrics, graph and streams."""

__version__ = "0.1.0"
