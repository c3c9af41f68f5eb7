"""Point-in-time analysis of rule-governed incidents, expressed as lazy Spark jobs."""

__version__ = "0.1.0"
