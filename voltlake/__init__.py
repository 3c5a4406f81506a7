"""voltlake: partial-discharge analytics and data preparation as Spark jobs."""

__version__ = "0.1.0"
