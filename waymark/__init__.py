"""Indoor mapping, localization and routing as PySpark DataFrame jobs."""

__version__ = "0.1.0"
