"""hazeflow: air-quality features and forecasts as Spark jobs."""

__version__ = "0.1.0"
