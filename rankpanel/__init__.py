"""rankpanel - cross-sectional factor research on (symbol, date) panels, on Spark."""

__version__ = "0.1.0"
