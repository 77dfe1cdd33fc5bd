"""panelforge: a Spark-first engine for panel data (monthly cross-sections and daily observations)."""

__version__ = "0.1.0"
