"""Analytics on keyed time-series panels, written as DataFrame-to-DataFrame functions on Spark."""

__version__ = "0.1.0"
