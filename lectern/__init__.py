"""lectern: a PySpark-native engine for long-context reading tests and the data behind them."""

__version__ = "0.1.0"
