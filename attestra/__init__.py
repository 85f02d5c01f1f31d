"""attestra: document audit and commitment reconciliation on Spark DataFrames."""

__version__ = "0.1.0"
