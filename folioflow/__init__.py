"""folioflow: batch document triage and analytics expressed as Spark DataFrames."""

__version__ = "0.1.0"
