"""Data quality for lists of healthcare providers, as Spark DataFrame operators."""
