"""Millrace: machine-telemetry analytics and data preparation on PySpark."""
