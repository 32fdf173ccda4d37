"""paperflow: PySpark jobs for office-correspondence data and training-corpus preparation."""

__version__ = "0.1.0"
