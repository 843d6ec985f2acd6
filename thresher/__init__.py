"""Topic analytics on Spark: threshold rules, topic text, text extraction,
classifiers and exact evaluation, each one a DataFrame -> DataFrame function."""

__version__ = "0.1.0"
