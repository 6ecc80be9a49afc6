"""Sets of nucleotide k-mers as Spark DataFrames."""

__version__ = "0.1.0"
