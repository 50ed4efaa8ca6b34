"""tidemark: a document-index, hybrid-search and reporting engine on Spark DataFrames."""

__version__ = "0.1.0"
