"""plumbline: consistency analytics over Markdown collections, on Spark DataFrames."""
