"""millrace: durable data pipelines and set-based state operators on Spark DataFrames."""
