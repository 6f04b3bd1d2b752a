"""Link ingestion and document curation on Spark DataFrames."""
