"""tidemark: dataset reconciliation and data-quality checks on Spark DataFrames."""
