"""Reading and writing matrices: Matrix Market and tuple text, Parquet, tables and generators."""
