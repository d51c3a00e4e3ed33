"""Column builders: regex classes shared by Spark and DuckDB, text cleaning, hashing,
array helpers and the fixed word lists."""
