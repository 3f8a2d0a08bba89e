"""The query registry and the SQL each query is checked against."""
