"""Composed plans, views of the star-schema tables, and the SQL they must equal."""
