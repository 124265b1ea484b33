"""Registered queries: each module maps query names to (Spark callable, DuckDB SQL or None)."""
