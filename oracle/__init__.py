"""Equivalent DuckDB SQL for the registered queries."""
