"""Operators for preparing training text, each usable on any table with an id and a text column."""
