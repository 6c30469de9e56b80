"""Queries over the engine's tables, each with the SQL that checks it."""
