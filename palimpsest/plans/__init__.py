"""Queries over whole tables, and the SQL that must give the same rows."""
