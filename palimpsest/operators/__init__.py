"""Relational operators over words, spans, numbers and findings."""
