"""Whole runs over a table of transcripts."""
