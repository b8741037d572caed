"""Reading transcripts and stored objects."""
