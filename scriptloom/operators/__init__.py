"""DataFrame operators over many transcripts at once, keyed by transcript_id."""
