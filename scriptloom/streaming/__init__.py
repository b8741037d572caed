"""Job intake with Structured Streaming."""
