"""The same work on unbounded input, with Structured Streaming."""
