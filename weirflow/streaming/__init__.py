"""Live forms of the stream operators in Structured Streaming."""
