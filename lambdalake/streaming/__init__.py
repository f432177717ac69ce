"""Trial analytics over streams: an addition of this library, in Structured Streaming."""
