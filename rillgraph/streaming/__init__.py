"""Live graphs: keyed state over Structured Streaming, and sinks."""
