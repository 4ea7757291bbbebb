"""Change streams: keyed state, late records, replay, merges; batch forms and Structured Streaming."""
