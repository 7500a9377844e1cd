"""Structured Streaming: redaction of streams, request and response state, pairing codes."""
