"""Structured Streaming: live windows, de-duplication, publishing, shared queries."""
