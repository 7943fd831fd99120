"""Unbounded inputs: parser programs and rules of one event variable over streams."""
