"""Structured Streaming jobs over the same builders."""
