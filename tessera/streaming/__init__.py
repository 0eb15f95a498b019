"""Structured Streaming forms of stateless and session operators."""
