"""Stateful operators of Structured Streaming."""
