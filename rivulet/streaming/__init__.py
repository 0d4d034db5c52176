"""Structured Streaming twins of the operators, and custom stateful processors."""
