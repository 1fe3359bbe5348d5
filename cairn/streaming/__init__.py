"""Structured Streaming over the engine's sources and operators."""
