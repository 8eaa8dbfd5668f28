"""Structured Streaming: index upkeep and standing queries."""
