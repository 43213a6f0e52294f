"""Structured Streaming: event replay, run states, rate limits, score changes."""
