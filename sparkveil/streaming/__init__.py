"""Streaming twins of the keyed state: step counters, replay checks and rings."""
