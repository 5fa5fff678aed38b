"""Structured Streaming front end: keep the score histogram as streaming state
and compute the batch metrics from it on every trigger."""
