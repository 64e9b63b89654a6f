"""Structured Streaming jobs that keep candles and packed rows up to date."""
