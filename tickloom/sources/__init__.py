"""Readers and writers of the tick, packed and candle tables."""
