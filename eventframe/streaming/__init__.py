"""Structured Streaming form of the online operators."""

from eventframe.streaming.early_stop import early_stop_monitor

__all__ = ["early_stop_monitor"]
