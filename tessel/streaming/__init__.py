"""Structured Streaming forms of the stateless operators and time-windowed aggregates."""

from tessel.streaming.windows import tumbling_aggregate

__all__ = ["tumbling_aggregate"]
