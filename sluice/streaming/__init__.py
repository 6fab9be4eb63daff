"""Logs as streams: the keyed operators over micro-batches, with the same results as over the whole log."""

from sluice.streaming.logs import stream_final_state, stream_stacks

__all__ = ["stream_final_state", "stream_stacks"]
