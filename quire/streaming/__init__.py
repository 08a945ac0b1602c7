"""Incremental (append-mode) evaluation with Structured Streaming."""

from quire.streaming.incremental import current_evaluations, run_incremental_scoring

__all__ = ["run_incremental_scoring", "current_evaluations"]
