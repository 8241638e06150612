"""Stateful streaming twins of the batch policy operators."""

from .quota import breaker_stream, token_bucket_stream

__all__ = ["breaker_stream", "token_bucket_stream"]
