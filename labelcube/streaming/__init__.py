"""Chains over the micro-batches of a stream. The operations themselves are of batches: a window here is of positions, not of arrival."""

from .batches import each_batch

__all__ = ["each_batch"]
