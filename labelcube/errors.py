"""The library's own errors."""


class InvalidExpressionError(ValueError):
    """A chain that can't run whatever the data are: it indexes a dimension that it has reduced away."""


class UnsupportedError(NotImplementedError):
    """Something that this engine doesn't do, named with what to use instead."""
