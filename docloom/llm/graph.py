"""Connected components, shared with the other operators."""

from ..operators.graph import components  # noqa: F401
