"""Connected components: the library's star rounds."""

from ..operators.graph import star_components as connected_components

__all__ = ["connected_components"]
