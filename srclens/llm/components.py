"""Connected components of an edge table by alternating star contraction."""

from srclens.operators.graph import connected_components

__all__ = ["connected_components"]
