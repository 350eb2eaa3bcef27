"""Connected components of links; the library's own step."""

from tagweave.operators.components import components

__all__ = ["components"]
