"""Connected components of a link table, as the library has them."""

from __future__ import annotations

from tidewater.operators.graph import connected_components

__all__ = ["connected_components"]
