"""What several operators of this subpackage share."""

from __future__ import annotations

from ..session import arrow_map, ship

__all__ = ["arrow_map", "ship"]
