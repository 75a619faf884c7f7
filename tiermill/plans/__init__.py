"""Named queries, grouped by layer."""

from __future__ import annotations

from importlib import import_module

GROUPS = ["ingest", "silver", "gold", "quality", "features", "products", "observe", "streams"]


def load_all() -> None:
    """Import every group so that its plans are registered."""
    for group in GROUPS:
        import_module(f"tiermill.plans.{group}")
