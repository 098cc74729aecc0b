"""The registered queries, one module per operator family, each beside its oracle."""

from __future__ import annotations

from importlib import import_module

FAMILIES = (
    "sources",
    "boxes",
    "headers",
    "samples",
    "digests",
    "manifests",
    "comparison",
    "library",
    "exports",
    "registers",
    "textscans",
    "reads",
)


def load() -> None:
    """Imports every family, which fills the registry."""
    for family in FAMILIES:
        import_module(f"strongroom.plans.{family}")
