"""Reading arguments: kinds, directions and edge kinds by name."""

from __future__ import annotations

from kgraph import model
from kgraph.operators.traversal import DIRECTIONS


def node_kind(name: str | None) -> str | None:
    if name is not None and name not in model.NODE_TAGS:
        raise ValueError(f"unknown kind {name!r}; valid: {', '.join(model.NODE_TAGS)}")
    return name


def direction(name: str | None) -> str:
    if name is None:
        return "both"
    if name not in DIRECTIONS:
        raise ValueError(f"unknown direction {name!r}; valid: {', '.join(DIRECTIONS)}")
    return name


def edge_kinds(names: list[str] | None) -> list[str] | None:
    """Names of edge kinds; none given means all."""
    for name in names or []:
        if name not in model.EDGE_KINDS:
            raise ValueError(f"unknown edge kind {name!r}; valid: {', '.join(model.EDGE_KINDS)}")
    return names or None
