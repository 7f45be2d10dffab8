"""Rows of a frame in a form that tests compare."""

from __future__ import annotations


def by(rows, *keys):
    """Rows as dictionaries, sorted by the keys."""
    return sorted((r.asDict() for r in rows), key=lambda r: tuple(r[k] for k in keys))
