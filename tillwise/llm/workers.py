"""Memory of the Python workers, which live on from stage to stage beside the executor's JVM."""

from __future__ import annotations

import ctypes

import pyarrow as pa

#: What the operator that worked last keeps for its next tasks, by operator.
_KEPT: dict[str, dict] = {}
try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError, TypeError):  # not glibc
    _TRIM = None


def kept(operator: str) -> dict:
    """A cache that lasts until another operator works in this process."""
    for other in _KEPT.keys() - {operator}:
        del _KEPT[other]
    return _KEPT.setdefault(operator, {})


def trim() -> None:
    """Gives freed memory back to the system: an idle worker would hold the most that any task of it took."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)
