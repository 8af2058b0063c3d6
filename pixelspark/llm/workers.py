"""Memory of Python workers, which live longer than their tasks."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable

import pyarrow as pa


def kept(name: str, make: Callable):
    """What an earlier task of this worker made under ``name``; one thing is kept at a time."""
    store = sys.__dict__.setdefault("_pixelspark_kept", {})
    if name not in store:
        release()
        store[name] = make()
    return store[name]


def trim() -> None:
    """Gives free memory back to the system, as Arrow and the C library would keep what a batch needed."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back is not None:
        give_back(0)


def release() -> None:
    """Forgets what is kept and gives free memory back to the system."""
    sys.__dict__.get("_pixelspark_kept", {}).clear()
    trim()
