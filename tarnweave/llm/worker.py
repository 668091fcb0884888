"""What a Python worker keeps between tasks: one operator's tables at a time."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable
from typing import Any

import pyarrow as pa

_slot: dict[str, Any] = {}


def _trim() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()  # Arrow's pool isn't the C library's
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library returns memory by itself
        pass


def held(key: str, make: Callable[[], Any]) -> Any:
    """The object of ``key``, made on first use. Workers outlive operators: another key's object is let go first."""
    if key not in _slot:
        _slot.clear()
        _slot[key] = make()
        _trim()
    return _slot[key]


def release() -> None:
    """Let go of any operator's tables and give what is free back to the system."""
    _slot.clear()
    _trim()
