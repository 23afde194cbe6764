"""One large object per Python worker: a worker outlives its task and serves other operators next."""

from __future__ import annotations

import gc
from collections.abc import Callable, Hashable
from typing import TypeVar

import pyarrow as pa

T = TypeVar("T")
_HELD: dict[Hashable, object] = {}


def held(key: Hashable, make: Callable[[], T]) -> T:
    """The object under `key`, made where the worker does not hold it; what it held before is let go."""
    if key not in _HELD:
        release()
        _HELD[key] = make()
    return _HELD[key]


def release() -> None:
    """Let go of what the worker holds, back to the system; for operators that hold nothing themselves."""
    _HELD.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
