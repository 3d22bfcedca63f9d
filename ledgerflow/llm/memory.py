"""What Python workers keep between tasks. Workers are used again by later stages, so what one
operator keeps there (tokenizers, dictionaries, memory that the allocators hold on to) adds up
over a pipeline unless the next operator lets it go."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa

_kept: dict[str, list[Callable[[], None]]] = {}
_owner = [""]


def keeps(operator: str, clear: Callable[[], None]) -> None:
    """Names what empties a cache that an operator keeps in a worker."""
    _kept.setdefault(operator, []).append(clear)


def enter(operator: str) -> None:
    """To be called where an operator's function starts in a worker: caches of others are emptied,
    and free memory goes back to the system. Results don't depend on it."""
    if _owner[0] == operator:
        return
    _owner[0] = operator
    for name, clears in _kept.items():
        if name != operator:
            for clear in clears:
                clear()
    gc.collect()
    give_back()


def give_back() -> None:
    """Free memory of the allocators back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
