"""One model per Python worker.

Workers outlive their task and are shared by the operators of a job. What an
operator keeps between tasks (a tokenizer with the words it has seen, automata)
goes into the one slot here, so the next operator's model takes its place
instead of adding to it.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable
from typing import Any

_slot: tuple[tuple, Any] | None = None


def release() -> None:
    """Drop the model and give its memory back."""
    global _slot
    if _slot is not None:
        _slot = None
        gc.collect()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # not glibc
            pass


def hold(key: tuple, build: Callable[[], Any]) -> Any:
    """The model of ``key``; built, in place of another, unless it is there."""
    global _slot
    if _slot is None or _slot[0] != key:
        release()
        _slot = (key, build())
    return _slot[1]
