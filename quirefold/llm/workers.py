"""What a Python worker keeps between tasks.

Spark hands a worker from one stage to the next, so an operator's vocabulary and remembered pieces would
stay in memory while others work.  An operator claims the worker when a task of its begins: what others
kept is let go.
"""

from __future__ import annotations

import ctypes
import gc

_kept: dict[str, dict] = {}


def claim(owner: str) -> dict:
    """The dictionary in which ``owner`` may keep things; those of all other operators are emptied."""
    others = [k for k in _kept if k != owner and _kept[k]]
    if others:
        for k in others:
            _kept.pop(k).clear()
        gc.collect()
        try:
            ctypes.CDLL(None).malloc_trim(0)  # glibc: give freed memory back
        except (OSError, AttributeError):
            pass
    return _kept.setdefault(owner, {})
