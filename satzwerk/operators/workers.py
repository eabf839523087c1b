"""Helper for code that runs in Python workers."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import TypeVar

T = TypeVar("T")
_made: dict[str, object] = {}
#: Backends of so many plans stay loaded in a worker; the oldest goes first.
KEPT = 4


def worker_key() -> str:
    """A name for a backend, made on the driver when the plan is.

    A factory that is pickled by value is another object in each task, so it
    cannot be its own name.
    """
    return uuid.uuid4().hex


def once_per_worker(make: Callable[[], T], key: str) -> T:
    """What ``make`` builds, once for each key and Python worker."""
    if key not in _made:
        while len(_made) >= KEPT:
            del _made[next(iter(_made))]
        _made[key] = make()
    return _made[key]
