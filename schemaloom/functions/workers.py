"""What a Python worker process keeps from one task to the next."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

# Models or tokenizers that a worker holds at most; the one not used for longest goes.
MOST = 2

_kept: dict[str, Any] = {}


def kept(name: str, load: Callable[[], Any]) -> Any:
    """What `load` returned when this worker first asked for `name`."""
    if name in _kept:
        value = _kept.pop(name)
    else:
        while len(_kept) >= MOST:
            del _kept[next(iter(_kept))]
        value = load()
    # The last in the order is the one used last.
    _kept[name] = value
    return value
