"""A bounded cache of collected results, on the driver."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable
from copy import deepcopy


def cache_key(query: str, top_k: int, min_score: float, source: str = "", categories: list[str] | None = None) -> str:
    return "\0".join([query, str(top_k), f"{min_score:g}", source, ",".join(sorted(categories or []))])


class ResultCache:
    """Least recently used entries go first; entries older than ``ttl`` seconds are no hits.  A bound of 0 disables it."""

    def __init__(self, size: int = 512, ttl: float = 60.0, clock: Callable[[], float] = time.monotonic):
        self.size, self.ttl, self.clock = size, ttl, clock
        self.entries: OrderedDict[str, tuple[float, list]] = OrderedDict()

    @property
    def enabled(self) -> bool:
        return self.size > 0 and self.ttl > 0

    def get(self, key: str) -> list | None:
        if not self.enabled or key not in self.entries:
            return None
        expires, value = self.entries[key]
        if self.clock() > expires:
            del self.entries[key]
            return None
        self.entries.move_to_end(key)
        return deepcopy(value)

    def put(self, key: str, value: list) -> None:
        if not self.enabled:
            return
        self.entries[key] = (self.clock() + self.ttl, deepcopy(value))
        self.entries.move_to_end(key)
        while len(self.entries) > self.size:
            self.entries.popitem(last=False)
