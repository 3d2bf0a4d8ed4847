"""A small cache of responses: by operation and parameters in any order, for a time, up to a number of entries."""

from __future__ import annotations

import json
import time
from collections import OrderedDict
from collections.abc import Callable, Iterable, Mapping
from typing import Any


class ResponseCache:
    """Only operations in allowed (None: all) are kept, and only answers that hang on no identity."""

    def __init__(self, ttl: float = 30.0, most: int = 256, allowed: Iterable[str] | None = None, clock: Callable[[], float] = time.monotonic):
        self.ttl, self.most, self.allowed, self.clock = ttl, most, None if allowed is None else set(allowed), clock
        self.entries: OrderedDict[str, tuple[float, Any]] = OrderedDict()

    @staticmethod
    def key(op: str, params: Mapping[str, Any]) -> str:
        return json.dumps([op, sorted((k, str(v)) for k, v in params.items())])

    def get(self, op: str, params: Mapping[str, Any], make: Callable[[], Any], identity: Any = None) -> Any:
        if identity is not None or self.allowed is not None and op not in self.allowed or self.ttl <= 0:
            return make()
        key, now = self.key(op, params), self.clock()
        hit = self.entries.get(key)
        if hit and now - hit[0] < self.ttl:
            self.entries.move_to_end(key)
            return hit[1]
        value = make()
        self.entries[key] = (now, value)
        self.entries.move_to_end(key)
        while len(self.entries) > self.most:
            self.entries.popitem(last=False)
        return value
