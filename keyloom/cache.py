"""A keyed cache whose entries expire; what it holds is bounded."""

from __future__ import annotations

import threading
import time
from collections import OrderedDict
from collections.abc import Callable
from typing import Generic, TypeVar

from keyloom.schema import CACHE_SECONDS

V = TypeVar("V")


class Cache(Generic[V]):
    """``set`` (again) begins a lifetime of ``seconds``; beyond ``most`` entries the oldest goes."""

    def __init__(self, seconds: float = CACHE_SECONDS, most: int = 10_000, clock: Callable[[], float] = time.monotonic):
        self.seconds, self.most, self.clock = seconds, most, clock
        self._held: OrderedDict[str, tuple[float, V]] = OrderedDict()
        self._lock = threading.Lock()

    def set(self, key: str, value: V) -> None:
        with self._lock:
            self._held.pop(key, None)
            self._held[key] = (self.clock() + self.seconds, value)
            while len(self._held) > self.most:
                self._held.popitem(last=False)

    def get(self, key: str) -> V:
        """Raises KeyError for what is missing or expired."""
        with self._lock:
            until, value = self._held[key]
            if until <= self.clock():
                del self._held[key]
                raise KeyError(key)
            return value

    def has(self, key: str) -> bool:
        try:
            self.get(key)
        except KeyError:
            return False
        return True
