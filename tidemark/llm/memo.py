"""A dictionary that fills itself and stays bounded."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any


class Memo(dict):
    """``memo[key]`` is ``make(key)``, computed once while it is remembered.

    At most ``2 * keep`` entries are held: when *keep* are new, they become the old
    generation and the former old one is forgotten. Keys longer than *longest* are
    never held. Forgetting costs time only.
    """

    def __init__(self, make: Callable[[Any], Any], keep: int = 400_000, longest: int = 64):
        super().__init__()
        self.make, self.keep, self.longest, self.old = make, keep, longest, {}

    def __missing__(self, key: Any) -> Any:
        if len(key) > self.longest:
            return self.make(key)
        if len(self) >= self.keep:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value
