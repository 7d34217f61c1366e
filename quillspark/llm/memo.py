"""A bounded memory of what a function gave, in two generations."""

from __future__ import annotations

from collections.abc import Callable


class Memo(dict):
    """key -> make(key), remembered. When the young generation is full it becomes the old one and the old one goes; a hit
    in the old one moves to the young. So what comes often is never forgotten, whatever rare keys pass by.

    Bounded by bytes: ``size`` bytes for both generations, an entry counting as its key, its value and ``ENTRY``.
    Long keys are made anew each time.
    """

    ENTRY = 230
    LONGEST = 64

    def __init__(self, make: Callable[[str], bytes], size: int):
        super().__init__()
        self.make, self.half, self.used, self.old = make, size // 2, 0, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > self.LONGEST:
                return value
        self.used += self.ENTRY + len(key) + len(value)
        if self.used > self.half:
            self.old = dict(self)
            self.clear()
            self.used = self.ENTRY + len(key) + len(value)
        self[key] = value
        return value
