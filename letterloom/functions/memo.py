"""Results kept from message to message."""

from __future__ import annotations

from collections.abc import Callable, Hashable


class Memo(dict):
    """What a function gave for each argument; forgotten together beyond ``most``. Unlike functools.lru_cache it is pickled
    by value with the function, and callers share the results."""

    def __init__(self, function: Callable, most: int = 1024) -> None:
        super().__init__()
        self.function, self.most = function, most

    def __missing__(self, key: Hashable) -> object:
        value = self.function(key)
        if len(self) >= self.most:
            self.clear()
        self[key] = value
        return value
