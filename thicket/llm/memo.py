"""A memo of bounded size for the Python side of a task."""

from __future__ import annotations

from collections.abc import Callable, Hashable

#: What an entry costs beside the characters of its key and value, about: two objects and a place in the table.
ENTRY_BYTES = 200


class Memo(dict):
    """Values that `make` gives for keys, in `most` bytes at most, about.

    Entries lie in two generations.  When the young one holds half of the bytes it becomes the old one, and what the old
    one held goes; a key that is found among the old becomes young again.  So what is in use stays, however much a
    task sees.  Keys of more than `longest` characters are not kept.
    """

    def __init__(self, make: Callable, most: int, longest: int = 256):
        self.make, self.most, self.longest = make, most, longest
        self.old: dict[Hashable, object] = {}
        self.weight = 0

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > self.longest:
                return value
        self.weight += ENTRY_BYTES + len(key) + (len(value) if isinstance(value, str) else 0)
        if 2 * self.weight > self.most:
            self.old = dict(self)
            super().clear()
            self.weight = 0
        self[key] = value
        return value

    def clear(self) -> None:
        super().clear()
        self.old = {}
        self.weight = 0
