"""A worker's memory of what it worked out for keys that come again and again."""

from __future__ import annotations

from collections.abc import Callable
from itertools import repeat

import numpy as np


class Memo:
    """Rows of integers by key, worked out once for all new keys of a call.

    ``make`` takes distinct keys and returns their rows one after another and
    the size of each. Beyond ``values`` integers or ``keys`` keys in memory, or
    for keys longer than ``longest`` bytes, rows are worked out again when they
    are next met; results never change.
    """

    def __init__(self, make: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], values: int = 1 << 23,
                 keys: int = 1 << 20, longest: int = 256):
        self.make, self.values, self.keys, self.longest = make, values, keys, longest
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat = np.empty(1 << 12, np.int64)
        self.at = np.zeros(1 << 10, np.int64)
        self.n = 0

    def _append(self, rows: np.ndarray, sizes: np.ndarray) -> None:
        used, total = int(self.at[self.n]), len(rows)
        while used + total > len(self.flat):
            self.flat = np.concatenate((self.flat, np.empty_like(self.flat)))
        while self.n + len(sizes) + 1 > len(self.at):
            self.at = np.concatenate((self.at, np.zeros_like(self.at)))
        self.flat[used:used + total] = rows
        self.at[self.n + 1:self.n + len(sizes) + 1] = used + np.cumsum(sizes)
        self.n += len(sizes)

    def index(self, keys: list[bytes]) -> np.ndarray:
        """The row number of each key; valid until the next call."""
        if self.at[self.n] > self.values or self.n > self.keys:
            self.forget()
        found = np.fromiter(map(self.known.get, keys, repeat(-1)), np.int64, len(keys))
        missing = np.flatnonzero(found < 0)
        if len(missing):
            new = list(dict.fromkeys(keys[i] for i in missing.tolist()))
            number = dict(zip(new, range(self.n, self.n + len(new))))
            self._append(*self.make(new))
            found[missing] = [number[keys[i]] for i in missing.tolist()]
            self.known.update((k, v) for k, v in number.items() if len(k) <= self.longest)
        return found

    def gather(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of ``index`` one after another, and the size of each."""
        start = self.at[index]
        size = self.at[index + 1] - start
        end = np.cumsum(size)
        total = int(end[-1]) if len(end) else 0
        return self.flat[np.repeat(start - (end - size), size) + np.arange(total)], size
