"""A cache of query results on shared storage: least recently used leave first, old ones expire.

Results are written tables, so they outlive executors; the driver holds keys,
times and folders only. A result that is cached is read, not computed again.
"""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import DataFrame

from quarrylight.storage import materialize, release

#: fixed values: entries and seconds that a cache keeps
MOST_ENTRIES, MOST_SECONDS = 512, 300.0


class ResultCache:
    """Results by key (repository, commit, question, criteria)."""

    def __init__(self, entries: int = MOST_ENTRIES, seconds: float = MOST_SECONDS, clock: Callable[[], float] = time.monotonic) -> None:
        self.entries, self.seconds, self.clock = entries, seconds, clock
        self.kept: OrderedDict[tuple, tuple[float, DataFrame]] = OrderedDict()
        self.hits = self.misses = 0

    def get(self, key: tuple, build: Callable[[], DataFrame]) -> DataFrame:
        """The cached result of ``key``, else that of ``build``, written once."""
        found = self.kept.get(key)
        if found and self.clock() - found[0] < self.seconds:
            self.kept.move_to_end(key)
            self.hits += 1
            return found[1]
        self.misses += 1
        self._drop(key)
        result = materialize(build(), "cached")
        self.kept[key] = (self.clock(), result)
        while len(self.kept) > self.entries:
            self._drop(next(iter(self.kept)))
        return result

    def invalidate(self, repository: str | None = None) -> int:
        """Forget the results of a repository, or all; returns how many."""
        gone = [k for k in self.kept if repository is None or k[0] == repository]
        for k in gone:
            self._drop(k)
        return len(gone)

    def _drop(self, key: tuple) -> None:
        old = self.kept.pop(key, None)
        if old:
            release(old[1])
