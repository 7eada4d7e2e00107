"""A cache of result pages by plan: bounded, with a time to live, cleared when the corpus' version changes."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import DataFrame

from quarry.plans.query import SearchPlan


class PageCache:
    """Holds persisted pages (a plan's limit of rows at most each); the oldest goes when it is full."""

    def __init__(self, entries: int = 100, seconds: float = 300.0, clock: Callable[[], float] = time.monotonic) -> None:
        self.entries, self.seconds, self.clock = entries, seconds, clock
        self.version: object = None
        self._pages: OrderedDict[SearchPlan, tuple[float, DataFrame]] = OrderedDict()

    def get(self, plan: SearchPlan, make: Callable[[SearchPlan], DataFrame], version: object = None) -> DataFrame:
        """The plan's page of the corpus' version; pages of another version are gone."""
        if version != self.version:
            self.clear()
            self.version = version
        now = self.clock()
        if (held := self._pages.get(plan)) and now - held[0] < self.seconds:
            return held[1]
        if held:
            self._drop(plan)
        while len(self._pages) >= self.entries:
            self._drop(next(iter(self._pages)))
        page = make(plan).persist()
        self._pages[plan] = now, page
        return page

    def _drop(self, plan: SearchPlan) -> None:
        self._pages.pop(plan)[1].unpersist()

    def clear(self) -> None:
        for plan in list(self._pages):
            self._drop(plan)
