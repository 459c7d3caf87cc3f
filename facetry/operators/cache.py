"""A small first-in first-out cache of concentration reports; a wider range of sizes answers a narrower one."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Hashable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ReportCache:
    def __init__(self, most: int = 3) -> None:
        self.most = most
        self._held: OrderedDict[tuple[Hashable, int, int], DataFrame] = OrderedDict()

    def get(self, key: Hashable, low: int, high: int, make: Callable[[int, int], DataFrame]) -> DataFrame:
        """The report of segments of low to high variables; ``make`` must give var<i>_name columns up to its high."""
        for (k, a, b), df in self._held.items():
            if k == key and a <= low and high <= b:
                size = sum((F.col(f"var{i}_name").isNotNull().cast("int") for i in range(2, b + 1)), F.lit(1))
                return df if (a, b) == (low, high) else df.where(size.between(low, high)).drop(*[f"var{i}_{x}" for i in range(high + 1, b + 1) for x in ("name", "value")])
        for k in [k for k in self._held if k[0] == key and low <= k[1] and k[2] <= high]:
            self._held.pop(k).unpersist()
        while len(self._held) >= self.most:
            self._held.popitem(last=False)[1].unpersist()
        self._held[key, low, high] = make(low, high).cache()
        return self._held[key, low, high]
