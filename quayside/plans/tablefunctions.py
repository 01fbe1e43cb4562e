"""Packing and retrieval as table functions, so that a policy of one's own runs over any number of independent partitions, from SQL too.

A function takes a table, partitioned and ordered by the caller: `SELECT * FROM f(map('r0', 90D, 'r1', 40D), TABLE(tasks) PARTITION BY shard ORDER BY arrival)`.
The table has shard, agent_id and the demands that the map of capacities names. Rows stream through in the caller's order; a
function holds what is left of the capacity, the ids it took (packing) or its best rows (retrieval) of one partition.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Sequence

from pyspark.sql.functions import udtf

from ..functions.demand import TOLERANCE

Wants = Callable[[Sequence[float], Sequence[float]], bool]
Scores = Callable[[Sequence[float], Sequence[float]], float]


def fits(demand: Sequence[float], left: Sequence[float]) -> bool:
    return all(x <= c + TOLERANCE for x, c in zip(demand, left, strict=True))


def _places(row, names: Sequence[str]) -> list[int]:
    """Where a row of the table holds the demands; the same for all of its rows, so that no row is searched by name."""
    return [row.__fields__.index(d) for d in names]


def _demand_of(row, places: Sequence[int]) -> list[float]:
    """The row's demands; a null one is an error, as it would fit anywhere."""
    try:
        return [float(row[k]) for k in places]
    except TypeError:
        raise ValueError(f"task {row['agent_id']} has a demand of null") from None


def packing(wants: Wants = fits):
    """A table function (shard, agent_id, seq) of the tasks that a policy takes, in order; wants sees a demand and what is left.

    A policy that takes what doesn't fit, and a partition with an id twice among the tasks taken, are errors; so is a null
    demand. A partition without tasks has no rows.
    """

    class Packing:
        def __init__(self):
            self.left, self.places, self.taken = None, (), set()

        def eval(self, capacity: dict, row):
            if self.left is None:
                self.places, self.left = _places(row, list(capacity)), [float(c) for c in capacity.values()]
            demand = _demand_of(row, self.places)
            if not wants(demand, list(self.left)):
                return
            if not fits(demand, self.left):
                raise ValueError(f"the policy took task {row['agent_id']}, which does not fit")
            if row["agent_id"] in self.taken:
                raise ValueError(f"task {row['agent_id']} was taken twice")
            self.left = [c - x for c, x in zip(self.left, demand, strict=True)]
            self.taken.add(row["agent_id"])
            yield row["shard"], row["agent_id"], len(self.taken) - 1

    return udtf(Packing, returnType="shard bigint, agent_id bigint, seq bigint")


def retrieval(scores: Scores):
    """A table function (shard, agent_id, score, place) of the k best tasks that fit, by a score of one's own, then by least id.

    It takes k after the capacities and holds k tasks of a partition. k under 1 gives no rows.
    """

    class Retrieval:
        def __init__(self):
            self.best, self.shard, self.limit, self.places = [], None, None, ()

        def eval(self, capacity: dict, k: int, row):
            if self.limit is None:
                self.places, self.limit, self.shard = _places(row, list(capacity)), [float(c) for c in capacity.values()], row["shard"]
            demand = _demand_of(row, self.places)
            if k > 0 and fits(demand, self.limit):
                entry = (float(scores(demand, list(self.limit))), -row["agent_id"])
                if len(self.best) < k:
                    heapq.heappush(self.best, entry)
                else:
                    heapq.heappushpop(self.best, entry)

        def terminate(self):
            for place, (score, negative) in enumerate(sorted(self.best, reverse=True)):
                yield self.shard, -negative, score, place

    return udtf(Retrieval, returnType="shard bigint, agent_id bigint, score double, place bigint")
