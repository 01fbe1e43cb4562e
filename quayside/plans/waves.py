"""Waves: each task gets the number of the batch it runs in, by rounds of set-wide queries."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..functions.demand import TOLERANCE, Amounts, by_demand, demand_columns, demands_of, like_given, rank_key, score
from ..operators.order import ranked, running_sums, task_count
from ..operators.pack import WINDOW, best_fit, best_outside, first_fit_window, pool_batches, scan_in_order
from ..operators.retrieve import POOL, active, scored, top_k
from ..sources.shared import written

MOST_WAVES = 10_000
#: Ids of batches that are sent to all tasks (8 MB) before what is left is written again.
KEPT_GONE = 1 << 20
#: Windows that one task packs at a time where tasks begin not to fit.
LOOKED = 4
#: Pools of the best tasks that one task packs batches from.
FRONT = 32


@dataclass
class Policy:
    """How a batch is taken from active tasks, what remains and the capacity; it looks at rows tasks at most.

    A policy that is first fit over the first rows tasks of an order names it as rank, one that is best fit over the rows best
    by a method's score names that.
    """

    take: Callable[[DataFrame, Amounts, Amounts], DataFrame]
    rows: int
    rank: str | None = None
    method: str | None = None


def require_equal_durations(tasks: DataFrame) -> None:
    """Waves end together, so tasks whose durations differ by more than 1e-12 from the least are an error; without a duration they count as equal."""
    if "duration" not in tasks.columns:
        return
    span = tasks.agg(F.min("duration").alias("least"), F.max("duration").alias("greatest")).first()
    if span["least"] is not None and float(span["greatest"]) - float(span["least"]) > 1e-12:
        raise ValueError(f"durations from {span['least']} to {span['greatest']}: waves need equal ones")


def strict_starts(tasks: DataFrame, capacity: Amounts, rows: int, rank: str = "agent_id") -> list[int]:
    """First rank of each wave when tasks run strictly in order: a wave ends before the first that does not fit.

    The running sums are written once. Each wave is then one aggregate over the rows after its start.
    """
    demands = demands_of(capacity)
    summed = written(running_sums(tasks.select(rank, *demands), rank, demands, rows), "sums")
    starts, base = [], [0] * len(demands)
    start = 0 if rows else None
    while start is not None:
        starts.append(start)
        if len(starts) > MOST_WAVES:
            raise RuntimeError(f"more than {MOST_WAVES} waves")
        over = F.lit(False)
        for (d, c), b in zip(by_demand(capacity).items(), base, strict=True):
            over = over | (F.col(f"s_{d}") > F.lit(b + c))
        first = summed.where((F.col(rank) >= start) & over).agg(F.min(F.struct(rank, *((F.col(f"s_{d}") - F.col(d)).alias(f"b_{d}") for d in demands))).alias("x")).first()["x"]
        if first is None:
            break
        if first[rank] == start:
            raise ValueError(f"task {start} fits no wave")
        start, base = first[rank], [first[f"b_{d}"] for d in demands]
    return starts


def strict_waves(tasks: DataFrame, capacity: Amounts, rows: int, rank: str = "agent_id") -> DataFrame:
    """tasks with wave, strictly in order of arrival, which is any dense rank. Durations must be equal."""
    require_equal_durations(tasks)
    starts = strict_starts(tasks, capacity, rows, rank)
    wave = F.size(F.filter(F.array(*(F.lit(s).cast("bigint") for s in starts)), lambda s: s <= F.col(rank))) - 1 if starts else F.lit(None)
    return tasks.withColumn("wave", wave.cast("bigint"))


def fifo_policy(window: int = WINDOW, rank: str = "agent_id") -> Policy:
    """The first so many active tasks by rank, whether or not ranks between are gone."""
    return Policy(lambda tasks, remaining, capacity: first_fit_window(tasks, remaining, rank, window), window, rank)


def sparse_policy(method: str, pool: int = POOL) -> Policy:
    """The best pool of a method's proxy, packed by best fit."""
    return Policy(lambda tasks, remaining, capacity: best_fit(top_k(scored(tasks, method, remaining, capacity), pool), remaining, pool), pool, method=method)


def first_come_waves(tasks: DataFrame, capacity: Amounts, window: int = WINDOW, rank: str = "agent_id") -> DataFrame:
    """tasks with wave, where each batch is first fit over the first window tasks that are left, in the order of distinct ranks.

    What a batch skips doesn't fit later in its wave either. So a wave takes what fits along the ranks, until it has skipped
    window tasks or has seen all. Those skipped begin the next wave, and behind them nothing has been looked at. Running sums,
    written once, give the stretches that fit whole, by one aggregate each; between them one task packs a
    few windows at most. The driver holds the stretches' ends.
    """
    demands, limit = demands_of(capacity), by_demand(capacity)
    told = tasks.agg(F.count(F.lit(1)).alias("n"), F.min(rank).alias("least"), F.max(rank).alias("greatest")).first()
    rows = told["n"]
    dense = rows == 0 or (told["least"], told["greatest"]) == (0, rows - 1)
    own = tasks.withColumn("_place", F.col(rank).cast("bigint")) if dense else ranked(tasks, [rank], "_place")
    summed = written(running_sums(own.select("agent_id", "_place", *demands), "_place", demands, rows), "sums")
    stretches, placed, skipped = [], None, None
    wave, at, n_skipped, base = 0, 0, 0, dict.fromkeys(demands, 0)

    def look(pool: DataFrame, left: dict, skips: int) -> tuple[DataFrame, dict]:
        """First fit over a bounded pool: the rows it saw, and how many and how much it saw and took."""
        seen = written(scan_in_order(pool.select("agent_id", "_place", *demands), left, "_place", skips), "seen")
        sums = [f(x).alias(f"{n}_{d}") for d in demands for n, f, x in (("seen", F.sum, F.col(d)), ("took", F.sum, F.when(F.col("took"), F.col(d))))]
        return seen, seen.agg(F.count(F.lit(1)).alias("seen"), F.count(F.when(F.col("took"), 1)).alias("took"), *sums).first().asDict()

    while at < rows or n_skipped:
        left, taken, parts = dict(limit), 0, []

        def put(seen: DataFrame, found: dict) -> None:
            nonlocal placed, left, taken, n_skipped
            took = seen.where("took").select("agent_id", F.lit(wave).cast("bigint").alias("wave"))
            placed = took if placed is None else placed.unionByName(took)
            parts.append(seen.where("NOT took").drop("took"))
            left = {d: c - (found[f"took_{d}"] or 0) for d, c in left.items()}
            taken, n_skipped = taken + found["took"], n_skipped + found["seen"] - found["took"]

        if n_skipped:
            n_skipped = 0
            put(*look(skipped, left, window))
        while at < rows and n_skipped < window:
            over = F.lit(False)
            for d, c in left.items():
                over = over | (F.col(f"s_{d}") > F.lit(base[d] + c + (0 if isinstance(c, int) else TOLERANCE)))
            first = summed.where((F.col("_place") >= at) & over).agg(F.min(F.struct("_place", *((F.col(f"s_{d}") - F.col(d)).alias(d) for d in demands))).alias("x")).first()["x"]
            end = rows if first is None else first["_place"]
            if end > at:
                stretches.append((at, end, wave))
                taken += end - at
            if first is None:
                at = rows
                break
            left, base, at = {d: c - (first[d] - base[d]) for d, c in left.items()}, {d: first[d] for d in demands}, end
            seen, found = look(summed.where((F.col("_place") >= at) & (F.col("_place") < at + LOOKED * window)), left, window - n_skipped)
            base, at = {d: b + found[f"seen_{d}"] for d, b in base.items()}, at + found["seen"]
            put(seen, found)
        if not taken:
            raise ValueError("a task fits no wave")
        skipped = None
        for part in parts:
            skipped = part if skipped is None else skipped.unionByName(part)
        wave += 1
        if wave > MOST_WAVES:
            raise RuntimeError(f"more than {MOST_WAVES} waves")
    whole = F.expr("CASE " + " ".join(f"WHEN _place >= {a} AND _place < {b} THEN {w}L" for a, b, w in stretches) + " END") if stretches else F.lit(None).cast("bigint")
    done = own.withColumn("wave", whole)
    out = done.where(F.col("wave").isNotNull())
    if placed is not None:
        out = out.unionByName(done.where(F.col("wave").isNull()).drop("wave").join(placed, "agent_id"))
    return out.select(*tasks.columns, "wave")


def by_level(tasks: DataFrame, capacity: Amounts, rows: int, step: int) -> tuple[DataFrame, list[Row]]:
    """Tasks from the best by mp for the whole capacity on, and where stretches of step of them at most begin (_at), their rows and their best score (level)."""
    below = (-rank_key(score("mp", capacity, capacity))).alias("_below")
    spread = tasks.select("agent_id", *demands_of(capacity), below).repartitionByRange(task_count(rows), "_below", "agent_id").sortWithinPartitions("_below", "agent_id")
    spread = written(spread.select("*", F.monotonically_increasing_id().alias("_at")), "levels")
    stretch = F.floor(F.col("_at") / F.lit(step))
    return spread, spread.groupBy(stretch).agg(F.min("_at").alias("at"), F.count(F.lit(1)).alias("n"), (-F.min("_below")).alias("level")).orderBy("at").collect()


def mp_pool_waves(tasks: DataFrame, capacity: Amounts, policy: Policy, rows: int, least: list, greatest: list) -> DataFrame:
    """(agent_id, wave) of policy_waves for a policy by mp, without a pass over all that is left for each batch.

    What remains shrinks about evenly, so the best tasks are nearly those for the whole capacity. The table is sorted by that score once,
    and its best rows are the front: one task packs batches from it as long as nothing behind it could be in a pool. Where it could, at the end of a
    wave mostly, Spark takes one batch from all rows that may reach the front's last score. The driver holds where stretches of the table begin.
    Batches are written; what is left of the front is written again when KEPT_GONE of its ids are gone.
    """
    pool, amounts = policy.rows, list(by_demand(capacity).values())
    most = min(FRONT * pool, max(pool, rows // 4))
    base, stretches = by_level(tasks, capacity, rows, max(1, most // 32))
    demands, closed = demands_of(capacity), 0
    front, n_front, gone, n_gone, ahead, n_ahead = base.limit(0), 0, None, 0, None, 0
    done, wave, remaining, fresh, floor = None, 0, capacity, True, None

    def behind(start: int, end: int) -> DataFrame:
        """Stretches of the table from start to before end."""
        rows_there = base.where(F.col("_at") >= (stretches[start]["at"] if start < len(stretches) else 1 << 62))
        rows_there = rows_there.where(F.col("_at") < stretches[end]["at"]) if end < len(stretches) else rows_there
        return rows_there if ahead is None else active(rows_there, ahead, bounded=True)

    def left_in_front() -> DataFrame:
        return front if gone is None else active(front, gone, bounded=n_gone < KEPT_GONE)

    def reach(at: int) -> float:
        """The best score that a task from a stretch on may have now."""
        return best_outside(stretches[at]["level"], list(by_demand(remaining).values()), amounts, greatest)

    while rows:
        opened = closed
        while closed < len(stretches) and (not n_front or n_front + stretches[closed]["n"] <= most):
            n_front, closed = n_front + stretches[closed]["n"], closed + 1
        if closed > opened:
            front = front.unionByName(behind(opened, closed))
        level = stretches[closed]["level"] if closed < len(stretches) else None
        alone = floor is None or level is None or (closed > opened and (not floor or reach(closed) < floor))
        if alone:
            batch = pool_batches(left_in_front(), remaining, capacity, pool, wave, least, greatest, level)
        else:
            near = left_in_front().unionByName(behind(closed, next((at for at in range(closed, len(stretches)) if reach(at) < floor), len(stretches))))
            near = near.where(rank_key(score("mp", remaining, capacity)) >= F.lit(floor - 1e-3))
            batch = policy.take(near, remaining, capacity).select("agent_id", *demands, F.lit(wave).cast("bigint").alias("wave"), F.lit(None).cast("double").alias("floor"), F.lit(-1).alias("n_left"))
        batch = written(batch, "batch")
        told = {r["wave"]: r for r in batch.groupBy("wave").agg(F.count("agent_id").alias("n"), F.max("floor").alias("floor"), F.max("n_left").alias("n_left"), *(F.sum(d).alias(d) for d in demands)).collect()}
        n, now = sum(r["n"] for r in told.values()), max(told, default=wave)
        last, rows = told.get(now), rows - n
        remaining, fresh = (remaining, fresh) if now == wave else (capacity, True)
        if last and last["n"]:
            fresh = False
            remaining = like_given([r - last[d] for d, r in by_demand(remaining).items()], remaining)
        if alone:
            wave, floor, n_front = now, last["floor"] or 0.0, last["n_left"]
        else:
            floor = None
            if not n and not fresh:
                wave, remaining, fresh, n = wave + 1, capacity, True, None
        if rows and (n == 0 and fresh and not alone or level is None and alone):
            raise ValueError("a task fits no wave")
        if wave >= MOST_WAVES:
            raise RuntimeError(f"more than {MOST_WAVES} waves")
        if n:
            taken = batch.where(F.col("agent_id").isNotNull())
            ids, n_gone = taken.select("agent_id"), n_gone + n
            done = taken.select("agent_id", "wave") if done is None else done.unionByName(taken.select("agent_id", "wave"))
            gone = ids if gone is None else gone.unionByName(ids)
            if not alone:
                ahead, n_ahead = ids if ahead is None else ahead.unionByName(ids), n_ahead + n
            if n_gone >= KEPT_GONE and rows:
                front, gone, n_gone = written(left_in_front(), "left"), None, 0
            if n_ahead >= KEPT_GONE and rows:
                base, ahead, n_ahead = written(behind(closed, len(stretches)), "levels"), None, 0
    return done if done is not None else tasks.select("agent_id", F.lit(0).cast("bigint").alias("wave")).limit(0)


def policy_waves(tasks: DataFrame, capacity: Amounts, policy: Policy) -> DataFrame:
    """tasks with wave: in each wave batches are taken until none fits, then capacity is whole again.

    Batches are written, and what is left is the table without their ids; it is written again when KEPT_GONE of them are gone. A
    batch that all active tasks were looked at for leaves none that fits, as demands are positive. Durations must be equal.
    First-come policies need no such rounds, first_come_waves gives the same waves; nor do pools by mp over demands that are not negative: mp_pool_waves.
    """
    require_equal_durations(tasks)
    if policy.rank is not None:
        return first_come_waves(tasks, capacity, policy.rows, policy.rank)
    demands = demands_of(capacity)
    if policy.method == "mp":
        told = tasks.agg(F.count(F.lit(1)).alias("n"), *(f(d) for d in demands for f in (F.min, F.max, F.count))).first()
        least, greatest, counts = told[1::3], told[2::3], told[3::3]
        if set(counts) == {told["n"]} and min(least, default=-1) >= 0:
            return tasks.join(mp_pool_waves(tasks, capacity, policy, told["n"], list(least), list(greatest)), "agent_id")
    base, left, done, gone, n_gone, wave = tasks, tasks, None, None, 0, 0
    rows = left.count()
    while rows:
        remaining, got_any = capacity, False
        while rows:
            batch = written(policy.take(left, remaining, capacity).select("agent_id", *demands, F.lit(wave).cast("bigint").alias("wave")), "batch")
            used = batch.agg(F.count(F.lit(1)).alias("n"), *(F.sum(d).alias(d) for d in demands)).first()
            if not used["n"]:
                break
            got_any, whole, rows = True, rows <= policy.rows, rows - used["n"]
            remaining = like_given([r - used[d] for d, r in by_demand(remaining).items()], remaining)
            done = batch if done is None else done.unionByName(batch)
            ids, n_gone = batch.select("agent_id"), n_gone + used["n"]
            gone = ids if gone is None else gone.unionByName(ids)
            left = active(base, gone, bounded=True)
            if n_gone >= KEPT_GONE:
                base = left = written(left, "left")
                gone, n_gone = None, 0
            if whole:
                break
        if not got_any:
            raise ValueError("a task fits no wave")
        wave += 1
        if wave > MOST_WAVES:
            raise RuntimeError(f"more than {MOST_WAVES} waves")
    placed = done.select("agent_id", "wave") if done is not None else tasks.select("agent_id", F.lit(0).cast("bigint").alias("wave")).limit(0)
    return tasks.join(placed, "agent_id")


def trace(waves: DataFrame, demands: Sequence[str] | None = None) -> DataFrame:
    """Waves of one unit of time each as starts and finishes."""
    demands = demand_columns(waves, demands)
    return waves.select("agent_id", F.col("wave").cast("double").alias("start"), (F.col("wave") + 1).cast("double").alias("finish"), "wave", *demands)


def wave_summary(waves: DataFrame, demands: Sequence[str] | None = None) -> DataFrame:
    """For each wave its tasks and what they use."""
    demands = demand_columns(waves, demands)
    return waves.groupBy("wave").agg(F.count(F.lit(1)).alias("n_tasks"), *(F.sum(d).cast("bigint").alias(f"used_{d}") for d in demands))
