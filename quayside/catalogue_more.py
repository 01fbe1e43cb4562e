"""Queries on tasks with any number of named demands, on an order of arrival apart from the ids, on reports, counters and traces."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalogue import _RESULTS, CAPS, GATE, POOL, REMS, SCORE, SHARED, TASKS, TENTHS, WINDOW, _context, _fold, _results, _target, query
from .functions.demand import DEMANDS, METHODS, uniform_sql
from .operators import metrics, pack, proximal, retrieve, solve
from .operators.order import arrival_ranks, reranked, with_arrival
from .operators.signed_rank import signed_rank
from .operators.usage import usage_over_time, usage_totals
from .plans import counted
from .plans import waves as plans
from .plans.tablefunctions import packing, retrieval
from .sources.shared import written
from .sources.tables import WAVES, capacities, lineitem_tasks, table, tasks
from .streaming import gate

# ---------------------------------------------------------------- five demands, by names of their own

#: The fifth demand of a task is made of its part number.
FIVE = ("items", "money", "rebate", "levy", "parts")
_M = len(FIVE)
TASKS5 = TASKS.replace("AS duration FROM", "AS duration, CAST(l_partkey % 97 + 1 AS BIGINT) AS r4 FROM")
CAPS5 = TASKS5 + ", caps AS (SELECT " + ", ".join(f"CAST(ceil(sum(r{k}) / {float(WAVES)}) AS BIGINT) AS c{k}" for k in range(_M)) + " FROM tasks)"
_TENTHS5 = (*TENTHS, 7)
SHARED5 = (
    CAPS5 + ", rems AS (SELECT *, " + ", ".join(f"c{k} * {t} // 10 AS m{k}" for k, t in enumerate(_TENTHS5)) + " FROM caps), shared AS (SELECT *, "
    + ", ".join(f"CAST(r{k} AS DOUBLE) / c{k} AS a{k}, CAST(m{k} AS DOUBLE) / c{k} AS b{k}" for k in range(_M)) + " FROM tasks, rems)"
)


def _sum(term: str, m: int = _M) -> str:
    return "(" + " + ".join(term.format(k=k) for k in range(m)) + ")"


_SCORE5 = {
    "mp": _sum("a{k} * b{k}"),
    "irls": f"{_sum('a{k} * b{k}')} / sqrt(sqrt({_sum('a{k} * a{k}')} + 1e-12)) - 0.015::DOUBLE * sqrt(greatest({_sum('a{k} * a{k}')} / 5.0 - ({_sum('a{k}')} / 5.0) * ({_sum('a{k}')} / 5.0), 0.0))",
}


def _five(spark, sf_dir) -> tuple[DataFrame, dict[str, int], dict[str, int]]:
    """Tasks with five named demands, their capacity and what remains of it."""
    own = table(spark, sf_dir, "lineitem")
    numbered = lineitem_tasks(own, parts=(F.col("l_partkey") % 97 + 1).cast("bigint"))
    rows = written(numbered.select("agent_id", *(F.col(f"r{k}").alias(d) for k, d in enumerate(FIVE[:4])), "parts", "duration"), "five")
    capacity = dict(zip(FIVE, capacities(rows, demands=FIVE), strict=True))
    return rows, capacity, {d: c * t // 10 for (d, c), t in zip(capacity.items(), _TENTHS5, strict=True)}


def _register_five(method: str) -> None:
    fits, fit = " AND ".join(f"r{k} <= m{k}" for k in range(_M)), "round((" + " + ".join(f"CAST(r{k} AS DOUBLE) / m{k}" for k in range(_M)) + ") * 1e6, 4)"
    demands = ", ".join(f"r{k}" for k in range(_M))

    @query(
        f"five_demand_dispatch_{method}",
        f"WITH {SHARED5}, pool AS (SELECT agent_id, {demands}, round(({_SCORE5[method]}) * 1e6, 4) AS score FROM shared WHERE {fits} ORDER BY score DESC, agent_id LIMIT {POOL}), "
        f"win AS (SELECT *, {fit} AS fit FROM pool, rems), {_fold('win', 'fit DESC, agent_id', 'm', _M)} SELECT b.agent_id, b.seq, p.score FROM batch b JOIN pool p ON b.agent_id = p.agent_id",
    )
    def dispatched(spark, sf_dir):
        rows, capacity, remaining = _five(spark, sf_dir)
        pool = retrieve.top_k(retrieve.scored(rows, method, remaining, capacity), POOL)
        return pack.best_fit(pool, remaining, POOL).select("agent_id", "seq", "score")


for _name in _SCORE5:
    _register_five(_name)


@query("five_demand_stats", f"WITH {TASKS5} " + " UNION ALL ".join(f"SELECT '{d}' AS resource, min(r{k}) AS least, round(avg(r{k}), 6) AS mean, max(r{k}) AS greatest, CAST(sum(r{k} * duration) AS BIGINT) AS usage FROM tasks" for k, d in enumerate(FIVE)))
def five_demand_stats(spark, sf_dir):
    rows, _, _ = _five(spark, sf_dir)
    return metrics.column_stats(rows, FIVE).join(metrics.usage_integral(rows, FIVE), "resource")


_PREFIX5 = ", ".join(f"sum(r{k}) OVER (ORDER BY agent_id) AS s{k}" for k in range(_M))
_OVER5 = " OR ".join(f"x.s{k} > s.b{k} + c{k}" for k in range(_M))


@query(
    "five_demand_strict_waves",
    f"WITH RECURSIVE {CAPS5}, sums AS MATERIALIZED (SELECT *, {_PREFIX5} FROM tasks), starts AS (SELECT CAST(0 AS BIGINT) AS wave, CAST(0 AS BIGINT) AS first, {', '.join(f'CAST(0 AS HUGEINT) AS b{k}' for k in range(_M))} "
    f"UNION ALL SELECT any_value(s.wave) + 1, min(x.agent_id), {', '.join(f'min(x.s{k} - x.r{k})' for k in range(_M))} FROM starts s, sums x, caps WHERE x.agent_id >= s.first AND ({_OVER5}) HAVING count(*) > 0) "
    f"SELECT s.wave, count(*) AS n_tasks, {', '.join(f'CAST(sum(r{k}) AS BIGINT) AS used_{d}' for k, d in enumerate(FIVE))} FROM tasks t ASOF JOIN starts s ON t.agent_id >= s.first GROUP BY s.wave",
)
def five_demand_strict_waves(spark, sf_dir):
    rows, capacity, _ = _five(spark, sf_dir)
    return plans.wave_summary(plans.strict_waves(rows.drop("duration"), capacity, rows.count()), FIVE)


# ---------------------------------------------------------------- arrival as a permutation of its own

#: An order of arrival that has nothing to do with the ids: a product modulo a prime, which no two ids share.
_PLACE = "(agent_id * 48271 + 11) % 2147483647"
ARRIVED = REMS.replace(TASKS, f"{TASKS},\narrived AS (SELECT *, row_number() OVER (ORDER BY {_PLACE}) - 1 AS arrival FROM tasks)")


def _arrived(spark, sf_dir) -> tuple[DataFrame, list[int], list[int]]:
    rows, capacity, remaining = _context(spark, sf_dir)
    order = rows.select(F.expr(_PLACE).alias("place"), "agent_id")
    return with_arrival(rows, order, "place"), capacity, remaining


@query("arrival_ranks", f"WITH {ARRIVED} SELECT agent_id, arrival FROM arrived")
def arrival_inverse(spark, sf_dir):
    return arrival_ranks(tasks(spark, sf_dir).select(F.expr(_PLACE).alias("place"), "agent_id"), "place", "agent_id")


_BY_ARRIVAL = ", ".join(f"sum(r{k}) OVER (ORDER BY arrival) AS s{k}" for k in range(4))
_IN_SUMS = " AND ".join(f"s{k} <= m{k}" for k in range(4))
_FIRST = f"{ARRIVED}, one AS (SELECT * FROM (SELECT *, {_BY_ARRIVAL} FROM arrived WHERE arrival < {WINDOW}), rems WHERE {_IN_SUMS}), active AS (SELECT * FROM arrived WHERE agent_id NOT IN (SELECT agent_id FROM one))"


#: The whole batch; the queries that keep _FIRST have its window in their SQL.
_ONE = f"{ARRIVED}, one AS (SELECT * FROM (SELECT *, {_BY_ARRIVAL} FROM arrived), rems WHERE {_IN_SUMS})"


@query("strict_fifo_by_arrival", f"WITH {_ONE} SELECT agent_id, arrival FROM one")
def strict_fifo_by_arrival(spark, sf_dir):
    rows, _, remaining = _arrived(spark, sf_dir)
    return pack.strict_prefix(rows, remaining, "arrival").select("agent_id", "arrival")


@query(
    "second_strict_batch",
    f"WITH {_ONE}, active AS (SELECT * FROM arrived WHERE agent_id NOT IN (SELECT agent_id FROM one)) SELECT agent_id, arrival FROM (SELECT *, {_BY_ARRIVAL} FROM active), rems WHERE {_IN_SUMS}",
)
def second_strict_batch(spark, sf_dir):
    """Strict again over what the first batch left, from the first rank that is still there."""
    rows, _, remaining = _arrived(spark, sf_dir)
    return pack.strict_prefix(pack.strict_rest(rows, remaining, "arrival"), remaining, "arrival").select("agent_id", "arrival")


@query(
    "windowed_fifo_by_arrival",
    f"WITH {_FIRST}, win AS (SELECT * FROM (SELECT * FROM active ORDER BY arrival LIMIT {WINDOW}), (SELECT m0, m1, m2, m3 FROM rems)), {_fold('win', 'arrival', 'm')} SELECT * FROM batch",
)
def windowed_fifo_by_arrival(spark, sf_dir):
    """The first active tasks by rank, whatever ranks the first batch took from between them."""
    rows, _, remaining = _arrived(spark, sf_dir)
    left = retrieve.active(rows, pack.strict_prefix(rows, remaining, "arrival", WINDOW), bounded=True)
    return pack.first_fit_window(left, remaining, "arrival", WINDOW).select("agent_id", "seq")


@query("reranked_active", f"WITH {_FIRST} SELECT agent_id, row_number() OVER (ORDER BY arrival) - 1 AS arrival FROM active")
def reranked_active(spark, sf_dir):
    rows, _, remaining = _arrived(spark, sf_dir)
    return reranked(retrieve.active(rows, pack.strict_prefix(rows, remaining, "arrival", WINDOW), bounded=True)).select("agent_id", "arrival")


def _cosine(x: str, y: str) -> str:
    dot = lambda p, q: "(" + " + ".join(f"{p}.a{k} * {q}.a{k}" for k in range(4)) + ")"
    return f"{dot(x, y)} / (sqrt({dot(x, x)}) * sqrt({dot(y, y)}))"


_SHARE = ", ".join(f"CAST(r{k} AS DOUBLE) / c{k} AS a{k}" for k in range(4))
_PICK = lambda salt: f"CAST(floor({uniform_sql(0, 'arrival', str(salt))} * CAST((SELECT count(*) FROM whole) AS DOUBLE)) AS BIGINT)"


@query(
    "gate_by_arrival",
    f"WITH {ARRIVED}, whole AS (SELECT arrival, {_SHARE} FROM arrived, caps), head AS (SELECT * FROM whole WHERE arrival < {GATE}), "
    f"near AS (SELECT round(avg({_cosine('x', 'y')}), 6) AS c FROM head x JOIN head y ON x.arrival = y.arrival + 1), pairs AS (SELECT {_PICK(1)} AS one, {_PICK(2)} AS other FROM head), "
    f"far AS (SELECT round(avg({_cosine('x', 'y')}), 6) AS c FROM pairs JOIN whole x ON x.arrival = one JOIN whole y ON y.arrival = other) "
    "SELECT round(near.c - far.c, 6) AS gate_score, CASE WHEN near.c - far.c > 0.1 THEN 'mp' ELSE 'fifo_windowed' END AS policy FROM near, far",
)
def gate_by_arrival(spark, sf_dir):
    rows, capacity, _ = _arrived(spark, sf_dir)
    return metrics.gate(rows, capacity, rows.count(), GATE, rank="arrival")


_OVER = " OR ".join(f"x.s{k} > s.b{k} + c{k}" for k in range(4))


@query(
    "strict_waves_by_arrival",
    f"WITH RECURSIVE {ARRIVED}, sums AS MATERIALIZED (SELECT *, {_BY_ARRIVAL} FROM arrived), starts AS (SELECT CAST(0 AS BIGINT) AS wave, CAST(0 AS BIGINT) AS first, {', '.join(f'CAST(0 AS HUGEINT) AS b{k}' for k in range(4))} "
    f"UNION ALL SELECT any_value(s.wave) + 1, min(x.arrival), {', '.join(f'min(x.s{k} - x.r{k})' for k in range(4))} FROM starts s, sums x, caps WHERE x.arrival >= s.first AND ({_OVER}) HAVING count(*) > 0) "
    f"SELECT s.wave, count(*) AS n_tasks, {', '.join(f'CAST(sum(r{k}) AS BIGINT) AS used_r{k}' for k in range(4))} FROM arrived t ASOF JOIN starts s ON t.arrival >= s.first GROUP BY s.wave",
)
def strict_waves_by_arrival(spark, sf_dir):
    rows, capacity, _ = _arrived(spark, sf_dir)
    return plans.wave_summary(plans.strict_waves(rows.drop("duration"), capacity, rows.count(), "arrival"), DEMANDS)


# ---------------------------------------------------------------- proximal steps and reports

STEPS = 5


def _fista_sql(steps: int) -> str:
    """Proximal steps as a chain of tables, with the momentum of the unrestarted method; the largest eigenvalue by squaring the matrix."""
    norm = f"sqrt({_sum('a{k} * a{k}', 4)})"
    parts = [f"atoms AS MATERIALIZED (SELECT agent_id, {norm} AS norm, {', '.join(f'a{k} / {norm} AS u{k}, b{k}' for k in range(4))} FROM shared)"]
    parts.append("g0 AS MATERIALIZED (SELECT " + ", ".join(f"sum(u{i} * u{j}) AS g{i}{j}" for i in range(4) for j in range(4)) + " FROM atoms)")
    # the trace of the matrix to the power 2 ** 10, scaled by its trace at each squaring, tends to the largest eigenvalue
    scale = []
    for q in range(10):
        trace = "(" + " + ".join(f"g{i}{i}" for i in range(4)) + ")"
        cells = ", ".join("(" + " + ".join(f"g{i}{k} * g{k}{j}" for k in range(4)) + f") / ({trace} * {trace}) AS g{i}{j}" for i in range(4) for j in range(4))
        parts.append(f"g{q + 1} AS MATERIALIZED (SELECT {cells} FROM g{q})")
        scale.append(f"pow((SELECT {trace} FROM g{q}), {0.5 ** q!r})")
    last = "pow((SELECT " + " + ".join(f"g{i}{i}" for i in range(4)) + f" FROM g10), {0.5 ** 10!r})"
    parts.append(f"l AS MATERIALIZED (SELECT {' * '.join([*scale, last])} AS l)")
    parts.append("x0 AS (SELECT *, CAST(0 AS DOUBLE) AS x, CAST(0 AS DOUBLE) AS y FROM atoms)")
    momentum = 1.0
    for k in range(steps):
        later = 0.5 * (1.0 + (1.0 + 4.0 * momentum * momentum) ** 0.5)
        push = (momentum - 1.0) / later
        momentum = later
        parts.append(f"r{k} AS MATERIALIZED (SELECT {', '.join(f'sum(u{i} * y) - any_value(b{i}) AS r{i}' for i in range(4))} FROM x{k})")
        new = "greatest(y - (" + " + ".join(f"u{i} * r{i}" for i in range(4)) + f") / l - {proximal.PENALTY!r}::DOUBLE / l, 0.0)"
        columns = "agent_id, norm, " + ", ".join(f"u{i}, b{i}" for i in range(4))
        parts.append(f"n{k} AS (SELECT {columns}, x, {new} AS n FROM x{k}, r{k}, l)")
        parts.append(f"x{k + 1} AS MATERIALIZED (SELECT {columns}, n AS x, n + {push!r}::DOUBLE * (n - x) AS y FROM n{k})")
    return f"WITH {SHARED}, {', '.join(parts)} SELECT agent_id, round(x / norm, 6) AS coefficient FROM x{steps}"


@query("fista_steps", _fista_sql(STEPS))
def fista_steps(spark, sf_dir):
    """The coefficients of all tasks after a few accelerated steps without restarts."""
    rows, capacity, remaining = _context(spark, sf_dir)
    found, _ = proximal.fista(rows, _target(capacity, remaining), capacity, steps=STEPS, restart=False)
    return found.select("agent_id", F.round("coefficient", 6).alias("coefficient"))


@query("solver_reports")
def solver_reports(spark, sf_dir):
    """How each solver ends on the pool of its method, one row each; the solvers' jobs on these small tables run beside each other."""
    rows, capacity, remaining = _context(spark, sf_dir)
    target = _target(capacity, remaining)
    pools = {m: written(pool, "pool") for m, pool in retrieve.pools(rows, METHODS, remaining, capacity, POOL).items()}

    def ended(method: str) -> tuple:
        if method in ("fista", "irls"):
            return {"fista": proximal.fista, "irls": proximal.irls}[method](pools[method], target, capacity)[1].row()
        return solve.pursued(pools[method], target, capacity, method)[1].row()

    with ThreadPoolExecutor(len(pools)) as threads:
        # each thread has a copy of the local properties of its own
        found = [x.result() for x in [threads.submit(inheritable_thread_target(spark)(ended), m) for m in pools]]
    return spark.createDataFrame(found, proximal.REPORT).select("method", F.round("residual_norm", 6).alias("residual_norm"), F.round("objective", 6).alias("objective"), "iterations", "converged")


# ---------------------------------------------------------------- counters, paired tests, usage over time

_COUNTED = ("mp", "ols")


def _counted_sql(method: str) -> str:
    fits, residual = " AND ".join(f"r{k} <= m{k}" for k in range(4)), "round((" + " + ".join(f"CAST(r{k} AS DOUBLE) / m{k}" for k in range(4)) + ") * 1e6, 4)"
    fold = _fold(f"win_{method}", "fit DESC, agent_id", "m").replace("packed AS", f"packed_{method} AS").replace("batch AS", f"batch_{method} AS").replace("FROM packed)", f"FROM packed_{method})")
    return (
        f"pool_{method} AS (SELECT agent_id, r0, r1, r2, r3 FROM (SELECT *, round(({SCORE[method]}) * 1e6, 4) AS score FROM shared WHERE {fits}) ORDER BY score DESC, agent_id LIMIT {POOL}), "
        f"win_{method} AS (SELECT *, {residual} AS fit FROM pool_{method}, rems), {fold}"
    )


def _counters_row(method: str, considered: str, selected: str) -> str:
    fits = " AND ".join(f"r{k} <= m{k}" for k in range(4))
    return f"SELECT '{method}' AS method, (SELECT count(*) FROM tasks) AS scanned, (SELECT count(*) FROM tasks, rems WHERE {fits}) AS feasible, {considered} AS considered, {selected} AS selected, {considered} - {selected} AS rejected"


_STRICT = f"(SELECT count(*) FROM (SELECT *, {', '.join(f'sum(r{k}) OVER (ORDER BY agent_id) AS s{k}' for k in range(4))} FROM tasks WHERE agent_id < {WINDOW}), rems WHERE {_IN_SUMS})"
_LOOKED = f"least((SELECT count(*) FROM tasks), {WINDOW})"


@query(
    "dispatch_counters",
    f"WITH {SHARED}, {', '.join(map(_counted_sql, _COUNTED))}, win AS (SELECT * FROM tasks, rems WHERE agent_id < {WINDOW}), {_fold('win', 'agent_id', 'm')} "
    + " UNION ALL ".join(_counters_row(m, f"(SELECT count(*) FROM pool_{m})", f"(SELECT count(*) FROM batch_{m})") for m in _COUNTED)
    + f" UNION ALL {_counters_row('fifo_windowed', _LOOKED, '(SELECT count(*) FROM batch)')} UNION ALL {_counters_row('fifo_strict', f'least({_LOOKED}, {_STRICT} + 1)', _STRICT)}",
)
def dispatch_counters(spark, sf_dir):
    rows, capacity, remaining = _context(spark, sf_dir)
    found = [counted.counted_dispatch(rows, remaining, capacity, m)[1] for m in (*_COUNTED, "fifo_windowed", "fifo_strict")]
    return spark.createDataFrame(found, counted.COUNTERS)


_ENUMERATED = f"""WITH {_RESULTS},
cuts AS (SELECT o.pattern, o.seed, o.makespan - b.makespan AS d FROM results o JOIN results b ON o.pattern = b.pattern AND o.seed = b.seed WHERE o.method = 'R' AND b.method = 'A'),
moved AS (SELECT pattern, d, row_number() OVER (PARTITION BY pattern ORDER BY seed) - 1 AS bit, 2 * count(*) OVER (PARTITION BY pattern ORDER BY abs(d)) - count(*) OVER (PARTITION BY pattern, abs(d)) + 1 AS twice FROM cuts WHERE d <> 0),
told AS (SELECT pattern, count(*) AS pairs, coalesce(sum(twice) FILTER (WHERE d > 0), 0) AS w FROM moved GROUP BY pattern),
signs AS (SELECT t.pattern, s.x, sum(CASE WHEN (s.x >> m.bit) & 1 = 1 THEN m.twice ELSE 0 END) AS w FROM told t, range(4096) s(x), moved m WHERE m.pattern = t.pattern AND s.x < (1 << t.pairs) GROUP BY ALL),
chances AS (SELECT t.pattern, avg(CAST(s.w <= t.w AS INT)) AS less, avg(CAST(s.w >= t.w AS INT)) AS more FROM told t JOIN signs s ON s.pattern = t.pattern GROUP BY t.pattern)
SELECT pattern, pairs, w / 2.0 AS rank_sum, round(less, 9) AS p_less, round(least(2 * least(less, more), 1.0), 9) AS p_two_sided FROM told JOIN chances USING (pattern)"""


@query("paired_signed_rank", _ENUMERATED)
def paired_signed_rank(spark, sf_dir):
    """The oracle tries all signs of at most twelve pairs."""
    found = signed_rank(_results(spark, sf_dir), "R", "A", ["seed"], "makespan", ["pattern"])
    return found.select("pattern", "pairs", "rank_sum", F.round("p_less", 9).alias("p_less"), F.round("p_two_sided", 9).alias("p_two_sided"))


#: A trace of all tasks whose finishes meet but for rounding: starts at halves, thirds of a unit long.
_START, _FINISH = "CAST(agent_id * 7919 % 2003 AS DOUBLE) / 2.0::DOUBLE", "CAST(agent_id * 7919 % 2003 AS DOUBLE) / 2.0::DOUBLE + CAST(duration AS DOUBLE) / 3.0::DOUBLE"
_LEVELS = ", ".join(f"CAST(sum(r{k}) OVER (ORDER BY instant) AS BIGINT) AS r{k}" for k in range(4))
_USAGE = f"""WITH {TASKS},
moves AS (SELECT {_START} AS moment, 1 AS sign, r0, r1, r2, r3 FROM tasks UNION ALL SELECT {_FINISH}, -1, r0, r1, r2, r3 FROM tasks),
change AS (SELECT moment, sum(sign) AS n, {", ".join(f"sum(sign * r{k}) AS r{k}" for k in range(4))} FROM moves GROUP BY moment),
marked AS (SELECT *, CASE WHEN moment - lag(moment) OVER (ORDER BY moment) <= 1e-10 THEN 0 ELSE 1 END AS fresh FROM change),
numbered AS (SELECT *, sum(fresh) OVER (ORDER BY moment) AS instant FROM marked),
islands AS (SELECT instant, min(moment) AS moment, sum(n) AS n, {", ".join(f"sum(r{k}) AS r{k}" for k in range(4))} FROM numbered GROUP BY instant),
levels AS (SELECT moment, coalesce(lead(moment) OVER (ORDER BY instant) - moment, 0) AS elapsed, CAST(sum(n) OVER (ORDER BY instant) AS BIGINT) AS n_running, {_LEVELS} FROM islands)"""


def _trace(spark, sf_dir) -> DataFrame:
    own = tasks(spark, sf_dir)
    start, finish = (F.expr(e.replace("::DOUBLE", "D")) for e in (_START, _FINISH))
    return own.select("agent_id", start.alias("start"), finish.alias("finish"), *DEMANDS)


@query("usage_over_time", f"{_USAGE} SELECT round(moment, 6) AS \"at\", round(elapsed, 6) AS elapsed, n_running, r0, r1, r2, r3 FROM levels")
def levels_over_time(spark, sf_dir):
    return usage_over_time(_trace(spark, sf_dir)).select(F.round("at", 6).alias("at"), F.round("elapsed", 6).alias("elapsed"), "n_running", *DEMANDS)


@query("usage_of_trace", f"{_USAGE} " + " UNION ALL ".join(f"SELECT 'r{k}' AS resource, round(sum(r{k} * elapsed), 3) AS usage FROM levels" for k in range(4)))
def usage_of_trace(spark, sf_dir):
    return usage_totals(_trace(spark, sf_dir)).select("resource", F.round("usage", 3).alias("usage"))


# ---------------------------------------------------------------- policies of one's own as table functions

SHARDS = 40


def thrifty(demand, left) -> bool:
    """A policy that takes a task only where it needs a fifth at most of what is left of each resource."""
    return all(5 * x <= c for x, c in zip(demand, left, strict=True))


def closest(demand, limit) -> float:
    """A score that is highest where the shares of the capacity are most alike."""
    shares = [x / c for x, c in zip(demand, limit, strict=True)]
    return min(shares) / max(shares)


def _sharded(spark, sf_dir) -> tuple[DataFrame, str]:
    """A view of the tasks dealt to shards, and the capacity of a shard as a map in SQL."""
    rows, capacity, _ = _context(spark, sf_dir)
    rows.withColumn("shard", F.pmod(F.col("agent_id"), F.lit(SHARDS))).createOrReplaceTempView("quayside_sharded")
    return rows, "map(" + ", ".join(f"'{d}', {c // SHARDS}D" for d, c in zip(DEMANDS, capacity, strict=True)) + ")"


_SHARDED = CAPS + ", dealt AS (SELECT *, agent_id % " + str(SHARDS) + " AS shard FROM tasks), lims AS (SELECT " + ", ".join(f"c{k} // {SHARDS} AS m{k}" for k in range(4)) + " FROM caps)"
_FOLD_STATE = "{'id': CAST(-1 AS BIGINT), " + ", ".join(f"'r{k}': any_value(m{k})" for k in range(4)) + ", 'took': CAST([] AS BIGINT[])}"
_FOLD_STEP = "{'id': s.id, " + ", ".join(f"'r{k}': s.r{k} - x.r{k}" for k in range(4)) + ", 'took': list_append(s.took, x.id)}"
_FOLD_ROW = "{'id': agent_id, " + ", ".join(f"'r{k}': r{k}" for k in range(4)) + ", 'took': CAST([] AS BIGINT[])}"


@query(
    "packed_by_own_policy",
    f"WITH {_SHARDED}, packed AS (SELECT shard, list_reduce(list({_FOLD_ROW} ORDER BY agent_id), lambda s, x: CASE WHEN {' AND '.join(f'5 * x.r{k} <= s.r{k}' for k in range(4))} THEN {_FOLD_STEP} ELSE s END, {_FOLD_STATE}) AS p FROM dealt, lims GROUP BY shard) "
    "SELECT shard, unnest(p.took) AS agent_id, CAST(unnest(range(len(p.took))) AS BIGINT) AS seq FROM packed",
)
def packed_by_own_policy(spark, sf_dir):
    _, capacity = _sharded(spark, sf_dir)
    spark.udtf.register("thrifty_packing", packing(thrifty))
    return spark.sql(f"SELECT * FROM thrifty_packing({capacity}, TABLE(quayside_sharded) PARTITION BY shard ORDER BY agent_id)")


_PARTS = ", ".join(f"CAST(r{k} AS DOUBLE) / m{k}" for k in range(4))


@query(
    "retrieved_by_own_score",
    f"WITH {_SHARDED}, scored AS (SELECT shard, agent_id, least({_PARTS}) / greatest({_PARTS}) AS score FROM dealt, lims WHERE {' AND '.join(f'r{k} <= m{k}' for k in range(4))}) "
    "SELECT shard, agent_id, round(score, 9) AS score, place - 1 AS place FROM (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY score DESC, agent_id) AS place FROM scored) WHERE place <= 20",
)
def retrieved_by_own_score(spark, sf_dir):
    _, capacity = _sharded(spark, sf_dir)
    spark.udtf.register("closest_retrieval", retrieval(closest))
    found = spark.sql(f"SELECT * FROM closest_retrieval({capacity}, 20, TABLE(quayside_sharded) PARTITION BY shard)")
    return found.withColumn("score", F.round("score", 9))


# ---------------------------------------------------------------- the gate by window, over a table and over a stream

_DOT = lambda x, y: "(" + " + ".join(f"{x}.p{k} * {y}.p{k}" for k in range(3)) + ")"
_COS3 = lambda x, y: f"{_DOT(x, y)} / (sqrt({_DOT(x, x)}) * sqrt({_DOT(y, y)}))"
_WINDOWED = f"""WITH v AS (
  SELECT event_type AS key, ts, event_id AS id, coalesce(value / 50.0::DOUBLE, 0) AS p0, coalesce(user_id / 150.0::DOUBLE, 0) AS p1, coalesce(TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) / 100.0::DOUBLE, 0) AS p2,
         CAST(floor(epoch(ts) / {gate.WINDOW_SECONDS}) AS BIGINT) * {gate.WINDOW_SECONDS} AS w FROM events WHERE ts IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY key, w ORDER BY ts, id) - 1 AS i, count(*) OVER (PARTITION BY key, w) AS n FROM v WHERE p0 * p0 + p1 * p1 + p2 * p2 > 0),
near AS (SELECT x.key, x.w, any_value(x.n) AS n, avg({_COS3('x', 'y')}) AS c FROM o x JOIN o y ON x.key = y.key AND x.w = y.w AND x.i = y.i + 1 GROUP BY x.key, x.w),
pairs AS (SELECT key, w, CAST(floor({uniform_sql(0, 'i', '1')} * n) AS BIGINT) AS one, CAST(floor({uniform_sql(0, 'i', '2')} * n) AS BIGINT) AS other FROM o),
far AS (SELECT p.key, p.w, avg({_COS3('x', 'y')}) AS c FROM pairs p JOIN o x ON x.key = p.key AND x.w = p.w AND x.i = one JOIN o y ON y.key = p.key AND y.w = p.w AND y.i = other GROUP BY p.key, p.w),
decided AS (SELECT key, w AS window_start, near.n AS n_rows, round(near.c - far.c, 6) AS gate_score, CASE WHEN near.c - far.c > 0.1 THEN 'mp' ELSE 'fifo_windowed' END AS policy FROM near JOIN far USING (key, w))"""


@query("gate_by_window", f"{_WINDOWED} SELECT * FROM decided")
def gate_of_windows(spark, sf_dir):
    return gate.gate_by_window(gate.event_vectors(table(spark, sf_dir, "events")), ["p0", "p1", "p2"])


@query("stream_gate", f"{_WINDOWED} SELECT * FROM decided WHERE window_start + {gate.WINDOW_SECONDS} < (SELECT max(epoch(ts)) FROM events) - 7200")
def stream_gate(spark, sf_dir):
    return gate.drain_gate(spark, sf_dir)


# ---------------------------------------------------------------- places in shards, ordered reports


@query("score_place_in_shard", f"WITH {SHARED} SELECT agent_id, CAST(-(agent_id % {retrieve.SHARD_ROWS}) AS DOUBLE) AS score FROM shared WHERE {' AND '.join(f'r{k} <= m{k}' for k in range(4))}")
def score_place_in_shard(spark, sf_dir):
    rows, _, remaining = _context(spark, sf_dir)
    return retrieve.scored_by_place(rows, remaining).select("agent_id", "score")


@query("ordered_report", f"WITH {_RESULTS}, told AS (SELECT method, pattern, round(avg(makespan), 6) AS mean_makespan, round(avg(dispatches), 6) AS mean_dispatches FROM results GROUP BY ALL) SELECT *, row_number() OVER (ORDER BY mean_makespan, mean_dispatches, method, pattern) AS place FROM told")
def ordered_report(spark, sf_dir):
    told = metrics.method_summary(_results(spark, sf_dir), ["method", "pattern"], ["makespan", "dispatches"]).select("method", "pattern", "mean_makespan", "mean_dispatches")
    return metrics.ordered_report(told, ["mean_makespan", "mean_dispatches"])
