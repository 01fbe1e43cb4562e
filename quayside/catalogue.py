"""Every registered query with its oracle in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.demand import DEMANDS, METHODS, affinity, rank_key, shares, uniform_sql
from .operators import metrics, pack, proximal, retrieve, solve, validate
from .operators.order import ranked
from .plans import dispatch
from .plans import waves as plans
from .sources import generate as gen
from .sources.tables import ARRIVAL, WAVES, capacities, table, tasks
from .streaming import windows

#: Rows of the top-k reports.
K = retrieve.POOL
LOCAL, SHARD = retrieve.LOCAL, retrieve.SHARD_ROWS
WINDOW, POOL = pack.WINDOW, retrieve.POOL
#: What remains of each resource in a dispatch, in tenths of the capacity.
TENTHS = (10, 8, 6, 9)
GATE = metrics.GATE_SAMPLE

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

# ---------------------------------------------------------------- SQL that the oracles share

TASKS = f"""tasks AS (
  SELECT row_number() OVER (ORDER BY {", ".join(ARRIVAL)}) - 1 AS agent_id,
         CAST(round(l_quantity * 100) AS BIGINT) AS r0, CAST(round(l_extendedprice) AS BIGINT) AS r1,
         CAST(round(l_discount * 1000) AS BIGINT) + 1 AS r2, CAST(round(l_tax * 1000) AS BIGINT) + 1 AS r3,
         CAST(l_linenumber AS BIGINT) AS duration FROM lineitem)"""
CAPS = TASKS + ",\ncaps AS (SELECT " + ", ".join(f"CAST(ceil(sum(r{k}) / {float(WAVES)}) AS BIGINT) AS c{k}" for k in range(4)) + " FROM tasks)"
REMS = CAPS + ",\nrems AS (SELECT *, " + ", ".join(f"c{k} * {t} // 10 AS m{k}" for k, t in enumerate(TENTHS)) + " FROM caps)"
#: a task's shares a0..a3, and sums of them
SHARED = REMS + ",\nshared AS (SELECT *, " + ", ".join(f"CAST(r{k} AS DOUBLE) / c{k} AS a{k}, CAST(m{k} AS DOUBLE) / c{k} AS b{k}" for k in range(4)) + " FROM tasks, rems)"
MATCH, SQUARE, TOTAL = "(a0 * b0 + a1 * b1 + a2 * b2 + a3 * b3)", "(a0 * a0 + a1 * a1 + a2 * a2 + a3 * a3)", "(a0 + a1 + a2 + a3)"
SPREAD = f"sqrt(greatest({SQUARE} / 4.0 - ({TOTAL} / 4.0) * ({TOTAL} / 4.0), 0.0))"
SCORE = {
    "mp": MATCH,
    "omp": f"{MATCH} / sqrt({SQUARE} + 1e-12)",
    "ols": f"greatest({MATCH}, 0.0) * greatest({MATCH}, 0.0) / ({SQUARE} + 1e-12)",
    "fista": f"{MATCH} - 0.02::DOUBLE * {TOTAL} - 0.02::DOUBLE * {SPREAD}",
    "irls": f"{MATCH} / sqrt(sqrt({SQUARE} + 1e-12)) - 0.015::DOUBLE * {SPREAD}",
}
FITS = " AND ".join(f"r{k} <= m{k}" for k in range(4))


def _scored(method: str) -> str:
    return f"{SHARED},\nscored AS (SELECT *, round(({SCORE[method]}) * 1e6, 4) AS score FROM shared WHERE {FITS})"


def _fold(source: str, order: str, caps: str, m: int = 4) -> str:
    """First fit over the rows of source in an order, as a fold; caps begins the names of m columns of a one-row table rems or caps."""
    row = "{'id': agent_id, " + ", ".join(f"'r{k}': r{k}" for k in range(m)) + ", 'took': CAST([] AS BIGINT[])}"
    first = "{'id': CAST(-1 AS BIGINT), " + ", ".join(f"'r{k}': any_value({caps}{k})" for k in range(m)) + ", 'took': CAST([] AS BIGINT[])}"
    fits = " AND ".join(f"x.r{k} <= s.r{k}" for k in range(m))
    step = "{'id': s.id, " + ", ".join(f"'r{k}': s.r{k} - x.r{k}" for k in range(m)) + ", 'took': list_append(s.took, x.id)}"
    return f"""packed AS (
  SELECT list_reduce(list({row} ORDER BY {order}), lambda s, x: CASE WHEN {fits} THEN {step} ELSE s END, {first}) AS p FROM {source}),
batch AS (SELECT unnest(p.took) AS agent_id, CAST(unnest(range(len(p.took))) AS BIGINT) AS seq FROM packed)"""


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return keep


def _remaining(capacity: list[int]) -> list[int]:
    return [c * t // 10 for c, t in zip(capacity, TENTHS, strict=True)]


def _context(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[int], list[int]]:
    rows = tasks(spark, sf_dir)
    capacity = capacities(rows)
    return rows, capacity, _remaining(capacity)


# ---------------------------------------------------------------- sources, filters, validation


@query("tasks_fixture", f"WITH {TASKS} SELECT * FROM tasks")
def tasks_fixture(spark, sf_dir):
    return tasks(spark, sf_dir)


@query("inspect_stats", f"WITH {TASKS} " + " UNION ALL ".join(f"SELECT 'r{k}' AS resource, min(r{k}) AS least, round(avg(r{k}), 6) AS mean, max(r{k}) AS greatest FROM tasks" for k in range(4)))
def inspect_stats(spark, sf_dir):
    return metrics.column_stats(tasks(spark, sf_dir))


@query("normalize_demand", f"WITH {CAPS} SELECT agent_id, " + ", ".join(f"round(CAST(r{k} AS DOUBLE) / c{k} * 1e6, 4) AS a{k}" for k in range(4)) + " FROM tasks, caps")
def normalize_demand(spark, sf_dir):
    rows, capacity, _ = _context(spark, sf_dir)
    return rows.select("agent_id", *(rank_key(s).alias(f"a{k}") for k, s in enumerate(shares(capacity))))


_SEVENTY = ", ".join(f"CAST(max(r{k}) * 7 // 10 AS BIGINT) AS m{k}" for k in range(4))


@query("feasible_filter", f"WITH {TASKS}, lims AS (SELECT {_SEVENTY} FROM tasks) SELECT agent_id, r0, r1, r2, r3 FROM tasks, lims WHERE {FITS}")
def feasible_filter(spark, sf_dir):
    rows = tasks(spark, sf_dir)
    return rows.where(retrieve.feasible(_seventy(rows))).select("agent_id", *DEMANDS)


def _seventy(rows: DataFrame) -> list[int]:
    top = rows.agg(*(F.max(d).alias(d) for d in DEMANDS)).first()
    return [(top[d] or 0) * 7 // 10 for d in DEMANDS]


@query("oversize_rows", f"WITH {TASKS}, lims AS (SELECT {_SEVENTY} FROM tasks) SELECT agent_id, r0, r1, r2, r3 FROM tasks, lims WHERE NOT ({FITS}) ORDER BY agent_id LIMIT 10")
def oversize_rows(spark, sf_dir):
    rows = tasks(spark, sf_dir)
    return validate.oversize_rows(rows, _seventy(rows)).select("agent_id", *DEMANDS)


@query("validate_rows", f"WITH {TASKS} SELECT count(*) AS n_rows, count(*) FILTER (WHERE r0 IS NULL OR r1 IS NULL OR r2 IS NULL OR r3 IS NULL OR duration IS NULL) AS n_null, count(*) FILTER (WHERE isnan(r0::DOUBLE) OR isinf(r0::DOUBLE) OR isnan(r1::DOUBLE) OR isinf(r1::DOUBLE) OR isnan(r2::DOUBLE) OR isinf(r2::DOUBLE) OR isnan(r3::DOUBLE) OR isinf(r3::DOUBLE) OR isnan(duration::DOUBLE) OR isinf(duration::DOUBLE)) AS n_not_finite, count(*) FILTER (WHERE r0 <= 0 OR r1 <= 0 OR r2 <= 0 OR r3 <= 0 OR duration <= 0) AS n_not_positive FROM tasks")
def validate_rows(spark, sf_dir):
    return validate.violations(tasks(spark, sf_dir))


@query("unique_ids", f"WITH {TASKS} SELECT count(*) AS n_rows, count(DISTINCT agent_id) AS n_ids, count(*) = count(DISTINCT agent_id) AS is_unique, count(*) = count(DISTINCT agent_id) AND min(agent_id) = 0 AND max(agent_id) = count(*) - 1 AS is_permutation FROM tasks")
def unique_ids(spark, sf_dir):
    return validate.id_check(tasks(spark, sf_dir))


_SAMPLED = f"SELECT DISTINCT CAST(k * (n - 1) // greatest(least(n, {validate.SAMPLE}) - 1, 1) AS BIGINT) AS agent_id FROM (SELECT count(*) AS n FROM tasks), range({validate.SAMPLE}) s(k) WHERE k < n"


@query("distinctness_sample", f"WITH {TASKS}, picked AS ({_SAMPLED}), taken AS (SELECT r0, r1, r2, r3 FROM tasks JOIN picked USING (agent_id)) SELECT count(*) AS n_sampled, (SELECT count(*) FROM (SELECT DISTINCT * FROM taken)) AS n_distinct, round((SELECT count(*) FROM (SELECT DISTINCT * FROM taken)) / count(*), 6) AS unique_fraction FROM taken")
def distinctness_sample(spark, sf_dir):
    rows = tasks(spark, sf_dir)
    return validate.distinctness(rows, rows.count())


# ---------------------------------------------------------------- scores and top-k


def _register_method(method: str) -> None:
    @query(f"score_{method}", f"WITH {_scored(method)} SELECT agent_id, score FROM scored")
    def score_all(spark, sf_dir):
        rows, capacity, remaining = _context(spark, sf_dir)
        return retrieve.scored(rows, method, remaining, capacity).select("agent_id", "score")

    @query(f"topk_{method}", f"WITH {_scored(method)} SELECT agent_id, score FROM scored ORDER BY score DESC, agent_id LIMIT {K}")
    def top(spark, sf_dir):
        rows, capacity, remaining = _context(spark, sf_dir)
        return retrieve.top_k(retrieve.scored(rows, method, remaining, capacity), K).select("agent_id", "score")


for _m in METHODS:
    _register_method(_m)


@query("topk_sharded", f"WITH {_scored('mp')}, kept AS (SELECT agent_id, score FROM (SELECT *, row_number() OVER (PARTITION BY agent_id // {SHARD} ORDER BY score DESC, agent_id) AS place FROM scored) WHERE place <= {LOCAL}) SELECT * FROM kept ORDER BY score DESC, agent_id LIMIT {K}")
def topk_sharded(spark, sf_dir):
    rows, capacity, remaining = _context(spark, sf_dir)
    return retrieve.sharded_top_k(retrieve.scored(rows, "mp", remaining, capacity), K, LOCAL, SHARD).select("agent_id", "score")


_DIRS = "dirs AS (SELECT a0 AS d0, a1 AS d1, a2 AS d2, a3 AS d3, place FROM (SELECT *, row_number() OVER (ORDER BY score DESC, agent_id) AS place FROM scored) WHERE place <= 12)"


@query("direction_affinity", f"WITH {_scored('mp')}, {_DIRS} SELECT agent_id, round(sum((s.a0 * d0 + s.a1 * d1 + s.a2 * d2 + s.a3 * d3) / (sqrt({SQUARE.replace('a', 's.a')}) * sqrt(d0 * d0 + d1 * d1 + d2 * d2 + d3 * d3)) * (13 - place) / 78.0), 6) AS affinity FROM shared s, dirs GROUP BY agent_id")
def direction_affinity(spark, sf_dir):
    rows, capacity, remaining = _context(spark, sf_dir)
    best = retrieve.top_k(retrieve.scored(rows, "mp", remaining, capacity), 12).select("score", "agent_id", *(s.alias(d) for d, s in zip(DEMANDS, shares(capacity), strict=True)))
    found = sorted(best.collect(), key=lambda r: (-r["score"], r["agent_id"]))
    directions = [(float(12 - k), [r[d] for d in DEMANDS]) for k, r in enumerate(found)]
    return rows.select("agent_id", F.round(affinity(directions, capacity), 6).alias("affinity"))


# ---------------------------------------------------------------- batches

_PREFIX = ", ".join(f"sum(r{k}) OVER (ORDER BY agent_id) AS s{k}" for k in range(4))
STRICT = f"WITH {REMS}, sums AS (SELECT *, {_PREFIX} FROM tasks WHERE agent_id < {pack.WINDOW}), batch AS (SELECT agent_id, r0, r1, r2, r3 FROM sums, rems WHERE s0 <= m0 AND s1 <= m1 AND s2 <= m2 AND s3 <= m3)"


def _strict(spark, sf_dir) -> tuple[DataFrame, DataFrame, list[int]]:
    rows, _, remaining = _context(spark, sf_dir)
    return rows, pack.strict_prefix(rows, remaining, "agent_id", WINDOW).select("agent_id", *DEMANDS), remaining


@query("strict_fifo_batch", f"{STRICT} SELECT * FROM batch")
def strict_fifo_batch(spark, sf_dir):
    return _strict(spark, sf_dir)[1]


@query("dispatch_check", f"{STRICT} " + " UNION ALL ".join(f"SELECT 'r{k}' AS resource, CAST(coalesce(sum(r{k}), 0) AS BIGINT) AS used, any_value(m{k}) AS available, coalesce(sum(r{k}), 0) <= any_value(m{k}) AS holds FROM rems LEFT JOIN batch ON true" for k in range(4)))
def dispatch_check(spark, sf_dir):
    _, batch, remaining = _strict(spark, sf_dir)
    return validate.dispatch_check(batch, remaining)


@query("duplicate_check", f"WITH {TASKS} SELECT r0 AS agent_id, count(*) AS n FROM tasks GROUP BY r0 HAVING count(*) > 1")
def duplicate_check(spark, sf_dir):
    return validate.duplicate_check(tasks(spark, sf_dir).select(F.col("r0").alias("agent_id")))


@query("active_after_batch", f"{STRICT} SELECT agent_id, r0, r1, r2, r3 FROM tasks WHERE agent_id NOT IN (SELECT agent_id FROM batch)")
def active_after_batch(spark, sf_dir):
    rows, batch, _ = _strict(spark, sf_dir)
    return retrieve.active(rows, batch, bounded=True).select("agent_id", *DEMANDS)


@query("pool_gather", f"WITH {_scored('omp')}, pool AS (SELECT agent_id FROM scored ORDER BY score DESC, agent_id LIMIT {K}) SELECT * FROM tasks WHERE agent_id IN (SELECT agent_id FROM pool)")
def pool_gather(spark, sf_dir):
    rows, capacity, remaining = _context(spark, sf_dir)
    return retrieve.gather(rows, retrieve.top_k(retrieve.scored(rows, "omp", remaining, capacity), K))


_WHOLE = ", ".join(f"c{k} AS m{k}" for k in range(4))


def _whole(capacity: list[int]) -> list[int]:
    return list(capacity)


@query("windowed_fifo_batch", f"WITH {CAPS}, rems AS (SELECT {_WHOLE} FROM caps), win AS (SELECT * FROM tasks, rems WHERE agent_id < {WINDOW}), {_fold('win', 'agent_id', 'm')} SELECT * FROM batch")
def windowed_fifo_batch(spark, sf_dir):
    rows, capacity, _ = _context(spark, sf_dir)
    return pack.first_fit_window(rows, _whole(capacity), window=WINDOW).select("agent_id", "seq")


@query("first_fit_batch", f"WITH {CAPS}, rems AS (SELECT {_WHOLE} FROM caps), win AS (SELECT * FROM tasks, rems), {_fold('win', 'agent_id', 'm')} SELECT agent_id FROM batch")
def first_fit_batch(spark, sf_dir):
    rows, capacity, _ = _context(spark, sf_dir)
    return pack.distributed_first_fit(rows, _whole(capacity), ["agent_id"]).select("agent_id")


_RESIDUAL = "round((" + " + ".join(f"CAST(r{k} AS DOUBLE) / m{k}" for k in range(4)) + ") * 1e6, 4)"


@query("best_fit_batch", f"WITH {_scored('mp')}, pool AS (SELECT agent_id, r0, r1, r2, r3 FROM scored ORDER BY score DESC, agent_id LIMIT {POOL}), small AS (SELECT {_WHOLE} FROM caps), win AS (SELECT *, {_RESIDUAL} AS fit FROM pool, small), {_fold('win', 'fit DESC, agent_id', 'm')} SELECT * FROM batch")
def best_fit_batch(spark, sf_dir):
    rows, capacity, remaining = _context(spark, sf_dir)
    pool = retrieve.top_k(retrieve.scored(rows, "mp", remaining, capacity), POOL)
    return pack.best_fit(pool, _whole(capacity), POOL).select("agent_id", "seq")


@query("mp_dispatch", f"WITH {_scored('mp')}, pool AS (SELECT agent_id, r0, r1, r2, r3, score FROM scored ORDER BY score DESC, agent_id LIMIT {POOL}), win AS (SELECT *, {_RESIDUAL} AS fit FROM pool, rems), {_fold('win', 'fit DESC, agent_id', 'm')} SELECT b.agent_id, b.seq, p.score FROM batch b JOIN pool p ON b.agent_id = p.agent_id")
def mp_dispatch(spark, sf_dir):
    """The flagship: filter, score, top-k, pack, with the pool's score of each task."""
    rows, capacity, remaining = _context(spark, sf_dir)
    pool = retrieve.top_k(retrieve.scored(rows, "mp", remaining, capacity), POOL)
    return pack.best_fit(pool, remaining, POOL).select("agent_id", "seq", "score")


# ---------------------------------------------------------------- bounds, gate, reports

_SHARES = ", ".join(f"sum(r{k}) / CAST(any_value(c{k}) AS DOUBLE)" for k in range(4))
_WORK = ", ".join(f"sum(r{k} * duration) / CAST(any_value(c{k}) AS DOUBLE)" for k in range(4))


@query("wave_lower_bound", f"WITH {CAPS} SELECT CAST(greatest(1, ceil(greatest({_SHARES}) - 1e-12)) AS BIGINT) AS waves FROM tasks, caps")
def wave_lower_bound(spark, sf_dir):
    rows, capacity, _ = _context(spark, sf_dir)
    return metrics.wave_bound(rows, capacity)


@query("event_lower_bound", f"WITH {CAPS} SELECT round(greatest({_WORK}, CAST(max(duration) AS DOUBLE)), 6) AS time FROM tasks, caps")
def event_lower_bound(spark, sf_dir):
    rows, capacity, _ = _context(spark, sf_dir)
    return metrics.event_bound(rows, capacity)


@query("usage_integral", f"WITH {TASKS} " + " UNION ALL ".join(f"SELECT 'r{k}' AS resource, CAST(sum(r{k} * duration) AS BIGINT) AS usage FROM tasks" for k in range(4)))
def usage_integral(spark, sf_dir):
    return metrics.usage_integral(tasks(spark, sf_dir))


@query("utilization_summary", f"WITH {CAPS}, used AS (" + " UNION ALL ".join(f"SELECT least(greatest(sum(r{k} * duration) / (CAST(any_value(c{k}) AS DOUBLE) * 80.0), 0.0), 1.0 + 1e-8) AS share FROM tasks, caps" for k in range(4)) + ") SELECT round(avg(share), 6) AS mean_utilization, round(min(share), 6) AS min_utilization, round(quantile_cont(share, 0.95), 6) AS p95_utilization FROM used")
def utilization_summary(spark, sf_dir):
    rows, capacity, _ = _context(spark, sf_dir)
    return metrics.utilization(rows, capacity, 80.0)


_UNIT = f"{CAPS}, whole AS (SELECT agent_id, " + ", ".join(f"CAST(r{k} AS DOUBLE) / c{k} AS a{k}" for k in range(4)) + f" FROM tasks, caps), unit AS (SELECT * FROM whole WHERE agent_id < {GATE})"


def _cos(x: str, y: str) -> str:
    dot = lambda p, q: "(" + " + ".join(f"{p}.a{k} * {q}.a{k}" for k in range(4)) + ")"
    return f"{dot(x, y)} / (sqrt({dot(x, x)}) * sqrt({dot(y, y)}))"


_NEAR = f"near AS (SELECT count(*) AS n_pairs, round(avg({_cos('x', 'y')}), 6) AS mean_cosine FROM unit x JOIN unit y ON x.agent_id = y.agent_id + 1)"
_PICK = lambda salt: f"CAST(floor({uniform_sql(0, 'agent_id', str(salt))} * CAST((SELECT count(*) FROM whole) AS DOUBLE)) AS BIGINT)"
_FAR = f"pairs AS (SELECT {_PICK(1)} AS one, {_PICK(2)} AS other FROM unit), far AS (SELECT count(*) AS n_pairs, round(avg({_cos('x', 'y')}), 6) AS mean_cosine FROM pairs JOIN whole x ON x.agent_id = one JOIN whole y ON y.agent_id = other)"


@query("gate_adjacent", f"WITH {_UNIT}, {_NEAR} SELECT * FROM near")
def gate_adjacent(spark, sf_dir):
    rows, capacity, _ = _context(spark, sf_dir)
    return metrics.adjacent_cosine(rows, capacity, GATE)


@query("gate_random_pairs", f"WITH {_UNIT}, {_FAR} SELECT * FROM far")
def gate_random_pairs(spark, sf_dir):
    rows, capacity, _ = _context(spark, sf_dir)
    return metrics.random_cosine(rows, capacity, rows.count(), GATE)


@query("gate_score", f"WITH {_UNIT}, {_NEAR}, {_FAR} SELECT round(near.mean_cosine - far.mean_cosine, 6) AS gate_score, CASE WHEN near.mean_cosine - far.mean_cosine > 0.1 THEN 'mp' ELSE 'fifo_windowed' END AS policy FROM near, far")
def gate_score(spark, sf_dir):
    rows, capacity, _ = _context(spark, sf_dir)
    return metrics.gate(rows, capacity, rows.count(), GATE)


_RESULTS = "results AS (SELECT l_returnflag AS method, l_linestatus AS pattern, l_linenumber AS seed, round(avg(l_extendedprice), 4) AS makespan, round(avg(l_quantity), 4) AS dispatches, count(*) >= 10 AS valid FROM lineitem GROUP BY ALL)"


def _results(spark, sf_dir) -> DataFrame:
    """A table of runs, as reports take it, derived from lineitem: flags as methods and patterns, line numbers as seeds."""
    own = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("method"), F.col("l_linestatus").alias("pattern"), F.col("l_linenumber").alias("seed"), "l_extendedprice", "l_quantity")
    return own.groupBy("method", "pattern", "seed").agg(F.round(F.avg("l_extendedprice"), 4).alias("makespan"), F.round(F.avg("l_quantity"), 4).alias("dispatches"), (F.count(F.lit(1)) >= 10).alias("valid"))


_STATS = ", ".join(f"round(avg({m}), 6) AS mean_{m}, round(coalesce(stddev_samp({m}), 0), 6) AS std_{m}" for m in ("makespan", "dispatches"))


@query("method_summary", f"WITH {_RESULTS} SELECT method, pattern, count(*) AS runs, CAST(sum(CAST(valid AS INT)) AS BIGINT) AS valid_runs, {_STATS} FROM results GROUP BY ALL")
def method_summary(spark, sf_dir):
    return metrics.method_summary(_results(spark, sf_dir), ["method", "pattern"], ["makespan", "dispatches"])


@query("paired_reduction", f"WITH {_RESULTS}, cuts AS (SELECT o.pattern, 1.0 - o.makespan / b.makespan AS cut FROM results o JOIN results b ON o.pattern = b.pattern AND o.seed = b.seed WHERE o.method = 'R' AND b.method = 'A') SELECT pattern, count(*) AS pairs, round(avg(cut), 6) AS mean_reduction, round(quantile_cont(cut, 0.5), 6) AS median_reduction, count(*) FILTER (WHERE cut > 0) AS wins FROM cuts GROUP BY pattern")
def paired_reduction(spark, sf_dir):
    return metrics.paired_reduction(_results(spark, sf_dir), "R", "A", ["seed"], "makespan", ["pattern"])


@query("exact_rate_pivot", f"WITH {_RESULTS} SELECT method, " + ", ".join(f"round(avg(CAST(dispatches > 25.5 AS DOUBLE)) FILTER (WHERE pattern = '{p}'), 6) AS {p}" for p in "FO") + " FROM results GROUP BY method")
def exact_rate_pivot(spark, sf_dir):
    return metrics.rate_pivot(_results(spark, sf_dir), "method", "pattern", ["F", "O"], F.col("dispatches") > 25.5)


#: Runs derived from orders: priorities as methods; a customer's orders are a run, its makespan over that of its largest order.
_RUNS = "runs AS (SELECT o_orderpriority AS method, o_custkey AS seed, count(*) AS n_agents, sum(o_totalprice) / max(o_totalprice) AS normalized_makespan, count(*) = count(DISTINCT o_orderkey) AS explicit_agents, CAST(count(DISTINCT o_totalprice) AS DOUBLE) / count(*) AS unique_fraction, bool_and(o_totalprice > 1000) AS valid FROM orders GROUP BY ALL)"
_GATES = {"valid": "valid", "tasks": "n_agents = 2", "explicit": "explicit_agents", "distinct": "unique_fraction >= 0.999", "bound": "normalized_makespan >= 1 - 1e-8"}


def _runs(spark, sf_dir) -> DataFrame:
    own = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("method"), F.col("o_custkey").alias("seed"))
    return own.agg(
        F.count(F.lit(1)).alias("n_agents"), (F.sum("o_totalprice") / F.max("o_totalprice")).alias("normalized_makespan"), (F.count(F.lit(1)) == F.countDistinct("o_orderkey")).alias("explicit_agents"),
        (F.countDistinct("o_totalprice").cast("double") / F.count(F.lit(1))).alias("unique_fraction"), F.every(F.col("o_totalprice") > 1000).alias("valid"),
    )


@query("result_gates", f"WITH {_RUNS}, failed AS (" + " UNION ALL ".join(f"SELECT '{g}' AS gate, count(*) FILTER (WHERE NOT ({c})) AS n_failed FROM runs" for g, c in _GATES.items()) + ") SELECT gate, n_failed, n_failed = 0 AS holds FROM failed")
def result_gates(spark, sf_dir):
    return metrics.result_gates(_runs(spark, sf_dir), 2)


@query("result_integrity", f"WITH {_RUNS} SELECT method, bool_and(valid) AS all_valid, bool_and(explicit_agents) AS all_explicit, round(min(unique_fraction), 6) AS min_unique_fraction FROM runs GROUP BY method")
def result_integrity(spark, sf_dir):
    return metrics.integrity(_runs(spark, sf_dir), ["method"])


@query("duration_check", f"WITH {TASKS} SELECT min(duration) AS least, max(duration) AS greatest, max(duration) - min(duration) <= 1e-9 AS are_equal FROM tasks")
def duration_check(spark, sf_dir):
    return validate.duration_check(tasks(spark, sf_dir))


# ---------------------------------------------------------------- generated tasks

_IDS = "ids AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS id FROM orders)"
_SHAPE = gen.Workload()
_U = lambda *keys: uniform_sql(_SHAPE.seed, *map(str, keys))


def _span(low: float, high: float, u: str) -> str:
    return f"({low!r}::DOUBLE + {high - low!r}::DOUBLE * {u})"


def _level_sql(k: int) -> str:
    """A cluster's level of resource k."""
    m = _SHAPE.resources
    base = f"CASE WHEN cluster % {m} = {k} THEN {_span(*_SHAPE.dominant, _U('cluster', gen.MAIN))} ELSE {_span(*_SHAPE.background, _U('cluster', gen.LEVEL + k))} END"
    return f"({base}) * CASE WHEN (cluster % {m} + 1 + cluster // {m}) % {m} = {k} THEN {_span(*_SHAPE.second, _U('cluster', gen.SECOND))} ELSE 1.0::DOUBLE END"


def _generated_sql(pattern: str) -> str:
    n = _SHAPE.clusters
    shares = f"gammas AS (SELECT c AS cluster, sum(-ln(greatest({_U('c', f'({gen.SHARE} + i)')}, 1e-12))) AS g FROM range({n}) a(c), range({_SHAPE.concentration}) b(i) GROUP BY c), edges AS (SELECT cluster, sum(g) OVER (ORDER BY cluster) / (SELECT sum(g) FROM gammas) AS high FROM gammas)"
    drawn = f"drawn AS (SELECT id, CAST(count(e.cluster) AS INT) AS cluster FROM ids LEFT JOIN edges e ON e.cluster < {n - 1} AND e.high <= {_U('id', gen.LABEL, 0)} GROUP BY id)"
    labelled = {
        "iid": "labelled AS (SELECT * FROM drawn)",
        "bursts": f"counts AS (SELECT cluster, count(*) AS n FROM drawn GROUP BY cluster), runs AS (SELECT cluster, n, sum(n) OVER (ORDER BY {_U('cluster', gen.TURN)}, cluster) AS till FROM counts), labelled AS (SELECT id, cluster FROM ids JOIN runs ON id >= till - n AND id < till)",
        "complementary": f"labelled AS (SELECT id, CAST((row_number() OVER (ORDER BY {_U('id', gen.PLACE, 0)}, id) - 1) % {n} AS INT) AS cluster FROM ids)",
    }[pattern]
    normal = lambda k: f"sqrt(-2.0::DOUBLE * ln(greatest({_U('id', gen.RADIUS + k, 0)}, 1e-12))) * cos(2.0::DOUBLE * pi() * {_U('id', gen.ANGLE + k, 0)})"
    added = lambda k: "" if pattern == "complementary" else f" + {_span(*_SHAPE.added, _U('id', gen.ADDED + k, 0))}"
    demand = lambda k: f"round({_level_sql(k)} * exp({_SHAPE.jitter!r}::DOUBLE * {normal(k)}){added(k)}, 6) AS r{k}"
    return f"WITH {_IDS}, {shares}, {drawn}, {labelled}, made AS (SELECT id AS agent_id, CAST(cluster AS INT) AS cluster, {', '.join(map(demand, range(_SHAPE.resources)))}, CAST(1 AS DOUBLE) AS duration FROM labelled) "


def _generated(spark, sf_dir, pattern: str) -> DataFrame:
    ids = ranked(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], "id")
    return gen.generate(ids, pattern)


def _register_pattern(pattern: str) -> None:
    @query(f"generate_{pattern}", _generated_sql(pattern) + "SELECT * FROM made")
    def made(spark, sf_dir):
        return _generated(spark, sf_dir, pattern)

    @query(f"label_runs_{pattern}", _generated_sql(pattern) + "SELECT count(*) AS n_pairs, count(*) FILTER (WHERE x.cluster <> y.cluster) AS n_changes FROM made x JOIN made y ON x.agent_id = y.agent_id + 1")
    def runs(spark, sf_dir):
        return metrics.label_runs(_generated(spark, sf_dir, pattern).select("agent_id", "cluster"), "agent_id", "cluster")


for _p in gen.PATTERNS:
    _register_pattern(_p)


def _register_durations(mode: str, sql: str) -> None:
    @query(f"durations_{mode}", f"WITH {TASKS} SELECT agent_id, round({sql}, 6) AS duration FROM tasks")
    def durations(spark, sf_dir):
        return tasks(spark, sf_dir).select("agent_id", F.round(gen.duration_column(mode), 6).alias("duration"))


_D, _V = uniform_sql(100, "agent_id", "31"), uniform_sql(100, "agent_id", "37")
_register_durations("uniform", f"0.65::DOUBLE + 0.7::DOUBLE * {_D}")
_register_durations("lognormal", f"exp(CAST({-0.35 * 0.35 / 2!r} AS DOUBLE) + 0.35::DOUBLE * sqrt(-2.0::DOUBLE * ln(greatest({_D}, 1e-12))) * cos(2.0::DOUBLE * pi() * {_V}))")


# ---------------------------------------------------------------- waves

_STARTS = f"""WITH RECURSIVE {CAPS},
sums AS MATERIALIZED (SELECT agent_id, r0, r1, r2, r3, {_PREFIX} FROM tasks),
starts AS (
  SELECT CAST(0 AS BIGINT) AS wave, CAST(0 AS BIGINT) AS first, CAST(0 AS HUGEINT) AS b0, CAST(0 AS HUGEINT) AS b1, CAST(0 AS HUGEINT) AS b2, CAST(0 AS HUGEINT) AS b3
  UNION ALL
  SELECT any_value(s.wave) + 1, min(x.agent_id), min(x.s0 - x.r0), min(x.s1 - x.r1), min(x.s2 - x.r2), min(x.s3 - x.r3)
  FROM starts s, sums x, caps
  WHERE x.agent_id >= s.first AND (x.s0 > s.b0 + c0 OR x.s1 > s.b1 + c1 OR x.s2 > s.b2 + c2 OR x.s3 > s.b3 + c3)
  HAVING count(*) > 0),
placed AS (SELECT t.agent_id, t.r0, t.r1, t.r2, t.r3, s.wave FROM tasks t ASOF JOIN starts s ON t.agent_id >= s.first)"""
_USED = ", ".join(f"CAST(sum(r{k}) AS BIGINT) AS used_r{k}" for k in range(4))


def _units(rows: DataFrame) -> DataFrame:
    """The tasks as of one unit of time each, as waves demand."""
    return rows.withColumn("duration", F.lit(1).cast("bigint"))


def _strict_waves(spark, sf_dir) -> tuple[DataFrame, list[int]]:
    rows, capacity, _ = _context(spark, sf_dir)
    rows = _units(rows)
    return plans.strict_waves(rows, capacity, rows.count()), capacity


@query("strict_fifo_waves", f"{_STARTS} SELECT wave, count(*) AS n_tasks, {_USED} FROM placed GROUP BY wave")
def strict_fifo_waves(spark, sf_dir):
    return plans.wave_summary(_strict_waves(spark, sf_dir)[0])


@query("trace_capacity_sweep", f"{_STARTS} SELECT CAST(wave AS DOUBLE) AS at, count(*) AS n_running, " + " AND ".join(f"sum(p.r{k}) <= any_value(c{k})" for k in range(4)) + " AS holds FROM placed p, caps GROUP BY wave")
def trace_capacity_sweep(spark, sf_dir):
    waves, capacity = _strict_waves(spark, sf_dir)
    return metrics.capacity_sweep(plans.trace(waves), capacity)


@query("trace_check", f"{_STARTS} SELECT count(*) AS n_rows, count(*) FILTER (WHERE p.wave IS NULL) AS n_open, count(*) FILTER (WHERE p.wave + 1 < p.wave) AS n_reversed, count(*) FILTER (WHERE p.wave IS NULL) AS n_without_wave FROM tasks t LEFT JOIN placed p ON t.agent_id = p.agent_id")
def trace_check(spark, sf_dir):
    waves, _ = _strict_waves(spark, sf_dir)
    return validate.trace_check(plans.trace(waves), tasks(spark, sf_dir))


#: First fit wave by wave is first fit into bins: each task, in order, goes to the first wave that holds it.
BINS = f"""WITH {CAPS},
bins AS (
  SELECT list_reduce(
    list([{{'n': CAST(0 AS BIGINT), 'r0': r0, 'r1': r1, 'r2': r2, 'r3': r3}}] ORDER BY agent_id),
    lambda s, x: list_transform(s, lambda b, i:
      CASE WHEN i = list_position(list_transform(s, lambda c: c.r0 >= x[1].r0 AND c.r1 >= x[1].r1 AND c.r2 >= x[1].r2 AND c.r3 >= x[1].r3), true)
      THEN {{'n': b.n + 1, 'r0': b.r0 - x[1].r0, 'r1': b.r1 - x[1].r1, 'r2': b.r2 - x[1].r2, 'r3': b.r3 - x[1].r3}} ELSE b END),
    list_transform(range(40), lambda k: {{'n': CAST(0 AS BIGINT), 'r0': any_value(c0), 'r1': any_value(c1), 'r2': any_value(c2), 'r3': any_value(c3)}})) AS found
  FROM tasks, caps),
each AS (SELECT CAST(unnest(range(40)) AS BIGINT) AS wave, unnest(found) AS b FROM bins),
filled AS (SELECT wave, b.n AS n_tasks, c0 - b.r0 AS used_r0, c1 - b.r1 AS used_r1, c2 - b.r2 AS used_r2, c3 - b.r3 AS used_r3 FROM each, caps WHERE b.n > 0)"""


@query("windowed_fifo_waves", f"{BINS} SELECT * FROM filled")
def windowed_fifo_waves(spark, sf_dir):
    rows, capacity, _ = _context(spark, sf_dir)
    return plans.wave_summary(plans.policy_waves(_units(rows), capacity, plans.fifo_policy()))


@query("mp_waves")
def mp_waves(spark, sf_dir):
    rows, capacity, _ = _context(spark, sf_dir)
    return plans.wave_summary(plans.policy_waves(_units(rows), capacity, plans.sparse_policy("mp")))


_GATE_SQL = f"SELECT CASE WHEN near.mean_cosine - far.mean_cosine > 0.1 THEN 'mp' ELSE 'fifo_windowed' END AS policy FROM near, far"


@query("adaptive_waves", f"{BINS}, {_UNIT.removeprefix(CAPS + ', ')}, {_NEAR}, {_FAR} SELECT f.*, g.policy FROM filled f, ({_GATE_SQL}) g")
def adaptive_waves(spark, sf_dir):
    """The gate's one row picks the policy; the waves follow it."""
    rows, capacity, _ = _context(spark, sf_dir)
    chosen = metrics.gate(rows, capacity, rows.count(), GATE).first()["policy"]
    policy = plans.sparse_policy("mp") if chosen == "mp" else plans.fifo_policy()
    return plans.wave_summary(plans.policy_waves(_units(rows), capacity, policy)).withColumn("policy", F.lit(chosen))


# ---------------------------------------------------------------- solvers


def _pursuit_sql(rounds: int) -> str:
    """Matching pursuit as a chain of rounds: the best atom, then the residual less its share."""
    norm = f"sqrt({SQUARE})"
    parts = [f"q0 AS (SELECT DISTINCT {', '.join(f'b{k} AS t{k}' for k in range(4))} FROM shared)"]
    for i in range(rounds):
        corr = f"({' + '.join(f'a{k} * t{k}' for k in range(4))}) / {norm}"
        parts.append(f"p{i} AS (SELECT agent_id, {corr} AS step, {', '.join(f'a{k} / {norm} AS u{k}' for k in range(4))} FROM shared, q{i} ORDER BY round({corr} * 1e6, 4) DESC, agent_id LIMIT 1)")
        parts.append(f"q{i + 1} AS (SELECT {', '.join(f't{k} - step * u{k} AS t{k}' for k in range(4))} FROM p{i}, q{i})")
    union = " UNION ALL ".join(f"SELECT agent_id, step FROM p{i}" for i in range(rounds))
    return f"WITH {SHARED}, {', '.join(parts)} SELECT agent_id, round(sum(step), 5) AS coefficient FROM ({union}) GROUP BY agent_id"


def _target(capacity: list[int], remaining: list[int]) -> list[float]:
    return [r / c for r, c in zip(remaining, capacity, strict=True)]


def _register_pursuit(method: str, atoms: int, sql: str | None) -> None:
    @query(f"solve_{method}", sql)
    def solved(spark, sf_dir):
        rows, capacity, remaining = _context(spark, sf_dir)
        found = solve.pursue(rows, _target(capacity, remaining), capacity, method, atoms)
        return spark.createDataFrame(found, "agent_id bigint, coefficient double").select("agent_id", F.round("coefficient", 5).alias("coefficient"))


_register_pursuit("mp", solve.ATOMS, _pursuit_sql(solve.ATOMS))
_register_pursuit("omp", solve.ATOMS, None)
_register_pursuit("ols", solve.ATOMS, None)


def _register_proximal(method: str) -> None:
    @query(f"solve_{method}")
    def solved(spark, sf_dir):
        """Every task's coefficient; those under the tolerance are left out of the report, not of the solution."""
        rows, capacity, remaining = _context(spark, sf_dir)
        found, _ = {"fista": proximal.fista, "irls": proximal.irls}[method](rows, _target(capacity, remaining), capacity)
        return found.where(F.col("coefficient") > proximal.TOLERANCE).select("agent_id", F.round("coefficient", 6).alias("coefficient"))


for _m in ("fista", "irls"):
    _register_proximal(_m)


def _register_ranked(method: str) -> None:
    @query(f"ranked_dispatch_{method}")
    def ranked_batch(spark, sf_dir):
        rows, capacity, remaining = _context(spark, sf_dir)
        return dispatch.ranked_dispatch(rows, remaining, capacity, method, POOL)


for _m in METHODS:
    _register_ranked(_m)


# ---------------------------------------------------------------- streams


@query("stream_windows", "SELECT CAST(epoch(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS window_start, event_type, count(*) AS n, CAST(sum(CAST(round(value * 1000) AS BIGINT)) AS BIGINT) AS value_milli FROM events GROUP BY ALL")
def stream_windows(spark, sf_dir):
    return windows.drain(spark, sf_dir)


from . import catalogue_more  # noqa: E402, F401  registers its queries beside these
