"""Whole-table proximal solvers against the same methods on dense matrices, and what must hold of any solution."""

import threading

import numpy as np
import pytest

from quayside import catalogue
from quayside.operators import proximal

PENALTY = proximal.PENALTY


def tasks_of(spark, demands):
    m = demands.shape[1]
    rows = [(i, *map(float, d)) for i, d in enumerate(demands)]
    return spark.createDataFrame(rows, "agent_id bigint, " + ", ".join(f"r{k} double" for k in range(m))).repartition(3)


def unit(demands, capacity):
    shares = demands / np.array(capacity)
    norms = np.linalg.norm(shares, axis=1)
    return (shares / norms[:, None]).T, norms


def dense_fista(a, b, steps, restart, tolerance=1e-6):
    step, x = 1 / np.linalg.eigvalsh(a @ a.T)[-1], np.zeros(a.shape[1])
    objective = lambda z: 0.5 * np.sum((a @ z - b) ** 2) + PENALTY * np.abs(z).sum()
    prox = lambda z: np.maximum(z - step * (a.T @ (a @ z - b)) - PENALTY * step, 0)
    y, t, last, k = x, 1.0, np.inf, 0
    for k in range(1, steps + 1):
        base, new = y, prox(y)
        if restart and objective(new) > last + 1e-14:
            base, new, t = x, prox(x), 1.0
        later = (1 + np.sqrt(1 + 4 * t * t)) / 2
        push = (t - 1) / later
        if restart and (base - new) @ (new - x) > 0:
            push, later = 0.0, 1.0
        moved = np.linalg.norm(new - x) / max(np.linalg.norm(x), 1e-12)
        x, y, t, last = new, new + push * (new - x), later, objective(new)
        if k >= 3 and moved <= tolerance:
            return x, k, True
    return x, k, False


def dense_irls(a, b, rounds, inner=32, tolerance=1e-6):
    right = a.T @ b
    x, k = np.maximum(right, 0) / max(right.max(), 1), 0
    for k in range(1, rounds + 1):
        smooth = max(proximal.FLOOR, 0.25 * 0.5 ** (k - 1))
        d = PENALTY * 0.25 * (x * x + smooth**2) ** (0.25 - 1)
        z, r = x.copy(), right - a.T @ (a @ x) - d * x
        p, size = r.copy(), r @ r
        enough = 0.1 * tolerance * max(right @ right, 1)
        for _ in range(min(inner, max(2, 2**k)) if size > enough else 0):
            image = a.T @ (a @ p) + d * p
            go = size / (p @ image)
            z, r = z + go * p, r - go * image
            size, before = r @ r, size
            if size <= enough:
                break
            p = r + size / before * p
        new = np.maximum(z, 0)
        moved = np.linalg.norm(new - x) / max(np.linalg.norm(x), 1e-12)
        x = new
        if k >= 3 and moved <= tolerance:
            return x, k, True
    return x, k, False


def coefficients(df, n):
    out = np.full(n, np.nan)
    for r in df.collect():
        out[r["agent_id"]] = r["coefficient"]
    return out


@pytest.mark.parametrize(("m", "restart"), [(2, True), (4, True), (4, False), (7, True)])
def test_fista_is_the_dense_method(spark, m, restart):
    rng = np.random.default_rng(m)
    demands, capacity = rng.integers(1, 90, (300, m)), rng.integers(500, 900, m).tolist()
    b = rng.uniform(0.3, 1.0, m)
    a, norms = unit(demands, capacity)
    want, steps, converged = dense_fista(a, b, 25, restart)
    found, report = proximal.fista(tasks_of(spark, demands), b, capacity, steps=25, restart=restart)
    got = coefficients(found, 300)
    assert np.allclose(got, want / norms, rtol=1e-8, atol=1e-8 * (want / norms).max())
    assert (report.iterations, report.converged) == (steps, converged)
    assert np.allclose(report.residual, b - a @ want, atol=1e-9)
    assert report.objective == pytest.approx(0.5 * np.sum((b - a @ want) ** 2) + PENALTY * (want / norms).sum())


@pytest.mark.parametrize(("m", "rounds", "close"), [(2, 4, 1e-8), (4, 4, 1e-8), (7, 4, 1e-8), (4, 8, 1e-3)])
def test_irls_is_the_dense_method(spark, m, rounds, close):
    """In later rounds many conjugate gradients magnify rounding: the dense method alone differs by 4e-6 if its atoms are put in another order."""
    rng = np.random.default_rng(m + 20)
    demands, capacity = rng.integers(1, 90, (250, m)), rng.integers(500, 900, m).tolist()
    b = rng.uniform(0.3, 1.0, m)
    a, norms = unit(demands, capacity)
    want, steps, converged = dense_irls(a, b, rounds)
    found, report = proximal.irls(tasks_of(spark, demands), b, capacity, rounds=rounds)
    got = coefficients(found, 250)
    assert np.allclose(got, want / norms, rtol=close, atol=close * (want / norms).max())
    assert (report.iterations, report.converged) == (steps, converged)
    assert np.allclose(report.residual, b - a @ want, atol=close)
    assert report.counts["cg_iterations"] >= report.iterations


@pytest.mark.parametrize("solver", [proximal.fista, proximal.irls])
def test_a_target_of_few_atoms_is_met(spark, solver):
    """Three of five directions that stand at right angles make the target; nothing else is used, and the solver says it converged."""
    demands = np.eye(5) * 40
    b = np.array([0.9, 0.0, 0.35, 0.0, 0.6])
    found, report = solver(tasks_of(spark, demands + 1e-9), b, [100.0] * 5, penalty=1e-7)
    got = coefficients(found, 5)
    assert np.allclose(got * 0.4, b, atol=1e-3)
    assert report.converged and np.linalg.norm(report.residual) < 1e-3


def test_objective_never_rises_with_more_steps(spark):
    rng = np.random.default_rng(1)
    demands = rng.integers(1, 90, (60, 3))
    a, norms = unit(demands, [700] * 3)
    b = np.array([0.9, 0.2, 0.5])
    values = []
    for steps in (1, 4, 12):
        x = coefficients(proximal.fista(tasks_of(spark, demands), b, [700] * 3, steps=steps)[0], 60) * norms
        values.append(0.5 * np.sum((a @ x - b) ** 2) + PENALTY * x.sum())
        assert (x >= 0).all()
    assert values == sorted(values, reverse=True)


@pytest.mark.parametrize("solver", [proximal.fista, proximal.irls])
def test_no_atoms(spark, solver):
    found, report = solver(tasks_of(spark, np.ones((1, 2))).where("agent_id > 5"), [0.5, 0.25], [1.0, 1.0])
    assert found.count() == 0
    assert (report.residual, report.iterations, report.converged) == ([0.5, 0.25], 0, True)


def test_wrong_parameters(spark):
    df = tasks_of(spark, np.ones((1, 2)))
    with pytest.raises(ValueError):
        proximal.fista(df, [1, 1], [1, 1], penalty=-1)
    for wrong in ({"power": 0}, {"power": 1.5}, {"penalty": -1}, {"floor": 0}):
        with pytest.raises(ValueError):
            proximal.irls(df, [1, 1], [1, 1], **wrong)


@pytest.mark.parametrize("solver", [proximal.fista, proximal.irls])
def test_the_state_is_written_without_the_atoms(spark, monkeypatch, solver):
    """Whole demands stay as they are in what is written, and demands may bear the names of a solver's columns."""
    seen, keep = {}, proximal.written
    monkeypatch.setattr(proximal, "written", lambda df, name: seen.setdefault(name, df.columns) and keep(df, name))
    monkeypatch.setattr(proximal, "KEPT_STEPS", 2)
    tasks = spark.createDataFrame([(i, 3 * i + 1, 7 - i % 5) for i in range(6)], "agent_id bigint, x bigint, p bigint")
    found, _ = solver(tasks, [0.5, 0.4], {"x": 20, "p": 9}, **({"steps": 3} if solver is proximal.fista else {"rounds": 1, "inner": 2}))
    assert found.count() == 6
    assert seen["atoms"] == ["agent_id", "_r0", "_r1"]
    assert set(seen["solver"]) <= {"agent_id", "_r0", "_r1", "x", "y", "n", "d", "z", "r", "p"}


def test_solver_reports_run_beside_each_other(spark, sf_dir, monkeypatch):
    """Each of two solvers waits for the other to begin; rows stay in the order of the methods."""
    met = threading.Barrier(2)

    def beside(name):
        def run(pool, target, capacity):
            met.wait(120)
            return pool, proximal.Report(name, [0.0], float(pool.count()), 3, True)

        return run

    for name in ("fista", "irls"):
        monkeypatch.setattr(proximal, name, beside(name))
    rows = [tuple(r) for r in catalogue.QUERIES["solver_reports"](spark, sf_dir).collect()]
    assert [r[0] for r in rows] == ["mp", "omp", "ols", "fista", "irls"]
    assert rows[3][1:] == rows[4][1:] and rows[3][2] > 1000
