"""Proximal solvers over whole tables: the coefficients are a column, and each step is one aggregate and one projection.

The atoms are the tasks' demands as shares of the capacity, scaled to length 1. The driver holds one number for each resource, a
few sums, and the matrix of the resources among themselves; tasks of the executors hold their own rows alone.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.demand import Amounts, by_demand, demands_of, plus, shares
from ..sources.shared import written

PENALTY, POWER, FLOOR, TOLERANCE = 0.025, 0.5, 1e-3, 1e-6
#: Steps after which the state is written, so that plans stay short and a lost executor costs a few steps.
KEPT_STEPS = 16


@dataclass
class Report:
    """How a solver ended: residual by resource, objective, steps, whether it converged, and what else the solver counts."""

    method: str
    residual: list[float]
    objective: float
    iterations: int
    converged: bool
    counts: dict[str, float] = field(default_factory=dict)

    def row(self) -> tuple:
        return self.method, math.sqrt(sum(x * x for x in self.residual)), self.objective, self.iterations, self.converged


REPORT = "method string, residual_norm double, objective double, iterations int, converged boolean"


def _number(x: float) -> str:
    return f"{float(x)!r}D"


class _State:
    """A table of atoms and the solver's columns, changed by projections and looked at by sums, both written in SQL.

    What is written are the demands and the solver's columns; the atoms are made of the demands again where they are read.
    """

    def __init__(self, tasks: DataFrame, capacity: Amounts):
        self.capacity = {f"_r{k}": c for k, c in enumerate(by_demand(capacity).values())}
        self.m, self.steps = len(self.capacity), 0
        self.df = self._with_atoms(written(tasks.select("agent_id", *(F.col(d).alias(f"_r{k}") for k, d in enumerate(demands_of(capacity)))), "atoms"))

    def _with_atoms(self, df: DataFrame) -> DataFrame:
        self.made = [*(f"_a{k}" for k in range(self.m)), "norm", *(f"u{k}" for k in range(self.m))]
        own = df.select("*", *(x.alias(f"_a{k}") for k, x in enumerate(shares(self.capacity))))
        own = own.select("*", F.sqrt(plus([F.col(f"_a{k}") * F.col(f"_a{k}") for k in range(self.m)])).alias("norm"))
        own = own.select("*", *((F.col(f"_a{k}") / F.col("norm")).alias(f"u{k}") for k in range(self.m)))
        return own

    def put(self, gone: Sequence[str] = (), **columns: str) -> None:
        """Replaces the solver's columns that are named, drops those that are gone, and keeps the others; all new ones see the old values."""
        kept = [c for c in self.df.columns if c not in columns and c not in gone]
        self.df, self.steps = self.df.selectExpr(*kept, *(f"{e} AS {n}" for n, e in columns.items())), self.steps + 1
        if self.steps % KEPT_STEPS == 0:
            self.df = self._with_atoms(written(self.df.drop(*self.made), "solver"))

    def along(self, vector: Sequence[float]) -> str:
        """Each atom's product with a vector of the resources."""
        return "(" + " + ".join(f"u{k} * {_number(v)}" for k, v in enumerate(vector)) + ")"

    def sums(self, image: str, also: Sequence[str] = (), **values: str) -> tuple[np.ndarray, dict[str, float]]:
        """The atoms' sum weighted by a column, one number for each resource, and other sums, in one aggregate; also are columns that these need."""
        own = self.df.selectExpr("*", *also) if also else self.df
        row = own.selectExpr(*(f"sum(u{k} * {image}) AS i{k}" for k in range(self.m)), *(f"sum({v}) AS {n}" for n, v in values.items())).first()
        return np.array([row[f"i{k}"] or 0.0 for k in range(self.m)]), {n: row[n] or 0.0 for n in values}


def _change(moved: float, before: float) -> float:
    return math.sqrt(moved) / max(math.sqrt(before), 1e-12)


def fista(tasks: DataFrame, target: Sequence[float], capacity: Amounts, penalty: float = PENALTY, steps: int = 64, tolerance: float = TOLERANCE, restart: bool = True) -> tuple[DataFrame, Report]:
    """(agent_id, coefficient) of every task, and the report, of the l1-penalised nonnegative fit of target.

    Accelerated proximal steps of length 1 / L, L the largest eigenvalue of the resources' matrix. With restart, momentum is given up where
    the objective rises, and where it points against the last step. Ends when a step changes the coefficients by a share of
    tolerance at most, after three steps at least. Coefficients are for demands as shares of the capacity. An empty table has
    no coefficients, the target as residual, and converges at once.
    """
    if penalty < 0:
        raise ValueError("the penalty is negative")
    b, m = np.asarray(target, dtype=np.float64), len(by_demand(capacity))
    state = _State(tasks, capacity)
    gram = state.df.agg(*(F.sum(F.col(f"u{i}") * F.col(f"u{j}")).alias(f"g{i}_{j}") for i in range(m) for j in range(i, m))).first()
    if gram["g0_0"] is None:
        return state.df.select("agent_id", F.lit(0.0).alias("coefficient")), Report("fista", b.tolist(), 0.5 * float(b @ b), 0, True)
    square = np.array([[gram[f"g{min(i, j)}_{max(i, j)}"] for j in range(m)] for i in range(m)])
    length = 1.0 / max(float(np.linalg.eigvalsh(square)[-1]), 1e-12)
    state.put(x="0.0D", y="0.0D")
    image_x = image_y = np.zeros(m)
    momentum, before, converged, restarts, k = 1.0, math.inf, False, 0, 0

    def step(base: str, image: np.ndarray) -> tuple[str, tuple[np.ndarray, dict[str, float]]]:
        new = f"greatest({base} - {_number(length)} * {state.along(image - b)} - {_number(penalty * length)}, 0.0D)"
        return new, state.sums("n", [f"{new} AS n"], total="n", moved="(n - x) * (n - x)", size="x * x", uphill=f"({base} - n) * (n - x)")

    def objective(found: tuple[np.ndarray, dict[str, float]]) -> float:
        rest = found[0] - b
        return 0.5 * float(rest @ rest) + penalty * found[1]["total"]

    for k in range(1, steps + 1):
        new, found = step("y", image_y)
        if restart and objective(found) > before + 1e-14:
            momentum, restarts = 1.0, restarts + 1
            new, found = step("x", image_x)
        image, sums = found
        later = 0.5 * (1.0 + math.sqrt(1.0 + 4.0 * momentum * momentum))
        push = (momentum - 1.0) / later
        if restart and sums["uphill"] > 0:
            push, later, restarts = 0.0, 1.0, restarts + 1
        state.put(n=new)
        state.put(["n"], x="n", y=f"n + {_number(push)} * (n - x)")
        image_x, image_y, momentum, before = image, image + push * (image - image_x), later, objective(found)
        if k >= 3 and _change(sums["moved"], sums["size"]) <= tolerance:
            converged = True
            break
    residual = b - image_x
    own = written(state.df.select("agent_id", (F.col("x") / F.col("norm")).alias("coefficient")), "coefficients")
    total = own.agg(F.sum(F.abs("coefficient"))).first()[0]
    return own, Report("fista", residual.tolist(), 0.5 * float(residual @ residual) + penalty * total, k, converged, {"restarts": restarts})


def irls(
    tasks: DataFrame, target: Sequence[float], capacity: Amounts, penalty: float = PENALTY, power: float = POWER, floor: float = FLOOR, rounds: int = 8, inner: int = 32, tolerance: float = TOLERANCE
) -> tuple[DataFrame, Report]:
    """(agent_id, coefficient) of every task, and the report, of the lp-penalised nonnegative fit of target by reweighted least squares.

    Round k smooths by the greater of floor and 0.25 / 2 ** (k - 1), and solves its system by at most min(inner, 2 ** k) conjugate gradients,
    each one aggregate: products with the system come from sums of one number for each resource. Ends as fista does.
    """
    if not 0 < power <= 1 or penalty < 0 or floor <= 0:
        raise ValueError("power lies in (0, 1], the penalty is not negative and the floor is positive")
    b, m = np.asarray(target, dtype=np.float64), len(by_demand(capacity))
    state = _State(tasks, capacity)
    own = state.along(b)
    first = state.df.selectExpr(f"max({own}) AS most", f"sum({own} * {own}) AS square").first()
    if first["square"] is None:
        return state.df.select("agent_id", F.lit(0.0).alias("coefficient")), Report("irls", b.tolist(), 0.5 * float(b @ b), 0, True)
    enough = 0.1 * tolerance * max(first["square"], 1.0)
    state.put(x=f"greatest({own}, 0.0D) / {_number(max(first['most'], 1.0))}")
    image_x, _ = state.sums("x")
    converged, used, solved, k = False, 0, 0, 0
    for k in range(1, rounds + 1):
        smooth = max(floor, 0.25 * 0.5 ** (k - 1))
        state.put(d=f"{_number(penalty * power / 2.0)} * pow(x * x + {_number(smooth * smooth)}, {_number(power / 2.0 - 1.0)})")
        state.put(z="x", r=f"{state.along(b - image_x)} - d * x", p=f"{state.along(b - image_x)} - d * x")
        image_p, s = state.sums("r", square="r * r", spread="d * r * r")
        square, spread, done = s["square"], s["spread"], s["square"] <= enough
        for _ in range(0 if done else min(inner, max(2, 2**k))):
            bend = float(image_p @ image_p) + spread
            if not math.isfinite(bend) or bend <= 1e-30:
                break
            used += 1
            go = _number(square / bend)
            state.put(z=f"z + {go} * p", r=f"r - {go} * ({state.along(image_p)} + d * p)")
            image_r, s = state.sums("r", square="r * r", spread="d * r * r", cross="d * r * p")
            if s["square"] <= enough:
                done = True
                break
            turn = s["square"] / max(square, 1e-30)
            state.put(p=f"r + {_number(turn)} * p")
            image_p, square = image_r + turn * image_p, s["square"]
            spread = s["spread"] + 2.0 * turn * s["cross"] + turn * turn * spread
        solved += done
        image_x, s = state.sums("n", ["greatest(z, 0.0D) AS n"], moved="(n - x) * (n - x)", size="x * x")
        state.put(["d", "z", "r", "p"], x="greatest(z, 0.0D)")
        if k >= 3 and _change(s["moved"], s["size"]) <= tolerance:
            converged = True
            break
    residual = b - image_x
    found = written(state.df.select("agent_id", (F.col("x") / F.col("norm")).alias("coefficient")), "coefficients")
    total = found.agg(F.sum(F.pow(F.col("coefficient") * F.col("coefficient") + F.lit(floor * floor), F.lit(power / 2.0)))).first()[0]
    return found, Report("irls", residual.tolist(), 0.5 * float(residual @ residual) + penalty * total, k, converged, {"cg_iterations": used, "cg_converged_systems": solved})
