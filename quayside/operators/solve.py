"""Sparse nonnegative approximation of what remains by the tasks' demand vectors.

The pursuits look at every task in each round: one aggregate finds the best atom, and only the chosen atoms
(at most a dozen vectors of one number per resource) and the residual are on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.demand import Amounts, demands_of, plus, shares
from .proximal import Report

ATOMS = 12
TOLERANCE = 1e-6


def nonnegative_fit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least squares of b by a few columns of a with coefficients of 0 or more, by an active set."""
    on, x = np.ones(a.shape[1], dtype=bool), np.zeros(a.shape[1])
    while on.any():
        part = np.linalg.lstsq(a[:, on], b, rcond=None)[0]
        if (part > 0).all():
            x[on] = part
            return x
        on[np.flatnonzero(on)[part <= 0]] = False
    return x


def _best_atom(tasks: DataFrame, value: Column, capacity: Amounts, chosen: Sequence[int]):
    """The task of greatest value, of equals the least id, and its normalised demands."""
    rest = tasks.where(~F.col("agent_id").isin(list(chosen))) if chosen else tasks
    own = rest.select(F.struct(F.round(value * F.lit(1e6), 4).alias("value"), (-F.col("agent_id")).alias("id"), *(s.alias(d) for d, s in zip(demands_of(capacity), shares(capacity), strict=True))).alias("x"))
    row = own.agg(F.max("x").alias("x")).first()["x"]
    return None if row is None else (row["value"], -row["id"], np.array([row[d] for d in demands_of(capacity)]))


def _correlation(residual: np.ndarray, capacity: Amounts) -> Column:
    a = shares(capacity)
    return plus([x * F.lit(float(r)) for x, r in zip(a, residual, strict=True)]) / F.sqrt(plus([x * x for x in a]))


def _gain(residual: np.ndarray, basis: np.ndarray, capacity: Amounts) -> Column:
    """What the squared residual loses if a task joins atoms with this orthonormal basis."""
    a = shares(capacity)
    square = plus([x * x for x in a])
    for q in basis.T:
        along = plus([x * F.lit(float(y)) for x, y in zip(a, q, strict=True)])
        square = square - along * along
    match = F.greatest(plus([x * F.lit(float(r)) for x, r in zip(a, residual, strict=True)]), F.lit(0.0))
    return F.when(square > F.lit(1e-18), match * match / square).otherwise(F.lit(0.0))


def pursue(tasks: DataFrame, target: Sequence[float], capacity: Amounts, method: str, atoms: int = ATOMS) -> list[tuple[int, float]]:
    """The coefficients of pursued, without its report."""
    return pursued(tasks, target, capacity, method, atoms)[0]


def pursued(tasks: DataFrame, target: Sequence[float], capacity: Amounts, method: str, atoms: int = ATOMS) -> tuple[list[tuple[int, float]], Report]:
    """(agent_id, coefficient) of the atoms that matching pursuit (mp), omp or ols chooses for target, and how it ended.

    mp steps along the best atom and may choose one again; omp chooses by correlation and ols by the loss
    after it, and both fit all chosen atoms anew. Atoms have unit length; coefficients are 0 or more. A pursuit
    converges when the residual is small or no atom improves it, and not when its steps run out.
    """
    b = np.asarray(target, dtype=np.float64)
    budget = atoms if method == "mp" else min(atoms, len(b))
    residual, ids, columns, x, steps, converged = b.copy(), [], [], np.zeros(0), 0, False
    for _ in range(budget):
        if np.linalg.norm(residual) <= TOLERANCE * np.linalg.norm(b):
            converged = True
            break
        basis = np.linalg.qr(np.array(columns).T)[0] if columns else np.zeros((len(b), 0))
        value = _gain(residual, basis, capacity) if method == "ols" else _correlation(residual, capacity)
        best = _best_atom(tasks, value, capacity, [] if method == "mp" else ids)
        if best is None or best[0] <= 0:
            converged = True
            break
        steps += 1
        unit = best[2] / np.linalg.norm(best[2])
        if method == "mp":
            step = float(unit @ residual)
            if best[1] in ids:
                x[ids.index(best[1])] += step
            else:
                ids.append(best[1])
                x = np.append(x, step)
            residual = residual - step * unit
        else:
            ids.append(best[1])
            columns.append(unit)
            x = nonnegative_fit(np.array(columns).T, b)
            residual = b - np.array(columns).T @ x
    converged = converged or bool(np.linalg.norm(residual) <= TOLERANCE * np.linalg.norm(b))
    found = [(i, float(c)) for i, c in sorted(zip(ids, x.tolist(), strict=True)) if c > 0]
    return found, Report(method, residual.tolist(), 0.5 * float(residual @ residual), steps, converged)
