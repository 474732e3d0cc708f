"""Poisson regression with an offset by Newton steps on sums that Spark makes: coefficients, covariance, folds and arms.

A step needs the gradient and the Fisher matrix, p + p * p numbers, whatever the rows; each task adds up its
own, one row a task and fit reaches the driver. All fits of a cross-fit share every pass over the rows, which are written once.
Each fit leaves one fold out. Convergence is that of the coefficients; a fit that doesn't settle is an error.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindling.operators.shared import cut

STEPS, SETTLED = 60, 1e-10
#: The normal quantile of a two-sided interval of 95 %.
Z95 = 1.959963984540054


@dataclass
class Fit:
    """A linear predictor: offset + coef[0] + coef[1:] on features that are shifted by `mean` and scaled by `scale`.

    `covariance` is of the coefficients as fitted, null for a ridge fit; `condition` is the condition number of the Fisher
    matrix with its diagonal scaled to one, large where features can hardly be told apart.
    """

    names: list[str]
    mean: np.ndarray
    scale: np.ndarray
    coef: np.ndarray
    covariance: np.ndarray | None
    condition: float
    rows: int
    steps: int = field(default=0)

    def eta(self, offset: Column | str) -> Column:
        """The log of the expected count, from the columns of the features and an offset."""
        out = (F.col(offset) if isinstance(offset, str) else offset) + F.lit(float(self.coef[0]))
        for name, m, s, b in zip(self.names, self.mean, self.scale, self.coef[1:]):
            out = out + (F.col(name) - float(m)) / float(s) * float(b)
        return out

    def table(self, spark) -> DataFrame:
        """term, coefficient, se, low and high (95 %) of each term; on the features' own scale where none was shifted."""
        se = np.sqrt(np.diag(self.covariance)) if self.covariance is not None else [None] * len(self.coef)
        rows = [(n, float(b), None if e is None else float(e), None if e is None else float(b - Z95 * e), None if e is None else float(b + Z95 * e)) for n, b, e in zip(["(intercept)", *self.names], self.coef, se)]
        return spark.createDataFrame(rows, "term string, coefficient double, se double, low double, high double")


def _sums(rows: DataFrame, width: int, fits: list[tuple[int | None, np.ndarray, np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """For each fit (fold left out, mean, scale, coefficients): gradient, Fisher matrix and rows, as one vector."""
    p = width + 1

    def run(batches):
        total = np.zeros((len(fits), p + p * p + 1))
        for b in batches:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, width)
            y, o = (b.column(c).to_numpy(zero_copy_only=False) for c in ("y", "o"))
            fold = b.column("fold").to_numpy(zero_copy_only=False)
            for i, (left_out, mean, scale, coef) in enumerate(fits):
                at = slice(None) if left_out is None else fold != left_out
                z = np.column_stack((np.ones(len(y[at])), (x[at] - mean) / scale))
                mu = np.exp(np.clip(z @ coef + o[at], -60, 60))
                total[i] += np.concatenate((z.T @ (y[at] - mu), (z.T @ (z * mu[:, None])).ravel(), [len(mu)]))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(fits)), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["fit", "v"])

    parts = rows.mapInArrow(run, "fit int, v array<double>")
    v = parts.select("fit", F.posexplode("v").alias("at", "x")).groupBy("fit", "at").agg(F.sum("x").alias("x"))
    out = np.zeros((len(fits), p + p * p + 1))
    for r in v.collect():  # fits * (p + p * p + 1) rows
        out[r.fit, r.at] = r.x
    return list(out)


def poisson(df: DataFrame, features: list[str], label: str, offset: str, alpha: float = 0.0, standardize: bool = False, fold: str | None = None) -> dict[int | None, Fit]:
    """The fit over all rows, by key None; with `fold` also one for each fold, from the rows of the others.

    It minimises the mean negative log-likelihood plus alpha / 2 times the sum of squared coefficients, the intercept's with them.
    With `standardize`, features are shifted and scaled by the mean and the sample deviation of the fit's own rows.
    Rows with a null feature, label or offset are left out.
    """
    width = len(features)
    rows = df.select(F.array(*(F.col(f).cast("double") for f in features)).cast("array<double>").alias("x"), F.col(label).cast("double").alias("y"), F.col(offset).cast("double").alias("o"), (F.col(fold).cast("long") if fold else F.lit(0).cast("long")).alias("fold"))
    rows = cut(rows.where("y is not null and o is not null and fold is not null and not exists(x, v -> v is null or isnan(v))"))
    moments = [F.count("*").alias("n"), *(f(F.get("x", F.lit(i))).alias(f"{k}{i}") for i in range(width) for k, f in (("s", F.sum), ("q", lambda c: F.sum(c * c))))]
    by = {r["fold"]: r for r in rows.groupBy("fold").agg(*moments).collect()}  # one row a fold
    fits, spread = [], {}
    for k in [None, *(sorted(by) if fold else [])]:
        own = [r for f, r in by.items() if f != k]  # the sums of a fit are those of all rows less those of its fold
        n = sum(r.n for r in own)
        s, q = (np.array([sum(r[f"{c}{i}"] for r in own) for i in range(width)], float) for c in "sq")
        mean = s / n if standardize and n else np.zeros(width)
        var = np.maximum(q - n * mean * mean, 0) / max(n - 1, 1)
        spread[k] = (mean, np.where(var > 1e-24, np.sqrt(var), 1.0) if standardize else np.ones(width))
        fits.append(k)
    coef = {k: np.zeros(width + 1) for k in fits}
    open_, done, size = list(fits), {}, {}
    for step in range(1, STEPS + 1):
        for k, v in zip(open_, _sums(rows, width, [(k, *spread[k], coef[k]) for k in open_])):
            p, n = width + 1, v[-1]
            grad, fisher = v[:p] - alpha * n * coef[k], v[p:-1].reshape(p, p)
            d = np.sqrt(np.maximum(np.diag(fisher), 1e-300))
            condition = float(np.linalg.cond(fisher / np.outer(d, d)))
            if not alpha and condition > 1e12:
                raise ValueError(f"features {features} can't be told apart: the condition number is {condition:.1e}")
            move = np.linalg.solve(fisher + alpha * n * np.eye(p), grad)
            move *= min(1.0, 3.0 / max(np.abs(move).max(), 1e-300))  # a step of e**3 at most, from a start at zero
            coef[k] = coef[k] + move
            size[k] = np.abs(move).max()
            done[k] = Fit(list(features), *spread[k], coef[k], None if alpha else np.linalg.inv(fisher), condition, int(n), step)
        open_ = [k for k in open_ if size[k] > SETTLED]
        if not open_:
            return done
    raise ArithmeticError(f"{len(open_)} fits did not settle in {STEPS} steps")


def over_folds(fits: dict[int | None, Fit], fold: str, of) -> Column:
    """of(fit) for each row, by the fit that left out its fold; null for a fold without one."""
    out = F.lit(None).cast("double")
    for k, fit in fits.items():
        if k is not None:
            out = F.when(F.col(fold) == k, of(fit)).otherwise(out)
    return out


def residual(df: DataFrame, base: Fit, offset: str, features: list[str], label: str, alpha: float = 0.0, standardize: bool = False) -> Fit:
    """A correction on top of the base fit's own rate, which becomes the offset: what `features` explain of what it leaves over.

    Its eta takes the base's eta as offset.
    """
    return poisson(df.withColumn("_base", base.eta(offset)), features, label, "_base", alpha, standardize)[None]


def crossfit_arms(df: DataFrame, seasonal: list[str], fast: list[str], label: str, offset: str, fold: str, alphas: tuple[float, float] = (0.0, 0.1)) -> DataFrame:
    """df with out-of-fold rates: lam_offset (intercept only), lam_seasonal, lam_full (a residual fit of `fast` on top of it).

    The fits of the first two arms share every pass. A residual fit takes the base fit of its own fold as offset of the rows that train it.
    """
    only = poisson(df, [], label, offset, fold=fold)
    base = poisson(df, seasonal, label, offset, alphas[0], alphas[0] > 0, fold)
    folds = [k for k in base if k is not None]
    full = {k: residual(df.where(F.col(fold) != k), base[k], offset, fast, label, alphas[1], alphas[1] > 0) for k in folds}
    eta = F.lit(None).cast("double")
    for k in folds:
        eta = F.when(F.col(fold) == k, full[k].eta(base[k].eta(offset))).otherwise(eta)
    lam = {"lam_offset": over_folds(only, fold, lambda f: f.eta(offset)), "lam_seasonal": over_folds(base, fold, lambda f: f.eta(offset)), "lam_full": eta}
    return df.withColumns({n: F.exp(v) for n, v in lam.items()})


def effort_exponent(df: DataFrame, features: list[str], label: str, effort: str) -> Fit:
    """The fit in which the log of the effort is a free term, the last, instead of an offset of weight one; no penalty, so it has intervals."""
    return poisson(df.withColumn("_none", F.lit(0.0)), [*features, effort], label, "_none")[None]


def identifiability(df: DataFrame, spark, features: list[str], label: str, effort: str) -> DataFrame:
    """The effort's exponent with and without the other features, its interval, and the condition number of each fit: one row a fit."""
    out = []
    for name, columns in (("alone", []), ("with features", features)):
        fit = effort_exponent(df, columns, label, effort)
        b, se = float(fit.coef[-1]), float(np.sqrt(fit.covariance[-1, -1]))
        out.append((name, b, b - Z95 * se, b + Z95 * se, fit.condition, bool(b - Z95 * se <= 1 <= b + Z95 * se)))
    return spark.createDataFrame(out, "fit string, exponent double, low double, high double, condition double, one_inside boolean")
