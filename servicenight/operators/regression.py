"""Least squares from distributed moments.

Sums of products are ordinary aggregates, combined on the map side; Python only solves the one
p-by-p system that is left (p is the number of design columns), whatever the number of rows.

A design is a constant followed by terms: the name of a numeric column, or a pair of a
column and its levels, which becomes 0/1 columns for every level but the first.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from servicenight.session import materialize, travels

travels(__name__)

NORMAL_975 = 1.959963984540054

Term = str | tuple[str, list]


def design_names(terms: list[Term]) -> list[str]:
    names = ["const"]
    for term in terms:
        names += [term] if isinstance(term, str) else [f"{term[0]}={level}" for level in term[1][1:]]
    return names


def design_columns(terms: list[Term]) -> list[Column]:
    columns = [F.lit(1.0)]
    for term in terms:
        if isinstance(term, str):
            columns.append(F.col(term).cast("double"))
        else:
            columns += [(F.col(term[0]) == F.lit(level)).cast("double") for level in term[1][1:]]
    return columns


def complete_rows(df: DataFrame, terms: list[Term], y: str) -> DataFrame:
    """(x: array of design columns, y) of rows without gaps, stored as both passes read them."""
    used = [term if isinstance(term, str) else term[0] for term in terms]
    whole = df.select(*used, F.col(y).cast("double").alias("y")).dropna()
    return materialize(whole.select(F.array(*design_columns(terms)).alias("x"), "y"))


def moments(rows: DataFrame, p: int, weight: Column | None = None) -> list[Column]:
    """Sums of x_i * x_j over i <= j, each row times ``weight``."""
    x = F.col("x")
    factor = F.lit(1.0) if weight is None else weight
    return [F.sum(x[i] * x[j] * factor) for i in range(p) for j in range(i, p)]


def _square(upper: np.ndarray, p: int) -> np.ndarray:
    full = np.zeros((p, p))
    full[np.triu_indices(p)] = upper
    return full + np.triu(full, 1).T


def solve(rows: DataFrame, terms: list[Term]) -> DataFrame:
    """One row: coefficients, inverse of X'X, row count and mean of y."""
    p = len(design_names(terms))
    cross = [F.sum(F.col("x")[i] * F.col("y")) for i in range(p)]
    sums = rows.agg(F.array(*moments(rows, p)).alias("xx"), F.array(*cross).alias("xy"),
                    F.count("y").alias("n"), F.coalesce(F.avg("y"), F.lit(0.0)).alias("mean_y"))

    def finish(batches):
        for batch in batches:
            for row in batch.itertuples():
                empty = row.n == 0
                xx = np.zeros((p, p)) if empty else _square(np.asarray(row.xx, dtype=float), p)
                xy = np.zeros(p) if empty else np.asarray(row.xy, dtype=float)
                beta = np.linalg.lstsq(xx, xy, rcond=None)[0]
                yield pd.DataFrame({"beta": [beta.tolist()], "inverse": [np.linalg.pinv(xx).ravel().tolist()],
                                    "n": [int(row.n)], "mean_y": [row.mean_y]})

    return sums.mapInPandas(finish, "beta array<double>, inverse array<double>, n bigint, mean_y double")


def residual(p: int, beta: Column) -> Column:
    fitted = F.lit(0.0)
    for i in range(p):
        fitted = fitted + F.col("x")[i] * beta[i]
    return F.col("y") - fitted


def robust_fit(df: DataFrame, terms: list[Term], y: str) -> DataFrame:
    """Coefficients with heteroscedasticity-robust (HC1) standard errors, one row per column."""
    rows, names = complete_rows(df, terms, y), design_names(terms)
    p = len(names)
    solution = materialize(solve(rows, terms))
    scored = rows.withColumn("_beta", solution.select("beta").scalar()).withColumn("_e", residual(p, F.col("_beta")))
    meat = scored.agg(F.array(*moments(scored, p, F.col("_e") * F.col("_e"))).alias("meat"))
    whole = meat.withColumn("_s", solution.select(F.struct("beta", "inverse", "n")).scalar()).select("meat", "_s.*")

    def sandwich(batches):
        for batch in batches:
            for row in batch.itertuples():
                n, beta = int(row.n), np.asarray(row.beta, dtype=float)
                if not n:
                    continue
                inverse = np.asarray(row.inverse, dtype=float).reshape(p, p)
                used = int((np.diag(inverse) != 0).sum())     # levels that never occur take no freedom
                meat_ = _square(np.asarray(row.meat, dtype=float), p)
                error = np.sqrt(np.diag(inverse @ meat_ @ inverse * n / (n - used)))
                yield pd.DataFrame({"term": names, "n": n, "coefficient": beta, "std_error": error,
                                    "low": beta - NORMAL_975 * error, "high": beta + NORMAL_975 * error})

    return whole.mapInPandas(
        sandwich, "term string, n bigint, coefficient double, std_error double, low double, high double")


def r_squared(df: DataFrame, terms: list[Term], y: str) -> DataFrame:
    """One row: R², row count and coefficients of an ordinary fit; rows with gaps are left out."""
    rows = complete_rows(df, terms, y)
    solution = materialize(solve(rows, terms))
    scored = rows.withColumn("_s", solution.select(F.struct("beta", "mean_y")).scalar())
    scored = scored.withColumn("_e", residual(len(design_names(terms)), F.col("_s.beta")))
    centred = F.col("y") - F.col("_s.mean_y")
    sums = scored.agg((1 - F.sum(F.col("_e") * F.col("_e")) / F.sum(centred * centred)).alias("r2"))
    return sums.withColumn("_s", solution.select(F.struct("n", "beta")).scalar()).select("r2", "_s.*")


def log_trend(nights: DataFrame, column: str, season: str, weekdays: list[str]) -> DataFrame:
    """Trend per year of a nightly measure, net of weekday and season, with a 95% interval.

    ``season`` is 'month' or 'temperature' (the day's high with its square).
    """
    rows = nights.where(F.col(column) > 0).select(
        F.log(F.col(column).cast("double")).alias("_y"), "day_name", "month_of_year", "years",
        "temp_high_f", (F.col("temp_high_f") * F.col("temp_high_f")).alias("temp_squared"))
    seasonal: list[Term] = ([("month_of_year", list(range(1, 13)))] if season == "month"
                            else ["temp_high_f", "temp_squared"])
    fit = robust_fit(rows, [("day_name", sorted(weekdays)), *seasonal, "years"], "_y")
    pct = lambda c: (F.exp(c) - 1).alias(f"{c}_pct")
    return fit.where("term = 'years'").select(
        F.lit(column).alias("measure"), F.lit(season).alias("season"), "n",
        pct("coefficient"), pct("low"), pct("high"))


TIME_TERMS = {"time": ["week"], "temperature": ["temp_high_f"], "both": ["week", "temp_high_f"]}


def season_or_decline(nights: DataFrame, weekdays: list[str]) -> DataFrame:
    """R² of revenue on weekday plus time, temperature, or both, with the slope per week."""
    first = nights.agg(F.min("service_date")).scalar()
    rows = materialize(nights.select(
        "service_dow", "revenue", "temp_high_f",
        (F.datediff(F.col("service_date"), first) / F.lit(7.0)).alias("week")))   # three fits read it
    out = None
    for design, numeric in TIME_TERMS.items():
        terms: list[Term] = [("service_dow", sorted(weekdays)), *numeric]
        slope = (F.col("beta")[design_names(terms).index("week")] if "week" in numeric
                 else F.lit(None).cast("double"))
        fit = r_squared(rows, terms, "revenue").select(
            F.lit(design).alias("design"), "n", "r2", slope.alias("per_week"))
        out = fit if out is None else out.unionByName(fit)
    return out
