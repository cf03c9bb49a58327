"""Ridge over a trailing window, refitted at every rebalance, from one pass over the samples.

A sample of session d, whose label is realised at session t, may train the fits of sessions t + 1 to
d + window. So its outer product enters the normal equations at t + 1 and leaves at d + window + 1: summed
per session, and summed up along the sessions, these give the equations of all windows at once. What is
summed along the sessions is one small matrix a session; nothing is fitted sample by sample.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _corner(p: int):
    return np.triu_indices(p)


def _events(columns: int):
    """Sums of outer products per session at which samples enter (positive) or leave (negative)."""
    at = _corner(columns)

    def run(batches):
        for b in batches:
            z = np.column_stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(2, 2 + columns)]).astype(np.float64)
            for k, sign in ((0, 1.0), (1, -1.0)):
                sessions, place = np.unique(b.column(k).to_numpy(), return_inverse=True)
                order = np.argsort(place, kind="stable")
                cuts = np.searchsorted(place[order], np.arange(len(sessions) + 1))
                sums = [(sign * (z[order[i:j]].T @ z[order[i:j]]))[at] for i, j in zip(cuts, cuts[1:])]
                if sums:
                    yield pa.RecordBatch.from_arrays([pa.array(sessions.astype(np.int32)), pa.array([s.tolist() for s in sums], pa.list_(pa.float64()))], ["ordinal", "cells"])

    return run


def _solve(columns: int, alpha: float):
    """Intercept and weights of one row of summed cells; columns are scaled to unit deviation for the penalty."""
    at, p = _corner(columns), columns - 2

    def run(batches):
        for b in batches:
            out = []
            for cells in b.column(1).to_pylist():
                g = np.zeros((columns, columns))
                g[at] = cells
                g = g + np.triu(g, 1).T
                n = round(g[0, 0])
                if n <= 0:
                    out.append((0, None, None))
                    continue
                mean = g[0, 1:] / n
                cov = g[1:, 1:] - n * np.outer(mean, mean)
                sd = np.sqrt(np.maximum(np.diag(cov)[:p], 0) / n)
                sd[sd <= 1e-9 * (np.abs(mean[:p]) + 1e-300)] = 1.0  # constant within the window
                w = np.linalg.solve(cov[:p, :p] / np.outer(sd, sd) + alpha * np.eye(p), cov[:p, p] / sd) / sd
                out.append((n, float(mean[p] - w @ mean[:p]), w.tolist()))
            rows, intercept, weights = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(rows, pa.int64()), pa.array(intercept, pa.float64()), pa.array(weights, pa.list_(pa.float64()))], ["ordinal", "rows", "intercept", "weights"]
            )

    return run


def window_coefficients(
    samples: DataFrame, features: list[str], sessions: DataFrame, window: int, step: int, alpha: float = 1.0, label: str = "label"
) -> DataFrame:
    """(trade_date, ordinal, rows, intercept, weights) for the signal sessions ``window``, ``window + step``...

    A fit sees samples of the last ``window`` sessions before the signal whose label is realised
    before it. ``sessions`` numbers the panel's sessions from 0; samples with a missing feature or label do
    not train. A session without mature samples has null weights.
    """
    if window < 1 or step < 1:
        raise ValueError("window and step must be positive")
    days = F.broadcast(sessions.select("trade_date", F.col("ordinal").cast("int").alias("_d")))  # one row per session
    target = F.broadcast(sessions.select(F.col("trade_date").alias("label_target_date"), F.col("ordinal").cast("int").alias("_t")))
    z = [F.lit(1.0), *[F.col(c).cast("double") for c in [*features, label]]]
    mature = samples.na.drop(subset=[*features, label]).join(days, "trade_date").join(target, "label_target_date")
    rows = mature.select((F.col("_t") + 1).alias("enter"), (F.col("_d") + window + 1).alias("leave"), *[c.alias(f"z{i}") for i, c in enumerate(z)]).where("enter < leave")
    cells = rows.mapInArrow(_events(len(z)), "ordinal int, cells array<double>").select("ordinal", F.posexplode("cells").alias("cell", "v"))
    signals = sessions.where((F.col("ordinal") >= window) & ((F.col("ordinal") - window) % step == 0)).select(F.col("ordinal").cast("int").alias("ordinal"))
    width = len(z) * (len(z) + 1) // 2
    asked = signals.select("ordinal", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("cell"), F.lit(0.0).alias("v"), F.lit(1).alias("asked"))
    both = cells.withColumn("asked", F.lit(0)).unionByName(asked)
    per = both.groupBy("cell", "ordinal").agg(F.sum("v").alias("v"), F.max("asked").alias("asked"))
    upto = Window.partitionBy("cell").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)  # one row per session
    summed = per.withColumn("v", F.sum("v").over(upto)).where("asked = 1")
    equations = summed.groupBy("ordinal").agg(F.sort_array(F.collect_list(F.struct("cell", "v"))).alias("c")).select("ordinal", F.col("c.v").alias("cells"))
    solved = equations.mapInArrow(_solve(len(z), alpha), "ordinal int, rows long, intercept double, weights array<double>")
    return solved.join(F.broadcast(sessions.select(F.col("ordinal").cast("int").alias("ordinal"), "trade_date")), "ordinal")


def walk_forward_scores(panel: DataFrame, coefficients: DataFrame, features: list[str]) -> DataFrame:
    """Scores of the panel's rows on the signal sessions; a row with a missing feature has none."""
    fits = F.broadcast(coefficients.where("weights IS NOT NULL").select("trade_date", "intercept", "weights"))  # one row per signal session
    score = F.col("intercept")
    for i, c in enumerate(features):
        score = score + F.get("weights", F.lit(i)) * F.col(c)
    return panel.na.drop(subset=features).join(fits, "trade_date").select("ts_code", "trade_date", score.alias("score"))
