"""Peer groups: role moments, Mahalanobis distance, calibrated peer score."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..config import EngineConfig
from ..functions.expressions import excess_score
from ..session import materialize
from .lookup import attach
from .stats import group_moments, robust_baseline


def inverse_with_ridge(cov: Column, ridge: float) -> Column:
    """Inverse of (cov + ridge I) for row-major square matrices, one small matrix per group."""

    @F.pandas_udf("array<double>")
    def invert(flat: pd.Series) -> pd.Series:
        def one(values):
            d = int(round(len(values) ** 0.5))
            return np.linalg.inv(np.asarray(values, float).reshape(d, d) + ridge * np.eye(d)).ravel()

        return flat.map(one)

    return invert(cov)


def with_mahalanobis(df: DataFrame, columns: Sequence[str], out: str) -> DataFrame:
    """Adds sqrt(d' S d) for rows that carry `mean` and the row-major symmetric `cov_inv`.

    Three short projections (differences, one weighted sum per feature, total) in place of one
    expression of 55 products, which would outgrow what the JVM compiles.
    """
    d = len(columns)
    diff = {f"_d{i}": F.col(c) - F.get("mean", F.lit(i)) for i, c in enumerate(columns)}
    part = {}
    for i in range(d):
        own = F.col(f"_d{i}") * F.get("cov_inv", F.lit(d * i + i))
        cross = [F.col(f"_d{j}") * (F.lit(2.0) * F.get("cov_inv", F.lit(d * i + j))) for j in range(i + 1, d)]
        part[f"_q{i}"] = F.col(f"_d{i}") * reduce(add, cross, own)
    total = reduce(add, [F.col(q) for q in part])
    return (df.withColumns(diff).withColumns(part)
            .withColumn(out, F.when(F.col("mean").isNotNull(), F.sqrt(F.greatest(total, F.lit(0.0)))))
            .drop(*diff, *part))


def role_moments(train: DataFrame, columns: Sequence[str], cfg: EngineConfig,
                 keep=lambda df, label: df) -> DataFrame:
    """role, n, mean, std, cov_inv, population_std. A role with fewer than two training rows
    has no covariance of its own and takes the whole population's."""
    whole = train.agg(*[F.avg(c) for c in columns], *[F.stddev_pop(c) for c in columns]).first()
    means, everyone = whole[:len(columns)], whole[len(columns):]
    roles = keep(group_moments(train.where(F.col("role").isNotNull()), columns, ["role"], means), "moments")

    def numbers(values) -> Column:
        return F.array(*[F.lit(float(v or 0.0)) for v in values])

    if roles.where("n < 2").limit(1).count():
        whole = group_moments(train, columns).first()
        if whole["n"] > 1:
            roles = roles.withColumn("cov", F.when(F.col("n") > 1, F.col("cov")).otherwise(numbers(whole["cov"])))
    return roles.where(F.get("cov", F.lit(0)).isNotNull()).select(
        "role", "n", "mean", "std", inverse_with_ridge(F.col("cov"), cfg.ridge).alias("cov_inv"),
        numbers(everyone).alias("population_std"))


def with_distance(df: DataFrame, columns: Sequence[str], roles: DataFrame, written: bool = False) -> DataFrame:
    """Adds `peer_distance`; sessions of unseen roles get NULL."""
    rows = attach(df, roles.select("role", "mean", "cov_inv"), ["role"], written=written)
    return with_mahalanobis(rows, columns, "peer_distance").drop("mean", "cov_inv")


def fit_peers(train: DataFrame, columns: Sequence[str], cfg: EngineConfig, keep=lambda df, label: df) -> DataFrame:
    """The role model table. `keep` writes intermediate tables that several jobs read."""
    roles = keep(role_moments(train, columns, cfg, keep), "role-moments")
    distances = keep(with_distance(train, columns, roles, written=keep is materialize).select("role", "peer_distance"), "distances")
    fit = robust_baseline(distances.where(F.col("role").isNotNull()), F.col("peer_distance"), ["role"])
    return roles.join(fit.select("role", "baseline", "scale"), "role")


def peer_score(df: DataFrame, columns: Sequence[str], model: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Adds `peer_distance` and `peer_group_score` by a written model table."""
    rows = attach(df, model.select("role", "mean", "cov_inv", "baseline", "scale"), ["role"], written=True)
    scored = with_mahalanobis(rows, columns, "peer_distance").drop("mean", "cov_inv")
    score = excess_score(F.col("peer_distance"), F.col("baseline"), F.col("scale"), cfg.peer_k)
    score = F.when(F.col("peer_distance").isNotNull(), score)
    return scored.withColumn("peer_group_score", score).drop("baseline", "scale")
