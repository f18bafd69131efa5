"""Why a session scored high: weighted, compressed deviation of each feature from its role."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import DataFrame, functions as F

from ..config import EngineConfig
from ..functions.expressions import compress_z
from .lookup import attach


def explain(df: DataFrame, columns: Sequence[str], model: DataFrame, cfg: EngineConfig,
            count: int | None = None, written: bool = False) -> DataFrame:
    """Adds `top_features`: the strongest features with their share of the weighted deviation.

    Shares of all features sum to 100 (or are all 0); equal shares keep feature order.
    Sessions of unseen roles get NULL. The steps are separate short projections over plain
    columns; only the chosen few pass through an array function.
    """
    places = range(len(columns))
    rows = attach(df, model.select("role", "mean", "std", "population_std"), ["role"], written=written)
    zs, pulls = {}, {}
    for i in places:
        floor = F.greatest(F.lit(cfg.std_floor_fraction) * F.get("population_std", F.lit(i)), F.lit(1e-9))
        zs[f"_z{i}"] = (F.col(columns[i]) - F.get("mean", F.lit(i))) / F.greatest(F.get("std", F.lit(i)), floor)
        pulls[f"_p{i}"] = F.abs(compress_z(F.col(f"_z{i}"), cfg.z_cap)) * F.lit(cfg.weights[i])
    rows = rows.withColumns(zs).withColumns(pulls)
    rows = rows.withColumn("_total", reduce(add, [F.col(p) for p in pulls]))
    rows = rows.withColumn("_whole", F.when(F.col("_total") == 0, F.lit(1.0)).otherwise(F.col("_total")))
    cells = [F.struct((-(F.col(f"_p{i}") / F.col("_whole") * 100)).alias("order"), F.lit(i).alias("place"),
                      F.col(f"_z{i}").alias("z")) for i in places]
    rows = rows.withColumn("_ranked", F.slice(F.sort_array(F.array(*cells)), 1, count or cfg.top_features))
    names = F.array(*[F.lit(c) for c in columns])
    top = F.transform("_ranked", lambda x: F.struct(
        F.get(names, x["place"]).alias("feature"),
        F.bround(-x["order"], 1).alias("pct_contribution"),
        (F.bround(x["z"], 2) + F.lit(0.0)).alias("z_score"),  # never -0
        (F.abs(x["z"]) > cfg.z_cap).alias("z_capped_for_display"),
        F.when(x["z"] > 0, F.lit("above peer norm")).otherwise(F.lit("below peer norm")).alias("direction")))
    return (rows.withColumn("top_features", F.when(F.col("mean").isNotNull(), top))
            .drop("mean", "std", "population_std", "_total", "_whole", "_ranked", *zs, *pulls))
