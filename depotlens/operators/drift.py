"""Population stability index and drift report (X-*).

All features are handled in one pass: both frames are unpivoted to
(feature, value), bin edges come from a per-feature min/max aggregate, and
counts from one grouped aggregate over (feature, side, bin).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.numeric import py_round_cols

PSI_STABLE = 0.10
PSI_ALERT = 0.20
EPS = 1e-6


def _long(df: DataFrame, features: list[str], side: str) -> DataFrame:
    return df.select(F.lit(side).alias("side"),
                     F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"))
                                         for c in features])).alias("kv")).select("side", "kv.*")


def _binned(long: DataFrame, n_bins: int) -> DataFrame:
    """Adds ``bin``: index of the equal-width bin [edge_i, edge_i+1) with
    edge_i = i·step + lo and the last bin closed, like numpy's histogram
    (first guess from the scaled value, then one correction each way
    against the exact edges).  Built over three projections so that no
    generated method repeats the nested guesses."""
    n = float(n_bins)
    v, lo, hi = F.col("value"), F.col("lo"), F.col("hi")
    step = (hi - lo) / F.lit(n)

    def edge(i):
        return F.when(i >= n_bins, hi).otherwise(i.cast("double") * step + lo)
    s1 = long.select("*", F.least(F.floor((v - lo) * (F.lit(n) / (hi - lo))).cast("int"), F.lit(n_bins - 1))
                     .alias("_i0"))
    s2 = s1.select("*", F.when(v < edge(F.col("_i0")), F.col("_i0") - 1).otherwise(F.col("_i0")).alias("_i1"))
    i1 = F.col("_i1")
    s3 = s2.select("*", F.when(hi == lo, F.lit(n_bins - 1))
                   .when((i1 != n_bins - 1) & (v >= edge(i1 + 1)), i1 + 1).otherwise(i1).alias("bin"))
    return s3.drop("_i0", "_i1")


def psi(baseline: DataFrame, current: DataFrame, features: list[str], n_bins: int = 10) -> DataFrame:
    """X-1: per feature PSI over 10 equal-width bins of the joint min/max;
    shares over all rows (nulls count in the denominator), floored at 1e-6;
    Σ (c − b)·ln(c/b), rounded to 4.  Features missing from either frame
    are skipped.

    Two passes over the data: one aggregate for every feature's joint
    min/max (a scalar struct subquery), then one pass that unpivots the
    (feature, value) pairs, bins them and counts them with a partial/final
    aggregate."""
    feats = [f for f in features if f in baseline.columns and f in current.columns]
    both = baseline.select(F.lit("base").alias("side"), *[F.col(f).cast("double").alias(f) for f in feats]) \
        .unionByName(current.select(F.lit("curr").alias("side"), *[F.col(f).cast("double").alias(f) for f in feats]))
    b = both.agg(F.struct(*[F.struct(F.min(f).alias("lo"), F.max(f).alias("hi")).alias(f) for f in feats])).scalar()
    kv = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("value"), F.col(f"_b.{f}.lo").alias("lo"),
                            F.col(f"_b.{f}.hi").alias("hi")) for f in feats])
    long = both.select("*", b.alias("_b")).select("side", F.explode(kv).alias("kv")).select("side", "kv.*")
    valid = long.where(F.col("value").isNotNull() & ~F.isnan("value"))
    counted = _binned(valid, n_bins).groupBy("feature", "side", "bin").agg(F.count(F.lit(1)).alias("c"))
    totals = long.groupBy("feature", "side").agg(F.count(F.lit(1)).alias("n"))  # all rows incl. nulls
    counts = counted.checkpoint(eager=True)
    grid = totals.select("feature").distinct().select(
        "feature", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bin"))
    g = grid
    for side in ("base", "curr"):
        cnt = counts.where(F.col("side") == side).select("feature", "bin", F.col("c").alias(f"c_{side}"))
        t = totals.where(F.col("side") == side).select("feature", F.col("n").alias(f"n_{side}"))
        g = g.join(cnt, ["feature", "bin"], "left").join(t, "feature", "left")
    bb = F.greatest(F.coalesce(F.col("c_base"), F.lit(0)) / F.greatest(F.coalesce("n_base", F.lit(0)), F.lit(1)),
                    F.lit(EPS))
    cc = F.greatest(F.coalesce(F.col("c_curr"), F.lit(0)) / F.greatest(F.coalesce("n_curr", F.lit(0)), F.lit(1)),
                    F.lit(EPS))
    raw = g.groupBy("feature").agg(F.sum((cc - bb) * F.log(cc / bb)).alias("_psi"))
    return py_round_cols(raw, {"psi": ("_psi", 4)}).select("feature", "psi")


def drift_report(baseline: DataFrame, current: DataFrame, features: list[str]) -> DataFrame:
    """X-2: psi and status per feature (≥ 0.20 drift_alert, ≥ 0.10
    slight_drift, else stable) with the run-level needs_retraining flag and
    count of drifted features on every row."""
    p = psi(baseline, current, features)
    status = (F.when(F.col("psi") >= PSI_ALERT, "drift_alert").when(F.col("psi") >= PSI_STABLE, "slight_drift")
              .otherwise("stable"))
    p = p.withColumn("status", status)
    alert = F.col("status") == "drift_alert"
    return p.select("*", p.agg(F.coalesce(F.bool_or(alert), F.lit(False))).scalar().alias("needs_retraining"),
                    p.agg(F.count_if(alert)).scalar().alias("n_features_drifted"))
