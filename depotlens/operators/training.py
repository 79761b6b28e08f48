"""Training support: splits, folds, synthetic batches, metrics, registry
and Spark ML models (M-*, D-12, E-13).

The reference's booster and forest libraries are not used; Spark ML's
GBTRegressor and RandomForestClassifier train distributed.  Their scores
differ from the reference's models, so only contract properties (ranges,
clipping, gates, metric formulas) are comparable.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .ranking import histogram, rank_within

# FIXED VALUES: walk-forward folds (train_start, train_end, test_start, test_end) and holdout.
FOLDS = [
    ("2013-01-01", "2013-12-31", "2014-01-01", "2014-03-31"),
    ("2013-01-01", "2014-03-31", "2014-04-01", "2014-06-30"),
    ("2013-01-01", "2014-06-30", "2014-07-01", "2014-09-30"),
    ("2013-01-01", "2014-09-30", "2014-10-01", "2014-12-31"),
]
HOLDOUT = ("2013-01-01", "2014-12-31", "2015-01-01", "2015-07-31")
SHELF_LIFE = 365
# FIXED VALUES: drug-code prefix -> category (default pain_relief).
CATEGORY_MAP = {
    "M01AB": "pain_relief", "M01AE": "pain_relief",
    "N02BA": "pain_relief", "N02BE": "pain_relief",
    "N05B": "vitamin", "N05C": "vitamin",
    "R03": "respiratory", "R06": "respiratory",
}


def chronological_split(df: DataFrame, frac: float = 0.8, date_col: str = "date") -> DataFrame:
    """M-1: cut at the 80 % quantile of the date (linear interpolation,
    over day numbers – a bounded calendar domain); rows strictly before the
    cut are ``train``, the rest ``test``."""
    cut = df.agg(F.percentile(F.unix_date(F.col(date_col)).cast("double"), frac)).scalar()
    return df.withColumn("split", F.when(F.unix_date(F.col(date_col)) < cut, "train").otherwise("test"))


def quarterly_folds(end_date: str) -> list[tuple[str, str, str, str]]:
    """The reference's fold layout (4 quarterly test windows, then a
    7-month holdout ending at ``end_date``) placed by rule on another
    calendar: the holdout test starts 7 months before the month after
    ``end_date``; each fold's test is the quarter before the next."""
    import datetime as dt

    def add_months(d, m):
        y, mo = divmod(d.month - 1 + m, 12)
        return dt.date(d.year + y, mo + 1, 1)
    e = dt.date.fromisoformat(end_date)
    ho_start = add_months(dt.date(e.year, e.month, 1), -6)
    start = add_months(ho_start, -24)
    folds = []
    for i in range(4):
        te_s = add_months(ho_start, -12 + 3 * i)
        te_e = add_months(te_s, 3) - dt.timedelta(days=1)
        folds.append((start.isoformat(), (te_s - dt.timedelta(days=1)).isoformat(), te_s.isoformat(),
                      te_e.isoformat()))
    holdout = (start.isoformat(), (ho_start - dt.timedelta(days=1)).isoformat(), ho_start.isoformat(), e.isoformat())
    return folds + [holdout]


def walk_forward_folds(df: DataFrame, folds=None, date_col: str = "date",
                       supplementary: F.Column | None = None) -> DataFrame:
    """M-2: (fold, role) per row for 4 date folds + holdout (fold 0 =
    holdout); supplementary rows (``supplementary`` true) are always train
    and never test.  The fold table is a literal array, exploded per row."""
    folds = folds or (FOLDS + [HOLDOUT])
    arr = F.array(*[F.struct(F.lit(i + 1 if i < len(folds) - 1 else 0).alias("fold"),
                             F.lit(a).cast("date").alias("tr_s"), F.lit(b).cast("date").alias("tr_e"),
                             F.lit(c).cast("date").alias("te_s"), F.lit(d).cast("date").alias("te_e"))
                    for i, (a, b, c, d) in enumerate(folds)])
    sup = supplementary if supplementary is not None else F.lit(False)
    x = df.select("*", sup.alias("_sup"), F.explode(arr).alias("_f"))
    d = F.col(date_col)
    role = (F.when(F.col("_sup"), "train")
            .when((d >= F.col("_f.tr_s")) & (d <= F.col("_f.tr_e")), "train")
            .when((d >= F.col("_f.te_s")) & (d <= F.col("_f.te_e")), "test"))
    return x.select(*df.columns, F.col("_f.fold").alias("fold"), role.alias("role")).where(F.col("role").isNotNull())


def synthesise_batches(daily: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M-3 from daily sales (date, product_id, units_sold): per product ×
    month sold = Σ; received = max(75th percentile of the product's monthly
    sums, 1); remaining = max(received − sold, 0); expiry = month start +
    365 d; an OUT movement 15 days into the month when sold > 0; category
    from the code prefix.  The percentile runs over a product's months (a
    calendar-bounded group)."""
    m = daily.groupBy("product_id", F.trunc("date", "MM").alias("month")).agg(F.sum("units_sold").alias("sold"))
    q = m.groupBy("product_id").agg(F.greatest(F.percentile("sold", 0.75), F.lit(1.0)).alias("received"))
    j = m.join(q, "product_id")
    cmap = F.create_map(*[x for k, v in CATEGORY_MAP.items() for x in (F.lit(k), F.lit(v))])
    cat = F.coalesce(cmap[F.substring("product_id", 1, 5)], F.lit("pain_relief"))
    bid = F.concat(F.col("product_id"), F.lit("_"), F.date_format("month", "yyyy-MM"))
    batches = j.select(bid.alias("batch_id"), "product_id", F.lit("pharma_global").alias("depot_id"),
                       F.date_add("month", SHELF_LIFE).alias("expiry_date"),
                       F.col("received").alias("quantity_received"),
                       F.greatest(F.col("received") - F.col("sold"), F.lit(0.0)).alias("quantity_remaining"),
                       cat.alias("product_category"), (cat == "cold_chain").alias("is_cold_chain"),
                       F.lit(float(SHELF_LIFE)).alias("default_shelf_life_days"),
                       F.col("month").cast("timestamp").alias("created_at"))
    moves = j.where(F.col("sold") > 0).select(bid.alias("batch_id"), F.col("sold").alias("quantity"),
                                              F.lit("OUT").alias("movement_type"),
                                              F.date_add("month", 15).cast("timestamp").alias("created_at"))
    return batches, moves


def time_series_folds(df: DataFrame, order: list[str], k: int = 5) -> DataFrame:
    """M-6 (ordered split): rows numbered in time order (skew-safe rank);
    test size n // (k+1); fold i tests positions [n − (k−i)·t, n − (k−i−1)·t)
    and trains on everything before.  Output per row: ``test_fold`` (or
    null) and ``first_train_fold`` (first fold using it for training)."""
    pos = rank_within(df.withColumn("_all", F.lit(0)), ["_all"], order, name="_pos").drop("_all")
    n = df.agg(F.count(F.lit(1))).scalar()
    t = F.floor(n / F.lit(k + 1))
    p0 = F.col("_pos") - 1
    first_test_start = n - F.lit(k) * t
    test_fold = F.when(p0 >= first_test_start, F.floor((p0 - first_test_start) / t)).cast("int")
    first_train = F.when(p0 < first_test_start, F.lit(0)).otherwise(test_fold + 1).cast("int")
    return pos.select(*df.columns, "_pos", test_fold.alias("test_fold"),
                      F.when(first_train < k, first_train).alias("first_train_fold"))


def stratified_folds(df: DataFrame, label: str, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """M-6 (shuffled stratified): within each label, rows ordered by a seeded
    hash of the key and dealt round-robin into k folds (skew-safe rank: a
    label is half of all rows)."""
    h = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    r = rank_within(df.withColumn("_h", h), [label], ["_h", key], name="_r")
    return r.withColumn("fold", ((F.col("_r") - 1) % k).cast("int")).drop("_h", "_r")


def mape(pred: DataFrame, y: str = "y", p: str = "prediction") -> DataFrame:
    """M-7: mean |y − p| / y over rows with y > 0."""
    return pred.where(F.col(y) > 0).agg(F.avg(F.abs(F.col(y) - F.col(p)) / F.col(y)).alias("mape"))


def _score_counts(scored: DataFrame, label: str, score: str) -> DataFrame:
    """Positives and negatives per distinct score, with those below it and in all."""
    s = scored.select(F.lit(0).alias("_all"), F.col(label).cast("int").alias("_y"), F.col(score).cast("double").alias("_s"))
    return histogram(s, ["_all"], "_s", {"pos": F.count_if(F.col("_y") == 1), "neg": F.count_if(F.col("_y") == 0)})


def auc(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """M-7: ROC AUC, the share of (positive, negative) pairs in which the
    positive scores higher, ties by half, from counts per distinct score."""
    h = _score_counts(scored, label, score)
    wins = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2))
    return h.agg(wins.alias("w"), F.coalesce(F.sum("pos"), F.lit(0)).alias("npos"), F.coalesce(F.sum("neg"), F.lit(0)).alias("nneg")).select(
        F.expr("w / nullif(npos * nneg, 0)").alias("auc"), "npos", "nneg")


def recall_threshold(scored: DataFrame, target: float = 0.85, label: str = "label", score: str = "score"
                     ) -> DataFrame:
    """M-7: highest score threshold whose recall (positives at score >= t, of
    all) reaches the target, else 0.5; without positives, the largest score."""
    h = _score_counts(scored, label, score)
    enough = F.col("pos_all") - F.col("pos_before") >= F.lit(float(target)) * F.col("pos_all")
    return h.agg(F.coalesce(F.max(F.when(enough, F.col("_s"))), F.lit(0.5)).alias("threshold"))


def confusion(scored: DataFrame, threshold: float, label: str = "label", score: str = "score") -> DataFrame:
    """M-7: TP, FP, TN, FN at a threshold (score ≥ threshold is positive)."""
    pos = F.col(score) >= threshold
    y = F.col(label) == 1
    return scored.agg(F.count_if(pos & y).alias("tp"), F.count_if(pos & ~y).alias("fp"),
                      F.count_if(~pos & ~y).alias("tn"), F.count_if(~pos & y).alias("fn"))


def model_versions(registry: DataFrame) -> DataFrame:
    """M-10: versions newest first per model with ``is_latest_active``: the
    newest active version of each model.  Ranking per model is a window over
    one model's versions (a small, bounded group)."""
    w = Window.partitionBy("model_name").orderBy(F.col("trained_at").desc(), F.col("version").desc())
    act = Window.partitionBy("model_name", "is_active").orderBy(F.col("trained_at").desc(), F.col("version").desc())
    r = registry.select("*", F.row_number().over(w).alias("recency"),
                        F.row_number().over(act).alias("_ar"))
    return r.withColumn("is_latest_active", F.col("is_active") & (F.col("_ar") == 1)).drop("_ar")


def rollback(registry: DataFrame, model_name: str) -> DataFrame:
    """M-10 rollback (H-7 fixed): deactivate the current version and
    activate the newest version older than it."""
    r = model_versions(registry)
    cur_t = r.where((F.col("model_name") == model_name) & F.col("is_latest_active")).agg(
        F.max("trained_at")).scalar()
    older = r.where((F.col("model_name") == model_name) & (F.col("trained_at") < cur_t))
    prev_v = older.agg(F.max_by("version", F.struct("trained_at", "version"))).scalar()
    is_m = F.col("model_name") == model_name
    return registry.withColumn("is_active", F.when(is_m, F.coalesce(F.col("version") == prev_v, F.lit(False)))
                               .otherwise(F.col("is_active")))


# ------------------------------------------------------------------ models
def train_demand(features: DataFrame, feature_cols: list[str], label: str = "units_sold", max_iter: int = 50,
                 seed: int = 42):
    """M-4: gradient-boosted trees on the demand features, validation on the
    last 20 % by date (M-1) with a low validation tolerance (the default
    stops after one tree).  Returns (model, test predictions clipped ≥ 0)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor
    split = chronological_split(features)
    data = split.withColumn("is_val", F.col("split") == "test")
    va = VectorAssembler(inputCols=feature_cols, outputCol="features", handleInvalid="keep")
    gbt = GBTRegressor(featuresCol="features", labelCol=label, maxIter=max_iter, maxDepth=6, stepSize=0.05,
                       subsamplingRate=0.8, seed=seed, validationIndicatorCol="is_val", validationTol=1e-4)
    data = data.checkpoint(eager=True)  # every boosting round re-reads it
    model = Pipeline(stages=[va, gbt]).fit(data)
    pred = model.transform(data.where("is_val")).withColumn("prediction", F.greatest(F.col("prediction"), F.lit(0.0)))
    return model, pred


def demand_forecast_model(model, features: DataFrame) -> DataFrame:
    """D-12: score every feature row, clip ≥ 0, mean per (depot, product) =
    daily rate, ×14; rounded 2/4 (slope comes from D-11 separately)."""
    from ..functions.numeric import py_round_cols
    s = model.transform(features).withColumn("prediction", F.greatest(F.col("prediction"), F.lit(0.0)))
    g = s.groupBy("depot_id", "product_id").agg(F.avg("prediction").alias("_rate"))
    g = g.withColumn("_u14", F.col("_rate") * 14)
    return py_round_cols(g, {"predicted_daily_rate": ("_rate", 4), "predicted_units_14d": ("_u14", 2)}) \
        .drop("_rate", "_u14")


def train_expiry(features: DataFrame, feature_cols: list[str], num_trees: int = 100, seed: int = 42):
    """M-5: random forest with balanced class weights n / (2·n_c) on the
    labelled batches, then isotonic calibration of the forest probability.
    Returns a (forest, calibrator) pair usable by ``score_expiry``."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import IsotonicRegression
    lab = features.where(F.col("label").isNotNull()).withColumn("label", F.col("label").cast("double"))
    counts = lab.groupBy("label").agg(F.count(F.lit(1)).alias("n_c"))
    n = lab.agg(F.count(F.lit(1))).scalar()
    # a row per class: by hash, a class would be one task's rows in every pass of the fit
    w = lab.join(F.broadcast(counts), "label").withColumn("weight", n / (2.0 * F.col("n_c"))).checkpoint(eager=True)
    va = VectorAssembler(inputCols=feature_cols, outputCol="features", handleInvalid="keep")
    rf = RandomForestClassifier(featuresCol="features", labelCol="label", weightCol="weight", numTrees=num_trees,
                                maxDepth=8, minInstancesPerNode=5, seed=seed)
    forest = Pipeline(stages=[va, rf]).fit(w)
    raw = forest.transform(w).withColumn("raw_p", vector_to_array("probability")[1])
    iso = IsotonicRegression(featuresCol="raw_p", labelCol="label", predictionCol="calibrated").fit(raw)
    return forest, iso


def score_expiry(forest, iso, features: DataFrame) -> DataFrame:
    """Calibrated P(expire unsold) per batch as a ``probability``-like
    column ``score``."""
    from pyspark.ml.functions import vector_to_array
    raw = forest.transform(features).withColumn("raw_p", vector_to_array("probability")[1])
    return iso.transform(raw).withColumnRenamed("calibrated", "score")


def ab_gate(global_model, client_features: DataFrame, feature_cols: list[str], label: str = "units_sold",
            min_rows: int = 100, max_iter: int = 20, seed: int = 42) -> dict:
    """M-8: fine-tune for one client and deploy only if it beats the global
    model on the client's last 20 % (by date).  Fine-tuning = boosting on the
    residuals of the global prediction (equivalent to continuing the global
    booster).  Fewer than ``min_rows`` feature rows keep the global model."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor
    n = client_features.count()
    if n < min_rows:
        return {"deployed": False, "reason": f"too few rows ({n})", "global_mape": None, "client_mape": None}
    data = chronological_split(client_features)
    scored = global_model.transform(data).withColumnRenamed("prediction", "g_pred") \
                         .withColumn("g_pred", F.greatest("g_pred", F.lit(0.0))).drop("features")
    scored = scored.withColumn("resid", F.col(label) - F.col("g_pred")).checkpoint(eager=True)
    va = VectorAssembler(inputCols=feature_cols, outputCol="features", handleInvalid="keep")
    train = va.transform(scored.where(F.col("split") == "train"))
    res_model = GBTRegressor(featuresCol="features", labelCol="resid", maxIter=max_iter, maxDepth=6,
                             stepSize=0.05, seed=seed).fit(train)
    val = res_model.transform(va.transform(scored.where(F.col("split") == "test")))
    val = val.withColumn("c_pred", F.greatest(F.col("g_pred") + F.col("prediction"), F.lit(0.0)))
    g = mape(val, y=label, p="g_pred").collect()[0]["mape"]
    c = mape(val, y=label, p="c_pred").collect()[0]["mape"]
    deployed = g is not None and c is not None and c < g
    return {"deployed": bool(deployed), "reason": "client beats global" if deployed else "global kept",
            "global_mape": g, "client_mape": c, "residual_model": res_model}


def onboard_client(spark, source, client_id: str, global_model, as_of: str,
                   festival_dates: list[str] | None = None) -> dict:
    """M-9: ingest (path or DataFrame) → map schema → sufficiency → demand
    fine-tuning with the A/B gate when the data allows; the expiry
    fine-tuning of the reference is a stub that never deploys."""
    from ..sources import ingest as ing
    from . import demand as dem
    raw = ing.ingest(spark, source) if isinstance(source, str) else ing.ingest_frame(source)
    mapped, warnings = ing.map_schema(raw, client_id)
    if mapped.limit(1).count() == 0:
        return {"client_id": client_id, "decision": "USE_GLOBAL_MODEL", "reason": "no_data_available",
                "demand_deployed": False, "expiry_deployed": False, "warnings": warnings}
    span = mapped.agg(F.datediff(F.max("date"), F.min("date"))).scalar()
    expired = (mapped.agg(F.count_if(F.col("expiry_date") < F.lit(as_of).cast("date"))).scalar()
               if "expiry_date" in mapped.columns else F.lit(0))
    stats = mapped.sparkSession.range(1).select(span.alias("span"), expired.alias("expired")).collect()[0]
    sp, ex = stats["span"] or 0, stats["expired"] or 0
    mode = "BOTH" if sp >= 180 and ex >= 50 else "DEMAND" if sp >= 90 else "GLOBAL"
    if mode == "GLOBAL":
        return {"client_id": client_id, "decision": "USE_GLOBAL_MODEL", "reason": f"span {sp} days",
                "demand_deployed": False, "expiry_deployed": False, "warnings": warnings}
    daily = dem.daily_from_mapped(mapped)
    feats = dem.demand_features(dem.fill_missing_dates(daily), festival_dates or [])
    gate = ab_gate(global_model, feats, dem.FEATURE_COLS)
    return {"client_id": client_id, "decision": f"SUFFICIENT_FOR_{mode}", "reason": gate["reason"],
            "demand_deployed": gate["deployed"], "expiry_deployed": False, "warnings": warnings}
