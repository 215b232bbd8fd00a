"""Classifier of opportunities: features, folds, candidates, out-of-fold metrics, synthetic positives, importances."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mercanta.operators.ranks import range_ranks
from mercanta.operators.relational import average_precision, best_per_key, surrogate_keys
from mercanta.runtime import written

NUMBERS = ["supplier_price", "estimated_market_price", "estimated_net_profit", "net_margin_pct", "total_fee_pct", "market_offer_count", "market_source_count", "price_history_count", "mercado_livre_count", "demand_score", "match_confidence"]
FLAGS = ["risk_flag_count", "has_market_price", "has_positive_margin", "has_multiple_market_sources", "has_price_history"]
FEATURES = [*NUMBERS, *FLAGS]
#: Rows a fit takes at most per class; all rows are scored and counted. None: all rows are fitted on.
FIT_ROWS: int | None = 200_000


def feature_rows(snapshots: DataFrame) -> DataFrame:
    """id, 16 features (missing values 0; the score itself isn't one), label, class and weight. NULL recommendations count as class 0."""
    numbers = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in NUMBERS]
    flags = [
        F.coalesce(F.size("risk_flags"), F.lit(0)).cast("double").alias("risk_flag_count"), (F.coalesce(F.col("estimated_market_price"), F.lit(0)) > 0).cast("double").alias("has_market_price"),
        (F.coalesce(F.col("net_margin_pct"), F.lit(0)) > 0).cast("double").alias("has_positive_margin"), (F.coalesce(F.col("market_source_count"), F.lit(0)) >= 2).cast("double").alias("has_multiple_market_sources"),
        (F.coalesce(F.col("price_history_count"), F.lit(0)) > 0).cast("double").alias("has_price_history"),
    ]
    kind = F.when(F.col("recommendation") == "comprar_teste", 2).when(F.col("recommendation") == "revisar", 1).otherwise(0)
    weight = F.when(F.col("confidence_level") == "alta", 1.0).when(F.col("confidence_level") == "media", 0.8).otherwise(0.5)
    return snapshots.select("id", *numbers, *flags, kind.alias("class"), (kind > 0).cast("double").alias("label"), weight.alias("weight"))


def class_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("class").agg(F.count("*").alias("n_rows"))


def effective_folds(positives: int, negatives: int, folds: int) -> int:
    return max(1, min(folds, positives, negatives))


def positive_weight(positives: int, negatives: int) -> float:
    return max(1.0, negatives / max(1, positives))


def _place_in_label(rows: DataFrame, seed: int) -> DataFrame:
    """Adds the place of each row among those of its label, in an order by hash (from 1), and the number of these."""
    keyed = rows.withColumn("_h", F.xxhash64(F.lit(seed), F.col("id").cast("string"))).withColumn("_one", F.lit(1).cast("long"))
    return range_ranks(keyed, ["label"], ["_h", "id"], ["_one"]).withColumnsRenamed({"cum__one": "_place", "all__one": "_rows"}).drop("_h", "_one")


def with_folds(rows: DataFrame, folds: int, seed: int = 42) -> DataFrame:
    """A fold per row, stratified: each label's rows in an order by hash are dealt out in turn. Ranges are sorted, no class in one task."""
    return _place_in_label(rows, seed).withColumn("fold", F.pmod(F.col("_place"), F.lit(folds)).cast("int")).drop("_place", "_rows")


def with_holdout(rows: DataFrame, share: float = 0.25, seed: int = 42) -> DataFrame:
    """``held`` tells the rows held out: this share of each label, rounded up."""
    return _place_in_label(rows, seed + 1).withColumn("held", F.col("_place") <= F.ceil(F.col("_rows") * share)).drop("_place", "_rows")


def training_rows(rows: DataFrame, least_rows: int = 10, least_positives: int = 1) -> DataFrame:
    """The rows to train on; too few of them, or of positives, is an error."""
    n = rows.agg(F.count("*").alias("n"), F.count_if(F.col("label") == 1).alias("p")).first()
    if n["n"] < least_rows or n["p"] < least_positives:
        raise ValueError(f"{n['n']} rows with {n['p']} positives are too few to train on")
    return rows


def candidates(seed: int = 42, trees: int = 300, rounds: tuple[int, int] = (180, 300)) -> dict[str, list]:
    """Stages of each candidate model. Boosted trees stand in, in two settings, for two libraries that aren't there."""
    imputed = [f"{c}_filled" for c in FEATURES]
    head = [Imputer(inputCols=FEATURES, outputCols=imputed, strategy="median"), VectorAssembler(inputCols=imputed, outputCol="raw")]
    scaled = [*head, StandardScaler(inputCol="raw", outputCol="features", withMean=True)]
    plain = [head[0], VectorAssembler(inputCols=imputed, outputCol="features")]
    common = {"labelCol": "label", "featuresCol": "features", "weightCol": "weight"}
    return {
        "logistic_regression": [*scaled, LogisticRegression(**common, maxIter=50)],
        "random_forest": [*plain, RandomForestClassifier(**common, numTrees=trees, maxDepth=10, minInstancesPerNode=3, seed=seed)],
        "boosted_trees": [*plain, GBTClassifier(**common, maxIter=rounds[0], maxDepth=5, stepSize=0.06, seed=seed)],
        "boosted_trees_long": [*plain, GBTClassifier(**common, maxIter=rounds[1], maxDepth=4, stepSize=0.04, subsamplingRate=0.9, seed=seed)],
    }


def bounded(rows: DataFrame, most: int | None = FIT_ROWS, seed: int = 42) -> DataFrame:
    """Rows to fit on: at most about ``most`` of each label, by hash; a documented bound on the fit only."""
    if most is None:
        return rows
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = F.lit(1.0)
    for label, n in counts.items():
        share = F.when(F.col("label") == label, F.lit(min(1.0, most / n))).otherwise(share)
    return rows.where(F.pmod(F.xxhash64(F.lit(seed + 1), F.col("id").cast("string")), F.lit(1_000_000)) < share * 1_000_000)


def synthetic_positives(positives: DataFrame, copies: int, noise: float = 0.08, weight: float = 0.30, seed: int = 42) -> DataFrame:
    """Jittered rows drawn with replacement, ``copies`` times as many as there are positives, within sensible bounds; profit and flags are worked out again, weights reduced."""
    numbered = written(surrogate_keys(positives, ["id"], "_n"), "positives")
    n = numbered.count()
    drawn = positives.sparkSession.range(1, n * copies + 1).select(F.col("id").alias("copy"), (F.pmod(F.xxhash64(F.lit(seed), F.lit("draw"), "id"), F.lit(max(1, n))) + 1).alias("_n"))
    rows = drawn.join(numbered, "_n").select(*positives.columns, "copy")
    unit = lambda name: (F.pmod(F.xxhash64(F.lit(seed), F.lit(name), F.col("id").cast("string"), F.col("copy")), F.lit(1_000_003)) + 0.5) / 1_000_003
    normal = lambda name: F.sqrt(-2 * F.ln(unit(name))) * F.cos(2 * F.pi() * unit(name + "'"))
    jitter = lambda c: F.greatest(F.lit(0.0), F.col(c) * (1 + noise * normal(c)))
    moved = {c: jitter(c) for c in ("supplier_price", "estimated_market_price", "market_offer_count", "price_history_count", "mercado_livre_count")}
    moved |= {c: F.least(F.lit(100.0), jitter(c)) for c in ("demand_score", "match_confidence")}
    rows = rows.withColumns(moved)
    profit = F.col("estimated_market_price") * (1 - F.col("total_fee_pct")) - F.col("supplier_price")
    rows = rows.withColumns({"estimated_net_profit": profit, "net_margin_pct": F.coalesce(F.try_divide(profit, F.col("estimated_market_price")), F.lit(0.0))})
    rows = rows.withColumns({"has_market_price": (F.col("estimated_market_price") > 0).cast("double"), "has_positive_margin": (F.col("net_margin_pct") > 0).cast("double"), "has_price_history": (F.col("price_history_count") > 0).cast("double"), "weight": F.col("weight") * weight})
    return rows.withColumn("id", F.concat_ws("~", F.col("id").cast("string"), "copy")).drop("copy")


def out_of_fold(rows: DataFrame, stages: Sequence, folds: int, synthetic: int = 0) -> DataFrame:
    """(id, label, score): every row scored once, by a model that hasn't seen its fold. Synthetic rows only join the fit."""
    parts = None
    for k in range(folds):
        train = bounded(rows.where(F.col("fold") != k))
        if synthetic:
            train = train.unionByName(synthetic_positives(train.where("label = 1"), synthetic))
        scored = Pipeline(stages=list(stages)).fit(train).transform(rows.where(F.col("fold") == k)).select("id", "label", vector_to_array("probability")[1].alias("score"))
        parts = scored if parts is None else parts.unionByName(scored)
    return parts


def metrics(scored: DataFrame, threshold: float = 0.5) -> dict[str, float]:
    """Accuracy, precision, recall, F1, average precision, ROC-AUC and the confusion counts of (label, score) rows."""
    p, y = F.col("score") >= threshold, F.col("label") == 1
    c = scored.agg(F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & y).alias("fn"), F.count_if(~p & ~y).alias("tn")).first()
    tp, fp, fn, tn = c["tp"], c["fp"], c["fn"], c["tn"]
    precision, recall = tp / max(1, tp + fp), tp / max(1, tp + fn)
    auc = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label").evaluate(scored.select(F.col("score").cast("double").alias("score"), "label"))
    ap = average_precision(scored, "score", "label").first()["average_precision"]
    return {"accuracy": (tp + tn) / max(1, tp + fp + fn + tn), "precision": precision, "recall": recall, "f1": 2 * precision * recall / max(1e-12, precision + recall), "average_precision": ap, "roc_auc": auc, "tp": tp, "fp": fp, "fn": fn, "tn": tn}


def select_model(measured: dict[str, dict[str, float]], synthetic_gain: float = 0.001, forced: str | None = None) -> str:
    """The variant of the greatest (average precision, F1); a ``+synthetic`` one counts only if it gains enough on its plain one."""
    allowed = {}
    for name, m in measured.items():
        base = name.removesuffix("+synthetic")
        if name != base and base in measured and m["average_precision"] - measured[base]["average_precision"] < synthetic_gain:
            continue
        if forced is None or base == forced:
            allowed[name] = m
    return max(allowed, key=lambda n: (allowed[n]["average_precision"], allowed[n]["f1"]))


def permuted_importance(model, rows: DataFrame, features: Sequence[str] = FEATURES, seed: int = 42, repeats: int = 5) -> dict[str, tuple[float, float]]:
    """Mean and deviation of the loss of average precision when one feature's values are exchanged among the rows, by hash-ordered shifts."""

    def ap(df: DataFrame) -> float:
        return average_precision(model.transform(df).select("label", vector_to_array("probability")[1].alias("score")), "score", "label").first()["average_precision"]

    base = ap(rows)
    numbered = written(surrogate_keys(rows.withColumn("_h", F.xxhash64(F.lit(seed), F.col("id").cast("string"))), ["_h", "id"], "_n").drop("_h"), "numbered")
    n = numbered.count()
    out = {}
    for i, name in enumerate(features):
        lost = []
        for r in range(repeats):
            moved = numbered.select(((F.col("_n") + (i * repeats + r + 1) * 7919) % n + 1).alias("_n"), F.col(name).alias("_v"))
            lost.append(base - ap(numbered.join(moved, "_n").withColumn(name, F.col("_v")).drop("_v")))
        mean = sum(lost) / repeats
        out[name] = (mean, (sum((x - mean) ** 2 for x in lost) / repeats) ** 0.5)
    return out


def own_importance(model, features: Sequence[str] = FEATURES) -> dict[str, float]:
    """What the model itself says of its features: size of coefficients or gain of splits."""
    last = model.stages[-1]
    values = last.featureImportances if hasattr(last, "featureImportances") else [abs(c) for c in last.coefficients]
    return {name: float(values[i]) for i, name in enumerate(features)}


def measured_candidates(rows: DataFrame, stages: dict[str, list], folds: int, synthetic: int = 0) -> dict[str, dict[str, float]]:
    """Out-of-fold metrics of every candidate, plain and with synthetic positives, for ``select_model``."""
    out = {}
    for name, parts in stages.items():
        for copies in (0, synthetic) if synthetic else (0,):
            out[name + ("+synthetic" if copies else "")] = metrics(written(out_of_fold(rows, parts, folds, copies), "scored"))
    return out


def save_model(model: PipelineModel, path: str) -> None:
    """Keep a fitted model on whatever file system the path names."""
    model.write().overwrite().save(path)


def scored_by(path: str, rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(id, label, score, predicted) of rows by a kept model."""
    score = vector_to_array("probability")[1]
    return PipelineModel.load(path).transform(rows).select("id", "label", score.alias("score"), (score >= threshold).cast("int").alias("predicted"))


def model_run(spark: SparkSession, run_id: str, name: str, path: str, measured: dict[str, float]) -> DataFrame:
    """The audit row of a training run: model, place and metrics as JSON; it is only ever appended."""
    import json

    return spark.createDataFrame([(run_id, name, path, json.dumps(measured, sort_keys=True))], "run_id string, model_name string, model_path string, metrics string")


def model_card(name: str, measured: dict[str, float], importance: dict[str, float]) -> str:
    """A short report of a model: its metrics and its features by weight."""
    lines = [f"# {name}", "", *(f"* {k}: {v:.4f}" if isinstance(v, float) else f"* {k}: {v}" for k, v in sorted(measured.items())), "", "| feature | weight |", "| --- | --- |"]
    return "\n".join([*lines, *(f"| {f} | {w:.4f} |" for f, w in sorted(importance.items(), key=lambda x: -x[1]))])


def latest_feature_rows(snapshots: DataFrame) -> DataFrame:
    """Features of the latest snapshot of each supplier product."""
    latest = best_per_key(snapshots, ["supplier_product_id"], [F.desc("generated_at"), F.desc("id")])
    return feature_rows(latest)


def explanation(signals: Sequence[tuple[Column, Column]], most: int = 4) -> Column:
    """The first signals that hold, as one text."""
    return F.array_join(F.slice(F.array_compact(F.array(*(F.when(c, t) for c, t in signals))), 1, most), ", ")
