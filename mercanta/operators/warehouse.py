"""Star schema over runs, supplier products and opportunities, and the marts on it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercanta.operators.relational import date_dimension, seconds_between, surrogate_keys, title_case, with_unknown
from mercanta.runtime import table, written


def static_dimension(spark: SparkSession, codes: list[tuple[int, str, str]]) -> DataFrame:
    """A fixed dimension with its unknown member 99."""
    return spark.createDataFrame([*codes, (99, "desconhecida", "Desconhecida")], "sk int, code string, label string")


def recommendation_dimension(spark: SparkSession) -> DataFrame:
    return static_dimension(spark, [(1, "comprar_teste", "Comprar teste"), (2, "revisar", "Revisar"), (3, "ignorar", "Ignorar")])


def confidence_dimension(spark: SparkSession) -> DataFrame:
    return static_dimension(spark, [(1, "alta", "Alta"), (2, "media", "Media"), (3, "baixa", "Baixa")])


def dates(spark: SparkSession, root: str) -> DataFrame:
    """The calendar of all dates in runs, loads and snapshots."""
    parts = [("decision_opportunity_snapshots", "generated_at"), ("decision_engine_runs", "started_at"), ("decision_engine_runs", "finished_at"), ("source_runs", "started_at"), ("source_runs", "finished_at")]
    union = None
    for name, column in parts:
        one = table(spark, root, name).select(F.to_date(column).alias("date")).distinct()
        union = one if union is None else union.unionByName(one)
    return date_dimension(union, "date")


def suppliers(spark: SparkSession, root: str) -> DataFrame:
    """Distinct suppliers of catalogue and snapshots with a display name and a key."""
    slugs = table(spark, root, "supplier_products_normalized").select("supplier_slug").distinct().unionByName(table(spark, root, "decision_opportunity_snapshots").select("supplier_slug").distinct())
    named = slugs.where("supplier_slug IS NOT NULL").distinct().withColumn("supplier_name", title_case(F.replace(F.col("supplier_slug"), F.lit("_"), F.lit(" "))))
    return surrogate_keys(named, ["supplier_slug"], "supplier_sk")


def products(spark: SparkSession, root: str, known: DataFrame | None = None) -> DataFrame:
    """Supplier products with their key and their supplier's; ``known`` is the supplier dimension if it is there already."""
    known = suppliers(spark, root) if known is None else known
    rows = table(spark, root, "supplier_products_normalized").select("id", "supplier_slug", "source_product_key", "normalized_title", "token_count", "sku", "ean", "currency_id")
    return surrogate_keys(rows.join(known.select("supplier_slug", "supplier_sk"), "supplier_slug"), ["supplier_slug", "normalized_title", "id"], "product_sk")


def engine_runs(spark: SparkSession, root: str) -> DataFrame:
    runs = table(spark, root, "decision_engine_runs").select("id", "scoring_version", "status", "started_at", seconds_between(F.col("started_at"), F.col("finished_at")).alias("seconds"))
    return surrogate_keys(runs, ["started_at", "id"], "run_sk")


def collection_sources(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "source_runs").where("source_name IS NOT NULL").select("source_name", "source_type", "raw_table_name").distinct()
    return surrogate_keys(rows, ["source_name", "source_type", "raw_table_name"], "source_sk")


def opportunity_fact(spark: SparkSession, root: str) -> DataFrame:
    """Snapshots with the keys of run, supplier, product, recommendation and confidence (99: unknown) and the date key."""
    fact = table(spark, root, "decision_opportunity_snapshots")
    runs = engine_runs(spark, root).select(F.col("id").alias("decision_run_id"), "run_sk")
    known = written(suppliers(spark, root), "suppliers")
    items = products(spark, root, known).select(F.col("id").alias("supplier_product_id"), "product_sk")
    fact = fact.join(runs, "decision_run_id", "left").join(known.select("supplier_slug", "supplier_sk"), "supplier_slug", "left").join(items, "supplier_product_id", "left")
    fact = with_unknown(fact, recommendation_dimension(spark).withColumnRenamed("sk", "recommendation_sk"), "recommendation", "code", "recommendation_sk")
    fact = with_unknown(fact, confidence_dimension(spark).withColumnRenamed("sk", "confidence_sk"), "confidence_level", "code", "confidence_sk")
    return fact.select("id", "run_sk", "supplier_sk", "product_sk", "recommendation_sk", "confidence_sk", F.date_format("generated_at", "yyyyMMdd").cast("int").alias("date_key"), "supplier_price", "estimated_market_price", "estimated_net_profit", "net_margin_pct", "market_offer_count", "price_history_count", "match_confidence", "decision_score", F.size("risk_flags").alias("risk_flag_count"))


def source_run_fact(spark: SparkSession, root: str) -> DataFrame:
    """Loads with the key of their source (NULL table names match) and date keys."""
    s, d = table(spark, root, "source_runs").alias("s"), collection_sources(spark, root).alias("d")
    same = (F.col("s.source_name") == F.col("d.source_name")) & (F.col("s.source_type") == F.col("d.source_type")) & F.col("s.raw_table_name").eqNullSafe(F.col("d.raw_table_name"))
    day = lambda c: F.date_format(F.col(c), "yyyyMMdd").cast("int")
    return s.join(d, same, "left").select("s.id", "d.source_sk", "s.status", "s.records_extracted", "s.records_loaded", "s.records_skipped", day("s.started_at").alias("start_key"), day("s.finished_at").alias("end_key"), seconds_between(F.col("s.started_at"), F.col("s.finished_at")).alias("seconds"))
