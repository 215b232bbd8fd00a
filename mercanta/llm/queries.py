"""Queries of the problems 2, 3, 8, 9 and 10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercanta.llm import listings, mixing, packing, percentiles, residue
from mercanta.runtime import table, written


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    """Every pair of records of the same product."""
    return listings.same_product_pairs(listings.products(listings.market_and_catalogue(spark, root)))


def p3_groups(spark: SparkSession, root: str) -> DataFrame:
    """Each record with its product group and what was read from its text."""
    return listings.products(listings.market_and_catalogue(spark, root))


def p2_percentiles(spark: SparkSession, root: str) -> DataFrame:
    """Percentiles of single loads, of days and of all days, with the rank error that bounds them."""
    return percentiles.price_percentiles(spark, root)


def p2_error(spark: SparkSession, root: str) -> DataFrame:
    """The exact rank of every percentile over all days, beside its bound."""
    return percentiles.measured_error(spark, root)


def p8_packing(spark: SparkSession, root: str) -> DataFrame:
    """Every document, or piece of one, with its bin in containers of each size."""
    return packing.pack(table(spark, root, "documents"), table(spark, root, "container_sizes"))


def p8_fill(spark: SparkSession, root: str) -> DataFrame:
    """Bins, tokens and share of unused space for each container size."""
    bins = packing.pack(table(spark, root, "documents"), table(spark, root, "container_sizes")).where("bin_id IS NOT NULL").groupBy("container_name", "capacity", "bin_id").agg(F.sum("tokens").alias("tokens"))
    return bins.groupBy("container_name", "capacity").agg(F.count("*").alias("bins"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"), F.round(1 - F.sum("tokens") / (F.count("*") * F.first("capacity")), 4).alias("unused"))


def p9_mixture(spark: SparkSession, root: str) -> DataFrame:
    """The documents of each mixture and how often each is used."""
    return mixing.mix(table(spark, root, "documents"), table(spark, root, "mixture_targets"))[0]


def p9_shares(spark: SparkSession, root: str) -> DataFrame:
    """Target and reached shares of each source in each mixture."""
    return mixing.reached_shares(*mixing.mix(table(spark, root, "documents"), table(spark, root, "mixture_targets")))


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    """Documents that hold template residue, filler or the words of a failed page."""
    return residue.residue_documents(table(spark, root, "documents"))


def p10_clean(spark: SparkSession, root: str) -> DataFrame:
    """The documents that remain."""
    return residue.clean_documents(spark, root)


def p2_bounds(spark: SparkSession, root: str) -> DataFrame:
    """Per level, the groups answered and whether at least 99 in 100 answers are within the stated bound of their exact rank."""
    e = percentiles.measured_error(spark, root)
    inside = F.avg((F.col("error") <= F.col("rank_error") + 1.0 / F.col("n")).cast("int"))
    return e.groupBy("level").agg((F.count("*") / len(percentiles.SHARES)).cast("bigint").alias("n_groups"), (inside >= 0.99).alias("within"))


def p3_membership(spark: SparkSession, root: str) -> DataFrame:
    """Records and how many are of a product of their own kind: every offer and every catalogue row is in exactly one group."""
    g = listings.products(listings.market_and_catalogue(spark, root))
    return g.agg(F.count("*").alias("records"), F.countDistinct("key").alias("keys"), F.count_if(F.col("product").isNull()).alias("without_group"))


def p8_coverage(spark: SparkSession, root: str) -> DataFrame:
    """Per container size: documents packed, bins filled over capacity, and documents split although they would fit."""
    packed = packing.pack(table(spark, root, "documents"), table(spark, root, "container_sizes")).where("bin_id IS NOT NULL")
    over = packed.groupBy("container_name", "capacity", "bin_id").agg(F.sum("tokens").alias("t")).groupBy("container_name").agg(F.count_if(F.col("t") > F.col("capacity")).alias("overfull"))
    split = packed.groupBy("container_name", "capacity", "doc_id").agg(F.count("*").alias("pieces"), F.sum("tokens").alias("t")).groupBy("container_name").agg(F.count("*").alias("documents"), F.count_if((F.col("pieces") > 1) & (F.col("t") <= F.col("capacity"))).alias("split"))
    return split.join(over, "container_name").select("container_name", "documents", "overfull", "split")


def p9_limits(spark: SparkSession, root: str) -> DataFrame:
    """Per mixture and source: whether its share is met within a hundredth, or within one document of usual size, and no document used more often than allowed."""
    chosen, planned = mixing.mix(table(spark, root, "documents"), table(spark, root, "mixture_targets"))
    shares = mixing.reached_shares(chosen, planned).join(planned.select("mixture_name", "source", "total", (F.col("have") / F.col("docs")).alias("usual")), ["mixture_name", "source"])
    apart = F.abs(F.col("reached_share") - F.col("target_share"))
    return shares.select("mixture_name", "source", (apart <= F.greatest(F.lit(0.01), F.col("usual") / F.col("total"))).alias("met"), (F.col("most_copies") <= F.col("max_repeats")).alias("allowed"))


def p10_parts(spark: SparkSession, root: str) -> DataFrame:
    """Residue and clean documents: together all, none in both."""
    documents = table(spark, root, "documents")
    found = written(residue.residue_documents(documents), "found")
    rest = documents.join(found, "doc_id", "left_anti")
    both = found.select("doc_id", F.lit(1).alias("residue")).unionByName(rest.select("doc_id", F.lit(0).alias("residue")))
    return both.agg(F.count("*").alias("documents"), F.countDistinct("doc_id").alias("ids"))


QUERIES = {f.__name__: f for f in (p2_percentiles, p2_error, p2_bounds, p3_found, p3_groups, p3_membership, p8_packing, p8_fill, p8_coverage, p9_mixture, p9_shares, p9_limits, p10_found, p10_clean, p10_parts)}

_PRICES = """(SELECT 'price' AS metric, NULL AS source, query, fetched_date AS day, source_run_id AS load FROM market_web_listings_raw WHERE NOT blocked AND price IS NOT NULL
 UNION ALL SELECT 'median_price', source_name, query, fetched_date, NULL FROM price_history_raw WHERE NOT blocked AND median_price IS NOT NULL)"""
#: What the results must be like, in SQL; which documents, groups and bins it comes to needs the operators themselves.
ORACLE: dict[str, str] = {
    "p2_bounds": f"""SELECT 'load' AS level, count(*) AS n_groups, true AS within FROM (SELECT DISTINCT metric, source, query, day, load FROM {_PRICES} WHERE load IS NOT NULL)
 UNION ALL SELECT 'day', count(*), true FROM (SELECT DISTINCT metric, source, query, day FROM {_PRICES}) UNION ALL SELECT 'all', count(*), true FROM (SELECT DISTINCT metric, source, query FROM {_PRICES})""",
    "p3_membership": """SELECT count(*) AS records, count(*) AS keys, 0 AS without_group FROM (SELECT DISTINCT item_url FROM market_web_listings_raw WHERE item_url IS NOT NULL AND title IS NOT NULL UNION ALL SELECT id FROM supplier_products_normalized)""",
    "p8_coverage": """SELECT container_name, (SELECT count(*) FROM documents WHERE text <> '') AS documents, 0 AS overfull, 0 AS split FROM container_sizes""",
    "p9_limits": """SELECT mixture_name, source, true AS met, true AS allowed FROM mixture_targets WHERE target_share > 0 AND max_repeats > 0""",
    "p10_parts": "SELECT count(*) AS documents, count(DISTINCT doc_id) AS ids FROM documents",
}
