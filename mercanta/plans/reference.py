"""Queries of the reference's own operators, with equivalent DuckDB SQL where SQL can say it.

"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercanta.functions import attributes, numbers, text
from mercanta.operators import matching, ml, ranks, relational, warehouse
from mercanta.runtime import scratch, table, written
from mercanta.sources import readers, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
LISTINGS, HISTORY, CATALOGUE, SNAPSHOTS, RUNS, LOADS = "market_web_listings_raw", "price_history_raw", "supplier_products_normalized", "decision_opportunity_snapshots", "decision_engine_runs", "source_runs"


def query(sql: str | None = None):
    """Register a query under its function's name, with its oracle."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


# --- projections -----------------------------------------------------------------------------------------------


@query("""SELECT id, coalesce(nullif(nullif(payload ->> '$.id', ''), '0'), nullif(nullif(payload ->> '$.item_id', ''), '0')) AS external_id,
  coalesce(nullif(nullif(payload ->> '$.title', ''), '0'), nullif(nullif(payload ->> '$.name', ''), '0')) AS title,
  coalesce(nullif(nullif(payload ->> '$.seller.id', ''), '0'), nullif(nullif(payload ->> '$.seller_id', ''), '0')) AS seller_id
FROM mercado_livre_items_raw WHERE json_valid(payload) AND json_type(payload) = 'OBJECT'""")
def P01_item_fields(spark, root):
    """Item JSON as columns, with fallbacks."""
    items = table(spark, root, "mercado_livre_items_raw").where(F.from_json("payload", "map<string,string>").isNotNull() & F.try_parse_json("payload").isNotNull() & F.ltrim("payload").startswith("{"))
    return items.select("id", readers.item_fields(F.col("payload")).alias("f")).select("id", "f.external_id", "f.title", "f.seller_id")


@query("""SELECT id, coalesce(title, query, '') AS title FROM market_web_listings_raw
UNION ALL SELECT id, coalesce(title, query, product_key, '') FROM price_history_raw""")
def P03_title_fallback(spark, root):
    """Titles with their fallbacks."""
    listings = table(spark, root, LISTINGS).select("id", F.coalesce("title", "query", F.lit("")).alias("title"))
    return listings.unionByName(table(spark, root, HISTORY).select("id", F.coalesce("title", "query", "product_key", F.lit("")).alias("title")))


@query("SELECT id, CAST(coalesce(avg_price, min_price, max_price) AS DOUBLE) AS price FROM price_history_raw")
def P04_price_fallback(spark, root):
    return table(spark, root, HISTORY).select("id", F.coalesce("avg_price", "min_price", "max_price").cast("double").alias("price"))


_EVIDENCE = """SELECT 0 AS source_order, id, coalesce(title, query, '') AS title, CAST(price AS DOUBLE) AS price, position, sold_quantity, reviews_count FROM market_web_listings_raw WHERE price > 0 AND NOT blocked
UNION ALL SELECT 1, id, coalesce(title, query, product_key, ''), CAST(current_price AS DOUBLE), NULL, NULL, NULL FROM price_history_raw WHERE current_price > 0 AND NOT blocked
UNION ALL SELECT 2, id, coalesce(title, query, ''), CAST(price AS DOUBLE), NULL, NULL, NULL FROM mercado_livre_items_raw WHERE price > 0"""


def evidence(spark: SparkSession, root: str) -> DataFrame:
    """The three evidence sources as one table; columns a source lacks are NULL."""
    none = F.lit(None).cast("int")
    market = table(spark, root, LISTINGS).where("price > 0 AND NOT blocked").select(F.lit(0).alias("source_order"), "id", F.coalesce("title", "query", F.lit("")).alias("title"), F.col("price").cast("double").alias("price"), "position", "sold_quantity", "reviews_count")
    history = table(spark, root, HISTORY).where("current_price > 0 AND NOT blocked").select(F.lit(1).alias("source_order"), "id", F.coalesce("title", "query", "product_key", F.lit("")).alias("title"), F.col("current_price").cast("double").alias("price"), none.alias("position"), none.alias("sold_quantity"), none.alias("reviews_count"))
    items = table(spark, root, "mercado_livre_items_raw").where("price > 0").select(F.lit(2).alias("source_order"), "id", F.coalesce("title", "query", F.lit("")).alias("title"), F.col("price").cast("double").alias("price"), none.alias("position"), none.alias("sold_quantity"), none.alias("reviews_count"))
    return market.unionByName(history).unionByName(items)


@query(_EVIDENCE)
def U04_evidence_union(spark, root):
    """P05 and F03 to F05 with it: padded columns, positive prices, no blocked rows."""
    return evidence(spark, root)


_NORM = "trim(regexp_replace(strip_accents(lower(coalesce({c}, ''))), '[^a-z0-9]+', ' ', 'g'))"
_NORM_TITLE = _NORM.format(c="raw_title")
_TOKENS = "list_filter(string_split(" + _NORM_TITLE + ", ' '), lambda w: w <> '' AND (regexp_matches(w, '[0-9]') OR length(w) >= 3) AND NOT list_contains(['a','as','ao','aos','com','da','das','de','do','dos','e','em','na','nas','no','nos','o','os','para','por','sem','uma','um','un'], w))"


@query(f"SELECT id, supplier_slug, {_NORM_TITLE} AS normalized_title, len(list_distinct({_TOKENS})) AS token_count, coalesce(currency_id, 'BRL') AS currency_id FROM supplier_products_normalized WHERE len({_TOKENS}) > 0")
def P08_supplier_normalisation(spark, root):
    """Normalised titles and token counts of supplier rows; rows without tokens are left out."""
    rows = table(spark, root, CATALOGUE).select("id", "supplier_slug", text.normalized(F.col("raw_title")).alias("normalized_title"), F.coalesce("currency_id", F.lit("BRL")).alias("currency_id"))
    return rows.withColumn("token_count", F.size(text.tokens(F.col("normalized_title")))).where("token_count > 0").select("id", "supplier_slug", "normalized_title", F.col("token_count").cast("bigint").alias("token_count"), "currency_id")


_CATEGORY = "CASE " + " ".join(f"WHEN regexp_matches(n, '(^| )({'|'.join(terms)})( |$)') THEN '{name}'" for name, terms in text.CATEGORIES) + " ELSE 'outros' END"


def _offers(spark: SparkSession, root: str) -> DataFrame:
    """Open listings with price and title as offers: key parts, category, discount."""
    rows = table(spark, root, LISTINGS).where("NOT blocked AND price > 0 AND trim(coalesce(title, '')) <> ''")
    norm_title, norm_query = text.normalized(F.col("title")), text.normalized(F.col("query"))
    rows = rows.select("id", "source_name", norm_query.alias("query_key"), norm_title.alias("nt"), text.title_key(norm_title).alias("title_key"), F.col("price").cast("double").alias("price"), F.col("old_price").cast("double").alias("old_price"), numbers.bare_url(F.col("item_url")).alias("item_url"), F.coalesce("is_sponsored", F.lit(False)).alias("is_sponsored"), "fetched_at", "sold_quantity", "reviews_count")
    return rows.withColumn("category", text.category(F.concat_ws(" ", "query_key", "nt"))).withColumn("discount", F.when(F.col("old_price") > F.col("price"), F.round((F.col("old_price") - F.col("price")) / F.col("old_price"), 4))).drop("nt")


_OFFER_SQL = f"""WITH base AS (
  SELECT id, source_name, {_NORM.format(c="query")} AS query_key, {_NORM.format(c="title")} AS nt, CAST(price AS DOUBLE) AS price, CAST(old_price AS DOUBLE) AS old_price,
    regexp_replace(trim(item_url), '[?#].*$', '') AS item_url, coalesce(is_sponsored, false) AS is_sponsored, fetched_at
  FROM market_web_listings_raw WHERE NOT blocked AND price > 0 AND trim(coalesce(title, '')) <> ''),
offers AS (
  SELECT *, concat_ws(' ', query_key, nt) AS n,
    array_to_string(list_filter(string_split(nt, ' '), lambda w: w <> '' AND NOT list_contains(['de','da','do','das','dos','com','para','por','em','a','o','e','r','rs','br'], w))[1:18], ' ') AS title_key
  FROM base) """


@query(_OFFER_SQL + f"SELECT id, source_name, query_key, title_key, {_CATEGORY} AS category, price, item_url, CASE WHEN old_price > price THEN round((old_price - price) / old_price, 4) END AS discount FROM offers")
def P09_market_offers(spark, root):
    """Listings as offers (H07, H09, H30 with it)."""
    return _offers(spark, root).select("id", "source_name", "query_key", "title_key", "category", "price", "item_url", "discount")


@query(_OFFER_SQL + """SELECT id, source_name, query_key FROM offers
QUALIFY row_number() OVER (PARTITION BY source_name, query_key, coalesce(item_url, title_key) ORDER BY is_sponsored, price, fetched_at, id) = 1""")
def A15_best_offers(spark, root):
    """The best offer of each source, query and item."""
    offers = _offers(spark, root).withColumn("item_key", F.coalesce("item_url", "title_key"))
    return relational.best_per_key(offers, ["source_name", "query_key", "item_key"], [F.col("is_sponsored"), F.col("price"), F.col("fetched_at"), F.col("id")]).select("id", "source_name", "query_key")


@query("""SELECT DISTINCT product_id, domain_id, status FROM mercado_livre_products_raw
QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY fetched_at DESC, id DESC) = 1""")
def A12_latest_products(spark, root):
    """The latest row of each marketplace product (P11 with it)."""
    rows = table(spark, root, "mercado_livre_products_raw").select("product_id", "domain_id", "status", "fetched_at", "id")
    return relational.best_per_key(rows, ["product_id"], [F.desc("fetched_at"), F.desc("id")]).select("product_id", "domain_id", "status")


@query("SELECT product_id, string_agg(query, ' | ' ORDER BY query) AS joined, count(*) AS n_values FROM (SELECT DISTINCT product_id, query FROM mercado_livre_products_raw WHERE query IS NOT NULL) GROUP BY product_id")
def A13_product_queries(spark, root):
    """Queries that found each product, sorted and joined."""
    return relational.joined_values(table(spark, root, "mercado_livre_products_raw"), ["product_id"], "query")


# --- filters ---------------------------------------------------------------------------------------------------


@query("SELECT id, supplier_slug, CAST(supplier_price AS DOUBLE) AS supplier_price FROM supplier_products_normalized WHERE raw_title IS NOT NULL AND supplier_price > 0")
def F02_priced_products(spark, root):
    """titles present, prices above zero."""
    return table(spark, root, CATALOGUE).where("raw_title IS NOT NULL AND supplier_price > 0").select("id", "supplier_slug", F.col("supplier_price").cast("double").alias("supplier_price"))


@query("SELECT id, blocked, CAST(price AS DOUBLE) AS price FROM market_web_listings_raw WHERE blocked OR price BETWEEN 100 AND 1500")
def F06_price_band(spark, root):
    """A price band that blocked rows always pass."""
    return table(spark, root, LISTINGS).where(F.col("blocked") | F.col("price").between(100, 1500)).select("id", "blocked", F.col("price").cast("double").alias("price"))


@query("SELECT id, source_name, status FROM source_runs WHERE started_at >= (SELECT max(started_at) FROM source_runs) - INTERVAL 48 HOUR AND status = 'partial'")
def F08_lookback(spark, root):
    """optional filters and a look back from the latest load."""
    loads = table(spark, root, LOADS)
    as_of = loads.agg(F.max("started_at").alias("as_of"))
    return loads.join(F.broadcast(as_of), F.col("started_at") >= F.col("as_of") - F.expr("make_interval(0, 0, 0, 0, 48, 0, 0)")).where("status = 'partial'").select("id", "source_name", "status")  # one row


@query("""SELECT reason, count(*) AS n_rows FROM (SELECT CASE WHEN blocked THEN 'blocked' WHEN price IS NULL OR price <= 0 THEN 'no_price' WHEN trim(coalesce(title, '')) = '' THEN 'no_title' ELSE 'kept' END AS reason FROM market_web_listings_raw) GROUP BY reason""")
def F12_drop_reasons(spark, root):
    """Rows dropped by the ETL, counted by reason in the same pass (A19 with it)."""
    reasons = [("blocked", F.col("blocked")), ("no_price", F.col("price").isNull() | (F.col("price") <= 0)), ("no_title", F.trim(F.coalesce("title", F.lit(""))) == "")]
    return relational.drop_reasons(table(spark, root, LISTINGS).select("blocked", "price", "title"), reasons).groupBy("reason").agg(F.count("*").alias("n_rows"))


@query(f"""WITH t AS (SELECT id, unnest(list_distinct({_TOKENS})) AS token FROM supplier_products_normalized), n AS (SELECT token, count(*) AS n FROM t GROUP BY token)
SELECT token, n FROM n WHERE n <= greatest(120, (SELECT count(*) FROM supplier_products_normalized) // 4)""")
def F14_useful_tokens(spark, root):
    """Document frequency of tokens, the most frequent ones cut."""
    rows = table(spark, root, CATALOGUE).select("id", text.tokens(text.normalized(F.col("raw_title"))).alias("tokens"))
    counts = rows.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    size = table(spark, root, CATALOGUE).agg(F.greatest(F.lit(120), F.expr("count(*) div 4")).alias("most"))
    return counts.join(F.broadcast(size), F.col("n") <= F.col("most")).select("token", "n")  # one row


@query("SELECT query, count(*) AS offers, CAST(min(price) AS DOUBLE) AS least FROM market_web_listings_raw WHERE NOT blocked AND price > 0 AND query IS NOT NULL GROUP BY query HAVING count(*) >= 5")
def F16_query_groups(spark, root):
    """Queries with at least five positive prices."""
    return table(spark, root, LISTINGS).where("NOT blocked AND price > 0 AND query IS NOT NULL").groupBy("query").agg(F.count("*").alias("offers"), F.min("price").cast("double").alias("least")).where("offers >= 5")


@query("""SELECT rule, count(*) AS n_rows FROM (
  SELECT 'status' AS rule FROM source_runs WHERE NOT (status IN ('success', 'failed', 'cancelled')) UNION ALL SELECT 'finished' FROM source_runs WHERE finished_at IS NULL UNION ALL SELECT 'counts' FROM source_runs WHERE NOT (records_extracted = records_loaded + records_skipped)) GROUP BY rule""")
def F18_violations(spark, root):
    """Rows that enum and check constraints refuse."""
    rules = {"status": F.col("status").isin("success", "failed", "cancelled"), "finished": F.col("finished_at").isNotNull(), "counts": F.col("records_extracted") == F.col("records_loaded") + F.col("records_skipped")}
    return relational.violations(table(spark, root, LOADS), rules).withColumnRenamed("rows", "n_rows")


@query("SELECT id, event_type FROM (SELECT event_id AS id, event_type, props FROM events) WHERE CAST(props ->> '$.k' AS BIGINT) = 42")
def F10_json_field(spark, root):
    """A predicate on a field of JSON text."""
    return table(spark, root, "events").where(F.get_json_object("props", "$.k").try_cast("bigint") == 42).select(F.col("event_id").alias("id"), "event_type")


# --- joins -----------------------------------------------------------------------------------------------------


@query("""WITH d AS (SELECT source_name, source_type, raw_table_name, row_number() OVER (ORDER BY source_name, source_type, raw_table_name) AS source_sk FROM (SELECT DISTINCT source_name, source_type, raw_table_name FROM source_runs WHERE source_name IS NOT NULL))
SELECT s.id, d.source_sk, s.status, s.records_extracted, s.records_loaded, s.records_skipped, CAST(strftime(s.started_at, '%Y%m%d') AS INTEGER) AS start_key, CAST(strftime(s.finished_at, '%Y%m%d') AS INTEGER) AS end_key,
  CAST(round((epoch_us(s.finished_at) - epoch_us(s.started_at)) / 1000000.0) AS BIGINT) AS seconds
FROM source_runs s LEFT JOIN d ON d.source_name = s.source_name AND d.source_type = s.source_type AND d.raw_table_name IS NOT DISTINCT FROM s.raw_table_name""")
def J04_source_run_fact(spark, root):
    """NULL-tolerant star join, date keys and rounded durations."""
    return warehouse.source_run_fact(spark, root)


@query("""WITH last AS (SELECT id FROM decision_engine_runs WHERE status = 'success' ORDER BY started_at DESC NULLS LAST, id DESC LIMIT 1)
SELECT s.id, s.supplier_product_id, s.recommendation FROM decision_opportunity_snapshots s JOIN last ON last.id = s.decision_run_id""")
def J06_latest_run_rows(spark, root):
    """Rows of the latest successful run (O03, S21 with it): one row on the small side."""
    last = table(spark, root, RUNS).where("status = 'success'").orderBy(F.desc_nulls_last("started_at"), F.desc("id")).limit(1).select(F.col("id").alias("decision_run_id"))
    return table(spark, root, SNAPSHOTS).join(F.broadcast(last), "decision_run_id").select("id", "supplier_product_id", "recommendation")


@query("""SELECT r.id AS source_run_id, r.records_loaded, count(m.id) AS n_rows, coalesce(sum(CAST(m.blocked AS BIGINT)), 0) AS blocked_rows FROM source_runs r LEFT JOIN market_web_listings_raw m ON m.source_run_id = r.id GROUP BY r.id, r.records_loaded""")
def J09_rows_per_load(spark, root):
    """Loads with the rows they left (J05, J07): counted before the join, so a hot load is one row."""
    counts = table(spark, root, LISTINGS).groupBy("source_run_id").agg(F.count("*").alias("n_rows"), F.sum(F.col("blocked").cast("bigint")).alias("blocked_rows"))
    loads = table(spark, root, LOADS).select(F.col("id").alias("source_run_id"), "records_loaded")
    return loads.join(counts, "source_run_id", "left").fillna(0, ["n_rows", "blocked_rows"])


@query("""SELECT s.source_name, q.query, row_number() OVER (ORDER BY s.source_name, q.query) AS task FROM (SELECT DISTINCT source_name FROM source_runs) s, (SELECT DISTINCT query FROM mercado_livre_products_raw WHERE query IS NOT NULL) q""")
def J11_task_grid(spark, root):
    """The grid of sources and queries to collect, numbered: a product of two configured lists."""
    sources = table(spark, root, LOADS).select("source_name").distinct()
    queries = table(spark, root, "mercado_livre_products_raw").where("query IS NOT NULL").select("query").distinct()
    listed = queries.agg(F.array_sort(F.collect_set("query")).alias("q"))
    grid = sources.join(F.broadcast(listed)).select("source_name", F.explode("q").alias("query"))
    return relational.surrogate_keys(grid, ["source_name", "query"], "task")


@query("""SELECT id, supplier_slug FROM supplier_products_normalized p WHERE NOT EXISTS (SELECT 1 FROM decision_opportunity_snapshots s WHERE s.supplier_product_id = p.id)""")
def J12_never_scored(spark, root):
    """Anti join: products that no run has scored."""
    return table(spark, root, CATALOGUE).select("id", "supplier_slug").join(table(spark, root, SNAPSHOTS).select(F.col("supplier_product_id").alias("id")), "id", "left_anti")


@query("""SELECT id, source_name FROM market_web_listings_raw WHERE source_run_id IN (SELECT id FROM source_runs WHERE status = 'partial')""")
def J13_rows_of_partial_loads(spark, root):
    """Semi join: F09 with a query as its list."""
    partial = table(spark, root, LOADS).where("status = 'partial'").select(F.col("id").alias("source_run_id"))
    return table(spark, root, LISTINGS).select("id", "source_name", "source_run_id").join(partial, "source_run_id", "left_semi").select("id", "source_name")


_STAR = """WITH sup AS (SELECT supplier_slug, row_number() OVER (ORDER BY supplier_slug) AS supplier_sk FROM (SELECT supplier_slug FROM supplier_products_normalized UNION SELECT supplier_slug FROM decision_opportunity_snapshots) WHERE supplier_slug IS NOT NULL),
prod AS (SELECT p.id, row_number() OVER (ORDER BY p.supplier_slug, p.normalized_title, p.id) AS product_sk FROM supplier_products_normalized p JOIN sup USING (supplier_slug)),
run AS (SELECT id, row_number() OVER (ORDER BY started_at, id) AS run_sk FROM decision_engine_runs),
fact AS (SELECT o.id, r.run_sk, s.supplier_sk, p.product_sk, CASE o.recommendation WHEN 'comprar_teste' THEN 1 WHEN 'revisar' THEN 2 WHEN 'ignorar' THEN 3 ELSE 99 END AS recommendation_sk,
  CASE o.confidence_level WHEN 'alta' THEN 1 WHEN 'media' THEN 2 WHEN 'baixa' THEN 3 ELSE 99 END AS confidence_sk, CAST(strftime(o.generated_at, '%Y%m%d') AS INTEGER) AS date_key, len(o.risk_flags) AS risk_flag_count,
  o.net_margin_pct, o.decision_score, o.match_confidence, o.estimated_net_profit, o.market_offer_count, o.price_history_count
  FROM decision_opportunity_snapshots o LEFT JOIN run r ON r.id = o.decision_run_id LEFT JOIN sup s USING (supplier_slug) LEFT JOIN prod p ON p.id = o.supplier_product_id) """


@query(_STAR + "SELECT id, run_sk, supplier_sk, product_sk, recommendation_sk, confidence_sk, date_key, risk_flag_count FROM fact")
def J02_opportunity_fact(spark, root):
    """The star join with unknown members."""
    return warehouse.opportunity_fact(spark, root).select("id", "run_sk", "supplier_sk", "product_sk", "recommendation_sk", "confidence_sk", "date_key", "risk_flag_count")


# --- aggregations ----------------------------------------------------------------------------------------------


@query("""SELECT supplier_slug, recommendation, confidence_level, count(*) AS products, round(avg(CAST(decision_score AS DOUBLE)), 2) AS mean_score, CAST(max(decision_score) AS DOUBLE) AS best FROM decision_opportunity_snapshots GROUP BY ALL""")
def A01_summary(spark, root):
    return table(spark, root, SNAPSHOTS).groupBy("supplier_slug", "recommendation", "confidence_level").agg(F.count("*").alias("products"), F.round(F.avg(F.col("decision_score").cast("double")), 2).alias("mean_score"), F.max("decision_score").cast("double").alias("best"))


@query("""SELECT supplier_slug, count(*) AS n_rows, count(*) FILTER (WHERE recommendation = 'comprar_teste') AS n_comprar_teste, count(*) FILTER (WHERE recommendation = 'revisar') AS n_revisar, count(*) FILTER (WHERE recommendation = 'ignorar') AS n_ignorar FROM decision_opportunity_snapshots GROUP BY supplier_slug""")
def A02_status_counts(spark, root):
    """Conditional counts."""
    return relational.status_counts(table(spark, root, SNAPSHOTS), ["supplier_slug"], "recommendation", ["comprar_teste", "revisar", "ignorar"]).withColumnRenamed("rows", "n_rows")


@query(_STAR + """SELECT count(*) AS products, count(*) FILTER (WHERE recommendation_sk = 1) AS to_buy, count(*) FILTER (WHERE recommendation_sk = 2) AS to_review, round(avg(CAST(net_margin_pct AS DOUBLE)), 4) AS mean_margin,
 CAST(sum(estimated_net_profit) FILTER (WHERE recommendation_sk = 1) AS DOUBLE) AS profit_to_buy, round(avg(CAST(decision_score AS DOUBLE)), 2) AS mean_score, CAST(sum(market_offer_count) AS BIGINT) AS market_evidence, max(date_key) AS last_date FROM fact""")
def A03_executive_mart(spark, root):
    """The executive mart (B08): conditional sums and means over the fact."""
    fact = warehouse.opportunity_fact(spark, root)
    buy = F.col("recommendation_sk") == 1
    return fact.agg(F.count("*").alias("products"), F.count_if(buy).alias("to_buy"), F.count_if(F.col("recommendation_sk") == 2).alias("to_review"), F.round(F.avg(F.col("net_margin_pct").cast("double")), 4).alias("mean_margin"), F.sum(F.when(buy, F.col("estimated_net_profit"))).cast("double").alias("profit_to_buy"), F.round(F.avg(F.col("decision_score").cast("double")), 2).alias("mean_score"), F.sum("market_offer_count").alias("market_evidence"), F.max("date_key").alias("last_date"))


@query("""SELECT payload ->> '$.catalog_product_id' AS product_id, coalesce(currency_id, 'BRL') AS currency_id, CAST(min(price) AS DOUBLE) AS min_price, round(avg(CAST(price AS DOUBLE)), 3) AS avg_price, CAST(max(price) AS DOUBLE) AS max_price, count(*) AS offers
FROM mercado_livre_items_raw WHERE json_valid(payload) AND json_type(payload) = 'OBJECT' AND payload ->> '$.catalog_product_id' IS NOT NULL AND price IS NOT NULL GROUP BY 1, 2""")
def A05_product_prices(spark, root):
    """Price summary of each catalogue product and currency."""
    items = table(spark, root, "mercado_livre_items_raw").where(F.try_parse_json("payload").isNotNull() & F.ltrim("payload").startswith("{") & F.col("price").isNotNull())
    rows = items.select(F.get_json_object("payload", "$.catalog_product_id").alias("product_id"), F.coalesce("currency_id", F.lit("BRL")).alias("currency_id"), F.col("price").cast("double").alias("price")).where("product_id IS NOT NULL")
    return rows.groupBy("product_id", "currency_id").agg(F.min("price").alias("min_price"), F.round(F.avg("price"), 3).alias("avg_price"), F.max("price").alias("max_price"), F.count("*").alias("offers"))


@query("""SELECT query, round(quantile_cont(CAST(price AS DOUBLE), 0.35), 2) AS p35, round(median(CAST(price AS DOUBLE)), 2) AS middle, round(stddev_pop(CAST(price AS DOUBLE)) / median(CAST(price AS DOUBLE)), 4) AS dispersion, count(DISTINCT source_name) AS sources
FROM market_web_listings_raw WHERE NOT blocked AND price > 0.01 AND price < 1000000 GROUP BY query HAVING count(*) >= 4""")
def A07_price_levels(spark, root):
    """Interpolated percentile, median, dispersion and distinct sources per query (A08 to A11); a query of any size is spread over tasks."""
    rows = table(spark, root, LISTINGS).where("NOT blocked AND price > 0.01 AND price < 1000000").select("query", "source_name", F.col("price").cast("double").alias("price"))
    sources = rows.groupBy("query", "source_name").agg(F.count("*").alias("n")).groupBy("query").agg(F.count("source_name").alias("sources"))
    counts = rows.groupBy("query", "price").agg(F.count("*").alias("n"))
    levels = ranks.range_ranks(counts, ["query"], ["price"], ["n"]).groupBy("query").agg(ranks.interpolated("price", "n", 0.35).alias("p35"), ranks.median_of("price", "n").alias("median"), *ranks.moments("price", "n"))
    levels = levels.where("n >= 4").select("query", F.round("p35", 2).alias("p35"), F.round("median", 2).alias("middle"), F.round(ranks.population_deviation() / F.col("median"), 4).alias("dispersion"))
    l, s = levels.alias("l"), sources.alias("s")
    return l.join(s, F.col("l.query").eqNullSafe(F.col("s.query"))).select("l.*", "s.sources")


@query("""SELECT id, query, CAST(price AS DOUBLE) AS price, round(median(CAST(price AS DOUBLE)) OVER (PARTITION BY query), 2) AS query_median, count(*) OVER (PARTITION BY query) AS query_offers FROM price_history_raw p, LATERAL (SELECT current_price AS price) WHERE NOT blocked AND current_price > 0""")
def W10_group_statistics(spark, root):
    """Statistics of each group on every row: aggregated, then joined back, so no group sits in one window."""
    rows = table(spark, root, HISTORY).where("NOT blocked AND current_price > 0").select("id", "query", F.col("current_price").cast("double").alias("price"))
    stats = ranks.group_medians(rows, ["query"], "price").select("query", F.round("median", 2).alias("query_median"), F.col("n").alias("query_offers"))
    r, s = rows.alias("r"), stats.alias("s")
    return r.join(s, F.col("r.query").eqNullSafe(F.col("s.query"))).select("r.id", "r.query", "r.price", "s.query_median", "s.query_offers")


@query("""SELECT source_name, count(*) AS loads, CAST(sum(records_extracted) AS BIGINT) AS extracted, CAST(sum(records_loaded) AS BIGINT) AS loaded, CAST(sum(records_skipped) AS BIGINT) AS skipped,
 CASE WHEN sum(records_loaded) = 0 THEN CASE WHEN count(*) FILTER (WHERE status = 'failed') > 0 THEN 'failed' ELSE 'partial' END WHEN count(*) FILTER (WHERE status <> 'success') > 0 THEN 'partial' ELSE 'success' END AS status FROM source_runs GROUP BY source_name""")
def A19_pipeline_status(spark, root):
    """Counters of each source and the status they roll up to."""
    rows = table(spark, root, LOADS).groupBy("source_name").agg(F.count("*").alias("loads"), F.sum("records_extracted").alias("extracted"), F.sum("records_loaded").alias("loaded"), F.sum("records_skipped").alias("skipped"), F.count_if(F.col("status") == "failed").alias("f"), F.count_if(F.col("status") != "success").alias("b"))
    status = F.when(F.col("loaded") == 0, F.when(F.col("f") > 0, "failed").otherwise("partial")).when(F.col("b") > 0, "partial").otherwise("success")
    return rows.withColumn("status", status).drop("f", "b")


_GRID = """SELECT 'market' AS kind, source_name, fetched_date, count(*) AS n_rows, CAST(sum(CAST(blocked AS INTEGER)) AS BIGINT) AS blocked_rows FROM market_web_listings_raw GROUP BY ALL
UNION ALL SELECT 'history', source_name, fetched_date, count(*), CAST(sum(CAST(blocked AS INTEGER)) AS BIGINT) FROM price_history_raw GROUP BY ALL
UNION ALL SELECT 'items', source_name, fetched_date, count(*), 0 FROM mercado_livre_items_raw GROUP BY ALL"""


def _grid(spark: SparkSession, root: str) -> DataFrame:
    parts = []
    for kind, name, blocked in (("market", LISTINGS, True), ("history", HISTORY, True), ("items", "mercado_livre_items_raw", False)):
        n_blocked = F.sum(F.col("blocked").cast("bigint")) if blocked else F.lit(0).cast("bigint")
        parts.append(table(spark, root, name).groupBy("source_name", "fetched_date").agg(F.count("*").alias("n_rows"), n_blocked.alias("blocked_rows")).select(F.lit(kind).alias("kind"), "source_name", "fetched_date", "n_rows", "blocked_rows"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(_GRID)
def A20_bronze_grid(spark, root):
    """Rows per source and day of three tables."""
    return _grid(spark, root)


@query(f"""SELECT source_name, coalesce(sum(n_rows) FILTER (WHERE dayofmonth(fetched_date) <= 10), 0)::BIGINT AS first_third, coalesce(sum(n_rows) FILTER (WHERE dayofmonth(fetched_date) BETWEEN 11 AND 20), 0)::BIGINT AS second_third, coalesce(sum(n_rows) FILTER (WHERE dayofmonth(fetched_date) > 20), 0)::BIGINT AS last_third FROM ({_GRID}) GROUP BY source_name""")
def A21_grid_pivot(spark, root):
    """The grid turned: periods become columns, whose values are named so that no scan is needed to find them."""
    day = F.dayofmonth("fetched_date")
    period = F.when(day <= 10, "first_third").when(day <= 20, "second_third").otherwise("last_third")
    return _grid(spark, root).withColumn("period", period).groupBy("source_name").pivot("period", ["first_third", "second_third", "last_third"]).agg(F.sum("n_rows")).fillna(0)


@query("SELECT DISTINCT source_name, source_type, raw_table_name FROM source_runs")
def A26_distinct_sources(spark, root):
    return table(spark, root, LOADS).select("source_name", "source_type", "raw_table_name").distinct()


@query("""SELECT query, count(*) AS n_rows, CAST(min(fetched_at) AS DATE) AS first_day FROM market_web_listings_raw WHERE query IS NOT NULL GROUP BY query ORDER BY n_rows DESC, query LIMIT 20""")
def A17_top_queries(spark, root):
    """The twenty most frequent queries: a top-k report."""
    rows = table(spark, root, LISTINGS).where("query IS NOT NULL").groupBy("query").agg(F.count("*").alias("n_rows"), F.to_date(F.min("fetched_at")).alias("first_day"))
    return rows.orderBy(F.desc("n_rows"), "query").limit(20)


@query(_STAR + """SELECT date_key, recommendation_sk, count(*) AS products, round(avg(CAST(net_margin_pct AS DOUBLE)), 4) AS mean_margin, round(avg(CAST(match_confidence AS DOUBLE)), 2) AS mean_match FROM fact GROUP BY ALL""")
def A18_evolution_mart(spark, root):
    """The evolution mart: products and means per day and recommendation."""
    return warehouse.opportunity_fact(spark, root).groupBy("date_key", "recommendation_sk").agg(F.count("*").alias("products"), F.round(F.avg(F.col("net_margin_pct").cast("double")), 4).alias("mean_margin"), F.round(F.avg(F.col("match_confidence").cast("double")), 2).alias("mean_match"))


# --- windows and order -----------------------------------------------------------------------------------------


@query("""SELECT id, supplier_slug, source_product_key FROM supplier_products_normalized
QUALIFY row_number() OVER (PARTITION BY supplier_slug, source_product_key ORDER BY fetched_at DESC NULLS LAST, fetched_date DESC, id DESC) = 1""")
def W01_latest_supplier_rows(spark, root):
    """The latest snapshot of each supplier product."""
    return relational.best_per_key(table(spark, root, CATALOGUE).select("id", "supplier_slug", "source_product_key", "fetched_at", "fetched_date"), ["supplier_slug", "source_product_key"], [F.desc_nulls_last("fetched_at"), F.desc("fetched_date"), F.desc("id")]).select("id", "supplier_slug", "source_product_key")


@query("""SELECT id, source_name, row_number() OVER (PARTITION BY source_name ORDER BY started_at DESC, id) AS rank FROM source_runs QUALIFY rank <= 10""")
def W02_last_loads(spark, root):
    """The last ten loads of each source."""
    return relational.top_per_key(table(spark, root, LOADS).select("id", "source_name", "started_at"), ["source_name"], [F.desc("started_at"), F.col("id")], 10).select("id", "source_name", F.col("rank").cast("bigint").alias("rank"))


@query("SELECT id, row_number() OVER (ORDER BY started_at, id) AS load_sk FROM source_runs")
def W03_surrogate_keys(spark, root):
    """Consecutive keys of a large table without a global window."""
    return relational.surrogate_keys(table(spark, root, LOADS).select("id", "started_at"), ["started_at", "id"], "load_sk").select("id", "load_sk")


@query("""WITH r AS (SELECT source_name, status <> 'success' AS bad, row_number() OVER (PARTITION BY source_name ORDER BY started_at DESC, id) AS n FROM source_runs), g AS (SELECT source_name, min(n) FILTER (WHERE NOT bad) AS good, count(*) AS runs FROM r GROUP BY source_name)
SELECT source_name, runs, coalesce(good - 1, runs) AS streak, coalesce(good - 1, runs) >= 3 AS disable FROM g""")
def W04_bad_streak(spark, root):
    """Bad loads of each source from the newest on."""
    return relational.bad_streak(table(spark, root, LOADS), ["source_name"], [F.desc("started_at"), F.col("id")], F.col("status") != "success", F.lit(True))


@query("""WITH s AS (SELECT id, CAST(decision_score AS DOUBLE) AS s, CASE WHEN recommendation = 'ignorar' THEN 0 ELSE 1 END AS y FROM decision_opportunity_snapshots WHERE decision_score IS NOT NULL), r AS (SELECT *, row_number() OVER (ORDER BY s DESC, id) AS r FROM s), t AS (SELECT count(*) AS n, sum(y) AS p FROM s)
SELECT round(sum(y) FILTER (WHERE r <= 10) / least(10, any_value(n)), 6) AS precision_at_10, round(sum(y) FILTER (WHERE r <= 10) / any_value(p), 6) AS recall_at_10, round(sum(y) FILTER (WHERE r <= 25) / least(25, any_value(n)), 6) AS precision_at_25,
 round(sum(y) FILTER (WHERE r <= 25) / any_value(p), 6) AS recall_at_25, round(sum(y) FILTER (WHERE r <= 50) / least(50, any_value(n)), 6) AS precision_at_50, round(sum(y) FILTER (WHERE r <= 50) / any_value(p), 6) AS recall_at_50 FROM r, t""")
def W09_ranking_metrics(spark, root):
    """Precision and recall of the best scored rows; only these are ranked."""
    rows = table(spark, root, SNAPSHOTS).where("decision_score IS NOT NULL").select("id", F.col("decision_score").cast("double").alias("s"), (F.col("recommendation") != "ignorar").cast("int").alias("y"))
    return relational.precision_recall_at(rows, "s", "y", "id")


@query("""WITH s AS (SELECT CAST(decision_score AS DOUBLE) AS s, CASE WHEN recommendation = 'ignorar' THEN 0 ELSE 1 END AS y FROM decision_opportunity_snapshots WHERE decision_score IS NOT NULL), g AS (SELECT s, count(*) AS n, sum(y) AS pos FROM s GROUP BY s), c AS (SELECT *, sum(n) OVER (ORDER BY s DESC) AS cn, sum(pos) OVER (ORDER BY s DESC) AS cp, sum(n) OVER () AS tn, sum(pos) OVER () AS tp FROM g)
SELECT round(sum(pos / tp * cp / cn), 6) AS average_precision, CAST(max(tn) AS BIGINT) AS n_rows, CAST(max(tp) AS BIGINT) AS positives FROM c""")
def L07_average_precision(spark, root):
    """Step-sum average precision of a score."""
    rows = table(spark, root, SNAPSHOTS).where("decision_score IS NOT NULL").select(F.col("decision_score").cast("double").alias("s"), (F.col("recommendation") != "ignorar").cast("int").alias("y"))
    return relational.average_precision(rows, "s", "y").withColumnRenamed("rows", "n_rows")


_PRIORITY = "CASE recommendation WHEN 'comprar_teste' THEN 1 WHEN 'revisar' THEN 2 ELSE 3 END"


@query(f"SELECT id, recommendation, CAST(decision_score AS DOUBLE) AS decision_score FROM decision_opportunity_snapshots ORDER BY {_PRIORITY}, decision_score DESC NULLS LAST, id LIMIT 100")
def O01_ranked_opportunities(spark, root):
    """The first hundred opportunities in display order (B01): a top-k report."""
    order = F.when(F.col("recommendation") == "comprar_teste", 1).when(F.col("recommendation") == "revisar", 2).otherwise(3)
    return table(spark, root, SNAPSHOTS).orderBy(order, F.desc_nulls_last("decision_score"), "id").limit(100).select("id", "recommendation", F.col("decision_score").cast("double").alias("decision_score"))


@query("SELECT source_name, CASE source_name WHEN 'vitrino' THEN 10 WHEN 'compranu' THEN 20 ELSE 50 END AS priority, count(*) AS loads FROM source_runs GROUP BY source_name")
def O06_source_priority(spark, root):
    """Sources with a configured priority, 50 where none is set."""
    return table(spark, root, LOADS).groupBy("source_name").agg(F.count("*").alias("loads")).select("source_name", F.when(F.col("source_name") == "vitrino", 10).when(F.col("source_name") == "compranu", 20).otherwise(50).alias("priority"), "loads")


# --- sets, dates -----------------------------------------------------------------------------------------------


@query("""WITH d AS (SELECT CAST(generated_at AS DATE) AS date FROM decision_opportunity_snapshots UNION SELECT CAST(started_at AS DATE) FROM decision_engine_runs UNION SELECT CAST(finished_at AS DATE) FROM decision_engine_runs UNION SELECT CAST(started_at AS DATE) FROM source_runs UNION SELECT CAST(finished_at AS DATE) FROM source_runs)
SELECT CAST(strftime(date, '%Y%m%d') AS INTEGER) AS date_key, date, CAST(year(date) AS INTEGER) AS year, CAST(quarter(date) AS INTEGER) AS quarter, CAST(month(date) AS INTEGER) AS month, strftime(date, '%B') AS month_name, CAST(day(date) AS INTEGER) AS day, CAST(isodow(date) AS INTEGER) AS iso_weekday, isodow(date) IN (6, 7) AS is_weekend FROM d WHERE date IS NOT NULL""")
def U01_date_dimension(spark, root):
    """The calendar of all dates."""
    return warehouse.dates(spark, root)


@query("SELECT supplier_slug, row_number() OVER (ORDER BY supplier_slug) AS supplier_sk FROM (SELECT supplier_slug FROM supplier_products_normalized UNION SELECT supplier_slug FROM decision_opportunity_snapshots) WHERE supplier_slug IS NOT NULL")
def U02_supplier_dimension(spark, root):
    """Distinct suppliers with keys; display names (P07) are tested on fixtures."""
    return warehouse.suppliers(spark, root).select("supplier_slug", "supplier_sk")


@query(f"""WITH p AS (SELECT i.id, list_distinct(string_split({_NORM.format(c="i.title")}, ' ')) AS a, list_distinct(string_split({_NORM.format(c="p.product_name")}, ' ')) AS b FROM mercado_livre_items_raw i
  JOIN (SELECT product_id, product_name FROM mercado_livre_products_raw QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY fetched_at DESC, id DESC) = 1) p ON p.product_id = i.payload ->> '$.catalog_product_id' WHERE json_valid(i.payload) AND json_type(i.payload) = 'OBJECT')
SELECT id, len(list_intersect(a, b)) AS common, len(a) - len(list_intersect(a, b)) AS only_item, len(list_intersect(a, b)) = 0 AS disjoint, len(list_intersect(a, b)) = len(a) AS contained FROM p""")
def U06_set_algebra(spark, root):
    """Words of items against the words of their catalogue product: intersection, difference, disjoint, subset."""
    items = table(spark, root, "mercado_livre_items_raw").where(F.try_parse_json("payload").isNotNull() & F.ltrim("payload").startswith("{")).select("id", F.array_distinct(F.split(text.normalized(F.col("title")), " ")).alias("a"), F.get_json_object("payload", "$.catalog_product_id").alias("product_id"))
    names = relational.best_per_key(table(spark, root, "mercado_livre_products_raw").select("product_id", "product_name", "fetched_at", "id"), ["product_id"], [F.desc("fetched_at"), F.desc("id")]).select("product_id", F.array_distinct(F.split(text.normalized(F.col("product_name")), " ")).alias("b"))
    both = items.join(names, "product_id")
    common = F.size(F.array_intersect("a", "b"))
    return both.select("id", common.cast("bigint").alias("common"), F.size(F.array_except("a", "b")).cast("bigint").alias("only_item"), (~F.arrays_overlap("a", "b")).alias("disjoint"), (F.size(F.array_except("a", "b")) == 0).alias("contained"))


@query("SELECT id, CAST(round((epoch_us(coalesce(finished_at, started_at)) - epoch_us(started_at)) / 1000000.0) AS BIGINT) AS seconds, CAST(strftime(started_at, '%Y%m%d') AS INTEGER) AS date_key FROM decision_engine_runs")
def T05_run_seconds(spark, root):
    """Durations of engine runs in whole seconds."""
    return table(spark, root, RUNS).select("id", relational.seconds_between(F.col("started_at"), F.coalesce("finished_at", "started_at")).alias("seconds"), F.date_format("started_at", "yyyyMMdd").cast("int").alias("date_key"))


# --- scalar functions ------------------------------------------------------------------------------------------


@query("SELECT id, trim(regexp_replace(title, '[\\s\\x{00A0}\\x{2000}-\\x{200B}\\x{202F}\\x{3000}\\x{FEFF}]+', ' ', 'g')) AS title FROM market_web_listings_raw")
def H01_spaces(spark, root):
    return table(spark, root, LISTINGS).select("id", text.spaces(F.col("title")).alias("title"))


@query()
def H08_redecoded(spark, root):
    """Titles with their encoding damage undone; tested on fixtures."""
    return table(spark, root, LISTINGS).select("id", text.redecoded(F.col("title")).alias("title"))


@query(f"SELECT id, {_NORM.format(c='title')} AS title FROM market_web_listings_raw")
def H02_normalized(spark, root):
    return table(spark, root, LISTINGS).select("id", text.normalized(F.col("title")).alias("title"))


@query(f"""SELECT id, array_to_string(list_filter(t, lambda w: regexp_matches(w, '[0-9]')), ' ') AS model_tokens, len(t) <= 5 AND len(list_filter(t, lambda w: regexp_matches(w, '[0-9]'))) = 0
  AND len(list_filter(t, lambda w: NOT list_contains(['adaptador','audio','cabo','carregador','combo','controle','femea','fio','fone','gamer','hub','kit','macho','mouse','notebook','para','preto','sem','suporte','teclado','usb','video','wireless'], w))) <= 1 AS generic
 FROM (SELECT id, list_filter(e, lambda w, i: list_position(e, w) = i) AS t FROM (SELECT id, {_TOKENS} AS e FROM supplier_products_normalized))""")
def H03_tokens(spark, root):
    """Tokens without repeats in their order, model tokens and generic titles."""
    rows = table(spark, root, CATALOGUE).select("id", text.tokens(text.normalized(F.col("raw_title"))).alias("t"))
    return rows.select("id", F.array_join(text.model_tokens(F.col("t")), " ").alias("model_tokens"), text.is_generic_title(F.col("t")).alias("generic"))


@query("""SELECT id, CASE WHEN nullif(trim(ean), '') IS NOT NULL THEN left(supplier_slug || ':ean:' || trim(ean), 240) WHEN nullif(trim(sku), '') IS NOT NULL THEN left(supplier_slug || ':sku:' || trim(sku), 240)
 ELSE supplier_slug || ':title:' || left(sha256(supplier_slug || '|' || coalesce(raw_title, 'None') || '|' || coalesce(CAST(supplier_price AS VARCHAR), 'None')), 24) END AS product_key FROM supplier_products_normalized""")
def H05_product_keys(spark, root):
    return table(spark, root, CATALOGUE).select("id", text.product_key(F.col("supplier_slug"), F.col("ean"), F.col("sku"), F.col("raw_title"), F.col("supplier_price")).alias("product_key"))


@query("""SELECT id, CASE WHEN regexp_matches(lower(t), 'captcha|digite os caracteres|verifique que voce|verify you are|deslize para verificar|unusual traffic') THEN 'captcha' WHEN regexp_matches(lower(t), 'robo|robot|automated access|acesso automatizado') THEN 'bot_block'
 WHEN regexp_matches(lower(t), 'access denied|acesso negado|not authorized|unauthorized|nao e possivel acessar|não é possível acessar|erro 403|403 forbidden|request blocked') THEN 'access_denied' WHEN regexp_matches(lower(t), 'faca login|entre para continuar|sign in to continue') THEN 'login_wall' END AS reason FROM (SELECT doc_id AS id, text AS t FROM documents)""")
def H12_block_reasons(spark, root):
    """Why a page's text counts as blocked."""
    return table(spark, root, "documents").select(F.col("doc_id").alias("id"), text.block_reason(F.col("text")).alias("reason"))


@query("SELECT id, coalesce(block_reason IN ('empty_results', 'captcha', 'bot_block', 'access_denied') OR block_reason LIKE 'navigation_timeout%', false) AS retryable FROM market_web_listings_raw")
def H13_retryable(spark, root):
    return table(spark, root, LISTINGS).select("id", text.is_retryable(F.col("block_reason")).alias("retryable"))


@query("""SELECT id, TRY_CAST(replace(replace(regexp_extract(installments_text, 'R\\$\\s*([0-9.]+,\\d{2}|[0-9]+(?:[.,]\\d{2})?)', 1), '.', ''), ',', '.') AS DOUBLE) AS amount FROM market_web_listings_raw""")
def H20_brl_prices(spark, root):
    """Prices in text, with the parser's own reading of dots (H21 and H25 are tested on fixtures)."""
    return table(spark, root, LISTINGS).select("id", numbers.brl_price(F.col("installments_text")).alias("amount"))


_LOCAL = "TRY_CAST(CASE WHEN contains(x, ',') AND contains(x, '.') THEN replace(replace(x, '.', ''), ',', '.') WHEN regexp_full_match(x, '\\d+(?:\\.\\d{3})+') THEN replace(x, '.', '') ELSE replace(x, ',', '.') END AS DOUBLE)"


@query(f"""SELECT id, CAST(trunc({_LOCAL} * CASE WHEN m <> '' THEN 1000 ELSE 1 END) AS BIGINT) AS n FROM (SELECT id, regexp_extract(lower(bsr_text), '(\\d+(?:[.,]\\d+)?)\\s*(mil|k)?', 1) AS x, regexp_extract(lower(bsr_text), '(\\d+(?:[.,]\\d+)?)\\s*(mil|k)?', 2) AS m FROM market_web_listings_raw)""")
def H22_int_texts(spark, root):
    return table(spark, root, LISTINGS).select("id", numbers.int_text(F.col("bsr_text")).alias("n"))


@query(f"""SELECT id, CASE WHEN contains(t, 'vend') OR contains(t, 'sold') OR contains(t, 'compras') THEN CAST(trunc({_LOCAL} * CASE WHEN m <> '' THEN 1000 ELSE 1 END) AS BIGINT) END AS sold FROM (
 SELECT id, t, CASE WHEN h THEN regexp_extract(t, '(\\d[\\d.,]*)\\s*(mil|k)?\\+?\\s*vendid', 1) ELSE regexp_extract(t, '(\\d[\\d.,]*)\\s*(mil|k)?\\+?\\s+compras?', 1) END AS x, CASE WHEN h THEN regexp_extract(t, '(\\d[\\d.,]*)\\s*(mil|k)?\\+?\\s*vendid', 2) ELSE regexp_extract(t, '(\\d[\\d.,]*)\\s*(mil|k)?\\+?\\s+compras?', 2) END AS m
 FROM (SELECT id, lower(trim(regexp_replace(sold_quantity_text, '[\\s\\x{{00A0}}\\x{{2000}}-\\x{{200B}}\\x{{202F}}\\x{{3000}}\\x{{FEFF}}]+', ' ', 'g'))) AS t, regexp_matches(t, '(\\d[\\d.,]*)\\s*(mil|k)?\\+?\\s*vendid') AS h FROM market_web_listings_raw))""")
def H23_sold_quantities(spark, root):
    """Sold quantities as the collectors read them."""
    return table(spark, root, LISTINGS).select("id", numbers.sold_quantity(F.col("sold_quantity_text")).alias("sold"))


@query("SELECT id, CAST(price AS DOUBLE) AS amount, CAST(trunc(CAST(price AS DOUBLE)) AS BIGINT) AS whole, coalesce(printf('%.2f', CAST(price AS DOUBLE)), '') AS money, coalesce(is_full, false) AS is_full FROM market_web_listings_raw")
def H26_conversions(spark, root):
    """Text to number, integer and flag, and back to money text."""
    amount = numbers.to_double(F.concat(F.lit("R$ "), F.translate(F.col("price").cast("string"), ".", ",")))
    return table(spark, root, LISTINGS).select("id", amount.alias("amount"), amount.cast("bigint").alias("whole"), numbers.money(amount).alias("money"), numbers.to_flag(F.when(F.col("is_full"), "Sim").when(~F.col("is_full"), "nao")).alias("is_full"))


@query("SELECT id, CASE WHEN r <= 5 THEN r END AS rating FROM (SELECT id, TRY_CAST(replace(regexp_extract(rating_text, '([0-5](?:[.,]\\d)?)', 1), ',', '.') AS DOUBLE) AS r FROM market_web_listings_raw)")
def H29_ratings(spark, root):
    return table(spark, root, LISTINGS).select("id", numbers.rating(F.col("rating_text")).alias("rating"))


@query("SELECT id, regexp_replace(trim(item_url), '[?#].*$', '') AS url, sha256(payload) AS digest, sha256(payload) = payload_hash AS agrees FROM market_web_listings_raw")
def H40_hashes(spark, root):
    """Bare URLs and payload digests."""
    digest = F.sha2("payload", 256)
    return table(spark, root, LISTINGS).select("id", numbers.bare_url(F.col("item_url")).alias("url"), digest.alias("digest"), (digest == F.col("payload_hash")).alias("agrees"))


@query("""SELECT id, CASE WHEN json_type(payload, '$.attributes') = 'ARRAY' THEN list_filter(from_json(json_extract(payload, '$.attributes'), '["JSON"]'), lambda a: a ->> '$.id' = 'BRAND')[1] ->> '$.value_name' END AS brand,
 CASE WHEN json_type(payload, '$.pictures') = 'ARRAY' THEN payload ->> '$.pictures[0].url' END AS first_picture FROM mercado_livre_products_raw WHERE json_valid(payload) AND json_type(payload) = 'OBJECT'""")
def H42_attributes(spark, root):
    """First attribute of an id and first picture of product payloads."""
    rows = table(spark, root, "mercado_livre_products_raw").where(F.try_parse_json("payload").isNotNull() & F.ltrim("payload").startswith("{"))
    raw, pictures = F.get_json_object("payload", "$.attributes"), F.variant_get(F.try_parse_json("payload"), "$.pictures", "variant")
    is_list = F.schema_of_variant(F.variant_get(F.try_parse_json("payload"), "$.attributes", "variant")).startswith("ARRAY")
    brand = F.try_element_at(F.filter(F.from_json(raw, "array<string>"), lambda a: F.get_json_object(a, "$.id") == "BRAND"), F.lit(1))
    return rows.select("id", F.when(is_list, F.get_json_object(brand, "$.value_name")).alias("brand"), F.when(F.schema_of_variant(pictures).startswith("ARRAY"), F.get_json_object("payload", "$.pictures[0].url")).alias("first_picture"))


@query("SELECT id, coalesce(CAST(epoch_us(coalesce(fetched_at, created_at)) AS VARCHAR), '') AS fetched FROM market_web_listings_raw")
def H33_timestamp_fallback(spark, root):
    """The time of a row, or of its creation, or empty text."""
    return table(spark, root, LISTINGS).select("id", F.coalesce(F.unix_micros(F.coalesce("fetched_at", "created_at")).cast("string"), F.lit("")).alias("fetched"))


@query("SELECT DISTINCT query, replace('https://loja.example/busca?q={query}', '{query}', replace(url_encode(query), '%20', '+')) AS url FROM market_web_listings_raw WHERE query IS NOT NULL")
def H34_search_urls(spark, root):
    return table(spark, root, LISTINGS).where("query IS NOT NULL").select("query").distinct().select("query", numbers.search_url("https://loja.example/busca?q={query}", F.col("query")).alias("url"))


_AT = "' ' || " + _NORM.format(c="raw_title") + " || ' '"
_HAS = lambda table_: "array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(p, ' ({'|'.join(terms)}) ') THEN '{name}' END" for name, terms in table_.items()) + "], lambda x: x IS NOT NULL), ',')"
_RE = lambda table_: "array_to_string(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(p, '{pattern}') THEN '{name}' END" for name, pattern in table_.items()) + "], lambda x: x IS NOT NULL), ',')"
_ALL = lambda pattern: f"array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(p, '{pattern}', 1), lambda x: replace(x, ' ', '')))), ',')"


@query(f"""SELECT id, {_HAS(attributes.COLOURS)} AS colors, {_RE(attributes.STORAGE)} AS storage, {_RE(attributes.CONNECTORS)} AS connectors, {_ALL(r"\b(\d+ ?(?:tb|gb|mb))\b")} AS capacities, {_ALL(r"\b(ddr[345])\b")} AS memory, {_ALL(r"\b(\d{2,4} ?w)\b")} AS watts
 FROM (SELECT id, {_AT} AS p FROM supplier_products_normalized)""")
def X01_attributes(spark, root):
    """Technical attributes of titles."""
    a = attributes.product_attributes(text.normalized(F.col("raw_title")))
    joined = lambda c: F.array_join(F.array_sort(c), ",")
    return table(spark, root, CATALOGUE).select("id", F.array_join(a["colors"], ",").alias("colors"), F.array_join(a["storage_interfaces"], ",").alias("storage"), F.array_join(a["connector_interfaces"], ",").alias("connectors"), joined(a["capacities"]).alias("capacities"), joined(a["memory_generations"]).alias("memory"), joined(a["power_watts"]).alias("watts"))


_LIST = lambda pattern, group=1: f"list_transform(regexp_extract_all(p, '{pattern}', {group}), lambda x: replace(x, ' ', ''))"
_SORTED = lambda list_: f"array_to_string(list_sort(list_distinct({list_})), ',')"


@query(f"""SELECT id, {_SORTED("list_concat(CASE WHEN regexp_matches(p, ' bivolt ') THEN ['bivolt'] ELSE [] END, " + _LIST(r"\b(110 ?v|127 ?v|220 ?v)\b") + ")")} AS volts,
 CASE WHEN regexp_matches(p, ' (mousepad|mouse pad) ') THEN array_to_string(list_filter(string_split({_HAS(attributes.TYPES)}, ','), lambda x: x <> 'mouse'), ',') ELSE {_HAS(attributes.TYPES)} END AS types,
 {_SORTED("list_concat(" + _LIST(r"\b(?:kit|pack|pacote|combo) ?(?:com|de)? ?(\d{{1,3}})\b".replace("{{", "{").replace("}}", "}")) + ", " + _LIST(r"\b(\d{{1,3}}) ?(?:pecas|pcs|unidades|un)\b".replace("{{", "{").replace("}}", "}")) + ")")} AS packs FROM (SELECT id, {_AT} AS p FROM supplier_products_normalized)""")
def X03_types(spark, root):
    """Product types, voltages and pack quantities (X03, X08, X10) of all titles; X11 is tested on fixtures."""
    a = attributes.product_attributes(text.normalized(F.col("raw_title")))
    joined = lambda c: F.array_join(F.array_sort(c), ",")
    return table(spark, root, CATALOGUE).select("id", joined(a["voltages"]).alias("volts"), F.array_join(a["product_types"], ",").alias("types"), joined(a["pack_quantities"]).alias("packs"))


@query()
def X12_conflicts(spark, root):
    """Attribute conflicts of marketplace items with their catalogue product, and the penalty they bring."""
    items = table(spark, root, "mercado_livre_items_raw").select("id", "title", F.get_json_object("payload", "$.catalog_product_id").alias("product_id"))
    names = relational.best_per_key(table(spark, root, "mercado_livre_products_raw").select("product_id", "product_name", "fetched_at", "id"), ["product_id"], [F.desc("fetched_at"), F.desc("id")]).select("product_id", "product_name")
    described = lambda c: F.struct(*(v.alias(n) for n, v in attributes.product_attributes(text.normalized(F.col(c))).items()))
    pairs = items.join(names, "product_id").select("id", described("title").alias("a"), described("product_name").alias("b"))
    found = pairs.select("id", attributes.conflicts(F.col("a"), F.col("b")).alias("conflicts"))
    return found.select("id", "conflicts", attributes.conflict_penalty(F.col("conflicts")).alias("penalty"))


# --- matching --------------------------------------------------------------------------------------------------


def _sides(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    products = relational.best_per_key(table(spark, root, CATALOGUE).where("supplier_price > 0").select("id", "raw_title", "supplier_price", "supplier_slug", "source_product_key", "fetched_at"), ["supplier_slug", "source_product_key"], [F.desc_nulls_last("fetched_at"), F.desc("id")])
    goods = evidence(spark, root).select(F.concat_ws("/", "source_order", "id").alias("id"), "title", "price")
    return matching.described(products, "id", "raw_title", "supplier_price"), matching.described(goods, "id", "title", "price")


_SIDE = lambda source, title: "list_distinct(" + _TOKENS.replace("raw_title", title) + ")"


@query(f"""WITH p AS (SELECT id, {_SIDE('p', 'raw_title')} AS t FROM supplier_products_normalized WHERE supplier_price > 0 QUALIFY row_number() OVER (PARTITION BY supplier_slug, source_product_key ORDER BY fetched_at DESC NULLS LAST, id DESC) = 1),
e AS (SELECT source_order, id, {_SIDE('e', 'title')} AS t FROM ({_EVIDENCE})),
pt AS (SELECT id, unnest(t) AS token FROM p), et AS (SELECT source_order, id, unnest(t) AS token FROM e), n AS (SELECT token FROM et GROUP BY token HAVING count(*) <= greatest(120, (SELECT count(*) FROM e WHERE len(t) > 0) // 4))
SELECT pt.id AS p_key, max(c) AS best_overlap, count(*) AS partners FROM (SELECT pt.id, et.source_order, et.id AS e, count(*) AS c FROM pt JOIN n USING (token) JOIN et USING (token) GROUP BY ALL) pt GROUP BY pt.id""")
def J08_token_overlap(spark, root):
    """The token-blocked join with all evidence, before its cut: best overlap and number of partners of each product."""
    left, right = _sides(spark, root)
    left = matching.numbered(left)
    best = matching.partner_counts(left, written(matching.titles_of(right), "titles"))
    return best.join(left.select("p_id", F.col("key").alias("p_key")), "p_id").select("p_key", "best_overlap", "partners")


@query()
def G03_best_matches(spark, root):
    """Fuzzy matches of supplier products to listings, price history and marketplace items."""
    return matching.matches(*_sides(spark, root))


@query()
def G04_price_levels(spark, root):
    """Price level, count and dispersion of each product's qualified matches."""
    return matching.price_levels(matching.matches(*_sides(spark, root)))


@query()
def P12_match_details(spark, root):
    """The best twelve matches of each product as JSON."""
    return matching.match_details(matching.matches(*_sides(spark, root)))


# --- sinks and reports -----------------------------------------------------------------------------------------


@query("""WITH m AS (SELECT id, source_name, query, payload_hash, fetched_date, created_at FROM market_web_listings_raw)
SELECT id, source_name FROM m WHERE source_name IS NULL OR query IS NULL OR payload_hash IS NULL OR fetched_date IS NULL UNION ALL
SELECT id, source_name FROM (SELECT * FROM m WHERE query IS NOT NULL AND payload_hash IS NOT NULL AND fetched_date IS NOT NULL AND source_name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source_name, query, payload_hash, fetched_date ORDER BY created_at, id) = 1)""")
def K01_append_ignore(spark, root):
    """Rows that the unique key of the listings lets in, first come first served; NULL keys never conflict."""
    rows = table(spark, root, LISTINGS).select("id", "source_name", "query", "payload_hash", "fetched_date", "created_at")
    return sinks.first_of_key(rows, ["source_name", "query", "payload_hash", "fetched_date"], [F.col("created_at"), F.col("id")]).select("id", "source_name")


@query("""WITH k AS (SELECT s.id, s.supplier_product_id, s.decision_run_id, r.started_at FROM decision_opportunity_snapshots s JOIN decision_engine_runs r ON r.id = s.decision_run_id)
SELECT supplier_product_id, id FROM k QUALIFY row_number() OVER (PARTITION BY supplier_product_id ORDER BY started_at DESC, id DESC) = 1""")
def K05_upserted_current(spark, root):
    """The current table after every run was upserted in order: later runs replace earlier rows."""
    runs = table(spark, root, RUNS).select(F.col("id").alias("decision_run_id"), "started_at")
    rows = table(spark, root, SNAPSHOTS).select("id", "supplier_product_id", "decision_run_id").join(runs, "decision_run_id")
    return relational.best_per_key(rows, ["supplier_product_id"], [F.desc("started_at"), F.desc("id")]).select("supplier_product_id", "id")


@query("""SELECT id, coalesce(replace(CAST(supplier_price AS VARCHAR), '.', ','), '') AS supplier_price, coalesce(array_to_string(risk_flags, ' | '), '') AS risk_flags, coalesce(recommendation, '') AS recommendation, coalesce(CAST(market_offer_count AS VARCHAR), '') AS market_offer_count FROM decision_opportunity_snapshots""")
def K14_extract_format(spark, root):
    """Opportunities in the format of the BI extracts."""
    rows = table(spark, root, SNAPSHOTS).select("id", "supplier_price", "risk_flags", "recommendation", "market_offer_count")
    return rows.select(*sinks.extract_columns(rows))


@query("""SELECT s.id, s.source_name, s.status, coalesce(s.records_extracted, 0) AS records_extracted, CAST(s.started_at AS DATE) AS day FROM source_runs s ORDER BY s.started_at DESC, s.id LIMIT 10000""")
def B04_load_extract(spark, root):
    """The newest ten thousand loads: the extract's own limit (B05, B07 alike)."""
    return table(spark, root, LOADS).orderBy(F.desc("started_at"), "id").limit(10_000).select("id", "source_name", "status", F.coalesce("records_extracted", F.lit(0)).alias("records_extracted"), F.to_date("started_at").alias("day"))


@query("""SELECT CAST(started_at AS DATE) AS day, source_name, count(*) AS loads, CAST(sum(records_loaded) AS BIGINT) AS loaded, round(avg(date_diff('microsecond', started_at, finished_at) / 1000000.0), 2) AS mean_seconds, count(*) FILTER (WHERE finished_at IS NULL) AS unfinished FROM source_runs GROUP BY ALL""")
def R04_collection_report(spark, root):
    """Loads per day and source (R01, A04): counts, rows, mean duration, unfinished ones."""
    seconds = (F.unix_micros("finished_at") - F.unix_micros("started_at")) / 1_000_000
    return table(spark, root, LOADS).groupBy(F.to_date("started_at").alias("day"), "source_name").agg(F.count("*").alias("loads"), F.sum("records_loaded").alias("loaded"), F.round(F.avg(seconds), 2).alias("mean_seconds"), F.count_if(F.col("finished_at").isNull()).alias("unfinished"))


@query("""SELECT source_name, records_loaded > 0 AS any_loaded, CASE WHEN status = 'failed' THEN 'failed' WHEN records_loaded > 0 THEN 'passed' ELSE 'warning' END AS outcome, count(*) AS loads FROM source_runs GROUP BY ALL""")
def R05_quality_checks(spark, root):
    """The quality check of each load, counted by outcome."""
    outcome = F.when(F.col("status") == "failed", "failed").when(F.col("records_loaded") > 0, "passed").otherwise("warning")
    return table(spark, root, LOADS).groupBy("source_name", (F.col("records_loaded") > 0).alias("any_loaded"), outcome.alias("outcome")).agg(F.count("*").alias("loads"))


# --- classifier ------------------------------------------------------------------------------------------------


@query("""SELECT CASE recommendation WHEN 'comprar_teste' THEN 2 WHEN 'revisar' THEN 1 ELSE 0 END AS class, count(*) AS n_rows FROM decision_opportunity_snapshots GROUP BY 1""")
def L01_class_counts(spark, root):
    """Labels and classes of all snapshots."""
    return ml.class_counts(ml.feature_rows(table(spark, root, SNAPSHOTS)))


_NUMBERS = "supplier_price estimated_market_price estimated_net_profit net_margin_pct total_fee_pct market_offer_count market_source_count price_history_count mercado_livre_count demand_score match_confidence".split()


@query(f"""SELECT id, {', '.join(f'coalesce(CAST({c} AS DOUBLE), 0) AS {c}' for c in _NUMBERS)}, CAST(coalesce(len(risk_flags), 0) AS DOUBLE) AS risk_flag_count, CAST(coalesce(estimated_market_price, 0) > 0 AS DOUBLE) AS has_market_price, CAST(coalesce(net_margin_pct, 0) > 0 AS DOUBLE) AS has_positive_margin,
 CAST(coalesce(market_source_count, 0) >= 2 AS DOUBLE) AS has_multiple_market_sources, CAST(coalesce(price_history_count, 0) > 0 AS DOUBLE) AS has_price_history, CASE confidence_level WHEN 'alta' THEN 1.0::DOUBLE WHEN 'media' THEN 0.8::DOUBLE ELSE 0.5::DOUBLE END AS weight FROM decision_opportunity_snapshots""")
def P13_features(spark, root):
    """All sixteen features and the teacher weight of all snapshots."""
    return ml.feature_rows(table(spark, root, SNAPSHOTS)).drop("class", "label")


@query()
def L04_out_of_fold(spark, root):
    """Out-of-fold scores of the latest opportunities by logistic regression."""
    rows = ml.training_rows(written(ml.with_folds(ml.latest_feature_rows(table(spark, root, SNAPSHOTS)), 3), "features"))
    return ml.out_of_fold(rows, ml.candidates()["logistic_regression"], 3)


@query()
def L03_candidates(spark, root):
    """All four candidates out of fold, and which one is chosen (L07, L08). Twenty trees or rounds instead of 180 to 300: the sizes of the library's defaults take minutes."""
    rows = ml.training_rows(written(ml.with_folds(ml.latest_feature_rows(table(spark, root, SNAPSHOTS)), 2), "features"))
    measured = ml.measured_candidates(rows, ml.candidates(trees=20, rounds=(20, 20)), 2)
    best = ml.select_model(measured)
    return spark.createDataFrame([(name, m["average_precision"], m["f1"], name == best) for name, m in measured.items()], "candidate string, average_precision double, f1 double, chosen boolean")


@query()
def S21_kept_model(spark, root):
    """A model fitted without the rows held out (L05), kept, loaded again, and the scores it gives all rows."""
    from pyspark.ml import Pipeline

    rows = ml.training_rows(written(ml.with_holdout(ml.latest_feature_rows(table(spark, root, SNAPSHOTS))), "features"))
    path = scratch(spark, "model")
    ml.save_model(Pipeline(stages=ml.candidates()["logistic_regression"]).fit(ml.bounded(rows.where("NOT held"))), path)
    return ml.scored_by(path, rows)
