"""Queries of the general problems 1, 4, 5, 6 and 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercanta.operators import nested, profile, snapshots, spikes, units
from mercanta.runtime import table

LISTINGS = "market_web_listings_raw"


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """Loads of market listings with an issue in blocked, reviews_count or rating_text."""
    df = table(spark, root, LISTINGS)
    checked = profile.profile(df, F.col("source_name"), F.col("source_run_id"), profile.listing_checks(~F.col("blocked")))
    return profile.load_issues(checked)


def p1_profile(spark: SparkSession, root: str) -> DataFrame:
    """Every column of every load of market listings, measured against the other loads of its source."""
    df = table(spark, root, LISTINGS)
    return profile.profile(df, F.col("source_name"), F.col("source_run_id"), profile.all_checks(df, skip=("source_run_id", "source_name")))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    """Listings whose stated quantity differs from sold_quantity."""
    common = units.common_units(table(spark, root, LISTINGS), "id", "source_name", "sold_quantity_text", "sold_quantity")
    return common.where(~F.col("units_sold").eqNullSafe(F.col("quantity").cast("bigint"))).select(F.col("key").alias("id"), "units_sold")


def p4_readings(spark: SparkSession, root: str) -> DataFrame:
    """What each unit word and number format stands for in each source, and whether the data decide it."""
    return units.fit_units(units.parsed(table(spark, root, LISTINGS), "id", "source_name", "sold_quantity_text", "sold_quantity"))


def _price_readings(spark: SparkSession, root: str) -> DataFrame:
    listings = table(spark, root, LISTINGS).where(~F.col("blocked"))
    fields = F.explode(F.array(*(F.struct(F.lit(c).alias("field_name"), F.col(c).cast("double").alias("value")) for c in ("price", "old_price"))))
    listings = listings.select(F.lit(LISTINGS).alias("table_name"), "id", F.col("source_name").alias("source"), F.col("item_url").alias("series"), F.unix_micros("fetched_at").alias("at"), fields.alias("f")).select("table_name", "id", "source", "series", "at", "f.*", F.lit(False).alias("sticky"))
    history = table(spark, root, "price_history_raw").where(~F.col("blocked"))
    history = history.select(F.lit("price_history_raw").alias("table_name"), "id", F.col("source_name").alias("source"), F.col("product_key").alias("series"), F.unix_date("fetched_date").cast("bigint").alias("at"), F.lit("current_price").alias("field_name"), F.col("current_price").cast("double").alias("value"), F.lit(True).alias("sticky"))
    return listings.unionByName(history)


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    """Rows whose price, old_price or current_price jumps away, sticks or cannot be a price."""
    return spikes.implausible(_price_readings(spark, root)).select("table_name", "id", "field_name")


def p5_flags(spark: SparkSession, root: str) -> DataFrame:
    """What the model alone flags, before the definition has a say: kind of flag and probabilities."""
    return spikes.implausible(_price_readings(spark, root), exact=False).select("table_name", "id", "field_name", "flag", F.round("p_spike", 4).alias("p_spike"), F.round("p_stuck", 4).alias("p_stuck"))


def _runs(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "decision_engine_runs").where("status = 'success'").select(F.col("id").alias("snapshot"), F.col("started_at").alias("at"))


def _changes(spark: SparkSession, root: str) -> DataFrame:
    df = table(spark, root, "decision_opportunity_snapshots")
    rows = snapshots.latest_rows(df, "decision_run_id", "supplier_product_id", F.struct("generated_at", "id"), F.col("estimated_net_profit"))
    return snapshots.snapshot_changes(rows, _runs(spark, root))


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    """Opportunities added, removed or changed in profit since the successful run before."""
    return _changes(spark, root).select(F.col("snapshot").alias("decision_run_id"), F.col("key").alias("supplier_product_id"), "change_kind")


def p6_changes(spark: SparkSession, root: str) -> DataFrame:
    """The same changes with the profit before and after."""
    return _changes(spark, root).select(F.col("snapshot").alias("decision_run_id"), F.col("key").alias("supplier_product_id"), "change_kind", F.col("old_value").alias("old_profit"), F.col("new_value").alias("new_profit"))


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    """Every object in an array of the marketplace payloads, with the path of its parent."""
    return nested.payload_objects(spark, root, texts=False).select("source_table", "record_id", "parent_path", "object_path")


def p7_tables(spark: SparkSession, root: str) -> DataFrame:
    """The flat tables in long form: table, keys of record and parent, position and the object's own fields as JSON."""
    return nested.payload_objects(spark, root).select("source_table", "table_name", "record_id", "parent_path", "object_path", "position", "object")


QUERIES = {f.__name__: f for f in (p1_found, p1_profile, p4_found, p4_readings, p5_found, p5_flags, p6_found, p6_changes, p7_found, p7_tables)}

_SOLD_ORDER = """
WITH runs AS (SELECT id, row_number() OVER (ORDER BY started_at, id) AS step FROM decision_engine_runs WHERE status = 'success'),
kept AS (
  SELECT r.step, s.decision_run_id, s.supplier_product_id, s.estimated_net_profit AS profit
  FROM decision_opportunity_snapshots s JOIN runs r ON r.id = s.decision_run_id
  QUALIFY row_number() OVER (PARTITION BY s.decision_run_id, s.supplier_product_id ORDER BY s.generated_at DESC, s.id DESC) = 1),
pairs AS (
  SELECT coalesce(n.step, o.step + 1) AS step, coalesce(n.supplier_product_id, o.supplier_product_id) AS supplier_product_id,
         CASE WHEN o.step IS NULL THEN 'added' WHEN n.step IS NULL THEN 'removed' WHEN n.profit IS DISTINCT FROM o.profit THEN 'changed' END AS change_kind,
         o.profit AS old_profit, n.profit AS new_profit
  FROM kept n FULL JOIN kept o ON n.step = o.step + 1 AND n.supplier_product_id = o.supplier_product_id)
SELECT r.id AS decision_run_id, p.supplier_product_id, p.change_kind{more} FROM pairs p JOIN runs r ON r.step = p.step
WHERE p.change_kind IS NOT NULL AND p.step > 1"""

_LOAD_ISSUES = r"""
WITH m AS (SELECT source_name AS s, source_run_id AS r, blocked AS b, CAST(reviews_count AS DOUBLE) AS rc, rating_text AS rt, reviews_count BETWEEN 0 AND 1000000 AS ok FROM market_web_listings_raw),
l AS (SELECT s, r, avg(CAST(b AS INT)) AS bl, count(*) FILTER (WHERE NOT b) AS n, avg(CAST(rc IS NULL AS INT)) FILTER (WHERE NOT b) AS nrc, avg(CAST(rt IS NULL AS INT)) FILTER (WHERE NOT b) AS nrt,
  count(rc) FILTER (WHERE NOT b) AS vrc, count(rt) FILTER (WHERE NOT b) AS vrt, count(DISTINCT rc) FILTER (WHERE NOT b) AS drc, count(DISTINCT rt) FILTER (WHERE NOT b) AS drt,
  avg(CAST(NOT ok AS INT)) FILTER (WHERE NOT b AND rc IS NOT NULL) AS outside, avg(CAST(NOT regexp_full_match(rt, '{rating}') AS INT)) FILTER (WHERE NOT b AND rt IS NOT NULL) AS malformed,
  count(*) FILTER (WHERE NOT b AND ok) AS nok, median(rc) FILTER (WHERE NOT b AND ok) AS med FROM m GROUP BY s, r),
u AS (SELECT s, median(bl) AS ubl, median(nrc) AS unrc, median(nrt) AS unrt, median(med) AS umed FROM l GROUP BY s),
j AS (SELECT l.*, u.* EXCLUDE (s) FROM l JOIN u USING (s))
SELECT r AS source_run_id, 'blocked' AS column_name, 'distribution' AS issue FROM j WHERE bl - ubl > 0.4
UNION ALL SELECT r, 'reviews_count', 'nulls' FROM j WHERE n >= 8 AND nrc - unrc > 0.4 UNION ALL SELECT r, 'rating_text', 'nulls' FROM j WHERE n >= 8 AND nrt - unrt > 0.4
UNION ALL SELECT r, 'reviews_count', 'distinct' FROM j WHERE vrc >= 8 AND drc = 1 UNION ALL SELECT r, 'rating_text', 'distinct' FROM j WHERE vrt >= 8 AND drt = 1
UNION ALL SELECT r, 'reviews_count', 'range' FROM j WHERE n >= 8 AND outside > 0.35 UNION ALL SELECT r, 'rating_text', 'pattern' FROM j WHERE n >= 8 AND malformed > 0.35
UNION ALL SELECT r, 'reviews_count', 'distribution' FROM j WHERE nok >= 8 AND (med / umed >= 8 OR med / umed <= 0.125)""".replace("{rating}", profile.RATING.replace("(?i)^", "(?i)").rstrip("$"))

_UNITS = r"""
WITH t AS (SELECT id, sold_quantity, replace(replace(regexp_replace(lower(trim(sold_quantity_text)), '[\s\x{00A0}]+', ' ', 'g'), 'â½', '½'), '1⁄2', '½') AS t FROM market_web_listings_raw WHERE sold_quantity_text IS NOT NULL),
s AS (SELECT *, regexp_extract(t, '(\d[\d.,]*) ?(?:x|caixas?|cx|pcts?|fardos?|kits?)\b ?(?:c/|com|de|\()? ?(\d+)', ['n', 'i']) AS packed, regexp_extract(t, '(\d[\d.,]*\d|\d|½|\bmeia\b|\buma\b)\+? ?([a-zãâºúçµ]*)', ['n', 'w']) AS plain
  FROM t WHERE regexp_matches(t, 'vendid|vend\.|sold|vendas|compras') AND NOT regexp_matches(t, 'vendid[oa] (e entregue )?por|mais vendido|venda por|estoque|restam|lote')),
p AS (SELECT id, sold_quantity, CASE WHEN packed.n <> '' THEN packed.n ELSE plain.n END AS n, CASE WHEN packed.n <> '' THEN '' ELSE plain.w END AS w, CASE WHEN packed.n <> '' THEN TRY_CAST(packed.i AS DOUBLE) ELSE 1 END AS i FROM s),
f AS (SELECT *, CASE WHEN w IN ('mil', 'k', 'mlh') OR w LIKE 'milheiro%' THEN 1000 WHEN w IN ('mi', 'm') OR w LIKE 'milh%' THEN 1000000 WHEN w IN ('dz', 'doz') OR regexp_matches(w, '^d.{1,2}zia') THEN 12 WHEN w IN ('pares', 'par', 'prs') THEN 2 WHEN w = 'ct' OR w LIKE 'cento%' THEN 100 WHEN w LIKE 'grosa%' THEN 144 ELSE 1 END AS factor FROM p WHERE n <> ''),
v AS (SELECT id, sold_quantity, CAST(round(factor * i * CASE WHEN n IN ('½', 'meia') THEN 0.5 WHEN n = 'uma' THEN 1 WHEN factor = 1 AND regexp_full_match(n, '\d{1,3}([.,]\d{3})+') THEN TRY_CAST(replace(replace(n, '.', ''), ',', '') AS DOUBLE) ELSE TRY_CAST(replace(n, ',', '.') AS DOUBLE) END) AS BIGINT) AS units_sold FROM f)
SELECT id, units_sold FROM v WHERE units_sold IS DISTINCT FROM sold_quantity"""



def _off(x: str, before: str, after: str) -> str:
    """SQL: the sign of x where it is off both levels by more than six steps and 2 %, else 0."""
    least = f"least(abs({x} - {before}), abs({x} - {after}))"
    return f"(CASE WHEN ({x} - {before}) * ({x} - {after}) > 0 AND {least} > 6 * mad AND abs(exp(sign({x} - {before}) * {least}) - 1) >= 0.02 THEN sign({x} - {before}) ELSE 0 END)"


def _level(*names: str) -> str:
    """SQL: the median of up to three values, NULL where fewer than two are there."""
    listed = f"list_filter([{', '.join(names)}], lambda q: q IS NOT NULL)"
    return f"CASE WHEN len({listed}) >= 2 THEN list_aggregate({listed}, 'median') END"


_JUMPS = f"""
WITH r AS (
  SELECT 'market_web_listings_raw' AS table_name, id, 'price' AS field_name, source_name AS s, item_url AS k, epoch_us(fetched_at) AS a, CAST(price AS DOUBLE) AS v FROM market_web_listings_raw WHERE NOT blocked AND price IS NOT NULL AND item_url IS NOT NULL
  UNION ALL SELECT 'market_web_listings_raw', id, 'old_price', source_name, item_url, epoch_us(fetched_at), CAST(old_price AS DOUBLE) FROM market_web_listings_raw WHERE NOT blocked AND old_price IS NOT NULL AND item_url IS NOT NULL
  UNION ALL SELECT 'price_history_raw', id, 'current_price', source_name, product_key, epoch_us(CAST(fetched_date AS TIMESTAMP)), CAST(current_price AS DOUBLE) FROM price_history_raw WHERE NOT blocked AND current_price IS NOT NULL AND product_key IS NOT NULL),
u AS (SELECT field_name, s, k, a, min(v) AS v, ln(min(v)) AS x FROM r WHERE v > 0.01 AND v < 1000000 GROUP BY ALL),
w AS (SELECT *, lag(v) OVER o AS v1, {', '.join(f'lag(x, {i}) OVER o AS b{i}, lead(x, {i}) OVER o AS a{i}' for i in (1, 2, 3, 4))} FROM u WINDOW o AS (PARTITION BY field_name, s, k ORDER BY a)),
m AS (SELECT field_name, s, median(abs(x - b1)) AS mad, avg(CAST(v = v1 AS INT)) AS repeats FROM w WHERE v1 IS NOT NULL GROUP BY ALL),
l AS (SELECT w.*, mad, repeats, {_level('b1', 'b2', 'b3')} AS lb, {_level('a1', 'a2', 'a3')} AS la1, {_level('a2', 'a3', 'a4')} AS la2, sum(CASE WHEN v = v1 THEN 0 ELSE 1 END) OVER (PARTITION BY field_name, s, k ORDER BY a) AS run FROM w JOIN m USING (field_name, s)),
h AS (SELECT *, coalesce({_off('x', 'lb', 'la1')} <> 0 AND {_off('b1', 'lb', 'la1')} <> {_off('x', 'lb', 'la1')} AND {_off('a1', 'lb', 'la1')} <> {_off('x', 'lb', 'la1')}, false) AS one,
  coalesce({_off('x', 'lb', 'la2')} <> 0 AND {_off('a1', 'lb', 'la2')} = {_off('x', 'lb', 'la2')} AND {_off('b1', 'lb', 'la2')} <> {_off('x', 'lb', 'la2')} AND {_off('a2', 'lb', 'la2')} <> {_off('x', 'lb', 'la2')}, false) AS two,
  field_name = 'current_price' AND repeats < 0.3 AND count(*) OVER (PARTITION BY field_name, s, k, run) >= 8 AS stuck FROM l),
c AS (SELECT field_name, s, k, a FROM (SELECT *, one OR two OR stuck OR coalesce(lag(two) OVER (PARTITION BY field_name, s, k ORDER BY a), false) AS hit FROM h) WHERE hit)
SELECT table_name, id, field_name FROM r WHERE v <= 0.01 OR v >= 1000000
UNION ALL SELECT r.table_name, r.id, r.field_name FROM r JOIN c USING (field_name, s, k, a) WHERE r.v > 0.01 AND r.v < 1000000"""

_ARRAY_OBJECTS = """
WITH RECURSIVE raw AS (SELECT 'mercado_livre_products_raw' AS source_table, id, payload FROM mercado_livre_products_raw UNION ALL SELECT 'mercado_livre_items_raw', id, payload FROM mercado_livre_items_raw),
parsed AS (SELECT source_table, id, CAST(payload AS JSON) AS j FROM raw WHERE json_valid(payload)),
node AS (
  SELECT source_table, id, '' AS path, '' AS way, '' AS parent, false AS element, CASE WHEN json_type(j) = 'VARCHAR' THEN CASE WHEN json_valid(j->>'$') THEN CAST(j->>'$' AS JSON) END ELSE j END AS j FROM parsed
  UNION ALL
  SELECT source_table, id, path, way, parent, element, CASE WHEN declared AND json_type(v) = 'OBJECT' THEN json_array(v) ELSE v END FROM (
    SELECT *, CASE WHEN declared AND json_type(j) = 'VARCHAR' AND json_valid(j->>'$') THEN CAST(j->>'$' AS JSON) ELSE j END AS v FROM (
      SELECT *, NOT element AND way IN ('attributes', 'attributes.values', 'pictures', 'pictures.sizes') OR NOT element AND CASE source_table
        WHEN 'mercado_livre_products_raw' THEN way IN ('main_features', 'pickers', 'pickers.products', 'pickers.products.thumbs', 'pickers.products.thumbs.sizes', 'buy_box_winner.sale_terms', 'buy_box_winner.sale_terms.values')
        ELSE way IN ('seller.reputation.periods', 'shipping.options', 'shipping.options.estimates', 'variations', 'variations.attribute_combinations', 'variations.attribute_combinations.values', 'variations.sale_terms', 'variations.sale_terms.values') END AS declared
      FROM (
        SELECT source_table, id, s.i IS NOT NULL AS element, CASE WHEN s.i IS NOT NULL THEN path || '[' || s.i || ']' WHEN path = '' THEN s.k ELSE path || '.' || s.k END AS path,
          CASE WHEN s.i IS NOT NULL THEN way WHEN way = '' THEN s.k ELSE way || '.' || s.k END AS way, CASE WHEN up AND kind = 'OBJECT' THEN path ELSE parent END AS parent,
          json_extract(j, CASE WHEN s.i IS NOT NULL THEN '$[' || s.i || ']' ELSE '$."' || s.k || '"' END) AS j
        FROM (SELECT source_table, id, path, way, parent, element AS up, j, json_type(j) AS kind, unnest(CASE json_type(j) WHEN 'OBJECT' THEN [{'k': k, 'i': NULL::BIGINT} for k in json_keys(j)] WHEN 'ARRAY' THEN [{'k': NULL::VARCHAR, 'i': i} for i in range(json_array_length(j)::BIGINT)] END) AS s FROM node WHERE json_type(j) IN ('OBJECT', 'ARRAY'))))))
SELECT source_table, id AS record_id, parent AS parent_path, path AS object_path FROM node WHERE element AND json_type(j) = 'OBJECT'"""

ORACLE = {
    "p7_found": _ARRAY_OBJECTS,
    "p5_found": _JUMPS,
    "p1_found": _LOAD_ISSUES,
    "p4_found": _UNITS.replace("\\\\", "\\"),
    "p6_found": _SOLD_ORDER.format(more=""),
    "p6_changes": _SOLD_ORDER.format(more=", p.old_profit, p.new_profit"),
}
