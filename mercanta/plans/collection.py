"""Queries of the reference's sources, sinks and reports, run over whole tables by way of what they read or write.

Pages, files and events are made of the tables' rows, read with the library's readers, and compared with plain SQL
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercanta.functions import attributes, numbers, text
from mercanta.operators import relational
from mercanta.plans.reference import _NORM, _OFFER_SQL, _offers
from mercanta.runtime import read_text, scratch, small_rows, table, written
from mercanta.sources import readers, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
LISTINGS, HISTORY, CATALOGUE, SNAPSHOTS, RUNS, LOADS, ITEMS = "market_web_listings_raw", "price_history_raw", "supplier_products_normalized", "decision_opportunity_snapshots", "decision_engine_runs", "source_runs", "mercado_livre_items_raw"


def query(sql: str | None = None):
    """Register a query under its function's name, with its oracle."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


# --- files -----------------------------------------------------------------------------------------------------


@query("SELECT id, source_name, title, CAST(price AS VARCHAR) AS price, CAST(position AS VARCHAR) AS position, CAST(NULL AS VARCHAR) AS absent FROM market_web_listings_raw")
def S02_csv_strings(spark, root):
    """Listings written as text with a fixed list of fields (K13) and scanned again, every column as text."""
    path = scratch(spark, "listings-csv")
    sinks.write_fields(table(spark, root, LISTINGS), ["id", "source_name", "title", "price", "position", "absent"], path)
    return readers.read_csv_strings(spark, path)


@query("SELECT sku, raw_title AS title, supplier_price AS price FROM supplier_products_normalized WHERE nullif(trim(sku), '') IS NOT NULL AND nullif(trim(raw_title), '') IS NOT NULL")
def S03_catalogue_rows(spark, root):
    """The catalogue in a supplier's own layout, and the rows that have a reference and a description."""
    rows = table(spark, root, CATALOGUE).select(F.col("sku").alias("reference"), F.col("raw_title").alias("description"), F.col("supplier_price").cast("double").alias("price"), F.lit("Acima de 20 un").alias("stock_text"), "source_url")
    path = scratch(spark, "catalogue")
    rows.write.json(path)
    read = readers.catalogue_b_rows(spark.read.schema(readers.CATALOGUE_B).json(path, mode="FAILFAST"))
    # the reader makes spaces single; the title as it came is joined back by reference, price and that form
    own = rows.select(F.col("reference").alias("sku"), "description", text.spaces(F.col("description")).alias("raw_title"), F.when(F.col("price") >= 0, F.col("price").cast("decimal(12,2)")).alias("raw_price"))
    numbered = lambda df: df.groupBy("sku", "raw_title", "raw_price").agg(F.count("*").alias("n"))
    both = numbered(read).alias("a").join(numbered(own).alias("b"), F.col("a.sku").eqNullSafe(F.col("b.sku")) & F.col("a.raw_title").eqNullSafe(F.col("b.raw_title")) & F.col("a.raw_price").eqNullSafe(F.col("b.raw_price")) & (F.col("a.n") == F.col("b.n")))
    kept = both.select(F.col("a.sku").alias("sku"), F.col("a.raw_title").alias("raw_title"), F.col("a.raw_price").alias("raw_price"))
    o, k = own.alias("o"), kept.alias("k")
    return o.join(k, F.col("o.sku").eqNullSafe(F.col("k.sku")) & F.col("o.raw_title").eqNullSafe(F.col("k.raw_title")) & F.col("o.raw_price").eqNullSafe(F.col("k.raw_price"))).select("o.sku", F.col("o.description").alias("title"), F.col("o.raw_price").alias("price"))


@query("""SELECT id, coalesce(CAST(supplier_price AS VARCHAR), '') AS supplier_price, coalesce(array_to_string(risk_flags, ' | '), '') AS risk_flags, coalesce(recommendation, '') AS recommendation FROM (
 SELECT id, replace(CAST(supplier_price AS VARCHAR), '.', ',') AS supplier_price, risk_flags, recommendation FROM decision_opportunity_snapshots)""")
def K15_extract_file(spark, root):
    """The extract as a file with its manifest (K16): written, counted, and read again as text."""
    folder = scratch(spark, "extracts")
    rows = table(spark, root, SNAPSHOTS).select("id", "supplier_price", "risk_flags", "recommendation")
    manifest = sinks.write_extracts({"opportunities": rows}, folder)
    read = spark.read.csv(f"{folder}/opportunities", header=True, sep=";", escape='"', inferSchema=False).na.fill("")
    if manifest["rows"] != read.count() or '"rows"' not in (read_text(spark, f"{folder}/manifest.json") or ""):
        raise ValueError("the manifest doesn't say what was written")
    return read


@query("SELECT source_name, count(*) AS n_rows, count(DISTINCT id) AS ids FROM source_runs GROUP BY source_name")
def K20_replaced_table(spark, root):
    """A table rebuilt in versions (K19): replaced, upserted with half of its rows again, read through its pointer."""
    rows = table(spark, root, LOADS)
    stored = sinks.VersionedTable(spark, scratch(spark, "versions"))
    stored.replace(rows)
    stored.upsert(rows.where(F.pmod(F.xxhash64("id"), F.lit(2)) == 0), ["id"])
    return stored.read().groupBy("source_name").agg(F.count("*").alias("n_rows"), F.countDistinct("id").alias("ids"))


@query("""WITH m AS (SELECT id, source_name, query, payload_hash, fetched_date, created_at FROM market_web_listings_raw)
SELECT id, source_name FROM m WHERE source_name IS NULL OR query IS NULL OR payload_hash IS NULL OR fetched_date IS NULL UNION ALL
SELECT id, source_name FROM (SELECT * FROM m WHERE query IS NOT NULL AND payload_hash IS NOT NULL AND fetched_date IS NOT NULL AND source_name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source_name, query, payload_hash, fetched_date ORDER BY created_at, id) = 1)""")
def K02_stored_batches(spark, root):
    """Two batches, the earlier rows first, appended to a stored table that is partitioned by day; the second runs twice and adds nothing then."""
    rows = table(spark, root, LISTINGS).select("id", "source_name", "query", "payload_hash", "fetched_date", "created_at")
    ends = rows.agg(F.min("created_at").alias("a"), F.max("created_at").alias("b")).select(F.timestamp_micros(((F.unix_micros("a") + F.unix_micros("b")) / 2).cast("bigint")).alias("middle"))
    rows = written(rows.join(F.broadcast(ends)), "rows")  # one row
    path, key, order = scratch(spark, "listings"), ["source_name", "query", "payload_hash", "fetched_date"], [F.col("created_at"), F.col("id")]
    late = rows.where("created_at > middle").drop("middle")
    sinks.append_ignore(spark, path, rows.where("created_at <= middle").drop("middle"), key, order, day="fetched_date")
    sinks.append_ignore(spark, path, late, key, order, day="fetched_date")
    # rows with a NULL in the key never conflict, so only the others are sent again
    sinks.append_ignore(spark, path, late.where("query IS NOT NULL AND payload_hash IS NOT NULL AND source_name IS NOT NULL AND fetched_date IS NOT NULL"), key, order, day="fetched_date")
    return spark.read.parquet(path).select("id", "source_name")


# --- pages -----------------------------------------------------------------------------------------------------


@query(f"""WITH m AS (SELECT id, nullif({_NORM.format(c='title')}, '') AS title, nullif({_NORM.format(c='query')}, '') AS query, item_url FROM market_web_listings_raw)
SELECT id, 1 AS position, title, item_url FROM m UNION ALL SELECT id, 2, query, NULL FROM m""")
def S07_cards(spark, root):
    """Pages of two cards each, parsed by selectors: positions from 1, text and attributes of elements."""
    card = lambda title, link: F.concat(F.lit('<div class="card x"><h2 class="name">'), text.normalized(title), F.lit("</h2>"), F.coalesce(F.concat(F.lit('<a href="'), link, F.lit('">go</a>')), F.lit("")), F.lit("</div>"))
    pages = table(spark, root, LISTINGS).select("id", F.concat(F.lit("<html><body>"), card(F.col("title"), F.col("item_url")), card(F.col("query"), F.lit(None).cast("string")), F.lit("</body></html>")).alias("page"))
    cards = readers.html_cards(pages, "page", "id", "div.card", {"title": "h2.name", "item_url": "a@href"})
    return cards.select(F.col("page_key").alias("id"), "position", "title", "item_url")


@query("""SELECT id, CAST(CASE WHEN price >= 0 THEN price END AS DOUBLE) AS price, CAST(reviews_count AS BIGINT) AS reviews_count, is_sponsored, CASE WHEN blocked THEN 'captcha' END AS block_reason FROM (
 SELECT id, price, CASE WHEN reviews_count >= 0 THEN reviews_count END AS reviews_count, coalesce(is_sponsored, false) AS is_sponsored, blocked FROM market_web_listings_raw)""")
def S15_card_listings(spark, root):
    """Card texts read as listing columns: price (a negative one is no price text), review count, promotion marks, block reason."""
    rows = table(spark, root, LISTINGS)
    # a plain text of the row's own values; groups of three digits are marked as the sources mark them
    price = F.concat(F.lit("R$ "), F.translate(F.format_number(F.col("price").cast("double"), 2), ",.", ".,"))
    body = F.concat_ws(" ", F.when(F.col("is_sponsored"), "Patrocinado"), F.when(F.col("blocked"), "captcha"), F.when(F.col("reviews_count") >= 0, F.concat(F.lit("("), F.col("reviews_count").cast("string"), F.lit(")"))))
    cards = rows.select(F.col("id").alias("href"), F.lit(1).alias("position"), F.lit("Produto exemplo").alias("title_text"), price.alias("price_text"), body.alias("card_text"), F.lit(None).cast("string").alias("image_url"))
    out = readers.card_listings(cards, "x")
    return out.select(F.col("item_url").alias("id"), "price", "reviews_count", "is_sponsored", "block_reason")


@query("SELECT id, CAST(sold_quantity AS BIGINT) AS historical_sold, CAST(CASE WHEN reviews_count >= 0 THEN reviews_count END AS BIGINT) AS ratings, CAST(NULL AS BIGINT) AS liked FROM market_web_listings_raw WHERE sold_quantity IS NULL OR sold_quantity >= 0")
def H31_detail_values(spark, root):
    """Counts in the scripts of detail pages; ``null`` and absence are NULL."""
    rows = table(spark, root, LISTINGS).where("sold_quantity IS NULL OR sold_quantity >= 0")
    html = F.concat(F.lit('<script>{"historical_sold": '), F.coalesce(F.col("sold_quantity").cast("string"), F.lit("null")), F.lit(', "liked_count": null'), F.when(F.col("reviews_count") >= 0, F.concat(F.lit(', "total_rating_count" : '), F.col("reviews_count").cast("string"))).otherwise(F.lit("")), F.lit("}</script>"))
    v = readers.detail_values(html, F.lit(""))
    return rows.select("id", v["historical_sold"].alias("historical_sold"), v["total_rating_count"].alias("ratings"), v["liked_count"].alias("liked"))


@query("SELECT id, 1 AS position, title AS name, product_url AS url, CAST(current_price AS DOUBLE) AS price FROM price_history_raw")
def S17_search_hits(spark, root):
    """Hits in the embedded state of price-comparison search pages."""
    rows = table(spark, root, HISTORY)
    hit = F.struct(F.col("product_key").alias("id"), F.col("title").alias("name"), F.col("product_url").alias("url"), F.col("current_price").cast("double").alias("price"))
    state = F.to_json(F.struct(F.struct(F.struct(F.struct(F.struct(F.array(hit).alias("hits")).alias("hits")).alias("initialReduxState")).alias("pageProps")).alias("props")))
    pages = rows.select(F.col("id").alias("row_id"), F.concat(F.lit('<html><script id="__NEXT_DATA__" type="application/json">'), state, F.lit("</script></html>")).alias("page"))
    return readers.next_data_hits(pages, "page", ["row_id"]).select(F.col("row_id").alias("id"), "position", "name", "url", "price")


@query("SELECT id, title AS name, CAST(min_price AS DOUBLE) AS low_price, CAST(max_price AS DOUBLE) AS high_price, 3 AS offer_count FROM price_history_raw")
def S18_product_pages(spark, root):
    """Product pages with JSON-LD, the product one node of a graph."""
    rows = table(spark, root, HISTORY)
    offers = F.struct(F.col("min_price").cast("double").alias("lowPrice"), F.col("max_price").cast("double").alias("highPrice"), F.lit(3).alias("offerCount"))
    graph = F.to_json(F.struct(F.array(F.to_json(F.struct(F.lit("Thing").alias("@type"))), F.to_json(F.struct(F.lit("Product").alias("@type"), F.col("title").alias("name"), offers.alias("offers")))).alias("g")))
    nodes = F.array_join(F.from_json(F.get_json_object(graph, "$.g"), "array<string>"), ",")
    product = readers.json_ld_product(F.concat(F.lit('<script type="application/ld+json">{"@graph": ['), nodes, F.lit("]}</script>")))
    return rows.select("id", product.alias("p")).select("id", "p.*")


@query("""SELECT id, history_window_days AS window_days, CAST(avg_price AS DOUBLE) AS average_price, CASE WHEN current_price < avg_price THEN 'low' WHEN current_price > avg_price THEN 'high' ELSE 'usual' END AS price_state
FROM price_history_raw WHERE avg_price IS NOT NULL AND current_price IS NOT NULL""")
def H46_history_summaries(spark, root):
    """What pages say of their price history: days, average, and whether the price is low or high."""
    rows = table(spark, root, HISTORY).where("avg_price IS NOT NULL AND current_price IS NOT NULL")
    said = F.concat(F.lit("Nos últimos "), F.col("history_window_days").cast("string"), F.lit(" dias a média foi de R$ "), F.translate(F.format_number(F.col("avg_price").cast("double"), 2), ",.", ".,"), F.when(F.col("current_price") < F.col("avg_price"), ": preço está baixo").when(F.col("current_price") > F.col("avg_price"), ": preço está alto").otherwise(""))
    return rows.select("id", readers.history_summary(said).alias("s")).select("id", "s.*")


@query("""SELECT id, nullif(trim(regexp_replace(list_filter([title, shipping_text, seller_text], lambda x: regexp_matches(lower(x), 'frete|vendid'))[1], '[\\s\\x{00A0}\\x{2000}-\\x{200B}\\x{202F}\\x{3000}\\x{FEFF}]+', ' ', 'g')), '') AS line FROM (
 SELECT id, replace(title, chr(10), ' ') AS title, replace(shipping_text, chr(10), ' ') AS shipping_text, replace(seller_text, chr(10), ' ') AS seller_text FROM market_web_listings_raw)""")
def H10_lines(spark, root):
    """The first line of a card that holds one of the words."""
    one = lambda c: F.replace(F.col(c), F.lit("\n"), F.lit(" "))
    return table(spark, root, LISTINGS).select("id", text.line_with(F.concat_ws("\n", one("title"), one("shipping_text"), one("seller_text")), ["frete", "vendid"]).alias("line"))


@query("SELECT id, printf('%.2f', CAST(price AS DOUBLE)) AS money, CAST(price AS DOUBLE) AS plain, CAST(price AS DOUBLE) AS brazilian, coalesce(lower(trim(CAST(is_full AS VARCHAR))) = 'true', false) AS flag FROM market_web_listings_raw WHERE price IS NOT NULL")
def H27_number_texts(spark, root):
    """Numbers written as text in plain and in Brazilian form and read again."""
    rows = table(spark, root, LISTINGS).where("price IS NOT NULL")
    price = F.col("price").cast("double")
    brazilian = F.concat(F.lit("R$ "), F.translate(F.format_number(price, 2), ",.", ".,"))
    return rows.select("id", numbers.money(price).alias("money"), numbers.any_price(F.col("price").cast("string")).alias("plain"), numbers.any_price(brazilian).alias("brazilian"), numbers.to_flag(F.col("is_full").cast("string")).alias("flag"))


# --- items -----------------------------------------------------------------------------------------------------


@query("SELECT id, CASE WHEN json_type(payload, '$.pictures') = 'ARRAY' THEN payload ->> '$.pictures[0].url' END AS picture FROM mercado_livre_items_raw WHERE json_valid(payload) AND json_type(payload) = 'OBJECT' AND json_type(payload, '$.pictures') = 'ARRAY'")
def H43_first_pictures(spark, root):
    """The first picture of items whose pictures are a list."""
    items = table(spark, root, ITEMS).where(F.try_parse_json("payload").isNotNull() & F.ltrim("payload").startswith("{") & F.ltrim(F.get_json_object("payload", "$.pictures")).startswith("["))
    return items.select("id", readers.first_picture(F.col("payload")).alias("picture"))


@query(f"""SELECT id, 'mercado_livre' AS source_name, {_NORM.format(c='query')} AS query_key, {_NORM.format(c='title')} AS title_key, CAST(price AS DOUBLE) AS price FROM mercado_livre_items_raw WHERE price > 0 AND trim(coalesce(title, '')) <> ''""")
def P10_item_offers(spark, root):
    """Marketplace items as offers."""
    return _item_offers(spark, root)


def _item_offers(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, ITEMS).where("price > 0 AND trim(coalesce(title, '')) <> ''")
    return rows.select("id", F.lit("mercado_livre").alias("source_name"), text.normalized(F.col("query")).alias("query_key"), text.normalized(F.col("title")).alias("title_key"), F.col("price").cast("double").alias("price"))


@query(_OFFER_SQL + f""", both_kinds AS (SELECT id, source_name, query_key, title_key, price FROM offers UNION ALL
 SELECT id, 'mercado_livre', {_NORM.format(c='query')}, {_NORM.format(c='title')}, CAST(price AS DOUBLE) FROM mercado_livre_items_raw WHERE price > 0 AND trim(coalesce(title, '')) <> '')
SELECT id, source_name FROM both_kinds QUALIFY row_number() OVER (PARTITION BY source_name, query_key, title_key ORDER BY price, id) = 1""")
def U05_all_offers(spark, root):
    """Offers of listings and items as one table, the cheapest of each source, query and title."""
    offers = _offers(spark, root).select("id", "source_name", "query_key", "title_key", "price").unionByName(_item_offers(spark, root))
    return relational.best_per_key(offers, ["source_name", "query_key", "title_key"], [F.col("price"), F.col("id")]).select("id", "source_name")


@query("""WITH p AS (SELECT product_id, product_name, domain_id FROM mercado_livre_products_raw QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY fetched_at DESC, id DESC) = 1)
SELECT i.id, CASE WHEN trim(i.title) <> '' THEN i.title ELSE p.product_name END AS title, p.domain_id FROM (SELECT id, title, CASE WHEN json_valid(payload) AND json_type(payload) = 'OBJECT' THEN payload ->> '$.catalog_product_id' END AS product_id FROM mercado_livre_items_raw) i LEFT JOIN p USING (product_id)""")
def P02_catalogue_context(spark, root):
    """Items with the name and domain of their catalogue product."""
    payload = F.when(F.try_parse_json("payload").isNotNull() & F.ltrim("payload").startswith("{"), F.col("payload"))
    items = table(spark, root, ITEMS).select("id", "title", F.get_json_object(payload, "$.catalog_product_id").alias("product_id"))
    products = relational.best_per_key(table(spark, root, "mercado_livre_products_raw"), ["product_id"], [F.desc("fetched_at"), F.desc("id")])
    return readers.with_catalogue(items, products).select("id", "title", "domain_id")


@query()
def H44_described_items(spark, root):
    """Brands, types and model codes of items by title and payload together (H35, X01); nested payload values need recursion, so no SQL."""
    a = attributes.described_by(F.col("title"), F.col("payload"))
    return table(spark, root, ITEMS).select("id", F.array_join(a["brands"], ",").alias("brands"), F.array_join(a["product_types"], ",").alias("types"), F.array_join(a["model_codes"], ",").alias("codes"))


@query("""SELECT key, nullif(min(CASE WHEN nullif(trim(ean), '') IS NOT NULL THEN lpad(CAST(n AS VARCHAR), 20, '0') || trim(ean) END)[21:], '') AS ean, nullif(min(CASE WHEN nullif(trim(sku), '') IS NOT NULL THEN lpad(CAST(n AS VARCHAR), 20, '0') || trim(sku) END)[21:], '') AS sku, bool_and(coalesce(flag, false)) AS flag, max(words) AS words FROM (
 SELECT supplier_slug || ':' || sku AS key, row_number() OVER (ORDER BY fetched_at, id) AS n, ean, sku, token_count > 8 AS flag, CAST(NULL AS VARCHAR) AS words FROM supplier_products_normalized WHERE sku IS NOT NULL
 UNION ALL SELECT supplier_slug || ':' || sku, 0, NULL, NULL, true, array_to_string(list_sort(list_distinct(flatten(list(title_tokens)))), ' ') FROM supplier_products_normalized WHERE sku IS NOT NULL GROUP BY 1) GROUP BY key""")
def A14_merged_catalogue(spark, root):
    """Rows of one article merged: first value that isn't blank, union of words, AND of a flag."""
    rows = table(spark, root, CATALOGUE).where("sku IS NOT NULL").select(F.concat("supplier_slug", F.lit(":"), "sku").alias("key"), F.struct("fetched_at", "id").alias("n"), "ean", "sku", F.col("title_tokens").alias("words"), (F.col("token_count") > 8).alias("flag"))
    return readers.merge_catalogue(rows, "key", "n", ["ean", "sku"], "words", "flag").select("key", "ean", "sku", "flag", F.array_join("words", " ").alias("words"))


# --- states ----------------------------------------------------------------------------------------------------


@query("""WITH r AS (SELECT product_id, price, late FROM (SELECT payload ->> '$.catalog_product_id' AS product_id, CAST(price AS DOUBLE) AS price, fetched_date > (SELECT min(fetched_date) FROM mercado_livre_items_raw) AS late FROM mercado_livre_items_raw WHERE json_valid(payload) AND json_type(payload) = 'OBJECT' AND price IS NOT NULL) WHERE product_id IS NOT NULL),
s AS (SELECT product_id, late, min(price) AS min_price, max(price) AS max_price, count(*) AS offers FROM r GROUP BY ALL)
SELECT product_id, min_price, max_price, offers FROM s QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY late DESC) = 1""")
def K03_price_summary(spark, root):
    """Price summaries of the first day, upserted with those of later days."""
    payload = F.when(F.try_parse_json("payload").isNotNull() & F.ltrim("payload").startswith("{"), F.col("payload"))
    items = table(spark, root, ITEMS)
    first = items.agg(F.min("fetched_date").alias("first"))
    rows = items.join(F.broadcast(first)).select(F.get_json_object(payload, "$.catalog_product_id").alias("product_id"), F.col("price").cast("double").alias("price"), (F.col("fetched_date") > F.col("first")).alias("late")).where("product_id IS NOT NULL AND price IS NOT NULL")
    summary = lambda df: df.groupBy("product_id").agg(F.min("price").alias("min_price"), F.max("price").alias("max_price"), F.count("*").alias("offers"))
    return sinks.upserted(summary(rows.where("NOT late")), summary(rows.where("late")), ["product_id"])


@query("""SELECT s.id, s.supplier_product_id FROM decision_opportunity_snapshots s WHERE decision_run_id = (SELECT id FROM decision_engine_runs WHERE status = 'success' ORDER BY started_at DESC, id DESC LIMIT 1)""")
def K06_current_rows(spark, root):
    """What is left once rows of older runs are deleted."""
    runs = table(spark, root, RUNS).where("status = 'success'").orderBy(F.desc("started_at"), F.desc("id")).limit(1)
    run = small_rows(runs.select("id"), 1)
    rows = table(spark, root, SNAPSHOTS)
    return sinks.without_stale(rows, "decision_run_id", run[0]["id"] if run else "").select("id", "supplier_product_id")


@query("SELECT id, CASE WHEN finished_at IS NULL THEN 'running' ELSE status END AS status, coalesce(finished_at, started_at) AS at FROM source_runs")
def K09_run_states(spark, root):
    """Starts and ends of loads as events that are only appended; the latest one is the state."""
    loads = table(spark, root, LOADS)
    starts = loads.select("id", F.col("started_at").alias("at"), F.lit("running").alias("status"))
    ends = loads.where("finished_at IS NOT NULL").select("id", F.col("finished_at").alias("at"), "status")
    return sinks.current_runs(sinks.run_events(starts, ends)).select("id", "status", "at")


@query("SELECT id, source_name FROM source_runs WHERE finished_at IS NULL AND started_at < (SELECT max(started_at) FROM source_runs) - INTERVAL 2 HOURS")
def F11_stale_loads(spark, root):
    """Loads that never ended and began more than two hours before the newest one."""
    loads = table(spark, root, LOADS)
    newest = loads.agg((F.max("started_at") - F.make_interval(hours=F.lit(2))).alias("before"))
    return loads.where("finished_at IS NULL").join(F.broadcast(newest), F.col("started_at") < F.col("before")).select("id", "source_name")  # one row


@query(f"SELECT count(*) AS n_rows, count(*) FILTER (WHERE t = '') AS blank, count(*) FILTER (WHERE NOT regexp_matches(t, '[0-9a-z]')) AS without_words FROM (SELECT {_NORM.format(c='title')} AS t FROM market_web_listings_raw)")
def F13_titles_without_words(spark, root):
    """Evidence that lacks a title or words."""
    t = text.normalized(F.col("title"))
    return table(spark, root, LISTINGS).agg(F.count("*").alias("n_rows"), F.count_if(t == "").alias("blank"), F.count_if(~t.rlike("[0-9a-z]")).alias("without_words"))


@query("""WITH c AS (SELECT * FROM (VALUES ('a', true, 1), ('b', false, 4), ('c', true, 2)) v(kind, enabled, workers))
SELECT l.source_name, c.workers > 1 AS parallel, count(*) AS loads FROM source_runs l JOIN c ON c.kind = chr(CAST(97 + length(l.source_name) % 3 AS INTEGER)) WHERE c.enabled GROUP BY ALL""")
def F20_enabled_sources(spark, root):
    """Loads of the sources that a configuration enables, and whether they may run side by side."""
    config = spark.createDataFrame([("a", True, 1), ("b", False, 4), ("c", True, 2)], "kind string, enabled boolean, workers int").where("enabled")
    kind = F.chr(F.lit(97) + F.length("source_name") % 3)
    return table(spark, root, LOADS).withColumn("kind", kind).join(F.broadcast(config), "kind").groupBy("source_name", (F.col("workers") > 1).alias("parallel")).agg(F.count("*").alias("loads"))


@query("SELECT id, lower(m) LIKE '%invalid%' AND lower(m) LIKE '%access%' AND lower(m) LIKE '%token%' AS expired FROM (SELECT id, coalesce(error_message, 'Invalid Access Token') AS m FROM decision_engine_runs)")
def F19_expired_tokens(spark, root):
    """Errors that say that a token isn't valid any more."""
    return table(spark, root, RUNS).select("id", readers.is_expired_token(F.coalesce("error_message", F.lit("Invalid Access Token"))).alias("expired"))


@query("""SELECT id, CASE WHEN s IS NULL THEN '-' WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN s // 60 || 'min' WHEN s < 86400 THEN s // 3600 || 'h' ELSE s // 86400 || 'd' END AS took FROM (SELECT id, CAST(floor(date_diff('microsecond', started_at, finished_at) / 1000000) AS BIGINT) AS s FROM source_runs)""")
def H14_durations(spark, root):
    """Durations of loads as short text."""
    seconds = F.floor((F.unix_micros("finished_at") - F.unix_micros("started_at")) / 1_000_000)
    return table(spark, root, LOADS).select("id", numbers.elapsed(seconds).alias("took"))


@query("""SELECT source_name, string_agg(id || '=' || status, ',' ORDER BY started_at DESC, id DESC) AS runs FROM (SELECT * FROM source_runs QUALIFY row_number() OVER (PARTITION BY source_name ORDER BY started_at DESC, id DESC) <= 5) GROUP BY source_name""")
def J10_nested_runs(spark, root):
    """The last five loads of each source nested in one row: one join in place of a lookup per row."""
    last = relational.top_per_key(table(spark, root, LOADS), ["source_name"], [F.desc("started_at"), F.desc("id")], 5)
    nested = last.groupBy("source_name").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "status"))).alias("runs"))
    return nested.select("source_name", F.array_join(F.transform("runs", lambda r: F.concat(r["id"], F.lit("="), r["status"])), ",").alias("runs"))


@query("""SELECT id, source_name, product_key, product_url, CAST(NULL AS DECIMAL(12,2)) AS current_price, CAST(NULL AS DECIMAL(12,2)) AS min_price, CAST(NULL AS DECIMAL(12,2)) AS max_price, true AS blocked, coalesce(block_reason, 'blocked') AS block_reason FROM price_history_raw WHERE blocked""")
def H47_blocked_snapshots(spark, root):
    """Rows that stand for pages which could not be read."""
    return readers.blocked_snapshot(table(spark, root, HISTORY).where("blocked"), F.col("block_reason"))


@query("SELECT id, CAST(price AS DOUBLE) AS price, strftime(fetched_at, '%Y-%m-%dT%H:%M:%S') AS fetched_at, strftime(fetched_date, '%Y-%m-%d') AS fetched_date FROM mercado_livre_items_raw")
def P18_json_rows(spark, root):
    """Rows as an API answers them: decimals as numbers, times as ISO text; through JSON and back."""
    rows = table(spark, root, ITEMS).select(F.to_json(F.struct("id", F.col("price").cast("double").alias("price"), F.date_format("fetched_at", "yyyy-MM-dd'T'HH:mm:ss").alias("fetched_at"), F.date_format("fetched_date", "yyyy-MM-dd").alias("fetched_date"))).alias("j"))
    return rows.select(F.from_json("j", "id string, price double, fetched_at string, fetched_date string").alias("r")).select("r.*")


@query("SELECT id, title FROM market_web_listings_raw ORDER BY fetched_at, id LIMIT 50 OFFSET 100")
def O07_page(spark, root):
    """One page of an ordered list: offset and limit are the feature."""
    return table(spark, root, LISTINGS).orderBy("fetched_at", "id").offset(100).limit(50).select("id", "title")


@query("SELECT 'ok' AS status, (SELECT count(*) FROM source_runs) AS loads, (SELECT count(*) FROM decision_engine_runs) AS runs")
def R07_health(spark, root):
    """Whether the tables that matter are there and hold rows."""
    missing = readers.missing_tables(spark, root, [LOADS, RUNS])
    loads = table(spark, root, LOADS).agg(F.count("*").alias("loads"))
    runs = table(spark, root, RUNS).agg(F.count("*").alias("runs"))
    return loads.crossJoin(runs).select(F.lit("missing" if missing else "ok").alias("status"), "loads", "runs")  # one row each
