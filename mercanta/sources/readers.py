"""Scans of files, catalogues, saved pages and saved API answers."""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from mercanta.functions import numbers, text

CATALOGUE_A = T.StructType([T.StructField("codigo", T.StringType()), T.StructField("barcode", T.StringType()), T.StructField("nome", T.StringType()), T.StructField("modelo", T.StringType()), T.StructField("preco", T.DoubleType()), T.StructField("unidade", T.StringType()), T.StructField("fonte", T.StringType())])
CATALOGUE_B = T.StructType([T.StructField(n, T.StringType()) for n in ("reference", "description", "brand", "ncm", "product_type")] + [T.StructField("price", T.DoubleType()), T.StructField("stock_text", T.StringType()), T.StructField("phase_out", T.BooleanType()), T.StructField("catalog_sections", T.ArrayType(T.StringType()))] + [T.StructField(n, T.StringType()) for n in ("source_snapshot_date", "source_file", "source_url")])


def latest_file(spark: SparkSession, folder: str, pattern: str) -> str | None:
    """Path of the newest file that matches a glob, by modification time, then path; None if there is none."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "modificationTime")
    row = files.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path")).first()
    return row["path"] if row else None


def read_csv_strings(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """CSV with a header: every column as text, quotes doubled, line breaks in fields, long fields, a byte-order mark skipped."""
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, quote='"', escape='"', maxCharsPerColumn=-1, encoding="UTF-8")
    return df.toDF(*(c.lstrip("﻿") for c in df.columns))


def first_picture(payload: Column) -> Column:
    """The URL of an item's first picture."""
    return F.get_json_object(payload, "$.pictures[0].url")


def blocked_snapshot(rows: DataFrame, reason: Column) -> DataFrame:
    """The row that stands for a page that could not be read: keys kept, prices NULL, the reason said."""
    none = F.lit(None).cast("decimal(12,2)")
    return rows.select("id", "source_name", "product_key", "product_url", none.alias("current_price"), none.alias("min_price"), none.alias("max_price"), F.lit(True).alias("blocked"), F.coalesce(reason, F.lit("blocked")).alias("block_reason"))


def with_catalogue(items: DataFrame, products: DataFrame) -> DataFrame:
    """Items with the name and domain of the catalogue product they belong to; items without one keep their own title."""
    p = products.select("product_id", "product_name", "domain_id")
    return items.join(p, "product_id", "left").withColumn("title", F.when(F.trim("title") != "", F.col("title")).otherwise(F.col("product_name")))


def is_expired_token(message: Column) -> Column:
    """Whether an error says that the access token isn't valid any more."""
    low = F.lower(message)
    return F.coalesce(low.contains("invalid") & low.contains("access") & low.contains("token"), F.lit(False))


def read_catalogue(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A JSON list of objects. Anything that isn't such a list fails."""
    return spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST")


def catalogue_a_rows(df: DataFrame) -> DataFrame:
    """Supplier rows of catalogue A: rows without a name are left out, negative prices are NULL."""
    price = F.when(F.col("preco") >= 0, F.col("preco").cast("decimal(12,2)"))
    title = text.spaces(F.concat_ws(" ", "nome", "modelo"))
    return df.where(F.nullif(F.trim("nome"), F.lit("")).isNotNull()).select(F.lit("megamix").alias("supplier_slug"), F.col("fonte").alias("source_url"), title.alias("raw_title"), price.alias("raw_price"), F.lit("BRL").alias("currency_id"), F.lit(None).cast("int").alias("raw_stock"), F.col("codigo").alias("sku"), F.col("barcode").alias("ean"))


def catalogue_b_rows(df: DataFrame) -> DataFrame:
    """Supplier rows of catalogue B: rows need a reference and a description."""
    present = F.nullif(F.trim("reference"), F.lit("")).isNotNull() & F.nullif(F.trim("description"), F.lit("")).isNotNull()
    price = F.when(F.col("price") >= 0, F.col("price").cast("decimal(12,2)"))
    return df.where(present).select(F.lit("coletek").alias("supplier_slug"), "source_url", text.spaces(F.col("description")).alias("raw_title"), price.alias("raw_price"), F.lit("BRL").alias("currency_id"), F.regexp_extract("stock_text", r"(\d+)", 1).try_cast("int").alias("raw_stock"), F.col("reference").alias("sku"), F.lit(None).cast("string").alias("ean"))


def merge_catalogue(df: DataFrame, key: str, order: str, firsts: list[str], sections: str, flag: str) -> DataFrame:
    """Duplicates of a key merged: first non-blank value of each attribute in order, sorted union of sections, AND of a flag."""
    first = [F.min_by(F.nullif(F.trim(c), F.lit("")), F.when(F.nullif(F.trim(c), F.lit("")).isNotNull(), F.col(order))).alias(c) for c in firsts]
    merged = df.groupBy(key).agg(*first, F.bool_and(F.coalesce(F.col(flag), F.lit(False))).alias(flag))
    found = df.select(key, F.explode(sections).alias("s")).distinct().groupBy(key).agg(F.array_sort(F.collect_list("s")).alias(sections))
    return merged.join(found, key, "left")


def page_lines(page_words: DataFrame, split_at: float = 300.0) -> DataFrame:
    """Words of a two-column page (page, top, x0, text) as lines: column by x, line by rounded top, words by x."""
    line = page_words.groupBy("page", (F.col("x0") >= split_at).cast("int").alias("column"), F.round("top").cast("int").alias("line"))
    return line.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda w: w["text"]), " ").alias("text"))


def catalogue_blocks(lines: DataFrame) -> DataFrame:
    """Products of catalogue lines: ``codigo name`` and the price that follows in the same column; the first of a code wins."""
    from pyspark.sql.window import Window

    reading = Window.partitionBy("page", "column").orderBy("line")
    head = F.regexp_extract("text", r"^(\d{4,})\s+(\S.*)$", 1)
    marked = lines.select("page", "column", "line", "text", F.nullif(head, F.lit("")).alias("codigo"), numbers.brl_price(F.col("text")).alias("price"))
    blocks = marked.withColumn("block", F.count("codigo").over(reading)).where("block > 0").groupBy("page", "column", "block")
    products = blocks.agg(F.min("line").alias("line"), F.max("codigo").alias("codigo"), F.max(F.nullif(F.regexp_extract("text", r"^\d{4,}\s+(\S.*)$", 1), F.lit(""))).alias("nome"), F.min_by("price", F.when(F.col("price").isNotNull(), F.col("line"))).alias("preco"))
    return products.groupBy("codigo").agg(F.min(F.struct("page", "column", "block", "nome", "preco")).alias("f")).select("codigo", "f.nome", "f.preco")


class _Selected(HTMLParser):
    """Elements of one CSS class (``.name``) or tag inside containers, with text and attributes."""

    VOID = {"img", "br", "input", "meta", "link", "hr"}

    def __init__(self, container: str, fields: dict[str, str]):
        super().__init__(convert_charrefs=True)
        self.container, self.fields = container, {k: self._split(v) for k, v in fields.items()}
        self.items: list[dict] = []
        self.stack: list[tuple[str, list[str], bool]] = []

    @staticmethod
    def _split(selector: str) -> tuple[str, str | None]:
        path, _, attribute = selector.partition("@")
        return path.strip(), attribute or None

    @staticmethod
    def _fits(selector: str, tag: str, attrs: dict) -> bool:
        name, _, cls = selector.partition(".")
        return (not name or name == tag) and (not cls or cls in (attrs.get("class") or "").split())

    def handle_starttag(self, tag: str, attrs: list) -> None:
        attrs = dict(attrs)
        opens = self._fits(self.container, tag, attrs)
        if opens:
            self.items.append({})
        inside = opens or any(s[2] for s in self.stack)
        takes = []
        if inside:
            for field, (selector, attribute) in self.fields.items():
                if self._fits(selector, tag, attrs) and field not in self.items[-1]:
                    if attribute:
                        self.items[-1][field] = attrs.get(attribute)
                    else:
                        self.items[-1][field] = ""
                        takes.append(field)
        if tag not in self.VOID:
            self.stack.append((tag, takes, opens))

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                return

    def handle_data(self, data: str) -> None:
        for _, takes, _ in self.stack:
            for field in takes:
                self.items[-1][field] += data


def html_cards(pages: DataFrame, html: str, key: str, container: str, fields: dict[str, str]) -> DataFrame:
    """Cards of saved pages by selectors (``tag``, ``.class``, ``tag.class``, ``…@attribute``): key, position from 1, one text column per field.

    NULL pages and pages without cards give no rows; a field that is missing is NULL.
    """
    schema = T.StructType([T.StructField("page_key", T.StringType()), T.StructField("position", T.IntegerType()), *(T.StructField(f, T.StringType()) for f in fields)])

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for k, page in zip(pdf["k"], pdf["h"]):
                if page:
                    parser = _Selected(container, fields)
                    parser.feed(page)
                    rows += [(k, i, *((re.sub(r"\s+", " ", item[f]).strip() or None) if item.get(f) is not None else None for f in fields)) for i, item in enumerate(parser.items, 1)]
            yield pd.DataFrame(rows, columns=schema.names).astype({"position": "int32"})

    return pages.select(F.col(key).cast("string").alias("k"), F.col(html).alias("h")).mapInPandas(parse, schema)


def card_listings(cards: DataFrame, source: str) -> DataFrame:
    """Card texts (position, title_text, price_text, card_text, href, image_url) as listing columns."""
    body = F.col("card_text")
    sold = F.regexp_extract(body, r"(?i)(\d[\d.,]*\s*(?:mil|k)?\+?\s*vendid[oa]s?|(?:mais\s+de\s+)?\d[\d.,]*\s*(?:mil|k)?\+?\s+compras?\s+no\s+m[eê]s\s+passado)", 1)
    reviews = F.regexp_extract(body, r"(?i)\((\d+(?:[.,]\d+)?\s*(?:mil|k)?)\)", 1)
    title = F.coalesce(text.trimmed_title(F.col("title_text")), text.trimmed_title(body))
    return cards.select(
        F.lit(source).alias("source_name"), "position", title.alias("title"), F.coalesce(numbers.brl_price(F.col("price_text")), market_price(body)).alias("price"), F.nullif(sold, F.lit("")).alias("sold_quantity_text"),
        numbers.sold_quantity(sold).alias("sold_quantity"), numbers.int_text(F.nullif(reviews, F.lit(""))).alias("reviews_count"), F.lower(body).contains("patrocinado").alias("is_sponsored"), F.lower(body).rlike(r"\bfull\b").alias("is_full"),
        text.block_reason(body).alias("block_reason"), F.col("href").alias("item_url"), "image_url",
    )


def market_price(body: Column) -> Column:
    """The price a card means: after ``por`` if stated; the second of two beside promotion words; else the first."""
    t = text.spaces(body)
    promo = F.regexp_extract(t, r"(?i)\bpor\s+(R\$\s*[\d.,]+)", 1)
    every = F.regexp_extract_all(t, F.lit(r"(R\$\s*[\d.,]+)"), 1)
    second = F.when((F.size(every) >= 2) & t.rlike(r"(?i)\b(?:de|desconto|pix|promo[cç][aã]o)\b"), F.try_element_at(every, F.lit(2)))
    return F.coalesce(numbers.brl_price(F.nullif(promo, F.lit(""))), numbers.brl_price(second), numbers.brl_price(t))


def detail_values(html: Column, body: Column) -> Column:
    """Counts of a saved detail page: sold, ratings, likes, comments and stars; the rating count falls back to the visible text."""
    rating_count = F.coalesce(numbers.json_int(html, "total_rating_count"), numbers.int_text(F.nullif(F.regexp_extract(body, r"(?i)(\d[\d.,]*)\s+avalia[cç][oõ]es", 1), F.lit(""))))
    return F.struct(numbers.json_int(html, "historical_sold").alias("historical_sold"), numbers.json_int(html, "global_sold").alias("global_sold"), rating_count.alias("total_rating_count"), numbers.json_int(html, "liked_count").alias("liked_count"), F.regexp_extract(html, r'"rating_star"\s*:\s*(\d+(?:\.\d+)?)', 1).try_cast("double").alias("rating_star"))


def next_data_hits(pages: DataFrame, html: str, keep: list[str]) -> DataFrame:
    """Search hits of saved price-comparison pages, from the page's embedded state: id, name, url, price of each hit."""
    state = F.regexp_extract(F.col(html), r'(?s)<script[^>]*id="__NEXT_DATA__"[^>]*>(.*?)</script>', 1)
    hits = F.from_json(F.get_json_object(state, "$.props.pageProps.initialReduxState.hits.hits"), "array<struct<id:string,name:string,url:string,price:double>>")
    return pages.select(*keep, F.posexplode(hits).alias("index", "hit")).select(*keep, (F.col("index") + 1).alias("position"), "hit.*")


def json_ld_product(html: Column) -> Column:
    """Name, lowest and highest price and offer count of the first Product in a page's JSON-LD, whatever shape its offers have."""
    blocks = F.regexp_extract_all(html, F.lit(r'(?s)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>'), 1)
    nodes = F.flatten(F.transform(blocks, lambda b: F.coalesce(F.from_json(F.get_json_object(b, "$.@graph"), "array<string>"), F.array(b))))
    node = F.try_element_at(F.filter(nodes, lambda n: F.get_json_object(n, "$.@type") == "Product"), F.lit(1))
    offers = F.get_json_object(node, "$.offers")
    several = F.from_json(F.when(offers.startswith("["), offers), "array<struct<price:string>>")
    prices = F.transform(several, lambda o: o["price"].try_cast("double"))
    one = F.get_json_object(offers, "$.price").try_cast("double")
    return F.struct(
        F.get_json_object(node, "$.name").alias("name"), F.coalesce(F.get_json_object(offers, "$.lowPrice").try_cast("double"), one, F.array_min(prices)).alias("low_price"),
        F.coalesce(F.get_json_object(offers, "$.highPrice").try_cast("double"), one, F.array_max(prices)).alias("high_price"), F.coalesce(F.get_json_object(offers, "$.offerCount").try_cast("int"), F.size(prices), F.when(one.isNotNull(), 1)).alias("offer_count"),
    )


def history_summary(body: Column) -> Column:
    """What a page says of its price history: days covered, average price and whether the price is low, usual or high."""
    t = text.spaces(body)
    days = F.regexp_extract(t, r"(?i)[uú]ltimos\s+(\d+)\s+(?:dias|meses)", 1).try_cast("int")
    days = F.when(t.rlike(r"(?i)[uú]ltimos\s+\d+\s+meses"), days * 30).otherwise(days)
    average = numbers.brl_price(F.nullif(F.regexp_extract(t, r"(?i)m[eé]dia\s+(?:foi\s+)?de\s+(R\$\s*[\d.,]+)", 1), F.lit("")))
    state = F.when(t.rlike(r"(?i)pre[cç]o\s+(?:est[aá]\s+)?(?:baixo|[oó]timo)"), "low").when(t.rlike(r"(?i)pre[cç]o\s+(?:est[aá]\s+)?alto"), "high").when(average.isNotNull(), "usual")
    return F.struct(days.alias("window_days"), average.alias("average_price"), state.alias("price_state"))


class _ReplayPage(InputPartition):
    def __init__(self, folder: str, query: str):
        self.folder, self.query = folder, query


class _ReplayReader(DataSourceReader):
    """Reads saved API answers page by page: one partition per query, offsets until an empty page, or until a page limit if one is given."""

    def __init__(self, options: dict):
        self.folder, self.queries = options["folder"], json.loads(options["queries"])
        self.most_pages = int(options.get("most_pages", "0"))

    def partitions(self) -> list[InputPartition]:
        return [_ReplayPage(self.folder, q) for q in self.queries]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from pathlib import Path

        for page in itertools.count() if not self.most_pages else range(self.most_pages):
            path = Path(partition.folder) / f"{partition.query}-{page}.json"
            if not path.exists():  # a search that ends, or that has no winners, is an empty one
                return
            results = json.loads(path.read_text(encoding="utf-8")).get("results") or []
            if not results:
                return
            for i, item in enumerate(results):
                yield (partition.query, page, i, json.dumps(item, ensure_ascii=False, sort_keys=True, separators=(",", ":")))


class SavedSearches(DataSource):
    """Python data source ``saved_searches``: replay of marketplace searches saved as ``<query>-<page>.json``."""

    @classmethod
    def name(cls) -> str:
        return "saved_searches"

    def schema(self) -> str:
        return "query string, page int, index int, payload string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _ReplayReader(dict(self.options))


def saved_searches(spark: SparkSession, folder: str, queries: list[str], most_pages: int = 0) -> DataFrame:
    spark.dataSource.register(SavedSearches)
    return spark.read.format("saved_searches").option("folder", folder).option("queries", json.dumps(queries)).option("most_pages", str(most_pages)).load()


def item_fields(payload: Column) -> Column:
    """Listing columns of a marketplace item's JSON with its fallbacks; blank text and 0 count as missing."""
    def first(*paths: str) -> Column:
        return F.coalesce(*(F.nullif(F.nullif(F.get_json_object(payload, p), F.lit("")), F.lit("0")) for p in paths))

    return F.struct(
        first("$.id", "$.item_id").alias("external_id"), first("$.title", "$.name", "$.catalog_product_name").alias("title"), first("$.price", "$.buy_box_winner.price").try_cast("decimal(12,2)").alias("price"),
        first("$.currency_id").alias("currency_id"), first("$.seller.id", "$.seller_id").alias("seller_id"), first("$.permalink").alias("permalink"), first("$.category_id").alias("category_id"),
    )


def missing_tables(spark: SparkSession, root: str, required: list[str]) -> list[str]:
    """Required tables that the data folder lacks."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    there = {f.getPath().getName().removesuffix(".parquet") for f in files}
    return sorted(set(required) - there)
