import json
import os

import pyspark.sql.functions as F
import pytest

from mercanta.sources import readers, sinks


def test_csv_and_latest_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿id,title\n1,old\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text('﻿id,title\n1,"two\nlines, ""q"""\n2,\n', encoding="utf-8")
    os.utime(tmp_path / "a.csv", (1, 1))
    path = readers.latest_file(spark, str(tmp_path), "*.csv")
    assert path.endswith("b.csv") and readers.latest_file(spark, str(tmp_path), "*.none") is None
    df = readers.read_csv_strings(spark, path)
    assert df.dtypes == [("id", "string"), ("title", "string")]
    assert [tuple(r) for r in df.collect()] == [("1", 'two\nlines, "q"'), ("2", None)]


def test_catalogues(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"codigo": "1", "barcode": "789", "nome": "Mouse", "modelo": "M1", "preco": 9.9}, {"codigo": "2", "nome": " ", "preco": 1}, {"codigo": "3", "nome": "X", "preco": -1}]))
    rows = readers.catalogue_a_rows(readers.read_catalogue(spark, str(tmp_path / "a.json"), readers.CATALOGUE_A)).collect()
    assert [(r.sku, r.raw_title, r.raw_price and float(r.raw_price)) for r in rows] == [("1", "Mouse M1", 9.9), ("3", "X", None)]
    (tmp_path / "b.json").write_text(json.dumps([{"reference": "R1", "description": "Cabo  HDMI", "price": 5, "stock_text": "Acima de 20 un"}, {"reference": "R2"}]))
    rows = readers.catalogue_b_rows(readers.read_catalogue(spark, str(tmp_path / "b.json"), readers.CATALOGUE_B)).collect()
    assert [(r.sku, r.raw_title, r.raw_stock) for r in rows] == [("R1", "Cabo HDMI", 20)]
    (tmp_path / "c.json").write_text('[{"codigo": 1')
    with pytest.raises(Exception):
        readers.read_catalogue(spark, str(tmp_path / "c.json"), readers.CATALOGUE_A).collect()


def test_merge_catalogue(spark):
    df = spark.createDataFrame([("r", 1, "", "A", ["x", "y"], True), ("r", 2, "brand", "B", ["a"], True), ("s", 3, None, None, None, None)], "ref string, n int, brand string, text string, sections array<string>, phase_out boolean")
    out = {r.ref: r for r in readers.merge_catalogue(df, "ref", "n", ["brand", "text"], "sections", "phase_out").collect()}
    assert (out["r"].brand, out["r"].text, out["r"].sections, out["r"].phase_out) == ("brand", "A", ["a", "x", "y"], True)
    assert (out["s"].brand, out["s"].sections, out["s"].phase_out) == (None, None, False)


def test_catalogue_pages(spark):
    words = [(1, 10.2, 5.0, "12345"), (1, 10.0, 50.0, "Mouse"), (1, 9.9, 90.0, "USB"), (1, 20.0, 5.0, "R$"), (1, 20.0, 30.0, "12,90"), (1, 10.0, 310.0, "99999"), (1, 10.0, 350.0, "Cabo"), (2, 10.0, 5.0, "12345"), (2, 10.0, 50.0, "Outro")]
    lines = readers.page_lines(spark.createDataFrame(words, "page int, top double, x0 double, text string"))
    out = {r.codigo: (r.nome, r.preco) for r in readers.catalogue_blocks(lines).collect()}
    assert out == {"12345": ("Mouse USB", 12.9), "99999": ("Cabo", None)}


PAGE = """<html><div class="card big"><h2 class="name">Mouse <b>Gamer</b> &amp; fio</h2><a href="/p/1"><img src="1.jpg"></a><span class="price">R$ 10,00</span></div>
<div class="card"><h2 class="name">Teclado</h2><br></div></html>"""


def test_html_cards(spark):
    df = spark.createDataFrame([("p", PAGE), ("empty", ""), ("null", None)], "k string, h string")
    fields = {"title_text": ".name", "price_text": "span.price", "href": "a@href", "image_url": "img@src", "card_text": ".card"}
    cards = readers.html_cards(df, "h", "k", "div.card", fields)
    rows = cards.orderBy("position").collect()
    assert [(r.position, r.title_text, r.price_text, r.href, r.image_url) for r in rows] == [(1, "Mouse Gamer & fio", "R$ 10,00", "/p/1", "1.jpg"), (2, "Teclado", None, None, None)]
    listing = readers.card_listings(cards, "loja").orderBy("position").first()
    assert (listing.title, listing.price) == ("Mouse Gamer & fio", 10.0)


def test_prices_and_details(spark):
    df = spark.createDataFrame([("de R$ 20,00 por R$ 15,00",), ("R$ 20,00 R$ 15,00 no pix",), ("R$ 20,00",), (None,)], "t string")
    assert [r.p for r in df.select(readers.market_price(F.col("t")).alias("p")).collect()] == [15.0, 15.0, 20.0, None]
    d = spark.createDataFrame([('{"historical_sold": 7, "rating_star": 4.5}', "1,2 mil avaliações")], "h string, b string").select(readers.detail_values(F.col("h"), F.col("b")).alias("d")).first().d
    assert (d.historical_sold, d.rating_star, d.liked_count) == (7, 4.5, None)


def test_embedded_json(spark):
    state = json.dumps({"props": {"pageProps": {"initialReduxState": {"hits": {"hits": [{"id": "1", "name": "A", "url": "/a", "price": 2.5}, {"id": "2", "name": "B"}]}}}}})
    html = f'<script id="__NEXT_DATA__" type="application/json">{state}</script>'
    out = readers.next_data_hits(spark.createDataFrame([("q", html), ("n", "x"), ("z", None)], "q string, h string"), "h", ["q"]).collect()
    assert [(r.q, r.position, r.name, r.price) for r in out] == [("q", 1, "A", 2.5), ("q", 2, "B", None)]
    product = lambda o: f'<script type="application/ld+json">{json.dumps(o)}</script>'
    pages = [product({"@type": "Product", "name": "A", "offers": {"lowPrice": "1.5", "highPrice": 3, "offerCount": 2}}), product({"@graph": [{"@type": "X"}, {"@type": "Product", "name": "B", "offers": [{"price": "4"}, {"price": "2"}]}]}), product({"@type": "Product", "name": "C", "offers": {"price": 7}}), "none"]
    got = [tuple(r.p) for r in spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, h string").orderBy("i").select(readers.json_ld_product(F.col("h")).alias("p")).collect()]
    assert got == [("A", 1.5, 3.0, 2), ("B", 2.0, 4.0, 2), ("C", 7.0, 7.0, 1), (None, None, None, None)]
    s = spark.createDataFrame([("Nos últimos 6 meses a média de R$ 100,50: preço está baixo",)], "t string").select(readers.history_summary(F.col("t")).alias("s")).first().s
    assert tuple(s) == (180, 100.5, "low")


def test_saved_searches(spark, tmp_path):
    (tmp_path / "mouse-0.json").write_text(json.dumps({"results": [{"id": "1"}, {"id": "2"}]}))
    (tmp_path / "mouse-1.json").write_text(json.dumps({"results": []}))
    (tmp_path / "mouse-2.json").write_text(json.dumps({"results": [{"id": "beyond the empty page"}]}))
    out = readers.saved_searches(spark, str(tmp_path), ["mouse", "absent"]).collect()
    assert [(r.query, r.page, r["index"], r.payload) for r in out] == [("mouse", 0, 0, '{"id":"1"}'), ("mouse", 0, 1, '{"id":"2"}')]
    item = spark.createDataFrame([('{"item_id":"X","name":"N","price":0,"buy_box_winner":{"price":9.5},"seller":{"id":5}}',)], "p string").select(readers.item_fields(F.col("p")).alias("f")).first().f
    assert (item.external_id, item.title, float(item.price), item.seller_id) == ("X", "N", 9.5, "5")


def test_missing_tables(spark, data):
    assert readers.missing_tables(spark, data, ["documents", "nowhere", "source_runs"]) == ["nowhere"]


def test_append_upsert_replace(spark, tmp_path):
    path, key = str(tmp_path / "t"), ["a", "b"]
    batch = spark.createDataFrame([("x", None, 1), ("x", None, 2), ("x", "y", 3), ("x", "y", 4)], "a string, b string, n int")
    order = [F.col("n")]
    assert sinks.append_ignore(spark, path, batch, key, order) == {"extracted": 4, "loaded": 3, "skipped": 1}
    keyed = batch.where("b IS NOT NULL")
    assert sinks.append_ignore(spark, path, keyed, key, order)["loaded"] == 0
    assert sorted(r.n for r in spark.read.parquet(path).collect()) == [1, 2, 3]
    t = sinks.VersionedTable(spark, str(tmp_path / "v"))
    assert t.read() is None
    t.upsert(spark.createDataFrame([(1, "a"), (2, "b")], "id int, x string"), ["id"])
    t.upsert(spark.createDataFrame([(2, "c"), (3, "d")], "id int, x string"), ["id"])
    assert {(r.id, r.x) for r in t.read().collect()} == {(1, "a"), (2, "c"), (3, "d")} and t.version() == 2
    assert sinks.without_stale(spark.createDataFrame([("r", 1), ("s", 2), (None, 3)], "run string, n int"), "run", "r").count() == 1
    events = sinks.run_events(spark.createDataFrame([("1", 1, "running")], "id string, at int, status string"), spark.createDataFrame([("1", 2, "success")], "id string, at int, status string"))
    assert sinks.current_runs(events).first().status == "success"


def test_extracts(spark, tmp_path):
    df = spark.sql("SELECT 1.5D AS n, true AS b, array('x', 'y') AS l, date'2026-01-02' AS d, CAST(NULL AS INT) AS z, 'a;b' AS t")
    assert tuple(df.select(*sinks.extract_columns(df)).first()) == ("1,5", "sim", "x | y", "2026-01-02", "", "a;b")
    manifest = sinks.write_extracts({"one": df, "none": df.limit(0)}, str(tmp_path))
    assert manifest["files"] == {"none": 0, "one": 1} and (tmp_path / "manifest.json").exists()
    sinks.write_fields(df.select("t"), ["t", "missing"], str(tmp_path / "f"))
    assert spark.read.csv(str(tmp_path / "f"), header=True).columns == ["t", "missing"]
