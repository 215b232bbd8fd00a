from itertools import combinations

import pyspark.sql.functions as F

from mercanta.llm import listings


def _groups(spark, rows):
    df = spark.createDataFrame([(str(i), t, e) for i, (t, e) in enumerate(rows)], "key string, title string, ean string")
    out = {r.key: r.product for r in listings.products(df).collect()}
    groups = {}
    for k, p in out.items():
        groups.setdefault(p, set()).add(int(k))
    return sorted(map(sorted, groups.values()))


def test_same_product_in_many_words(spark):
    rows = [
        ("Mouse Gamer Nexoril Memojoju UJ-13622 6400dpi BT 5.0 preto", None),
        ("OFERTA Nexoril UJ 13622 Mouse Óptico até 6.400 DPI Bluetooth na cor preta Frete Grátis", None),
        ("mouse via bluetooth pto 6400 dpi uj/13622", None),
        ("Mouse Nexoril Memojoju 6400 DPI via bluetooth black", None),
        ("Mouse Nexoril Memojju 6400 DPI BT 5.0 pto Envio Hoje", None),
        ("Mouse Nexoril Memojoju UJ13622 6400dpi wireless preto", None),
        ("Mouse Nexoril Memojoju UJ13622 12000dpi BT 5.0 preto", None),
        ("Mouse Nexoril Memojoju UJ13622 6400dpi BT 5.0 branco", None),
    ]
    assert _groups(spark, rows) == [[0, 1, 2, 3, 4], [5], [6], [7]]


def test_units_and_formats(spark):
    rows = [("SSD Oxibyte Quibrocruba YZ-99096 1TB NVMe", None), ("HD SSD YZ99096 M.2 NVMe 1000 GB", None), ("SSD Interno Oxibyte Quibrocruba 1 Tera PCIe NVMe", None), ("SSD Oxibyte YZ-99096 1TB SATA III", None)]
    rows += [("Cabo HDMI Tuparo AB-12345 1,5 metros kit c/ 2", None), ("Cb HDMI AB/12345 150cm 2un", None), ("cabo de vídeo hdmi ab12345 1500mm pack 2 un", None), ("Cabo HDMI Tuparo AB-12345 1,5m", None)]
    rows += [("Fonte ATX Jacuma CD-11111 0,75kW 110/220v", None), ("fonte pc cd 11111 750 watts bivolt", None), ("Fonte Jacuma CD-11111 750W 220V", None)]
    assert _groups(spark, rows) == [[0, 1, 2], [3], [4, 5, 6], [7], [8, 9], [10]]


def test_identifiers_link_and_guards_hold(spark):
    good, other = "2901702303902", "2 901702 303902"
    rows = [("Pilha Maruvi Dabotraso SN-61386 AAA c/8 pcs", good), ("Pilha alcalina Maruvi Dabotrasa palito AAA 8 unidades", other), ("Pilha Alcalina Xerofuvi AAA 8un", good), ("", good), (None, None), ("", None)]
    groups = _groups(spark, rows)
    # a shared valid number links names of one kind and set of attributes; an empty title takes the number's group
    assert [0, 1, 2, 3] in groups and [4] in groups and [5] in groups
    # two part numbers are never one model, whatever number they share
    rows = [("Mouse Nexoril UJ-13622 6400dpi USB preto", good), ("Mouse Nexoril XT-12644 6400dpi USB preto", good)]
    assert _groups(spark, rows) == [[0], [1]]


def test_gtin(spark):
    cases = {"2901702303902": True, "02901702303902": True, "EAN 2901702303902": True, "2-901702-303902": True, "2901702303902.0": True, "2901702303903": False, "0000000000000": False, "SEM GTIN": False, "123456": False, "": False, None: False}
    rows = spark.createDataFrame([(i, e) for i, e in enumerate(cases)], "i int, e string")
    assert [r.g is not None for r in rows.orderBy("i").select(listings.gtin(F.col("e")).alias("g")).collect()] == list(cases.values())


def test_pairs(spark):
    df = spark.createDataFrame([("b", "p"), ("a", "p"), ("c", "p"), ("d", "q"), ("e", "r"), ("f", "r")], "key string, product string")
    assert {(r.key_a, r.key_b) for r in listings.same_product_pairs(df).collect()} == {*combinations("abc", 2), ("e", "f")}
    assert listings.same_product_pairs(df.limit(0)).count() == 0


def test_brands_types_and_codes_nobody_listed(spark):
    rows = [
        ("Mouse Logitech M170 sem fio preto 1000dpi", None), ("Mouse sem fio Logitech m-170 1000 dpi preto oferta", None), ("Mouse Logitech M280 sem fio preto 1000dpi", None),
        ("SSD Kingston A400 480GB SATA", None), ("Kingston SSD SATA 480 GB A400", None), ("SSD Kingston UV500 480GB SATA", None),
        ("Monitor LG 24MP400 full hd", None), ("Monitor LG UltraGear GN800 preto", None), ("Monitor gamer LG ultragear GN-800 preto", None), ("Monitor LG UltraGear GN800 branco", None),
    ]
    assert _groups(spark, rows) == [[0, 1], [2], [3, 4], [5], [6], [7, 8], [9]]


def test_names_reach_a_part_number_over_other_names(spark):
    """A slip of a slip; and a name between two part numbers joins neither."""
    rows = [(f"Webcam {name} 1080p preta", None) for name in ("Memojoju UJ-13622", "Memojoju UJ-13622", "Memojju", "Memojiju", "Memjiju")]
    rows += [("Webcam Tatrelip AB-11111 1080p preta", None), ("Webcam Tatrelix CD-22222 1080p preta", None), ("Webcam Tatreli 1080p preta", None)]
    assert _groups(spark, rows) == [[0, 1, 2, 3, 4], [5], [6], [7]]


def test_titles_of_an_offer_vote_and_prices_guard(spark):
    rows = [("o", "Webcam Memojoju UJ-13622 1080p preta", None, 100.0, 5), ("o", "Webcam 720p branca", None, 100.0, 1), ("p", "Webcam Memojoju UJ-13622 1080p preta", None, 99.0, 1), ("q", "Webcam Memojiju 1080p preta", None, 900.0, 1), ("r", "Webcam 1080p preta EAN 2901702303902", None, None, 1), ("s", "Webcam Memojoju UJ-13622 1080p preta", "2901702303902", 99.0, 1)]
    df = spark.createDataFrame(rows, "key string, title string, ean string, price double, n long")
    out = {r.key: r.product for r in listings.products(df).collect()}
    assert set(out) == set("opqrs") and out["o"] == out["p"] == out["r"] == out["s"] != out["q"]


def test_whole_tables(spark, data):
    records = listings.market_and_catalogue(spark, data)
    assert records.select("key").distinct().count() == listings.products(records).count()
    long = spark.createDataFrame([("k", "Mouse " + "palavra " * 20_000 + "UJ-13622 6400dpi USB preto", None)], "key string, title string, ean string")
    assert listings.products(long).first().product == "mouse/uj13622/6400|wired|black"
