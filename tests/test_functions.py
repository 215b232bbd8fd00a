import pytest
import pyspark.sql.functions as F

from mercanta.functions import attributes, numbers, text
from mercanta.operators.relational import title_case


def _apply(spark, f, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in rows.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "f, cases",
    [
        (numbers.brl_price, {"R$ 1.234,56": 1234.56, "por R$ 12,90 hoje": 12.9, "R$ 12.99": 1299.0, "R$ 1.234": 123.0, "12,90": None, "": None, None: None}),
        (numbers.brl_price_with_cents, {"1.234,56": 1234.56, "R$ 12": None, None: None}),
        (numbers.int_text, {"1,2 mil avaliações": 1200, "3k": 3000, "1.234": 1234, "45": 45, "nada": None, None: None}),
        (numbers.sold_quantity, {"1,1 mil+ vendidos": 1100, "Mais de 1.200 compras": 1200, "+50 vendidos": 50, "50": None, "restam 5": None, None: None}),
        (numbers.to_double, {"R$ 1.234,50": 1234.5, "1,234.50": 1.2345, "12.5": 12.5, "nan": None, "inf": None, "x": None, "": None, None: None}),
        (numbers.to_flag, {"1": True, "SIM": True, "yes": True, "0": False, "": False, None: False}),
        (numbers.rating, {"4,5 de 5": 4.5, "nota 3": 3.0, "x": None, None: None}),
        (numbers.bare_url, {"https://a.example/x?y=1#z": "https://a.example/x", " a b ": "a b", None: None}),
        (lambda c: numbers.json_int(c, "sold"), {'{"sold": 12}': 12, '{"sold":null}': None, "": None, None: None}),
        (text.spaces, {" a\xa0 b\n": "a b", "": "", None: None}),
        (text.fold, {"CÃ¢mera PreÃ§o Nº": "camera preco nº", "Ação": "acao", "café": "cafe", None: None}),
        (text.redecoded, {"CÃ¢mera nÂº 1": "Câmera nº 1", "SÃ£o 5€": "SÃ£o 5€", "Ação": "Ação", "Ã": "Ã", None: None}),
        (text.normalized, {"SSD 1,5TB – Novo!": "ssd 1 5tb novo", "": "", None: ""}),
        (lambda c: F.array_join(text.tokens(text.normalized(c)), " "), {"Cabo de USB a C3 C3 ab": "cabo usb c3", "": "", None: ""}),
        (lambda c: text.title_key(text.normalized(c)), {"Mouse de mesa com fio " + "x " * 30: "mouse mesa fio " + " ".join(["x"] * 15)}),
        (lambda c: text.category(text.normalized(c)), {"Mouse Pad grande": "mousepad", "mouse sem fio": "mouse", "Cabo USB-C": "cabo", "cooler notebook": "notebook_acessorio", "geladeira": "outros", None: "outros"}),
        (text.block_reason, {"Digite os caracteres": "captcha", "você é um robo?": "bot_block", "Erro 403": "access_denied", "Sign in to continue": "login_wall", "ok": None, None: None}),
        (text.is_retryable, {"captcha": True, "navigation_timeout: 30s": True, "empty_results": True, "login_wall": False, None: False}),
        (lambda c: text.line_with(c, ["frete"]), {"a\n Frete  grátis \nb": "Frete grátis", "a": None, None: None}),
        (text.trimmed_title, {"🔥 PATROCINADO Mouse Gamer R$ 10,00": "Mouse Gamer", "10% OFF Teclado Mecânico mais de 5 vendidos": "Teclado Mecânico", "x": None, None: None}),
        (title_case, {"atacado-boreal da SERRA": "Atacado-Boreal Da Serra", None: None}),
    ],
)
def test_scalar(spark, f, cases):
    assert _apply(spark, f, list(cases)) == list(cases.values())


def test_product_keys(spark):
    rows = spark.createDataFrame([("s", " 789 ", "K", "t", 1.0), ("s", "", "K" * 300, "t", 1.0), ("s", None, None, "t", None)], "slug string, ean string, sku string, title string, price double")
    out = [r.k for r in rows.select(text.product_key(F.col("slug"), F.col("ean"), F.col("sku"), F.col("title"), F.col("price").cast("decimal(12,2)")).alias("k")).collect()]
    assert out[0] == "s:ean:789" and len(out[1]) == 240 and out[2].startswith("s:title:") and len(out[2]) == 32


def _attributes(spark, *titles):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(titles)], "i int, t string")
    return rows.select("i", F.struct(*(c.alias(n) for n, c in attributes.product_attributes(text.normalized(F.col("t"))).items())).alias("a"))


@pytest.mark.parametrize(
    "left, right, found, penalty",
    [
        ("SSD SATA 480GB Kingston", "SSD NVME 1TB Kingston", {"capacities_conflict", "storage_interfaces_conflict"}, 0.30),
        ("Fonte 650W Cabo HDMI", "Fonte 500W Cabo USB C", {"power_watts_conflict", "connector_interfaces_conflict"}, 0.30),
        ("Carregador USB C Bivolt", "Carregador USB C 110V", set(), 1.0),
        ("Mouse Logitech", "Mouse HP", {"brands_conflict"}, 0.55),
        ("Mouse preto", "Mouse branco", {"colors_conflict"}, 0.70),
        ("Hub USB", "Adaptador USB", set(), 1.0),
        ("", "Mouse", set(), 1.0),
    ],
)
def test_conflicts(spark, left, right, found, penalty):
    a = _attributes(spark, left, right)
    row = a.where("i = 0").select(F.col("a").alias("l")).crossJoin(a.where("i = 1").select(F.col("a").alias("r"))).select(attributes.conflicts(F.col("l"), F.col("r")).alias("c")).select("c", attributes.conflict_penalty(F.col("c")).alias("p")).first()
    assert (set(row.c), row.p) == (found, penalty)


def test_attribute_lists(spark):
    a = _attributes(spark, "Mousepad gamer preto kit com 3", "SSD 480 GB 480GB M.2 NVMe kit 2 pecas", "Logitech M170 5 unidades").orderBy("i").collect()
    assert a[0].a.product_types == ["mousepad"] and a[0].a.colors == ["black"] and a[0].a.pack_quantities == ["3"]
    assert a[1].a.capacities == ["480gb"] and a[1].a.storage_interfaces == ["nvme", "m2"]
    assert a[2].a.brands == ["logitech"] and "m170" in a[2].a.model_codes and a[2].a.pack_quantities == ["5"]


def test_payload_adds_brand_and_model(spark):
    payload = '{"product": {"name": "Mouse sem fio", "attributes": [{"id": "BRAND", "value_name": "Logitech"}, {"id": "MODEL", "value_name": "M170"}]}}'
    rows = spark.createDataFrame([("Mouse Wireless", payload), ("Mouse Wireless", None), (None, "{"), ("Mouse", "[1, null, {\"title\": \"hub\"}]")], "t string, p string")
    a = attributes.described_by(F.col("t"), F.col("p"))
    out = [(r.brands, r.codes) for r in rows.select(a["brands"].alias("brands"), a["model_codes"].alias("codes")).collect()]
    assert out == [(["logitech"], ["m170"]), ([], []), ([], []), ([], [])]


def test_elapsed_and_any_price(spark):
    rows = spark.createDataFrame([(59, "12.5"), (61, "1.234,50"), (7300, "R$ 9,90"), (90000, "x"), (None, None)], "s long, t string")
    out = rows.select(numbers.elapsed(F.col("s")).alias("e"), numbers.any_price(F.col("t")).alias("p")).collect()
    assert [(r.e, r.p) for r in out] == [("59s", 12.5), ("1min", 1234.5), ("2h", 9.9), ("1d", None), ("-", None)]
