"""Listings and catalogue rows of the same product (problem 3).

Standard identifiers (checksum-validated), part numbers and measured attributes are taken out of every title and
normalised; an offer with several titles takes the reading most of them agree on. Brands and line names are learned
from the words themselves: a line name stands beside one part number, a brand beside many, and in most titles of
each. Names of one model are joined on reliable keys and form guarded connected components: part numbers, shared
identifiers and typing slips are the links, labels spread round by round, and a component never holds two part
numbers, two brands or prices far apart. Records are of the same product if model and every attribute agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mercanta.functions.text import fold
from mercanta.runtime import table, written

#: Product types by the words that name them, tried in this order.
TYPES = [
    ("hub", r"\bhubs?\b|\bmultiplicador usb\b"),
    ("power_bank", r"\bpower ?bank\b|\bcarregador portatil\b|\bbateria externa\b"),
    ("mouse_pad", r"\bmouse ?pad\b"),
    ("headset", r"\bhead(?:set|phone)s?\b|\bfone\b"),
    ("keyboard", r"\bteclados?\b"),
    ("mouse", r"\bmouses?\b"),
    ("ssd", r"\bssd\b"),
    ("memory", r"\bmemorias?\b|\bddr ?-?\d\b"),
    ("usb_c_cable", r"\b(?:cabo|cb)\b.*\b(?:usb[ -]?c|tipo[ -]c)\b"),
    ("hdmi_cable", r"\b(?:cabo|cb)\b.*\bhdmi\b"),
    ("charger", r"\bcarregador\b"),
    ("power_supply", r"\bfontes?\b"),
    ("webcam", r"\bweb ?cam\b|\bcamera\b"),
    ("battery", r"\bpilhas?\b"),
    ("power_strip", r"\bfiltro de linha\b|\bregua de tomadas\b|\bextensao\b"),
    ("lamp", r"\blampadas?\b|\blamp\b"),
]
#: Colours by their words.
COLOURS = {"black": "preto|preta|black|pto", "white": "branco|branca|white|bco", "blue": "azul|blue|az", "red": "vermelho|vermelha|red|verm", "green": "verde|green|vde", "pink": "rosa|rose|pink", "grey": "cinza|grey|gray|cza"}
#: Words that are no line name (types, attributes, units, sales talk).
KNOWN = """acessorio adaptador abnt alcalina alimentacao alta americano bateria bivolt black bluetooth branca branco brinde bulbo cabo camera carregador
cinza compre dados desconto desktop disco eletrica entrega envio estoque exclusivo extensao externa filtro fiscal fone fonte frete full gamer garantia gaming gigas gratis green
headset headphone hoje imediata imediato interno lacrado lampada lancamento layout limitada linha memoria mecanico meses melhor metros microfone mouse multiplicador
nota novo oferta optico original padrao palito parede parts patrocinado pecas pente pequena pilha pilhas pink portas portatil ports power preco preta preto premium profissional promo promocao pronta
qualidade queima regua rosa sata hdmi nvme pcie tipo azul roxo rose wifi full gbps mbps frio quente pack kits para sem com novo nova super teclado tech tera tomadas turbo unidades verde vermelha vermelho video volts watts webcam white wireless usada usado anuncio importado nacional relampago imperdivel""".split()
UNITS_AFTER = r"(?:dpi|m?ah|mhz|ghz|mm|cm|mts?|metros?|m(?!\.)|k|w|v|gb|tb|un|pcs?|pecas?|lumens?)\b"
#: Words and units that no part number starts or ends with.
_NO_START = r"(?!(?:usb|ddr|hdmi|sata|cat|tipo|type|gen|kit|pack|com|hd|hz|mhz|ghz|dpi|mah|led|aaa?|bt|ps|x|cabo|ate|de|ref|nf)[-/]?\d)"
_NO_END = r"(?!(?:cm|mm|mt|gb|tb|mb|hz|w|v|g|k|m|un|pc)\b)"
#: Two or three letters and five digits or more, as one word or with a mark or blank between them; or fewer digits, as one word or with a mark between them.
CODE = rf"\b(?:([a-z]{{2,3}})[ /-]?(\d{{5,6}})|{_NO_START}([a-z]{{1,6}})[-/]?(\d{{3,4}}{_NO_END}[a-z]{{0,2}}))\b(?![.,]?\d| ?(?:{UNITS_AFTER}))"
#: Attributes that titles state; those that tell variants of a type apart are named by type, of other types each one is looked at.
FIELDS = ["capacity", "watts", "volts", "link", "colour", "length", "pack", "dpi", "speed", "charge", "bus", "layout", "picture", "ports", "outlets", "size", "generation"]
BY_TYPE = {
    "mouse": ("dpi", "link", "colour"), "keyboard": ("layout", "link", "colour"), "headset": ("link", "colour"), "ssd": ("bus", "capacity"), "memory": ("capacity", "generation", "speed"),
    "usb_c_cable": ("colour", "length", "pack"), "hdmi_cable": ("length", "pack"), "charger": ("watts", "colour"), "power_bank": ("charge", "colour"), "power_supply": ("watts", "volts"), "webcam": ("picture", "colour"),
    "hub": ("ports", "colour"), "battery": ("size", "pack"), "power_strip": ("outlets", "length"), "lamp": ("watts", "volts", "pack"), "mouse_pad": ("colour", "pack"),
}
OTHER = ("capacity", "watts", "volts", "link", "colour", "length", "pack", "size", "generation")
#: A name belongs to a part number that holds this share of its coded records; a brand is in this share of the records of at least so many part numbers.
OWNED, BRAND_SHARE, BRAND_CODES = 2 / 3, 0.5, 3
#: A typing slip joins no names whose ranges of prices (over all variants) are further apart than this factor.
PRICE_FACTOR = 4.0


def gtin(text: Column) -> Column:
    """A valid GTIN-8/12/13/14 as 14 digits, else NULL: marks removed, fillers rejected, check digit proved."""
    digits = F.regexp_replace(F.regexp_replace(text, r"\.0+$", ""), r"[^0-9]", "")
    padded = F.lpad(digits, 14, "0")
    total = F.aggregate(F.sequence(F.lit(1), F.lit(13)), F.lit(0), lambda a, i: a + F.substring(padded, i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 3).otherwise(1))
    valid = F.pmod(-total, F.lit(10)) == F.substring(padded, 14, 1).cast("int")
    filler = digits.rlike(r"^(\d)\1+$") | (digits == "1234567890123")
    return F.when(F.length(digits).isin(8, 12, 13, 14) & ~filler & valid, padded)


def _number(t: Column, pattern: str) -> Column:
    """The first match as a number; a mark before exactly three digits parts thousands."""
    x = F.regexp_extract(t, pattern, 1)
    return F.when(x.rlike(r"^\d+[.,]\d{3}$"), F.regexp_replace(x, "[.,]", "")).otherwise(F.translate(x, ",", ".")).try_cast("double")


def _decimal(t: Column, pattern: str) -> Column:
    return F.translate(F.regexp_extract(t, pattern, 1), ",", ".").try_cast("double")


def _whole(x: Column) -> Column:
    return F.round(x).cast("bigint").cast("string")


def attributes(t: Column) -> Column:
    """What a title states of each of FIELDS, NULL where it states nothing (a pack of one). ``t`` is folded text without part numbers."""
    n = r"(\d+(?:[.,]\d+)?)"
    terabyte, gigabyte = _decimal(t, n + r" ?(?:tb|tera)s?\b"), _decimal(t, r"(?<![\d.,])(\d+) ?(?:gb|gigas?|g)\b")
    capacity = _whole(F.coalesce(terabyte * 1000, gigabyte))
    watts = _whole(F.coalesce(_decimal(t, n + r" ?kw\b") * 1000, _decimal(t, n + r" ?(?:w|watts?)\b")))
    volts = F.when(t.rlike(r"\bbi-?volt\b|\b1\d\d ?[/-] ?2\d\d ?v"), "bi").when(t.rlike(r"\b(?:220|230|240) ?v"), "220").when(t.rlike(r"\b1[0-3]\d ?v"), "110")
    link = F.when(t.rlike(r"\bbluetooth\b|\bbt\b"), "bluetooth").when(t.rlike(r"\bsem fio\b|\bs/ ?fio\b|\bwireless\b"), "wireless").when(t.rlike(r"\bcom fio\b|\bc/ ?fio\b|\busb\b"), "wired")
    colour = F.lit(None).cast("string")
    for name, pattern in COLOURS.items():
        colour = F.coalesce(colour, F.when(t.rlike(rf"\b(?:{pattern})\b"), F.lit(name)))
    metres = F.coalesce(_decimal(t, n + r" ?mm\b") / 1000, _decimal(t, n + r" ?cm\b") / 100, _decimal(t, n + r" ?(?:mts?|metros?|m)\b"))
    length = _whole(metres * 1000)
    pack = F.coalesce(*(F.nullif(F.regexp_extract(t, p, 1), F.lit("")) for p in (r"\bkit (?:com|c/) ?(\d+)\b", r"\bpack (?:com |c/ ?)?(\d+)\b", r"\bc/ ?(\d+) ?(?:pcs?|pecas?|un)\b", r"\b(\d+) ?(?:un|unid|unidades?|pecas?|pcs)\b")), F.lit("1"))
    dpi = _whole(_number(t, r"(\d+(?:[.,]\d{3})?) ?dpi\b"))
    speed = _whole(F.coalesce(_decimal(t, n + r" ?ghz\b") * 1000, _decimal(t, n + r" ?mhz\b")))
    charge = _whole(F.coalesce(_decimal(t, r"(?<![\d.,])(\d+)k ?mah\b") * 1000, _number(t, r"(\d+(?:[.,]\d{3})?) ?mah\b"), _decimal(t, n + r" ?ah\b") * 1000))
    bus = F.when(t.rlike(r"\bnvme\b|\bm\.?2\b|\bpcie\b"), "nvme").when(t.rlike(r"\bsata\b"), "sata")
    layout = F.when(t.rlike(r"\babnt-?2?\b|\bbr\b"), "br").when(t.rlike(r"\bamericano\b|\bus\b"), "us")
    picture = F.when(t.rlike(r"\b4k\b|\b2160 ?p\b|\buhd\b"), "2160").when(t.rlike(r"\b2k\b|\b1440 ?p\b|\bqhd\b"), "1440").when(t.rlike(r"\b1080 ?p\b|\bfull hd\b|\bfhd\b"), "1080").when(t.rlike(r"\b720 ?p\b|\bhd\b"), "720")
    ports = F.regexp_extract(t, r"\b(\d+) ?(?:portas?|ports?|p)\b", 1)
    outlets = F.regexp_extract(t, r"\b(\d+) ?(?:tomadas?|tom)\b", 1)
    size = F.when(t.rlike(r"\baaa\b|\bpalito\b"), "aaa").when(t.rlike(r"\baa\b|\bpequena\b"), "aa")
    generation = F.regexp_extract(t, r"\bddr ?-?(\d)\b", 1)
    values = (capacity, watts, volts, link, colour, length, pack, dpi, speed, charge, bus, layout, picture, ports, outlets, size, generation)
    return F.struct(*(F.nullif(v, F.lit("")).alias(name) for name, v in zip(FIELDS, values)))


def variant(kind: Column, stated: str) -> Column:
    """The attributes that tell variants of the type apart, as one text; unread ones as ?, of other types as -."""
    text = lambda names, missing: F.concat_ws("|", *(F.coalesce(F.col(f"{stated}.{n}"), F.lit(missing)) for n in names))
    out = text(OTHER, "-")
    for name, fields in BY_TYPE.items():
        out = F.when(kind == name, text(fields, "?")).otherwise(out)
    return out


def readings(records: DataFrame) -> DataFrame:
    """(key, price, gtin, code, kind, stated, words): one row a key, the reading most of its rows agree on.

    ``records``: (key, title, ean, price, n). Whole titles; equal ones of a key are read once. A valid GTIN stands in ``ean`` or in the title.
    """
    # marks inside numbers were commas: keep them
    t = F.regexp_replace(fold(F.regexp_replace(F.col("title"), r"(\d),(\d)", r"$1.$2")), r"[^a-z0-9./ -]+", " ")
    rows = records.select("key", "n", "price", gtin(F.col("ean")).alias("ean"), F.concat(F.lit(" "), F.coalesce(t, F.lit("")), F.lit(" ")).alias("t"))
    part = lambda i: F.regexp_extract("t", CODE, i)
    code = F.nullif(F.concat(part(1), part(2), part(3), part(4)), F.lit(""))
    rows = rows.select("key", "n", "price", F.coalesce("ean", gtin(F.nullif(F.regexp_extract("t", r"\b(\d{12,14})\b", 1), F.lit("")))).alias("gtin"), code.alias("code"), F.when(code.isNull(), F.col("t")).otherwise(F.regexp_replace("t", CODE, " ")).alias("t"))
    kind = F.lit(None).cast("string")
    for name, pattern in TYPES:
        kind = F.coalesce(kind, F.when(F.col("t").rlike(pattern), F.lit(name)))
    rest = F.array_except(F.split(F.trim(F.regexp_replace("t", r"[^a-z]+", " ")), " "), F.array(*(F.lit(w) for w in KNOWN)))
    words = F.filter(rest, lambda w: F.length(w) >= 4)
    rows = rows.select("key", "n", "price", F.struct("gtin", "code", kind.alias("kind"), attributes(F.col("t")).alias("stated")).alias("r"), words.alias("words"))
    agreed = rows.groupBy("key", "r").agg(F.sum("n").alias("n"), F.max_by("words", F.struct("n", "words")).alias("words"), F.max("price").alias("price"))
    filled = F.size(F.array_compact(F.array(F.col("r.gtin"), F.col("r.code"), F.col("r.kind"), *(F.col(f"r.stated.{f}") for f in FIELDS))))
    best = agreed.groupBy("key").agg(F.max(F.struct("n", filled.alias("filled"), "r", "words", "price")).alias("b"))
    return best.select("key", "b.price", "b.r.*", "b.words")


def learned(rows: DataFrame) -> DataFrame:
    """``readings`` with ``line`` and ``brand``: the words of a record that the data show to be such.

    A word that stands mostly beside one part number of a type is a line name, the most frequent of a record is
    its line. A word that most records of several part numbers hold is a brand. Words beside no part number may be line names.
    """
    w = rows.select("key", F.coalesce("kind", F.lit("")).alias("type"), "code", F.posexplode("words").alias("at", "word"))
    counts = written(w.groupBy("type", "word", "code").agg(F.count("*").alias("n")), "word-counts")
    coded = counts.where("code IS NOT NULL")
    of_code = rows.where("code IS NOT NULL").groupBy("code").agg(F.count("*").alias("of_code"))
    held = coded.groupBy("word", "code").agg(F.sum("n").alias("n")).join(of_code, "code").withColumn("most", F.col("n") >= F.col("of_code") * BRAND_SHARE)
    brands = held.groupBy("word").agg(F.sum(F.col("most").cast("int")).alias("codes"), F.sum(F.when(F.col("most"), F.col("n")).otherwise(0)).alias("held"), F.sum("n").alias("n"))
    brands = brands.where((F.col("codes") >= BRAND_CODES) & (F.col("held") >= 0.8 * F.col("n"))).select("word", F.lit(True).alias("is_brand"))
    top = coded.groupBy("type", "word").agg(F.max("n").alias("top"), F.sum("n").alias("coded"))
    lines = counts.groupBy("type", "word").agg(F.sum("n").alias("n")).join(top, ["type", "word"], "left").join(brands, "word", "left")
    own = F.coalesce(F.col("top") >= F.col("coded") * OWNED, F.lit(True)) & (F.length("word") >= 5) & F.col("is_brand").isNull()
    lines = written(lines.select("type", "word", F.coalesce("is_brand", F.lit(False)).alias("is_brand"), F.when(own, F.col("n")).alias("weight")), "words")
    told = w.select("key", "type", "at", "word").join(lines, ["type", "word"]).groupBy("key").agg(F.min_by("word", F.when(F.col("is_brand"), F.col("at"))).alias("brand"), F.max_by("word", F.when(F.col("weight").isNotNull(), F.struct("weight", -F.col("at")))).alias("line"))
    # a record without a readable type has the type of its part number
    kinds = rows.where("code IS NOT NULL AND kind IS NOT NULL").groupBy("code", "kind").agg(F.count("*").alias("n")).groupBy("code").agg(F.max_by("kind", F.struct("n", "kind")).alias("code_kind"))
    full = rows.drop("words").join(told, "key", "left").join(kinds, "code", "left")
    full = full.withColumn("kind", F.coalesce("kind", "code_kind", F.when(F.col("code").isNotNull(), F.lit("other"))))
    return full.select("key", "price", "gtin", "code", "kind", "brand", "line", variant(F.col("kind"), "stated").alias("variant"))


def extracted(records: DataFrame) -> DataFrame:
    """(key, price, gtin, code, kind, brand, line, variant) of (key, title, ean) or, with rows already counted, (key, title, ean, price, n)."""
    for name, default in (("price", F.lit(None).cast("double")), ("n", F.lit(1).cast("bigint"))):
        if name not in records.columns:
            records = records.withColumn(name, default)
    return written(learned(written(readings(records), "readings")), "records")


def _shortened(line: Column) -> Column:
    """The name and the name without one letter, for each letter: names one typing slip apart share one."""
    return F.array_distinct(F.concat(F.array(line), F.transform(F.sequence(F.lit(1), F.length(line)), lambda i: F.concat(F.substring(line, F.lit(1), i - 1), F.substring(line, i + 1, F.length(line))))))


def _clash(left: Column, right: Column) -> Column:
    return left.isNotNull() & right.isNotNull() & (left != right)


def model_names(rows: DataFrame) -> DataFrame:
    """(kind, line, brand, model): what each line name of a type stands for.

    Links from a name to a part number, the strongest first: the name beside the number in a text (a number that
    holds OWNED of them, so a stray one doesn't join two models); a valid GTIN that the name shares with one number,
    type and attributes being equal; typing slips, over any number of names. A brand that differs forbids a link, and
    so does a price that is far off. Names without any link are centres of their own.
    """
    coded = rows.where("code IS NOT NULL")
    brand_of = coded.where("brand IS NOT NULL").groupBy("kind", "code", "brand").agg(F.count("*").alias("n")).groupBy("kind", "code").agg(F.max_by("brand", F.struct("n", "brand")).alias("code_brand"))
    counts = written(rows.where("line IS NOT NULL").groupBy("kind", "line", "brand", "code").agg(F.count("*").alias("n"), F.min("price").alias("low"), F.max("price").alias("high")), "names")
    brands = counts.where("brand IS NOT NULL").groupBy("kind", "line", "brand").agg(F.sum("n").alias("n")).groupBy("kind", "line").agg(F.max_by("brand", F.struct("n", "brand")).alias("brand"))
    direct = counts.where("code IS NOT NULL").groupBy("kind", "line", "code").agg(F.sum("n").alias("n")).groupBy("kind", "line").agg(F.max_by("code", F.struct("n", "code")).alias("code"), F.max("n").alias("most"), F.sum("n").alias("all")).where(F.col("most") >= F.col("all") * OWNED).drop("most", "all")
    names = counts.groupBy("kind", "line").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).join(brands, ["kind", "line"], "left").join(direct, ["kind", "line"], "left").join(brand_of, ["kind", "code"], "left")
    names = written(names.withColumn("brand", F.coalesce("brand", "code_brand")).drop("code_brand"), "line-names")
    # GTINs that one number clearly owns, for one type and one set of attributes
    proofs = coded.where("gtin IS NOT NULL").groupBy("gtin", "kind", "variant", "code").agg(F.count("*").alias("n")).groupBy("gtin", "kind", "variant").agg(F.max_by("code", F.struct("n", "code")).alias("code"), F.max("n").alias("most"), F.sum("n").alias("all")).where("most * 2 > all").drop("most", "all")
    unlinked = names.where("code IS NULL")
    asked = rows.where("code IS NULL AND line IS NOT NULL AND gtin IS NOT NULL").groupBy("gtin", "kind", "variant", "line").agg(F.count("*").alias("n"))
    proved = asked.join(proofs, ["gtin", "kind", "variant"]).groupBy("kind", "line", "code").agg(F.sum("n").alias("n")).join(brand_of, ["kind", "code"], "left")
    proved = proved.join(unlinked.select("kind", "line", "brand"), ["kind", "line"]).where(~_clash(F.col("brand"), F.col("code_brand")))
    proved = proved.groupBy("kind", "line").agg(F.max_by("code", F.struct("n", "code")).alias("proved"))
    linked = names.join(proved, ["kind", "line"], "left").select("kind", "line", "brand", "n", "low", "high", F.coalesce("code", "proved").alias("model"))
    linked = written(linked, "linked-names")
    # typing slips from open names to all others of the type
    spelled = linked.withColumn("s", F.explode(_shortened(F.col("line"))))
    a, b = spelled.where("model IS NULL").alias("a"), spelled.alias("b")
    far = F.coalesce((F.col("a.low") > F.col("b.high") * PRICE_FACTOR) | (F.col("b.low") > F.col("a.high") * PRICE_FACTOR), F.lit(False))
    slips = a.join(b, (F.col("a.kind") == F.col("b.kind")) & (F.col("a.s") == F.col("b.s")) & (F.col("a.line") != F.col("b.line")))
    slips = slips.where(~_clash(F.col("a.brand"), F.col("b.brand")) & ~far & (F.levenshtein("a.line", "b.line") <= 2))
    slips = written(slips.select("a.kind", "a.line", F.col("b.line").alias("other")).distinct(), "slips")
    nodes = _components(linked.select("kind", "line", "model"), slips)
    return linked.select("kind", "line", "brand").join(nodes, ["kind", "line"])


def _components(nodes: DataFrame, slips: DataFrame) -> DataFrame:
    """(kind, line, model): models spread over slips, round by round until nothing changes; never two part numbers in a component.

    A name without a number takes the one number that its neighbours have; where they have two, it takes neither. What
    no number reaches forms components among itself, named after the first name.
    """
    while True:
        models = nodes.where("model IS NOT NULL").select("kind", F.col("line").alias("other"), "model")
        reach = slips.join(models, ["kind", "other"]).groupBy("kind", "line").agg(F.min("model").alias("low"), F.max("model").alias("high")).where("low = high")
        grown = written(nodes.join(reach, ["kind", "line"], "left").select("kind", "line", F.coalesce("model", "low").alias("model"), (F.col("model").isNull() & F.col("low").isNotNull()).alias("new")), "models")
        nodes = grown.drop("new")
        if grown.where("new").isEmpty():
            break
    open_names = nodes.where("model IS NULL").select("kind", "line", F.col("line").alias("label"))
    among = written(slips.join(open_names.select("kind", F.col("line").alias("other")), ["kind", "other"], "left_semi").join(open_names.select("kind", "line"), ["kind", "line"], "left_semi"), "open-slips")
    while True:
        least = among.join(open_names.select("kind", F.col("line").alias("other"), F.col("label").alias("near")), ["kind", "other"]).groupBy("kind", "line").agg(F.min("near").alias("near"))
        grown = open_names.join(least, ["kind", "line"], "left").select("kind", "line", F.least("label", "near").alias("label"), (F.col("near") < F.col("label")).alias("new"))
        grown = written(grown, "open-labels")
        open_names = grown.drop("new")
        if grown.where("new").isEmpty():
            break
    named = open_names.select("kind", "line", F.concat_ws(":", "kind", "label").alias("model"))
    return nodes.where("model IS NOT NULL").unionByName(named)


def resolved(rows: DataFrame) -> DataFrame:
    """``extracted`` rows with ``model``: the centre of the component that the record's names belong to."""
    names = written(model_names(rows), "model-names")
    r, m = rows.alias("r"), names.alias("m")
    joined = r.join(m, (F.col("r.kind") == F.col("m.kind")) & (F.col("r.line") == F.col("m.line")), "left")
    by_name = F.when(_clash(F.col("r.brand"), F.col("m.brand")), F.concat_ws(":", "r.kind", "r.brand", "r.line")).otherwise(F.col("m.model"))
    return joined.select("r.*", F.coalesce(F.col("r.code"), by_name).alias("model"))


def products(records: DataFrame) -> DataFrame:
    """(key, product): the product group of each record of (key, title, ean), with or without price and count of rows.

    A record without type, model or any attribute of its type takes the group that its valid GTIN has in
    complete records, if these agree on one; else it has a group of its own. NULL and empty titles likewise.
    Whole titles are read. A hot product is a key of counts and joins only; nothing is paired here.
    """
    rows = written(resolved(extracted(records)), "resolved")
    complete = F.col("kind").isNotNull() & F.col("model").isNotNull() & ~F.col("variant").contains("?")
    rows = rows.withColumn("product", F.when(complete, F.concat_ws("/", "kind", "model", "variant")))
    votes = rows.where("gtin IS NOT NULL AND product IS NOT NULL").groupBy("gtin", "product").agg(F.count("*").alias("n"))
    agreed = votes.groupBy("gtin").agg(F.max_by("product", F.struct("n", "product")).alias("by_gtin"), F.max("n").alias("most"), F.sum("n").alias("all")).where("most * 2 > all")
    return rows.join(agreed, "gtin", "left").select("key", "kind", "brand", "code", "line", "model", "variant", "gtin", F.coalesce("product", "by_gtin", F.concat(F.lit("alone/"), "key")).alias("product"))


def market_and_catalogue(spark: SparkSession, root: str) -> DataFrame:
    """(key, title, ean, price, n) of both tables: every title of an offer with the rows that bear it, a catalogue row each."""
    offers = table(spark, root, "market_web_listings_raw").where("item_url IS NOT NULL AND title IS NOT NULL")
    usable = F.when((F.col("price") > 0.01) & (F.col("price") < 1_000_000), F.col("price").cast("double"))
    offers = offers.groupBy(F.col("item_url").alias("key"), "title").agg(F.lit(None).cast("string").alias("ean"), F.exp(F.avg(F.ln(usable))).alias("price"), F.count("*").alias("n"))
    rows = table(spark, root, "supplier_products_normalized").select(F.col("id").alias("key"), F.col("raw_title").alias("title"), "ean", F.when(F.col("supplier_price") > 0, F.col("supplier_price").cast("double")).alias("price"), F.lit(1).cast("bigint").alias("n"))
    return offers.unionByName(rows)


def same_product_pairs(grouped: DataFrame) -> DataFrame:
    """(key_a, key_b), key_a < key_b, of every two records of a product: an equi-join that AQE may split."""
    g = written(grouped.select("key", "product"), "products")
    sizes = g.groupBy("product").agg(F.count("*").alias("n")).where("n > 1").select("product")
    g = written(g.join(sizes, "product", "left_semi"), "grouped")
    a, b = g.select("product", F.col("key").alias("key_a")), g.select("product", F.col("key").alias("key_b"))
    return a.join(b, "product").where("key_a < key_b").select("key_a", "key_b")
