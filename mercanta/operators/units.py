"""Quantities stated in different units and number formats (problem 4).

A text is taken apart into a number as written, a scale or unit word and an inner pack count. What a
word and a number format stand for is chosen per source from the identity between columns:

    stated number x unit x inner count = sold_quantity

Every admissible combination of number format and unit is scored by its mean truncated log residual
over all rows of that word, format and source; the smallest wins. Where the runner-up is as good, the
combination is flagged as not unique and the lexicon's first reading holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mercanta.functions.text import fold
from mercanta.runtime import written

#: Unit and scale words with the readings they admit, the first being the usual one.
LEXICON: dict[str, tuple[float, ...]] = {
    "": (1,),
    "mil": (1e3,), "k": (1e3, 1e6), "mi": (1e6, 1e3), "m": (1e6, 1e3), "milhao": (1e6,), "bi": (1e9,),
    "par": (2,), "dz": (12, 10), "cento": (100,), "ct": (100, 10, 1000), "grosa": (144, 12), "milheiro": (1e3,), "mlh": (1e3, 1e6),
}
#: How each word is written once folded.
SPELLINGS = {
    "mil": "mil|thousand", "k": "k", "mi": "mi", "m": "m", "milhao": "milhao|milhoes|million|millones|millon", "bi": "bi|bilhao|bilhoes",
    "par": "par|pares|prs|pr|pairs?", "dz": "dz|dzs|duzias?|doz|dozens?|docenas?", "cento": "centos?", "ct": "ct|cts", "grosa": "grosas?|gross|gz", "milheiro": "milheiros?", "mlh": "mlh|mlhs",
}
NUMBER = r"(?:\d+/\d+|\d[\d.,]*\d|\d|meia|uma?|one|half)"
PACK = r"(?:x|caixas?|cxs?|pcts?|pacotes?|fardos?|kits?|conjuntos?|packs?|displays?|cartelas?|sacos?)"
UNIT = "|".join(SPELLINGS.values())
_SOLD = r"(?:\bvendid[oa]s?\b|\bvend\b|\bsold\b|\bvendas\b|\bcompras\b|\bcomprad[oa]s?\b|\bventas\b)"
_NO_SALE = r"\bvendid[oa] (?:e entregue )?por\b|\bmais vendid|\bestoque\b|\brestam?\b|\blote minimo\b|\bvenda por\b|\branking\b|\bultimas?\b"
#: Residuals beyond this count as this: a row whose sold_quantity is plainly wrong mustn't decide.
CAP = 1.0
UNIQUE_MARGIN = 0.02


def stated(text: Column) -> Column:
    """The text folded and with vulgar fractions written out."""
    plain = F.translate(F.regexp_replace(F.regexp_replace(text, "Â?½", "1/2"), "Â?¼", "1/4"), "⁄∕", "//")
    return F.regexp_replace(F.regexp_replace(fold(plain), r"\bpc\b|\bpcs\b|\bpecas?\b|\bunid(?:ades?)?\b\.?|\bun\b\.?", "un"), r"\bvend\.", "vend")


def parsed(df: DataFrame, key: str, source: str, text: str, quantity: str) -> DataFrame:
    """Rows that state a quantity: key, source, stated, quantity, number as written, word, inner count, shape, decimal, thousands.

    In steps, so that each expression is worked out once.
    """
    pack = rf"({NUMBER}) ?{PACK}\b\.? ?(?:c/|com|de|\()? ?(\d+)"
    plain = rf"(?<![\w.,])({NUMBER})\+? ?(?:({UNIT})\b)?"
    rows = df.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(source).alias("source"), F.col(text).alias("stated"), F.col(quantity).alias("quantity"), stated(F.col(text)).alias("t"))
    # no filter before the table is written: it would be pushed down and repeat the text functions
    rows = rows.select("*", F.col("t").rlike(rf"^(?!.*(?:{_NO_SALE})).*{_SOLD}").alias("sells"), F.col("t").rlike(pack).alias("packed"))
    rows = rows.select("key", "source", "stated", "quantity", "sells", F.when(F.col("packed"), F.regexp_extract("t", pack, 1)).otherwise(F.regexp_extract("t", plain, 1)).alias("number"), F.when(F.col("packed"), "").otherwise(F.regexp_extract("t", plain, 2)).alias("unit"), F.when(F.col("packed"), F.regexp_extract("t", pack, 2).try_cast("double")).otherwise(F.lit(1.0)).alias("inner"))
    word = F.when(F.col("unit") == "", F.lit(""))
    for name, pattern in SPELLINGS.items():
        word = word.when(F.col("unit").rlike(f"^(?:{pattern})$"), F.lit(name))
    shape, decimal, thousands = readings(F.col("number"))
    rows = rows.select("key", "source", "stated", "quantity", F.when(F.col("sells") & (F.col("number") != ""), F.col("number")).alias("number"), word.alias("word"), "inner", shape.alias("shape"), decimal.alias("decimal"), thousands.alias("thousands"))
    return written(rows, "stated").where("number IS NOT NULL AND word IS NOT NULL AND decimal IS NOT NULL")


def readings(number: Column) -> tuple[Column, Column, Column]:
    """Shape of a number as written, and its value with the mark as a decimal one and as a thousands one."""
    shape = (
        F.when(number.rlike(r"^\d+$"), "whole").when(number.rlike(r"^\d{1,3}(?:\.\d{3})+$"), "dot3").when(number.rlike(r"^\d{1,3}(?:,\d{3})+$"), "comma3")
        .when(number.rlike(r"^\d+\.\d+$"), "dot").when(number.rlike(r"^\d+,\d+$"), "comma").when(number.rlike(r"^\d+/\d+$"), "fraction").when(number.rlike("^[a-z]"), "name").otherwise("mixed")
    )
    fraction = F.try_divide(F.split_part(number, F.lit("/"), F.lit(1)).try_cast("double"), F.split_part(number, F.lit("/"), F.lit(2)).try_cast("double"))
    named = F.when(number.isin("meia", "half"), 0.5).otherwise(1.0)
    last_mark = F.regexp_replace(number, r"[.,](?=.*[.,])", "")  # marks before the last one part thousands
    decimal = F.when(shape == "fraction", fraction).when(shape == "name", named).otherwise(F.translate(last_mark, ",", ".").try_cast("double"))
    thousands = F.when(shape.isin("fraction", "name"), decimal).otherwise(F.regexp_replace(number, "[.,]", "").try_cast("double"))
    return shape, decimal, thousands


#: Number formats that a shape admits; shapes not named here have one reading.
_FORMATS = {"dot3": ("thousands", "decimal"), "comma3": ("thousands", "decimal")}
_SHAPES = ("whole", "dot3", "comma3", "dot", "comma", "fraction", "name", "mixed")


def _options(spark: SparkSession) -> DataFrame:
    """Every admissible reading of a word and shape, with its place by usage: the lexicon times the shapes."""
    rows = []
    for word, factors in LEXICON.items():
        for shape in _SHAPES:
            forms = _FORMATS.get(shape, ("decimal",))
            if word:  # beside a unit or scale word a single mark is a decimal one first
                forms = forms[::-1]
            rows += [(word, shape, form, float(factor), 10 * i + k) for i, form in enumerate(forms) for k, factor in enumerate(factors)]
    return spark.createDataFrame(rows, "word string, shape string, form string, factor double, usual int")


def fit_units(rows: DataFrame) -> DataFrame:
    """The reading of each (source, word, shape) of ``parsed`` rows: form, factor, mean residual, support, is_unique.

    Equal rows are counted before anything else. The options table has a fixed size and is broadcast.
    """
    counts = rows.groupBy("source", "word", "shape", "decimal", "thousands", "inner", "quantity").agg(F.count("*").alias("n"))
    tried = counts.join(F.broadcast(_options(rows.sparkSession)), ["word", "shape"])
    value = F.round(F.col("factor") * F.col("inner") * F.when(F.col("form") == "decimal", F.col("decimal")).otherwise(F.col("thousands")))
    counts_in = (F.col("quantity") > 0) & (value > 0)
    residual = F.when(counts_in, F.least(F.abs(F.ln(F.col("quantity").cast("double")) - F.ln(value)), F.lit(CAP)))
    weight = F.when(counts_in, F.col("n")).otherwise(0)
    scored = tried.groupBy("source", "word", "shape", "form", "factor", "usual").agg(F.coalesce(F.try_divide(F.sum(residual * F.col("n")), F.sum(weight)), F.lit(CAP)).alias("residual"), F.sum(weight).alias("support"))
    # few rows a group: the options of one word and shape
    groups = scored.groupBy("source", "word", "shape").agg(F.array_sort(F.collect_list(F.struct("residual", "usual", "form", "factor"))).alias("o"), F.min(F.struct("usual", "residual", "form", "factor")).alias("u"), F.max("support").alias("support"))
    unique = (F.size("o") == 1) | ((F.col("support") >= 5) & (F.try_element_at("o", F.lit(2))["residual"] - F.col("o")[0]["residual"] > UNIQUE_MARGIN))

    def pick(part: str) -> Column:
        return F.when(unique, F.col("o")[0][part]).otherwise(F.col("u")[part]).alias(part)

    return groups.select("source", "word", "shape", "support", pick("form"), pick("factor"), pick("residual"), F.coalesce(unique, F.lit(False)).alias("is_unique"), F.size("o").alias("readings"))


def common_units(df: DataFrame, key: str, source: str, text: str, quantity: str) -> DataFrame:
    """Every stated quantity in single pieces.

    Columns: key, source, stated text, quantity as delivered, number, word, factor, units_sold, is_unique.
    Rows that state nothing (NULL or empty text, sellers, ranks, stock) are left out; NULL, zero or
    negative quantities don't take part in the fit; repeated rows each have a row. NULL sources fit together.
    The table of readings has at most sources x words x shapes rows and is joined by AQE's choice.
    """
    rows = parsed(df, key, source, text, quantity)
    fit = fit_units(rows)
    r, f = rows.alias("r"), fit.alias("f")
    joined = r.join(f, F.col("r.source").eqNullSafe(F.col("f.source")) & (F.col("r.word") == F.col("f.word")) & (F.col("r.shape") == F.col("f.shape")))
    value = F.when(F.col("f.form") == "decimal", F.col("r.decimal")).otherwise(F.col("r.thousands")) * F.col("f.factor") * F.col("r.inner")
    return joined.select("r.key", "r.source", "r.stated", "r.quantity", "r.number", "r.word", "f.factor", "f.is_unique", F.round(value).try_cast("bigint").alias("units_sold")).where(F.col("units_sold").isNotNull())
