"""Column builders for text normalisation. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented Latin letters and what they fold to (position by position).
ACCENTED = "áàâãäåéèêëíìîïóòôõöúùûüçñýÿÁÀÂÃÄÅÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑÝŠšŽžŸ"
FOLDED = "aaaaaaeeeeiiiiooooouuuucnyyAAAAAAEEEEIIIIOOOOOUUUUCNYSsZzY"

#: UTF-8 read as Latin-1 or cp1252: the letter after "Ã", as a character class, and the letter meant.
_DAMAGED = [
    ("Ã[ -¥]", "a"), ("Ã§", "c"), ("Ã[¨-«]", "e"), ("Ã[¬-¯]", "i"), ("Ã±", "n"),
    ("Ã[²-¶]", "o"), ("Ã[¹-¼]", "u"), ("Ã[\u0080-\u0085€‚ƒ„…]", "A"), ("Ã[\u0087‡]", "C"),
    ("Ã[\u0088-\u008bˆ‰Š‹]", "E"), ("Ã[\u008c-\u008fŒŽ]", "I"), ("Ã[\u0092-\u0096’“”•–]", "O"), ("Ã[\u0099-\u009c™š›œ]", "U"), ("Â([ -¿])", "$1"),
]


def repair(text: Column) -> Column:
    """Undo UTF-8 that was read as Latin-1 or cp1252. Letters come out without accents; NULL stays NULL."""
    for pattern, letter in _DAMAGED:  # a chain that names its input once: guards would double the code at every level
        text = F.regexp_replace(text, pattern, letter)
    return text


def spaces(text: Column) -> Column:
    """Every run of white space, no-break spaces included, becomes one space; ends are trimmed."""
    return F.trim(F.regexp_replace(text, "[\\s  -​ 　﻿]+", " "))


def fold(text: Column) -> Column:
    """Lower case, accents removed, damage repaired, spaces single. The common form for matching."""
    plain = F.regexp_replace(F.translate(repair(text), ACCENTED, FOLDED), "\\p{M}+", "")
    return F.lower(spaces(plain))


def words(text: Column) -> Column:
    """``fold`` with everything but letters and digits as a space."""
    return F.trim(F.regexp_replace(fold(text), "[^a-z0-9]+", " "))


#: Words that carry no meaning in titles.
STOPWORDS = "a as ao aos com da das de do dos e em na nas no nos o os para por sem uma um un".split()
#: Words that many products share.
GENERIC = "adaptador audio cabo carregador combo controle femea fio fone gamer hub kit macho mouse notebook para preto sem suporte teclado usb video wireless".split()
#: Words left out of title keys.
KEY_STOPWORDS = "de da do das dos com para por em a o e r rs br".split()


def _texts(values: list[str]) -> Column:
    return F.array(*(F.lit(v) for v in values))


def tokens(normalized: Column) -> Column:
    """Distinct words in order, without stop words and without words under three letters that have no digit."""
    split = F.filter(F.split(normalized, " "), lambda w: (w != "") & (w.rlike("[0-9]") | (F.length(w) >= 3)))
    return F.array_distinct(F.filter(split, lambda w: ~w.isin(STOPWORDS)))


def model_tokens(words_: Column) -> Column:
    """The words that hold a digit."""
    return F.filter(words_, lambda w: w.rlike("[0-9]"))


def title_key(normalized: Column) -> Column:
    """The first 18 words that aren't in the key's own stop list."""
    kept = F.filter(F.split(normalized, " "), lambda w: (w != "") & ~w.isin(KEY_STOPWORDS))
    return F.array_join(F.slice(kept, 1, 18), " ")


def is_generic_title(words_: Column) -> Column:
    """No word with a digit, at most one word that isn't generic, at most five words."""
    special = F.size(F.array_except(words_, _texts(GENERIC)))
    return (F.size(model_tokens(words_)) == 0) & (special <= 1) & (F.size(words_) <= 5)


#: Categories by the terms that name them, in order of precedence.
CATEGORIES = [
    ("mousepad", ["mouse pad", "mousepad"]), ("webcam", ["webcam", "camera web"]), ("mouse", ["mouse", "mice"]), ("teclado", ["teclado", "keyboard"]),
    ("headset_fone", ["headset", "fone", "fones", "headphone", "earphone"]), ("hub_adaptador", ["hub", "adaptador", "adapter", "wifi usb"]), ("cabo", ["cabo", "cable", "usb c", "hdmi"]),
    ("notebook_acessorio", ["suporte notebook", "cooler notebook"]), ("notebook", ["notebook", "laptop"]),
]


def has_term(normalized: Column, terms: list[str]) -> Column:
    """Whether any of the terms occurs as whole words."""
    return normalized.rlike(r"(?:^| )(?:" + "|".join(terms) + r")(?: |$)")


def category(normalized: Column) -> Column:
    """The first category whose terms occur, else ``outros``."""
    rule = F
    for name, terms in CATEGORIES:
        rule = rule.when(has_term(normalized, terms), F.lit(name))
    return rule.otherwise(F.lit("outros"))


#: Signs of a page that refused to answer, in order of precedence.
BLOCK_SIGNS = [
    ("captcha", ["captcha", "digite os caracteres", "verifique que voce", "verify you are", "deslize para verificar", "unusual traffic"]),
    ("bot_block", ["robo", "robot", "automated access", "acesso automatizado"]),
    ("access_denied", ["access denied", "acesso negado", "not authorized", "unauthorized", "nao e possivel acessar", "não é possível acessar", "erro 403", "403 forbidden", "request blocked"]),
    ("login_wall", ["faca login", "entre para continuar", "sign in to continue"]),
]


def block_reason(page: Column) -> Column:
    """Why a page counts as blocked, NULL if it doesn't."""
    low = F.lower(page)
    rule = F
    for reason, signs in BLOCK_SIGNS:
        rule = rule.when(low.rlike("|".join(signs)), F.lit(reason))
    return rule.otherwise(F.lit(None).cast("string"))


def is_retryable(reason: Column) -> Column:
    return F.coalesce(reason.isin("empty_results", "captcha", "bot_block", "access_denied") | reason.startswith("navigation_timeout"), F.lit(False))


def line_with(text: Column, needles: list[str]) -> Column:
    """The first line that holds a needle (any case), spaces single; NULL if none does."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.lower(x).rlike("|".join(needles)))
    return F.nullif(spaces(F.try_element_at(lines, F.lit(1))), F.lit(""))


def trimmed_title(text: Column) -> Column:
    """A card's title: leading marks and promotion words cut, cut off at price, rating or sales talk; NULL under 8 letters."""
    t = F.regexp_replace(spaces(text), r"^[^A-Za-z0-9À-ÿ]+", "")
    for pattern in (r"(?i)^(?:SELO:\s*)?CUPOM\s+\S+\s+", r"(?i)^Avalia[cç][aã]o\s+\d+(?:[.,]\d+)?\s+de\s+\d+(?:[.,]\d+)?\s*", r"(?i)^\d+%\s+OFF\s+", r"(?i)^\d+\s+UNID\s+"):
        t = F.regexp_replace(t, pattern, "")
    t = F.regexp_replace(t, r"(?i)(?:\s+de)?\s+R\$.*$|\s+De:\s*$|\s+\d[,.]\d\s+\d[,.]\d\s+de\s+5\s+estrelas.*$|\s+mais\s+de\s+\d.*$", "")
    t = spaces(F.regexp_replace(t, r"(?i)^(?:patrocinado|sponsored|an[uú]ncio|escolha da amazon)\s+", ""))
    return F.when(F.length(t) >= 8, F.substring(t, 1, 250))


def product_key(slug: Column, ean: Column, sku: Column, title: Column, price: Column) -> Column:
    """A stable key: by EAN, else by SKU, else by a digest of slug, title and price text (a NULL price is ``None``)."""
    e, s = F.nullif(F.trim(ean), F.lit("")), F.nullif(F.trim(sku), F.lit(""))
    digest = F.substring(F.sha2(F.concat_ws("|", slug, F.coalesce(title, F.lit("None")), F.coalesce(price.cast("string"), F.lit("None"))), 256), 1, 24)
    return F.when(e.isNotNull(), F.substring(F.concat(slug, F.lit(":ean:"), e), 1, 240)).when(s.isNotNull(), F.substring(F.concat(slug, F.lit(":sku:"), s), 1, 240)).otherwise(F.concat(slug, F.lit(":title:"), digest))


def normalized(text: Column) -> Column:
    """Lower case without accents, all but letters and digits as single spaces; damage is left as it is. NULL gives empty text."""
    plain = F.lower(F.translate(F.coalesce(text, F.lit("")), ACCENTED, FOLDED))
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))


def redecoded(text: Column) -> Column:
    """UTF-8 that was read as Latin-1 read again, accents kept; texts that don't come out whole stay as they are."""
    again = F.try_validate_utf8(F.encode(text, "ISO-8859-1").cast("string"))
    marked = text.rlike("[ÃÂâ]") & text.rlike(r"^[\x{00}-\x{FF}]*$")
    return F.when(marked & (F.length(again) >= F.greatest(F.lit(3), F.floor(F.length(text) / 2))), again).otherwise(text)
