"""Template residue, filler and error-page text (problem 10).

Texts are cut into passages and equal ones are looked at once. A unit is a passage, a window of a long one, or
the words beside an empty slot. Units that hold trusted signs (slots that no template engine filled, filler,
notices of failed or script-only pages) get trusted labels. All units get a SimHash; near-duplicates meet in
partitioned tables, are verified by Hamming distance and edit similarity, and the labels spread through the
connected components, round by round, until none grows.

The tables are partitioned by length: texts of which one is less than 0.8 times as long as the other can't be
that similar, so a text meets its own and the two neighbouring classes. A class is split into blocks of bounded
size, labelled against open texts, and Hamming distances of a block are taken at once on 64-bit words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mercanta.functions.text import ACCENTED, FOLDED, repair
from mercanta.runtime import bounded_broadcast, table, written

#: SimHash over letter pairs; columns of 64 bits that hold the set of a text's letter pairs.
GRAM = 2
PAIR_COLUMNS = ["pairs0", "pairs1", "pairs2", "pairs3"]
#: Rows of a block of open and of labelled texts.
OPEN_ROWS, SEED_ROWS = 40_000, 20_000
#: Links: most bits apart, least edit similarity.
MOST_BITS_APART, LEAST_SIMILAR = 20, 0.8
#: Words of a window of a long passage, words from one window to the next, words kept around a trusted sign or beside a slot, and words in which a writer may tell of it.
WINDOW, STRIDE, BESIDE, TOLD_IN = 8, 4, 4, 6

#: Slots that templates leave behind.
SLOTS = [
    r"\{\{.{0,60}?\}\}", r"\{%.{0,60}?%\}", r"<%.{0,60}?%>", r"\$\{.{0,40}?\}", r"#\{.{0,40}?\}", r"%\(\w{1,30}\)s", r"\*\|\w{1,40}\|\*", r"\[\[.{1,40}?\]\]", r"@@\w{1,40}@@", r"(?<!\w)__[a-z]\w{0,40}__(?!\w)", r"%%\w{1,40}%%", r"<<\w{1,40}>>",
    r"\[(?:inserir|insira|preencher|insert|insertar|your|seu|sua)\b[^\]]{0,40}\]", r"\[[^\]]{1,30}\b(?:aqui|here|aca)\]", r"\[[a-z]+_[a-z_]+\]", r"<(?:preencher|inserir|insert)\b[^>]{0,40}>", r"<[a-z]+(?:_[a-z]+)+>", r"\{(?:\d{1,2}|[a-z_]{3,30}|[a-z]+-[a-z-]+)\}",
    r"\[object object\]", r"\b[a-z]+(?:\.[a-z_]+){1,4}\.(?:label|title|text|name|description|placeholder|message)",
]
#: What programs write for a value that isn't there. Not trusted by themselves: names and talk use the words too.
VOID = r"(?<!\w)(?:undefined|nan|null|none|n/a)(?!\w)"
_LATIN = r"(?:um|us|am|at|et|it|ens|ant|ent|unt|tis|ris)"
#: Filler texts.
FILLER = [
    r"\blorem ipsum\b", r"\bdolor sit amet\b", r"\basdf(?:gh?j?k?l?)?\b", r"\bqwerty qwerty\b", r"\btexto (?:de relleno|provisorio|de exemplo|de prueba|ficticio)\b", r"\b(?:sample|dummy|placeholder|filler) text\b", r"\bplaceholder\b", r"\b(?:paragrafo|paragraph) \d+\.", r"\b(?:titulo principal|subtitulo|main title|subtitle)\b", r"\bsubstitua este texto\b", r"\breplace (?:this text|with the real)\b", r"\b(?:escreva|digite|insira) (?:o texto )?aqui\b",
    r"\b(?:descricao|description) (?:do produto )?(?:aqui|here)\b", r"\bteste de cadastro\b", r"\b(?:apagar depois|delete later|borrar despues)\b", r"\bx{5,}\b", r"^\W*(?<again>\w[\w ]{1,20}?)(?:[\s,;-]+\k<again>){2,}\W*$",
    # five words of four letters or more, three of them close together with Latin endings
    rf"\b(?=(?:[a-z]{{4,}} ){{4}}[a-z]{{4,}}\b)(?:[a-z]+ )??[a-z]+{_LATIN} (?:[a-z]+ )??[a-z]+{_LATIN} (?:[a-z]+ )??[a-z]+{_LATIN}\b",
]
_SCRIPT = r"(?:java ?script|scripts?|js(?! ?-?\d)|cookies|client-side scripting)"
_SWITCH = r"(?:habilit\w*|ativ\w*|activ\w*|lig(?:ar|ad\w*|ue)|permit\w*|enabl\w*|allow\w*|turn(?:ed)? on|precisa\w*|requer\w*|requier\w*|requir\w*|depend\w*|needs?|necesita\w*|sem|without|sin|disponivel apenas)"
#: Names of HTTP errors, in the languages of the texts.
_STATUS = r"(?:not found|bad gateway|gateway time-?out|forbidden|service unavailable|internal server error|unauthorized|too many requests|bad request|request timeout|servico indisponivel|servicio no disponible|acesso negado|acceso denegado|nao encontrad[oa]|no encontrad[oa]|erro interno)"
#: Notices of pages that need scripts, and of pages that failed, were blocked or are gone.
PAGES = [
    rf"\b{_SWITCH}\b[^.!?]{{0,60}}\b{_SCRIPT}\b", rf"\b{_SCRIPT}\b[^.!?]{{0,40}}\b(?:habilitad\w*|ativad\w*|ativos?|activ\w*|enabled|ligad\w*|disabled|desativad\w*)\b", r"\bnoscript\b", r"\b(?:navegador|browser|navegador web)\b[^.!?]{0,20}\b(?:nao suporta|not supported|desatualizad\w*|outdated|no soporta|no es compatible)", r"\b(?:outdated|unsupported) browser\b", r"\b(?:update|upgrade|atualize|actualice) (?:your|seu|o|su) (?:browser|navegador)\b",
    rf"\b(?:erro|error|http|status|codigo)?:? ?[45]\d\d\b[ :-]{{1,3}}{_STATUS}", rf"\b{_STATUS}\b[ :-]{{1,3}}\(?[45]\d\d\b", r"\b(?:http|status|error|erro) ?[45]\d\d\b.{0,60}\b(?:id|ref|retry|owner|fetch|timed|permission|url|policy|unreachable|requests|servidor|gateway|denied|unavailable)\b", rf"^\W*(?:[45]\d\d )?{_STATUS}\W*$", r"^\W*nginx(?:/[\d.]+)?\W*$", r"\bapache/\d",
    r"\b(?:pagina|page|produto|product|anuncio|producto)\b[^.!?]{0,30}\b(?:nao (?:foi )?encontrad[oa]|not found|no (?:fue )?encontrad[oa]|nao existe mais|no longer (?:exists|available)|ya no existe|saiu do ar|esta pausad[oa]|no esta disponible|was removed)\b", r"\brequested url\b", r"\bupstream (?:timed out|connect error)\b", r"\bbackend fetch failed\b", r"\brejected by policy\b", r"\borigin unreachable\b", r"\byou do not have permission\b", r"\baccess to this page\b", r"\baccess denied\b", r"\btoo many requests\b", r"\bcontact the site owner\b",
    r"\bproblema ao (?:montar|carregar|abrir) a pagina\b", r"\bnao foi possivel carregar\b", r"\bnao pode ser carregad", r"\b(?:banco de dados|database)\b[^.!?]{0,20}\b(?:recus|refus|indispon|unavail|err)", r"\btraceback\b", r"\b(?:key|type|value|attribute)error\b", r"\binternal (?:failure|server error)\b", r"\bnull ?(?:pointer|reference)\b", r"\btemporar(?:iamente|ily) (?:indisponivel|unavailable)\b", r"\bem manutencao\b", r"\bunder maintenance\b", r"\b(?:sessao|conexao) expirou\b", r"\bsession (?:has )?expired\b", r"\b(?:faca login|sign in|log in|entre) (?:para|to) contin", r"\b(?:algo deu errado|something went wrong|algo salio mal)\b",
    r"\bacesso foi bloqueado\b", r"\baccess (?:was|has been) blocked\b", r"\bservidor nao respondeu\b", r"\bnao (?:achamos|encontramos) (?:o que|a pagina)\b", r"\b(?:trafego incomum|unusual traffic)\b", r"\b(?:nao e|not a|no es|no eres) (?:um |un )?robo?t?\b", r"\bverify (?:that )?you are (?:a )?human\b", r"\bno esta disponible en este momento\b",
    r"^\W*o{1,2}ps\W*$", r"\b(?:tente|try) (?:novamente em alguns|again later)\b", r"\b(?:volte mais tarde|come back later)\b", r"\b(?:bloqueador|blocker|extensao|extension)\b[^.!?]{0,40}\b(?:carregamento|loading)\b", r"\bimpediu o carregamento\b",
]
#: Words by which a writer speaks of such things instead of showing them: just before the sign, quotes right at it.
TELLING = r"\b(?:eu|meus?|minhas?|tive|fiz|uso|usei|quando|consegui|imprimi|escrevi|exportei|guardei|digitei|contei|li|curso|disse|diz|aparece|yo|mis?|tuve|dice|my|we|he|she|said|says|counted|had|was|saw)\b|['\"]\s*$"

#: Signs without which no slot pattern matches: a cheap look before the patterns.
_SLOT_SIGNS = r"[{<\[%$#@*_]|\.[a-z]"


def _any(patterns: list[str]) -> str:
    """One pattern for all; what they begin with in common, a word's edge, is looked for once a place."""
    words, others = [p[2:] for p in patterns if p.startswith(r"\b")], [p for p in patterns if not p.startswith(r"\b")]
    return "|".join([*others, r"\b(?:" + "|".join(words) + ")"])


_SLOT, _SOFT = _any(SLOTS), _any([*FILLER, *PAGES])


def _parts(text: Column) -> Column:
    """The folded sentences and lines of a text."""
    plain = F.when(text.rlike("[ÃÂ]"), repair(text)).otherwise(text)
    plain = F.lower(F.translate(F.regexp_replace(plain, "[\\u00a0\\u2000-\\u200b\\u202f\\u3000\\ufeff\\t]+", " "), ACCENTED, FOLDED))
    plain = F.when(plain.rlike("\\p{M}"), F.regexp_replace(plain, "\\p{M}+", "")).otherwise(plain)
    return F.transform(F.split(plain, r"(?<=[.!?]) +|\s*[\r\n]\s*"), lambda p: F.trim(F.regexp_replace(p, r"\s{2,}", " ")))


def passages(documents: DataFrame) -> DataFrame:
    """(doc_id, passage): the sentences and lines of each whole text, folded. NULL and empty texts have none."""
    return documents.where("text IS NOT NULL").select("doc_id", F.explode(_parts(F.col("text"))).alias("passage")).where("passage != ''")


def _masked(text: Column) -> Column:
    """Slots and missing values as one sign, hexadecimal codes and numbers as 0."""
    text = F.when(text.rlike(_SLOT_SIGNS) & text.rlike(_SLOT), F.regexp_replace(text, _SLOT, "§")).otherwise(text)
    text = F.when(text.rlike(VOID), F.regexp_replace(text, VOID, "§")).otherwise(text)
    return F.regexp_replace(F.regexp_replace(text, r"\b(?=[a-f0-9]*\d)[a-f0-9]{4,}\b", "0"), r"\d+", "0")


def _last(text: Column, n: int) -> Column:
    words = F.filter(F.split(text, " "), lambda w: w != "")
    return F.array_join(F.slice(words, F.greatest(F.lit(1), F.size(words) - n + 1), F.lit(n)), " ")


def _first(text: Column, n: int) -> Column:
    return F.array_join(F.slice(F.filter(F.split(text, " "), lambda w: w != ""), 1, n), " ")


def _soft(passage: Column) -> tuple[Column, Column]:
    """The words before the first trusted sign of a passage that holds one, and the sign with the words around it."""
    whole = rf"(?s)^(.*?)({_SOFT})(.*)$"
    before, sign, after = (F.regexp_extract(passage, whole, i) for i in (1, 2, 4))
    return _last(before, TOLD_IN), F.trim(F.concat_ws(" ", _last(before, BESIDE), F.trim(sign), _first(after, BESIDE)))


def units_of(distinct: DataFrame) -> DataFrame:
    """(passage, unit, label) of distinct passages; label 1 is trusted residue, 0 open.

    A passage with a trusted sign is labelled by the sign with the words around it, so honest text beside it carries no
    label on. Open passages stand for themselves, long ones also by windows that cover them. Beside every slot, the words
    before it and those after it are units of their own: trusted where a template left the slot, open where a missing
    value stands in its place. A sign that the writer speaks of is none; if another passage of the same text shows it, that one counts.
    """
    p = F.col("passage")
    signs = distinct.select("passage", (p.rlike(_SLOT_SIGNS) & p.rlike(_SLOT)).alias("slot"), p.rlike(_SOFT).alias("sign"))
    before, core = _soft(p)
    told = F.col("sign") & (before.rlike(TELLING) | p.rlike(rf"['\"](?:{_SOFT})"))
    rows = signs.select("passage", "slot", "sign", F.when(F.col("sign"), told).otherwise(False).alias("told"), _masked(p).alias("masked"), F.when(F.col("sign"), _masked(core)).alias("core"))
    words = F.split("masked", " ")
    starts = F.when(F.size(words) > WINDOW, F.sequence(F.lit(1), F.size(words) - WINDOW + STRIDE, F.lit(STRIDE)))
    windows = F.coalesce(F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(WINDOW)), " ")), F.array().cast("array<string>"))
    pieces = F.split("masked", "§")
    left = F.transform(F.slice(pieces, F.lit(1), F.greatest(F.lit(0), F.size(pieces) - 1)), lambda x: F.when(F.trim(x) != "", F.concat(_last(x, BESIDE), F.lit(" §"))))
    right = F.transform(F.slice(pieces, F.lit(2), F.greatest(F.lit(0), F.size(pieces) - 1)), lambda x: F.when(F.trim(x) != "", F.concat(F.lit("§ "), _first(x, BESIDE))))
    beside = F.when(F.col("masked").contains("§"), F.array_compact(F.concat(left, right))).otherwise(F.array().cast("array<string>"))
    unit = lambda texts, label: F.transform(texts, lambda t: F.struct(t.alias("unit"), F.lit(label).alias("label")))
    every = (
        F.when(F.col("slot"), F.concat(unit(F.array(F.lit("§")), 1), unit(beside, 1)))
        .when(F.col("told"), F.array().cast("array<struct<unit: string, label: int>>"))
        .when(F.col("sign"), unit(F.array("core"), 1))
        .otherwise(F.concat(unit(F.array("masked"), 0), unit(windows, 0), unit(beside, 0)))
    )
    return rows.select("passage", F.explode(F.array_distinct(every)).alias("u")).select("passage", "u.unit", "u.label")


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def simhash(texts: list[str], gram: int = GRAM) -> np.ndarray:
    """64-bit SimHash over the letter grams of each text; texts shorter than a gram are padded with blanks."""
    out = np.zeros(len(texts), dtype=np.uint64)
    if not texts:
        return out
    coded = [np.frombuffer(t.ljust(gram).encode("utf-32-le"), dtype=np.uint32) for t in texts]
    lengths = np.array([len(c) for c in coded])
    stream = np.concatenate(coded).astype(np.uint64)
    h = np.zeros(len(stream) - gram + 1, dtype=np.uint64)
    for k in range(gram):
        h = (h << np.uint64(21)) + stream[k : len(stream) - gram + 1 + k]
    h = _mix(h)
    grams = lengths - gram + 1
    starts = np.cumsum(grams) - grams
    h = h[np.repeat(np.cumsum(lengths) - lengths - starts, grams) + np.arange(grams.sum())]
    for bit in range(64):
        ones = np.add.reduceat(((h >> np.uint64(bit)) & np.uint64(1)).astype(np.int32), starts)
        out |= (ones * 2 > grams).astype(np.uint64) << np.uint64(bit)
    return out


def letter_pairs(texts: list[str]) -> np.ndarray:
    """The set of each text's letter pairs, hashed to 256 bits: a row of four 64-bit words per text.

    An edit takes at most two pairs from a text's set, so of two texts ``d`` edits apart neither has more than ``2 d`` bits that the other lacks.
    """
    out = np.zeros((len(texts), len(PAIR_COLUMNS)), dtype=np.uint64)
    coded = [np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32) for t in texts]
    if sum(map(len, coded)) < 2:
        return out
    row = np.repeat(np.arange(len(coded)), [len(c) for c in coded])
    stream = np.concatenate(coded).astype(np.uint64)
    inside = row[:-1] == row[1:]
    h = _mix((stream[:-1] << np.uint64(21)) | stream[1:])[inside]
    np.bitwise_or.at(out, (row[:-1][inside], ((h >> np.uint64(6)) & np.uint64(3)).astype(int)), np.uint64(1) << (h & np.uint64(63)))
    return out


def fingerprinted(units: DataFrame) -> DataFrame:
    """(unit, label) with ``h``, the SimHash of the whole unit, and its letter pairs, in batches."""
    names = ["unit", "label", "h", *PAIR_COLUMNS]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("unit").to_pylist()
            pairs = letter_pairs(texts).view(np.int64)
            columns = [pa.array(simhash(texts).view(np.int64)), *(pa.array(pairs[:, i]) for i in range(len(PAIR_COLUMNS)))]
            yield pa.RecordBatch.from_arrays([batch.column("unit"), batch.column("label"), *columns], names=names)

    return units.select("unit", "label").mapInArrow(work, "unit string, label int, h bigint, " + ", ".join(f"{c} bigint" for c in PAIR_COLUMNS))


def _near_in_block(opens: pd.DataFrame, seeds: pd.DataFrame) -> pd.DataFrame:
    """(id, s_id) of the open and labelled texts of a block whose lengths, SimHashes and letter pairs allow a link."""
    order = np.argsort(opens["size"].to_numpy(), kind="stable")
    size, ids = opens["size"].to_numpy()[order], opens["id"].to_numpy()[order]
    h = opens["h"].to_numpy().view(np.uint64)[order]
    pairs = opens[PAIR_COLUMNS].to_numpy().view(np.uint64)[order]
    seed_size, seed_ids, seed_h = seeds["size"].to_numpy(), seeds["id"].to_numpy(), seeds["h"].to_numpy().view(np.uint64)
    seed_pairs = seeds[PAIR_COLUMNS].to_numpy().view(np.uint64)
    low = np.searchsorted(size, np.ceil(seed_size * LEAST_SIMILAR - 1e-6), "left")
    high = np.searchsorted(size, np.floor(seed_size / LEAST_SIMILAR + 1e-6), "right")
    found, owner = [], []
    for k in range(len(seeds)):
        near = low[k] + np.flatnonzero(np.bitwise_count(h[low[k] : high[k]] ^ seed_h[k]) <= MOST_BITS_APART)
        if len(near):
            most = 2 * np.floor(np.maximum(size[near], seed_size[k]) * (1 - LEAST_SIMILAR) + 1e-6)
            p = pairs[near]
            fits = (np.bitwise_count(p & ~seed_pairs[k]).sum(1) <= most) & (np.bitwise_count(seed_pairs[k] & ~p).sum(1) <= most)
            found.append(ids[near[fits]])
            owner.append(np.full(int(fits.sum()), seed_ids[k]))
    return pd.DataFrame({"id": np.concatenate(found or [np.zeros(0, np.int64)]), "s_id": np.concatenate(owner or [np.zeros(0, np.int64)])})


def linked(seeds: DataFrame, others: DataFrame) -> DataFrame:
    """(unit, seed) of every unit of ``others`` near a seed: met in a table, Hamming distance, letter pairs and edit similarity verified.

    Only numbers go through the tables. A length class of any size is split into blocks, so none is one task.
    """
    numbers = ["h", *PAIR_COLUMNS]
    s = seeds.select(F.xxhash64("unit").alias("id"), F.length("unit").alias("size"), *numbers)
    o = others.select(F.xxhash64("unit").alias("id"), F.length("unit").alias("size"), *numbers)
    length_class = F.floor(F.log(1 / LEAST_SIMILAR, F.greatest(F.col("size"), F.lit(1))) + 1e-9).cast("int")
    o = o.withColumn("class", length_class)
    s = s.withColumn("class", F.explode(F.array(length_class - 1, length_class, length_class + 1)))
    # one row a length class: lengths grow by a quarter from class to class, so there are few
    blocks = o.groupBy("class").agg(F.ceil(F.count("*") / OPEN_ROWS).cast("int").alias("parts")).join(s.groupBy("class").agg(F.ceil(F.count("*") / SEED_ROWS).cast("int").alias("seed_parts")), "class")
    blocks = bounded_broadcast(written(blocks, "blocks"), 1000)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    o = o.join(blocks, "class").withColumn("part", F.pmod(F.col("id"), F.col("parts")).cast("int")).withColumn("seed_part", every("seed_parts"))
    s = s.join(blocks, "class").withColumn("seed_part", F.pmod(F.col("id"), F.col("seed_parts")).cast("int")).withColumn("part", every("parts"))
    key = ["class", "part", "seed_part"]
    met = o.select(*key, "id", "size", *numbers).groupBy(*key).cogroup(s.select(*key, "id", "size", *numbers).groupBy(*key)).applyInPandas(_near_in_block, "id bigint, s_id bigint")
    met = written(met, "met")
    texts = met.join(others.select(F.xxhash64("unit").alias("id"), "unit"), "id").join(seeds.select(F.xxhash64("unit").alias("s_id"), F.col("unit").alias("seed")), "s_id")
    # an empty slot is what such texts share: a text without one is no copy of a text with one
    slots = F.col("unit").contains("§") == F.col("seed").contains("§")
    alike = F.expr(f"levenshtein(unit, seed, cast(floor(greatest(length(unit), length(seed)) * (1 - {LEAST_SIMILAR}) + 1e-6) as int)) >= 0")
    return texts.where(slots & alike).select("unit", "seed")


def spread(units: DataFrame) -> DataFrame:
    """All units of (unit, label, h) that are connected to one with label 1, themselves included.

    Each round links what was labelled last with open units and ends when a component no longer grows. Pairs
    are formed between labelled and open units only, never within a group of alike ones.
    """
    new = written(units.where("label = 1").drop("label"), "labelled")
    rest = written(units.where("label = 0").drop("label"), "open")
    done = new
    while True:
        reached = written(linked(new, rest).select("unit").distinct(), "reached")
        if reached.isEmpty():
            return done.select("unit")
        new = written(rest.join(reached, "unit", "left_semi"), "grown")
        rest = written(rest.join(reached, "unit", "left_anti"), "open")
        done = done.unionByName(new)


def residue_units(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, passage) of all passages, (passage, unit, label) of the distinct ones, and the units of residue components."""
    cut = written(passages(documents), "passages")
    units = written(units_of(cut.select("passage").distinct()), "units")
    # a text that shows a sign is trusted, whatever else it is part of
    distinct = units.groupBy("unit").agg(F.max("label").alias("label"))
    return cut, units, spread(written(fingerprinted(distinct), "fingerprints"))


def residue_documents(documents: DataFrame) -> DataFrame:
    """doc_id of the documents of which any passage is in a component of trusted residue, once each.

    NULL and empty texts are no case; copies of a text are all found; texts that only speak of templates or
    errors are no case. A passage that any share of the documents holds is looked at once.
    """
    cut, units, labelled = residue_units(documents)
    hit = units.join(labelled, "unit", "left_semi").select("passage").distinct()
    return cut.join(hit, "passage", "left_semi").select("doc_id").distinct()


def clean_documents(spark: SparkSession, root: str) -> DataFrame:
    """The documents without residue: what remains after exclusion."""
    documents = table(spark, root, "documents")
    return documents.join(residue_documents(documents), "doc_id", "left_anti").select("doc_id", "lang", "source", "n_chars")
