"""Token-blocked fuzzy match of products to evidence."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from mercanta.functions import attributes, text
from mercanta.operators.relational import surrogate_keys, top_per_key
from mercanta.runtime import bounded_broadcast, written

#: Fixed values of the match: candidates and matches kept per product, and the least score of a match.
CANDIDATES, MATCHES, LEAST_SCORE = 350, 60, 42.0
#: Tokens of products that are broadcast at most.
BROADCAST_TOKENS = 200_000
#: Product titles and evidence titles that meet in one task at most.
CHUNK_PRODUCTS, BLOCK_TITLES = 20_000, 1 << 19
#: Candidate rows for which their scoring makes a part.
PART_ROWS = 250_000


def _read(rows: DataFrame) -> DataFrame:
    """Tokens and attributes of ``norm``; rows without tokens are left out."""
    rows = rows.withColumn("tokens", text.tokens(F.col("norm"))).where(F.size("tokens") > 0)
    rows = rows.withColumn("special", F.array_except("tokens", F.array(*(F.lit(w) for w in text.GENERIC)))).withColumn("models", text.model_tokens(F.col("tokens")))
    return rows.withColumn("attrs", F.struct(*(c.alias(n) for n, c in attributes.product_attributes(F.col("norm")).items())))


def described(df: DataFrame, key: str, title: str, price: str) -> DataFrame:
    """key, price, normalised title, tokens and attributes of each row; rows without tokens are left out."""
    return _read(df.select(F.col(key).alias("key"), F.col(price).cast("double").alias("price"), text.normalized(F.col(title)).alias("norm")))


def titles_of(evidence: DataFrame) -> DataFrame:
    """(title_id, norm, rows, tokens, attrs): evidence rows of one normalised title are read once, with their number."""
    titles = evidence.groupBy("norm").agg(F.count("*").alias("rows"))
    return _read(titles).withColumn("title_id", F.monotonically_increasing_id())


def numbered(products: DataFrame) -> DataFrame:
    """Products with a number, by which what they share with titles is counted: those of one normalised title have the same."""
    products = written(products, "described")
    numbers = written(products.select("norm").distinct().withColumn("p_id", F.monotonically_increasing_id()), "product-titles")
    return written(products.join(numbers, "norm").withColumn("row", F.monotonically_increasing_id()), "products")


def useful_tokens(products: DataFrame, titles: DataFrame, most: int | None = None) -> DataFrame:
    """(token, p_id, position) of product titles without tokens that no evidence has or more than max(120, n/4) of its rows."""
    counts = titles.select("rows", F.explode("tokens").alias("token")).groupBy("token").agg(F.sum("rows").alias("n"))
    limit = max(120, (titles.agg(F.sum("rows")).first()[0] or 0) // 4) if most is None else most
    tokens = products.dropDuplicates(["p_id"]).select("p_id", F.posexplode("tokens").alias("position", "token"))
    return tokens.join(counts.where(F.col("n") <= limit).select("token"), "token", "left_semi")


class _Block:
    """Tokens of a block of titles as bits, 64 titles a word, in the order given; rare tokens as lists of places."""

    def __init__(self, lists: pa.Array, own: np.ndarray):
        self.n = len(lists)
        self.words = max(1, -(-self.n // 64))
        lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
        tokens, places = lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(self.n), lengths)
        self.tokens = np.unique(own)
        at = np.minimum(np.searchsorted(self.tokens, tokens), max(0, len(self.tokens) - 1))
        known = self.tokens[at] == tokens
        at, places = at[known], places[known]
        order = np.argsort(at, kind="stable")
        self.places = places[order]
        self.start = np.searchsorted(at[order], np.arange(len(self.tokens) + 1))
        self.kept: dict[int, np.ndarray] = {}

    def bits(self, places: np.ndarray) -> np.ndarray:
        flags = np.zeros(self.words * 64, dtype=bool)
        flags[places] = True
        return np.packbits(flags, bitorder="little").view("<u8")

    def of(self, token: int) -> tuple[np.ndarray, bool]:
        """The bits of a token, or its places if it is rare."""
        places = self.places[self.start[token] : self.start[token + 1]]
        if 2 * len(places) < self.words:
            return places, False
        if token not in self.kept:
            self.kept[token] = self.bits(places)
        return self.kept[token], True


def _has(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    return ((bits[places >> 6] >> (places & 63).astype("u8")) & np.uint64(1)).astype(bool)


class _Shared:
    """How many tokens of a product each title of a block has: bit by bit in ``planes``, but for titles with a rare token one by one."""

    def __init__(self, block: _Block, tokens: np.ndarray):
        found = [block.of(t) for t in tokens]
        self.common = [(i, x) for i, (x, dense) in enumerate(found) if dense]
        rare = [(i, x) for i, (x, dense) in enumerate(found) if not dense]
        self.planes: list[np.ndarray] = []
        for _, carry in self.common:
            for k, plane in enumerate(self.planes):
                self.planes[k], carry = plane ^ carry, plane & carry
            if 1 << len(self.planes) <= len(self.common) and carry.any():
                self.planes.append(carry)
        self.places = np.unique(np.concatenate([x for _, x in rare])) if rare else np.zeros(0, dtype=np.int64)
        self.overlap = np.zeros(len(self.places), dtype=np.int64)
        self.first = np.full(len(self.places), len(tokens))
        self.open = None
        if len(self.places):
            for i, x in rare:
                at = np.searchsorted(self.places, x)
                self.overlap[at] += 1
                self.first[at] = np.minimum(self.first[at], i)
            for i, x in self.common:
                at = _has(x, self.places)
                self.overlap += at
                self.first[at] = np.minimum(self.first[at], i)
            self.open = ~block.bits(self.places)
            self.planes = [p & self.open for p in self.planes]

    def level(self, overlap: int) -> np.ndarray | None:
        """Bits of the titles, without those of rare tokens, that have so many tokens."""
        if overlap >> len(self.planes):
            return None
        out = None
        for k, plane in enumerate(self.planes):
            side = plane if overlap >> k & 1 else ~plane
            out = side if out is None else out & side
        return out

    def best(self) -> int:
        """The most tokens that a title has."""
        best, left = 0, None
        for k in range(len(self.planes) - 1, -1, -1):
            here = self.planes[k] if left is None else left & self.planes[k]
            if here.any():
                best, left = best | 1 << k, here
        return max(best, int(self.overlap.max()) if len(self.overlap) else 0)


def _first_places(bits: np.ndarray, most: int) -> np.ndarray:
    """Places of the first ``most`` bits."""
    words = np.flatnonzero(bits)
    if len(words) > most:
        words = words[:most]
    flags = np.unpackbits(bits[words].view("u1").reshape(-1, 8), axis=1, bitorder="little")
    word, bit = np.nonzero(flags)
    return (words[word] * 64 + bit)[:most]


def _best_rows(shared: _Shared, most: int, start: np.ndarray, numbers: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(overlap, first token, places, row numbers) of the ``most`` rows that share most tokens. Places are in order of their least row number."""
    for overlap in range(shared.best(), 0, -1):
        level = shared.level(overlap)
        alone = shared.overlap == overlap
        common = dict(shared.common) if level is not None and level.any() else {}
        firsts = set(common) | set(shared.first[alone].tolist())
        for first in sorted(firsts):
            places = shared.places[alone & (shared.first == first)]
            if first in common:
                # a title's rows come after its least one, so no more titles than rows are needed
                places = np.union1d(places, _first_places(level & common[first], most))
                level = level & ~common[first]
            places = places[:most]
            if not len(places):
                continue
            length = start[places + 1] - start[places]
            at = np.repeat(start[places] - np.cumsum(length) + length, length) + np.arange(length.sum())
            rows, places = numbers[at], np.repeat(places, length)
            order = np.argsort(rows, kind="stable")[:most]
            yield overlap, first, places[order], rows[order]
            most -= len(order)
            if most <= 0:
                return


def _numbered_sides(products: DataFrame, titles: DataFrame, most_common: int | None) -> tuple[DataFrame, DataFrame]:
    """(p_id, own) and (title_id, rows, tokens): the tokens that both sides use, as numbers; own: position and token in order."""
    useful = written(useful_tokens(products, titles, most_common), "tokens")
    names = bounded_broadcast(written(useful.select("token").distinct().withColumn("t", F.monotonically_increasing_id()), "token-numbers"), BROADCAST_TOKENS)
    left = useful.join(names, "token").groupBy("p_id").agg(F.array_sort(F.collect_list(F.struct(F.col("position"), F.col("t")))).alias("own"))
    right = titles.select("title_id", "rows", F.explode("tokens").alias("token")).join(names, "token").groupBy("title_id", "rows").agg(F.collect_list("t").alias("tokens"))
    return written(left.select("p_id", F.col("own.position").alias("positions"), F.col("own.t").alias("own")), "product-tokens"), written(right, "title-tokens")


def _together(left: DataFrame, right: DataFrame, work, schema: str) -> DataFrame:
    """``work(products, titles)`` of Arrow tables over each chunk of products and block of titles, both of bounded size."""
    n, cores = left.count(), left.sparkSession.sparkContext.defaultParallelism
    chunks = max(-(-n // CHUNK_PRODUCTS), min(2 * cores, -(-n // 200)), 1)
    blocks = max(1, -(-right.count() // BLOCK_TITLES))
    each = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = left.withColumn("chunk", F.pmod(F.xxhash64("p_id"), F.lit(chunks)).cast("int")).withColumn("block", each(blocks))
    right = right.withColumn("block", F.pmod(F.xxhash64("title_id"), F.lit(blocks)).cast("int")).withColumn("chunk", each(chunks))
    return left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInArrow(work, schema)


def _chunk(products: pa.Table, titles: pa.Table) -> tuple[_Block, Iterator[tuple[int, np.ndarray, np.ndarray]]]:
    own = products["own"].combine_chunks()
    tokens, start = own.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(own.value_lengths().to_numpy(zero_copy_only=False))]
    block = _Block(titles["tokens"].combine_chunks(), tokens)
    tokens = np.searchsorted(block.tokens, tokens)
    positions = products["positions"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return block, ((p, tokens[start[i] : start[i + 1]], positions[start[i] : start[i + 1]]) for i, p in enumerate(products["p_id"].to_pylist()))


def partner_counts(products: DataFrame, titles: DataFrame, most_common: int | None = None) -> DataFrame:
    """(p_id, best_overlap, partners): the most tokens a product title shares with a title, and the evidence rows it shares any with."""

    def work(chunk: pa.Table, titles: pa.Table) -> pa.Table:
        out = []
        if chunk.num_rows and titles.num_rows:
            block, each = _chunk(chunk, titles)
            weight = titles["rows"].to_numpy()
            digits = [block.bits(np.flatnonzero(weight >> k & 1)) for k in range(int(weight.max()).bit_length())]
            for p, tokens, _ in each:
                shared = _Shared(block, tokens)
                partners = int(weight[shared.places].sum())
                if shared.planes:
                    some = np.bitwise_or.reduce(shared.planes)
                    partners += sum(int(np.bitwise_count(some & d).sum(dtype=np.int64)) << k for k, d in enumerate(digits))
                if partners:
                    out.append((p, shared.best(), partners))
        columns = list(zip(*out)) or [[], [], []]
        return pa.table({"p_id": pa.array(columns[0], pa.int64()), "best_overlap": pa.array(columns[1], pa.int64()), "partners": pa.array(columns[2], pa.int64())})

    counts = _together(*_numbered_sides(products, titles, most_common), work, "p_id bigint, best_overlap bigint, partners bigint")
    return counts.groupBy("p_id").agg(F.max("best_overlap").alias("best_overlap"), F.sum("partners").alias("partners"))


def _candidate_rows(products: DataFrame, evidence: DataFrame, titles: DataFrame, most: int, most_common: int | None) -> DataFrame:
    """(p_id, title_id, e_no): per product title the numbered evidence rows that share most tokens."""
    rows = evidence.join(titles.select("norm", "title_id"), "norm").select("title_id", "e_no")
    # no more rows of a title than the cut can hold
    rows = top_per_key(rows, ["title_id"], [F.col("e_no")], most).groupBy("title_id").agg(F.array_sort(F.collect_list("e_no")).alias("numbers"))
    left, right = _numbered_sides(products, titles, most_common)
    right = written(right.join(rows, "title_id"), "numbered-titles")

    def work(chunk: pa.Table, titles: pa.Table) -> pa.Table:
        found, names = [], ["p_id", "title_id", "e_no", "overlap", "first_position"]
        if chunk.num_rows and titles.num_rows:
            titles = titles.append_column("least", pc.list_element(titles["numbers"].combine_chunks(), 0)).sort_by("least")
            lists = titles["numbers"].combine_chunks()
            start = np.r_[0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]
            numbers, ids = lists.flatten().to_numpy(zero_copy_only=False), titles["title_id"].to_numpy()
            block, each = _chunk(chunk, titles)
            for p, tokens, positions in each:
                for overlap, first, places, rows in _best_rows(_Shared(block, tokens), most, start, numbers):
                    n = len(rows)
                    found.append((np.full(n, p), ids[places], rows, np.full(n, overlap), np.full(n, positions[first])))
        columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, dtype=np.int64)] * 5
        return pa.table({name: pa.array(c.astype(np.int64)) for name, c in zip(names, columns)})

    out = written(_together(left, right, work, "p_id bigint, title_id bigint, e_no bigint, overlap bigint, first_position bigint"), "candidates")
    if right.count() > BLOCK_TITLES:  # else a product met all titles in one place
        out = written(top_per_key(out, ["p_id"], [F.desc("overlap"), F.col("first_position"), F.col("e_no")], most), "best-rows")
    return out.select("p_id", "title_id", "e_no")


def candidates(products: DataFrame, evidence: DataFrame, titles: DataFrame, most: int = CANDIDATES, most_common: int | None = None) -> DataFrame:
    """(p_key, title_id, e_key, price): per numbered product the evidence rows that share most tokens.

    Ties go to the token that comes first in the product, then to the evidence key. Products of one title are looked up
    once, titles are bits of words: a block of them meets a product in a few operations a token.
    """
    evidence = with_numbers(evidence)
    best = _candidate_rows(products, evidence, titles, most, most_common)
    best = best.join(evidence.select("e_no", F.col("key").alias("e_key"), "price"), "e_no")
    return best.join(products.select("p_id", F.col("key").alias("p_key")), "p_id").select("p_key", "title_id", "e_key", "price")


def with_numbers(evidence: DataFrame) -> DataFrame:
    """Evidence rows numbered in order of their keys."""
    return written(surrogate_keys(evidence.select("key", "price", "norm"), ["key"], "e_no"), "evidence")


def _is_dear(price: Column, other: Column) -> Column:
    """Whether evidence costs so much more than a cheap product that it is hardly the same."""
    return (price < 15) & (other > 20 * price)


def _parts(p: str, e: str) -> Column:
    """What a score takes of two described rows besides the ratio of their texts: shared tokens, parts of the sum, factor."""
    s, t = F.col(f"{p}.tokens"), F.col(f"{e}.tokens")
    special = F.col(f"{p}.special")
    both, special_both = F.size(F.array_intersect(s, t)), F.size(F.array_intersect(special, t))
    base = 0.45 * both / F.least(F.size(s), F.lit(10)) + 0.20 * both / F.least(F.size(t), F.lit(14))
    more = 0.15 * F.least(F.lit(1.0), special_both / F.greatest(F.lit(1), F.least(F.size(special), F.lit(5))))
    models_p, models_e = F.col(f"{p}.models"), F.col(f"{e}.models")
    apart = F.when(F.size(models_p) == 0, 1.0).when(F.size(models_e) == 0, 0.82).when(F.arrays_overlap(models_p, models_e), 1.0).otherwise(0.35)
    factor = F.when(both < 2, 0.45).otherwise(1.0) * F.when((F.size(special) > 0) & (special_both == 0), 0.72).otherwise(1.0) * apart
    factor = factor * attributes.conflict_penalty(attributes.conflicts(F.col(f"{p}.attrs"), F.col(f"{e}.attrs")))
    return F.struct(both.alias("both"), base.alias("base"), more.alias("more"), factor.alias("factor"))


def _score_of(parts: Column, ratio: Column, dear: Column | None = None) -> Column:
    """Similarity from 0 to 100 from its parts and the ratio; ``dear`` tells whether the second row is dear (if unsaid: it isn't)."""
    base = parts["base"] + 0.20 * ratio + parts["more"]
    factor = parts["factor"] * F.when(F.lit(False) if dear is None else dear, 0.85).otherwise(1.0)
    return F.when(parts["both"] == 0, 0.0).otherwise(F.round(F.least(F.lit(100.0), 100 * base * factor), 2))


def _score(p: str, e: str, ratio: Column, dear: Column | None = None) -> Column:
    """Similarity from 0 to 100 of two described rows, given the ratio of their texts."""
    return _score_of(_parts(p, e), ratio, dear)


def _matching(a: str, b: str) -> int:
    """Letters in the matching blocks of two texts: the longest common part, first in a and then in b, and so on at either side of it."""
    if not a or not b:
        return 0
    size = at = 0
    for i in range(len(a)):
        while i + size < len(a) and a[i : i + size + 1] in b:
            size, at = size + 1, i
        if len(a) - i - 1 <= size:
            break
    if not size:
        return 0
    j = b.index(a[at : at + size])
    return size + _matching(a[:at], b[:j]) + _matching(a[at + size :], b[j + size :])


def _ratio(a: str, b: str) -> float:
    """SequenceMatcher(None, a, b).ratio(); that leaves out letters that are frequent in texts from 200 letters on."""
    if len(b) >= 200:
        return SequenceMatcher(None, a, b).ratio()
    return 2.0 * _matching(a, b) / (len(a) + len(b)) if a or b else 1.0


@F.pandas_udf(T.DoubleType())
def text_ratio(pairs: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Ratcliff-Obershelp ratio of two texts; the JVM has no equal of it.

    Where a bound of it by lengths is under the third argument, the bound is given instead: it doesn't matter then.
    """
    for left, right, least in pairs:
        out = []
        for a, b, need in zip(left, right, least):
            bound = 2.0 * min(len(a), len(b)) / max(1, len(a) + len(b))
            out.append(_ratio(a, b) if bound >= need else bound)
        yield pd.Series(out, dtype="float64")


def matches(products: DataFrame, evidence: DataFrame, most_common: int | None = None) -> DataFrame:
    """(p_key, e_key, score, price, rank): the best matches of each product from the least score on.

    Texts are compared once a product title and evidence title. Pairs that can't reach the least score even with equal
    texts are left out before: the ratio adds at most a fifth and every factor is at most 1.
    """
    products, evidence = numbered(products), with_numbers(evidence)
    titles = written(titles_of(evidence), "titles")
    c = _candidate_rows(products, evidence, titles, CANDIDATES, most_common)
    # few bytes but much work a pair: the number of parts is given
    parts = max(int(products.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-c.count() // PART_ROWS))
    read = F.struct("norm", "tokens", "special", "models", "attrs")
    pairs = c.select("p_id", "title_id").distinct().join(products.dropDuplicates(["p_id"]).select("p_id", read.alias("p")), "p_id")
    pairs = pairs.repartition(parts, "title_id").join(titles.select("title_id", read.alias("e")), "title_id")
    pairs = written(pairs.select("p_id", "title_id", F.col("p.norm").alias("p_norm"), F.col("e.norm").alias("e_norm"), _parts("p", "e").alias("parts")), "pairs")
    low, high = _score_of(F.col("parts"), F.lit(0.0)), _score_of(F.col("parts"), F.lit(1.0))
    # scores are linear in the ratio; both ends are rounded, so the least ratio is taken a little lower
    least = F.coalesce(F.try_divide(LEAST_SCORE - 0.02 - low, high - low + 0.01), F.lit(0.0))
    rated = written(pairs.where(high >= LEAST_SCORE).select("p_id", "title_id", "parts", text_ratio("p_norm", "e_norm", least).alias("ratio")), "rated")
    # both scores that a row of a title can have are worked out once a title
    rated = rated.select("p_id", "title_id", _score_of(F.col("parts"), F.col("ratio")).alias("usual"), _score_of(F.col("parts"), F.col("ratio"), F.lit(True)).alias("dear")).where(F.col("usual") >= LEAST_SCORE)
    score = F.when(_is_dear(F.col("p_price"), F.col("price")), F.col("dear")).otherwise(F.col("usual"))
    # the rows are many: numbers stand for their keys (in the same order) until the cut
    scored = c.join(rated, ["p_id", "title_id"]).drop("title_id").join(evidence.select("e_no", "price"), "e_no")
    scored = scored.join(products.select("p_id", "row", F.col("price").alias("p_price")), "p_id")
    scored = scored.select("row", "e_no", "price", score.alias("score")).where(F.col("score") >= LEAST_SCORE)
    best = top_per_key(scored, ["row"], [F.desc("score"), F.desc("price"), F.col("e_no")], MATCHES)
    best = best.join(products.select("row", F.col("key").alias("p_key")), "row").join(evidence.select("e_no", F.col("key").alias("e_key")), "e_no")
    return best.select("p_key", "e_key", "price", "score", "rank")


def price_levels(matched: DataFrame, share: float = 0.35, least: float = 58.0, most: int = 30) -> DataFrame:
    """Interpolated percentile of the prices of each product's best qualified matches, with count and dispersion."""
    used = matched.where((F.col("score") >= least) & (F.col("rank") <= most))
    return used.groupBy("p_key").agg(F.round(F.percentile("price", F.lit(share)), 2).alias("level"), F.count("*").alias("prices"), F.round(F.try_divide(F.stddev_pop("price"), F.median("price")), 4).alias("dispersion"))


def match_details(matched: DataFrame, most: int = 12) -> DataFrame:
    """(p_key, details): the best matches of each product as JSON, in order of rank. Lists hold ``most`` rows at most."""
    kept = matched.where(F.col("rank") <= most).groupBy("p_key").agg(F.array_sort(F.collect_list(F.struct("rank", "e_key", "score", "price"))).alias("m"))
    return kept.select("p_key", F.to_json("m").alias("details"))
