"""Flat tables of nested payloads (problem 7).

Payloads stay in the byte buffer of their Arrow column; no row is parsed. One pass over the bytes of a batch
finds the strings and the structural marks outside them; bracket depth gives every mark its container, and
counting commas gives list offsets. Going down level by level, the containers of a level take keys, paths and
record ids from their parents by index (``take``), so arrays at any depth, declared or not, come out alike.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mercanta.runtime import table

Tree = Mapping[str, "Tree"]
_VALUES: Tree = {"values": {}}
_PICTURES: Tree = {"sizes": {}}
#: Declared arrays of objects of each payload, where an object or a JSON string may stand for the array; a dotted name passes single objects.
ARRAYS: dict[str, Tree] = {
    "mercado_livre_products_raw": {"attributes": _VALUES, "pictures": _PICTURES, "main_features": {}, "pickers": {"products": {"thumbs": _PICTURES}}, "buy_box_winner.sale_terms": _VALUES},
    "mercado_livre_items_raw": {"attributes": _VALUES, "pictures": _PICTURES, "seller.reputation.periods": {}, "shipping.options": {"estimates": {}}, "variations": {"attribute_combinations": _VALUES, "sale_terms": _VALUES}},
}
_OUT = "table_name string, record_id string, parent_path string, object_path string, position bigint, object string"
#: Bytes of payloads that are looked at together.
BLOCK_BYTES = 4_000_000
_QUOTE, _BACKSLASH, _COLON, _COMMA = 34, 92, 58, 44
_MARKS = np.zeros(256, dtype=np.int8)
_MARKS[[91, 123]] = 1
_MARKS[[93, 125]] = -1
_MARKS[[_COLON, _COMMA]] = 2


def declared_ways(tree: Tree, at: str = "") -> set[str]:
    """The dotted ways of all declared arrays."""
    return {way for name, sub in tree.items() for way in (at + name, *declared_ways(sub, f"{at}{name}."))}


def readable(payload: Column) -> Column:
    """The payload's text; a JSON string in its place is read as the payload. NULL if it can't be read."""
    t = F.trim(payload)
    t = F.when(t.startswith('"'), F.get_json_object(F.concat(F.lit("["), t, F.lit("]")), "$[0]")).otherwise(t)
    return F.when(F.try_parse_json(t).isNotNull(), t)


def _strings(data: np.ndarray) -> np.ndarray:
    """Positions of the quotes that open and close strings, in turn."""
    quotes = np.flatnonzero(data == _QUOTE)
    slashes = np.flatnonzero(data == _BACKSLASH)
    if not len(slashes) or not len(quotes):
        return quotes
    starts = np.r_[True, np.diff(slashes) > 1]
    first = slashes[np.maximum.accumulate(np.where(starts, np.arange(len(slashes)), 0))]
    at = np.clip(np.searchsorted(slashes, quotes) - 1, 0, None)
    after = (slashes[at] == quotes - 1) & (quotes > 0)
    return quotes[~(after & ((quotes - first[at]) % 2 == 1))]


class _Index:
    """The structural marks of a block of readable payloads, and the containers they make up."""

    def __init__(self, data: np.ndarray):
        self.data, self.quotes = data, _strings(data)
        kind = _MARKS[data]
        at = np.flatnonzero(kind)
        at = at[np.searchsorted(self.quotes, at) % 2 == 0]
        kind = kind[at]
        step = np.where(np.abs(kind) == 1, kind, 0)
        depth = np.cumsum(step)
        level = depth - (kind == 1)  # of the container that holds the mark
        self.at, self.level = at, level
        opens = np.flatnonzero(kind == 1)
        self.open, self.open_level = at[opens], level[opens]
        self.before = np.where(opens > 0, data[at[np.maximum(opens - 1, 0)]], 0)  # the mark before it: a colon where a key names it
        self.colon = np.where(self.before == _COLON, at[np.maximum(opens - 1, 0)], -1)
        self.is_object = data[self.open] == 123
        n = len(opens)
        self.close, self.parent, self.position = np.zeros(n, dtype=np.int64), np.full(n, -1), np.zeros(n, dtype=np.int64)
        colons = np.flatnonzero((kind == 2) & (data[at] == _COLON))
        self.colons, self.colon_owner = at[colons], np.full(len(colons), -1)
        # a colon is followed by a string if a quote comes before any mark
        q = np.searchsorted(self.quotes, self.colons)
        following = at[np.minimum(colons + 1, len(at) - 1)]
        self.value_quote = np.where((q + 1 < len(self.quotes)) & (self.quotes[np.minimum(q, len(self.quotes) - 1)] < following) if len(self.quotes) else False, q, -1)
        commas = (kind == 2) & (data[at] == _COMMA)
        self.levels = [np.flatnonzero(self.open_level == d) for d in range(self.open_level.max() + 1 if n else 0)]
        for d, here in enumerate(self.levels):
            self.close[here] = at[(kind == -1) & (level == d)]
            if not d:
                continue
            above = self.levels[d - 1]
            self.parent[here] = above[np.searchsorted(self.open[above], self.open[here]) - 1]
            own = at[commas & (level == d)]
            self.position[here] = np.searchsorted(own, self.open[here]) - np.searchsorted(own, self.open[self.parent[here]])
        for d in np.unique(level[colons]) if len(colons) else ():
            mine, above = np.flatnonzero(level[colons] == d), self.levels[d - 1]
            self.colon_owner[mine] = above[np.searchsorted(self.open[above], self.colons[mine]) - 1]

    def texts(self, start: np.ndarray, end: np.ndarray) -> pa.Array:
        """The bytes from ``start`` up to ``end`` of each piece, gathered into one Arrow buffer."""
        length = end - start
        offsets = np.r_[0, np.cumsum(length)]
        index = np.repeat(start - offsets[:-1], length) + np.arange(offsets[-1])
        large = pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(self.data[index])])
        return large.cast(pa.string())

    def keys(self, colons: np.ndarray) -> pa.Array:
        """The names before the given colons."""
        q = np.searchsorted(self.quotes, colons)
        names = self.texts(self.quotes[q - 2] + 1, self.quotes[q - 1]) if len(colons) else pa.array([], pa.string())
        if len(names) and pc.any(pc.match_substring(names, "\\")).as_py():
            names = pa.array([json.loads(f'"{x}"') if "\\" in x else x for x in names.to_pylist()], pa.string())
        return names


def _joined(left: pa.Array, mark: str, right: pa.Array) -> pa.Array:
    """``left`` and ``right`` with ``mark`` between them where ``left`` isn't empty."""
    return pc.if_else(pc.equal(left, ""), right, pc.binary_join_element_wise(left, right, mark))


def _objects(ids: pa.Array, docs: pa.Array, paths: pa.Array, parents: pa.Array, ways: pa.Array, declared: set[str], texts: bool) -> Iterator[pa.Table]:
    """Array objects of readable documents; ``paths``, ``parents`` and ``ways`` say where a document itself stands."""
    docs = docs.cast(pa.large_binary())
    offsets = np.frombuffer(docs.buffers()[1], dtype=np.int64)[docs.offset : docs.offset + len(docs) + 1]
    data = np.frombuffer(docs.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]] if docs.buffers()[2] is not None else np.zeros(0, dtype=np.uint8)
    x = _Index(data)
    if not len(x.open):
        return
    listed = pa.array(sorted(declared), pa.string())
    # what each container is called, and the path of the nearest object around it that is an array's element
    path, way, around, owner = ([None] * len(x.levels) for _ in range(4))
    place = np.zeros(len(x.open), dtype=np.int64)
    inner = [np.zeros(0, dtype=np.int64)]
    for d, here in enumerate(x.levels):
        place[here] = np.arange(len(here))
        if d == 0:
            doc = pa.array(np.searchsorted(offsets - offsets[0], x.open[here], "right") - 1)
            owner[d], path[d], way[d], around[d] = ids.take(doc), paths.take(doc), ways.take(doc), parents.take(doc)
            named = np.ones(len(here), dtype=bool)
            element = np.zeros(len(here), dtype=bool)
        else:
            up = pa.array(place[x.parent[here]])
            owner[d], p, w, around[d] = owner[d - 1].take(up), path[d - 1].take(up), way[d - 1].take(up), around[d - 1].take(up)
            named = x.before[here] == _COLON
            element = ~named
            mask, number = pa.array(named), pa.array(x.position[here]).cast(pa.string())
            name = x.keys(x.colon[here[named]])
            name = name.take(pa.array(np.where(named, np.cumsum(named) - 1, 0))) if len(name) else pa.array([""]).take(pa.array(np.zeros(len(here), dtype=np.int64)))
            path[d] = pc.if_else(mask, _joined(p, ".", name), pc.binary_join_element_wise(p, "[", number, "]", ""))
            way[d] = pc.if_else(mask, _joined(w, ".", name), w)
        # an object in place of a declared array is the array's only element
        stands = named & x.is_object[here] & pc.is_in(way[d], listed).to_numpy(zero_copy_only=False)
        if stands.any():
            path[d] = pc.if_else(pa.array(stands), pc.binary_join_element_wise(path[d], "[0]", ""), path[d])
        found = (element | stands) & x.is_object[here]
        if found.any():
            i = pa.array(np.flatnonzero(found))
            objects = x.texts(x.open[here[found]], x.close[here[found]] + 1) if texts else pa.nulls(len(i), pa.string())
            yield pa.table({"table_name": way[d].take(i), "record_id": owner[d].take(i), "parent_path": around[d].take(i), "object_path": path[d].take(i), "position": pa.array(np.where(stands, 0, x.position[here])[found].astype(np.int64)), "object": objects})
            around[d] = pc.if_else(pa.array(found), path[d], around[d])
        inner.append(here)
    # JSON strings in place of declared arrays are documents of their own
    strings = np.flatnonzero((x.value_quote >= 0) & (x.colon_owner >= 0))
    last = pa.array(sorted({w.rpartition(".")[2] for w in declared}), pa.string())
    names = x.keys(x.colons[strings])
    keep = pc.is_in(names, last).to_numpy(zero_copy_only=False)
    strings, names = strings[keep], names.filter(pa.array(keep))
    for d in range(len(x.levels)):
        mine = x.open_level[x.colon_owner[strings]] == d
        up = pa.array(place[x.colon_owner[strings[mine]]])
        w = _joined(way[d].take(up), ".", names.filter(pa.array(mine)))
        there = pc.is_in(w, listed)
        if not pc.any(there).as_py():
            continue
        q = x.value_quote[strings[mine]][there.to_numpy(zero_copy_only=False)]
        inside = [_unquoted(t) for t in x.texts(x.quotes[q], x.quotes[q + 1] + 1).to_pylist()]
        kept = pa.array([t is not None for t in inside])
        take = lambda a: a.filter(there).filter(kept)
        p = _joined(path[d].take(up), ".", names.filter(pa.array(mine)))
        texts_in = pa.array([t for t in inside if t is not None], pa.string())
        single = pc.starts_with(texts_in, "{")
        texts_in = pc.if_else(single, pc.binary_join_element_wise("[", texts_in, "]", ""), texts_in)
        yield from _objects(take(owner[d].take(up)), texts_in, take(p), take(around[d].take(up)), take(w), declared, texts)


def _unquoted(text: str) -> str | None:
    """What a JSON string says, if that is a readable array or object itself."""
    said = json.loads(text).strip()
    if said[:1] not in ("[", "{"):
        return None
    try:
        json.loads(said)
    except ValueError:
        return None
    return said


def array_objects(df: DataFrame, record_id: str, payload: str, label: str, tree: Tree, texts: bool = True) -> DataFrame:
    """Every object that is an element of an array of the payload: table, record, parent path, path, position, JSON.

    Arrays at any depth count, in whatever key, array or object they stand. An object or JSON string in place of a
    declared array counts as the array. NULL, empty and unreadable payloads give no rows; NULL and other non-object
    elements keep their index and give none; repeated rows (same id) each give theirs, as do repeated keys of one
    object; other columns are not looked at. An empty table gives an empty one. Rows never meet each other, so no
    key can be hot. Without ``texts`` the objects' own JSON is left out (NULL).
    """
    docs = df.select(F.col(record_id).cast("string").alias("id"), readable(F.col(payload)).alias("doc")).where("doc IS NOT NULL")
    declared = declared_ways(tree)

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, doc = batch.column("id"), batch.column("doc").cast(pa.string())
            size = np.cumsum(pc.binary_length(doc).to_numpy(zero_copy_only=False))
            block = size // BLOCK_BYTES
            first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(block) else []
            for a, b in zip(first, [*first[1:], len(block)]):
                empty = pa.array([""]).take(pa.array(np.zeros(b - a, dtype=np.int64)))
                for rows in _objects(ids.slice(a, b - a), doc.slice(a, b - a), empty, empty, empty, declared, texts):
                    names = _joined(pa.array([label]).take(pa.array(np.zeros(len(rows), dtype=np.int64))), ".", rows.column("table_name").combine_chunks())
                    yield from rows.set_column(0, "table_name", names).combine_chunks().to_batches()

    return docs.mapInArrow(flat, _OUT)


def payload_objects(spark: SparkSession, root: str, texts: bool = True) -> DataFrame:
    """The objects of all marketplace payloads."""
    parts = [array_objects(table(spark, root, name), "id", "payload", name, tree, texts).withColumn("source_table", F.lit(name)) for name, tree in ARRAYS.items()]
    return parts[0].unionByName(parts[1])
