import random

import numpy as np
import pyspark.sql.functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from mercanta.llm import packing
from mercanta.llm.tokens import token_counts
from mercanta.runtime import table


@settings(max_examples=60, deadline=None)
@given(st.integers(8, 600), st.lists(st.integers(1, 600), max_size=300))
def test_harmonic_never_overfills(capacity, sizes):
    sizes = np.array([min(s, capacity) for s in sizes], dtype=np.int64)
    bins, loose = packing.harmonic(sizes, capacity)
    assert (bins >= 0).all() and len(loose) == len(sizes)
    if len(sizes):
        assert np.bincount(bins, weights=sizes).max() <= capacity
    again = packing.best_fit(sizes, capacity)
    if len(sizes):
        assert np.bincount(again, weights=sizes).max() <= capacity


def test_little_is_left_unused():
    rnd = np.random.default_rng(1)
    sizes = np.minimum(rnd.lognormal(4.6, 0.8, 50_000).astype(np.int64) + 1, 2000)
    for capacity in (256, 512, 1024, 2048, 4096):
        counts = packing.pieces(__import__("pandas").DataFrame({"doc_id": np.arange(len(sizes)), "tokens": sizes}), capacity)
        bins, _ = packing.harmonic(counts["tokens"].to_numpy(), capacity)
        assert 1 - sizes.sum() / (capacity * (bins.max() + 1)) < 0.05


def test_documents(spark, data):
    texts = [None, "", "palavra " * 3000, "curto", "curto", "<|endoftext|>"] + ["um texto de tamanho medio " * n for n in range(1, 40)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(3, "curto", "y")], "doc_id long, text string, bin string").repartition(3)
    containers = spark.createDataFrame([("a", 256), ("b", 512), ("null", None), ("zero", 0)], "container_name string, capacity_tokens int")
    out = packing.pack(df, containers).collect()
    tokens = {}
    for r in token_counts(df, "text", ["doc_id"]).collect():
        tokens.setdefault(r.doc_id, []).append(r.tokens)
    for name, capacity in (("a", 256), ("b", 512)):
        rows = [r for r in out if r.container_name == name]
        load, parts = {}, {}
        for r in rows:
            parts.setdefault(r.doc_id, []).append(r)
            if r.bin_id:
                load[r.bin_id] = load.get(r.bin_id, 0) + r.tokens
        assert max(load.values()) <= capacity
        for doc, sizes in tokens.items():
            assert sum(r.tokens for r in parts[doc]) == sum(sizes)
            if max(sizes) <= capacity:
                assert len(parts[doc]) == len(sizes)
            if not sum(sizes):
                assert [r.bin_id for r in parts[doc]] == [None]
    assert {r.container_name for r in out} == {"a", "b"}
    assert packing.pack(df.limit(0), containers).count() == 0
    whole = packing.pack(table(spark, data, "documents"), table(spark, data, "container_sizes")).groupBy("container_name").agg(F.sum("tokens").alias("t"))
    assert len({r.t for r in whole.collect()}) == 1


def test_pooled_items_are_kept(spark):
    rnd = random.Random(2)
    df = spark.createDataFrame([(i, "x y " * rnd.randrange(1, 60)) for i in range(500)], "doc_id long, text string").repartition(40)
    containers = spark.createDataFrame([("a", 128)], "container_name string, capacity_tokens int")
    out = packing.pack(df, containers)
    assert out.select("doc_id").distinct().count() == out.count() == 500
