"""Token counts of texts by a public tokenizer whose file the workers read by path."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the tokenizer files on every machine; MERCANTA_TOKENIZERS names another.
TOKENIZERS = os.environ.get("MERCANTA_TOKENIZERS", "/opt/tokenizers")
DEFAULT = "byte_bpe_multi_50k.tiktoken"
#: Split pattern of byte-level BPE vocabularies, a fixed value of the public tokenizers.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoder(path: str):
    """The tokenizer of a ``.tiktoken`` rank file, made once per worker."""
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, text: str, keep: list[str], path: str | None = None) -> DataFrame:
    """``keep`` columns and ``tokens`` of the whole text; NULL and empty texts have 0. Special tokens are plain text."""
    path = path or f"{TOKENIZERS}/{DEFAULT}"
    source = df.select(*keep, F.col(text).alias("_text"))
    schema = ", ".join(f"`{n}` {t}" for n, t in df.select(*keep).dtypes) + ", tokens bigint"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode_ordinary
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            counts = pa.array([len(encode(x)) if x else 0 for x in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), counts], names=[*keep, "tokens"])

    return source.mapInArrow(count, schema)
