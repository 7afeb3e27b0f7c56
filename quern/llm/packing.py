"""Best-fit packing of token pieces into sequences of a fixed capacity.

Method: large-item matching. Pieces above one third of the capacity go at most two to a sequence:
the largest left is paired with the largest other that fits beside it. Smaller pieces then go, in
falling order of length, into the tightest gap that holds them; a new sequence opens only when no
gap does. Pieces are dealt by hash into packing groups of about ``GROUP`` pieces, so that a group
is bounded and groups run side by side; each group leaves about one sequence unfilled.

Defined results: a null or empty text is the closing id alone (one piece of length 1). Documents
longer than the capacity are cut into whole-capacity pieces, the first one holding the remainder.
Repeated rows are packed each. Ties in length go by id and piece. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quern.llm.common import map_rows
from quern.session import stored

CAPACITY = 2048
END_ID = 0
#: Pieces that one packing group holds about; a bound on what one task sorts, not on the input.
GROUP = 32_768


def pack(lengths: list[int], capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(sequence, offset) of each length."""
    third = capacity / 3
    place: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    large = sorted((n, i) for i, n in enumerate(lengths) if n > third)
    gaps: list[tuple[int, int]] = []
    n_bins = 0
    while large:
        n, i = large.pop()
        place[i], used = (n_bins, 0), n
        k = bisect_right(large, (capacity - n, len(lengths))) - 1
        if k >= 0:
            m, j = large.pop(k)
            place[j], used = (n_bins, n), n + m
        if used < capacity:
            gaps.append((capacity - used, n_bins))
        n_bins += 1
    gaps.sort()
    for n, i in sorted(((n, i) for i, n in enumerate(lengths) if n <= third), key=lambda x: (-x[0], x[1])):
        k = bisect_left(gaps, (n, -1))
        if k < len(gaps):
            gap, b = gaps.pop(k)
        else:
            gap, b = capacity, n_bins
            n_bins += 1
        place[i] = (b, capacity - gap)
        if gap > n:
            insort(gaps, (gap - n, b))
    return place


def encoder(tokenizer: str | None = None):
    """text -> ids of the vocabulary at ``tokenizer``, by default the public 50k byte-level one.

    The public vocabulary also exists as merge ranks, which encode in a third of the time. Ranks are
    used for texts of Latin letters (where both libraries' character tables are the same) that hold no
    special token's string; all other texts go to the tokenizer itself.
    """
    from functools import cache

    from tokenizers import Tokenizer

    if tokenizer is not None:
        exact = Tokenizer.from_file(tokenizer)
        return lambda text: exact.encode_batch_fast([text], add_special_tokens=False)[0].ids
    import base64
    import json

    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.json")
    load = cache(lambda: Tokenizer.from_file(path))  # only when a text needs it
    with open(path, encoding="utf-8") as f:
        special = [t["content"] for t in json.load(f)["added_tokens"]]
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    other = re.compile("[^\x00-\u024f]|" + "|".join(map(re.escape, special)))

    def encode(text: str) -> list[int]:
        if other.search(text):
            return load().encode_batch_fast([text], add_special_tokens=False)[0].ids
        return quick.encode_ordinary(text)

    return encode


def _pieces(tokenizer: str | None, capacity: int):
    def make():
        import zlib

        import numpy as np

        encode = encoder(tokenizer)

        def row(key, text):
            ids = np.array([*encode(text or ""), END_ID], dtype="<u4")
            n, out, start = len(ids), [], 0
            while start < n:
                length = (n - start - 1) % capacity + 1 if start == 0 else capacity
                out.append((key, len(out), start, length, zlib.crc32(ids[start : start + length].tobytes())))
                start += length
            return out

        return row

    return make


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """Token pieces of each document: id, piece, start, length, ids_crc32. ``tokenizer``: path of the vocabulary file."""
    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(
        docs.select(F.col(id_col), F.col(text_col)),
        f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long",
        _pieces(tokenizer, capacity),
    )


def best_fit(cut: DataFrame, id_col: str = "doc_id", length_col: str = "length", capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """``cut`` (stored: it is read twice) with ``sequence_id`` and ``offset``."""
    n_groups = max(1, cut.count() // group)
    dealt = cut.withColumn("__group", F.pmod(F.xxhash64(F.col(id_col), "piece"), F.lit(n_groups)))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values([id_col, "piece"], kind="stable").reset_index(drop=True)
        at = pack(part[length_col].tolist(), capacity)
        part["sequence_id"] = part["__group"] * (1 << 32) + pd.Series([x[0] for x in at], dtype="int64")
        part["offset"] = pd.Series([x[1] for x in at], dtype="int64")
        return part.drop(columns="__group")

    schema = StructType([*cut.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    return dealt.groupBy("__group").applyInPandas(run, schema)


def best_fit_packing(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None, group: int = GROUP) -> DataFrame:
    """One row a piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    return best_fit(stored(pieces(docs, id_col, text_col, capacity, tokenizer), "pieces"), id_col, capacity=capacity, group=group)


def op6_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return best_fit_packing(spark.read.parquet(f"{sf_dir}/documents.parquet"))
