"""SimHash near-duplicates by multi-index hashing.

Method: fingerprints enter the tables of :mod:`quern.llm.multi_index`, one a segment; the small Hamming
ball of each segment's value is enumerated, the tables' matches are fetched, and complete distances
are verified. The pipeline's stage asks the same tables for its wider fingerprints
(:mod:`quern.llm.near_copies`).

Defined results: a null or empty text has no words and fingerprint zero, linked like any other.
Copies share a fingerprint, which enters the tables once. Repeated rows each get a row. An empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import components, map_rows
from quern.llm.multi_index import DISTANCE, HOT, SEGMENTS, close_pairs, segment_masks, signed  # noqa: F401
from quern.llm.near_copies import PERCENT, WORDS, representatives
from quern.session import discard, stored

SHINGLE = 3
SEED = 42


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits: bit set if set in over half the shingle hashes."""
    import numpy as np
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    h = np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle]), SEED) for i in range(n)), dtype=np.uint64, count=n)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 4096):
        counts += np.unpackbits(h[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(sum(1 << int(i) for i in np.flatnonzero(2 * counts > n)))


def _row(shingle: int):
    def make():
        def row(key, text):
            return [(key, signed(fingerprint(text, shingle)))]

        return row

    return make


def simhash(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE, segments: int = SEGMENTS, hot: int = HOT,
) -> DataFrame:
    """One row a document: id, ``fp`` (signed), ``fingerprint`` (hex), ``component_id`` (least id reachable)."""
    kind = docs.schema[id_col].dataType.simpleString()
    fps = stored(map_rows(docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")), f"key {kind}, fp long", _row(shingle)), "fps")
    table = stored(fps.groupBy("fp").agg(F.min("key").alias("first")), "table")
    groups = stored(components(close_pairs(table.select("fp"), distance, segments, hot), "simcc"), "groups")
    # the least id of a group of fingerprints, then the group of each fingerprint that has links
    firsts = stored(
        groups.join(table, groups["node"] == table["fp"]).groupBy("component").agg(F.min("first").alias("component_id")), "firsts"
    )
    of = table.join(groups.join(firsts, "component").select("node", "component_id"), F.col("fp") == F.col("node"), "left").select(
        "fp", F.coalesce("component_id", "first").alias("component_id")
    )
    of = stored(of, "of")
    for old in (table, groups, firsts):
        discard(old)
    return fps.join(of, "fp").select(
        F.col("key").alias(id_col), "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each group of near copies: those that links of similarity ``percent`` or more reach.

    The one of least id stays, of texts under one id that of least digest, of repeated rows one. Rows without id stay.
    """
    digest = lambda: F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    keep = representatives(docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("key"), digest().alias("t"), F.col(text_col).alias("text")), words, percent)
    keep = keep.select(F.col("key").alias("__key"), F.col("t").alias("__t"))
    one = docs.withColumn("__digest", digest()).dropDuplicates([id_col, "__digest"])
    one = one.join(keep.hint("merge"), (F.col(id_col) == F.col("__key")) & (F.col("__digest") == F.col("__t")), "left_semi")
    return one.drop("__digest").unionByName(docs.where(F.col(id_col).isNull()))


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    out = simhash(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "fingerprint", "component_id")
