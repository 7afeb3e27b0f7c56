"""Line dedup over content-defined chunks of lines.

Method: a rolling hash runs over the hashes of ``WINDOW`` lines; a place is a boundary if its hash is
0 modulo ``mean``, so boundaries depend on the lines about them alone and do not shift with what is
inserted before. A chunk starts at each boundary and ends at the first one at least ``WINDOW`` lines
behind it. With ``mean`` 1, the default, every place is a boundary and each two lines are a chunk: a
repeated passage of two lines or more then goes whole (with 3, most passages hold no whole chunk; the
README has the figures). Where lines are equal, chunks start at every second one (an odd run has one of
three lines at its end), so no chunk repeats within itself. Chunks that stand anywhere else in the
corpus are compared byte for byte; of equal ones all but the first (by document id, then place) are
removed with all their lines.

Defined results: a null text stays null; an empty text and texts of one line have no multi-line
chunk and stay as they are. Chunks whose lines are all blank are kept. With ``mean`` 1 the first place
of a line is never removed. Rows that share an id count as one place, so a repeated row keeps what its
twin keeps. An empty table gives an empty result. Every column of the input stays.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from quern.llm.common import SPACE, map_rows
from quern.session import discard, stored

#: Lines under the rolling hash, and the fewest of a chunk.
WINDOW = 2
#: One of so many places is a boundary.
MEAN = 1
#: Bytes of a chunk's digest. Digests only pick candidates.
DIGEST = 16
#: Parts that a frequent chunk's rows are dealt to in joins.
SALTS = 8
BASE = 0x9E3779B97F4A7C15
WORD64 = (1 << 64) - 1


def boundaries(lines: list[str], mean: int = MEAN) -> list[bool]:
    """For each line, whether a boundary stands before it: the rolling hash of it and the next ones decides."""
    if mean == 1:
        return [True] * len(lines)
    import xxhash

    h = [xxhash.xxh64_intdigest(x.encode()) for x in lines] + [0] * WINDOW
    top = pow(BASE, WINDOW - 1, 1 << 64)
    cur, out = 0, []
    for x in h[:WINDOW]:
        cur = (cur * BASE + x) & WORD64
    for i in range(len(lines)):
        out.append((cur ^ cur >> 32) % mean == 0)
        cur = ((cur - h[i] * top) * BASE + h[i + WINDOW]) & WORD64
    return out


def chunks(lines: list[str], mean: int = MEAN) -> list[tuple[int, int]]:
    """Line ranges [a, b) of a text's chunks, which may overlap."""
    out, run, n = [], 0, len(lines)
    at = boundaries(lines, mean)
    for i in range(n - 1):
        same = lines[i] == lines[i + 1]
        if at[i] and not (same and (i - run) % WINDOW):
            out.append((i, next((j for j in range(i + WINDOW, n) if at[j]), n)))
        if not same or i == n - 2:
            k = i + 1 + same - run
            if at[run] and k > 1 and k % WINDOW:
                out.append((run + k - WINDOW - 1, run + k))
            run = i + 1
    return out


def multi_line(text: str | None, mean: int = MEAN) -> list[tuple[int, str]]:
    """(chunk, its text) of the chunks that dedup looks at."""
    if not text:
        return []
    lines = text.split("\n")
    return [(c, s) for c, (a, b) in enumerate(chunks(lines, mean)) if (s := "\n".join(lines[a:b])).strip(SPACE)]


def without(text: str, gone: set[int], mean: int = MEAN) -> str:
    """``text`` without the lines of the chunks numbered in ``gone``."""
    lines = text.split("\n")
    out = {k for c, (a, b) in enumerate(chunks(lines, mean)) if c in gone for k in range(a, b)}
    return "\n".join(x for k, x in enumerate(lines) if k not in out)


def _digest(s: str, size: int = DIGEST) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(s.encode())[:size]


def _keys(mean: int, size: int):
    return lambda: lambda key, text: [(key, c, _digest(s, size)) for c, s in multi_line(text, mean)]


def _bytes(mean: int, size: int):
    def make():
        def row(key, text, wanted):
            wanted = set(wanted)
            return [(key, c, _digest(s, size), s.encode()) for c, s in multi_line(text, mean) if c in wanted]

        return row

    return make


def _dealt(df: DataFrame) -> DataFrame:
    """Rows of many documents with a salt from the document."""
    return df.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)))


def _copied(df: DataFrame) -> DataFrame:
    """One row a digest, for each salt."""
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))


def repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mean: int = MEAN, digest: int = DIGEST) -> DataFrame:
    """(id, gone): numbers and digests of the chunks to remove, for the documents that lose any.

    Digests pick what can repeat; then the bytes themselves are the grouping key, which a partial
    aggregate collapses before the exchange, so a passage in a third of all documents is one row a task.
    What is joined on a digest is dealt to ``SALTS`` parts by document.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"))
    all_keys = stored(map_rows(texts, f"key {kind}, c int, h binary", _keys(mean, digest)), "chunks")
    twice = stored(all_keys.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "twice")
    again = stored(_dealt(all_keys).join(_copied(twice), ["h", "salt"], "left_semi").select("key", "c", "h"), "again")
    discard(all_keys)
    wanted = again.groupBy("key").agg(F.collect_set("c").alias("wanted")).withColumnRenamed("key", "k2")
    held = texts.join(stored(wanted, "wanted").hint("merge"), F.col("key") == F.col("k2")).select("key", "text", "wanted")
    read = map_rows(held, f"key {kind}, c int, h binary, b binary", _bytes(mean, digest))
    equal = read.groupBy("h", "b").agg(F.min(F.struct("key", "c")).alias("first"))
    firsts = equal.groupBy("h").agg(F.min("first").alias("first"), F.count(F.lit(1)).alias("kinds"))
    firsts = stored(firsts, "firsts")
    gone = _dealt(again).join(_copied(firsts.where("kinds = 1")), ["h", "salt"]).where(F.struct("key", "c") != F.col("first")).select("key", "c", "h")
    several = firsts.where("kinds > 1").select("h")
    if not several.isEmpty():  # texts that share a digest are told apart by their bytes
        some = stored(read.join(several, "h", "left_semi"), "several")
        own = some.groupBy("h", "b").agg(F.min(F.struct("key", "c")).alias("first"))
        gone = gone.unionByName(some.join(own, ["h", "b"]).where(F.struct("key", "c") != F.col("first")).select("key", "c", "h"))
    gone = stored(gone.groupBy("key").agg(F.collect_set(F.struct("c", "h")).alias("gone")).withColumnRenamed("key", id_col), "gone")
    for old in (twice, again, firsts):
        discard(old)
    return gone


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mean: int = MEAN, digest: int = DIGEST) -> DataFrame:
    """``docs`` with the repeated chunks removed from the text (``n_chars`` follows), and ``n_removed_chunks``."""
    gone = repeated_chunks(docs, id_col, text_col, mean, digest).select(F.col(id_col).alias("__id"), F.col("gone").alias("__gone"))

    @pandas_udf("string")
    def cut(text: pd.Series, c: pd.Series, h: pd.Series) -> pd.Series:
        # another text under the same id keeps what is not the chunk that was judged
        def own(t, c, h):
            said = set(zip(c, map(bytes, h)))
            return {k for k, s in multi_line(t, mean) if (k, _digest(s, digest)) in said}

        return pd.Series([None if t is None else without(t, own(t, x, y), mean) for t, x, y in zip(text, c, h)], dtype=object)

    j = docs.join(gone.hint("merge"), F.col(id_col) == F.col("__id"), "left")
    j = j.withColumn("__cut", cut(F.when(F.col("__gone").isNotNull(), F.col(text_col)), F.col("__gone.c"), F.col("__gone.h")))  # only those texts leave the JVM
    j = j.withColumn("__text", F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(F.col("__cut")))
    put = {text_col: F.col("__text"), "n_chars": F.when(F.col("__gone").isNull(), F.col("n_chars")).otherwise(F.length("__text").cast("long")) if "n_chars" in docs.columns else None}
    return j.select(
        *(put[c].alias(c) if c in put else F.col(c) for c in docs.columns if c != "n_removed_chunks"), F.coalesce(F.size("__gone"), F.lit(0)).alias("n_removed_chunks")
    )


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "text", "n_removed_chunks")
