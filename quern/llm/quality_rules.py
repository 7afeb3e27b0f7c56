"""Quality rules: per-document word rules and cross-document line frequency.

Method: every line is normalised (ASCII white space collapsed, ASCII letters lower-cased) and
hashed; per host the distinct documents that hold a line are counted (``copies_once`` counts copies of
a text as one document, which is off); lines in more documents than the host's limit are removed; a
document that is depleted by that is rejected.

Defined results: a null or empty text has no words, so it fails the base rules. A null host is a
host of its own. Repeated rows each get a row of the result and count as one document; rows without
an id count as one document a text. Ties do not occur (limits are strict).
An empty table gives an empty result. Only the named columns are read, so other columns may have
any names.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from quern.llm.common import SPACE, map_rows
from quern.session import stored

SYMBOLS = "#*$%&|<>"
#: A word in the sense of the contract.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: A line is removed if it stands in more than this share of a host's distinct documents ...
LINE_SHARE = 0.08
#: ... and in more than this many of them, so that a host of a few documents keeps its lines.
LINE_DOCS = 3
#: A document is depleted if lines were removed and fewer words, or a smaller share of words, stay.
LEFT_WORDS = 10
LEFT_SHARE = 0.2
SALTS = 16


def repeat_words(words: list) -> int:
    """Words that stand in a 5-word window found twice or more, first ones included."""
    wins = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
    seen = set(wins)
    if len(seen) == len(wins):
        return 0
    once, twice = set(), set()
    for w in wins:
        (twice if w in once else once).add(w)
    n, end = 0, 0
    for i, w in enumerate(wins):
        if w in twice:
            n += i + 5 - max(i, end)
            end = i + 5
    return n


def line_key(line: str) -> bytes:
    """A line as it is compared: ASCII letters lower-cased, white space collapsed."""
    return b" ".join(line.encode().lower().split())


def rules(text: str | None) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode().split()
    chars = len(text) - sum(map(text.count, SPACE))
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    return len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeat_words(words)


def _measure():
    import xxhash

    def row(key, text, host, digest):
        lines: dict[int, int] = {}
        for x in (text or "").split("\n"):
            if k := line_key(x):
                h = xxhash.xxh64_intdigest(k) - (1 << 63)
                lines[h] = lines.get(h, 0) + k.count(b" ") + 1
        return [(key, host, digest, *rules(text), [{"h": h, "w": w} for h, w in lines.items()])]

    return row


def text_digest(text_col: str):
    """128 bits of a text, null as the empty text: rows of one text share their lines' verdict."""
    return F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
    line_share: float = LINE_SHARE, line_docs: int = LINE_DOCS, left_words: int = LEFT_WORDS, left_share: float = LEFT_SHARE,
    copies_once: bool = False,
) -> DataFrame:
    """One row a document: id, host, text_hash, the base counts, ``base_failed``, ``n_removed_words``,
    ``removed`` (hashes of the lines removed) and ``kept``.

    The texts are read once; what is shuffled is the line hashes of distinct texts. The join that
    finds the lines above the limit is salted, as a hot host's hot line may be in a third of all rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = stored(
        map_rows(
            docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"), F.col(host_col).alias("host"), text_digest(text_col)),
            f"key {kind}, host string, text_hash binary, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<struct<h:long,w:int>>",
            _measure,
        ),
        "rules",
    )
    same = lambda a, b: a.eqNullSafe(b)  # noqa: E731  a null host is a host
    texts = rows.groupBy("host", "text_hash").agg(F.first("lines").alias("lines"))
    # how many documents hold a text: copies meet here as one row a task, not as their lines
    held = rows.select("host", "text_hash", "key").distinct().groupBy("host", "text_hash").agg((F.lit(1) if copies_once else F.count(F.lit(1))).cast("long").alias("docs"))
    x, y = texts.alias("x"), held.alias("y")
    texts = x.join(y, same(F.col("x.host"), F.col("y.host")) & (F.col("x.text_hash") == F.col("y.text_hash"))).select("x.*", "docs")
    lines = texts.select(
        "host", "text_hash", "docs", F.explode("lines").alias("l"), F.pmod(F.xxhash64("text_hash"), F.lit(SALTS)).alias("salt")
    ).select("host", "text_hash", "docs", "salt", "l.h", "l.w")
    lines = stored(lines, "lines")
    limits = held.groupBy("host").agg(F.greatest(F.lit(float(line_docs)), F.sum("docs") * F.lit(line_share)).alias("limit"))
    counts = lines.groupBy("host", "h").agg(F.sum("docs").alias("n")).where(F.col("n") > line_docs)
    c, m = counts.alias("c"), limits.alias("m")
    above = stored(
        c.join(m, same(F.col("c.host"), F.col("m.host"))).where("n > limit").select("c.host", "h", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt")),
        "above",
    )
    a, b = lines.alias("a"), above.alias("b")
    removed = stored(
        a.join(b, (F.col("a.h") == F.col("b.h")) & (F.col("a.salt") == F.col("b.salt")) & same(F.col("a.host"), F.col("b.host")))
        .groupBy("a.host", "text_hash")
        .agg(F.sum("w").alias("n_removed_words"), F.collect_list("a.h").alias("removed")),
        "removed",
    )
    r, d = rows.drop("lines").alias("r"), removed.alias("d")
    out = r.join(
        d, (F.col("r.text_hash") == F.col("d.text_hash")) & same(F.col("r.host"), F.col("d.host")), "left"
    ).select("r.*", F.coalesce("n_removed_words", F.lit(0).cast("long")).alias("n_removed_words"), "removed")
    left = F.col("n_words") - F.col("n_removed_words")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    depleted = (F.col("n_removed_words") > 0) & ((left < left_words) | (left < left_share * F.col("n_words")))
    return (
        out.withColumn("base_failed", failed)
        .withColumn("kept", ~failed & ~depleted)
        .withColumnRenamed("key", id_col)
    )


def _strip():
    import xxhash

    def row(text, removed):
        gone = set(removed)
        return "\n".join(x for x in text.split("\n") if not ((k := line_key(x)) and xxhash.xxh64_intdigest(k) - (1 << 63) in gone))

    return row


def apply_quality_rules(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the rejected documents, and without the lines above the limits in the rest.

    The verdict depends on host and text; every column of ``docs`` stays.
    """
    id_col, text_col, host_col = (options.get(k, v) for k, v in (("id_col", "doc_id"), ("text_col", "text"), ("host_col", "source")))
    marks = quality_rules(docs, **options).where("kept").select(F.col(id_col).alias("__id"), F.col("removed").alias("__removed"), F.col("text_hash").alias("__text_hash"), F.col("host").alias("__host"))
    marks = stored(marks.dropDuplicates(["__id", "__text_hash", "__host"]), "marks")

    @pandas_udf("string")
    def strip(text: pd.Series, removed: pd.Series) -> pd.Series:
        f = _strip()
        return pd.Series([None if t is None else f(t, r) for t, r in zip(text, removed)], dtype=object)

    d = docs.withColumn("__hash", text_digest(text_col))
    own = (F.col(id_col).eqNullSafe(F.col("__id"))) & (F.col("__hash") == F.col("__text_hash")) & F.col(host_col).cast("string").eqNullSafe(F.col("__host"))
    j = d.join(marks.hint("merge"), own)
    j = j.withColumn("__new", strip(F.when(F.col("__removed").isNotNull(), F.col(text_col)), F.col("__removed")))  # only those texts leave the JVM
    new = F.when(F.col("__removed").isNull(), F.col(text_col)).otherwise(F.col("__new"))
    cols = [new.alias(c) if c == text_col else F.when(F.col("__removed").isNull(), F.col(c)).otherwise(F.length(new)).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return j.select(*cols)


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for the whole of ``documents``, plus the words removed with frequent lines."""
    out = quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words")
