"""Removal of bytes covered by long strings that also start earlier in the corpus.

Method: shard Burrows-Wheeler transforms are merged by iterative interleave refinement. Each round
replaces the interleave by the one that sorts by two more bytes (a stable counting step over the
merged transform); the round at which a boundary between two rows first appears is their common
prefix, and after ``LENGTH`` bytes the rows between boundaries are the repeated intervals. No
suffix of the union is sorted again.

What is merged is kept bounded as follows. A winnowed anchor (least hash of ``GRAM`` bytes) is
chosen in every ``LENGTH``-byte string, so equal strings have equal anchors at equal places. The
starts of a document that choose the same anchor form a run; strings of runs whose anchor stands in
one place of the corpus cannot repeat. Of the rest, runs with equal bytes are aggregated to their
first place; only anchors whose runs have different bytes go to the transforms, dealt by anchor
into buckets of bounded size and cut down to starts whose ends have an equal. Anchors with more than ``HOT`` different runs are split further by
the place of the start, where grouping the strings themselves is exact.

Defined results: a null or empty text has no bytes. Documents are ordered by id; rows that repeat
an id and text are one document and have equal results; other texts under one id are documents of their
own, ordered by digest. A copy of an earlier text of ``LENGTH``
bytes or more is removed whole. Rows without an id are kept whole
and stand before no other. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import map_rows, ranked
from quern.session import discard, release, stored

LENGTH = 100
GRAM = 36
#: Bytes of different runs in a bucket, and of a shard with a transform of its own.
BUCKET = 4 << 20
SHARD = 1 << 19
#: Anchors with more different runs than this (about 8 MB) are split by start.
HOT = 50_000
BUCKETS_LEAST = 24
EMPTY = hashlib.sha256(b"").hexdigest()


def gram_hashes(b: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Polynomial hash of each ``gram``-byte string, by doubling."""
    with np.errstate(over="ignore"):
        have, width, out, at = b.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x7F4A7C15), 1, None, 0
        n, power = len(b) - gram + 1, np.uint64(0x100000001B3)
        bits = gram
        while bits:
            if bits & 1:
                part = have[at : at + n]
                out = part.copy() if out is None else out * power + part
                at += width
            bits >>= 1
            if bits:
                have = have[:-width] * power + have[width:]
                width *= 2
                power = power * power
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
        return out


def runs(b: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """First start of each run of starts that choose one anchor, and the anchors' hashes."""
    if len(b) < length:
        return np.empty(0, np.int32), np.empty(0, np.int64)
    h = gram_hashes(b, gram)
    val, pos, width, window = (h >> np.uint64(32)).astype(np.uint32), np.arange(len(h), dtype=np.int32), 1, length - gram + 1
    while width < window:
        step = min(width, window - width)
        less = val[step:] < val[:-step]
        val, pos = np.where(less, val[step:], val[:-step]), np.where(less, pos[step:], pos[:-step])
        width += step
    first = np.flatnonzero(np.concatenate(([True], pos[1:] != pos[:-1])))
    return first.astype(np.int32), h[pos[first]].view(np.int64)


#: Bytes that the first sort of a shard compares at once.
PACKED = 7


def suffix_array(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of strings laid end to end, each closed by a 0 at its end; closing bytes are ordered by string.

    A first sort by ``PACKED`` bytes, then prefix doubling. What lies behind a string's end is never compared.
    """
    n = len(codes)
    own = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=-1))
    left = ends[own] - np.arange(n)
    key = np.zeros(n, dtype=np.int64)
    wide = codes.astype(np.int64)
    for k in range(PACKED):
        key <<= 9
        key[: n - k] += np.where(left[: n - k] >= k, wide[k:], 0)
    step = PACKED
    while True:
        order = np.argsort(key)
        sorted_ = key[order]
        new = np.cumsum(np.concatenate(([0], sorted_[1:] != sorted_[:-1])))
        if new[-1] == n - 1:
            return order
        rank = np.empty(n, dtype=np.int64)
        rank[order] = new
        at = np.minimum(np.arange(n) + step, n - 1)
        key = rank * (n + len(ends)) + np.where(left >= step, rank[at] + len(ends), own)
        step *= 2


def transform(strings: list[bytes], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(transform, suffix array, ends of the strings) of a shard; 0 closes each string.

    A row of the transform holds the two bytes before its suffix (round the end of its string) as one
    code, which is 0 if the first of them closes a string.
    """
    flat = np.frombuffer(b"\0".join(strings) + b"\0", dtype=np.uint8)
    ends = np.cumsum([len(s) + 1 for s in strings]) - 1
    codes = table[flat].astype(np.int32)
    codes[ends] = 0
    sa = suffix_array(codes, ends)
    before = np.arange(len(codes)) - 1
    before[np.concatenate(([0], ends[:-1] + 1))] = ends
    last = codes[before]
    first = last[before]
    pair = np.where(first == 0, 0, first * (int(table.max()) + 1) + last)
    return pair[sa].astype(np.uint16 if pair.max() < 1 << 16 else np.int32), sa, ends


def merged(bwts: list[np.ndarray], length: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave (shard of each row) and common prefixes with the row before, to even lengths, up to ``length`` (even).

    ``base``: codes are pairs, first byte * base + second. A round sorts by two more bytes; rows are
    sorted by ``length`` bytes when this ends.
    """
    source = np.concatenate(bwts)
    inter = np.repeat(np.arange(len(bwts), dtype=np.uint8 if len(bwts) < 256 else np.int32), [len(x) for x in bwts])
    n = len(source)
    lcp = np.full(n, length, dtype=np.int16)
    bound = np.zeros(n, dtype=bool)
    bound[0] = True
    lcp[0] = 0
    tally = np.bincount(source)
    stop = np.cumsum(tally)
    # groups of codes that hold a closing byte: their rows go by shard, then string
    closing = [(int(stop[c] - tally[c]), int(stop[c])) for c in np.flatnonzero(tally) if c % base == 0 or c == 0]
    fixed = np.zeros(n, dtype=bool)
    for a, b in closing:
        fixed[a:b] = True
    for h in range(2, length + 1, 2):
        block = np.cumsum(bound, dtype=np.int32)
        row = np.empty(n, dtype=source.dtype)
        row[np.argsort(inter, kind="stable")] = source
        order = np.argsort(row, kind="stable")
        codes, blocks = row[order], block[order]
        new = fixed.copy()
        new[0] = True
        new[1:] |= (codes[1:] != codes[:-1]) | (blocks[1:] != blocks[:-1])
        inter = inter[order]
        for a, b in closing:
            inter[a:b] = np.sort(inter[a:b])
        fresh = new & ~bound
        if not fresh.any() and h > 2:
            break
        lcp[fresh] = h - 2
        bound |= new
    return inter, lcp


def repeated_starts(strings: list[bytes], places: np.ndarray, length: int = LENGTH, shard: int = SHARD) -> list[tuple[int, int, int]]:
    """(string, a, b): ranges of offsets whose ``length``-byte strings also start at a lesser place.

    ``places``: rising with document and start; the place of offset o of string i is places[i] + o.
    """
    used = np.unique(np.frombuffer(b"".join(strings), dtype=np.uint8))
    table = np.zeros(256, dtype=np.uint8 if len(used) < 256 else np.int16)
    table[used] = np.arange(1, len(used) + 1)
    parts, size = [[]], 0
    for i, s in enumerate(strings):
        if size > shard:
            parts.append([])
            size = 0
        parts[-1].append(i)
        size += len(s) + 1
    made = [transform([strings[i] for i in part], table) for part in parts]
    inter, lcp = merged([m[0] for m in made], length, int(table.max()) + 1)
    where, offset = np.empty(len(inter), dtype=np.int64), np.empty(len(inter), dtype=np.int64)
    order = np.argsort(inter, kind="stable")
    at = 0
    for part, (_, sa, ends) in zip(parts, made):
        k = np.searchsorted(ends, sa)
        starts = np.concatenate(([0], ends[:-1] + 1))
        rows = order[at : at + len(sa)]
        where[rows], offset[rows] = np.asarray(part)[k], sa - starts[k]
        at += len(sa)
    first = np.flatnonzero(lcp < length)
    place = places[where] + offset
    least = np.repeat(np.minimum.reduceat(place, first), np.diff(np.concatenate((first, [len(lcp)]))))
    hit = np.flatnonzero(place > least)
    hit = hit[np.lexsort((offset[hit], where[hit]))]
    out: list[tuple[int, int, int]] = []
    w, o = where[hit], offset[hit]
    if len(w):
        cut = np.flatnonzero((np.diff(w) != 0) | (np.diff(o) != 1)) + 1
        for a, b in zip(np.concatenate(([0], cut)), np.concatenate((cut, [len(w)]))):
            out.append((int(w[a]), int(o[a]), int(o[b - 1]) + 1))
    return out


def _anchors(length: int, gram: int):
    schema = pa.schema([("key", pa.int64()), ("h", pa.int64()), ("t", pa.int64()), ("p", pa.int32()), ("n", pa.int32()), ("n_bytes", pa.int64()), ("digest", pa.string())])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                keys, texts = batch.slice(at, 256).columns
                raw = [(t or "").encode() for t in texts.to_pylist()]
                if not raw:
                    continue
                digests = [hashlib.sha256(b).hexdigest() for b in raw]
                short = np.array([int(d[:16], 16) for d in digests], dtype=np.uint64).view(np.int64)
                found = [runs(np.frombuffer(b, dtype=np.uint8), length, gram) for b in raw]
                count = [len(x[0]) for x in found]
                p = np.concatenate([x[0] for x in found])
                ends = np.cumsum(count) - 1
                n = np.diff(p, append=p[-1:])
                for k, (c, e) in enumerate(zip(count, ends)):
                    if c:
                        n[e] = len(raw[k]) - length + 1 - p[e]
                each = np.repeat(np.arange(len(raw)), count)
                keys = keys.cast(pa.int64())
                none = pa.nulls(len(p), pa.int64()), pa.nulls(len(p), pa.string())
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(each)), pa.array(np.concatenate([x[1] for x in found])), pa.array(short[each]), pa.array(p), pa.array(n.astype(np.int32)), *none], schema=schema)
                void = [pa.nulls(len(raw), k) for k in (pa.int64(), pa.int64(), pa.int32(), pa.int32())]
                yield pa.RecordBatch.from_arrays([keys, *void, pa.array([len(b) for b in raw], pa.int64()), pa.array(digests)], schema=schema)

    return run, "key long, h long, t long, p int, n int, n_bytes long, digest string"


def _digests(length: int):
    schema = pa.schema([("key", pa.int64()), ("h", pa.int64()), ("d", pa.binary()), ("p", pa.int32()), ("n", pa.int32())])

    def run(batches):
        import xxhash

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for key, text, wanted in zip(part["key"].to_pylist(), part["text"].to_pylist(), part["wanted"]):
                    b, rows = text.encode(), wanted.values
                    h, p, n = (rows.field(k) for k in ("h", "p", "n"))
                    d = [xxhash.xxh3_128_digest(b[x : x + y + length - 1]) for x, y in zip(p.to_pylist(), n.to_pylist())]
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(d), pa.int64()), h, pa.array(d, pa.binary()), p, n], schema=schema)

    return run, "key long, h long, d binary, p int, n int"


def _windows(length: int):
    def make():
        def row(key, text, wanted):
            b = text.encode()
            return [(x["h"], b[x["p"] : x["p"] + x["n"] + length - 1], key, x["p"], x["n"], x["kinds"]) for x in wanted]

        return row

    return make


def possible(strings: list[bytes], length: int = LENGTH, gram: int = GRAM) -> list[tuple[int, int, int]]:
    """(string, a, b): ranges of starts whose first and last ``gram`` bytes both equal another start's.

    A start outside cannot repeat, so strings are cut down to these ranges before they are transformed.
    """
    size = np.array([len(s) for s in strings])
    n, base = size - length + 1, np.cumsum(size) - size
    g = gram_hashes(np.frombuffer(b"".join(strings), dtype=np.uint8), gram)
    which = np.repeat(np.arange(len(strings)), n)
    offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = base[which] + offset
    with np.errstate(over="ignore"):
        ends = g[at] * np.uint64(0x9E3779B97F4A7C15) ^ g[at + length - gram]
    order = np.argsort(ends)
    same = ends[order][1:] == ends[order][:-1]
    hit = np.zeros(len(ends), dtype=bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    edge = np.diff(np.concatenate(([False], hit, [False])).astype(np.int8))
    out = []
    for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
        while a < b:  # a range ends with its string
            i = which[a]
            e = min(b, a + n[i] - offset[a])
            out.append((int(i), int(offset[a]), int(offset[a] + e - a)))
            a = e
    return out


def _bucket(length: int, gram: int):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["key", "p"]).reset_index(drop=True)
        doc = part["key"].rank(method="dense").astype("int64") - 1
        texts, p = [bytes(x) for x in part["b"]], part["p"].to_numpy().astype(np.int64)
        cuts = possible(texts, length, gram)
        if not cuts:
            return pd.DataFrame({"key": [], "a": [], "b": []}).astype("int64")
        own, first = np.array([c[0] for c in cuts]), np.array([c[1] for c in cuts])
        places = (doc.to_numpy() * (1 << 31) + p)[own] + first
        found = repeated_starts([texts[i][a : b + length - 1] for i, a, b in cuts], places, length)
        i, a, b = (np.array([x[k] for x in found], dtype=np.int64) for k in range(3))
        start = (p[own] + first)[i]
        return pd.DataFrame({"key": part["key"].to_numpy()[own[i]], "a": start + a, "b": start + b + length - 1})

    return run


def spans_of(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the union."""
    out: list[list[int]] = []
    for a, b in sorted(intervals):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _cut():
    def row(key, text, gone):
        b, spans, kept, at = text.encode(), spans_of([(x["a"], x["b"]) for x in gone]), [], 0
        for s, e in spans:
            kept.append(b[at:s])
            at = e
        kept.append(b[at:])
        rest = b"".join(kept)
        return [(key, len(b), len(b) - len(rest), len(spans), hashlib.sha256(rest).hexdigest(), rest, [{"start": s, "end": e} for s, e in spans])]

    return row


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """One row a document: id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes; null if nothing goes), spans.

    Ids must be integers. Texts are exchanged once, by document; what else moves is anchors and runs.
    """
    if length % 2 or length < gram:
        raise ValueError("length must be even and at least gram")
    texts = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("text"))
    run, schema = _anchors(length, gram)
    anchors = stored(texts.mapInArrow(run, schema), "anchors")
    meta = stored(anchors.where("h is null").select("key", "n_bytes", "digest"), "meta")
    each = anchors.where("h is not null").select("h", "key", "p", "n")
    several = meta.where("key is not null").groupBy("key").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a <> b")
    if not several.isEmpty():  # ids are no keys here: documents are numbered in order, and looked up by text afterwards
        discard(anchors)
        return _numbered(docs, id_col, text_col, length, gram, hot)
    firsts = stored(meta.groupBy("digest").agg(F.min("key").alias("first"), F.count_distinct("key").alias("n")).where("n > 1").select(F.col("digest").alias("d"), "first"), "copies")
    copies = stored(meta.join(firsts, (F.col("digest") == F.col("d")) & (F.col("key") > F.col("first")), "left_semi").distinct(), "later")
    # anchors in two texts, or at two places of one; copies of a text count once
    place = F.xxhash64("t", "p")
    twice = anchors.where("h is not null").select("h", place.alias("x")).groupBy("h").agg(F.min("x").alias("lo"), F.max("x").alias("hi")).where("lo <> hi")
    twice = stored(twice.select(F.col("h").alias("h2")), "twice")
    spark = docs.sparkSession
    release(spark)
    wanted = stored(each.join(twice, F.col("h") == F.col("h2"), "left_semi").groupBy("key").agg(F.collect_set(F.struct("h", "p", "n")).alias("wanted")), "wanted")
    discard(twice)
    discard(anchors)
    del each, twice, anchors
    release(spark)
    ids = wanted.join(copies.select("key"), "key", "left_anti").withColumnRenamed("key", "k2")
    held = stored(texts.join(ids, F.col("key") == F.col("k2")).dropDuplicates(["key"]).select("key", "text", "wanted"), "held")
    discard(wanted)
    del wanted, ids
    release(spark)
    run, schema = _digests(length)
    windows = stored(held.mapInArrow(run, schema), "windows")
    first = stored(windows.groupBy("h", "d").agg(F.min(F.struct("key", "p", "n")).alias("f")).select("h", "f.key", "f.p", "f.n"), "first")
    release(spark)
    kinds = stored(first.groupBy("h").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select(F.col("h").alias("h3"), "kinds"), "kinds")
    differ = first.join(kinds, F.col("h") == F.col("h3")).groupBy(F.col("key").alias("k3")).agg(F.collect_list(F.struct("h", "p", "n", "kinds")).alias("differ"))
    read = held.join(stored(differ, "differ"), F.col("key") == F.col("k3")).select("key", "text", "differ")
    runs_ = stored(map_rows(read, "h long, b binary, key long, p int, n int, kinds long", _windows(length)), "runs")
    del kinds, differ
    release(spark)
    size = runs_.where(F.col("kinds") <= hot).agg(F.sum(F.length("b"))).first()[0] or 0
    buckets = max(BUCKETS_LEAST, -(-size // BUCKET))
    by_merge = runs_.where(F.col("kinds") <= hot).groupBy(F.pmod("h", F.lit(buckets)).alias("bucket")).applyInPandas(_bucket(length, gram), "key long, a long, b long")
    # hot anchors: each start by itself; equal strings have their anchor at equal places
    starts = runs_.where(F.col("kinds") > hot).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select(
        F.unhex(F.md5(F.expr(f"substring(b, o + 1, {length})"))).alias("s"), "key", (F.col("p") + F.col("o")).alias("at")
    )
    starts = stored(starts, "starts")
    least = stored(starts.groupBy("s").agg(F.min(F.struct("key", "at")).alias("f")).select("f.key", "f.at"), "least")
    by_start = starts.join(least, ["key", "at"], "left_anti").select("key", F.col("at").cast("long").alias("a"), (F.col("at") + length).cast("long").alias("b"))
    later = windows.select("key", "p", "n").join(first.select("key", "p"), ["key", "p"], "left_anti").select(
        "key", F.col("p").cast("long").alias("a"), (F.col("p") + F.col("n") + length - 1).cast("long").alias("b")
    )
    gone = by_merge.unionByName(by_start).unionByName(later).groupBy("key").agg(F.collect_list(F.struct("a", "b")).alias("gone"))
    gone = stored(gone.withColumnRenamed("key", "k4"), "gone")
    for old in (windows, runs_, first):
        discard(old)
    del windows, runs_, first, by_merge, by_start, later, read
    release(spark)
    cut_schema = "key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, spans array<struct<start:long,end:long>>"
    changed = stored(map_rows(held.join(gone, F.col("key") == F.col("k4")).select("key", "text", "gone"), cut_schema, _cut), "cut")
    whole = copies.where(F.col("n_bytes") >= length).select(
        "key", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(EMPTY).alias("kept_sha256"),
        F.lit(b"").alias("kept"), F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end"))).alias("spans"),
    )
    some = stored(changed.unionByName(whole).withColumnRenamed("key", "k5").withColumnRenamed("n_bytes", "n5"), "some")
    return meta.join(some, F.col("key") == F.col("k5"), "left").select(
        F.col("key").alias(id_col), "n_bytes", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"),
        F.coalesce("kept_sha256", "digest").alias("kept_sha256"), "kept", "spans",
    )


def _numbered(docs: DataFrame, id_col: str, text_col: str, length: int, gram: int, hot: int) -> DataFrame:
    """:func:`suffix_dedup` where ids repeat with other texts: over numbers of the distinct (id, text) in order."""
    digest = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), digest.alias("t"), F.col(text_col).alias("text"))
    order = F.concat(F.lpad((F.col("id").cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("string"), 20, "0"), F.col("t"))
    named = ranked(rows.select("id", "t").distinct().withColumn("order", order), "order").select("id", "t", F.col("rank").alias("number"))
    named = stored(named, "numbers")
    one = stored(rows.dropDuplicates(["id", "t"]).join(named, ["id", "t"]).select("number", "text").unionByName(docs.where(F.col(id_col).isNull()).select(F.lit(None).cast("long").alias("number"), F.col(text_col).alias("text"))), "numbered")
    out = suffix_dedup(one, "number", "text", length, gram, hot)
    cols = [c for c in out.columns if c != "number"]
    known = rows.select("id", "t").join(named, ["id", "t"]).join(out, "number").select(F.col("id").alias(id_col), *cols)
    return known.unionByName(out.where("number is null").select(F.lit(None).cast("long").alias(id_col), *cols))


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
