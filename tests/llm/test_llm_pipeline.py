"""The pipeline's stages against plain versions over the smallest documents."""

from collections import Counter, defaultdict

from pyspark.sql import functions as F

import corpus_pipeline as p
from quern.llm import packing, quality_rules
from tests.llm.test_llm_corpus import plain_targets
from tests.llm.test_llm_lines import own_dedup
from tests.llm.test_llm_near_copies import plain_groups
from tests.llm.test_llm_rows import plain_rules


def plain_quality(rows):
    own = defaultdict(dict)
    for r in rows:
        own[r["source"]][r["doc_id"]] = r["text"] or ""
    often = {}
    for s, held in own.items():
        c = Counter(k for t in held.values() for k in {quality_rules.line_key(x) for x in t.split("\n")} if k)
        often[s] = {k for k, n in c.items() if n > max(quality_rules.LINE_DOCS, quality_rules.LINE_SHARE * len(held))}
    out = []
    for r in rows:
        n, _, _, _, rep = plain_rules(r["text"])
        if n < 10 or 100 * rep > 20 * n:
            continue
        lines = r["text"].split("\n")
        kept = [x for x in lines if quality_rules.line_key(x) not in often[r["source"]]]
        left = len(" ".join(kept).encode().split())
        if len(kept) < len(lines) and (left < quality_rules.LEFT_WORDS or left < quality_rules.LEFT_SHARE * n):
            continue
        out.append(r | ({"text": "\n".join(kept), "n_chars": len("\n".join(kept))} if len(kept) < len(lines) else {}))
    return out


def plain_lines(rows):
    rows = sorted(rows, key=lambda r: r["doc_id"])
    return [r | ({"text": t, "n_chars": len(t)} if t != r["text"] else {}) for r, t in zip(rows, own_dedup([r["text"] for r in rows]))]


def plain_near(rows):
    groups = plain_groups({r["doc_id"]: r["text"] for r in rows})
    return [r for r in rows if groups[r["doc_id"]] == r["doc_id"]]


def key(rows):
    return sorted(tuple(sorted(r.items())) for r in rows)


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    cur, want = docs, [r.asDict() for r in docs.collect()]
    for (_, stage), plain in zip(p.STAGES, (plain_quality, plain_lines, plain_near)):
        cur, want = stage(spark, cur, sf).cache(), plain(want)
        assert key(r.asDict() for r in cur.collect()) == key(want)
    mixed = [r.asDict() for r in p.mixing(spark, cur, sf).collect()]
    size = {r["doc_id"]: len((r["text"] or "").encode().split()) for r in want}
    n, before, after = Counter(r["doc_id"] for r in mixed), defaultdict(int), defaultdict(int)
    for r in want:
        before[r["source"]] += size[r["doc_id"]]
        after[r["source"]] += n[r["doc_id"]] * size[r["doc_id"]]
        assert n[r["doc_id"]] <= 3
    most = defaultdict(int)
    for r in want:
        most[r["source"]] = max(most[r["source"]], size[r["doc_id"]])
    for s, t in plain_targets(before).items():
        assert abs(after[s] - t) <= most[s]
    encode = packing.encoder()
    packed = p.packing(spark, spark.createDataFrame(p.mixing(spark, cur, sf).rdd, docs.schema), sf).collect()
    assert sum(r.length for r in packed) == sum(len(encode(r["text"] or "")) + 1 for r in mixed)


def test_stages_of_nothing_and_of_rows_without_ids(spark, sf):
    """An empty table goes through; rows without id are kept by every stage but where their text fails the rules."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    cur = docs.limit(0)
    for _, stage in p.STAGES:
        cur = stage(spark, cur, sf)
    assert cur.count() == 0
    nameless = docs.orderBy("doc_id").limit(30).withColumn("doc_id", F.lit(None).cast("long"))
    cur, n = nameless, []
    for _, stage in p.STAGES[:3]:
        cur = stage(spark, cur, sf).cache()
        n.append(cur.count())
    assert n[0] == n[1] == n[2] > 20 and p.packing(spark, p.mixing(spark, cur, sf), sf).count() > 0
