"""Near copies by word shingles against brute force."""

import random

import pytest

import corpus_pipeline as p
from quern.llm import near_copies, simhash
from tests.llm.test_llm_corpus import closure, corpus, frame, words


def plain_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_groups(texts):
    sets = {i: plain_set(t) for i, t in texts.items()}
    alike = lambda a, b: a == b or 10 * len(a & b) >= 8 * len(a | b)
    return closure(sets, [(a, b) for a in sets for b in sets if a < b and alike(sets[a], sets[b])])


def edited():
    """Texts with edits of one word each, from few to about as many as 0.8 bears, and a common line."""
    r = random.Random(21)
    texts = corpus() + ["", "a b", "A  b", "a b c d e", "a b c d e f"]
    for _ in range(12):
        base = words(r, 120).split()
        for n in range(6):
            t = list(base)
            for k in r.sample(range(len(t)), n):
                t[k] = "edited"
            texts.append(" ".join(t) + "\nall of these hold the same last line here")
    base = words(r, 100).split()
    for i in range(40):
        t = list(base)
        t[i] = f"own{i}"
        texts.append(" ".join(t))
    return texts


@pytest.mark.parametrize("chained", [3, 1000])
def test_groups_are_those_of_brute_force(spark, chained):
    texts = edited()
    rows, of = near_copies.near_copy_groups(frame(spark, texts).selectExpr("doc_id as key", "unhex(md5(coalesce(text, ''))) as t", "text"), chained=chained)
    group = {x.d: x.group for x in of.collect()}
    by = {}
    for x in sorted(rows.collect(), key=lambda x: x.key):
        by.setdefault(group[x.d], []).append(x.key)
    got = {k: own[0] for own in by.values() for k in own}
    want = plain_groups(dict(enumerate(texts)))
    assert got == want and len(set(want.values())) < len(texts) - 60


def family(n=160):
    """Texts about 0.8 alike: copies of one with edits of their own, each a few words."""
    r = random.Random(26)
    base = words(r, 150).split()
    out = []
    for i in range(n):
        t = list(base)
        for k in r.sample(range(len(t)), r.randint(2, 5)):
            t[k] = f"own{i}"
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize("tiles", [1, 3])
def test_tiles_return_a_forest_of_the_links_of_brute_force(tiles):
    import numpy as np

    texts = family()
    sets = [near_copies.shingles(t).view(np.int64) for t in texts]
    prints = np.stack([near_copies.wide_print(s.view(np.uint64)).view(np.uint64) for s in sets])
    d, tile = np.arange(len(sets)), np.arange(len(sets)) % tiles
    found = []
    for lo in range(tiles):
        for hi in range(lo, tiles):
            k = np.flatnonzero((tile == lo) | (tile == hi))
            links = near_copies.forest(d[k], d[k], tile[k], prints[k], [sets[i] for i in k], 80, step=1000)
            assert len(links) < len(k)
            found += links
    want = plain_groups(dict(enumerate(texts)))
    assert closure(range(len(texts)), found) == want and 2 < len(set(want.values())) < len(texts) - 20


def test_families_are_compared_in_tiles(spark, monkeypatch):
    texts = dict(enumerate(family()))
    made = {}
    kept = near_copies.stored

    def spied(df, label="t"):
        made.setdefault(label, []).append(kept(df, label))
        return made[label][-1]

    monkeypatch.setattr(near_copies, "stored", spied)
    monkeypatch.setattr(near_copies, "discard", lambda df: None)
    _, of = near_copies.near_copy_groups(frame(spark, list(texts.values())).selectExpr("doc_id as key", "unhex(md5(text)) as t", "text"), chained=8, tile=6000)
    want = plain_groups(texts)
    got = {}
    for x in of.collect():
        got.setdefault(x.group, []).append(x.least.key)
    assert sorted(sorted(g) for g in got.values()) == sorted(sorted(k for k in want if want[k] == c) for c in set(want.values()))
    assert "rest" not in made and all(x.count() < len(texts) for x in made["forest"]) and made["forest"][0].count() > 0


@pytest.mark.parametrize("tile", [near_copies.TILE, 3000])
def test_sets_without_partner_are_not_sent(spark, monkeypatch, tile):
    """Texts of common lines share frequent shingles and little more: only those that fingerprints hold near are sent."""
    r = random.Random(27)
    lines = [words(r, 40) for _ in range(36)]
    texts = [" ".join(r.sample(lines, 6)) for _ in range(120)]
    texts += [t + " and own words" for t in texts[:6]]
    made = {}
    kept = near_copies.stored

    def spied(df, label="t"):
        made.setdefault(label, []).append(kept(df, label))
        return made[label][-1]

    monkeypatch.setattr(near_copies, "stored", spied)
    monkeypatch.setattr(near_copies, "discard", lambda df: None)
    _, of = near_copies.near_copy_groups(frame(spark, texts).selectExpr("doc_id as key", "unhex(md5(text)) as t", "text"), chained=8, tile=tile)
    assert len({x.group for x in of.collect()}) == len(set(plain_groups(dict(enumerate(texts))).values())) == 120
    assert made["many"][-1].select("d").distinct().count() > 100 and made["sets"][-1].count() < 60


def test_partners_are_those_of_all_pairs():
    import numpy as np

    r = random.Random(28)
    texts = family(60) + [t[: len(t) // k] for t in family(20) for k in (1, 2, 9)] + [words(r, 150 + k) for k in range(10)]
    sets = [near_copies.shingles(t) for t in texts]
    n = np.array([len(s) for s in sets])
    prints = np.stack([near_copies.wide_print(s).view(np.uint64) for s in sets])
    g = np.arange(len(sets)) // 2
    bits = lambda u, v: int(np.bitwise_count(prints[u] ^ prints[v]).sum())
    near = lambda u, v: g[u] != g[v] and 100 * min(n[u], n[v]) >= 80 * max(n[u], n[v]) and (min(n[u], n[v]) < near_copies.SURE or bits(u, v) <= near_copies.FAR)
    for tile in (np.zeros(len(sets), int), np.arange(len(sets)) % 3 % 2):
        across = len(set(tile)) > 1
        want = [any(near(u, v) and (tile[u] != tile[v] or not across) for v in range(len(sets)) if v != u) for u in range(len(sets))]
        assert near_copies.with_partners(n, g, tile, prints, 80).tolist() == want and 20 < sum(want) < len(want)


def test_wide_prints_never_part_similar_sets():
    r = random.Random(24)
    most = 0
    for _ in range(400):
        base = words(r, r.randint(70, 400)).split()
        t = list(base)
        while len(near_copies.shingles(" ".join(t))) and jaccard(base, t) >= 0.8:
            kept, k = list(t), r.randrange(len(t))
            t[k] = "edited" + str(r.random())
        a, b = (near_copies.wide_print(near_copies.shingles(" ".join(x))).view("u8") for x in (base, kept))
        most = max(most, sum(int(x ^ y).bit_count() for x, y in zip(a, b)))
    assert most <= near_copies.FAR - 6


def jaccard(a, b):
    a, b = plain_set(" ".join(a)), plain_set(" ".join(b))
    return len(a & b) / len(a | b)


def test_segment_tables_find_close_fingerprints(spark):
    r = random.Random(25)
    prints = {}
    for _ in range(6):
        base = words(r, 900).split()
        for n in range(12):
            t = list(base)
            for k in r.sample(range(len(t)), n):
                t[k] = "edited"
            sh = near_copies.shingles(" ".join(t))
            prints[len(prints)] = near_copies.wide_print(sh).tolist()
    uniq = spark.createDataFrame([(d, *f) for d, f in prints.items()], ", ".join(["d long", *(f"{f} long" for f in near_copies.PRINTS)]))
    found = {(x.u, x.v) for x in near_copies.by_fingerprints(uniq).collect()}
    bits = lambda x, y: int((x ^ y) & (1 << 64) - 1).bit_count()
    want = set()
    for k in range(near_copies.WIDE):
        first = {}
        for d in sorted(prints):
            first.setdefault(prints[d][k], d)
        want |= {(first[p], first[q]) for p in first for q in first if first[p] < first[q] and bits(p, q) <= 2}
        want |= {(first[f[k]], d) for d, f in prints.items() if first[f[k]] != d}
    near = {(a, b) for a in prints for b in prints if a < b and sum(map(bits, prints[a], prints[b])) <= 11}
    assert found == want and len(near & want) > 10
    assert near_copies.by_fingerprints(uniq.limit(0)).count() == 0


def test_pipeline_leaves_no_near_copies(spark, sf):
    cur = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in p.STAGES[:3]:
        cur = stage(spark, cur, sf).cache()
    texts = {r.doc_id: r.text for r in cur.collect()}
    assert len(texts) == len(set(plain_groups(texts).values())) > 100


def test_ids_and_rows(spark):
    df = frame(spark, ["a b c d e f", "a b c d e f", "x"], ids=[None, 4, 5])
    out = simhash.drop_near_copies(df.unionByName(df))
    assert out.columns == df.columns and sorted(r.doc_id or -1 for r in out.collect()) == [-1, -1, 4, 5]
    assert simhash.drop_near_copies(df.limit(0)).count() == 0


def test_other_texts_under_one_id_stay(spark):
    df = frame(spark, ["one text of its own", "another text of its own", "One text  of its own", "third"], ids=[7, 7, 8, 7])
    assert sorted((r.doc_id, r.text) for r in simhash.drop_near_copies(df).collect()) == [(7, "another text of its own"), (7, "one text of its own"), (7, "third")]
