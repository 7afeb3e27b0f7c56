"""Operators over the whole corpus (1 to 6, 10) and the pipeline, against brute force."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from quern.llm import common, embedding_dedup, line_dedup, mixing, packing, simhash, suffix_dedup, url_filter

DOCS = "doc_id long, text string, source string, lang string, n_chars long, key int, h string, id int"


def frame(spark, texts, sources=None, ids=None):
    rows = [((ids or range(len(texts)))[i], t, sources[i] if sources else "s", None, None, 5, "clash", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def closure(nodes, links):
    comp = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(comp[a], comp[b])
            if comp[a] != m or comp[b] != m:
                comp[a] = comp[b] = m
                changed = True
    return comp


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(1, 50)]
    got = {x.node: x.component for x in common.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    edges = [(a, b) for a, b in edges if a != b]
    assert got == closure({x for e in edges for x in e}, edges)
    assert common.components(spark.createDataFrame([], "u long, v long")).count() == 0


def words(r, n):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


def corpus(seed=6):
    r = random.Random(seed)
    texts = []
    for i in range(40):
        texts.append("\n".join(words(r, r.randint(3, 30)) for _ in range(r.randint(1, 9))))
    passage = "\n".join(words(r, 14) for _ in range(8))
    for i in range(8):
        texts.append(words(r, 20) + "\n" + passage + "\n" + words(r, 12))
    for i in range(6):
        t = texts[i].split(" ")
        t[len(t) // 2] = "edited"
        texts.append(" ".join(t))
    texts += [texts[3]] * 3 + [None, "", "a", "é" * 70 + "x" * 150, "z" * 400, "z" * 250, "é" * 70 + "x" * 150]
    return texts


def plain_fingerprint(text):
    import xxhash

    w = (text or "").encode().lower().split()
    if not w:
        return 0
    sh = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash(spark):
    texts = corpus() + ["one two three four five six seven eight nine ten"] * 2
    out = {x.doc_id: x for x in simhash.simhash(frame(spark, texts)).collect()}
    fps = {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    links = [(a, b) for a in fps for b in fps if a < b and bin(fps[a] ^ fps[b]).count("1") <= 2]
    comp = closure(fps, links)
    assert {i: (x.fingerprint, x.component_id) for i, x in out.items()} == {i: (f"{f:016x}", comp[i]) for i, f in fps.items()}


@pytest.mark.parametrize(("segments", "distance", "hot"), [(1, 2, 256), (2, 2, 256), (2, 2, 3), (3, 4, 3), (8, 2, 256)])
def test_simhash_links_are_complete(spark, segments, distance, hot):
    r = random.Random(7)
    base = [r.getrandbits(64) for _ in range(20)]
    fps = sorted({b ^ sum(1 << k for k in r.sample(range(64), d)) for b in base for d in (0, 1, 2, 3, 4) for _ in range(4)} | {base[0] ^ 1 << k for k in range(64)})
    table = spark.createDataFrame([(simhash.signed(f),) for f in fps], "fp long")
    found = {(x.u, x.v) for x in simhash.close_pairs(table, distance, segments, hot).collect()}
    signed = [simhash.signed(f) for f in fps]
    want = {tuple(sorted((signed[i], signed[j]))) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= distance}
    assert found == want


@pytest.mark.parametrize("segments", [1, 2, 3, 5, 7, 64])
def test_segments_hold_every_bit(segments):
    masks = simhash.segment_masks(segments)
    assert sum(masks) == (1 << 64) - 1 and len(masks) == segments
    for bad in (0, 65):
        with pytest.raises(ValueError):
            simhash.segment_masks(bad)


def brute_removed(texts, length=100):
    first, out = {}, []
    for t in texts:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            x = b[s : s + length]
            if x in first:
                gone[s : s + length] = True
            else:
                first[x] = 1
        out.append((b, gone))
    return out


def plain_spans(gone):
    edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
    return len(edges) // 2


@pytest.mark.parametrize("hot", [2000, 1])
def test_suffix_dedup(spark, hot):
    texts = corpus()
    out = {x.doc_id: x for x in suffix_dedup.suffix_dedup(frame(spark, texts), hot=hot).collect()}
    for i, (b, gone) in enumerate(brute_removed(texts)):
        want = (len(b), int(gone.sum()), plain_spans(gone), hashlib.sha256(b[:0] + bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest())
        x = out[i]
        assert (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) == want, i


def test_suffix_dedup_with_other_texts_under_one_id(spark):
    r = random.Random(19)
    shared = words(r, 60)
    texts = [words(r, 40) + shared, words(r, 50), words(r, 30) + shared, shared + words(r, 20), None, shared]
    ids = [7, 7, 3, -5, 7, None]
    df = frame(spark, texts, ids=ids)
    out = suffix_dedup.suffix_dedup(df.unionByName(df.where("doc_id = 7")))
    order = sorted((i for i in range(5)), key=lambda i: (ids[i], hashlib.sha256((texts[i] or "").encode()).hexdigest()))
    want = sorted((ids[i], len(b), int(g.sum())) for i, (b, g) in zip(order, brute_removed([texts[i] for i in order])))
    got = sorted((x.doc_id, x.n_bytes, x.n_removed) for x in out.collect() if x.doc_id is not None)
    assert got == sorted(want + [w for w in want if w[0] == 7]) and sum(w[2] for w in want) > 400


def test_suffix_dedup_on_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    out = {x.doc_id: x for x in suffix_dedup.suffix_dedup(docs).collect()}
    for r, (b, gone) in zip(rows, brute_removed([r.text for r in rows])):
        x = out[r.doc_id]
        assert (x.n_removed, x.n_spans, x.kept_sha256) == (int(gone.sum()), plain_spans(gone), hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest())


def test_merged_transform_sorts_suffixes():
    r = random.Random(8)
    strings = ["".join(r.choice("ab") for _ in range(r.randint(5, 40))).encode() for _ in range(30)]
    table = np.zeros(256, np.uint8)
    table[[97, 98]] = 1, 2
    made = [suffix_dedup.transform(strings[k::3], table) for k in range(3)]
    inter, lcp = suffix_dedup.merged([m[0] for m in made], 12, 3)
    rows = [None] * len(inter)
    for k, (_, sa, ends) in enumerate(made):
        own = strings[k::3]
        which = np.searchsorted(ends, sa)
        start = np.concatenate(([0], ends[:-1] + 1))
        for at, s, w in zip(np.flatnonzero(inter == k), sa, which):
            rows[at] = own[w][s - start[w] :]
    assert all(a[:12] <= b[:12] for a, b in zip(rows, rows[1:]))
    for a, b, n in zip(rows, rows[1:], lcp[1:]):
        common_ = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert n == min(common_, 12) // 2 * 2


def test_line_dedup(spark):
    texts = corpus()
    out = {x.doc_id: x for x in line_dedup.line_dedup(frame(spark, texts)).collect()}
    seen, total = set(), 0
    for i, t in enumerate(texts):
        gone = set()
        for c, s in line_dedup.multi_line(t):
            if s in seen:
                gone.add(c)
            seen.add(s)
        total += len(gone)
        assert out[i].text == (t if t is None or not gone else line_dedup.without(t, gone)) and out[i].n_removed_chunks == len(gone)
    assert total > 10 and line_dedup.line_dedup(frame(spark, texts).limit(0)).count() == 0


def test_line_chunks_resist_shifts():
    r = random.Random(9)
    lines = [words(r, 5) for _ in range(300)]
    a = {s for _, s in line_dedup.multi_line("\n".join(lines))}
    b = {s for _, s in line_dedup.multi_line("\n".join(["new line", *lines[:150], "another", *lines[150:]]))}
    assert len(a & b) >= len(a) - 4
    t = "\n".join(lines)
    assert line_dedup.without(t, set()) == t


def test_packing_is_tight():
    r = random.Random(10)
    for _ in range(20):
        lengths = [r.choice((r.randint(1, 2048), r.randint(1, 300), r.randint(600, 1100))) for _ in range(1500)]
        held, ends = defaultdict(int), defaultdict(list)
        for n, (b, at) in zip(lengths, packing.pack(lengths)):
            held[b] += n
            ends[b].append((at, at + n))
        assert max(held.values()) <= 2048
        for spans in ends.values():
            spans.sort()
            assert spans[0][0] == 0 and all(x[1] == y[0] for x, y in zip(spans, spans[1:]))
        assert len(held) <= 1.04 * math.ceil(sum(lengths) / 2048) + 1
    assert packing.pack([]) == [] and packing.pack([2048, 1]) == [(0, 0), (1, 0)]


def test_encoder_gives_the_tokenizers_ids(spark, sf):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok, encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.encoder()
    r = random.Random(15)
    texts = [x.text for x in spark.read.parquet(f"{sf}/documents.parquet").collect()] + ["", "a" * 5000, " " * 3000, "a<|endoftext|>", "漢字 \u0661 𝒳 e\u0301"]
    latin = [chr(c) for c in range(0x250)]
    texts += latin + [a + c + b for c in latin for a, b in ((" ", "x"), ("1", " "), ("\n", "."))]
    texts += ["".join(r.choice(latin) for _ in range(40)) for _ in range(2000)]
    for t in texts:
        assert encode(t) == tok.encode(t, add_special_tokens=False).ids, t


def test_packing_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    r = random.Random(11)
    texts = [None, "", "a<|endoftext|>b", words(r, 4000), "é" * 9000, *(words(r, r.randint(1, 400)) for _ in range(40)), "same", "same"]
    out = packing.best_fit_packing(frame(spark, texts)).collect()
    by, seq = defaultdict(list), defaultdict(list)
    for x in out:
        by[x.doc_id].append(x)
        seq[x.sequence_id].append((x.offset, x.length))
    for i, t in enumerate(texts):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        at = 0
        for k, x in enumerate(sorted(by[i], key=lambda x: x.piece)):
            assert (x.piece, x.start) == (k, at) and x.ids_crc32 == zlib.crc32(np.array(ids[at : at + x.length], "<u4").tobytes())
            assert x.length == 2048 or k == 0
            at += x.length
        assert at == len(ids)
    for spans in seq.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and sum(n for _, n in spans) <= 2048


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: (i % 3) + 1 for i, s in enumerate(names)}
    fixed, total = set(), sum(sizes.values())
    while True:
        rest = [s for s in names if s not in fixed]
        level = (total - sum(3 * sizes[s] for s in fixed)) / max(1e-12, sum(w[s] for s in rest))
        over = {s for s in rest if w[s] * level > 3 * sizes[s]}
        if not over:
            return {s: 3 * sizes[s] if s in fixed else w[s] * level for s in names}
        fixed |= over


def test_mixing(spark):
    r = random.Random(12)
    sources = [r.choice(["a", "b", "é", "Z", None, "tiny"][: 5 if i % 40 else 6]) if i % 3 else "hot" for i in range(1500)]
    texts = [None if i % 97 == 0 else words(r, r.randint(0, 200)) for i in range(1500)]
    out = mixing.mix(frame(spark, texts, sources)).collect()
    again = mixing.mix(frame(spark, texts, sources).repartition(7)).collect()
    key = lambda rows: sorted((x.doc_id, x.taken) for x in rows)
    assert key(out) == key(again) and len(out) == 1500
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for x in out:
        s = sources[x.doc_id]
        assert x.size == len((texts[x.doc_id] or "").split()) and x.taken in (0, x.size, 2 * x.size, 3 * x.size)
        sizes[s] += x.size
        taken[s] += x.taken
        target[s] = x.target
    want = plain_targets(sizes)
    for s in sizes:
        assert math.isclose(target[s], want[s], rel_tol=1e-9) and abs(taken[s] - want[s]) <= 200
    mixed = mixing.apply_mix(frame(spark, texts, sources))
    assert mixed.columns == frame(spark, texts).columns
    assert mixing.mix(frame(spark, texts, sources).limit(0)).count() == 0


def test_embedding_dedup(spark):
    r = np.random.default_rng(13)
    base = r.normal(size=(60, 24))
    vecs = [list(map(float, np.float32(b + r.normal(size=24) * s))) for b in base for s in (0.02, 0.08, 0.14, 0.2)]
    vecs += [vecs[5]] * 4 + [[x * 3 for x in vecs[9]]] + [[0.0] * 24, None, [], [float("nan")] * 24, [1.0] * 23, [None] * 24, [float("inf")] * 24]
    labels = [int(i % 60 // 20) for i in range(240)] + [int(5 % 60 // 20)] * 4 + [0] + [1] * 7
    labels[17] = None
    rows = [(i, v, k, "x") for i, (v, k) in enumerate(zip(vecs, labels))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, rep string")
    fine = {i for i, v in enumerate(vecs) if v and all(x is not None and math.isfinite(x) for x in v) and any(v) and labels[i] is not None}
    unit = {i: np.array(np.float32(vecs[i]), np.float64) for i in fine}
    cos = lambda a, b: unit[a] @ unit[b] / (np.linalg.norm(unit[a]) * np.linalg.norm(unit[b]))
    links = [(a, b) for a in fine for b in fine if a < b and labels[a] == labels[b] and len(unit[a]) == len(unit[b]) and cos(a, b) >= 0.98]
    comp, n = closure(range(len(vecs)), links), defaultdict(int)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    for tile in (16, 4096):
        out = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in embedding_dedup.embedding_dedup(df, tile=tile).collect()}
        assert out == {i: (n[i], comp[i], comp[i] == i) for i in range(len(vecs))}
    assert len(links) > 30 and embedding_dedup.embedding_dedup(df.limit(0)).count() == 0


def test_embedding_extremes_repeats_and_null_ids(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(0, [x * 1e300 for x in v], 1), (1, [x * 1e-300 for x in v], 1), (2, [5e-324, 1e-323, 1.5e-323], 1), (3, v, 1), (3, v, 1), (None, v, 1), (None, None, 1), (4, [1e308, -1e308, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    out = sorted((-1 if x.vec_id is None else x.vec_id, x.n_links, -1 if x.component_id is None else x.component_id, x.kept) for x in embedding_dedup.embedding_dedup(df).collect())
    assert out == [(-1, 0, -1, False)] * 2 + [(0, 4, 0, True), (1, 4, 0, False), (2, 4, 0, False), (3, 4, 0, False), (3, 4, 0, False), (4, 0, 4, True)]


def test_blocks_do_not_change_links():
    x = np.random.default_rng(18).normal(size=(70, 5))
    want = {tuple(p) for p in np.argwhere(np.triu((lambda u: u @ u.T)(x / np.linalg.norm(x, axis=1)[:, None]) >= 0.9, 1))}
    for block in (1, 7, 70, 1024):
        assert set(zip(*embedding_dedup.links(x, x, 0.9, True, block))) == want
        i, j = embedding_dedup.links(x[:30], x[30:], 0.9, False, block)
        assert set(zip(i, j + 30)) == {(a, b) for a, b in want if a < 30 <= b}


def test_quantisation_bound_holds():
    r = np.random.default_rng(14)
    x = r.normal(size=(200, 64)) * np.exp(r.normal(size=(1, 64)))
    x /= np.linalg.norm(x, axis=1)[:, None]
    q, s, e = embedding_dedup.quantised(x)
    gap = np.abs(x @ x.T - (q.astype(float) @ q.astype(float).T) * s[:, None] * s[None])
    assert (gap <= e[:, None] + e[None] + e[:, None] * e[None] + 1e-12).all()


def test_url_rules_and_parts(spark):
    urls = [
        None, "", "nourl", "http://", "HTTP://WWW.Example.com", "http://www.example.com/en/x", "http://example.com/en/x", "http://a.example.com/en/1", "https://x.net/es/1?q=/fr/",
        "http://x.net?y=/es/", "http://x.net/fr/#a", "http://notexample.com/en/", "http://xcom/", "a://b://c.com/d", "http://É.com/\n/x", "http://x.org/" + "a/" * 40, "http://x.org/" + "a" * 50_000,
    ]
    df = spark.createDataFrame([(i, u, "t") for i, u in enumerate(urls)] + [(4, urls[4], "t")], "page_id long, url string, t string")
    labels = spark.createDataFrame([(0, 1, 0), (0, None, None), (5, 0, None)], "doc_id long, quality int, toxic int")
    out = url_filter.url_filter(df, labels).collect()
    assert len(out) == len(urls) + 1
    rank = sorted(url_filter.RULES, key=lambda r: -len(r[1] + r[2]))
    for x in out:
        u = urls[x.page_id] or ""
        rest = u.split("://", 1)[1] if "://" in u else ""
        cut = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
        host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
        fit = next((r for r in rank if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])), None)
        assert (x.host, x.path, x.rule) == (host, path, fit[1] + fit[2] if fit else None)
        assert x.verdict == (fit[0] if fit else "allow")
    assert url_filter.url_filter(df.limit(0), labels.limit(0)).count() == 0


def test_url_templates(spark):
    pages, labels = [], []
    for i in range(400):
        kind = ("spam", "news", "blog", "shop")[i % 4]
        pages.append((i, f"http://h.org/{kind}/{i * 7}.html"))
        labels.append((i, 0 if kind == "spam" or i == 1 else 1, 0))
    pages += [(1000 + i, f"http://h.org/user/{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}/x") for i in range(100)]
    out = {
        x.page_id: x
        for x in url_filter.url_filter(
            spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rules=()
        ).collect()
    }
    assert {out[i].template for i in range(0, 400, 4)} == {"/spam/*.html"} and {out[i].verdict for i in range(0, 400, 4)} == {"block"}
    assert {out[i].template for i in range(400) if i % 4} == {"/*/*.html"} and {out[i].verdict for i in range(400) if i % 4} == {"allow"}
    assert {out[1000 + i].template for i in range(100)} == {"/user/*/x"}


def test_pipeline(spark, sf):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    cur, sizes = docs, []
    for _, stage in p.STAGES:
        cur = stage(spark, cur, sf).cache()
        sizes.append(cur.count())
        if stage is not p.packing:
            assert [(f.name, f.dataType) for f in cur.schema] == [(f.name, f.dataType) for f in docs.schema]
    assert docs.count() >= sizes[0] >= sizes[1] >= sizes[2] > 0
    got = {tuple(x) for x in p.run(spark, sf).select("doc_id", "piece", "length").distinct().collect()}
    assert got == {tuple(x) for x in cur.select("doc_id", "piece", "length").distinct().collect()}


def test_operators_take_null_ids(spark):
    df = frame(spark, ["a b c d e f"] * 3, ids=[None, None, 4])
    assert simhash.simhash(df).count() == 3 and mixing.mix(df).count() == 3
    assert line_dedup.line_dedup(df).count() == 3 and packing.best_fit_packing(df).count() == 3 and suffix_dedup.suffix_dedup(df).count() == 3


def test_operators_take_repeated_rows_and_long_texts(spark):
    from quern.llm import pii, quality_rules, secrets

    r = random.Random(16)
    texts = [words(r, 60_000), "\n".join(["same line of words here"] * 5000), "", None, words(r, 50), "w" * 300_000]
    df = frame(spark, texts)
    twice = df.unionByName(df)
    for f in (simhash.simhash, mixing.mix, line_dedup.line_dedup, quality_rules.quality_rules, secrets.secret_scan, pii.pii):
        rows = f(twice).collect()
        assert len(rows) == 12
        by = defaultdict(set)
        for x in rows:
            by[x.doc_id].add(str(x))
        assert all(len(v) == 1 for v in by.values()), f
    out = suffix_dedup.suffix_dedup(twice).select("doc_id", "n_removed", "kept_sha256").collect()
    assert len(out) == 12 and len(set(out)) == 6
    assert packing.best_fit_packing(twice).count() == 2 * packing.best_fit_packing(df).count()
    assert simhash.drop_near_copies(twice).count() == simhash.drop_near_copies(df).count()
    assert line_dedup.line_dedup(twice).where("doc_id = 4").select("text").distinct().count() == 1


def test_filters_take_clashing_columns(spark):
    from quern.llm import quality_rules

    F = simhash.F
    names = ["gone", "text_hash", "removed", "kept", "wanted", "size", "copies", "fp", "first", "component_id", "n_removed_chunks", "lines", "host", "u", "v", "c", "p", "n"]
    df = frame(spark, corpus()).withColumns({n: F.lit(7) for n in names})
    for f in (quality_rules.apply_quality_rules, line_dedup.line_dedup, simhash.drop_near_copies, mixing.apply_mix):
        rows = f(df).collect()
        assert rows and all(r[n] == 7 for r in rows for n in names if n != "n_removed_chunks")
    for f in (quality_rules.quality_rules, simhash.simhash, mixing.mix, packing.best_fit_packing, suffix_dedup.suffix_dedup):
        assert f(df).count() >= df.count()
