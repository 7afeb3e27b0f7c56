"""Near copies at a stated similarity of word shingles: how the SimHash stage completes its links.

Each shingle set has a SimHash fingerprint of four words of 64 bits. Each word enters the segment tables
of :mod:`quern.llm.multi_index`: the balls of its segments are enumerated, the tables' matches are
fetched, and the distance of the complete fingerprints is verified. So the tables find sets that are
within 11 of 256 bits, and others that are that close in one word only.

Sets that share 0.8 of their shingles differ in 39 bits of 256 on average (up to 18 of 64); balls that wide
cannot be enumerated. What the tables do not reach is found by an index over shingles. In one order of all
shingles (those frequent in a sample last, else by hash) two texts whose Jaccard similarity
reaches the threshold share one of the first ``n - ceil(threshold * n) + 1`` shingles of each, so the
texts that hold a shingle among their first are candidates too, and none is missed. The fingerprints
discard candidates that are far apart, and complete shingle sets decide the rest.

Where many texts hold one shingle, they are first held against one of them. What these links leave apart is
compared in tiles, twice: first a task gets the sizes and fingerprints of two tiles' sets and returns those
that have a partner of another group. Then a task gets the complete sets of two tiles of these, looks at the
pairs whose groups differ, skips those that a link found before has joined, and returns a spanning forest of
its links, never pairs.

Defined results: white space and letter case of ASCII do not count. A text of fewer words than a
shingle is one shingle; texts without words equal each other. A group is what links reach. An empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import components, map_rows
from quern.llm.multi_index import DISTANCE, SEGMENTS, close_pairs
from quern.session import discard, release, stored

WORDS = 5
#: Least similarity of near copies, in per cent.
PERCENT = 80
#: Buckets of more texts than this are held against one of their texts before their pairs are listed.
CHAINED = 32
#: About so many texts are sampled for frequent shingles: those in over one of SHARE of them.
SAMPLE = 20_000
SHARE = 1000
MULTIPLIER = 0x9E3779B97F4A7C15
#: Words of 64 bits in a wide fingerprint.
WIDE = 4
#: Sets of fewer shingles are not judged by fingerprints.
SURE = 64
#: Wide fingerprints of sets at 0.8 differ in 39 bits of 256 on average, with a deviation of 6: more than this is six deviations off.
FAR = 75
PRINTS = [f"f{k}" for k in range(WIDE)]
#: Shingles in a tile, about: sets are dealt by hash. A tile is sent once for each tile of its block.
#: Where only fingerprints are sent, a set counts as ``SURE`` of them.
TILE = 1 << 19
#: Shingles that a task gathers at once.
STEP = 1 << 18
#: Candidates that hang together are compared in tiles if those hold at most so many pairs for each candidate.
DENSE = 1000


def shingles(text: str | None, words: int = WORDS):
    """Sorted distinct 64-bit hashes of a text's shingles."""
    import numpy as np
    import xxhash

    w = (text or "").encode().lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, w), dtype=np.uint64, count=len(w))
    k = min(words, len(w))
    out = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        out = out * np.uint64(MULTIPLIER) + h[i : len(w) - k + 1 + i]
        out ^= out >> np.uint64(29)
    return np.unique(out)


def wide_print(sh):
    """``WIDE`` words of a set's SimHash: a bit is set if set in over half of the hashes."""
    import numpy as np

    counts = np.zeros(64 * WIDE, dtype=np.int64)
    for at in range(0, len(sh), 4096):
        rows = np.empty((len(sh[at : at + 4096]), WIDE), np.uint64)
        for k in range(WIDE):
            h = sh[at : at + 4096] + np.uint64((k + 1) * MULTIPLIER & (1 << 64) - 1)
            h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
            rows[:, k] = h ^ h >> np.uint64(31)
        counts += np.unpackbits(rows.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(2 * counts > len(sh), bitorder="little").view(np.int64)


def first_shingles(sh, hot, percent: int = PERCENT):
    """The shingles of a set by which it is indexed; ``hot`` ones (sorted) come last in the order."""
    import numpy as np

    n = len(sh)
    take = n - -(-percent * n // 100) + 1 if n else 0
    if len(hot) and take < n:
        is_hot = np.isin(sh, hot, assume_unique=True)
        sh = np.concatenate((sh[~is_hot], sh[is_hot]))
    return sh[:take]


def _index(words: int, percent: int, hot):
    def make():
        import numpy as np
        import xxhash

        def row(key, t, text):
            sh = shingles(text, words)
            d = np.uint64(xxhash.xxh64_intdigest(sh.tobytes())).astype(np.int64)
            return [(key, t, int(d), len(sh), *wide_print(sh).tolist(), first_shingles(sh, hot, percent).view(np.int64).tolist())]

        return row

    return make


def _sets(words: int):
    def make():
        import numpy as np

        return lambda d, text: [(d, shingles(text, words).view(np.int64).tolist())]

    return make


def frequent(texts: DataFrame, words: int = WORDS):
    """Sorted hashes of the shingles in over one of ``SHARE`` sampled texts (three at least): they order the index, nothing is left out."""
    import numpy as np

    n = texts.count()
    part = texts.where(F.pmod(F.xxhash64("key"), F.lit(max(1, n // SAMPLE))) == 0)
    sets = map_rows(part.select(F.lit(0).cast("long").alias("d"), "text"), "d long, sh array<long>", _sets(words))
    often = sets.select(F.explode("sh").alias("s")).groupBy("s").count().where(F.col("count") > max(2, min(n, SAMPLE) // SHARE))
    return np.sort(np.array([r.s for r in often.collect()], dtype=np.int64).view(np.uint64))


def possible(n, m, a: str, b: str, percent: int):
    """Whether sets of sizes ``n`` and ``m`` with wide fingerprints in structs ``a`` and ``b`` can be as similar as asked."""
    apart = sum((F.bit_count(F.col(f"{a}.{f}").bitwiseXOR(F.col(f"{b}.{f}"))) for f in PRINTS), F.lit(0))
    far = F.lit(percent >= PERCENT) & (F.least(n, m) >= SURE) & (apart > FAR)
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ~far


def by_fingerprints(uniq: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS) -> DataFrame:
    """(u, v): sets of ``uniq(d, *PRINTS)`` with a word of their fingerprints ``distance`` bits apart or fewer, from the words' segment tables.

    Where several sets hold one value of a word, the least stands for them and is paired with each.
    """
    out = None
    for f in PRINTS:
        word = stored(uniq.groupBy(F.col(f).alias("fp")).agg(F.min("d").alias("first")), "word")
        end = lambda fp, d: word.select(F.col("fp").alias(fp), F.col("first").alias(d))  # noqa: B023, E731
        met = close_pairs(word.select("fp"), distance, segments).withColumnsRenamed({"u": "p", "v": "q"}).join(end("p", "u"), "p").join(end("q", "v"), "q")
        same = uniq.select(F.col("d").alias("v"), F.col(f).alias("p")).join(end("p", "u"), "p").where("u <> v")
        part = stored(met.select("u", "v").unionByName(same.select("u", "v")).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "met")
        discard(word)
        release(uniq.sparkSession)
        out = part if out is None else out.unionByName(part)
    return out


def sets_of(wanted: DataFrame, texts: DataFrame, uniq: DataFrame, words: int) -> DataFrame:
    """(d, sh): the complete sets of ``wanted(d)``, made from one text each."""
    wanted = stored(uniq.join(wanted.distinct(), "d").select(F.col("least.key").alias("k"), F.col("least.t").alias("t2"), "d"), "ends")
    held = texts.join(wanted.hint("merge"), (F.col("key") == F.col("k")) & (F.col("t") == F.col("t2"))).dropDuplicates(["d"]).select("d", "text")
    sets = stored(map_rows(held, "d long, sh array<long>", _sets(words)), "sets")
    discard(wanted)
    release(sets.sparkSession)
    return sets


def similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of ``pairs(u, v)`` of sets those as similar as asked, by their complete ``sets(d, sh)``."""
    both = pairs.join(sets.select(F.col("d").alias("u"), F.col("sh").alias("a")), "u").join(sets.select(F.col("d").alias("v"), F.col("sh").alias("b")), "v")
    shared = F.size(F.array_intersect("a", "b"))
    return stored(both.where(100 * shared >= percent * (F.size("a") + F.size("b") - shared)).select("u", "v"), "links")


def partners(u: int, n, root, tile, prints, percent: int):
    """Of sets by size ``n``, the places after ``u`` that can be as similar as asked and are of another group ``root``.

    Of two tiles only pairs across are looked at, of one all.
    """
    import numpy as np

    v = np.arange(u + 1, np.searchsorted(n, 100 * n[u] // percent, side="right"))
    v = v[root[v] != root[u]]
    if tile is not None:
        v = v[tile[v] != tile[u]]
    if percent >= PERCENT and n[u] >= SURE:
        v = v[np.bitwise_count(prints[v] ^ prints[u]).sum(1) <= FAR]
    return v


def with_partners(n, g, tile, prints, percent: int):
    """Whether each of the sets has a partner of another group, by sizes and fingerprints."""
    import numpy as np

    order = np.argsort(n, kind="stable")
    n, g, prints = n[order], g[order], prints[order]
    tile = tile[order] if (tile != tile[0]).any() else None
    found = np.zeros(len(n), bool)
    for u in range(len(n)):
        v = partners(u, n, g, tile, prints, percent)
        found[v] = True
        found[u] |= len(v) > 0
    out = np.empty(len(n), bool)
    out[order] = found
    return out


def forest(d, g, tile, prints, sets, percent: int, step: int = STEP) -> list[tuple[int, int]]:
    """Links as similar as asked that join groups ``g`` of the sets ``d``: a spanning forest of them.

    Sets are held against larger ones, so that sizes bound the partners.
    """
    import numpy as np

    n = np.array([len(x) for x in sets])
    order = np.argsort(n, kind="stable")
    n, d, tile, prints = n[order], d[order], tile[order], prints[order]
    root = np.unique(g[order], return_inverse=True)[1]
    flat = np.unique(np.concatenate([sets[k] for k in order]), return_inverse=True)[1]
    start = np.cumsum(n) - n
    held = np.zeros(len(flat), bool)
    tile = tile if (tile != tile[0]).any() else None
    out = []
    for u in range(len(d)):
        v = partners(u, n, root, tile, prints, percent)
        own = flat[start[u] : start[u] + n[u]]
        held[own] = True
        while len(v):
            most = max(1, step // int(n[v[-1]]))
            now, v = v[:most], v[most:]
            ends = np.cumsum(n[now])
            at = np.arange(ends[-1]) + np.repeat(start[now] - ends + n[now], n[now])
            shared = np.add.reduceat(held[flat[at]], ends - n[now], dtype=np.int64)
            for w in now[100 * shared >= percent * (n[u] + n[now] - shared)]:
                if root[w] != root[u]:
                    out.append((int(d[u]), int(d[w])))
                    root[root == root[w]] = root[u]
            v = v[root[v] != root[u]]
        held[own] = False
    return out


def _prints(part):
    import numpy as np

    return np.ascontiguousarray(part[PRINTS].to_numpy(np.int64)).view(np.uint64)


def _with_partners(columns: list[str], percent: int):
    def run(part):
        import numpy as np

        return part.loc[with_partners(part["n"].to_numpy(np.int64), part["g"].to_numpy(), part["tile"].to_numpy(), _prints(part), percent), columns]

    return run


def _tile_pair(percent: int):
    def run(part):
        import pandas as pd

        links = forest(*(part[c].to_numpy() for c in ("d", "g", "tile")), _prints(part), list(part["sh"]), percent)
        return pd.DataFrame(links, columns=["u", "v"], dtype="int64")

    return run


def joined(many: DataFrame, texts: DataFrame, uniq: DataFrame, words: int, percent: int, tile: int = TILE) -> DataFrame:
    """(u, v): links that join groups, of all sets in ``many(s, d, g)`` that share ``s`` and are of different groups ``g``.

    A block is what buckets that share sets make up, or a single bucket where that is fewer pairs.
    """
    low = many.groupBy("s").agg(F.min("d").alias("u"))
    chain = stored(components(many.join(low, "s").select("u", F.col("d").alias("v")), "chaincc"), "chain")
    many = stored(many.join(chain, F.col("d") == F.col("node")).select("s", "d", "g", F.col("component").alias("c")), "chained")
    buckets = many.groupBy("c", "s").agg(F.count(F.lit(1)).cast("double").alias("k")).groupBy("c").agg(F.sum(F.col("k") * F.col("k")).alias("apart"))
    whole = many.select("c", "d").distinct().groupBy("c").agg(F.count(F.lit(1)).cast("double").alias("k")).join(buckets, "c")
    whole = whole.select("c", (F.col("k") * F.col("k") <= F.col("apart")).alias("whole"))
    block = F.when(F.col("whole"), F.lit(0).cast("long")).otherwise(F.col("s")).alias("b")
    blocks = sized(many.join(whole, "c").select("c", block, "d", "g").distinct(), uniq)
    left = tiled(blocks, F.count(F.lit(1)), max(1, tile // SURE)).groupBy("c", "b", "lo", "hi").applyInPandas(_with_partners(blocks.columns, percent), blocks.schema)
    left = stored(left.dropDuplicates(["c", "b", "d"]), "left")
    for old in (chain, many, blocks):
        discard(old)
    release(left.sparkSession)
    sets = sets_of(left.select("d"), texts, uniq, words)
    links = compared(left, sets, percent, tile)
    for old in (left, sets):
        discard(old)
    return links


def sized(blocks: DataFrame, uniq: DataFrame) -> DataFrame:
    """``blocks(c, b, d, g)`` with sizes and fingerprints of the sets ``d``; without the empty set, which nothing equals."""
    return stored(blocks.join(uniq.select("d", "n", *PRINTS), "d").where("n > 0"), "dealt")


def tiled(blocks: DataFrame, size, tile: int) -> DataFrame:
    """``blocks(c, b, d, ...)`` dealt to tiles of about ``tile`` of the aggregate ``size``: a row for each pair of tiles (lo, hi) that a set's is in."""
    tiles = blocks.groupBy("c", "b").agg(F.ceil(size / tile).alias("tiles"))
    rows = blocks.join(tiles, ["c", "b"]).withColumn("tile", F.pmod(F.xxhash64("d"), F.col("tiles")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    return rows.withColumns({"lo": F.least("tile", "other"), "hi": F.greatest("tile", "other")}).drop("other", "tiles")


def compared(blocks: DataFrame, sets: DataFrame, percent: int, tile: int) -> DataFrame:
    """(u, v): links that join groups ``g`` of the sets ``d`` within each block (c, b) of :func:`sized` ``blocks``."""
    rows = tiled(blocks, F.sum("n"), tile).drop("n").join(sets, "d")
    return stored(rows.groupBy("c", "b", "lo", "hi").applyInPandas(_tile_pair(percent), "u long, v long"), "forest")


def decided(known: DataFrame, texts: DataFrame, uniq: DataFrame, words: int, percent: int, tile: int) -> DataFrame:
    """(u, v): links that reach what those of the candidates ``known(u, v, sure)`` reach; more pairs may have been looked at.

    Sets that candidates hold together are sent once a tile. Each candidate is joined only where they hang
    together loosely: small sets, which fingerprints do not tell apart, chain through common lines.
    """
    chain = stored(components(known.where("sure"), "candcc"), "chain")
    of = known.where("sure").join(chain, F.col("u") == F.col("node")).select("u", "v", F.col("component").alias("c"))
    pairs = of.groupBy("c").agg(F.count(F.lit(1)).cast("double").alias("pairs"))
    sizes = chain.groupBy(F.col("component").alias("c")).agg(F.count(F.lit(1)).cast("double").alias("k")).join(pairs, "c")
    dense = stored(sizes.select("c", (F.col("k") * F.col("k") <= DENSE * F.col("pairs")).alias("dense")), "dense")
    blocks = chain.select(F.col("component").alias("c"), F.col("node").alias("d")).join(dense.where("dense"), "c")
    blocks = sized(blocks.select("c", F.lit(0).cast("long").alias("b"), "d", F.col("d").alias("g")), uniq)
    loose = of.join(dense.where("not dense"), "c", "left_semi").select("u", "v").unionByName(known.where("not sure").select("u", "v"))
    loose = stored(loose, "loose")
    wanted = blocks.select("d").unionByName(loose.select(F.col("u").alias("d"))).unionByName(loose.select(F.col("v").alias("d")))
    sets = sets_of(wanted, texts, uniq, words)
    links = compared(blocks, sets, percent, tile).unionByName(similar(loose, sets, percent))
    for old in (chain, blocks, loose, sets):
        discard(old)
    return links


def near_copy_groups(
    texts: DataFrame, words: int = WORDS, percent: int = PERCENT, chained: int = CHAINED, tile: int = TILE,
) -> tuple[DataFrame, DataFrame]:
    """Of ``texts(key, t, text)`` (t: digest of the text): (key, t, d) of each row, and (d, group, least) of each shingle set.

    ``group`` is the least set that links reach, ``least`` the least (key, t) that holds the set.
    """
    kind = texts.schema["key"].dataType.simpleString()
    prints = ", ".join(f"{f} long" for f in PRINTS)
    index = stored(map_rows(texts, f"key {kind}, t binary, d long, n int, {prints}, s array<long>", _index(words, percent, frequent(texts, words))), "index")
    some = [F.any_value(c).alias(c) for c in ("n", *PRINTS, "s")]
    uniq = stored(index.groupBy("d").agg(F.min(F.struct("key", "t")).alias("least"), *some), "uniq")
    rows = stored(index.select("key", "t", "d"), "rows")
    discard(index)
    release(rows.sparkSession)
    first = uniq.select(F.explode("s").alias("s"), "d")
    sizes = stored(first.groupBy("s").agg(F.count(F.lit(1)).alias("size"), F.min("d").alias("hub")).where("size > 1"), "shared")
    release(sizes.sparkSession)
    held = stored(first.join(sizes, "s").select("s", "d", "size", "hub"), "held")
    discard(sizes)
    release(held.sparkSession)
    prints_of = lambda name, key: uniq.select(F.col("d").alias(key), F.struct("n", *PRINTS).alias(name))

    def checked(pairs: DataFrame) -> DataFrame:
        """Distinct (u, v, sure) of ``pairs`` that can be similar; ``sure`` if fingerprints had a say."""
        out = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
        out = out.join(prints_of("a", "u"), "u").join(prints_of("b", "v"), "v")
        return out.where(possible(F.col("a.n"), F.col("b.n"), "a", "b", percent)).select("u", "v", (F.least("a.n", "b.n") >= SURE).alias("sure"))

    few = held.where(F.col("size") <= chained).select("s", "d")
    pairs = few.select("s", F.col("d").alias("u")).join(few.select("s", F.col("d").alias("v")), "s").where("u < v").select("u", "v")
    stars = held.where((F.col("size") > chained) & (F.col("d") != F.col("hub"))).select(F.col("hub").alias("u"), F.col("d").alias("v"))
    known = stored(checked(by_fingerprints(uniq).unionByName(pairs).unionByName(stars)), "known")
    release(known.sparkSession)
    links = decided(known, texts, uniq, words, percent, tile)
    groups = stored(components(links, "nearcc"), "groups")
    many = held.where(F.col("size") > chained).select("s", "d").join(groups, F.col("d") == F.col("node"), "left").select("s", "d", F.coalesce("component", "d").alias("g"))
    apart = many.groupBy("s").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo <> hi").select("s")
    many = stored(many.join(apart, "s", "left_semi"), "many")
    if not many.isEmpty():
        release(many.sparkSession)
        links = links.unionByName(joined(many, texts, uniq, words, percent, tile))
        groups = stored(components(links, "nearcc"), "groups")
    out = uniq.join(groups, F.col("d") == F.col("node"), "left").select("d", F.coalesce("component", "d").alias("group"), "least")
    out = stored(out, "of")
    for old in (uniq, held, known, many):
        discard(old)
    return rows, out


def representatives(texts: DataFrame, words: int = WORDS, percent: int = PERCENT, chained: int = CHAINED) -> DataFrame:
    """(key, t): of each group of near copies in ``texts(key, t, text)`` the least row."""
    _, of = near_copy_groups(texts, words, percent, chained)
    return stored(of.groupBy("group").agg(F.min("least").alias("one")).select("one.key", "one.t"), "keep")
