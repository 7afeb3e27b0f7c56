"""Near-duplicate vectors by int8 tile products with rigorous error bounds.

Method: unit vectors are quantised to int8 with a scale each; the norm of what quantisation lost is
kept, so that for any pair ``|cos - product| <= ex + ey + ex * ey``. Tiles of a label are multiplied
in int8 (exact in float32 up to 1040 dimensions); only pairs that the bound cannot rule out are
computed again from the vectors in double precision. A tile pair returns link counts and a spanning
forest of its links, never the links themselves.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, and
vectors with a null label or id, link with nothing and are components of their own (without an id: null, not
kept); so do vectors of other dimension. Equal vectors of a label enter the products once, with their count. Repeated rows are
vectors of their own. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import components
from quern.session import discard, stored

THRESHOLD = 0.98
#: Vectors in a tile, about: they are dealt by hash. A tile is sent once for each tile of its label.
TILE = 4096
#: Rows and columns of one product.
BLOCK = 1024


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of unit rows: int8 codes, scales, and norms of the error."""
    scale = np.abs(x).max(1) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    return q, scale, np.linalg.norm(x - q * scale[:, None], axis=1)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows in double precision, each times a power of two that brings its largest component near 1: squares neither overflow nor vanish."""
    x = x.astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])


def links(x: np.ndarray, y: np.ndarray, threshold: float, same: bool, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of rows of ``x`` and ``y`` with cosine at or above ``threshold``; i < j if they are the ``same``."""
    x, y = scaled(x), scaled(y)
    nx, ny = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    (qx, sx, ex), (qy, sy, ey) = quantised(x / nx[:, None]), quantised(y / ny[:, None])
    kind = np.float32 if x.shape[1] <= 1040 else np.float64
    found = []
    for p in range(0, len(x), block):
        for q in range(p if same else 0, len(y), block):
            a, b = slice(p, p + block), slice(q, q + block)
            most = (qx[a].astype(kind) @ qy[b].astype(kind).T).astype(np.float64) * sx[a, None] * sy[None, b]
            most += ex[a, None] + ey[None, b] + ex[a, None] * ey[None, b]
            maybe = most >= threshold - 1e-9
            i, j = np.nonzero(np.triu(maybe, 1) if same and p == q else maybe)
            for at in range(0, len(i), 1 << 16):
                u, v = i[at : at + (1 << 16)] + p, j[at : at + (1 << 16)] + q
                keep = np.einsum("ij,ij->i", x[u], y[v]) / (nx[u] * ny[v]) >= threshold
                found.append((u[keep], v[keep]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _tile_pair(threshold: float):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("tile")
        ids = [np.asarray(x, dtype=np.int64) for x in part["ids"]]
        mult = [np.asarray(x, dtype=np.int64) for x in part["mult"]]
        vecs = [np.stack([np.asarray(v) for v in x]) for x in part["vecs"]]
        same = len(ids) == 1
        i, j = links(vecs[0], vecs[-1], threshold, same)
        if same:
            node, m = ids[0], mult[0]
        else:
            node, m, j = np.concatenate(ids), np.concatenate(mult), j + len(ids[0])
        n = np.zeros(len(node), dtype=np.int64)
        np.add.at(n, i, m[j])
        np.add.at(n, j, m[i])
        root = node.copy()
        while True:  # least id over links until nothing changes
            new = root.copy()
            np.minimum.at(new, i, root[j])
            np.minimum.at(new, j, root[i])
            if (new == root).all():
                break
            root = new
        hit = n > 0
        return pd.DataFrame({"rep": node[hit], "links": n[hit], "root": root[hit]})

    return run


def embedding_dedup(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    threshold: float = THRESHOLD, tile: int = TILE,
) -> DataFrame:
    """One row a vector: id, n_links, component_id, kept. Ids must be integers."""
    v = F.col("v")
    fine = F.col("id").isNotNull() & v.isNotNull() & F.col("label").isNotNull() & F.coalesce(
        F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0), F.lit(False)
    )
    rows = stored(
        vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), F.col(label_col).alias("label")).withColumn("fine", fine), "vectors"
    )
    good = rows.where("fine")
    reps = stored(good.groupBy("label", "v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("mult")), "reps")
    sizes = reps.groupBy("label", F.size("v").alias("dim")).agg(F.ceil(F.count(F.lit(1)) / tile).alias("n_tiles"))
    dealt = reps.withColumn("dim", F.size("v")).join(stored(sizes, "tiles"), ["label", "dim"]).withColumn(
        "tile", F.pmod(F.xxhash64("rep"), F.col("n_tiles"))
    )
    # a tile holds about `tile` vectors, whatever the label's share
    packed = stored(
        dealt.groupBy("label", "dim", "tile").agg(
            F.first("n_tiles").alias("n_tiles"), F.collect_list(F.struct("rep", "mult", "v")).alias("x")
        ).select("label", "dim", "tile", "n_tiles", F.col("x.rep").alias("ids"), F.col("x.mult").alias("mult"), F.col("x.v").alias("vecs")),
        "packed",
    )
    pairs = packed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_tiles") - 1))).withColumns(
        {"a": F.least("tile", "other"), "b": F.greatest("tile", "other")}
    ).drop("other", "n_tiles")
    kind = rows.schema["id"].dataType.simpleString()
    found = stored(
        pairs.groupBy("label", "dim", "a", "b").applyInPandas(_tile_pair(threshold), f"rep {kind}, links long, root {kind}"), "links"
    )
    discard(packed)
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("rep").alias("u"), F.col("root").alias("v")), "veccc")
    of = stored(
        reps.select("label", "v", "rep", "mult").join(counts, "rep", "left").join(groups, F.col("rep") == F.col("node"), "left").select(
            F.col("label").alias("l"), F.col("v").alias("w"),
            (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).cast("long").alias("n"), F.coalesce("component", "rep").alias("c"),
        ),
        "of",
    )
    done = good.join(of, (F.col("label") == F.col("l")) & (F.col("v") == F.col("w"))).select("id", "n", "c")
    rest = rows.where("not fine").select("id", F.lit(0).cast("long").alias("n"), F.col("id").alias("c"))
    return done.unionByName(rest).select(
        F.col("id").alias(id_col), F.col("n").alias("n_links"), F.col("c").alias("component_id"), F.coalesce(F.col("id") == F.col("c"), F.lit(False)).alias("kept")
    )


def op2_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return embedding_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
