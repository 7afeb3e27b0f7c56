"""Mixing sources to target weights by entropy balancing.

Method: the document rates of a source minimise the (bounded) entropy distance from one copy each
under the constraint that its tokens reach the target; the convex dual has one multiplier a source
and gives exponentially tilted rates ``r = cap * sigmoid(logit(1/cap) + lambda * size / mean)``.
Newton iterations, safeguarded by a bracket, run distributed over the histogram (source, size,
count). Rates are rounded into copies with a uniform drawn from the document's id; the multiplier is
then refined on the rounded total, which rises with it, until it is within a document of the target.

Defined results: a null or empty text has size 0. A null source is a source of its own and comes
last. Repeated rows are documents of their own (with equal copies). A source of size 0 has target 0.
An empty table gives an empty result. Reruns agree: uniforms come from ids, and multipliers are
put on a grid before documents are rounded.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import ranked
from quern.session import discard, stored

WEIGHTS = (1.0, 2.0, 3.0)
CAP = 3
#: Newton ends when every source is within this share of its target.
TOLERANCE = 1e-11
ROUNDS = 60
#: Multipliers before rounding are multiples of this.
GRID = 1e-6
POINTS = 16
PASSES = 7


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, share: float = 1.0) -> DataFrame:
    """``sizes(sid, source_size, rank)`` with ``target``: shares by weight, capped, the excess reshared."""
    s = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")))
    total, weight = s.agg(F.sum("source_size"), F.sum("w")).first()
    total = share * (total or 0)
    level = total / weight if weight else 0.0
    while True:
        over = cap * F.col("source_size") < F.col("w") * level
        fixed, rest = s.agg(F.sum(F.when(over, cap * F.col("source_size"))), F.sum(F.when(~over, F.col("w")))).first()
        if not rest or (new := (total - (fixed or 0)) / rest) == level:
            break
        level = new
    return s.withColumn("target", F.least((cap * F.col("source_size")).cast("double"), F.col("w") * F.lit(float(level))))


def size_of(text_col: str):
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(id_col: str):
    """A document's uniform: 52 bits of a digest of its id."""
    text = F.concat(F.lit("mix"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def copies(lam, size, mean, u, cap: int = CAP):
    """Whole copies of a document: its rate under a multiplier, rounded by its uniform."""
    return F.least(F.lit(cap), F.floor(rate(lam, size / mean, cap) + u).cast("int"))


def rate(lam, x, cap: int = CAP):
    """The tilted rate: 1 at multiplier 0, below ``cap``."""
    return cap / (1 + F.exp(-(F.lit(math.log(1 / (cap - 1))) + lam * x)))


def taken_copies(m: str, size, u, cap: int = CAP):
    """Copies under a source's row ``m`` of :func:`multipliers`: those at their cap have no multiplier."""
    lam = F.col(f"{m}.lam")
    return F.when(lam.isNotNull(), copies(lam, size, F.col(f"{m}.mean"), u, cap)).when(F.col(f"{m}.target") > 0, F.lit(cap)).otherwise(F.lit(0))


def multipliers(table: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, mean, target, lam), a row a source, of stored documents ``table(source, size, u)``."""
    per = table.groupBy("source").agg(F.sum("size").alias("source_size"), F.avg("size").alias("mean"))
    sources = stored(targets(stored(ranked(per, "source").withColumnRenamed("rank", "sid").withColumn("rank", F.col("sid")), "sources"), weights, cap), "targets")
    t, s = table.alias("t"), sources.alias("s")
    rows = stored(t.join(s, F.col("t.source").eqNullSafe(F.col("s.source"))).where("size > 0").select("sid", "size", "u"), "rows")
    hist = stored(rows.groupBy("sid", "size").agg(F.count(F.lit(1)).alias("n")), "hist")
    # sources at their cap take every document cap times; those of size 0 take nothing
    open_ = sources.where((F.col("target") > 0) & (F.col("target") < cap * F.col("source_size")))
    duals = stored(open_.select("sid", "mean", "target", F.lit(0.0).alias("lam"), F.lit(-1e6).alias("lo"), F.lit(1e6).alias("hi")), "duals")
    for _ in range(ROUNDS):
        x, r = F.col("size") / F.col("mean"), rate(F.col("lam"), F.col("size") / F.col("mean"), cap)
        sums = hist.join(duals.select("sid", "mean", "lam"), "sid").groupBy("sid").agg(
            F.sum(F.col("n") * F.col("size") * r).alias("g"), F.sum(F.col("n") * F.col("size") * x * r * (1 - r / cap)).alias("h")
        )
        g = F.col("g") - F.col("target")
        lo, hi = F.when(g <= 0, F.col("lam")).otherwise(F.col("lo")), F.when(g >= 0, F.col("lam")).otherwise(F.col("hi"))
        step = F.col("lam") - F.try_divide(g, F.col("h"))
        middle = F.when(F.col("hi") >= 1e6, F.greatest(F.lit(1.0), 4 * F.col("lo"))).when(F.col("lo") <= -1e6, F.least(F.lit(-1.0), 4 * F.col("hi"))).otherwise((F.col("lo") + F.col("hi")) / 2)
        new = duals.join(sums, "sid").withColumn("lo", lo).withColumn("hi", hi).withColumn("off", F.abs(g) / F.col("target"))
        new = new.withColumn("step", step)
        ok = F.col("step").isNotNull() & ~F.isnan("step") & (F.col("step") > F.col("lo")) & (F.col("step") < F.col("hi"))
        new = stored(
            new.select("sid", "mean", "target", F.when(F.col("off") <= TOLERANCE, F.col("lam")).when(ok, F.col("step")).otherwise(middle).alias("lam"), "lo", "hi", "off"),
            "duals",
        )
        discard(duals)
        duals = new
        if (duals.agg(F.max("off")).first()[0] or 0) <= TOLERANCE:
            break
    lam = F.round(F.col("lam") / GRID) * GRID
    width = F.greatest(F.lit(4.0), F.abs(lam) * 2.0)  # wide enough for sources of a few documents, whose rounded total may be far off
    spans = stored(duals.select("sid", "mean", "target", (lam - width).alias("a"), (lam + width).alias("b")), "spans")

    points = lambda k: F.col("a") + (F.col("b") - F.col("a")) * F.lit(k / POINTS)
    taken = [F.sum(F.col("size") * copies(points(k), F.col("size"), F.col("mean"), F.col("u"), cap)).alias(f"t{k}") for k in range(POINTS + 1)]
    for _ in range(PASSES):
        sums = rows.join(spans.select("sid", "mean", "a", "b"), "sid").groupBy("sid").agg(*taken)
        joined = spans.join(sums, "sid")
        below = sum((F.when(F.col(f"t{k}") <= F.col("target"), 1).otherwise(0) for k in range(1, POINTS)), F.lit(0))
        at = lambda k: F.col("a") + (F.col("b") - F.col("a")) * k / POINTS
        ends = F.array(*(F.col(f"t{k}") for k in range(POINTS + 1)))
        new = stored(
            joined.withColumn("k", below).select(
                "sid", "mean", "target", at(F.col("k")).alias("a"), at(F.col("k") + 1).alias("b"),
                F.element_at(ends, F.col("k") + 1).alias("ta"), F.element_at(ends, F.col("k") + 2).alias("tb"),
            ),
            "spans",
        )
        discard(spans)
        spans = new
    best = F.when(F.abs(F.col("ta") - F.col("target")) <= F.abs(F.col("tb") - F.col("target")), F.col("a")).otherwise(F.col("b"))
    final = sources.join(spans.select("sid", best.alias("lam")), "sid", "left")
    final = stored(final.select("source", "source_size", "mean", "target", "lam"), "final")
    for old in (rows, hist, duals, spans):
        discard(old)
    return final


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS, cap: int = CAP,
) -> DataFrame:
    """One row a document: id, size, source_size, target, copies, taken."""
    table = stored(docs.select(F.col(id_col).alias("key"), F.col(source_col).alias("source"), size_of(text_col).alias("size"), uniform(id_col).alias("u")), "sizes")
    t, s = table.alias("t"), multipliers(table, weights, cap).alias("s")
    out = t.join(s, F.col("t.source").eqNullSafe(F.col("s.source"))).withColumn("copies", taken_copies("s", F.col("size"), F.col("u"), cap))
    return out.select(F.col("key").alias(id_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def apply_mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple[float, ...] = WEIGHTS, cap: int = CAP,
) -> DataFrame:
    """``docs`` with each row as often as the mix takes it (empty documents once, as they cost nothing).

    A row's copies follow from its own size, source and id, so texts meet one row a source and are not exchanged by id.
    """
    table = stored(docs.select(F.col(source_col).alias("source"), size_of(text_col).alias("size"), uniform(id_col).alias("u")), "sizes")
    final = multipliers(table, weights, cap).select(F.col("source").alias("__source"), F.struct("mean", "target", "lam").alias("__m"))
    own = docs.withColumns({"__size": size_of(text_col), "__u": uniform(id_col)})
    out = own.join(final, F.col(source_col).eqNullSafe(F.col("__source")))
    n = taken_copies("__m", F.col("__size"), F.col("__u"), cap)
    out = out.withColumn("__n", F.when(F.col("__size") == 0, 1).otherwise(n))
    return out.where("__n > 0").withColumn("__c", F.explode(F.sequence(F.lit(1), F.col("__n")))).select(*docs.columns)


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "source_size", "target", "taken")
