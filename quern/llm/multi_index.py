"""Multi-index hashing: all pairs of 64-bit fingerprints within a Hamming distance.

A fingerprint is cut into segments, each with a table of its own, keyed by (segment number, segment
value). Two fingerprints that differ in ``distance`` bits or fewer differ in at most
``distance // segments`` bits of one segment at least, so the small Hamming ball of each segment's
value is enumerated, the table's matches are fetched, and complete distances are verified.

A table key may hold a third of all fingerprints (near copies that differ elsewhere). Keys of more
than ``hot`` fingerprints are continued by the bits outside the segment: both sides enumerate half of
the distance there and meet, so that a continued key has a bounded number of fingerprints and the
result is the same.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import stored

BITS = 64
SEGMENTS = 2
#: Links join fingerprints that differ in at most this many bits.
DISTANCE = 2
#: Table keys of more fingerprints than this are continued by the bits outside their segment.
HOT = 256


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def segment_masks(segments: int) -> list[int]:
    """Masks of the segments: together they hold every bit once."""
    if not 1 <= segments <= BITS:
        raise ValueError(f"segments must be in 1..{BITS}")
    ends = [BITS * k // segments for k in range(segments + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(ends, ends[1:])]


def ball(mask: int, radius: int) -> list[int]:
    """All ways to flip at most ``radius`` of the bits of ``mask``."""
    bits = [1 << k for k in range(BITS) if mask >> k & 1]
    return [sum(c) for r in range(min(radius, len(bits)) + 1) for c in combinations(bits, r)]


def _flips(value, masks: list[int]):
    """``value`` with each of the flips, exploded."""
    return F.explode(F.transform(F.array(*(F.lit(signed(m)).cast("long") for m in masks)), lambda m: value.bitwiseXOR(m)))


def _by_segment(table: DataFrame, masks: list[int], radius: int) -> DataFrame:
    """(segment, value, fp): of each fingerprint and segment, the segment's bits with each flip of at most ``radius``."""

    def rows(segment: int, mask: int):
        own = F.col("fp").bitwiseAND(F.lit(signed(mask)).cast("long"))
        flips = F.array(*(F.lit(signed(f)).cast("long") for f in ball(mask, radius)))
        return F.transform(flips, lambda x: F.struct(F.lit(segment).alias("segment"), own.bitwiseXOR(x).alias("value")))

    return table.select(F.explode(F.concat(*(rows(k, m) for k, m in enumerate(masks)))).alias("e"), "fp").select("e.segment", "e.value", "fp")


def _continued(rows: DataFrame, masks: list[int], radius: int) -> DataFrame:
    """Rows of hot keys with ``rest``: the bits outside the segment, at most ``radius`` of them flipped."""
    out = None
    for k, m in enumerate(masks):
        outside = (1 << BITS) - 1 - m
        rest = F.col("fp").bitwiseAND(F.lit(signed(outside)).cast("long"))
        own = rows.where(F.col("segment") == k).withColumn("rest", _flips(rest, ball(outside, radius)))
        out = own if out is None else out.unionByName(own)
    return out


def close_pairs(table: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS, hot: int = HOT) -> DataFrame:
    """(u, v), u < v: all pairs of the distinct 64-bit fingerprints ``table(fp)`` that differ in ``distance`` bits or fewer."""
    masks = segment_masks(segments)
    entries = _by_segment(table, masks, 0)
    probes = _by_segment(table, masks, distance // segments)
    often = stored(entries.groupBy("segment", "value").count().where(F.col("count") > hot).select("segment", "value"), "hot")
    near = (F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= distance)

    def met(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
        return a.withColumnRenamed("fp", "u").join(b.withColumnRenamed("fp", "v"), on).where(near).select("u", "v")

    if often.isEmpty():
        return met(probes, entries, ["segment", "value"])
    key = ["segment", "value"]
    cold = met(probes.join(often, key, "left_anti"), entries.join(often, key, "left_anti"), key)
    few, more = distance // 2, distance - distance // 2
    return cold.unionByName(met(_continued(probes.join(often, key, "left_semi"), masks, more), _continued(entries.join(often, key, "left_semi"), masks, few), [*key, "rest"]))
