"""URL filters: given rules, and a path-template tree judged by smoothed labelled purity.

Method: per host, the segments of each path are typed, and variable ones (numbers, hashes, dates,
long ids, and the children of nodes with too many of them) become wildcards; sibling branches whose
labelled shares do not differ statistically from the median share of all siblings are merged into a
wildcard, deepest position first; a template is rejected if its smoothed share of good labels is below
``min_purity`` times the corpus's share, so that the limit means the same however clean the labels are.
A rule that fits decides before the tree; of several the longest.

Defined results: a null url, or one without ``://``, has empty host and path and template ``""``.
Unlabelled templates have the corpus's share of good labels. Labels repeated for a page are
combined (bad if any is). Repeated pages each get a row. Paths of any depth are in the tree whole;
steps of the tree run only at depths where they can change something. An empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import map_rows
from quern.session import stored

#: The contract's rules: (verdict, host, path).
RULES = (
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
VARIABLE = r"^(\d+|[0-9a-f]{8,}|[0-9a-f-]{32,}|\d{1,4}[-_.]\d{1,2}([-_.]\d{1,4})?|.*\d{3,}.*|.{40,})$"
SUFFIX = r"(\.[A-Za-z][A-Za-z0-9]{0,4})$"
#: A node with more literal children than this has variable children.
FANOUT = 50
#: Branches whose shares differ by fewer standard errors than this are similar.
Z = 1.96
#: Weight of the corpus's share in a template's, in labels.
PRIOR = 10.0
#: Least smoothed share of good labels, as a part of the corpus's: 3 bad of 3 reject, 2 of 2 don't, at a share of 0.75.
MIN_PURITY = 0.8


def host_path(url):
    """Columns (host, path) of a url column."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, pattern, 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def rule_for(host, path, rules=RULES):
    """Columns (rule, verdict) of the longest rule that fits, else null. ``rules`` is a short list: it becomes an expression."""
    rule = verdict = None
    for said, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, said) if verdict is None else verdict.when(fits, said)
    return (rule, verdict) if rules else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def typed(path):
    """Array of a path's segments, variable ones as ``*`` (a file suffix stays)."""
    parts = F.split(F.regexp_replace(path, "^/", ""), "/", -1)
    stem = lambda s: F.regexp_replace(s, SUFFIX, "")
    one = lambda s: F.when(F.lower(stem(s)).rlike(VARIABLE), F.concat(F.lit("*"), F.regexp_extract(s, SUFFIX, 1))).otherwise(s)
    return F.transform(parts, one)


def _at(array, k: int, value):
    """``array`` with its ``k``-th element (from 1) replaced."""
    return F.transform(array, lambda x, i: F.when(i == k - 1, value).otherwise(x))


def _branches():
    import xxhash

    def row(host, g):
        out, up = [], xxhash.xxh3_128(host.encode())
        for k, s in enumerate(g, 1):
            out.append((k, len(g), up.digest(), xxhash.xxh3_128_digest(s.encode())))
            up.update(s.encode() + b"/")
        return out

    return row


def wide_depths(nodes: DataFrame, fanout: int) -> list[int]:
    """Depths at which a host has enough segments for a wide node."""
    at = nodes.select("host", F.posexplode("g").alias("k", "s")).distinct().groupBy("host", "k").count().where(F.col("count") > fanout)
    return sorted(r.k + 1 for r in at.select("k").distinct().collect())


def branching_depths(nodes: DataFrame) -> list[int]:
    """Depths, deepest first, at which templates of one length part: siblings that can merge are only there."""
    at = map_rows(nodes.select("host", "g").distinct(), "k int, n int, up binary, s binary", _branches)
    at = at.groupBy("k", "n", "up").agg(F.min("s").alias("a"), F.max("s").alias("b")).where("a <> b")
    return sorted((r.k for r in at.select("k").distinct().collect()), reverse=True)


def url_filter(
    pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", label_id: str = "doc_id", rules=RULES,
    fanout: int = FANOUT, z: float = Z, prior: float = PRIOR, min_purity: float = MIN_PURITY,
) -> DataFrame:
    """One row a page: id, host, path, rule, verdict, template, purity.

    Pages are narrow rows from the start (no page body is read). Only statistics of templates are
    joined back; the hot host's pages meet them in joins that Spark may split.
    """
    host, path = host_path(F.col(url_col))
    bad = F.coalesce(F.col("toxic") == 1, F.lit(False)) | F.coalesce(F.col("quality") == 0, F.lit(False))
    known = labels.where("toxic is not null or quality is not null").groupBy(F.col(label_id).alias("lid")).agg(F.max(bad.cast("int")).alias("bad"))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path")).withColumn("t", typed(F.col("path")))
    rows = stored(rows.join(known, F.col("id") == F.col("lid"), "left").drop("lid"), "urls")
    nodes = rows.groupBy("host", "t").agg(F.count(F.lit(1)).alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    nodes = stored(nodes.select("host", "t", F.col("t").alias("g"), "n", "labelled", "bad"), "nodes")
    for k in wide_depths(nodes, fanout):  # from the root: children of wide nodes become wildcards
        at = nodes.where(F.size("g") >= k).select("host", F.slice("g", 1, k - 1).alias("up"), F.element_at("g", k).alias("s"))
        wide = at.distinct().groupBy("host", "up").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > fanout)
        wide = stored(wide.select(F.col("host").alias("h"), "up"), "wide")
        if wide.isEmpty():
            continue
        hit = nodes.join(wide, (F.col("host") == F.col("h")) & (F.slice("g", 1, k - 1) == F.col("up")) & (F.size("g") >= k), "left")
        nodes = stored(hit.withColumn("g", F.when(F.col("h").isNotNull(), _at(F.col("g"), k, F.lit("*"))).otherwise(F.col("g"))).select(*nodes.columns), "nodes")
    for k in branching_depths(nodes):  # from the leaves: similar siblings merge
        stats = nodes.groupBy("host", "g").agg(F.sum("labelled").alias("m"), F.sum("bad").alias("b")).where(F.size("g") >= k)
        stats = stored(stats.withColumn("pool", _at(F.col("g"), k, F.lit("*"))), "stats")
        pools = stats.groupBy("host", "pool").agg(F.sum("m").alias("pm"), F.expr("percentile(try_divide(b, m), 0.5, m)").alias("mid"), F.count(F.lit(1)).alias("c")).where("c > 1")
        pools = stored(pools.select(F.col("host").alias("ph"), F.col("pool").alias("pp"), "pm", "mid"), "pools")
        if pools.isEmpty():
            continue
        # a branch against the labelled median share of all siblings, which outliers do not move
        others = F.col("pm") - F.col("m")
        pooled = (F.col("b") + F.col("mid") * others + 0.5) / (F.col("pm") + 1)
        error = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1), "m") + F.try_divide(F.lit(1), others)))
        similar = (F.col("m") == 0) | (others == 0) | (F.abs(F.try_divide("b", "m") - F.col("mid")) <= z * error)
        merged = stats.join(pools, (F.col("host") == F.col("ph")) & (F.col("pool") == F.col("pp"))).where(similar)
        merged = stored(merged.select(F.col("host").alias("h"), F.col("g").alias("old"), "pool"), "merged")
        hit = nodes.join(merged, (F.col("host") == F.col("h")) & (F.col("g") == F.col("old")), "left")
        nodes = stored(hit.withColumn("g", F.coalesce("pool", "g")).select(*nodes.columns), "nodes")
    labelled, bad_n = nodes.agg(F.sum("labelled"), F.sum("bad")).first()
    good_share = 1 - bad_n / labelled if labelled else 1.0
    purity = (F.col("m") - F.col("b") + prior * good_share) / (F.col("m") + prior)
    judged = nodes.groupBy("host", "g").agg(F.sum("labelled").alias("m"), F.sum("bad").alias("b")).select("host", "g", purity.alias("purity"))
    verdicts = stored(nodes.select("host", "t", "g").join(judged, ["host", "g"]).select(F.col("host").alias("h"), F.col("t").alias("t0"), "g", "purity"), "verdicts")
    out = rows.join(verdicts, (F.col("host") == F.col("h")) & (F.col("t") == F.col("t0")))
    rule, said = rule_for(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("purity") < F.lit(min_purity * good_share), "block").otherwise("allow")
    template = F.when(F.col("path") == "", "").otherwise(F.concat(F.lit("/"), F.array_join("g", "/")))
    return out.select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(said, method).alias("verdict"), template.alias("template"), "purity")


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    return url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
