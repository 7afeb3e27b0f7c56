"""SQL for those queries of this package that SQL can express."""

from __future__ import annotations

import math

from quern.llm.mixing import CAP, GRID, PASSES, POINTS, WEIGHTS
from quern.llm.quality_rules import LEFT_SHARE, LEFT_WORDS, LINE_DOCS, LINE_SHARE
from quern.llm.secrets import BASE62
from quern.llm.simhash import DISTANCE, SEED, SHINGLE
from quern.llm.suffix_dedup import LENGTH
from quern.llm.url_filter import FANOUT, LOWER, MIN_PURITY, PRIOR, RULES, SUFFIX, UPPER, VARIABLE, Z

WORDS = r"[^\x20\x09-\x0D]+"

OP2 = """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
 fine AS (SELECT * FROM v WHERE e IS NOT NULL AND label IS NOT NULL AND len([x FOR x IN e IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN e IF x <> 0]) > 0),
 links AS (SELECT a.vec_id AS u, b.vec_id AS w FROM fine a JOIN fine b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
   WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98),
 reach(u, w) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.u, l.w FROM reach r JOIN links l ON l.u = r.w),
 comp AS (SELECT u, min(w) AS c FROM reach GROUP BY u), n AS (SELECT u, count(*) AS k FROM links GROUP BY u)
SELECT v.vec_id, coalesce(n.k, 0) AS n_links, comp.c AS component_id, v.vec_id = comp.c AS kept FROM v JOIN comp ON comp.u = v.vec_id LEFT JOIN n ON n.u = v.vec_id"""

OP7 = f"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, source, coalesce(text, '') AS t FROM documents),
 w AS (SELECT k, regexp_extract_all(t, '{WORDS}') AS ws FROM d),
 ln AS (SELECT k, unnest(string_split(t, chr(10))) AS l FROM d),
 lw AS (SELECT k, l, regexp_extract_all(translate(l, '{UPPER}', '{LOWER}'), '{WORDS}') AS ws FROM ln),
 lk AS (SELECT k, l, array_to_string(ws, ' ') AS nl, len(ws) AS n FROM lw WHERE len(ws) > 0),
 dup AS (SELECT k, count(*) - count(DISTINCT l) AS n_dup_lines FROM lk GROUP BY k),
 win AS (SELECT k, i, ws[i:i + 4] AS five FROM (SELECT k, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
 rep AS (SELECT k, count(DISTINCT p) AS n_repeat_words FROM (SELECT k, unnest(range(i, i + 5)) AS p FROM (SELECT k, i, count(*) OVER (PARTITION BY k, five) AS c FROM win) WHERE c > 1) GROUP BY k),
 texts AS (SELECT coalesce(source, chr(1)) AS s, t, min(k) AS k, count(DISTINCT doc_id) + max(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) AS docs FROM d GROUP BY 1, 2),
 lim AS (SELECT s, greatest({float(LINE_DOCS)}, sum(docs) * CAST({LINE_SHARE} AS DOUBLE)) AS most FROM texts GROUP BY s),
 often AS (SELECT s, nl FROM (SELECT s, nl, sum(docs) AS c FROM (SELECT DISTINCT s, nl, t, docs FROM texts JOIN lk USING (k)) GROUP BY s, nl) JOIN lim USING (s) WHERE c > most),
 gone AS (SELECT s, t, CAST(sum(n) AS BIGINT) AS gone FROM texts JOIN lk USING (k) JOIN often USING (s, nl) GROUP BY s, t),
 m AS (SELECT d.doc_id, len(w.ws) AS n_words, CAST(coalesce(list_sum([length(x) FOR x IN w.ws]), 0) AS BIGINT) AS word_chars,
   length(d.t) - length(regexp_replace(d.t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n_dup_lines, 0) AS n_dup_lines, coalesce(rep.n_repeat_words, 0) AS n_repeat_words, coalesce(gone.gone, 0) AS n_removed_words
   FROM d JOIN w USING (k) LEFT JOIN dup USING (k) LEFT JOIN rep USING (k) LEFT JOIN gone ON gone.s = coalesce(d.source, chr(1)) AND gone.t = d.t)
SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT (n_removed_words > 0 AND (n_words - n_removed_words < {LEFT_WORDS} OR n_words - n_removed_words < CAST({LEFT_SHARE} AS DOUBLE) * n_words)) AS kept FROM m"""

def _hex(at: str, n: int) -> str:
    """The little-endian word of ``n`` bytes at byte ``at`` of hex text ``x``."""
    return "CAST('0x' || " + " || ".join(f"substr(x, 2 * ({at}) + {2 * k + 1}, 2)" for k in reversed(range(n))) + " AS UBIGINT)"


def _mul(a, b) -> str:
    return f"CAST((CAST({a} AS UHUGEINT) * CAST({b} AS UHUGEINT)) % {1 << 64}::UHUGEINT AS UBIGINT)"


def _add(*xs) -> str:
    return "CAST((" + " + ".join(f"CAST({x} AS UHUGEINT)" for x in xs) + f") % {1 << 64}::UHUGEINT AS UBIGINT)"


def _rot(x, r: int) -> str:
    return f"CAST((CAST({x} AS UHUGEINT) * {1 << r}::UHUGEINT) % {1 << 64}::UHUGEINT + CAST({x} >> {64 - r} AS UHUGEINT) AS UBIGINT)"


#: Fixed values of XXH64.
P1, P2, P3, P4, P5 = 11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261


def _round(acc: str, word: str) -> str:
    return _mul(_rot(_add(acc, _mul(word, P2)), 31), P1)


def _merge(acc: str, v: str) -> str:
    return _add(_mul(f"xor({acc}, {_round('0', v)})", P1), P4)


def _avalanche(h: str) -> list[str]:
    """Three steps, each of the column ``h``."""
    return [_mul(f"xor({h}, {h} >> 33)", P2), _mul(f"xor({h}, {h} >> 29)", P3), f"xor({h}, {h} >> 32)"]


def _xxh64(seed: int) -> str:
    """CTEs that give ``hashed(x, h)``: XXH64 of the bytes of each hex text of ``todo(x)``. A step of the recursion takes a stripe, a word or a byte."""
    start = [(seed + P1 + P2) % (1 << 64), (seed + P2) % (1 << 64), seed, (seed - P1) % (1 << 64)]
    return f"""w0 AS (SELECT x, length(x) // 2 AS n, 0 AS o, {', '.join(f'{v}::UBIGINT AS v{k}' for k, v in enumerate(start, 1))} FROM todo),
 stripes AS (SELECT * FROM w0 UNION ALL SELECT x, n, o + 32, {', '.join(f"{_round(f'v{k}', _hex(f'o + {8 * k - 8}', 8))} AS v{k}" for k in range(1, 5))} FROM stripes WHERE o + 32 <= n),
 long_ AS (SELECT * FROM stripes WHERE o + 32 > n),
 m0 AS (SELECT *, {_add(*(_rot(f'v{k}', r) for k, r in ((1, 1), (2, 7), (3, 12), (4, 18))))} AS h FROM long_ WHERE n >= 32),
 m1 AS (SELECT * REPLACE ({_merge('h', 'v1')} AS h) FROM m0), m2 AS (SELECT * REPLACE ({_merge('h', 'v2')} AS h) FROM m1), m3 AS (SELECT * REPLACE ({_merge('h', 'v3')} AS h) FROM m2), m4 AS (SELECT * REPLACE ({_merge('h', 'v4')} AS h) FROM m3),
 begun AS (SELECT x, n, o, {_add('h', 'n')} AS h FROM m4 UNION ALL SELECT x, n, o, {_add((seed + P5) % (1 << 64), 'n')} FROM long_ WHERE n < 32),
 tails AS (SELECT * FROM begun UNION ALL SELECT x, n, CASE WHEN o + 8 <= n THEN o + 8 WHEN o + 4 <= n THEN o + 4 ELSE o + 1 END,
   CASE WHEN o + 8 <= n THEN {_add(_mul(_rot(f"xor(h, {_round('0', _hex('o', 8))})", 27), P1), P4)}
     WHEN o + 4 <= n THEN {_add(_mul(_rot(f"xor(h, {_mul(_hex('o', 4), P1)})", 23), P2), P3)}
     ELSE {_mul(_rot(f"xor(h, {_mul(_hex('o', 1), P5)})", 11), P1)} END FROM tails WHERE o < n),
 a0 AS (SELECT x, h FROM tails WHERE o = n), a1 AS (SELECT x, {_avalanche('h')[0]} AS h FROM a0), a2 AS (SELECT x, {_avalanche('h')[1]} AS h FROM a1), hashed AS (SELECT x, {_avalanche('h')[2]} AS h FROM a2)"""


OP3 = f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORDS}') AS ws FROM documents),
 sh AS (SELECT k, lower(hex(encode(array_to_string(ws[i:i + {SHINGLE - 1}], ' ')))) AS x FROM (SELECT k, ws, unnest(range(1, greatest(2, len(ws) - {SHINGLE - 2}))) AS i FROM d WHERE len(ws) > 0)),
 todo AS MATERIALIZED (SELECT DISTINCT x FROM sh), {_xxh64(SEED)},
 bits AS (SELECT k, {' + '.join(f"CASE WHEN 2 * sum((h >> {b}) & 1) > count(*) THEN {1 << b}::UHUGEINT ELSE 0::UHUGEINT END" for b in range(64))} AS fp FROM sh JOIN hashed USING (x) GROUP BY k),
 fps AS MATERIALIZED (SELECT k, doc_id, CAST(coalesce(fp, 0) AS UBIGINT) AS fp FROM d LEFT JOIN bits USING (k)),
 own AS MATERIALIZED (SELECT fp, min(doc_id) AS first FROM fps GROUP BY fp),
 links AS MATERIALIZED (SELECT a.fp AS u, b.fp AS w FROM own a JOIN own b ON a.fp <> b.fp AND bit_count(CAST(xor(a.fp, b.fp) >> 32 AS BIGINT)) + bit_count(CAST(xor(a.fp, b.fp) & 4294967295 AS BIGINT)) <= {DISTANCE}),
 reach(u, w) AS (SELECT fp, fp FROM own UNION SELECT r.u, l.w FROM reach r JOIN links l ON l.u = r.w),
 comp AS (SELECT r.u, min(own.first) AS c FROM reach r JOIN own ON own.fp = r.w GROUP BY r.u)
SELECT doc_id, lpad(lower(hex(fp)), 16, '0') AS fingerprint, c AS component_id FROM fps JOIN comp ON u = fp"""

OP4 = f"""WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents), n AS (SELECT doc_id, b, octet_length(b) AS n FROM d),
 starts AS (SELECT doc_id, b, unnest(range(1, n - {LENGTH - 2})) AS s FROM n WHERE n >= {LENGTH}),
 strings AS MATERIALIZED (SELECT doc_id, s - 1 AS s, md5(b[s:s + {LENGTH - 1}]) AS h FROM starts),
 later AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) AS r FROM strings) WHERE r > 1),
 cut AS (SELECT doc_id, s, coalesce(s > lag(s) OVER (PARTITION BY doc_id ORDER BY s) + {LENGTH}, true) AS fresh FROM later),
 runs AS (SELECT doc_id, min(s) AS a, max(s) + {LENGTH} AS e FROM (SELECT *, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY s) AS r FROM cut) GROUP BY doc_id, r),
 kept AS (SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY a), 0) AS lo, a AS hi FROM runs UNION ALL SELECT doc_id, max(e), NULL FROM runs GROUP BY doc_id),
 rest AS (SELECT doc_id, string_agg(substr(hex(b), 2 * lo + 1, 2 * (coalesce(hi, n) - lo)), '' ORDER BY lo) AS x FROM kept JOIN n USING (doc_id) GROUP BY doc_id),
 gone AS (SELECT doc_id, sum(e - a) AS gone, count(*) AS spans FROM runs GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(coalesce(unhex(x), b)) AS kept_sha256 FROM n LEFT JOIN gone USING (doc_id) LEFT JOIN rest USING (doc_id)"""


def _found(kind: str, pattern: str, ok: str) -> str:
    """(k, kind, s, e, m) of a pattern's leftmost matches that are ``ok``: between the matches stand the pieces of a split."""
    return f"""SELECT k, '{kind}' AS kind, s, s + length(m) AS e, m FROM (SELECT k, ms[i] AS m, CAST(list_sum([length(p) FOR p IN ps[:i]]) + coalesce(list_sum([length(p) FOR p IN ms[:i - 1]]), 0) AS BIGINT) AS s
   FROM (SELECT k, ms, ps, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT k, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS ps FROM d WHERE regexp_matches(t, '{pattern}')))) WHERE {ok}"""


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


ASSIGN_SQL = "(" + "|".join(map(_either, ("password", "passwd", "secret", "token"))) + "|" + _either("api") + "_?" + _either("key") + """)["'']?\\x20*[:=]\\x20*["'']?"""
#: CRC-32, a byte at a time and a bit at a time.
CRC32 = "xor(4294967295, list_reduce(list_prepend(4294967295, [CAST(ascii(c) AS BIGINT) FOR c IN string_split(m[-36:-7], '')]), lambda a, b: list_reduce(list_prepend(xor(a, b), [CAST(0 AS BIGINT) FOR z IN range(8)]), lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))))"
BASE62_SQL = f"""array_to_string([substr('{BASE62}', CAST((v // power(62, 5 - z)) % 62 AS INTEGER) + 1, 1) FOR z IN range(6)], '')"""
HEAD = "split_part(m, '.', 1)"
JSON = f"TRY(decode(from_base64(rpad(translate({HEAD}, '-_', '+/'), CAST(4 * ceil(length({HEAD}) / 4) AS INTEGER), '='))))"

OP8 = f"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
 crc AS (SELECT *, {CRC32} AS v FROM ({_found('crc_token', '(gh[pousr]_|npm_)[0-9A-Za-z]{36}', 'true')})),
 found AS (SELECT k, kind, s, e, 0 AS rank FROM ({_found('assign', ASSIGN_SQL + '[A-Za-z0-9+/_.=-]+', "length(regexp_replace(m, '^" + ASSIGN_SQL + "', '')) >= 6")})
  UNION ALL SELECT k, kind, s, e, 1 FROM ({_found('access', 'AKIA[A-Z0-9]+', 'length(m) >= 20')}) UNION ALL SELECT k, kind, s, e, 2 FROM ({_found('hex', '[0-9a-f]+', 'length(m) >= 24')})
  UNION ALL SELECT k, kind, s, e, 3 FROM crc JOIN d USING (k) WHERE m[-6:] = {BASE62_SQL} AND NOT regexp_matches(substr(t, e + 1, 1), '[0-9A-Za-z]')
  UNION ALL SELECT k, kind, s, e, 4 FROM ({_found('jwt', 'eyJ[A-Za-z0-9_-]+[.]eyJ[A-Za-z0-9_-]+[.][A-Za-z0-9_-]+', f"coalesce(json_exists(CASE WHEN json_valid({JSON}) THEN {JSON} END, '$.alg'), false)")})),
 spans AS (SELECT k, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank < 3) AS base,
   count(*) FILTER (rank = 0) AS a, count(*) FILTER (rank = 1) AS c, count(*) FILTER (rank = 2) AS h FROM found GROUP BY k)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN spans USING (k)"""

OP10 = r"""WITH d AS (SELECT row_number() OVER () AS k, doc_id, text FROM documents),
 ln AS (SELECT k, doc_id, unnest(ls) AS l, unnest(range(len(ls))) AS i, len(ls) AS n FROM (SELECT k, doc_id, string_split(text, chr(10)) AS ls FROM d WHERE text IS NOT NULL)),
 same AS (SELECT *, coalesce(l = lag(l) OVER (PARTITION BY k ORDER BY i), false) AS again, lead(l) OVER (PARTITION BY k ORDER BY i) AS next FROM ln),
 runs AS (SELECT *, sum(CASE WHEN again THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY i) AS run FROM same),
 placed AS (SELECT *, i - min(i) OVER (PARTITION BY k, run) AS j, count(*) OVER (PARTITION BY k, run) AS size FROM runs),
 chunks AS (SELECT k, doc_id, i AS a, i + 2 AS e, l || chr(10) || next AS b FROM placed WHERE i < n - 1 AND (next <> l OR j % 2 = 0)
  UNION ALL SELECT k, doc_id, i, i + 3, l || chr(10) || l || chr(10) || l FROM placed WHERE size > 1 AND size % 2 = 1 AND j = size - 3),
 gone AS (SELECT k, a, e FROM (SELECT *, row_number() OVER (PARTITION BY b ORDER BY doc_id, a) AS r FROM chunks WHERE regexp_matches(b, '[^\x20\x09-\x0D]')) WHERE r > 1),
 cut AS (SELECT DISTINCT k, unnest(range(a, e)) AS i FROM gone),
 kept AS (SELECT k, string_agg(l, chr(10) ORDER BY i) AS t FROM ln LEFT JOIN cut USING (k, i) WHERE cut.k IS NULL GROUP BY k)
SELECT doc_id, CASE WHEN text IS NOT NULL THEN coalesce(t, '') END AS text, CAST(coalesce(c, 0) AS INTEGER) AS n_removed_chunks FROM d LEFT JOIN kept USING (k) LEFT JOIN (SELECT k, count(*) AS c FROM gone GROUP BY k) USING (k)"""


def _copies(lam: str) -> str:
    return f"least({CAP}, CAST(floor({_rate(lam)} + u) AS INTEGER))"


def _rate(lam: str) -> str:
    return f"({CAP} / (1 + exp(-(CAST({math.log(1 / (CAP - 1))!r} AS DOUBLE) + {lam} * (size / mean)))))"


def _pass(i: int) -> str:
    """One narrowing of the multipliers' spans on rounded totals."""
    point = lambda k: f"(a + (b - a) * CAST({k / POINTS!r} AS DOUBLE))"
    sums = ", ".join(f"CAST(sum(size * {_copies(point(k))}) AS BIGINT)" for k in range(POINTS + 1))
    return f"""p{i} AS (SELECT sid, mean, target, a, b, [{sums}] AS t FROM rows_ JOIN s{i} USING (sid, mean) GROUP BY sid, mean, target, a, b),
 q{i} AS (SELECT *, len([x FOR x IN t[2:{POINTS}] IF x <= target]) AS k FROM p{i}),
 s{i + 1} AS (SELECT sid, mean, target, a + (b - a) * k / {POINTS} AS a, a + (b - a) * (k + 1) / {POINTS} AS b, t[k + 1] AS ta, t[k + 2] AS tb FROM q{i})"""


OP5 = f"""WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORDS}')) AS BIGINT) AS size, CAST(CAST('0x' || substr(md5('mix' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) / {1 << 52} AS u FROM documents),
 src AS MATERIALIZED (SELECT *, list_extract(CAST([{', '.join(map(str, WEIGHTS))}] AS DOUBLE[]), CAST(sid % {len(WEIGHTS)} + 1 AS INTEGER)) AS w FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, avg(size) AS mean, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM d GROUP BY source)),
 lv(i, level) AS (SELECT 0, sum(source_size) / sum(w) FROM src UNION ALL SELECT i + 1, (SELECT coalesce(((SELECT sum(source_size) FROM src) - coalesce(sum(CASE WHEN {CAP} * source_size < w * lv.level THEN {CAP} * source_size END), 0)) / sum(CASE WHEN NOT {CAP} * source_size < w * lv.level THEN w END), lv.level) FROM src) FROM lv WHERE i < 50),
 tg AS MATERIALIZED (SELECT src.*, least(CAST({CAP} * source_size AS DOUBLE), w * level) AS target FROM src CROSS JOIN (SELECT level FROM lv WHERE i = 50)),
 rows_ AS MATERIALIZED (SELECT sid, mean, size, u FROM d JOIN tg ON d.source IS NOT DISTINCT FROM tg.source WHERE size > 0),
 hist AS MATERIALIZED (SELECT sid, size, count(*) AS n FROM rows_ GROUP BY sid, size),
 bis(sid, mean, target, i, lo, hi) AS (SELECT sid, mean, target, 0, CAST(-1000 AS DOUBLE), CAST(1000 AS DOUBLE) FROM tg WHERE target > 0 AND target < {CAP} * source_size
   UNION ALL SELECT sid, mean, target, i + 1, CASE WHEN g <= target THEN (lo + hi) / 2 ELSE lo END, CASE WHEN g <= target THEN hi ELSE (lo + hi) / 2 END
   FROM (SELECT bis.*, (SELECT sum(n * size * {_rate('((bis.lo + bis.hi) / 2)')}) FROM hist WHERE hist.sid = bis.sid) AS g FROM bis WHERE i < 60)),
 l AS (SELECT sid, mean, target, round((lo + hi) / 2 / {GRID}) * {GRID} AS lam FROM bis WHERE i = 60),
 s0 AS (SELECT sid, mean, target, lam - greatest(4::DOUBLE, abs(lam) * 2) AS a, lam + greatest(4::DOUBLE, abs(lam) * 2) AS b FROM l), {', '.join(map(_pass, range(PASSES)))},
 best AS (SELECT sid, CASE WHEN abs(ta - target) <= abs(tb - target) THEN a ELSE b END AS lam FROM s{PASSES})
SELECT doc_id, size, source_size, target, size * CASE WHEN lam IS NOT NULL THEN {_copies('lam')} WHEN target > 0 THEN {CAP} ELSE 0 END AS taken FROM d JOIN tg ON d.source IS NOT DISTINCT FROM tg.source LEFT JOIN best USING (sid)"""

#: Segments of a path that the SQL of the tree looks at; the tables' paths have 4 at most.
TREE_DEPTH = 6
STEM = f"regexp_replace(s, '{SUFFIX}', '')"
TYPED = f"list_transform(string_split(regexp_replace(path, '^/', ''), '/'), lambda s: CASE WHEN regexp_matches(lower({STEM}), '{VARIABLE}') THEN '*' || regexp_extract(s, '{SUFFIX}', 1) ELSE s END)"


def _put(k: int) -> str:
    return f"list_concat(list_concat(g[1:{k - 1}], ['*']), g[{k + 1}:])"


def _wide(k: int) -> str:
    """Children of wide nodes at depth ``k`` become wildcards."""
    return f"""w{k} AS (SELECT host, up FROM (SELECT DISTINCT host, g[1:{k - 1}] AS up, g[{k}] AS s FROM n{k - 1} WHERE len(g) >= {k}) GROUP BY host, up HAVING count(*) > {FANOUT}),
 n{k} AS MATERIALIZED (SELECT n.host, t, CASE WHEN w.host IS NOT NULL THEN {_put(k)} ELSE g END AS g, labelled, bad FROM n{k - 1} n LEFT JOIN w{k} w ON n.host = w.host AND len(g) >= {k} AND g[1:{k - 1}] = up)"""


def _alike(k: int, before: str, after: str) -> str:
    """Siblings at depth ``k`` whose shares do not differ from the labelled median merge."""
    return f"""st{k} AS MATERIALIZED (SELECT host, g, {_put(k)} AS pool, sum(labelled) AS m, sum(bad) AS b FROM {before} WHERE len(g) >= {k} GROUP BY host, g),
 mid{k} AS (SELECT host, pool, quantile_cont(v, 0.5) AS mid FROM (SELECT host, pool, CAST(b AS DOUBLE) / m AS v, unnest(range(CAST(m AS BIGINT))) FROM st{k} WHERE m > 0) GROUP BY host, pool),
 pl{k} AS (SELECT p.*, mid FROM (SELECT host, pool, sum(m) AS pm FROM st{k} GROUP BY host, pool HAVING count(*) > 1) p LEFT JOIN mid{k} USING (host, pool)),
 sh{k} AS (SELECT host, g, pool, m, b, mid, pm - m AS others, (b + mid * (pm - m) + 0.5::DOUBLE) / (pm + 1) AS x FROM st{k} JOIN pl{k} USING (host, pool)),
 mg{k} AS (SELECT host, g, pool FROM sh{k} WHERE m = 0 OR others = 0 OR abs(CAST(b AS DOUBLE) / m - mid) <= {Z} * sqrt(x * (1 - x) * (1::DOUBLE / m + 1::DOUBLE / others))),
 {after} AS MATERIALIZED (SELECT n.host, t, coalesce(pool, n.g) AS g, labelled, bad FROM {before} n LEFT JOIN mg{k} USING (host, g))"""


def _rule(value: int) -> str:
    """The longest rule that fits: its text (1) or what it says (0)."""
    cases = (f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{(v, h + p)[value]}'" for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2])))
    return f"CASE {' '.join(cases)} END"


OP1 = f"""WITH parts AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
 known AS (SELECT doc_id AS lid, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels WHERE toxic IS NOT NULL OR quality IS NOT NULL GROUP BY doc_id),
 urls AS MATERIALIZED (SELECT page_id, host, path, {TYPED} AS t, bad FROM parts LEFT JOIN known ON page_id = lid),
 n0 AS MATERIALIZED (SELECT host, t, t AS g, count(bad) AS labelled, coalesce(sum(bad), 0) AS bad FROM urls GROUP BY host, t),
 {', '.join(map(_wide, range(1, TREE_DEPTH + 1)))}, {', '.join(_alike(k, f'n{TREE_DEPTH}' if k == TREE_DEPTH else f'j{k + 1}', f'j{k}') for k in range(TREE_DEPTH, 0, -1))},
 share AS (SELECT CASE WHEN sum(labelled) > 0 THEN 1 - CAST(sum(bad) AS DOUBLE) / sum(labelled) ELSE 1 END AS good FROM j1),
 judged AS (SELECT host, g, (sum(labelled) - sum(bad) + {PRIOR}::DOUBLE * any_value(good)) / (sum(labelled) + {PRIOR}::DOUBLE) AS purity, any_value(good) AS good FROM j1 CROSS JOIN share GROUP BY host, g)
SELECT page_id, host, path, {_rule(1)} AS rule, coalesce({_rule(0)}, CASE WHEN purity < {MIN_PURITY}::DOUBLE * good THEN 'block' ELSE 'allow' END) AS verdict, CASE WHEN path = '' THEN '' ELSE '/' || array_to_string(g, '/') END AS template, purity
FROM urls JOIN j1 USING (host, t) JOIN judged USING (host, g)"""

ORACLE_SQL = {
    "op1_url_filter": OP1, "op2_embedding_dedup": OP2, "op3_simhash": OP3, "op4_suffix_dedup": OP4, "op5_mixing": OP5, "op7_quality_rules": OP7, "op8_secret_scan": OP8, "op10_line_dedup": OP10,
}
