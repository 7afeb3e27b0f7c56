"""Secret scans: keyword automaton, anchored expressions near its hits, embedded checksums.

Method: one Aho-Corasick automaton over the keywords runs through the ASCII-lower-cased text; at
each hit only the expressions of that keyword are tried, anchored at the hit; candidates whose
format embeds a checksum or a length are validated by it. Runs of hex digits have no keyword: the
automaton's place is taken by probes at every 24th code point, as a run of 24 must cover one.

Defined results: a null text is an empty text (no spans). Offsets are code points, end exclusive.
Matches of a kind are leftmost and do not overlap; failing ones are dropped without a retry.
Repeated rows each get a row; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import map_rows

BASE_KINDS = ("assign", "access", "hex")
#: Fixed values of public token formats.
GIT_PREFIXES = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")
NPM_PREFIX = "npm_"
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
CRC_TOKEN = re.compile(r"(gh[pousr]_|npm_)([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
JWT = re.compile(r"(eyJ[A-Za-z0-9_-]+)\.(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)")
JWT_RUN = re.compile(r"[A-Za-z0-9_-]*")
PEM = re.compile(r"-----BEGIN ([A-Z ]*PRIVATE KEY)-----([A-Za-z0-9+/=\s]+)-----END \1-----")
EXTRA_KINDS = ("crc_token", "jwt", "private_key")
RANK = {k: i for i, k in enumerate((*BASE_KINDS, *EXTRA_KINDS))}
HEX_RUN = 24


def _b62(n: int, width: int) -> str:
    out = ""
    while n:
        n, r = divmod(n, 62)
        out = BASE62[r] + out
    return out.rjust(width, "0")


def crc_ok(entropy: str, check: str) -> bool:
    """The last six characters of such tokens are the CRC-32 of the thirty before, in base 62."""
    return _b62(zlib.crc32(entropy.encode()), 6) == check


def jwt_ok(head: str) -> bool:
    """The header segment must decode to a JSON object that names its algorithm."""
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, TypeError, RecursionError):
        return False


def pem_ok(body: str) -> bool:
    """The body must be base64 of a DER sequence whose embedded length is its length."""
    try:
        raw = base64.b64decode("".join(body.split()), validate=True)
    except (binascii.Error, ValueError):
        return False
    if len(raw) < 4 or raw[0] != 0x30:
        return False
    if raw[1] < 0x80:
        return len(raw) == 2 + raw[1]
    n = raw[1] & 0x7F
    return len(raw) == 2 + n + int.from_bytes(raw[2 : 2 + n], "big")


def automaton():
    """Keyword -> the kinds that can begin there."""
    import ahocorasick

    a = ahocorasick.Automaton()
    kinds = {w: "assign" for w in ASSIGN_WORDS} | {"akia": "access", NPM_PREFIX: "crc_token", "eyj": "jwt", "-----begin ": "private_key"}
    for w, k in (kinds | {w: "crc_token" for w in GIT_PREFIXES}).items():
        a.add_word(w, (len(w), k))
    a.make_automaton()
    return a


def hex_runs(text: str) -> list[tuple[int, int]]:
    """Maximal runs of 24 or more lower-case hex digits; any such run covers a probe."""
    out, end = [], 0
    for at in range(HEX_RUN - 1, len(text), HEX_RUN):
        if at < end or text[at] not in "0123456789abcdef":
            continue
        lo = at
        while lo > end and text[lo - 1] in "0123456789abcdef":
            lo -= 1
        m = HEX.match(text, lo)
        if m.end() - lo >= HEX_RUN:
            out.append((lo, m.end()))
        end = m.end()
    return out


def scan(text: str | None, a) -> list[tuple[str, int, int]]:
    """All spans as (kind, start, end), by start and then kind."""
    if not text:
        return []
    hits = sorted((end - n + 1, kind) for end, (n, kind) in a.iter(text.encode().lower().decode()))
    found, last = [("hex", s, e) for s, e in hex_runs(text)], {}
    for at, kind in hits:
        if at < last.get(kind, 0):
            continue
        if kind == "assign":
            m = ASSIGN.match(text, at)
            ok = m and len(m[2]) >= 6
        elif kind == "access":
            m = ACCESS.match(text, at)
            ok = m and len(m[0]) >= 20
        elif kind == "crc_token":
            m = CRC_TOKEN.match(text, at)
            ok = m and crc_ok(m[2], m[3])
        elif kind == "jwt":
            m = JWT.match(text, at)
            ok = m and jwt_ok(m[1])
        else:
            m = PEM.match(text, at)
            ok = m and pem_ok(m[2])
        if kind == "jwt" and not m and text.startswith("eyJ", at):
            last[kind] = JWT_RUN.match(text, at).end()  # what follows the run is the same for its later hits
        if m:
            last[kind] = m.end()
            if ok:
                found.append((kind, at, m.end()))
    return sorted(found, key=lambda x: (x[1], RANK[x[0]]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _row():
    a = automaton()

    def row(key, text):
        found = scan(text, a)
        n = [sum(x[0] == k for x in found) for k in BASE_KINDS]
        base = joined([x for x in found if x[0] in BASE_KINDS])
        return [(key, *n, hashlib.sha256(base.encode()).hexdigest(), joined(found))]

    return row


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, counts of the base kinds, digest of the base spans, all spans. No shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(
        docs.select(F.col(id_col), F.col(text_col)),
        f"`{id_col}` {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string",
        _row,
    )


def op8_secret_scan(spark, sf_dir: str) -> DataFrame:
    return secret_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
