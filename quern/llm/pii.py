"""Personal data: base expressions with validation, and a linear-chain conditional random field.

Method: a CRF over word-shape features (and a short list of cue words), trained on a small labelled
table (made by rule from a seed, :func:`labelled_table`), decoded by Viterbi in numpy batches over all
words of every text. A word whose score for "outside" beats every other label by more than any
neighbours' transitions can give back is outside in the best sequence, whatever stands around it; such
words are fixed and the runs between them decoded, which gives the tags of the whole text's Viterbi.
Spans of the field are added where no base span stands; those with a format that can be checked
(cards, addresses of machines, account numbers) must pass its check.

Defined results: a null text is an empty text (no spans). Offsets are code points, end exclusive.
Matches of a base kind are leftmost and do not overlap; failing ones are dropped, without a retry.
Repeated rows each get a row; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
HOT = re.compile(r"[0-9@+]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

LABELS = ("O", "email", "ip", "card", "phone", "id", "birth", "name", "street")
EXTRA_KINDS = tuple(f"crf_{x}" for x in LABELS[1:])
RANK = {k: i for i, k in enumerate((*BASE_KINDS, *EXTRA_KINDS))}
#: Labels whose neighbouring words are one span.
JOINED = frozenset(("card", "phone", "id", "birth", "name", "street"))
#: Digits that a span of the field has: least and most.
DIGITS = {"phone": (7, 15), "birth": (3, 8), "street": (1, 6)}
BUCKETS = 1 << 12
#: Shapes that a worker remembers the scores of; it forgets all when those longer than LONG fill a megabyte.
REMEMBERED, LONG = 200_000, 64
#: Words before or in personal data: their lower-case form, without end punctuation, is a feature.
TITLES = ("mr", "mrs", "ms", "dr", "prof", "herr", "frau", "herrn", "mme", "monsieur", "señor", "señora", "sr", "sra", "name", "contact", "signed")
BIRTH = ("born", "dob", "birth", "birthday", "geboren", "geburtsdatum", "née", "né", "nacido", "nacida")
STREETS = ("street", "st", "road", "rd", "avenue", "ave", "lane", "ln", "drive", "boulevard", "blvd", "way", "court", "square")
TELEPHONE = ("phone", "tel", "telephone", "call", "mobile", "fax", "telefon", "teléfono", "téléphone")
ACCOUNT = ("iban", "account", "ssn", "passport", "card", "visa")
CUES = frozenset((*TITLES, *BIRTH, *STREETS, *TELEPHONE, *ACCOUNT, "on", "am", "le", "el", "in", "of", "date", "number", "no", "is", "at"))
#: Words that read as a cue.
CUE_FORMS = {form + end: c for c in CUES for form in (c, c.title(), c.upper()) for end in ("", ".", ":", ",")}
#: Words before a span among which its label's cue must stand, and how many are looked at; of streets, words of the span.
BEFORE = {"name": (frozenset(TITLES), 1), "birth": (frozenset((*BIRTH, "birth")), 4)}


class Shapes(dict):
    """Characters to the characters of shapes: d for digits, A and a for letters, others stay."""

    def __missing__(self, c: int) -> int:
        x = chr(c)
        self[c] = out = ord("d") if x.isdigit() else ord("A") if x.isupper() else ord("a") if x.isalpha() else c
        return out


SHAPES = Shapes()


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def emails(text: str) -> list[tuple[str, int, int]]:
    """Anchored at each @, so that long runs of word characters cost linear time."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        lo = at
        while lo > end and text[lo - 1] in LOCAL_CHARS:
            lo -= 1
        if at >= end and lo < at and (m := DOMAIN.match(text, at + 1)):
            out.append(("email", lo, m.end()))
            end = m.end()
        at = text.find("@", at + 1)
    return out


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    if not text or not HOT.search(text):
        return []
    out = emails(text)
    for m in IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x[-3:]) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if 12 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if 9 <= sum(c.isascii() and c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return sorted(out, key=lambda x: (x[1], RANK[x[0]]))


# the field


def features(shape: str, cue: str = "") -> list[int]:
    """Buckets of a word's features: full and collapsed shape, digit count, ends, length, cue."""
    short = re.sub(r"(.)\1+", r"\1", shape)
    n = shape.count("d")
    names = (
        "b", f"s{short}", f"f{shape}" if len(shape) <= 24 else "f+", f"n{min(n, 24)}", f"e{shape[:1]}{shape[-1:]}", f"@{'@' in shape}", f"l{min(len(shape), 30)}",
        f"c{cue}", f"i{shape[:1] == '+'}{not set(shape) - {'a', 'A'}}",
    )
    return [zlib.crc32(x.encode()) % BUCKETS for x in names]


def keys_of(text: str) -> list:
    """A text's words as the field sees them: their shape, with the cue that they are, if any."""
    shapes: list = WORD.findall(text.translate(SHAPES))
    words = WORD.findall(text)
    for k in [k for k, w in enumerate(words) if w in CUE_FORMS]:
        shapes[k] = shapes[k], CUE_FORMS[words[k]]
    return shapes


def word_features(key) -> list[int]:
    return features(*key) if isinstance(key, tuple) else features(key)


def labelled_table(rows: int = 900, seed: int = 7) -> list[list[tuple[str, str]]]:
    """The small labelled table: ``rows`` sequences of (word, label), the same for the same seed."""
    r = random.Random(seed)
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    w = lambda: "".join(r.choice("aeinorstuhldéüß" if r.random() < 0.2 else "aeinorstuhld") for _ in range(r.randint(1, 11)))
    title = lambda: w().title()
    plain = lambda: r.choice((w, w, w, title, lambda: w() + ",", lambda: w() + ".", lambda: w().upper(), lambda: title() + ".", lambda: f"{w()}-{w()}", lambda: f"{w()}'{w()}", lambda: r.choice(("|", "-", "*", "!!", "#", "&", "...", "<br>", "$"))))()
    other = (
        lambda: d(r.randint(1, 4)), lambda: f"{d(2)}.{d(2)}", lambda: f"{d(1)},{d(3)}", lambda: f"20{d(2)}-{d(2)}-{d(2)}", lambda: f"{d(2)}:{d(2)}",
        lambda: f"v{d(1)}.{d(1)}.{d(2)}", lambda: f"{d(2)}%", lambda: f"{w()}={''.join(r.choice('0123456789abcdef') for _ in range(20))}",
        lambda: "AKIA" + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)), lambda: f"https://{w()}.example.com/{d(3)}", lambda: f"+{d(1)}", lambda: f"{w()}{d(2)}",
        lambda: "".join(r.choice("0123456789abcdef") for _ in range(32)), lambda: f"@{w()}", lambda: d(r.randint(5, 10)), lambda: f"{d(3)}-{d(2)}", lambda: f"({d(2)})", lambda: f"{d(r.randint(20, 30))}",
        lambda: f'"{w()}{d(30)}"', lambda: f"{d(2)}/{d(2)}/{d(4)}", lambda: f"{d(4)}-{d(4)}", lambda: f"${d(3)}.{d(2)}", lambda: f"#{d(5)}",
    )
    cue = lambda words: (lambda x: r.choice((x, x.title(), x + ":", x.title() + ":", x.title() + ".")))(r.choice(words))
    end = lambda: r.choice(("", "", ".", ","))
    day = lambda: r.choice(([f"{d(2)}/{d(2)}/19{d(2)}"], [f"19{d(2)}-{d(2)}-{d(2)}"], [f"{d(2)}.{d(2)}.19{d(2)}"], [d(1), title(), f"19{d(2)}"], [title(), f"{d(2)},", f"19{d(2)}"]))
    of = lambda label, words: [(x, label) for x in words]
    kinds = (
        lambda: [(f"{w()}.{d(2)}@{w()}.{w()}.com", "email")], lambda: [(f"{w()}@{w()}.org" + end(), "email")],
        lambda: [(".".join(str(r.randint(0, 255)) for _ in range(4)), "ip")],
        lambda: [(d(16), "card")], lambda: of("card", (d(4), d(4), d(4), d(4))), lambda: [("-".join((d(4), d(4), d(4), d(4))), "card")], lambda: [(".".join((d(4), d(4), d(4), d(4))) + end(), "card")], lambda: [("/".join((d(4), d(4), d(4), d(4))), "card")],
        lambda: of("phone", (f"+{d(1)}", f"({d(3)})", f"{d(3)}-{d(4)}")), lambda: of("phone", (f"({d(3)})", f"{d(3)}-{d(4)}" + end())),
        lambda: [(f"+{d(2)}-{d(3)}-{d(3)}-{d(4)}", "phone")], lambda: [(f"{d(3)}-{d(3)}-{d(4)}" + end(), "phone")], lambda: [(f"{d(3)}.{d(3)}.{d(4)}" + end(), "phone")],
        lambda: [(cue(TELEPHONE), "O"), *of("phone", (f"0{d(2)}", d(r.randint(6, 8)) + end()))], lambda: [(cue(TELEPHONE), "O"), *of("phone", (f"0{d(1)}", d(2), d(2), d(2), d(2)))], lambda: [(cue(TELEPHONE), "O"), (f"0{d(3)}/{d(7)}", "phone")], lambda: [(cue(TELEPHONE), "O"), *of("phone", (d(3), d(3), d(4) + end()))],
        lambda: [(f"{d(3)}-{d(2)}-{d(4)}" + end(), "id")], lambda: of("id", (f"{r.choice(('DE', 'FR', 'ES', 'GB'))}{d(2)}", d(4), d(4), d(4), d(4), d(2) + end())), lambda: [(f"DE{d(20)}", "id")],
        lambda: [(cue(("born", "geboren", "nacido", "née", "né")), "O"), *([(r.choice(("on", "am", "le", "el", "in")), "O")] if r.random() < 0.7 else []), *of("birth", day())],
        lambda: [(cue(("dob", "birthday", "geburtsdatum")), "O"), *of("birth", day())], lambda: [("date", "O"), ("of", "O"), (r.choice(("birth", "birth:")), "O"), *of("birth", day())],
        lambda: [(cue(TITLES), "O"), *of("name", (title(), title() + end()))], lambda: [(cue(TITLES), "O"), (title() + end(), "name")], lambda: [(cue(TITLES), "O"), *of("name", (title(), w()[:1].upper() + ".", title() + end()))],
        lambda: of("street", (d(r.randint(1, 4)), title(), r.choice(STREETS).title() + end())), lambda: of("street", (d(r.randint(1, 4)), title(), title(), r.choice(STREETS).title() + end())),
        lambda: [(title(), "O"), (r.choice(STREETS).title(), "O"), (w(), "O")], lambda: [(w(), "O"), (r.choice(("born", "call", "name", "in", "is", "at", "way", "contact")), "O"), (w(), "O")],
    )
    table = []
    for _ in range(rows):
        row: list[tuple[str, str]] = []
        for _ in range(r.randint(2, 9)):
            x = r.random()
            row += [(plain(), "O")] if x < 0.6 else [(r.choice(other)(), "O")] if x < 0.78 else r.choice(kinds)()
            row += [(plain(), "O")] if r.random() < 0.5 else []
        table.append(row)
    return table


def emissions(words: list[str], weights: np.ndarray) -> np.ndarray:
    """Scores (word, label) from the features of a word and of its neighbours."""
    f = np.array([word_features(x) for x in keys_of(" ".join(words))])
    own, before, after = (weights[k][f].sum(1) for k in range(3))
    out = own.copy()
    out[1:] += before[:-1]
    out[:-1] += after[1:]
    return out


@lru_cache(maxsize=2)
def train(rows: int = 900, seed: int = 7, rounds: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Weights (3, BUCKETS, labels) and transitions by AdaGrad on the conditional log-likelihood."""
    n = len(LABELS)
    weights, trans = np.zeros((3, BUCKETS, n)), np.zeros((n, n))
    gw, gt = np.full((3, BUCKETS, n), 1e-2), np.full((n, n), 1e-2)
    table, order = labelled_table(rows, seed), random.Random(seed)
    for _ in range(rounds):
        order.shuffle(table)
        for row in table:
            f, y = np.array([word_features(x) for x in keys_of(" ".join(x for x, _ in row))]), np.array([LABELS.index(k) for _, k in row])
            e, t = emissions([x for x, _ in row], weights), len(row)
            a, b = np.empty((t, n)), np.zeros((t, n))
            a[0] = e[0]
            for i in range(1, t):
                a[i] = e[i] + np.logaddexp.reduce(a[i - 1][:, None] + trans, axis=0)
            for i in range(t - 2, -1, -1):
                b[i] = np.logaddexp.reduce(trans + (e[i + 1] + b[i + 1])[None], axis=1)
            z = np.logaddexp.reduce(a[-1])
            diff = np.exp(a + b - z)
            diff[np.arange(t), y] -= 1
            dt = np.zeros((n, n))
            for i in range(1, t):
                dt += np.exp(a[i - 1][:, None] + trans + (e[i] + b[i])[None] - z)
                dt[y[i - 1], y[i]] -= 1
            gt += dt * dt
            trans -= 0.2 * dt / np.sqrt(gt)
            for k, (at, g) in enumerate(((f, diff), (f[:-1], diff[1:]), (f[1:], diff[:-1]))):
                if len(at):
                    hit, place = np.unique(at, return_inverse=True)
                    sums = np.zeros((len(hit), n))
                    np.add.at(sums, place.ravel(), np.repeat(g, at.shape[1], axis=0))
                    gw[k][hit] += sums**2
                    weights[k][hit] -= 0.2 * sums / np.sqrt(gw[k][hit])
    return weights, trans


def viterbi(scores: list[np.ndarray], trans: np.ndarray) -> list[np.ndarray]:
    """Best label sequences of many score tables at once; tables are padded within groups of like length."""
    out: list = [None] * len(scores)
    order = sorted(range(len(scores)), key=lambda i: len(scores[i]))
    at = 0
    while at < len(order):
        most, group = max(8, 2 * len(scores[order[at]])), []
        while at < len(order) and len(scores[order[at]]) <= most and len(group) < 512:
            group.append(order[at])
            at += 1
        size, t = np.array([len(scores[i]) for i in group]), max(len(scores[i]) for i in group)
        e = np.zeros((len(group), t, trans.shape[0]))
        for k, i in enumerate(group):
            e[k, : len(scores[i])] = scores[i]
        best, back = e[:, 0].copy(), np.zeros((t, len(group), trans.shape[0]), dtype=np.int8)
        for i in range(1, t):
            step = best[:, :, None] + trans[None]
            back[i] = step.argmax(1)
            best = np.where((i < size)[:, None], step.max(1) + e[:, i], best)
        tags = np.zeros((len(group), t), dtype=np.int8)
        cur = best.argmax(1).astype(np.int8)
        for i in range(t - 1, -1, -1):
            live = i < size
            tags[:, i] = np.where(live, cur, 0)
            if i:
                cur = np.where(live, back[i][np.arange(len(group)), cur], cur)
        for k, i in enumerate(group):
            out[i] = tags[k, : size[k]]
    return out


class Field:
    """A trained field over whole texts. Scores of words are kept, so that each different word is looked at once."""

    def __init__(self, weights: np.ndarray, trans: np.ndarray) -> None:
        self.weights, self.trans = weights, trans
        #: What a label can win over "outside" by its transitions, at most.
        self.bonus = np.maximum(0, (trans - trans[:, :1]).max(0)) + np.maximum(0, (trans - trans[:1]).max(1)) + 1e-3
        self.forget()

    def forget(self) -> None:
        self.ids: dict = {}
        self.scores = np.empty((1024, 3, self.trans.shape[0]))
        self.long = 0

    def places(self, keys: list) -> list[int]:
        """Rows of ``scores`` of words; new ones get a row."""
        get, out = self.ids.get, []
        for w in keys:
            k = get(w)
            if k is None:
                k = self.ids[w] = len(self.ids)
                if k == len(self.scores):
                    self.scores = np.concatenate((self.scores, np.empty_like(self.scores)))
                self.scores[k] = self.weights[:, word_features(w)].sum(1)
                self.long += len(w) if len(w) > LONG else 0
            out.append(k)
        return out

    def tags(self, texts: list[list]) -> list[dict[int, int]]:
        """Of each text (as :func:`keys_of`) the places that are not outside, and their labels."""
        out: list[dict[int, int]] = [{} for _ in texts]
        at = np.array([k for words in texts for k in self.places(words)], dtype=np.int64)
        if not len(at):
            return out
        size = np.array([len(x) for x in texts])
        text = np.repeat(np.arange(len(texts)), size)
        joint = text[1:] == text[:-1]  # a word has the one before it as neighbour
        e = self.scores[at, 0]
        e[1:][joint] += self.scores[at[:-1][joint], 1]
        e[:-1][joint] += self.scores[at[1:][joint], 2]
        open_ = np.flatnonzero((e[:, 1:] + self.bonus[1:] >= e[:, :1]).any(1))
        if len(self.ids) > REMEMBERED or self.long > 1 << 20:
            self.forget()
        if not len(open_):
            return out
        cut = np.flatnonzero((np.diff(open_) > 1) | ~joint[open_[1:] - 1]) + 1
        runs = np.split(open_, cut)
        scores = []
        for run in runs:
            own = e[run[0] : run[-1] + 1].copy()
            if run[0] and joint[run[0] - 1]:
                own[0] += self.trans[0]
            if run[-1] < len(joint) and joint[run[-1]]:
                own[-1] += self.trans[:, 0]
            scores.append(own)
        first = np.cumsum(size) - size
        for run, tag in zip(runs, viterbi(scores, self.trans)):
            for k, y in zip(run, tag):
                if y:
                    out[text[k]][int(k - first[text[k]])] = int(y)
        return out


def account_ok(text: str) -> bool:
    """Nine digits in three parts, or an account number whose remainder modulo 97 is 1."""
    x = "".join(c for c in text if c.isalnum()).upper()
    if x.isdigit():
        return len(x) == 9
    return 15 <= len(x) <= 34 and x.isascii() and int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1


def passes(label: str, text: str) -> bool:
    """Whether a span of the field has what its label's format asks for."""
    digits = "".join(c for c in text if c.isascii() and c.isdigit())
    if label == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    if label == "ip":
        return bool(IP.fullmatch(text)) and all(len(x) <= 3 and int(x) <= 255 for x in text.split("."))
    if label == "id":
        return account_ok(text)
    if label == "email":
        return "@" in text[1:-1]
    if label == "name":
        return not digits and text[:1].isupper()
    low, high = DIGITS[label]
    return low <= len(digits) <= high


def cued(label: str, before: list[str], span: str) -> bool:
    """Whether the words about a span name what its label says."""
    read = lambda w: w.strip(".,;:!?()").lower()
    if label == "street":
        return any(read(w) in STREETS for w in span.split())
    known, reach = BEFORE.get(label, ((), 0))
    return not reach or any(read(w) in known for w in before[-reach:])


def added(text: str, base: list, tags: dict[int, int]) -> list[tuple[str, int, int]]:
    """Runs of one label, without end punctuation, that touch no base span and pass the label's check."""
    if not tags:
        return []
    words = [m.span() for m in WORD.finditer(text)]
    out, at = [], sorted(tags)
    i = 0
    while i < len(at):
        label, j = LABELS[tags[at[i]]], i + 1
        while j < len(at) and label in JOINED and at[j] == at[j - 1] + 1 and tags[at[j]] == tags[at[i]]:
            j += 1
        s, e, k = words[at[i]][0], words[at[j - 1]][1], i
        i = j
        while e > s and text[e - 1] in ".,;:!?":
            e -= 1
        if passes(label, text[s:e]) and cued(label, [text[x:y] for x, y in words[max(0, at[k] - 4) : at[k]]], text[s:e]) and not any(s < b[2] and b[1] < e for b in base):
            out.append((f"crf_{label}", s, e))
    return out


def pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = 900, seed: int = 7) -> DataFrame:
    """One row a document: id, counts of the base kinds, digest of the base spans, all spans. No shuffle.

    The field is trained once on the driver; its weights have a fixed size and go with the tasks.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    arrow = to_arrow_schema(_parse_datatype_string(schema))
    weights, trans = train(rows, seed)
    weights = weights.astype(np.float32)

    def run(batches):
        field = Field(weights.astype(np.float64), trans)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                keys, texts = (c.to_pylist() for c in batch.slice(at, 256).columns)
                tags, out = field.tags([keys_of(t or "") for t in texts]), []
                for key, text, own in zip(keys, texts, tags):
                    base = base_spans(text)
                    more = added(text, base, own)
                    n = [sum(x[0] == k for x in base) for k in BASE_KINDS]
                    every = sorted(base + more, key=lambda x: (x[1], RANK[x[0]]))
                    join = lambda spans: ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
                    out.append((key, *n, hashlib.sha256(join(base).encode()).hexdigest(), join(every)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def op9_pii(spark, sf_dir: str) -> DataFrame:
    return pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
