"""Line dedup of planted passages, and against a chunker of its own."""

import itertools
import random
import re

import pytest

from quern.llm import line_dedup
from tests.llm.test_llm_corpus import corpus, frame, words


@pytest.mark.parametrize("line", [14, 2])
def test_planted_passages_go_whole(spark, line):
    r = random.Random(22)
    texts, want = [], {}
    for n in range(2, 9):
        for shift in range(5):
            passage = [words(r, line) + f" {n} {shift} {k}" for k in range(n)]
            own = [[words(r, 9) + f" own {n} {shift} {side} {k}" for k in range(shift + side)] for side in range(3)]
            texts.append("\n".join([*own[0], *passage, *own[1]]))
            texts.append("\n".join([*own[2], *passage, *[x + " again" for x in own[0]]]))
            want[len(texts) - 1] = "\n".join([*own[2], *[x + " again" for x in own[0]]])
    out = {x.doc_id: x.text for x in line_dedup.line_dedup(frame(spark, texts)).collect()}
    assert out == {i: want[i] if i % 2 else t for i, t in enumerate(texts)}


def test_first_places_stay():
    r = random.Random(23)
    for _ in range(500):
        texts = ["\n".join(r.choice("abcd") for _ in range(r.randint(1, 9))) for _ in range(4)]
        seen, left = set(), []
        for t in texts:
            gone = set()
            for c, s in line_dedup.multi_line(t):
                if s in seen:
                    gone.add(c)
                seen.add(s)
            left += line_dedup.without(t, gone).split("\n")
        assert {x for t in texts for x in t.split("\n")} <= set(left), texts
    run = lambda n: line_dedup.multi_line("\n".join("x" * n))
    assert [s for _, s in run(5)] == ["x\nx", "x\nx", "x\nx\nx"] and [s for _, s in run(4)] == ["x\nx", "x\nx"] and run(1) == []


def own_chunks(text):
    """Chunks of two lines, made from runs of equal lines: (first line, lines)."""
    lines, out, at = text.split("\n"), [], 0
    runs = [(x, len(list(g))) for x, g in itertools.groupby(lines)]
    for k, (x, n) in enumerate(runs):
        out += [(at + i, (x, x)) for i in range(0, n - 1, 2)]
        if n > 1 and n % 2:
            out.append((at + n - 3, (x, x, x)))
        at += n
        if k + 1 < len(runs):
            out.append((at - 1, (x, runs[k + 1][0])))
    return [c for c in out if re.search(r"[^\x20\x09-\x0D]", "".join(c[1]))]


def own_dedup(texts):
    """Texts without the lines of chunks that stand earlier: by id, then place."""
    seen, out = set(), []
    for t in texts:
        if t is None:
            out.append(None)
            continue
        lines, gone, mine = t.split("\n"), set(), set()
        for a, c in own_chunks(t):
            if c in seen or c in mine:
                gone |= set(range(a, a + len(c)))
            mine.add(c)
        seen |= mine
        out.append("\n".join(x for k, x in enumerate(lines) if k not in gone))
    return out


@pytest.mark.parametrize("digest", [16, 1])
def test_against_a_chunker_of_its_own(spark, digest):
    """Whatever the digests: with one byte many chunks share one, and bytes decide."""
    r = random.Random(25)
    texts = ["\n".join(r.choice(["a", "b", "c", "a long line", "", " ", "\t", "é"]) for _ in range(r.randint(1, 12))) for _ in range(120)] + corpus() + [None, "", "one"]
    out = {x.doc_id: x.text for x in line_dedup.line_dedup(frame(spark, texts), digest=digest).collect()}
    assert out == dict(enumerate(own_dedup(texts)))


def test_coarse_chunks(spark):
    """With a mean above 1 chunks are longer, depend on content alone, and whole equal ones go."""
    r = random.Random(26)
    lines = [words(r, 6) for _ in range(400)]
    spans = line_dedup.chunks(lines, 4)
    assert all(b - a >= 2 for a, b in spans) and 50 < len(spans) < 160
    texts = lambda ls: {"\n".join(ls[a:b]) for a, b in line_dedup.chunks(ls, 4)}
    moved = texts(["new", *lines[:200], "another", *lines[200:]])
    assert len(texts(lines) - moved) <= 4
    a = "\n".join(lines)
    out = {x.doc_id: x.text for x in line_dedup.line_dedup(frame(spark, [a, "x\n" + a]), mean=4).collect()}
    assert out[0] == a and len(out[1].split("\n")) < 30 and out[1].startswith("x")
