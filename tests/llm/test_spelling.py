"""Spelling variants next to all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest

from pulsemill.llm import spelling

SCHEMA = "doc_id long, text string, word string, n long, root string"


def is_near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


def brute(rows, faults=199, letters=6, least=5, ratio=5):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if faults and h % faults == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= letters and c >= least}
    out, form = {}, {}
    by = sorted(n)
    for w in by:
        near = [v for v in by if abs(len(v) - len(w)) < 2 and is_near(w, v)]
        best = min(near, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
        out[w] = [n[w], len(near), form[w], n.get(form[w])]
    for w in by:
        v = w
        while form[v] is not None:
            v = form[v]
        out[w].append(v)
    return {w: tuple(v) for w, v in out.items()}


def found(spark, rows, **kw):
    df = spark.createDataFrame([(d, t, "x", 1, "y") for d, t in rows], SCHEMA)
    got = spelling.group(df, **kw).collect()
    assert len(got) == len({r.word for r in got})
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in got}


def test_index_is_distance_one():
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abé") for _ in range(rng.randrange(1, 7))) for _ in range(400)})
    index = spelling.Index(words)
    for w in [*words, "", "zz", "aaaaaaaa"]:
        assert [words[k] for k in spelling.members(index.near(w))] == [v for v in words if is_near(w, v)], w


def drawn(rng, words, rows):
    out = []
    for k in range(rows):
        text = rng.choice([" ", "\n", ", ", "·"]).join(rng.choice(words) for _ in range(rng.randrange(200)))
        out.append((rng.choice([k, k, None]), text))
    return out


@pytest.mark.parametrize("block", [spelling.BLOCK, 7])
def test_group_against_all_pairs(spark, block):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcé") for _ in range(rng.randrange(5, 10))) for _ in range(120)]
    for w in list(words):
        for _ in range(4):
            i = rng.randrange(len(w) + 1)
            words.append(w[:i] + rng.choice(["", "a", "ÿ", "b"]) + w[i + rng.randrange(2):])
    words = [w for w in words for _ in range(rng.choice((1, 1, 1, 6, 40)))] + ["ÀBCdef", "x" * 5000, "x" * 5001]
    rows = drawn(rng, words, 300) + [(1, None), (2, ""), (3, "a1b2c3"), (4, "x" * 100_000)]
    rows += [(900 + k, "prefixes" + "abcdefgh"[k % 8] + " prefixed" * 5) for k in range(60)]
    rows += [(7, "repeated repeatet")] * 50
    assert found(spark, rows, faults=19, block=block) == brute(rows, 19)


def test_chain_ties_and_limits(spark):
    rows = [(k, "colours " * n) for k, n in ((1, 700),)] + [(2, "colour " * 130 + "colou " * 26 + "coloux " * 26 + "colox " * 5)]
    got = found(spark, rows)
    assert got["colour"][4] == "colours" and got["coloux"][2:] == ("colour", 130, "colours")
    assert got == brute(rows, 0)


def test_empty(spark):
    assert spelling.group(spark.createDataFrame([], SCHEMA), faults=199).count() == 0


def test_query_against_all_pairs(spark):
    import __spark_entry__ as entry
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = entry.queries()["op13_spelling"](spark, d).collect()
    assert {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in got} == brute(rows)
