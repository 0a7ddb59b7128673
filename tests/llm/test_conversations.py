"""Conversation repair next to an enumeration of all edits and a plain dynamic programme."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from pulsemill.llm import conversations as cv

SCHEMA = "conv_id long, turn long, role string, text string, key string, piece long"
SOUND = re.compile(r"(s?(ua)+)?")


def faults(rows):
    seen, out = set(), []
    for turn, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen
                   else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def options(role, fault):
    more = 5 * (fault == "truncated")
    out = [("D", 2, None)]
    if fault not in ("blank", "duplicate"):
        out += [("K", more, role), ("R", 1 + more, "user"), ("R", 1 + more, "assistant")]
    return out


def enumerated(rows):
    """(cost, audit, roles) over all edits with at most two inserted rows in a row."""
    inserts = [x for k in range(3) for x in itertools.product(("user", "assistant"), repeat=k)]
    best = None
    per_row = [options(r[1], f) for r, f in zip(rows, faults(rows))]
    for acts in itertools.product(*per_row):
        for ins in itertools.product(inserts, repeat=len(rows) + 1):
            roles, audit, cost = [], "", 0
            for k in range(len(rows) + 1):
                roles += ins[k]
                audit += "I" * len(ins[k])
                cost += 5 * len(ins[k])
                if k < len(rows):
                    audit += acts[k][0]
                    cost += acts[k][1]
                    if acts[k][2] is not None:
                        roles.append(acts[k][2])
            if (best is None or (cost, audit) < best[:2]) and SOUND.fullmatch("".join(r[:1] or "-" for r in roles)):
                best = (cost, audit, roles)
    return best


def planned(rows):
    """The same by a plain programme over whole strings, for longer conversations."""
    alive = {"": (0, "", [])}

    def closed(alive):
        for _ in range(2):
            for state, (c, a, out) in list(alive.items()):
                role = "assistant" if state == "u" else "user"
                new = (c + 5, a + "I", out + [(role, "")])
                if role[0] not in alive or new[:2] < alive[role[0]][:2]:
                    alive[role[0]] = new
        return alive

    for (_, role, text), fault in zip(rows, faults(rows)):
        nxt = {}
        for state, (c, a, out) in closed(alive).items():
            for edit, cost, to in options(role, fault):
                end = state
                if to is not None:
                    end = to[:1]
                    if end not in {"": "su", "s": "u", "u": "a", "a": "u"}[state] or not end:
                        continue
                new = (c + cost, a + edit, out if to is None else out + [(to, text)])
                if end not in nxt or new[:2] < nxt[end][:2]:
                    nxt[end] = new
        alive = nxt
    return min((v for k, v in closed(alive).items() if k in ("", "a")), key=lambda v: v[:2])


def plain_digest(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    found = faults(rows)
    turns = [r[0] for r in rows if r[0] is not None]
    cost, audit, out = planned(rows)
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, found.count("blank"),
            found.count("duplicate"), found.count("truncated"),
            sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:])), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())


def drawn(rng, n, roles=("system", "user", "assistant", "tool", "")):
    texts = ["Hello there.", "Why?", "cut off", "", " \n", "Yes!", "no end, ", "Fine."]
    return [(t, rng.choice(roles), rng.choice(texts) + rng.choice(["", str(t), f" {t}."])) for t in range(n)]


def test_plain_programme_against_enumeration():
    rng = random.Random(5)
    for _ in range(40):
        rows = drawn(rng, rng.choice((0, 1, 2)))
        assert planned(rows)[:2] == enumerated(rows)[:2], rows
    assert planned(rows := [(0, "system", "A."), (1, "system", "B."), (2, "user", "C.")])[:2] == enumerated(rows)[:2]


def test_streaming_trellis_is_the_plain_programme():
    rng = random.Random(6)
    for k in range(400):
        rows = drawn(rng, rng.randrange(30), ("user",) if k % 4 == 0 else ("system", "user", "user", "assistant", "tool"))
        reader, trellis, words = cv.Reader(), cv.Trellis(), []
        for r in rows:
            words += trellis.step(reader.moves(*r))
        cost, rest, closing = trellis.end()
        assert (cost, "".join([*words, *rest]) + closing) == planned(rows)[:2], rows


def test_edits_are_emitted_early_and_nodes_go():
    reader, trellis, held = cv.Reader(), cv.Trellis(), 0
    done = 0
    for t in range(5000):
        done += len(trellis.step(reader.moves(t, "user" if t % 2 == 0 else "assistant", f"Text {t}.")))
        held = max(held, t + 1 - done)
    assert done > 4980 and held < 20


ROWS = ([(c, t, r, x, "extra", 9) for c in range(60) for t, r, x in drawn(random.Random(c), c % 13)]
        + [(100, t, r, x, "e", 1) for t, r, x in drawn(random.Random(1), 300)]          # a third of all rows
        + [(101, t % 7, "user", "Same.", "e", 1) for t in range(60)]                    # repeated rows and turns
        + [(102, t, "user", f"U {t}.", "e", 1) for t in range(81)]                      # unresolved to its end
        + [(103, None, "user", "Null turn.", "e", 1), (103, None, None, None, "e", 1), (103, 4, "assistant", "x.", "e", 1)]
        + [(None, 1, "user", "No id.", "e", 1), (None, 2, "assistant", None, "e", 1)]
        + [(104, 1, "user", "Long. " * 200_000, "e", 1), (104, 2, "assistant", None, "e", 1)])


def expected():
    by = defaultdict(list)
    for c, t, r, x, *_ in ROWS:
        by[c].append((t, " " if r is None else r, " " if x is None else x))
    return {c: plain_digest(rows) for c, rows in by.items()}


@pytest.mark.parametrize("long_rows", [50_000, 9])
def test_digest(spark, long_rows):
    got = cv.digest(spark.createDataFrame(ROWS, SCHEMA), long_rows).collect()
    assert len(got) == len({r.conv_id for r in got})
    assert {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256)
            for r in got} == expected()


def test_edits_give_the_repaired_rows(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    for long_rows in (50_000, 9):
        got = sorted(cv.repair(df, long_rows).collect(), key=lambda r: (r.conv_id or -1, r.piece, r.no))
        hashes = defaultdict(list)
        for r in got:
            hashes[r.conv_id] += [f"{r.role}:{r.text}"] * (r.edit != "D")
        for c, want in expected().items():
            assert hashlib.sha256("\n".join(hashes[c]).encode()).hexdigest() == want[-1]


def test_empty(spark):
    assert cv.digest(spark.createDataFrame([], SCHEMA)).count() == 0
    assert cv.repair(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_against_plain_definition(spark):
    """op11 over the whole small table."""
    import __spark_entry__ as entry
    d = "/root/testdata/sf0.001"
    by = defaultdict(list)
    for r in spark.read.parquet(f"{d}/conversations.parquet").collect():
        conv, turn = (" " if v is None else v for v in (r.conv_id, r.turn))
        role, text = (" " if v is None else v for v in (r.role, r.text))
        draw = zlib.crc32(f"{conv}:{turn}".encode()) % 20
        rows = by[r.conv_id]
        if draw == 1:
            text = ""
        if draw == 2:
            text = re.sub(r"[.!?]", "", text)
        if draw == 4:
            role = "user"
        rows += [(r.turn, role, text)] * {0: 0, 3: 2}.get(draw, 1)
    want = {c: plain_digest(rows) for c, rows in by.items()}
    got = entry.queries()["op11_conversations"](spark, d).collect()
    assert {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256)
            for r in got} == want
