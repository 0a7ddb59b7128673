"""Each operator on small awkward tables, next to a plain definition."""

import math
import re
import zlib

import numpy as np
import pytest

from pulsemill.llm import (batches, components, decontamination, line_dedup, near_dup, packing, perplexity,
                           quality_rules, templates, token_files, tokens, toxicity, url_rules)
from pulsemill.sources.storage import scratch_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, score string"
BASE = ("one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen "
        "sixteen seventeen eighteen nineteen twenty")
LONG = " ".join(f"w{i}" for i in range(3000))
TEXTS = [(1, BASE), (2, BASE), (2, BASE), (3, BASE + " more"), (4, ""), (5, None), (None, BASE), (None, None),
         (6, "a b"), (7, "A  B"), (8, " \n\t "), (9, LONG), (10, "<|endoftext|> x\n\ny  z. ")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, t, "en", "s", len(t or ""), "x", "y") for d, t in TEXTS], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def plain_ids(text):
    e = tokens.encoder(tokens.tokenizer_path())
    return np.frombuffer(e.plain(text or ""), "<u4")


@pytest.mark.parametrize("text", ["", " ", "a", " a b", "a  b ", "x.\ny", "x. \ny", "don't 1,2 \x1c b", "é\u2028 ü\n\n\nz",
                                  "<|endoftext|>", "a,b. c", LONG])
def test_pieces_give_the_ids_of_the_whole(text):
    e = tokens.encoder(tokens.tokenizer_path())
    assert e.encode(text) == e.plain(text)


def test_pieces_of_random_texts_give_the_ids_of_the_whole(monkeypatch):
    rng = np.random.default_rng(3)
    letters = [*"  \n\t\r\x0b\x1c\x85\xa0azAst'\"ml.,-$$19éÀ×÷ªʰЯ҂αא०\u1680\u2003\u2028\u3000”’—あ漢😀²", "\u0301", "\x00"]
    e = tokens.Encoder(tokens.tokenizer_path())
    monkeypatch.setattr(tokens, "PIECES_KEPT", 500)
    for _ in range(30):
        some = rng.choice(letters, 6)
        texts = ["".join(rng.choice(some if i % 2 else letters, rng.integers(0, 30))) for i in range(100)]
        assert e.encode_all(texts) == [e.plain(t) for t in texts]
        assert len(e.pieces) <= 500


def test_words_are_not_searched_for_one_by_one():
    class Counted:
        def __init__(self, tokenizer):
            self.tokenizer, self.n = tokenizer, 0

        def encode(self, text, **k):
            self.n += 1
            return self.tokenizer.encode(text, **k)

        def encode_batch_fast(self, texts, **k):
            self.n += len(texts)
            return self.tokenizer.encode_batch_fast(texts, **k)

    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abdeghinorstwé"), 9)) for _ in range(2000)]
    text = "".join(w + e for w, e in zip(words, ["$$$ ", ".\n", ",### ", " 12 ", "!) "] * 400))
    e = tokens.Encoder(tokens.tokenizer_path())
    want = e.plain(text)
    e.tokenizer = Counted(e.tokenizer)
    assert e.encode_all([text]) == [want]
    assert e.tokenizer.n < 100


def test_token_files(spark, docs, empty):
    root = scratch_path(spark, "t")
    token_files.write_token_files(docs, root, tokens.tokenizer_path())
    got = token_files.read_token_files(spark, root, with_ids=True).collect()
    want = sorted(TEXTS, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or ""))
    got.sort(key=lambda r: r.start)
    at = 0
    assert [r.doc_id for r in got] == [d for d, _ in want]
    for r, (_, t) in zip(got, want):
        ids = np.append(plain_ids(t), 0).astype("<u4")
        assert (r.start, r.n_tokens, r.ids_crc32, r.ids) == (at, len(ids), zlib.crc32(ids.tobytes()), ids.tolist())
        at += len(ids)
    some = token_files.read_documents(spark, root, [2, 6, 99]).collect()
    assert sorted(r.doc_id for r in some) == [2, 2, 6]
    root = scratch_path(spark, "t")
    token_files.write_token_files(empty, root, tokens.tokenizer_path())
    assert token_files.read_token_files(spark, root).count() == 0


def test_damage_is_noticed(tmp_path):
    with open(tmp_path / "f", "wb") as f:
        w = token_files.FileWriter(f, 2)
        w.add(5, np.arange(5000, dtype="<u4"))
        w.close()
    from pyarrow import fs
    data = bytearray((tmp_path / "f").read_bytes())
    r = token_files.FileReader(fs.LocalFileSystem().open_input_file(str(tmp_path / "f")))
    assert r.find(5)[0].tolist() == list(range(5000))
    r.sums = r.sums + 1
    with pytest.raises(ValueError):
        r.ids(0)
    data[-1] ^= 1
    (tmp_path / "g").write_bytes(bytes(data))
    with pytest.raises(ValueError):
        token_files.FileReader(fs.LocalFileSystem().open_input_file(str(tmp_path / "g")))


def test_packing(docs, empty):
    rows = packing.pack(docs, tokens.tokenizer_path()).collect()
    want = sorted(len(plain_ids(t)) + 1 for _, t in TEXTS)
    assert sum(r.length for r in rows) == sum(want)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for s in by.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= r.sequence_length
    assert packing.pack(empty, tokens.tokenizer_path()).count() == 0


def test_blocks_are_full():
    rng = np.random.default_rng(1)
    made = packing.pack_block(rng.integers(1, 5000, 700).tolist())
    short = [s for s, row in made if sum(p[2] for p in row) != s]
    assert len(short) <= 1
    groups = packing.step_groups(made)
    assert len(groups) == len(made)


def test_decontamination(spark, docs, empty):
    bench = spark.createDataFrame(
        [(1, BASE), (2, "A B"), (3, None), (4, ""), (5, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 zz"), (6, "a b"), (None, "a b")],
        "item_id long, text string")
    def rows(df):
        return sorted((r.doc_id or 0, r.n_words, r.n_hit, r.n_items) for r in df.collect())
    got = rows(decontamination.digest(decontamination.find(docs, bench)))
    want = []
    items = [decontamination.words(x) for x in (BASE, "A B", "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 zz", "a b", "a b")]
    for d, t in TEXTS:
        ws, hit, found = decontamination.words(t), set(), set()
        for k, it in enumerate(items):
            n = min(10, len(it))
            for i in range(len(ws) - n + 1):
                if any(ws[i:i + n] == it[j:j + n] for j in range(len(it) - n + 1)):
                    hit |= set(range(i, i + n))
                    found.add(k)
        want.append((d or 0, len(ws), len(hit), len(found)))
    assert got == sorted(want)
    assert rows(decontamination.digest(decontamination.find(docs, bench, block_words=4))) == got
    left = {r.doc_id: r.text for r in decontamination.clean(docs, bench).collect()}
    assert 1 not in left and 6 not in left and "w3 " not in left[9] and left[4] == "" and left[5] is None
    assert decontamination.clean(docs, bench).columns == docs.columns
    assert decontamination.find(empty, bench).count() == 0
    assert not any(r.n_hit for r in decontamination.digest(decontamination.find(docs, bench.limit(0))).collect())


@pytest.mark.parametrize("block_words", [200_000, 12])
def test_clean_leaves_nothing_and_keeps_columns(spark, block_words):
    bench = spark.createDataFrame([("a", BASE), ("b", "a1 a2 a3 a4 a5 a6 a7 a8 a9 a10 a11"), ("c", "x1:x2=x3@x4"),
                                   (None, " ".join(f"long{k}" for k in range(60)))], "item_id string, text string")
    filler = " ".join(f"f{k}" for k in range(90))
    # Cutting the first span brings the halves of another window together.
    nested = "a1 a2 a3 a4 a5 " + BASE + " a6 a7 a8 a9 a10 a11 " + filler
    texts = [nested, filler, BASE, f"{filler} x1 x2, x3 x4", None, "", f"{filler} " + " ".join(f"long{k}" for k in range(5, 40)), nested]
    names = ["names", "spans", "n_words", "keys", "__text", "items", "row", "changed", "n_chars"]
    df = spark.createDataFrame([(k, t, *[f"{c}{k}" for c in names[:-1]], len(t or "")) for k, t in enumerate(texts)],
                               "doc_id long, text string, " + ", ".join(f"{c} string" for c in names[:-1]) + ", n_chars long")
    left = decontamination.clean(df, bench, block_words=block_words)
    assert left.columns == df.columns
    got = {r.doc_id: r for r in left.collect()}
    assert got.keys() == {0, 1, 3, 4, 5, 6, 7}
    assert all(got[k].names == f"names{k}" and got[k].row == f"row{k}" and got[k].n_chars == len(got[k].text or "") for k in got)
    assert got[0].text.split() == filler.split() == got[7].text.split() and got[1].text == filler
    assert decontamination.digest(decontamination.find(left, bench)).where("n_hit > 0").count() == 0


def test_long_items_are_cut_into_segments(spark):
    ws = [f"s{k}" for k in range(100)]
    bench = spark.createDataFrame([("a", " ".join(ws)), ("a", ":".join(ws))], "item_id string, text string")
    got = decontamination.segments(bench, 10, 25).collect()
    assert all(r.n <= 25 for r in got) and len({r.item for r in got}) == 2
    seen = {tuple(r.words.split()[k:k + 10]) for r in got for k in range(r.n - 9)}
    assert seen == {tuple(ws[k:k + 10]) for k in range(91)}
    docs = spark.createDataFrame([(1, " ".join(ws[20:60]))], "doc_id long, text string")
    r = decontamination.digest(decontamination.find(docs, bench, block_words=30)).first()
    assert (r.n_hit, r.n_items) == (40, 2)


def test_toxicity(spark, docs, empty):
    rows = [(i, f"word{i % 7} plain text here. " + ("you idiot there." if i % 5 == 0 else "fine day.")) for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(300)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(d, labels)
    got = {r.doc_id: r for r in toxicity.score(d, model).collect()}
    assert all(got[i].predicted == int(i % 5 == 0) for i in range(300))
    assert got[0].worst_sentence == 1
    assert {r.text for r in toxicity.offending(d, model).collect()} == {"you idiot there."}
    odd = toxicity.score(docs, model).collect()
    assert len(odd) == len(TEXTS) and all(0 <= r.score <= 1 for r in odd)
    assert toxicity.score(empty, toxicity.train(empty, labels.limit(0))).count() == 0


def test_near_dup(docs, empty):
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in near_dup.link(docs).collect())
    want = [(0, 0, None, True), (0, 16, None, True), (1, 16, 1, True), (2, 16, 1, False), (2, 16, 1, False), (3, 17, 1, False),
            (4, 0, 4, True), (5, 0, 5, True), (6, 1, 6, True), (7, 1, 6, False), (8, 0, 8, True), (9, 2996, 9, True)]
    assert [g for g in got if g[0] < 10] == want
    assert near_dup.link(empty).count() == 0


def test_near_dup_of_long_lists(spark, monkeypatch):
    """A family of texts around the limit, in tiles and in pairs, next to all pairs."""
    rng = np.random.default_rng(3)
    texts = []
    for i in range(90):
        words = [f"w{k}" for k in range(120)]
        for at in rng.choice(120, rng.integers(2, 5), replace=False):
            words[at] = f"x{rng.integers(0, 40)}"
        texts.append(" ".join(words))
    sets = [{tuple(t.split()[k:k + 5]) for k in range(116)} for t in texts]
    least = list(range(90))
    for _ in range(90):
        for a in range(90):
            for b in range(a):
                if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    least[a] = least[b] = min(least[a], least[b])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for short, part in ((1, 1000), (1000, 1000)):
        monkeypatch.setattr(near_dup, "SHORT", short)
        monkeypatch.setattr(near_dup, "PART", part)
        monkeypatch.setattr(near_dup, "TURNS", 1)
        got = {r.doc_id: r.component_id for r in near_dup.link(docs).collect()}
        assert got == dict(enumerate(least))
    assert 1 < len(set(least)) < 90


def test_near_dup_around_the_sketch_size(spark):
    """Pairs of equal size and truncations of every size from 90 to 135, next to all pairs."""
    texts, want = [], {}

    def add(a, b):
        x, y = ({tuple(w[k:k + 5]) for k in range(len(w) - 4)} for w in (a, b))
        linked = 100 * len(x & y) >= 75 * len(x | y)
        i = len(texts)
        texts.extend([(i, " ".join(a)), (i + 1, " ".join(b))])
        want[i], want[i + 1] = i, i if linked else i + 1

    for n in range(90, 136):
        for j, other in enumerate((n * 3 // 4, -(-n * 3 // 4), -(-n * 4 // 5))):
            words = [f"w{n}x{j}x{k}" for k in range(n + 4)]
            add(words, words[:other + 4])
        for j, common in enumerate((n * 6 // 7, -(-n * 6 // 7), -(-n * 22 // 25))):
            words = [f"v{n}x{j}x{k}" for k in range(n + 4)]
            add(words, words[:common + 4] + [f"u{n}x{j}x{k}" for k in range(n - common)])
    got = near_dup.link(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == want
    assert 150 < sum(i != c for i, c in want.items()) < len(texts) // 2


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 100)], "a long, b long")
    got = {r.node: r.label for r in components.components(links).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and got[100] == 90


def test_line_dedup(spark, docs, empty):
    line = "this is the very same boilerplate line that everyone has today"
    rows = [(i, f"{line}\nown words of document {chr(97 + i)} " + " ".join(f"{chr(97 + i)}{chr(97 + k)}" for k in range(20)),
             "en", "s", 0, "x", "y") for i in range(8)]
    out = {r.doc_id: r for r in line_dedup.drop_recurring(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(out) == 8 and sum(line in r.text for r in out.values()) == 1
    assert all("own words of document" in r.text for r in out.values())
    fields = [(i, "2024-01-%02d 10:00 user %d logged in from host number %d ok\n" % (i, i, i) + rows[i][1].split("\n")[1], "en", "s", 0, "x", "y")
              for i in range(8)]
    out = line_dedup.drop_recurring(spark.createDataFrame(fields, SCHEMA)).collect()
    assert sum("logged in" in r.text for r in out) == 1
    kept = line_dedup.drop_recurring(docs)
    assert kept.columns == [*docs.columns, "n_dropped", "n_records"]
    texts = [(r.doc_id, r.text) for r in kept.collect()]
    assert (4, "") in texts and (5, None) in texts and (6, "a b") in texts and (9, LONG) in texts
    assert line_dedup.drop_recurring(empty).count() == 0


def own_words(name, n):
    return " ".join(f"{name}{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(n))


def test_line_dedup_of_passages(spark):
    """Passages of records that are each too short or too rare, in two documents."""
    sentences = " ".join(own_words(f"sentence{chr(97 + i)}", 15) + "." for i in range(5))
    short = "\n".join(own_words(f"short{chr(97 + i)}", 5) for i in range(12))
    few = own_words("few", 12) + "."
    rows = [(i, "\n".join([own_words(f"head{chr(97 + i)}", 30), part, few, own_words(f"tail{chr(97 + i)}", 30)]), "en", "s", 0, "x", "y")
            for i, part in enumerate([sentences, sentences, short, short])]
    rows = [(i, t if i % 2 else t.replace(few, own_words(f"other{i}", 12)), *x) for i, t, *x in rows]
    out = {r.doc_id: r.text for r in line_dedup.drop_recurring(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(out) == 4
    assert sum(sentences in t for t in out.values()) == 1 and sum("sentence" in t for t in out.values()) == 1
    assert sum(short in t for t in out.values()) == 1 and sum("short" in t for t in out.values()) == 1
    assert sum(few in t for t in out.values()) == 2
    assert all(f"{x}{chr(97 + i)}" in t for i, t in out.items() for x in ("head", "tail"))


def test_line_dedup_keeps_what_it_drops_elsewhere(spark):
    """Documents that lose most of their text own a passage, or a sentence of a line, that others lose."""
    def run(rows):
        rows = [(i, t, "en", "s", 0, "x", "y") for i, t in rows]
        return [r.text for r in line_dedup.drop_recurring(spark.createDataFrame(rows, SCHEMA)).collect()]

    # every order of the documents is tried, since buckets are by hash
    big = "\n".join(own_words(f"big{chr(97 + i)}", 45) for i in range(6))
    passage = own_words("passage", 45)
    for b in range(4):
        ids = [b, *(i for i in range(4) if i != b)]
        out = run(zip(ids, [f"{big}\n{passage}", big, f"{own_words('ea', 30)}\n{passage}", f"{own_words('fa', 30)}\n{passage}"]))
        assert sum(passage in t for t in out) == 1 and sum(own_words("biga", 45) in t for t in out) == 1

    # a line that goes by a template with a variable third; the sentence in that third goes elsewhere
    start, end = own_words("start", 12) + ".", own_words("end", 12)
    owned = own_words("owned", 9) + "."
    for b in range(7):
        ids = [b, *(i for i in range(7) if i != b)]
        lines = [f"{start} {s} {end}" for s in [owned, *(own_words(f"third{chr(97 + k)}", 9) + "." for k in range(4))]]
        out = run(zip(ids, [f"{own_words(f'doc{chr(97 + k)}', 60)}\n{x}" for k, x in enumerate([*lines, f"{owned} Yes.", f"{owned} No."])]))
        assert sum(owned in t for t in out) == 1


def test_kneser_ney_sums_to_one(spark):
    counts = {"aab": 3, "aba": 2, "bab": 1, "abb": 1, "bba": 4}
    rows = [("en", g, c) for g, c in counts.items()]
    m = {r.gram: r for r in perplexity.model(spark.createDataFrame(rows, "lang string, gram string, c long"), 3).collect()}

    def p(gram):
        if gram == "":
            return math.exp(m[""].logp)
        if gram in m and m[gram].logp is not None:
            return math.exp(m[gram].logp)
        ctx = m.get(gram[:-1])
        return (math.exp(ctx.bow) if ctx else 1.0) * p(gram[1:])
    for ctx in ("aa", "ab", "ba", "bb"):
        assert sum(p(ctx + c) for c in "ab") + p(ctx + "?") == pytest.approx(1.0)


def test_perplexity(spark, docs, empty):
    good = [(i, "the cat sat on the mat and the dog ran to the cat " * 4, "en", "s", 0, "x", "y") for i in range(200)]
    bad = [(1000, "#$%&* QQQ ### " * 20, "en", "s", 0, "x", "y"), (1001, None, "en", "s", 0, "x", "y"),
           (1002, "unknown", "xx", "s", 0, "x", "y"), (None, "", None, "s", 0, "x", "y")]
    labels = spark.createDataFrame([(i, 1) for i in range(200)] + [(None, 1), (1000, 0)], "doc_id long, quality int")
    out = {r.doc_id: r for r in perplexity.classify(spark.createDataFrame(good + bad, SCHEMA), labels).collect()}
    assert len(out) == 204 and all(out[i].kept for i in range(200)) and not out[1000].kept
    assert out[1001].kept and out[1001].perplexity is None and out[1002].kept and out[None].kept
    assert perplexity.classify(empty, labels).count() == 0
    assert perplexity.classify(docs, labels.limit(0)).where("kept").count() == len(TEXTS)


def test_quality_rules(docs, empty):
    got = sorted(((r.doc_id or 0, r.n_words, r.n_repeat_words, r.n_dup_lines, r.kept) for r in quality_rules.judge(docs).collect()))
    want = []
    for d, t in TEXTS:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
        rep = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)} if len(w) < 100 else set()
        want.append((d or 0, len(w), len(rep), 0, False))
    assert got == sorted(want)
    assert quality_rules.judge(empty).count() == 0
    assert "Python" not in quality_rules.judge(docs)._jdf.queryExecution().toString()


def plain_rules(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    n = {}
    for g in grams:
        n[g] = n.get(g, 0) + 1
    rep = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep),
            len(w) < 50 or 100 * len(rep) > 50 * len(w))


def test_quality_rules_next_to_plain_counts(spark):
    """Letters and white space at both ends, and repeats in long texts."""
    rng = np.random.default_rng(0)
    texts = ["f", "ff off f", "\x0cabc def\x0c", "\x0b\t f x f\r\n", "a\x0cb\x0bc", "\u00a0f\u2003", "\x1cf\x1c", "f\nf\n\nf",
             None, "", " ", " ".join(rng.choice(list("abcdef"), 3000)), " ".join(rng.choice([f"w{k}" for k in range(400)], 20_000)),
             " ".join(f"w{k}" for k in range(70_000)) + " w5 w6 w7", "".join(rng.choice(list("f \t\n\x0b\x0cg#"), 5000))]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, n_words string")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)
           for r in quality_rules.judge(df).collect()}
    assert got == {k: plain_rules(t) for k, t in enumerate(texts)}


def test_url_rules(spark):
    urls = ["http://a.EXAMPLE.net/en/x", "https://example.net/de/", "x://shop.example.com/de/1?q", "http://b.org/fr/", "http://b.org/FR/",
            None, "", "no scheme", "http://casino-win.example.com/en/", "http://net", "http://notnet/", "http://x.net/#f", "http://x.net?y/"]
    p = spark.createDataFrame([(i, u, "z", "w") for i, u in enumerate(urls)] + [(0, urls[0], "z", "w")],
                              "page_id long, url string, rule string, host string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_rules.judge(p).collect()}
    want = [("example.net/en/", "allow"), ("net/", "block"), ("example.com/de/", "block"), ("org/fr/", "allow"), (None, "allow"), (None, "allow"),
            (None, "allow"), (None, "allow"), (None, "block"), (None, "allow"), (None, "allow"), ("net/", "block"), (None, "allow")]
    assert [got[i] for i in range(len(urls))] == want
    assert url_rules.judge(p).count() == len(urls) + 1 and url_rules.judge(p.limit(0)).count() == 0


def test_templates(spark):
    page = ("<html><head><title>t</title><style>p{{}}</style></head><body><nav><a href='/'>home</a></nav><div class='sidebar'>side</div>"
            "<div id=content><h1>Head {0}</h1><p>First &amp; {0}<p>Second <b>bold</b> {0} <script>x('</p>')</script></p>"
            "<div class=comments><p>me too</p></div></div><footer>foot</footer></body></html>")
    rows = [(i, f"http://h/{i}", page.format(" ".join(f"v{i}w{k}" for k in range(9))), "x") for i in range(6)]
    rows += [(90, None, None, "x"), (91, "http://h/z", "", "x"), (92, "http://one/", "just text &lt; <br> more", "x"), (0, "http://h/0", rows[0][2], "x")]
    p = spark.createDataFrame(rows, "page_id long, url string, html string, main string")
    out = {r.page_id: r.text for r in templates.extract(p).collect()}
    v = " ".join(f"v0w{k}" for k in range(9))
    assert out[0] == f"Head {v}\nFirst & {v}\nSecond bold {v}"
    assert out[90] == "" and out[91] == "" and out[92] == "just text <\nmore"
    assert templates.extract(p).count() == len(rows) and templates.extract(p.limit(0)).count() == 0


def test_templates_of_repeated_pages(spark):
    """Rows that are one page, and a paragraph of the article that all pages share."""
    page = "<html><body><div id=content><h1>{0}</h1><p>{1}</p><p>Shared paragraph</p></div><div>Made by us</div></body></html>"
    one = page.format("Title", own_words("only", 20))
    rows = [(i, None if i % 2 else "http://same/", one) for i in range(14)]
    rows += [(20 + i, f"http://h/{i}", page.format(f"Title {i}", own_words(f"text{chr(97 + i)}", 20))) for i in range(7)]
    p = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = {r.page_id: r.text for r in templates.extract(p).collect()}
    assert len(out) == len(rows)
    assert all(f"Title\n{own_words('only', 20)}\nShared paragraph" in out[i] for i in range(14))
    assert all(out[20 + i] == f"Title {i}\n{own_words(f'text{chr(97 + i)}', 20)}\nShared paragraph" for i in range(7))


def test_templates_keep_what_is_beside_the_main_text(spark):
    def body(i, parts):
        return f"<html><body><div class=box>Same on all pages</div>{parts}<footer>foot</footer></body></html>"

    rows, want = [], {}

    def add(host, i, html, *text):
        want[len(rows)] = "\n".join(text)
        rows.append((len(rows), f"http://{host}/{i}", body(i, html)))

    for i in range(6):
        name = chr(97 + i)
        head, intro, long = f"Head {name}", own_words(f"intro{name}", 6), own_words(f"long{name}", 40)
        add("parts", i, f"<article><h1>{head}</h1><div class=intro>{intro}</div><div class=body><p>{long}</p></div></article>", head, intro, long)
        add("wrap", i, f"<div id=page><h1>{head}</h1><div class=wrap><div class=body><p>{long}</p><p>{intro}</p></div></div></div>", head, long, intro)
        add("plain", i, f"<div id=page><div class=body><p>{long}</p><p>{intro}</p></div><div class=box>Boilerplate</div></div>", long, intro)
        add("single", i, f"<article><h1>{head}</h1><p>{long}</p><ul><li>{intro}</li></ul></article>", head, long, intro)
    add("one", 0, "<article><h1>Head</h1><p>" + own_words("one", 30) + "</p><ul><li>item</li></ul></article>",
        "Same on all pages", "Head", own_words("one", 30), "item")
    p = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in templates.extract(p).collect()} == want
