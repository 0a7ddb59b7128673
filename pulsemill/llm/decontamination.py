"""Benchmark decontamination with a generalised suffix automaton.

Words are runs of ASCII letters (lower-cased), digits and characters beyond ASCII. A window is
WINDOW consecutive words of a benchmark item; a shorter item with a word is one window. The
automaton holds all word sequences of the items. The words of a document are streamed through
it; at each word it gives the length of the longest match that ends there, so a window ends
wherever that length reaches WINDOW (or a whole short item is a suffix of the match).

The benchmark is a query set: its items are cut into segments of at most SEGMENT_WORDS words, which share
WINDOW - 1 words with the next so that every window is whole in one, and the segments are dealt into blocks of about
BLOCK_WORDS words. Each block's automaton is built in one task and broadcast, which bounds what is sent, and all
documents pass each block, several blocks in one scan. Documents are never shuffled for one scan; for several, hit
positions are merged per row.

NULL and empty texts have no words and are clean. An item that occurs twice counts as two
items. NULL item ids are left out of the id list. Extra columns are not read, except by
`clean`, which keeps them whatever their names.
"""

import hashlib
import itertools
import pickle
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from pulsemill.llm.worker import kept, release, released
from pulsemill.sources.storage import materialize

WINDOW, BLOCK_WORDS, SEGMENT_WORDS, BLOCKS_A_SCAN = 10, 200_000, 50_000, 4
MAX_SPAN, MAX_COVERAGE = 0, 0.5

_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128
               else 32 for c in range(256))


def words(text: str) -> list:
    """Normalised words as bytes."""
    return text.encode("utf-8", "surrogatepass").translate(_WORDS).split() if text else []


class Automaton:
    """Suffix automaton of several word sequences; word -1 is in none of them."""

    def __init__(self, items, window: int = WINDOW):
        self.window, self.vocab = window, {}
        self.next, self.link, self.length = [{}], [-1], [0]
        for _, ws in items:
            at = 0
            for w in ws:
                at = self._extend(at, self.vocab.setdefault(w, len(self.vocab)))
        # the items of each window, filed under the window's state and length
        self.items = {}
        for key, ws in items:
            at, size, n = 0, 0, min(window, len(ws))
            for w in ws:
                at, size = self.step(at, size, self.vocab[w])
                if size >= n:
                    self.items.setdefault((self.suffix_state(at, n), n), set()).add(key)
        self.short = {}
        for s, n in self.items:
            if n < window:
                self.short.setdefault(s, []).append(n)
        self._mark()

    def _extend(self, last, c):
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return cur

    def _clone(self, p, c, q):
        nxt, link, length = self.next, self.link, self.length
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = new
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def step(self, at, size, c):
        nxt, link, length = self.next, self.link, self.length
        while True:
            to = nxt[at].get(c)
            if to is not None:
                return to, size + 1
            at = link[at]
            if at == -1:
                return 0, 0
            size = length[at]

    def suffix_state(self, at, n):
        """The state of the last n words of a match that is at least so long."""
        while self.length[self.link[at]] >= n:
            at = self.link[at]
        return at

    def _mark(self):
        """Per state, the window sizes of short items among its suffixes."""
        self.has_short = [False] * len(self.next)
        for s in sorted(range(len(self.next)), key=self.length.__getitem__):
            self.has_short[s] = s in self.short or (s > 0 and self.has_short[self.link[s]])

    def scan(self, ws):
        """(hit spans as [start, end) pairs in order, merged; keys of the items found)."""
        spans, keys = [], set()
        get, nxt, link, length, window = self.vocab.get, self.next, self.link, self.length, self.window
        at = size = 0
        has_short = self.has_short
        for i, c in enumerate(map(get, ws)):
            if c is None:
                at = size = 0
                continue
            to = nxt[at].get(c)
            while to is None:
                at = link[at]
                if at == -1:
                    break
                size = length[at]
                to = nxt[at].get(c)
            if to is None:
                at = size = 0
                continue
            at, size = to, size + 1
            if size >= window:
                start = i + 1 - size
                keys |= self.items.get((self.suffix_state(at, window), window), _NONE)
            elif has_short[at]:
                start = None
            else:
                continue
            if has_short[at]:
                s = at
                while s > 0:
                    for n in self.short.get(s, ()):
                        if n <= size:
                            keys |= self.items[s, n]
                            start = min(i + 1 - n, i if start is None else start)
                    s = link[s]
            if start is None:
                continue
            while spans and spans[-1][1] >= start:
                start = min(start, spans.pop()[0])
            spans.append((start, i + 1))
        return spans, keys


_NONE = frozenset()


def _load(shared):
    """The broadcast automata, unpickled once per worker."""
    data = shared.value

    def load():
        release()
        out = []
        for d in data:
            made = Automaton.__new__(Automaton)
            vars(made).update(pickle.loads(d))
            out.append(made)
        return out

    return kept("automaton " + " ".join(hashlib.sha256(d).hexdigest() for d in data), load)


_SEGMENT = StructType([StructField("item", StringType()), StructField("item_id", StringType()),
                       StructField("words", StringType()), StructField("n", LongType())])


def segments(benchmark: DataFrame, window: int = WINDOW, segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """(item, item_id, words, n): the items' words in pieces of bounded length. `item` tells rows apart."""
    step = max(1, segment_words - window + 1)
    rows = benchmark.select(F.concat(F.lit("i"), F.monotonically_increasing_id().cast("string")).alias("item"),
                            F.col("item_id").cast("string").alias("item_id"), "text")

    def cut(batches):
        release()
        for b in batches:
            out = []
            for item, key, text in zip(*[b.column(c).to_pylist() for c in range(3)]):
                ws = words(text)
                for s in range(0, max(1, len(ws) - window + 1) if ws else 0, step):
                    part = ws[s:s + segment_words]
                    out.append((item, key, b" ".join(part).decode("utf-8", "replace"), len(part)))
            yield pa.RecordBatch.from_pylist([dict(zip(_SEGMENT.names, r)) for r in out],
                                             schema=to_arrow_schema(_SEGMENT))

    return rows.mapInArrow(cut, _SEGMENT)


def automata(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS):
    """Pickled automata of the benchmark's blocks, one after another."""
    b = materialize(segments(benchmark, window, min(SEGMENT_WORDS, max(window, block_words))))
    total = b.agg(F.sum("n")).first()[0]
    if not total:
        return
    blocks = max(1, -(-int(total) // block_words))
    dealt = b.withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(blocks)))

    def build(pdf):
        rows = [(i, k, w.encode().split()) for i, k, w in zip(pdf["item"], pdf["item_id"], pdf["words"])]
        made = Automaton([(i, ws) for i, _, ws in rows], window)
        made.names = {i: None if k is None else str(k) for i, k, _ in rows}
        return pd.DataFrame({"automaton": [pickle.dumps(vars(made))]})

    made = dealt.groupBy("block").applyInPandas(released(build), "automaton binary")
    for r in made.toLocalIterator():
        yield bytes(r["automaton"])


FOUND = [StructField("n_words", LongType()), StructField("spans", ArrayType(LongType())),
         StructField("items", ArrayType(StructType([StructField("item", StringType()),
                                                    StructField("name", StringType())])))]


def _merge(pairs):
    """Spans [start, end) as a flat list in order, overlapping and touching ones put together."""
    out = []
    for a, b in sorted(pairs):
        if out and out[-1] >= a:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def _scan(autos, ws):
    """(merged spans, {item: name}) of a list of words."""
    if len(autos) == 1:
        s, keys = autos[0].scan(ws)
        return [x for pair in s for x in pair], {k: autos[0].names[k] for k in keys}
    pairs, names = [], {}
    for auto in autos:
        s, keys = auto.scan(ws)
        pairs += s
        names.update((k, auto.names[k]) for k in keys)
    return _merge(pairs), names


def _scanned(docs: DataFrame, data: list, columns) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(data)
    kept = docs.select(*columns, F.col("text").alias("__text"))
    found = to_arrow_schema(StructType(FOUND))

    def run(batches):
        autos = _load(shared)
        for b in batches:
            out = []
            for t in b.column("__text"):
                ws = words(t.as_py())
                spans, names = _scan(autos, ws)
                out.append((len(ws), spans, [{"item": k, "name": names[k]} for k in sorted(names)]))
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in columns],
                 *[pa.array([r[k] for r in out], f.type) for k, f in enumerate(found)]],
                names=[*columns, *found.names])

    return kept.mapInArrow(run, StructType([kept.schema[c] for c in columns] + FOUND))


def _scans(benchmark, window, block_words):
    """Lists of automata, each for one scan of the documents; one of an empty automaton at least."""
    blocks, any_yet = automata(benchmark, window, block_words), False
    while True:
        some = list(itertools.islice(blocks, BLOCKS_A_SCAN))
        if some:
            yield some
        elif not any_yet:
            yield [pickle.dumps(vars(_empty(window)))]
            return
        else:
            return
        any_yet = True


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
         block_words: int = BLOCK_WORDS, columns=("doc_id",)) -> DataFrame:
    """The given columns, n_words, spans (starts and ends of hit words, merged) and items (item and
    its id as `name`) of every document."""
    return _found(docs, _scans(benchmark, window, block_words), list(columns))


def _found(docs, scans, columns):
    scans = iter(scans)
    first, second = next(scans), next(scans, None)
    if second is None:
        return _scanned(docs, first, columns)
    # several scans: rows are numbered once, and what the scans find is put together
    rows = materialize(docs.select(*columns, "text").withColumn("__row", F.monotonically_increasing_id()))
    found = None
    for data in itertools.chain([first, second], scans):
        part = materialize(_scanned(rows, data, ["__row"]))
        found = part if found is None else found.unionByName(part)
    pairs = """array_sort(flatten(transform(collect_list(spans), s -> transform(
        case when size(s) = 0 then array() else sequence(0, size(s) - 2, 2) end,
        k -> struct(s[k] as a, s[k + 1] as b)))))"""
    put = found.groupBy("__row").agg(
        F.max("n_words").alias("n_words"), F.expr(pairs).alias("__pairs"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    merged = F.expr("""aggregate(__pairs, cast(array() as array<bigint>), (out, p) ->
        case when size(out) > 0 and element_at(out, -1) >= p.a
             then concat(slice(out, 1, size(out) - 1), array(greatest(element_at(out, -1), p.b)))
             else concat(out, array(p.a, p.b)) end)""")
    return rows.join(put.withColumn("spans", merged), "__row").select(*columns, "n_words", "spans", "items")


def _empty(window):
    a = Automaton([], window)
    a.names = {}
    return a


def n_hit(spans="spans"):
    return F.expr(f"cast(coalesce(aggregate(transform({spans}, (x, i) -> case when i % 2 = 1 then x else -x end),"
                  " 0L, (a, x) -> a + x), 0L) as bigint)")


def digest(found: DataFrame) -> DataFrame:
    """The columns of the query: counts, and a digest of the item ids found."""
    names = F.array_sort(F.filter(F.col("items.name"), lambda x: x.isNotNull()))
    return found.select(
        "doc_id", "n_words", n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_span: int = MAX_SPAN,
          max_coverage: float = MAX_COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Documents without their hit spans of more than `max_span` words.

    Documents with more than `max_coverage` of their words hit, and those left without a word,
    are removed. What stands on both sides of a cut may make a window, so cut texts are looked at again until
    nothing is hit. All columns are kept; n_chars, where present, is set anew for changed texts.
    """
    cols = docs.columns
    # The columns travel as one struct, so that no name of theirs meets one of ours.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"), "text")
    scans = list(_scans(benchmark, window, block_words))
    if len(scans) == 1:
        done = _cleaned(rows, scans[0], max_span, max_coverage)
    else:
        done = _cleaned_in_rounds(rows, scans, max_span, max_coverage)

    def column(c):
        value = F.col("row").getField(c)
        if c == "text":
            return F.when(F.col("changed"), F.col("text")).otherwise(value).alias(c)
        if c == "n_chars":
            new = F.length("text").cast(docs.schema[c].dataType)
            return F.when(F.col("changed"), new).otherwise(value).alias(c)
        return value.alias(c)

    return done.select(*[column(c) for c in cols])


def _cleaned(rows, autos, max_span, max_coverage):
    """(row, text, changed) of the documents that stay, in one scan."""
    shared = rows.sparkSession.sparkContext.broadcast(autos)

    def run(batches):
        autos = _load(shared)
        for b in batches:
            at, texts, changed = [], [], []
            for k, t in enumerate(b.column("text")):
                t = t.as_py()
                ws = words(t)
                spans, _ = _scan(autos, ws)
                hit = sum(spans[1::2]) - sum(spans[::2])
                if hit > len(ws) * max_coverage:
                    continue
                cut, new = _without(t, spans, max_span), False
                while cut is not None:  # each round takes words out, so this ends
                    t, new = cut, True
                    cut = _without(t, _scan(autos, words(t))[0], max_span)
                if new and not words(t):
                    continue
                at.append(k)
                texts.append(t)
                changed.append(new)
            yield pa.RecordBatch.from_arrays(
                [b.column("row").take(pa.array(at, pa.int64())), pa.array(texts, pa.string()),
                 pa.array(changed, pa.bool_())], names=["row", "text", "changed"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("changed", BooleanType())]))


def _cleaned_in_rounds(rows, scans, max_span, max_coverage):
    """The same where several scans are needed: the texts cut in one round are scanned in the next."""
    cut = F.pandas_udf(_cut, "string")
    found = materialize(_found(rows, scans, ["row", "text"]).where(n_hit() <= F.col("n_words") * max_coverage))
    out, changed = None, False
    while True:
        new = cut("text", "spans", F.lit(max_span))
        still = found.select("row", new.alias("text")).where(F.col("text").isNotNull())
        same = found.where(new.isNull()).select("row", "text", "n_words", F.lit(changed).alias("changed"))
        same = same.where(~F.col("changed") | (F.col("n_words") > 0)).drop("n_words")
        out = same if out is None else out.unionByName(same)
        still = materialize(still)
        if not still.limit(1).count():
            return out
        found, changed = materialize(_found(still, scans, ["row", "text"])), True


_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _without(text, spans, longest):
    """The text without its spans of more than `longest` words; None where there are none."""
    spans = [(a, b) for a, b in zip(spans[::2], spans[1::2]) if b - a > longest]
    if not spans:
        return None
    at = [m.span() for m in _WORD.finditer(text)]
    parts, last = [], 0
    for a, b in spans:
        parts.append(text[last:at[a][0]])
        last = at[b - 1][1]
    return "".join([*parts, text[last:]])


def _cut(text: pd.Series, spans: pd.Series, longest: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else _without(t, s, limit) for t, s, limit in zip(text, spans, longest)],
                     dtype=object)
