"""Near-duplicate documents from bottom-k sketches.

A document is the set of its distinct 5-word shingles (see `shingles`). Documents with equal sets
are one class. The sketch of a class is the SKETCH smallest values of one hash function over
its set. Inverted lists of sketch values bring classes together, with three exact or nearly
exact savings:

- a value that one class alone has opens no list, and the values of a sketch are taken rarest
  first: two sketches that share at least t values share one among the first (size - t + 1) of
  each. For sets whose union fits into the sketch t follows from the similarity; for larger ones it
  is the expected overlap less SIGMAS standard deviations, and the lesser of both where either may be;
- a list is cut by set size, since similar sets have similar sizes;
- members of a list are first compared with one pivot each, in several turns; only members that are
  still in different components afterwards are compared with each other, each pair in one list.
  Short lists give pairs; long ones are cut into parts of bounded size, and every two parts meet
  in a task that counts the overlaps of full sets and returns links alone. Where a large family
  of texts is just below the limit with each other, that is still a large share of its pairs.

The similarity of candidate pairs is estimated from the union of their sketches, and pairs that
are not far below the limit are confirmed on their full sets, from their texts.

NULL and empty texts have no shingles and no links. Rows with a NULL doc_id are not linked and
are kept. Rows with the same doc_id are separate texts of one document id. Repeated rows fall into
one class. Extra columns are not read.
"""

from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from pulsemill.llm import batches
from pulsemill.llm.components import components
from pulsemill.llm.worker import kept, released, released_stream
from pulsemill.sources.storage import materialize, scratch_path

WORDS, PERCENT = 5, 75
SKETCH, ESTIMATE, SIGMAS = 128, 48, 5.0
BUCKET_CLASSES, TURNS = 5_000, 2
FIRST, SHORT, PART, COLUMNS = 4, 50, 100_000, 2_048
HASHES_KEPT, TEXTS_AT_ONCE = 50_000, 100


class _Hashes(dict):
    def __missing__(self, word):
        h = xxhash.xxh64_intdigest(word)
        if len(self) >= HASHES_KEPT:
            self.clear()
        self[word] = h
        return h


_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts) -> list:
    """The sorted distinct shingle hashes of every text.

    A-Z are lower-cased; words are runs without ASCII white space; a shingle is 5 words, or all
    words of a shorter text.
    """
    hashes = kept("word hashes", _Hashes)
    words = [t.encode("utf-8", "surrogatepass").lower().split() if t else [] for t in texts]
    sizes = [len(w) for w in words]
    flat = np.fromiter((h for w in words for h in map(hashes.__getitem__, w)), np.uint64, sum(sizes))
    n = len(flat) - WORDS + 1
    rolled = np.zeros(max(n, 0), np.uint64)
    for j in range(WORDS if n > 0 else 0):
        rolled = rolled * _MULTIPLIER + flat[j:j + n]
    rolled = batches.mix(rolled)
    out, at = [], 0
    for size in sizes:
        if size >= WORDS:
            out.append(np.unique(rolled[at:at + size - WORDS + 1]))
        elif size:
            h = np.array([size], np.uint64)
            for x in flat[at:at + size]:
                h = h * _MULTIPLIER + x
            out.append(batches.mix(h))
        else:
            out.append(np.zeros(0, np.uint64))
        at += size
    return out


def _slices(batch):
    for lo in range(0, batch.num_rows, TEXTS_AT_ONCE):
        yield batch.slice(lo, TEXTS_AT_ONCE)


def _node(values: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(values.tobytes())).view(np.int64))


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, node (hash of the set), and the sketch in the first row of each node
    in a task's batch."""
    @released_stream
    def run(stream):
        for b in stream:
            for part in _slices(b):
                sets = shingle_sets(part.column("text").to_pylist())
                nodes = [_node(s) if len(s) else None for s in sets]
                seen, kept = set(), []
                for node, s, d in zip(nodes, sets, part.column("doc_id").to_pylist()):
                    new = node is not None and d is not None and node not in seen
                    seen.add(node) if new else None
                    kept.append(s[:SKETCH].tobytes() if new else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array(nodes, pa.int64()), pa.array(kept, pa.binary())],
                    names=["doc_id", "n_shingles", "node", "sketch"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_shingles long, node long, sketch binary")


def least_shared(n: int, sketch: int = SKETCH, percent: int = PERCENT) -> int:
    """Sketch values that a class of n shingles shares with any class it is linked with."""
    q = percent / 100
    # a union that fits into the sketch leaves the intersection, which this may be all of
    whole = -(-n * percent // 100)
    if n <= int(q * sketch):
        return whole
    # the union of two linked sets has at most n / q members, of which the sketch is a part
    union = max(n / q, sketch + 1)
    spread = (sketch * q * (1 - q) * (union - sketch) / (union - 1)) ** 0.5
    part = max(1, int(q * sketch - SIGMAS * spread) - 1)
    return min(whole, part) if n <= sketch else part


def list_entries(t1: DataFrame, rows: int) -> DataFrame:
    """(value, node, n): the rare shared values under which each class is filed."""
    buckets = max(1, -(-rows // BUCKET_CLASSES))
    shards = max(1, -(-rows * SKETCH // 4_000_000))
    own = (t1.where("sketch is not null").select("node", "n_shingles", "sketch")
           .withColumn("bucket", F.pmod("node", F.lit(buckets)).cast("long")))

    def classes(pdf):
        return pdf.drop_duplicates("node")

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        every = np.concatenate([np.frombuffer(s, np.uint64) for s in classes(pdf)["sketch"]])
        keys, counts = np.unique(every, return_counts=True)
        return batches.ask(int(pdf["bucket"].iloc[0]), keys, counts, shards)

    answers = batches.totals(own.groupBy("bucket").applyInPandas(released(count), batches.ASKED), 2)

    def prefix(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        values, nodes, sizes = [], [], []
        if len(left) and len(right):
            keys, totals = batches.merged(right, ("totals", np.uint32))
            pdf = classes(left)
            for node, n, s in zip(pdf["node"], pdf["n_shingles"], pdf["sketch"]):
                v = np.frombuffer(s, np.uint64)
                at = batches.find(keys, v)
                shared = v[at >= 0]
                room = len(shared) - least_shared(n) + 1
                if room > 0:
                    rare = shared[np.lexsort((shared, totals[at[at >= 0]]))[:room]]
                    values.append(rare)
                    nodes.append(np.full(len(rare), node))
                    sizes.append(np.full(len(rare), n))
        if not values:
            return pd.DataFrame({"value": [], "node": [], "n": []}, dtype="int64")
        return pd.DataFrame({"value": np.concatenate(values).view(np.int64),
                             "node": np.concatenate(nodes), "n": np.concatenate(sizes)})

    return own.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInPandas(
        released(prefix), "value long, node long, n long")


def _bands(entries: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Each entry in two overlapping size bands; sizes that may be linked share one."""
    b = F.floor(F.log(F.col("n").cast("double")) / float(-np.log(percent / 100)) + 1e-9).cast("long")
    return entries.withColumn("own", b).withColumn("band", F.explode(F.array(b, b - 1)))


def _sized(a="n", b="m"):
    return (F.col(a) * 100 >= F.col(b) * PERCENT) & (F.col(b) * 100 >= F.col(a) * PERCENT)


def _mixed(entries: DataFrame, labels) -> DataFrame:
    """The entries of lists whose members are not all in one component, with their labels."""
    if labels is None:
        return entries.withColumn("label", F.col("node"))
    own = entries.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = (own.groupBy("value", "band").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
             .where("lo <> hi").select("value", "band"))
    return own.join(mixed, ["value", "band"], "left_semi")


def _stars(entries: DataFrame, turn: int) -> DataFrame:
    """Each member of a list with the list's pivot of this turn, where they are still apart."""
    order = F.xxhash64(F.col("node"), F.lit(turn))
    pivots = entries.groupBy("value", "band").agg(F.min(F.struct(
        order.alias("h"), F.col("node").alias("p"), F.col("n").alias("m"), F.col("label").alias("other"))).alias("x"),
        F.count(F.lit(1)).alias("k")).where("k > 1").select("value", "band", "x.p", "x.m", "x.other")
    pairs = entries.join(pivots, ["value", "band"]).where(F.col("label") != F.col("other")).where(_sized())
    return pairs.select(F.least("node", "p").alias("a"), F.greatest("node", "p").alias("b")).distinct()


def _homes(own: DataFrame) -> DataFrame:
    """Add the size of each list and the FIRST longest lists of each member.

    Lists stand in one order, longest first. A pair is looked at in the earliest list that is
    among the first of both, its home; a pair without one, which is rare, in every list that
    both are in.
    """
    sizes = own.groupBy("value", "band").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("total"))
    mine = Window.partitionBy("node", "band")
    ranked = own.join(sizes, ["value", "band"]).withColumn(
        "rank", F.row_number().over(mine.orderBy(F.desc("k"), "value")))
    return ranked.withColumns({
        f"f{i}": F.max(F.when(F.col("rank") == i + 1, F.col("value"))).over(mine) for i in range(FIRST)})


def _apart(own: DataFrame) -> DataFrame:
    """Pairs of short lists, and pairs without a home, whose members are not in one component."""
    other = own.select("value", "band", F.col("node").alias("p"), F.col("n").alias("m"), F.col("label").alias("other"),
                       F.col("own").alias("theirs"), F.col("rank").alias("rank_p"),
                       *[F.col(f"f{i}").alias(f"g{i}") for i in range(FIRST)])

    def meet(also=lambda i: F.lit(True)):
        return F.coalesce(reduce(or_, [(F.col(f"f{i}") == F.col(f"g{j}")) & also(i)
                                       for i in range(FIRST) for j in range(FIRST)]), F.lit(False))

    home = ((F.col("k") <= SHORT) & (F.col("rank") <= FIRST) & (F.col("rank_p") <= FIRST)
            & ~meet(lambda i: F.col("rank") > i + 1))
    # members of one band meet in two bands; the upper one is theirs
    pairs = own.join(other, ["value", "band"]).where(
        (F.col("node") < F.col("p")) & (F.col("label") != F.col("other")) & (F.col("band") == F.least("own", "theirs"))
        & _sized() & (home | ~meet()))
    return pairs.select(F.col("node").alias("a"), F.col("p").alias("b")).distinct()


def _common(sets: list, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets in `rows` with those in `cols`."""
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, ids, counts = np.unique(every, return_inverse=True, return_counts=True)
    again = np.flatnonzero(counts > 1)
    place = np.full(len(counts), -1)
    place[again] = np.arange(len(again))
    at = place[ids]
    owner, at = owner[at >= 0], at[at >= 0]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    out = np.zeros((len(rows), len(cols)), np.float32)
    for lo in range(0, len(again), COLUMNS):
        i, j = np.searchsorted(at, [lo, lo + COLUMNS])
        has = np.zeros((len(sets), min(COLUMNS, len(again) - lo)), np.float32)
        has[owner[i:j], at[i:j] - lo] = 1
        out += has[rows] @ has[cols].T
    return out.astype(np.int64)


def _tiled(own: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between members of long lists that are not in one component, from full sets.

    A list is dealt into parts of about PART shingles, and every two parts meet in a task of their
    own, so a task holds two parts however long the list is; only confirmed links leave it.
    """
    parts = F.ceil(F.col("total") / PART).cast("long")
    long = own.where((F.col("k") > SHORT) & (F.col("rank") <= FIRST)).withColumn(
        "part", F.pmod(F.xxhash64("node", "value"), parts))
    dealt = long.join(texts, "node").select(
        "value", "band", "node", "label", "own", "rank", "part", "packed", *[f"f{i}" for i in range(FIRST)],
        F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("with"))
    dealt = dealt.withColumns({"lo": F.least("part", "with"), "hi": F.greatest("part", "with")}).drop("with")

    @released
    def meet(t: pa.Table) -> pa.Table:
        part, lo, hi = (t.column(c).to_numpy() for c in ("part", "lo", "hi"))
        node, label, band_of = (t.column(c).to_numpy() for c in ("node", "label", "own"))
        band = t.column("band")[0].as_py()
        rows, cols = np.flatnonzero(part == lo), np.flatnonzero(part == hi)
        firsts = zip(t.column("rank").to_pylist(), *(t.column(f"f{i}").to_pylist() for i in range(FIRST)))
        before = [np.array(f[:rank - 1], np.int64) for rank, *f in firsts]
        ok = label[rows][:, None] != label[cols][None, :]
        ok &= np.minimum(band_of[rows][:, None], band_of[cols][None, :]) == band
        if lo[0] == hi[0]:
            ok &= node[rows][:, None] < node[cols][None, :]
        if ok.any():
            ok &= _common(before, rows, cols) == 0
        a, b = rows[:0], cols[:0]
        if ok.any():
            sets = []
            packed = t.column("packed")
            for i in range(0, len(packed), 100):
                sets += shingle_sets([_unzip(x.as_py()) for x in packed[i:i + 100]])
            sizes = np.array([len(s) for s in sets], np.int64)
            both = _common(sets, rows, cols)
            union = sizes[rows][:, None] + sizes[cols][None, :] - both
            x, y = np.nonzero(ok & (100 * both >= PERCENT * union))
            a, b = rows[x], cols[y]
        return pa.table({"a": pa.array(np.minimum(node[a], node[b]), pa.int64()),
                         "b": pa.array(np.maximum(node[a], node[b]), pa.int64())})

    return dealt.groupBy("value", "band", "lo", "hi").applyInArrow(meet, "a long, b long").distinct()


def _alike(a: bytes, b: bytes, n: int, m: int) -> bool:
    """Whether the bottom of the sketches' union leaves room for a link."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    k = min(ESTIMATE, len(x) if n > len(x) else ESTIMATE, len(y) if m > len(y) else ESTIMATE)
    union = np.union1d(x, y)[:k]
    both = np.intersect1d(np.intersect1d(x, y, True), union, True)
    q = PERCENT / 100
    return len(both) >= q * len(union) - SIGMAS * (len(union) * q * (1 - q)) ** 0.5


def confirm(pairs: DataFrame, heads: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    def side(name, df, col):
        return df.select(F.col("node").alias(name), F.col(col).alias(f"{col}_{name}"),
                         *([F.col("n").alias(f"n_{name}")] if col == "head" else []))

    near = pairs.join(side("a", heads, "head"), "a").join(side("b", heads, "head"), "b")

    @released_stream
    def estimate(stream):
        for t in stream:
            ok = [_alike(*x) for x in zip(*(t.column(c).to_pylist() for c in ("head_a", "head_b", "n_a", "n_b")))]
            yield t.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    near = near.mapInArrow(estimate, "a long, b long")
    full = near.join(side("a", texts, "packed"), "a").join(side("b", texts, "packed"), "b")

    @released_stream
    def verify(stream):
        held = {}

        def get(node, data):
            s = held.get(node)
            if s is None:
                if len(held) >= 200:
                    held.clear()
                s = held[node] = shingle_sets([_unzip(data)])[0]
            return s

        for t in stream:
            ok = []
            for part in _slices(t):
                for a, b, x, y in zip(*(part.column(c).to_pylist() for c in ("a", "b", "packed_a", "packed_b"))):
                    u, v = get(a, x), get(b, y)
                    both = len(np.intersect1d(u, v, True))
                    ok.append(100 * both >= PERCENT * (len(u) + len(v) - both))
            yield t.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return full.mapInArrow(verify, "a long, b long")


def _unzip(data: bytes) -> str:
    return zstandard.ZstdDecompressor().decompress(
        data, max_output_size=max(1, zstandard.frame_content_size(data))).decode("utf-8", "surrogatepass")


def candidate_texts(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """(node, packed): the compressed text of every class that has a list entry."""
    @released_stream
    def squeeze(stream):
        z = zstandard.ZstdCompressor(level=1)
        for b in stream:
            packed = [z.compress((t or "").encode("utf-8", "surrogatepass"))
                      for part in _slices(b) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(packed, pa.binary())], names=["doc_id", "packed"])

    small = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(squeeze, "doc_id long, packed binary")

    @released_stream
    def same(stream):
        # a doc_id may stand for several texts
        for b in stream:
            ok = []
            for part in _slices(b):
                sets = shingle_sets([_unzip(x) for x in part.column("packed").to_pylist()])
                ok += [len(s) > 0 and _node(s) == n for s, n in zip(sets, part.column("node").to_pylist())]
            yield b.select(["node", "packed"]).filter(pa.array(ok, pa.bool_()))

    found = small.join(reps.select(F.col("rep").alias("doc_id"), "node"), "doc_id").select("node", "packed")
    return found.mapInArrow(same, "node long, packed binary").dropDuplicates(["node"])


def link(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row."""
    spark = docs.sparkSession
    path = scratch_path(spark, "sketches")
    sketches(docs).write.parquet(path)
    t1 = spark.read.parquet(path)
    rows = t1.where("sketch is not null").count()
    firsts = t1.where("node is not null and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("rep"))
    labels = None
    entries = batches.stored(_bands(list_entries(t1, rows)), "entries") if rows else None
    if entries is not None and entries.limit(1).count():
        nodes = materialize(entries.select("node").distinct())
        reps = materialize(firsts.join(nodes, "node", "left_semi"))
        texts = batches.stored(candidate_texts(docs, reps), "texts")
        heads = materialize(t1.where("sketch is not null").join(nodes, "node", "left_semi").dropDuplicates(["node"]).select(
            "node", F.col("n_shingles").alias("n"), F.expr(f"substring(sketch, 1, {8 * ESTIMATE})").alias("head")))
        links = None
        for turn in range(TURNS):
            entries = batches.stored(_mixed(entries, labels), "entries").select("value", "band", "own", "node", "n", "label")
            found = materialize(confirm(_stars(entries, turn), heads, texts))
            links = found if links is None else links.unionByName(found)
            labels = components(links)
            entries = entries.drop("label")
        own = batches.stored(_homes(_mixed(entries, labels)), "entries")
        links = links.unionByName(materialize(_tiled(own, texts)))
        links = links.unionByName(materialize(confirm(_apart(own), heads, texts)))
        labels = components(links)
    ids = firsts
    if labels is not None:
        named = firsts.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        least = named.groupBy("label").agg(F.min("rep").alias("component_id"))
        ids = named.join(least, "label").select("node", "component_id")
    else:
        ids = firsts.select("node", F.col("rep").alias("component_id"))
    out = t1.select("doc_id", "n_shingles", "node").join(ids, "node", "left")
    own = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), own.eqNullSafe(F.col("doc_id")).alias("kept"))
