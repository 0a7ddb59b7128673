"""Quality by perplexity under an interpolated modified Kneser-Ney model of characters.

For each language a model of ORDER characters is trained on the text of documents marked as good,
with three discounts per order taken from the counts of counts; lower orders count different left
neighbours. White space is one blank and digits are one sign; letter case and symbols count.
One in CALIBRATE trusted documents is kept out of the counts and gives the limits: a document
is rejected if its perplexity is above its language's limit, which lies MARGIN times the distance
between the middle and the UPPER quantile above the middle of those documents. SLACK nats of a
text are free, since a few characters say little.

The n-grams of all trusted documents are counted. Scoring is a sharded join: every bucket of
documents asks for each of its distinct n-grams once, the shard that owns an n-gram answers with
its probability and back-off weight, and the bucket then sums over its documents. No counts
or texts pass the driver, only limits and a filter of bounded size over the labelled ids.

NULL and empty texts, and languages without a trusted text, have no perplexity and are kept (NULL
languages are one language). Languages with fewer than MIN_CALIBRATION held-back documents use
the widest limit of the others, or none. Repeated rows are scored each. Result columns replace input
columns of the same names; all other columns are kept.
"""

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import (BinaryType, BooleanType, DoubleType, LongType, StructField,
                               StructType)

from pulsemill.llm import batches
from pulsemill.llm.worker import released

ORDER, CALIBRATE, MIN_CALIBRATION = 4, 5, 10
MIDDLE, UPPER, MARGIN, SLACK = 0.5, 0.98, 2.5, 12.0
START, NO_LANGUAGE = "\x02", "\x00"
MODEL_SHARD, SLICE_CHARS, BUCKET_CHARS = 300_000, 1_000_000, 10_000_000

_SPACE, _DIGIT = re.compile(r"\s+"), re.compile(r"\d")
RESULT = [("perplexity", DoubleType()), ("perplexity_limit", DoubleType()), ("kept", BooleanType())]


def normal(text: str) -> str:
    return _DIGIT.sub("0", _SPACE.sub(" ", text)).replace("\0", "\1").strip()


class Grams:
    """The distinct n-grams of some texts: windows of code points, and where each one stands."""

    def __init__(self, texts, order: int):
        pad = START * (order - 1)
        data = np.frombuffer("".join(pad + t for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.sizes = np.array([len(t) for t in texts], np.int64)
        starts = np.cumsum(self.sizes + order - 1) - self.sizes - (order - 1)
        n = int(self.sizes.sum())
        # the first code point of each window; windows never cross texts
        at = np.arange(n, dtype=np.int32)
        at += np.repeat((starts - (np.cumsum(self.sizes) - self.sizes)).astype(np.int32), self.sizes)
        ch, alphabet = pd.factorize(data)
        ch = ch.astype(np.int32)
        code, span, width = ch[at].astype(np.int64), len(alphabet), max(1, len(alphabet))
        for j in range(1, order):
            if span > (1 << 62) // width:
                code, found = pd.factorize(code)
                span = len(found)
            code = code * width + ch[at + j]
            span *= width
        self.codes, found = pd.factorize(code)
        self.codes = self.codes.astype(np.int32)
        del code, ch
        first = np.empty(len(found), np.int64)
        first[self.codes[::-1]] = at[::-1]
        self.windows = data[first[:, None] + np.arange(order)] if n else np.zeros((0, order), np.uint32)

    def counts(self):
        return np.bincount(self.codes, minlength=len(self.windows))

    def per_text(self, values):
        """Sum of a value per window over the characters of each text."""
        ends = np.concatenate([[0.0], np.cumsum(values[self.codes])])
        last = np.cumsum(self.sizes)
        return ends[last] - ends[last - self.sizes]


def gram_keys(lang: str, windows: np.ndarray) -> np.ndarray:
    """uint64 keys of rows of code points (of any one length, also none)."""
    import xxhash
    h = np.full(len(windows), xxhash.xxh64_intdigest(f"{windows.shape[1]}:{lang}"), np.uint64)
    for j in range(windows.shape[1]):
        h = batches.mix(h * np.uint64(0x9E3779B97F4A7C15) + windows[:, j].astype(np.uint64) + np.uint64(1))
    return h


def _strings(windows):
    if not len(windows):
        return pa.array([], pa.string())
    return pa.array(np.ascontiguousarray(windows).view(f"<U{windows.shape[1]}").ravel(), pa.string())


def _by_language(t: pa.Table):
    """(language, [(row, normal text)]) in slices of a bounded number of characters; the slices
    of a table depend only on its rows."""
    langs = t.column("lang").to_pylist() if "lang" in t.column_names else [None] * t.num_rows
    groups, out = {}, []
    for i, (lang, text) in enumerate(zip(langs, t.column("text"))):
        s = normal(text.as_py() or "")
        if s:
            lang = NO_LANGUAGE if lang is None else str(lang)
            part = groups.setdefault(lang, [0, []])
            part[0] += len(s)
            part[1].append((i, s))
            if part[0] >= SLICE_CHARS:
                out.append((lang, groups.pop(lang)[1]))
    return out + [(lang, part[1]) for lang, part in groups.items()]


def _held_back(doc_id="doc_id"):
    return F.pmod(F.xxhash64(F.col(doc_id).cast("long")), F.lit(CALIBRATE)) == 0


def _good(labels: DataFrame) -> DataFrame:
    return (labels.where("quality = 1 and doc_id is not null")
            .select(F.col("doc_id").cast("long").alias("doc_id")).distinct())


def count_grams(docs: DataFrame, labels: DataFrame, buckets: int, order: int) -> DataFrame:
    """(lang, gram, c) over all trusted documents that are not held back."""
    good = _good(labels).where(~_held_back())
    docs = docs.select("doc_id", "text", *[c for c in ("lang",) if c in docs.columns])
    packed = batches.packed(docs, buckets, only=batches.sieve(good, "doc_id"))
    good = good.withColumn("bucket", batches.bucket_of(buckets))

    kind = pa.schema([("lang", pa.string()), ("gram", pa.string()), ("c", pa.int64())])

    @released
    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [kind.empty_table()]
        if left.num_rows and right.num_rows:
            trusted = right.column("doc_id").unique()
            t = pa.concat_tables([u.filter(pc.is_in(u.column("doc_id").cast(pa.int64()), trusted))
                                  for u in map(batches.unpack_rows, left.column("rows").to_pylist())])
            for lang, texts in _by_language(t):
                g = Grams([s for _, s in texts], order)
                out.append(pa.Table.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), len(g.windows)),
                                                 _strings(g.windows), pa.array(g.counts().astype(np.int64))], schema=kind))
                del g
        return pa.concat_tables(out)

    made = packed.groupBy("bucket").cogroup(good.groupBy("bucket")).applyInArrow(
        count, "lang string, gram string, c long")
    return made.groupBy("lang", "gram").agg(F.sum("c").alias("c"))


def model(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(lang, gram, logp, bow): interpolated probability of the last character of each seen gram
    after the others, and the weight that the gram leaves to shorter contexts. The empty gram
    stands for a character never seen."""
    levels = {order: batches.stored(counts, "grams")}
    for k in range(order - 1, 0, -1):
        longer = levels[k + 1]
        levels[k] = batches.stored(longer.groupBy("lang", F.expr("substring(gram, 2)").alias("gram"))
                                   .agg(F.count(F.lit(1)).alias("c")), "grams")
    size = levels[1].groupBy("lang").agg((F.count(F.lit(1)) + 1).alias("v"))
    lower = size.select("lang", F.lit("").alias("gram"), (1.0 / F.col("v")).alias("p"))
    out = None
    for k in range(1, order + 1):
        g = levels[k]
        n = [F.sum(F.when(F.col("c") == i, 1).otherwise(0)).cast("double") for i in range(1, 5)]
        d = g.groupBy("lang").agg(*[x.alias(f"n{i}") for i, x in enumerate(n, 1)])
        y = F.col("n1") / F.greatest(F.lit(1.0), F.col("n1") + 2 * F.col("n2"))

        def discount(i):
            a, b = F.col(f"n{i}"), F.col(f"n{i + 1}")
            raw = F.when(a > 0, i - (i + 1) * y * b / F.greatest(a, F.lit(1.0))).otherwise(0.5)
            return F.greatest(F.lit(0.1), F.least(F.lit(float(i)) - 0.05, raw))

        d = d.select("lang", *[discount(i).alias(f"d{i}") for i in (1, 2, 3)])
        g = g.withColumn("ctx", F.expr(f"substring(gram, 1, {k - 1})"))
        cut = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        g = g.join(F.broadcast(d), "lang").withColumn("cut", F.least(cut, F.col("c").cast("double")))
        ctx = g.groupBy("lang", "ctx").agg(F.sum("c").cast("double").alias("s"), F.sum("cut").alias("left"))
        ctx = ctx.select("lang", "ctx", "s", (F.col("left") / F.col("s")).alias("bow"))
        short = lower.select("lang", F.col("gram").alias("tail"), F.col("p").alias("q"))
        g = (g.withColumn("tail", F.expr("substring(gram, 2)")).join(ctx, ["lang", "ctx"])
             .join(short, ["lang", "tail"]))
        g = g.select("lang", "gram", ((F.col("c") - F.col("cut")) / F.col("s") + F.col("bow") * F.col("q")).alias("p"))
        bows = ctx.select("lang", F.col("ctx").alias("gram"), "bow")
        # the weights belong to the grams of the level below
        done = lower.join(bows, ["lang", "gram"], "left").select(
            "lang", "gram", F.log("p").alias("logp"), F.log(F.coalesce("bow", F.lit(1.0))).alias("bow"))
        if k > 1:
            # contexts at the start of a text occur before a character but never as one
            extra = bows.join(lower, ["lang", "gram"], "left_anti").select(
                "lang", "gram", F.lit(None).cast("double").alias("logp"), F.log("bow").alias("bow"))
            done = done.unionByName(extra)
        lower = batches.stored(g, "model")
        out = done if out is None else out.unionByName(done)
    return out.unionByName(lower.select("lang", "gram", F.log("p").alias("logp"), F.lit(0.0).alias("bow")))


def model_shards(m: DataFrame) -> tuple:
    """The model as one packed row per shard, and the number of shards."""
    m = batches.stored(m, "model")
    shards = max(1, -(-m.count() // MODEL_SHARD))

    def key(batches_):
        for b in batches_:
            pdf = b.to_pandas()
            keys = np.zeros(len(pdf), np.uint64)
            for (lang, n), part in pdf.groupby(["lang", pdf["gram"].str.len()]).indices.items():
                text = "".join(pdf["gram"].iloc[part])
                w = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(part), n)
                keys[part] = gram_keys(lang, w)
            shard = (keys >> np.uint64(40)) % np.uint64(shards)
            yield pa.RecordBatch.from_pydict({
                "shard": pa.array(shard.astype(np.int64)), "key": pa.array(keys.view(np.int64)),
                "logp": pa.array(pdf["logp"].to_numpy(np.float64), from_pandas=True),
                "bow": pa.array(pdf["bow"].to_numpy(np.float64))})

    return m.mapInArrow(key, "shard long, key long, logp double, bow double"), shards


ANSWER = StructType([StructField("bucket", LongType()), StructField("shard", LongType()),
                     StructField("values", BinaryType())])


def _wanted(lang, windows):
    """Keys of all suffixes of the windows and of their contexts."""
    order, parts = windows.shape[1], []
    for k in range(1, order + 1):
        parts.append(gram_keys(lang, windows[:, order - k:]))
        parts.append(gram_keys(lang, windows[:, order - k:order - 1]))
    parts.append(gram_keys(lang, windows[:1, :0]))
    return parts


def _bucket_grams(blobs, order):
    """The bucket's documents in one table, its n-grams by language, and the keys to ask for."""
    t = pa.concat_tables([batches.unpack_rows(b) for b in blobs])
    made = []
    for lang, texts in _by_language(t):
        made.append((lang, [i for i, _ in texts], Grams([s for _, s in texts], order)))
    parts = [np.unique(np.concatenate(_wanted(lang, g.windows))) for lang, _, g in made]
    keys = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
    return t, made, keys


def answers(packed: DataFrame, m: DataFrame, shards: int, order: int) -> DataFrame:
    """For each bucket and shard, the values of the keys asked for, in the order of the keys."""
    @released
    def want(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = _bucket_grams(pdf["rows"], order)[2]
        return batches.ask(int(pdf["bucket"].iloc[0]), keys, None, shards)

    asked = packed.groupBy("bucket").applyInPandas(want, batches.ASKED)

    @released
    def look(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        keys = right["key"].to_numpy(np.int64).view(np.uint64)
        by = np.argsort(keys)
        keys = keys[by]
        values = np.stack([right["logp"].to_numpy(np.float32)[by], right["bow"].to_numpy(np.float32)[by]], 1)
        out = []
        for b, s, k in zip(left["bucket"], left["shard"], left["keys"]):
            at = batches.find(keys, np.frombuffer(k, np.uint64))
            v = np.full((len(at), 2), np.nan, np.float32)
            v[at >= 0] = values[at[at >= 0]]
            out.append((b, s, v.astype(np.float16).tobytes()))
        return pd.DataFrame(out, columns=["bucket", "shard", "values"])

    # a shard's questions are split over parts, each with its own copy of the shard's entries
    parts = F.lit(ASK_PARTS)
    asked = asked.withColumn("part", F.pmod("bucket", parts))
    copies = m.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(ASK_PARTS - 1).cast("long"))))
    return asked.groupBy("shard", "part").cogroup(copies.groupBy("shard", "part")).applyInPandas(look, ANSWER)


ASK_PARTS = 2


def scored(docs: DataFrame, m: DataFrame, shards: int, buckets: int, order: int, limits: dict) -> DataFrame:
    """All documents with perplexity, perplexity_limit and kept."""
    packed = batches.packed(docs, buckets)
    replies = answers(packed, m, shards, order)
    names = [n for n, _ in RESULT]
    schema = StructType([f for f in docs.schema.fields if f.name not in names]
                        + [StructField(n, t) for n, t in RESULT])

    @released
    def score(left: pd.DataFrame, right: pd.DataFrame):
        if not len(left):
            return pd.DataFrame()
        t, made, keys = _bucket_grams(left["rows"], order)
        shard = (keys >> np.uint64(40)) % np.uint64(shards)
        values = np.full((len(keys), 2), np.nan)
        for s, v in zip(right["shard"], right["values"]):
            values[shard == s] = np.frombuffer(v, np.float16).reshape(-1, 2)
        perplexity = [None] * t.num_rows
        for lang, rows, g in made:
            def of(w):
                return values[batches.find(keys, gram_keys(lang, w))]
            unseen = of(g.windows[:1, :0])[0, 0]
            if np.isnan(unseen):
                continue
            log = np.full(len(g.windows), unseen)
            for k in range(1, order + 1):
                seen = of(g.windows[:, order - k:])[:, 0]
                bow = of(g.windows[:, order - k:order - 1])[:, 1]
                log = np.where(np.isnan(seen), log + np.nan_to_num(bow), seen)
            mean = g.per_text(log) / g.sizes
            for i, x in zip(rows, np.exp(-mean)):
                perplexity[i] = float(x)
        langs = t.column("lang").to_pylist() if "lang" in t.column_names else [None] * t.num_rows
        limit = [limits.get(NO_LANGUAGE if x is None else str(x), limits.get("")) for x in langs]
        sizes = np.ones(t.num_rows)
        for _, rows, g in made:
            sizes[rows] = g.sizes
        limit = [b * float(np.exp(SLACK / n)) if a is not None and b is not None else None
                 for a, b, n in zip(perplexity, limit, sizes)]
        kept = [a is None or b is None or a <= b for a, b in zip(perplexity, limit)]
        t = t.drop_columns([n for n in names if n in t.column_names])
        for n, v, kind in zip(names, (perplexity, limit, kept), (pa.float64(), pa.float64(), pa.bool_())):
            t = t.append_column(n, pa.array(v, kind))
        return t.select(schema.names)

    return batches.cogroup(packed, replies, score, schema)


def find_limits(docs, labels, m, shards, order) -> dict:
    """Language to limit, from held-back trusted documents; the key "" holds the widest."""
    held = docs.select("doc_id", "text", *[c for c in ("lang",) if c in docs.columns])
    good = _good(labels).where(_held_back())
    held = batches.sift(held.where(_held_back()), "doc_id", batches.sieve(good, "doc_id"))
    # by a shuffle, so that no task has the sieve and the packing in two workers
    held = held.join(good.hint("merge"), "doc_id", "left_semi")
    buckets = batches.bucket_count(*batches.text_size(held), BUCKET_CHARS)
    held = scored(held, m, shards, buckets, order, {}).where("perplexity is not null")
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANGUAGE)) if "lang" in docs.columns else F.lit(NO_LANGUAGE)
    q = held.groupBy(lang.alias("l")).agg(
        F.count(F.lit(1)).alias("n"), F.percentile_approx("perplexity", [MIDDLE, UPPER], 10000).alias("q"))
    found = {r["l"]: r["q"][0] + MARGIN * (r["q"][1] - r["q"][0]) for r in q.collect() if r["n"] >= MIN_CALIBRATION}
    return {**found, "": max(found.values())} if found else {}


def classify(docs: DataFrame, labels: DataFrame, order: int = ORDER) -> DataFrame:
    """All documents, with perplexity, perplexity_limit and kept."""
    buckets = batches.bucket_count(*batches.text_size(docs), BUCKET_CHARS)
    m, shards = model_shards(model(count_grams(docs, labels, buckets, order), order))
    return scored(docs, m, shards, buckets, order, find_limits(docs, labels, m, shards, order))
