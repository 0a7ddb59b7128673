"""Spelling variants: words one edit from a word that is far more frequent.

Words are runs of letters (A-Z, a-z, U+00C0 to U+00FF), lower-cased in A-Z. Words that differ by exactly
one inserted, deleted or replaced code point are near; a word's form is its near word with the largest count if that is
`ratio` times its own, and its root is reached by following forms.

Bit-sliced position index: for a block of words, one bitset per (position, letter) says which words have that
letter there. A word is matched with the whole block at once: going through its letters, four bitsets follow the
words that agree so far without an error, and those with one error so far by the shift of positions it
left (replaced: none, one more letter: ahead by one, one letter less: behind by one). The last step keeps those of the
length that fits.

A block is not the whole vocabulary. If l is the length of the shorter of two near words and h = l // 2, either their
first h letters are equal or their last l - h. So words of length l and l + 1 meet under both parts, and a pair
found under its end counts only if the beginnings differ. Groups of more than `BLOCK` words are cut into
parts, and every two parts meet in a task that gives back one row per word.

Defined results: NULL and empty texts have no words. A NULL doc_id is read as an empty string where planted
faults are drawn. Repeated rows count each time. Extra columns are not read. An empty table gives no rows.
"""

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from pulsemill.llm.batches import stored
from pulsemill.llm.sorted_groups import whole_groups

MIN_LETTERS, MIN_COUNT, RATIO = 6, 5, 5
BLOCK = 8_192
WORDS_HELD = 400_000

# The letters' UTF-8 form after lower-casing A-Z: a to z, and all of U+00C0 to U+00FF.
_RUN = re.compile(rb"(?:[a-z]+|\xc3[\x80-\xbf])+")
COUNTED = StructType([StructField("word", StringType()), StructField("n", LongType())])


def _robbed(word: bytes, h: int) -> bytes:
    text = word.decode()
    at = h % len(text)
    return (text[:at] + text[at + 1:]).encode()


def occurrences(docs: DataFrame, faults: int = 0) -> DataFrame:
    """(word, n) with partial counts. With `faults`, every run whose unsigned crc32 of `doc_id:run` h is divisible
    by that number loses its code point h % length."""

    def count(batches):
        held = Counter()
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not text:
                    continue
                found = _RUN.findall(text.encode().lower())
                if not faults:
                    held.update(found)
                else:
                    start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                    for word, n in Counter(found).items():
                        h = zlib.crc32(word, start)
                        if h % faults == 0:
                            word = _robbed(word, h)
                        held[word] += n
                if len(held) > WORDS_HELD:
                    yield emit(held)
                    held = Counter()
        yield emit(held)

    def emit(held):
        long = [(w, n) for w, n in held.items() if len(w) >= MIN_LETTERS]
        words = pa.array([w for w, _ in long], pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array([n for _, n in long], pa.int64())], names=COUNTED.names)

    return docs.select("doc_id", "text").mapInArrow(count, COUNTED)


def vocabulary(docs: DataFrame, faults: int = 0, letters: int = MIN_LETTERS, least: int = MIN_COUNT) -> DataFrame:
    """(word, n) for every word that is long and frequent enough."""
    return (occurrences(docs, faults).where(F.length("word") >= letters).groupBy("word")
            .agg(F.sum("n").alias("n")).where(F.col("n") >= least))


class Index:
    """Bit-sliced index of a list of words; word k has bit k."""

    def __init__(self, words):
        at, lengths = {}, {}
        for k, word in enumerate(words):
            bit = k
            lengths.setdefault(len(word), []).append(bit)
            for i, letter in enumerate(word):
                at.setdefault((i, letter), []).append(bit)
        size = len(words)
        self.every = (1 << size) - 1
        self.at = {k: _bitset(v, size) for k, v in at.items()}
        self.lengths = {k: _bitset(v, size) for k, v in lengths.items()}

    def near(self, word):
        """The bitset of words at distance one."""
        get = self.at.get
        none = self.every           # no error so far
        same = more = less = 0      # one error, which left the positions as they were, or shifted by one
        for i, c in enumerate(word):
            here, ahead = get((i, c), 0), get((i + 1, c), 0)
            more = (more | none) & ahead
            less = (less & get((i - 1, c), 0)) | none
            same = (same & here) | (none & ~here)
            none &= here
        n, get = len(word), self.lengths.get
        return ((same & get(n, 0)) | ((more | none) & get(n + 1, 0)) | (less & get(n - 1, 0)))


def _bitset(bits, size):
    if len(bits) * 8 < size:
        out = 0
        for b in bits:
            out |= 1 << b
        return out
    raw = bytearray(size // 8 + 1)
    for b in bits:
        raw[b >> 3] |= 1 << (b & 7)
    return int.from_bytes(raw, "little")


def members(bits):
    """Numbers of the set bits."""
    while bits:
        low = bits & -bits
        yield low.bit_length() - 1
        bits ^= low


FOUND = StructType([StructField("word", StringType()), StructField("near", LongType()),
                    StructField("n", LongType()), StructField("best", StringType())])


def neighbours(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, n_near, best, best_n): the number of near words, and the most frequent of them."""
    size = F.length("word")
    classes = F.array(size, size - 1)
    dealt = words.withColumn("l", F.explode(classes)).where(F.col("l") >= 1)
    half = F.floor(F.col("l") / 2).cast("int")
    ends = F.array(F.struct(F.lit("a").alias("side"), F.expr("left(word, cast(floor(l / 2) as int))").alias("part")),
                   F.struct(F.lit("z").alias("side"),
                            F.expr("right(word, l - cast(floor(l / 2) as int))").alias("part")))
    dealt = (dealt.withColumn("half", half).withColumn("end", F.explode(ends))
             .withColumn("group", F.concat_ws("/", "l", "end.side", F.xxhash64("end.part")))
             .select("word", "n", "l", "half", "end.side", "group"))
    sizes = dealt.groupBy("group").count().where("count > 1")
    parts = F.ceil(F.col("count") / F.lit(block)).cast("int")
    tiles = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(
        F.least(k, "mine").alias("low"), F.greatest(k, "mine").alias("high")))
    dealt = (dealt.join(sizes, "group").withColumn("parts", parts)
             .withColumn("mine", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
             .withColumn("t", F.explode(tiles))
             .withColumn("tile", F.concat_ws("/", "t.low", "t.high", "group"))
             .withColumn("asks", F.col("mine") == F.col("t.high"))
             .withColumn("held", F.col("mine") == F.col("t.low"))
             .select("tile", "word", "n", "l", "half", "side", "asks", "held"))
    arrow = to_arrow_schema(FOUND)

    def run(batches):
        out = []
        for _, rows in whole_groups(batches, "tile"):
            if len(rows) > 1:
                out += met(rows)
            if len(out) > 5_000:
                yield emit(out)
                out = []
        if out:
            yield emit(out)

    def emit(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), arrow)], schema=arrow)

    # A number keeps small but costly partitions apart.
    tasks = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = dealt.repartition(tasks, "tile").sortWithinPartitions("tile", "word").mapInArrow(run, FOUND)
    first = F.min(F.struct((-F.col("n")).alias("less"), "best"))
    return (found.groupBy("word").agg(F.sum("near").alias("n_near"), first.alias("f"))
            .select("word", "n_near", F.col("f.best").alias("best"), (-F.col("f.less")).alias("best_n")))


def met(rows: pa.Table):
    """(word, near words, count of the best, best) for the words of one tile."""
    words, counts = rows.column("word").to_pylist(), rows.column("n").to_pylist()
    held, asks = rows.column("held").to_pylist(), rows.column("asks").to_pylist()
    l, half, side = (rows.column(c)[0].as_py() for c in ("l", "half", "side"))
    inside = [k for k in range(len(words)) if held[k]]
    index = Index([words[k] for k in inside])
    longer = index.lengths.get(l + 1, 0)
    out = {}
    place = {k: i for i, k in enumerate(inside)}
    for k in range(len(words)):
        if not asks[k]:
            continue
        bits = index.near(words[k])
        if len(words[k]) > l:  # two words of length l + 1 meet in their own class
            bits &= ~longer
        if held[k]:  # within one part every pair is asked for twice
            bits &= (1 << place[k]) - 1
        for i in members(bits):
            other = inside[i]
            if side == "z" and words[k][:half] == words[other][:half]:
                continue
            for a, b in ((k, other), (other, k)):
                new = (-counts[b], words[b])
                seen = out.get(a)
                out[a] = (1, new) if seen is None else (seen[0] + 1, min(seen[1], new))
    return [(words[a], near, -best[0], best[1]) for a, (near, best) in out.items()]


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for words with a form. Counts grow by the ratio at every step, so chains are short;
    each round doubles the steps taken."""
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        far = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = stored(now.join(far, "root", "left")
                     .select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")),
                     "roots")
        now = new.select("word", "root")
        if not new.where("moved").limit(1).count():
            return now


def group(docs: DataFrame, faults: int = 0, letters: int = MIN_LETTERS, least: int = MIN_COUNT, ratio: int = RATIO,
          block: int = BLOCK) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word."""
    words = stored(vocabulary(docs, faults, letters, least), "words")
    near = neighbours(words, block)
    good = F.col("best_n") >= F.lit(ratio) * F.col("n")
    formed = stored(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(good, F.col("best")).alias("form"), F.when(good, F.col("best_n")).alias("form_n")), "forms")
    last = roots(formed.where("form is not null"))
    return formed.join(last, "word", "left").withColumn("root", F.coalesce("root", "word"))
