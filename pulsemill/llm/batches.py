"""Arrow helpers and the keyed exchange that several operators share.

Documents are dealt into buckets by a hash of their id, packed and compressed, so one
bucket is a bounded piece of the table. A bucket may ask about keys: the keys go to shards
by their hash, each shard answers for all buckets, and the answers meet the bucket again.
A key is sent once per bucket however often it occurs, so a frequent key is never hot.
"""

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from pulsemill.llm.worker import release
from pulsemill.sources.storage import scratch_path

BUCKET_CHARS = 6_000_000
SHARD_KEYS = 1_500_000
ROWS_AT_ONCE = 500


def text_size(docs: DataFrame) -> tuple:
    """(rows, characters) of a table with a text column."""
    r = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    return int(r[0]), int(r[1])


def bucket_count(rows: int, chars: int, each: int = BUCKET_CHARS) -> int:
    return max(1, math.ceil((chars + 200 * rows) / each))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a result to the shared folder, compressed, and read it back."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def bucket_of(buckets: int, key: str = "doc_id", other: str = None):
    """Bucket by hash of the key; rows without a key go by the hash of `other`."""
    k = F.xxhash64(F.col(key).cast("long"))
    if other is not None:
        k = F.when(F.col(key).isNull(), F.xxhash64(F.col(other))).otherwise(k)
    return F.pmod(k, F.lit(buckets)).cast("long")


def pack_rows(batch: pa.Table, level: int = 5) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_table(batch)
    return zstandard.ZstdCompressor(level=level).compress(sink.getvalue().to_pybytes())


def unpack_rows(blob: bytes) -> pa.Table:
    d = zstandard.ZstdDecompressor()
    size = zstandard.frame_content_size(blob)
    return pa.ipc.open_stream(d.decompress(blob, max_output_size=max(size, 1))).read_all()


PACKED = StructType([StructField("bucket", LongType()), StructField("rows", BinaryType())])


def packed(docs: DataFrame, buckets: int, add=None, level: int = 5, only: np.ndarray = None) -> DataFrame:
    """(bucket, rows): all columns of the documents, packed per task and bucket. `add` may give
    columns that are worked out from the rows once, some rows at a time, before they travel; `level` is
    that of compression; `only` is a sieve that the doc_id may be in (see `sift`, which would take a second
    worker for each task)."""
    with_bucket = docs.withColumn("__bucket", bucket_of(buckets, "doc_id", "text"))
    shared = None
    if only is not None:
        with_bucket = with_bucket.withColumn("__h", _sieved("doc_id"))
        shared = docs.sparkSession.sparkContext.broadcast(only)

    def deal(batches):
        release()
        held, size = [], 0
        for b in batches:
            if shared is not None:
                b = _let_through(b, shared.value, True)
            held.append(b)
            size += b.nbytes
            if size >= 32_000_000:
                yield from emit(held)
                held, size = [], 0
        if held:
            yield from emit(held)
            held = None
        release()

    def emit(held):
        t = pa.Table.from_batches(held)
        at = t.column("__bucket").to_numpy()
        t = t.drop_columns(["__bucket"])
        if add is not None:
            t = pa.concat_tables([add(t.slice(lo, ROWS_AT_ONCE)) for lo in range(0, t.num_rows, ROWS_AT_ONCE) or [0]])
            t = t.combine_chunks()
        order = np.argsort(at, kind="stable")
        at = at[order]
        starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else []
        ends = np.r_[starts[1:], len(at)] if len(at) else []
        for s, e in zip(starts, ends):
            part = t.take(pa.array(order[s:e]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(at[s])], pa.int64()), pa.array([pack_rows(part, level)], pa.binary())],
                names=["bucket", "rows"])

    return with_bucket.mapInArrow(deal, PACKED)


SIEVE_BITS = 1 << 26


def sieve(ids: DataFrame, key: str) -> np.ndarray:
    """A Bloom filter over the keys, of at most SIEVE_BITS bits whatever their number."""
    bits = 1 << 10
    while bits < min(SIEVE_BITS, 24 * ids.count()):
        bits *= 2
    h = F.xxhash64(F.col(key).cast("long"))
    places = F.array(*[F.pmod(F.shiftright(h, 19 * i), F.lit(bits)) for i in range(3)])
    at = ids.select(F.explode(places).alias("p"))
    words = at.groupBy(F.shiftright("p", 5).alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(p % 32 as int))")).alias("b")).toPandas()
    out = np.zeros(bits // 32, np.uint32)
    out[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64).astype(np.uint32)
    return out


def sift(df: DataFrame, key: str, words: np.ndarray, inside: bool = True) -> DataFrame:
    """The rows whose key may be in the sieve, or the others. It only spares work: an exact join has
    to follow, and a sieve that is too full lets everything through."""
    shared = df.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        for b in batches:
            yield _let_through(b, shared.value, inside)

    return df.withColumn("__h", _sieved(key)).mapInArrow(run, df.schema)


def _sieved(key: str):
    return F.xxhash64(F.col(key).cast("long"))


def _let_through(b: pa.RecordBatch, words: np.ndarray, inside: bool) -> pa.RecordBatch:
    bits = np.uint64(32 * len(words))
    h = b.column("__h").to_numpy(zero_copy_only=False)
    ok = np.ones(len(h), bool)
    for i in range(3):
        p = (h >> np.int64(19 * i)).view(np.uint64) % bits
        ok &= (words[p >> np.uint64(5)] >> (p % np.uint64(32)).astype(np.uint32)) & np.uint32(1) == 1
    return b.drop_columns(["__h"]).filter(pa.array(ok == inside))


ASKED = StructType([StructField("shard", LongType()), StructField("bucket", LongType()),
                    StructField("keys", BinaryType()), StructField("counts", BinaryType())])


def ask(bucket: int, keys: np.ndarray, counts, shards: int) -> pd.DataFrame:
    """One row per shard for sorted distinct uint64 keys of a bucket."""
    shard = (keys >> np.uint64(40)) % np.uint64(shards)
    order = np.argsort(shard, kind="stable")
    edges = np.searchsorted(shard[order], np.arange(shards + 1, dtype=np.uint64))
    out = []
    for s in range(shards):
        at = order[edges[s]:edges[s + 1]]
        if len(at):
            c = b"" if counts is None else counts[at].astype(np.uint32).tobytes()
            out.append((s, bucket, keys[at].tobytes(), c))
    return pd.DataFrame(out, columns=["shard", "bucket", "keys", "counts"])


ANSWER = StructType([StructField("bucket", LongType()), StructField("keys", BinaryType()),
                     StructField("totals", BinaryType()), StructField("first", BinaryType())])


def totals(asked: DataFrame, least: int = 2) -> DataFrame:
    """Sum the counts of each key over all buckets and send the keys that reach `least`
    back to every bucket that has them: sorted keys, their totals, and whether the bucket
    is the lowest one that has the key. One shard holds a bounded share of all keys."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bucket")
        keys = [np.frombuffer(k, np.uint64) for k in pdf["keys"]]
        counts = [np.frombuffer(c, np.uint32) for c in pdf["counts"]]
        every = np.concatenate(keys)
        order = np.argsort(every, kind="stable")
        k = every[order]
        new = np.r_[True, k[1:] != k[:-1]] if len(k) else np.zeros(0, bool)
        group = np.cumsum(new) - 1
        sums = np.bincount(group, weights=np.concatenate(counts)[order]).astype(np.uint32)
        total = np.empty(len(every), np.uint32)
        first = np.zeros(len(every), np.uint8)
        total[order] = sums[group]
        first[order[new]] = 1
        out, at = [], 0
        for b, mine in zip(pdf["bucket"], keys):
            t, f = total[at:at + len(mine)], first[at:at + len(mine)]
            at += len(mine)
            ok = t >= least
            if ok.any():
                out.append((b, mine[ok].tobytes(), t[ok].tobytes(), f[ok].tobytes()))
        return pd.DataFrame(out, columns=["bucket", "keys", "totals", "first"])

    return asked.groupBy("shard").applyInPandas(add, ANSWER)


def merged(answers: pd.DataFrame, *fields) -> tuple:
    """Sorted keys of a bucket's answers with the named (column, dtype) fields."""
    if not len(answers):
        return (np.zeros(0, np.uint64), *[np.zeros(0, d) for _, d in fields])
    keys = np.concatenate([np.frombuffer(k, np.uint64) for k in answers["keys"]])
    order = np.argsort(keys, kind="stable")
    return (keys[order], *[np.concatenate([np.frombuffer(x, d) for x in answers[c]])[order]
                           for c, d in fields])


def find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Position of each wanted key among sorted keys, -1 where absent."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return np.where(keys[at] == wanted, at, -1)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of uint64 values (a one-to-one map)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def cogroup(packed: DataFrame, answers: DataFrame, fn, schema) -> DataFrame:
    """Bring a bucket's rows and answers together; `fn(rows, answers)` gives an Arrow table."""
    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        out = fn(left.to_pandas(), right.to_pandas())
        if isinstance(out, pd.DataFrame):
            out = pa.Table.from_pylist([], schema=arrow)
        return out.cast(arrow)

    arrow = to_arrow_schema(schema)
    return packed.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(both, schema)
