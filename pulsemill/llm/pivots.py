"""Near-duplicate embeddings by a pivot-permutation index.

Reference points (pivots) are rows far from each other, chosen from a bounded sample: the `SAMPLE` vectors with
the lowest hash, `PIVOTS` of them by farthest-first choice. Every vector is described by its nearest
pivots in order. Vectors of one label are filed in inverted lists, one per two of the
first `FILED` pivots, so a list holds the vectors that both pivots are near to. Members of a
list are compared when their first `SHARED_OF` pivots have `SHARED` in common, and confirmed by their cosine in double
precision. A pair that meets in several lists counts in one: that of the two lowest
pivots that both file.

Equal vectors of a label are one class, told apart by a digest, and only classes are filed. Lists of more than `PART` classes
are cut into parts, and every two parts meet in a task that gives back one count and at most one link per member,
never pairs. So a hot list or a large group of copies is spread evenly, and what is written grows
with the rows alone; the comparisons within one large group of different vectors are all made.

Recall: a pair at the limit of 0.98 shares two of its first six of 128 pivots in over 99.99 % of cases, and three
of the first eight likewise (64 dimensions, no preferred direction; the tests measure it). Every row is filed.

Defined results: vectors that are NULL, empty, zero or hold NULL or non-finite components, and rows
without label or vec_id, link with nothing: no links, a component of their own, kept. Only vectors of one length
are compared. Rows with the same vec_id are separate vectors with one id. Repeated rows link with each
other. Extra columns are not read. An empty table gives no rows.
"""

import itertools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

from pulsemill.llm.batches import stored
from pulsemill.llm.components import components
from pulsemill.llm.sorted_groups import whole_groups

LIMIT = 0.98
SAMPLE, PIVOTS, FILED, SHARED_OF, SHARED = 2_048, 128, 6, 8, 3
PART = 2_048
TILE = 512


def usable(embedding="embedding"):
    """Whether a vector can be compared."""
    e = F.col(embedding)
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & finite
                      & F.exists(e, lambda x: x != 0), F.lit(False))


def _node():
    """Equal labels and vectors have equal digests; 0.0 and -0.0 are equal."""
    e = F.transform("embedding", lambda x: (x.cast("double") + F.lit(0.0)).cast("string"))
    return F.md5(F.concat_ws(",", F.col("label").cast("string"), e))


def classes(vectors: DataFrame) -> DataFrame:
    """(node, label, embedding, lowest id, copies) for every different vector of a label."""
    return (vectors.where(usable()).groupBy(_node().alias("node"))
            .agg(F.first("label").alias("label"), F.first("embedding").alias("embedding"),
                 F.min("vec_id").alias("lowest"), F.count(F.lit(1)).alias("copies")))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision, safe against overflow."""
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def choose_pivots(found: DataFrame, sample: int = SAMPLE, pivots: int = PIVOTS) -> np.ndarray:
    """Vectors far from each other, from a sample of at most `sample` classes."""
    rows = found.orderBy(F.xxhash64("node"), "node").limit(sample).select("embedding").collect()
    dim = max([len(r.embedding) for r in rows], default=1)
    pool = np.zeros((len(rows), dim))
    for i, r in enumerate(rows):
        pool[i, :len(r.embedding)] = r.embedding
    if not len(pool):
        return pool
    pool = unit(pool)
    chosen, nearest = [0], pool @ pool[0]
    while len(chosen) < min(pivots, len(pool)):
        k = int(nearest.argmin())
        chosen.append(k)
        nearest = np.maximum(nearest, pool @ pool[k])
    return pool[chosen]


def _bits(order: np.ndarray, words: int) -> np.ndarray:
    """Sets of pivots as bits, a row of 64-bit words each."""
    out = np.zeros((len(order), words), np.uint64)
    at = np.arange(len(order))
    for c in range(order.shape[1]):
        out[at, order[:, c] >> 6] |= np.uint64(1) << (order[:, c] & 63).astype(np.uint64)
    return out


FILED_ROW = StructType([StructField("list", StringType()), StructField("node", StringType()),
                        StructField("pair", IntegerType()), StructField("vector", BinaryType()),
                        StructField("copies", LongType()), StructField("filed", BinaryType()),
                        StructField("near", BinaryType())])


def describe(found: DataFrame, pivots: np.ndarray) -> DataFrame:
    """One row per vector and inverted list. With fewer than two pivots every label has one list."""
    shared = found.sparkSession.sparkContext.broadcast(pivots)
    words = max(1, math.ceil(len(pivots) / 64))

    def file(batches):
        for b in batches:
            sizes = np.array([len(v) for v in b.column("embedding")], np.int64)
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                rows = b.take(pa.array(at))
                raw = np.asarray(rows.column("embedding").flatten()).reshape(len(at), dim)
                p = shared.value
                p = p[:, :dim] if p.shape[1] >= dim else np.pad(p, ((0, 0), (0, dim - p.shape[1])))
                order = np.argsort(-(unit(raw) @ p.T), axis=1, kind="stable")
                filed, near = _bits(order[:, :FILED], words), _bits(order[:, :SHARED_OF], words)
                own = np.sort(order[:, :FILED], axis=1)
                label = rows.column("label").cast(pa.string()).to_pylist()
                node, copies = rows.column("node").to_pylist(), rows.column("copies").to_pylist()
                pairs = list(itertools.combinations(range(own.shape[1]), 2)) or [(0, 0)]
                out = [[] for _ in FILED_ROW]
                for i in range(len(at)):
                    blob, f, n = raw[i].tobytes(), filed[i].tobytes(), near[i].tobytes()
                    for x, y in pairs:
                        a, c = int(own[i, x]), int(own[i, y])
                        row = (f"{dim}/{a}/{c}/{label[i]}", node[i], c, blob, copies[i], f, n)
                        for col, v in zip(out, row):
                            col.append(v)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(out, (pa.string(), pa.string(), pa.int32(), pa.binary(), pa.int64(),
                                                          pa.binary(), pa.binary()))], names=FILED_ROW.names)

    return found.mapInArrow(file, FILED_ROW)


FOUND = StructType([StructField("node", StringType()), StructField("links", LongType()),
                    StructField("other", StringType())])


def compare(filed: DataFrame, limit: float = LIMIT, part: int = PART, exact: str = "float32") -> DataFrame:
    """(node, links found, one linked node or NULL) per member of a list that has a link there."""
    sizes = filed.groupBy("list").count().where("count > 1")
    parts = F.ceil(F.col("count") / F.lit(part)).cast("int")
    mine = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    tiles = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(
        F.least(k, "mine").alias("low"), F.greatest(k, "mine").alias("high")))
    dealt = (filed.join(sizes, "list").withColumn("parts", parts).withColumn("mine", mine)
             .withColumn("t", F.explode(tiles))
             .withColumn("tile", F.concat_ws("/", F.col("t.low"), F.col("t.high"), "list"))
             .withColumn("side", F.col("mine") != F.col("t.low"))
             .withColumn("alone", F.col("t.low") == F.col("t.high"))
             .select("tile", "side", "alone", "node", "pair", "vector", "copies", "filed", "near"))

    def run(batches):
        for _, rows in whole_groups(batches, "tile"):
            if len(rows) > 1:
                out = compared(rows, limit, exact)
                if out is not None:
                    yield out

    # A number keeps small but costly partitions apart.
    tasks = int(filed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(tasks, "tile").sortWithinPartitions("tile", "node").mapInArrow(run, FOUND)


def compared(rows: pa.Table, limit: float, exact: str):
    """Links between the members of one tile whose home it is."""
    rows = rows.combine_chunks()
    blob = rows.column("vector").to_pylist()
    vectors = unit(np.frombuffer(b"".join(blob), exact).reshape(len(blob), -1))
    filed, near = (np.frombuffer(b"".join(rows.column(c).to_pylist()), np.uint64).reshape(len(blob), -1)
                   for c in ("filed", "near"))
    copies = rows.column("copies").to_numpy()
    pair = int(rows.column("pair")[0].as_py())
    below = _bits(np.arange(pair)[None, :], filed.shape[1])[0] if pair else np.zeros(filed.shape[1], np.uint64)
    alone = rows.column("alone")[0].as_py()
    side = rows.column("side").to_numpy()
    left = np.arange(len(blob)) if alone else np.flatnonzero(~side)
    right = left if alone else np.flatnonzero(side)
    wanted = min(SHARED, int(np.bitwise_count(near[0]).sum()))
    links = np.zeros(len(blob), np.int64)
    first, second = [], []
    for s in range(0, len(left), TILE):
        a = left[s:s + TILE]
        for t in range(s if alone else 0, len(right), TILE):
            b = right[t:t + TILE]
            common = np.bitwise_count(near[a][:, None, :] & near[b][None, :, :]).sum(axis=2)
            x, y = np.nonzero(common >= wanted)
            if alone and s == t:
                x, y = x[x < y], y[x < y]
            for cut in range(0, len(x), 65_536):
                i, j = a[x[cut:cut + 65_536]], b[y[cut:cut + 65_536]]
                cosine = np.einsum("ij,ij->i", vectors[i], vectors[j])
                ok = cosine >= limit
                for k in np.flatnonzero(np.abs(cosine - limit) < 1e-12):  # the order of the sum may decide
                    ok[k] = math.fsum(vectors[i[k]] * vectors[j[k]]) >= limit
                # Home: only one of the pivots that both file lies below the list's second one.
                ok &= np.bitwise_count(filed[i] & filed[j] & below).sum(axis=1) <= 1
                i, j = i[ok], j[ok]
                np.add.at(links, i, copies[j])
                np.add.at(links, j, copies[i])
                first.append(i)
                second.append(j)
    if not first or not links.any():
        return None
    i, j = np.concatenate(first), np.concatenate(second)
    label = np.arange(len(blob))
    while True:  # the smallest member reachable inside the tile
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = new[new]
        if (new == label).all():
            break
        label = new
    some = np.flatnonzero(links)
    node = rows.column("node")
    other = node.take(pa.array(label[some]))
    apart = pa.array(label[some] != some)
    return pa.RecordBatch.from_arrays(
        [node.take(pa.array(some)).combine_chunks(), pa.array(links[some]),
         pc.if_else(apart, other, pa.scalar(None, pa.string())).combine_chunks()], names=FOUND.names)


def link(vectors: DataFrame, limit: float = LIMIT, part: int = PART) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per row of the table."""
    exact = "float32" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "float64"
    wide = f"array<{'float' if exact == 'float32' else 'double'}>"
    vectors = vectors.select("vec_id", "label", F.col("embedding").cast(wide).alias("embedding"))
    found = stored(classes(vectors), "vectors")
    pivots = choose_pivots(found)
    links = stored(compare(describe(found, pivots), limit, part, exact), "links")
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    labels = components(links.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    lowest = (labels.join(found.select("node", "lowest"), "node")
              .groupBy("label").agg(F.min("lowest").alias("component")))
    joined = labels.join(lowest, "label").select("node", "component")
    per = (found.select("node", "lowest", "copies").join(counts, "node", "left").join(joined, "node", "left")
           .select("node", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("class_links"),
                   F.coalesce("component", "lowest").alias("component")))
    rows = vectors.select("vec_id", F.when(usable(), _node()).alias("node"))
    out = rows.join(per, "node", "left").select(
        "vec_id", F.coalesce("class_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "vec_id").cast("long").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def link_sql(limit: float = LIMIT) -> str:
    """All pairs of a label, for tables small enough."""
    return f"""
with recursive good as (
  select row_number() over () as r, vec_id, label, embedding::double[] as e from embeddings
  where vec_id is not null and label is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (
  select a.r as a, b.r as b, a.vec_id as va, b.vec_id as vb from good a join good b
    on a.label = b.label and a.r <> b.r and len(a.e) = len(b.e)
  where case when len(a.e) = len(b.e) then list_cosine_similarity(a.e, b.e) >= {limit} end),
reach(v, w) as (
  select va, va from links union select reach.v, links.vb from reach join links on links.va = reach.w),
low as (select v, min(w) as w from reach group by v),
counted as (select a, count(*) as n from links group by a),
every as (
  select e.vec_id, 0 as n, e.vec_id as c from embeddings e
  where not (coalesce(e.vec_id is not null and e.label is not null and len(e.embedding) > 0
    and len(list_filter(e.embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(e.embedding, lambda x: x <> 0)) > 0, false))
  union all
  select good.vec_id, coalesce(n, 0), coalesce(low.w, good.vec_id)
  from good left join counted on counted.a = good.r left join low on low.v = good.vec_id)
select vec_id::bigint as vec_id, n::bigint as n_links, c::bigint as component_id, coalesce(vec_id = c, true) as kept
from every"""
