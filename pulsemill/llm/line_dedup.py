"""Line dedup with a fixed-depth tree of log templates.

A record is a line, or a sentence of a longer line. It is filed by its number of tokens and its
leading tokens; tokens with digits, addresses and links are variable fields from the start. Below
that leaf a record stands for the template made of its constant tokens, and, if it is a whole line
of enough tokens, also for the three templates in which one third of the tokens after the leading
ones is a variable field. A template that many documents have is recurring.

A passage is a run of consecutive records, short ones included, of at least LONG_TOKENS tokens; the
shortest run from every record on, and the shortest up to every record, are counted by their exact
words. A passage that two documents have is recurring, so what repeats at length is found as a
whole, while single short records need more documents.

A record of a recurring template or passage is dropped everywhere but in one document: the lowest in
the order (bucket, doc_id, text) among those that have the template, where buckets are by hash. Short
records between two dropped ones go with them. What a document keeps for others goes neither by a
template with a variable third nor between dropped records, and such a document stays. So every record
that goes by its own template, its line's or a passage is in some document that stays: where its owner
loses it to a passage or template of another owner, that owner is lower in the order. A document whose
text loses nothing is passed on as it is; another one that keeps fewer than MIN_LEFT percent of its
words is removed.

Counts are over all documents: every bucket of documents sends each of its templates once, with the
number of its documents, to the template's shard, so that a template of a third of all rows is
no more work than any other.

NULL and empty texts are kept as they are. Repeated rows count as separate documents. All columns
are kept; the results replace input columns of the same names.
"""

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from pulsemill.llm import batches
from pulsemill.llm.worker import released

MIN_TOKENS, TEMPLATE_TOKENS, LEADING = 8, 12, 2
# documents that make a template recurring, by its number of tokens
MIN_DOCS, LONG_TOKENS, LONG_MIN_DOCS, TEMPLATE_MIN_DOCS = 3, 40, 2, 5
MIN_LEFT = 20

_SENTENCE = re.compile(r"[.!?] +")
_FIELD, _MAYBE_FIELD = re.compile(r"\d|://|@"), re.compile(r"[\d@:]")
_digest = xxhash.xxh64_intdigest
_OTHER_SPACE = re.compile(r"[^\S \n]")
# of the rolling hash over the records of a passage
MULTIPLIER = 0x9E3779B97F4A7C17
MASK = (1 << 64) - 4
INVERSE = pow(MULTIPLIER, -1, 1 << 64)
RESULT = ["n_dropped", "n_records"]
# columns worked out once per document: start, end, tokens and template of every record; first and
# last record and four templates of every line;
PARTS = ["__from", "__to", "__tokens", "__key", "__line_from", "__line_to", "__line_keys"]
# first and last record and hash of every passage
RUNS = ["__run_from", "__run_to", "__run_key"]
KEYS = ["__key", "__line_keys", "__run_key"]


def _mask(token):
    return "<*>" if _FIELD.search(token) else token


def _key(tokens: list, n: int, fixed: bool) -> int:
    """Hash of a record's template; the low two bits name the kind: 1 long, 2 short, 3 with a
    variable third. 0 for records that are too short or all variable fields."""
    if n < MIN_TOKENS or not fixed and sum(t != "<*>" for t in tokens) < MIN_TOKENS // 2:
        return 0
    return _hash(n, _digest(" ".join(tokens)))


def _hash(n, words):
    """From the hash of the words."""
    return ((words + n) * MULTIPLIER & MASK) | (1 if n >= LONG_TOKENS else 2)


def _thirds(tokens: list, n: int) -> list:
    """Hashes of the templates of a line in which one third is a variable field."""
    step = -(-(n - LEADING) // 3)
    out = []
    for k in range(3):
        a = LEADING + k * step
        b = min(n, a + step)
        rest = f"{n} {k} {' '.join(tokens[:a])} <{b - a}*> {' '.join(tokens[b:])}"
        out.append((_digest(rest) & ~3) | 3)
    return out


def parts_of(text: str) -> tuple:
    """The values of PARTS for one text, and the hash of the words of every record."""
    words = []
    starts, ends, sizes, keys, line_from, line_to, line_keys = [], [], [], [], [], [], []
    even = not ("  " in text or " \n" in text or "\n " in text or _OTHER_SPACE.search(text))
    at = 0
    for line in text.split("\n") if text else ():
        if line and not line.isspace():
            first = len(starts)
            lo = at
            raw = tokens = line.split()
            fixed = not (_MAYBE_FIELD.search(line) and _FIELD.search(line))
            if not fixed:
                tokens = [_mask(t) for t in tokens]
            n = len(tokens)
            cuts = [m.end() for m in _SENTENCE.finditer(line)]
            if not cuts or n < MIN_TOKENS:
                starts.append(at)
                ends.append(at + len(line))
                sizes.append(n)
                keys.append(_key(tokens, n, fixed))
                words.append(_digest(" ".join(raw)))
            else:
                for cut in [*cuts, len(line)]:
                    if at + cut == lo:
                        continue
                    s = line[lo - at:cut]
                    if even and fixed:
                        s = s.rstrip(" ")
                        m = s.count(" ") + 1
                        h = _digest(s)
                        keys.append(_hash(m, h) if m >= MIN_TOKENS else 0)
                        words.append(h)
                    else:
                        part = s.split()
                        words.append(_digest(" ".join(part)))
                        if not fixed:
                            part = [_mask(t) for t in part]
                        m = len(part)
                        keys.append(_key(part, m, fixed))
                    starts.append(lo)
                    ends.append(at + cut)
                    sizes.append(m)
                    lo = at + cut
            if n >= TEMPLATE_TOKENS or cuts and n >= MIN_TOKENS:
                whole = _key(tokens, n, fixed)
                if whole:
                    line_from.append(first)
                    line_to.append(len(starts))
                    line_keys.append(whole if cuts else 0)
                    line_keys += _thirds(tokens, n) if n >= TEMPLATE_TOKENS else [0, 0, 0]
        at += len(line) + 1
    return starts, ends, sizes, keys, line_from, line_to, line_keys, words


def _powers(x: int, n: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(n, x, np.uint64)])


def passages(sizes: np.ndarray, keys: np.ndarray, words: np.ndarray, doc: np.ndarray) -> tuple:
    """First and last record, hash and document of the shortest runs of LONG_TOKENS tokens from
    and up to every record. All arrays are over the records of many documents, in their order. A
    record that is long enough by itself and has a template is not a passage."""
    n = len(sizes)
    at, before = np.arange(n), np.r_[0, np.cumsum(sizes)]
    last = np.searchsorted(before, before[:-1] + LONG_TOKENS)
    first = np.searchsorted(before, before[1:] - LONG_TOKENS, "right") - 1
    a, b = np.r_[at, first], np.r_[last, at + 1]
    ok = (a >= 0) & (b <= n)
    a, b = a[ok], b[ok]
    ok = (doc[a] == doc[b - 1]) & ((b - a > 1) | (keys[a] == 0))
    a, b = np.divmod(np.unique(a[ok] * np.int64(n + 1) + b[ok]), n + 1)
    sums = np.r_[np.uint64(0), np.cumsum(words * _powers(MULTIPLIER, n)[:n])]
    key = (sums[b] - sums[a]) * _powers(INVERSE, n)[a]
    key = batches.mix(key + (b - a).astype(np.uint64)) & ~np.uint64(3) | np.uint64(1)
    return a, b, key, doc[a]


def add_parts(t: pa.Table) -> pa.Table:
    rows = [parts_of(x.as_py() or "") for x in t.column("text")]
    for i, name in enumerate(PARTS):
        kind = pa.uint64() if "key" in name else pa.int32()
        t = t.append_column(name, pa.array([r[i] for r in rows], pa.list_(kind)))
    (sizes, doc), (keys, _) = _flat(t, "__tokens"), _flat(t, "__key")
    words = np.fromiter((w for r in rows for w in r[7]), np.uint64, len(sizes))
    a, b, key, owner = passages(sizes, keys, words, doc)
    base = np.searchsorted(doc, owner)
    ends = pa.array(np.searchsorted(owner, np.arange(t.num_rows + 1)).astype(np.int32))
    for name, values in zip(RUNS, ((a - base).astype(np.int32), (b - base).astype(np.int32), key)):
        t = t.append_column(name, pa.ListArray.from_arrays(ends, pa.array(values)))
    return t


def _bucket_rows(blobs) -> pa.Table:
    t = pa.concat_tables([batches.unpack_rows(b) for b in blobs])
    ids, texts = t.column("doc_id").to_pylist(), t.column("text").to_pylist()
    order = sorted(range(t.num_rows), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i] or ""))
    return t.take(pa.array(order, pa.int64())).combine_chunks()


def _flat(t: pa.Table, name) -> tuple:
    """All values of a list column and the row of each."""
    c = t.column(name).combine_chunks()
    sizes = np.diff(c.offsets.to_numpy())
    return c.flatten().to_numpy(), np.repeat(np.arange(t.num_rows), sizes)


def _needed(keys):
    kind = keys & np.uint64(3)
    return np.where(kind == 1, LONG_MIN_DOCS, np.where(kind == 2, MIN_DOCS, TEMPLATE_MIN_DOCS))


def drop_recurring(docs: DataFrame) -> DataFrame:
    """The documents that stay, with n_dropped and n_records added."""
    size = batches.text_size(docs)
    buckets = batches.bucket_count(*size)
    shards = max(1, -(-size[1] // 20_000_000))
    plain = docs.drop(*[c for c in (*PARTS, *RUNS) if c in docs.columns])
    packed = batches.packed(plain, buckets, add_parts, level=1)

    @released
    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        t = pa.concat_tables([batches.unpack_rows(b) for b in pdf["rows"]])
        key, row = (np.concatenate(x) for x in zip(*(_flat(t, c) for c in KEYS)))
        order = np.lexsort((row, key))
        key, row = key[order], row[order]
        once = np.r_[True, (key[1:] != key[:-1]) | (row[1:] != row[:-1])] if len(key) else np.zeros(0, bool)
        keys, counts = np.unique(key[once & (key > 0)], return_counts=True)
        return batches.ask(int(pdf["bucket"].iloc[0]), keys, counts, shards)

    asked = packed.groupBy("bucket").applyInPandas(count, batches.ASKED)
    answers = batches.totals(asked, LONG_MIN_DOCS)

    names = [f for f in plain.schema.fields if f.name not in RESULT]
    schema = StructType(names + [StructField(n, LongType()) for n in RESULT])

    @released
    def rewrite(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame()
        keys, totals, first = batches.merged(right, ("totals", np.uint32), ("first", np.uint8))
        ok = totals >= _needed(keys)
        keys, first = keys[ok], first[ok]
        t = _bucket_rows(left["rows"])
        key, row = zip(*(_flat(t, c) for c in KEYS))
        at = batches.find(keys, np.concatenate(key))
        rows = np.concatenate(row)
        # where the bucket is the lowest with a template, its first document keeps the records
        owner = np.full(len(keys), t.num_rows)
        np.minimum.at(owner, at[at >= 0], rows[at >= 0])
        owner[first == 0] = -1
        gone = (at >= 0) & (owner[at] != rows) if len(keys) else np.zeros(len(at), bool)
        hit_rows = np.unique(rows[gone])
        cuts = np.cumsum([len(k) for k in key])[:-1]
        kinds = list(zip(np.split(gone, cuts), np.split((at >= 0) & ~gone, cuts)))
        parts = [t.column(n).combine_chunks() for n in (*PARTS, *RUNS)]
        n_records = np.diff(parts[0].offsets.to_numpy())
        base, line_base, run_base = (parts[i].offsets.to_numpy() for i in (3, 6, 9))
        texts, n_dropped, stay = t.column("text").to_pylist(), np.zeros(t.num_rows, np.int64), np.ones(t.num_rows, bool)
        for i in hit_rows:
            lo, hi = base[i], base[i + 1]
            mine, kept = (x[lo:hi].copy() for x in kinds[0])
            lines, line_kept = (x[line_base[i]:line_base[i + 1]].reshape(-1, 4) for x in kinds[1])
            runs, run_kept = (x[run_base[i]:run_base[i + 1]] for x in kinds[2])
            of_line, of_run = ([p[i].values.to_numpy() for p in parts[k:k + 2]] for k in (4, 7))
            loose = np.zeros(hi - lo, bool)
            for marks, (x, y), where in ((mine, of_line, lines[:, 0]), (mine, of_run, runs), (loose, of_line, lines[:, 1:].any(axis=1)),
                                         (kept, of_line, line_kept.any(axis=1)), (kept, of_run, run_kept)):
                for a, b in zip(x[where], y[where]):
                    marks[a:b] = True
            texts[i], n_dropped[i], stay[i] = _without(
                texts[i], mine | loose & ~kept, kept, *(p[i].values.to_numpy() for p in parts[:3]))
        t = t.drop_columns([n for n in (*RESULT, *PARTS, *RUNS) if n in t.column_names])
        t = t.set_column(t.column_names.index("text"), "text", pa.array(texts, t.schema.field("text").type))
        if "n_chars" in t.column_names:
            i = t.column_names.index("n_chars")
            new = [o if not d else len(x) for o, d, x in zip(t.column(i).to_pylist(), n_dropped, texts)]
            t = t.set_column(i, "n_chars", pa.array(new, t.schema.field(i).type))
        t = t.append_column("n_dropped", pa.array(n_dropped))
        t = t.append_column("n_records", pa.array(n_records.astype(np.int64)))
        return t.filter(pa.array(stay)).select(schema.names)

    return batches.cogroup(packed, answers, rewrite, schema)


def _without(text, gone, kept, starts, ends, sizes) -> tuple:
    """(text without the records that are gone, their number, whether enough or anything kept for
    others is left). Short records inside a dropped passage go with it."""
    i, n = 0, len(gone)
    while i < n:
        j = i
        while j < n and not gone[j] and not kept[j] and sizes[j] < MIN_TOKENS:
            j += 1
        if j > i and i > 0 and gone[i - 1] and j < n and gone[j]:
            gone[i:j] = True
        i = max(j, i + 1)
    left, every = int(sizes[~gone].sum()), int(sizes.sum())
    out, last = [], 0
    for k in np.flatnonzero(gone):
        out.append(text[last:starts[k]])
        last = ends[k]
    out.append(text[last:])
    new = re.sub(r" *\n\s*", "\n", "".join(out)).strip()
    return new, int(gone.sum()), (left * 100 >= every * MIN_LEFT or bool((kept & ~gone).any())) and bool(new)
