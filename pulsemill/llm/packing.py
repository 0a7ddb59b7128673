"""Hierarchical packing into sequences of several lengths.

Every document is its ids and the end id. Full windows of the longest tier are cut off first;
what is left of a document goes to the smallest tier that holds it. Windows of the longest
tier are opened by its own pieces and their gaps are filled with the largest shorter pieces
that fit; where nothing fits, one shorter piece is cut to close the gap. The shorter tiers
are then packed in the same way, so every sequence is exactly full. Only the end of a block
leaves tokens over: they are cut at the tier lengths and less than the shortest tier is padded.

A block is a bounded number of tokens of one task, so no shuffle is needed and memory does not
depend on the input. Sequences of a tier are dealt to step groups by attention cost (the sum
of squared piece lengths), in turns up and down, so that groups of one tier cost the same.

NULL and empty texts are one end id. Repeated rows are packed once for each row. An empty table
gives no pieces. Extra columns are not read.
"""

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from pulsemill.llm.tokens import encoded, encoder
from pulsemill.llm.worker import released_stream

TIERS, END_ID = (2048, 1024, 512, 256), 1
BLOCK_TOKENS, STEP_TOKENS = 4_000_000, 65_536

SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long, sequence_length long, step_group long")


class _Pool:
    """Pieces (document, start, length) by length."""

    def __init__(self, pieces):
        self.by = {}
        for p in pieces:
            self.by.setdefault(p[2], []).append(p)
        self.lengths = sorted(self.by)

    def add(self, p):
        if p[2] not in self.by:
            self.by[p[2]] = []
            bisect.insort(self.lengths, p[2])
        self.by[p[2]].append(p)

    def take(self, most: int, least: int = 0):
        """The longest piece of at most `most` and more than `least` tokens."""
        i = bisect.bisect_right(self.lengths, most) - 1
        if i < 0 or self.lengths[i] <= least:
            return None
        return self._pop(i)

    def shortest(self):
        return self._pop(0) if self.lengths else None

    def _pop(self, i):
        n = self.lengths[i]
        p = self.by[n].pop()
        if not self.by[n]:
            del self.by[n]
            self.lengths.pop(i)
        return p


def pack_block(lengths, tiers=TIERS) -> list:
    """Sequences as (capacity, pieces); a piece is (document, start, length)."""
    top, out, rest = tiers[0], [], []
    for d, n in enumerate(lengths):
        for at in range(0, n - top + 1, top):
            out.append((top, [(d, at, top)]))
        if n % top:
            rest.append((d, n - n % top, n % top))
    pool = _Pool(rest)
    for k, size in enumerate(tiers):
        floor = tiers[k + 1] if k + 1 < len(tiers) else 0
        while True:
            first = pool.take(size, floor)
            if first is None:
                break
            row, gap = [first], size - first[2]
            while gap:
                p = pool.take(gap)
                if p is None:
                    p = pool.shortest()
                    if p is None:
                        break
                    d, at, n = p
                    pool.add((d, at + gap, n - gap))
                    p = (d, at, gap)
                row.append(p)
                gap -= p[2]
            out += [(size, row)] if not gap else _close(row, tiers)
    return out


def _close(row, tiers) -> list:
    """Cut an unfinished sequence at tier lengths; what is shorter than all of them is padded."""
    out, left = [], sum(p[2] for p in row)
    row = list(row)
    for size in tiers:
        while left >= size:
            take, part = size, []
            while take:
                d, at, n = row[0]
                m = min(n, take)
                part.append((d, at, m))
                take -= m
                row[0] = (d, at + m, n - m)
                if m == n:
                    row.pop(0)
            out.append((size, part))
            left -= size
    if left:
        out.append((left if left & (left - 1) == 0 else tiers[0], row))
    return out


def step_groups(sequences, step_tokens=STEP_TOKENS) -> list:
    """Group number of each sequence: equal tier and, as far as possible, equal cost."""
    groups, base = [0] * len(sequences), 0
    for size in sorted({s for s, _ in sequences}, reverse=True):
        mine = sorted((i for i, s in enumerate(sequences) if s[0] == size),
                      key=lambda i: -sum(p[2] ** 2 for p in sequences[i][1]))
        k = max(1, -(-len(mine) * size // step_tokens))
        for turn, i in enumerate(mine):
            lap, at = divmod(turn, k)
            groups[i] = base + (at if lap % 2 == 0 else k - 1 - at)
        base += k
    return groups


def pack(docs: DataFrame, tokenizer: str, tiers=TIERS, end_id: int = END_ID,
         block_tokens: int = BLOCK_TOKENS, keep_encoder: bool = True) -> DataFrame:
    """One row per piece. sequence_id and step_group are unique over the table. Without `keep_encoder`
    workers that wait between tasks hold no encoder; its pieces are then learned once a task."""

    def run(batches):
        enc = encoder(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        number = TaskContext.get().partitionId() << 40
        held, tokens, seq, group = [], 0, 0, 0

        def flush():
            nonlocal seq, group
            made = pack_block([len(x) // 4 for _, x in held], tiers)
            groups = step_groups(made)
            cols = [[] for _ in range(9)]
            for k, ((size, row), g) in enumerate(zip(made, groups)):
                offset = 0
                for d, at, n in row:
                    doc_id, ids = held[d]
                    crc = zlib.crc32(memoryview(ids)[4 * at:4 * (at + n)])
                    for c, v in zip(cols, (doc_id, at, n, crc, len(ids) // 4, number + seq + k,
                                           offset, size, number + group + g)):
                        c.append(v)
                    offset += n
            seq += len(made)
            group += max(groups, default=-1) + 1
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols],
                                              names=[f.split()[0] for f in SCHEMA.split(", ")])

        for b in batches:
            for doc_id, data in encoded(enc, b):
                ids = data + end
                held.append((doc_id, ids))
                tokens += len(ids) // 4
                if tokens >= block_tokens:
                    yield flush()
                    held, tokens = [], 0
        if held:
            yield flush()

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(
        run if keep_encoder else released_stream(run), SCHEMA)
