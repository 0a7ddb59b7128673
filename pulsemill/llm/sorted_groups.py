"""Walk over groups inside sorted partitions.

A function given to mapInArrow sees its partition as batches. When the partition is sorted by a
key, a group is a run of equal keys that may go over several batches.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def runs(batches, key):
    """(is new, key, rows) for every run of equal non-null keys in every batch, in order; `is new`
    says whether the run opens a group or goes on with that of the batch before."""
    last, any_yet = None, False
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        k = b.column(key)
        cut = np.flatnonzero(pc.not_equal(k.slice(1), k.slice(0, n - 1)).to_numpy(zero_copy_only=False)) + 1
        edges = [0, *cut.tolist(), n]
        for s, e in zip(edges, edges[1:]):
            now = k[s].as_py()
            yield not any_yet or now != last, now, b.slice(s, e - s)
            last, any_yet = now, True


def whole_groups(batches, key):
    """(key, rows as one table) per group; for groups of bounded size."""
    held, now = [], None
    for new, k, rows in runs(batches, key):
        if new and held:
            yield now, pa.Table.from_batches(held)
            held = []
        now = k
        held.append(rows)
    if held:
        yield now, pa.Table.from_batches(held)
