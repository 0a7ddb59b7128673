"""Peaks of one array, and of an array that is a part of a longer signal.

These are the small numeric helpers that Spark calls per window or per block.
"""

import numpy as np

FAIL, OK, OPEN = 0, 1, 2


def piece_extremes(x):
    """(starts, stops, values) of the runs of equal values, and the runs that are a flat top higher
    than both neighbours, with the first and last run around them."""
    starts = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    level = x[starts]
    stops = np.r_[starts[1:], x.size]
    top = np.zeros(starts.size, dtype=bool)
    if starts.size > 2:
        top[1:-1] = (level[1:-1] > level[:-2]) & (level[1:-1] > level[2:])
    return starts, stops, level, np.r_[0, np.flatnonzero(top), starts.size - 1]


def _lows(heights, valleys):
    """Per top the lowest value on its left before a higher top, and whether there is a higher one.
    valleys[k] is the lowest value between tops k and k + 1."""
    low, higher, stack = np.empty(len(heights)), np.zeros(len(heights), bool), []
    for k, h in enumerate(heights):
        m = valleys[k - 1] if k else np.inf
        while stack and stack[-1][0] <= h:
            m = min(m, stack.pop()[1])
        higher[k] = bool(stack)
        low[k] = m
        stack.append((h, m))
    return low, higher


def depth_verdicts(level, tops, prominence, open_left=True, open_right=True):
    """Whether each top rises by `prominence` on its left and right, as far as these values say."""
    h = level[tops]
    if len(tops) > 1:
        valleys = np.minimum(np.minimum.reduceat(level, tops)[:-1], h[1:])
    else:
        valleys = np.zeros(0)
    out = []
    for a, b, is_open in ((h, valleys, open_left), (h[::-1], valleys[::-1], open_right)):
        low, higher = _lows(a.tolist(), b.tolist())
        v = np.where(a - low >= prominence, OK, np.where(higher | (not is_open), FAIL, OPEN))
        out.append(v)
    return out[0], out[1][::-1]


def reach(level, prominence):
    """The least height that, coming from the left end, meets a value at least `prominence` lower
    before a higher one; for a part too flat for that, the height at which its lowest value is so low."""
    before = np.r_[-np.inf, np.maximum.accumulate(level)[:-1]]
    return float(np.min(np.maximum(level + prominence, before)))


def _spread_out(x, peaks, distance):
    """Keep peaks from the highest down (ties: the later one first), at least `distance` apart."""
    lo = np.searchsorted(peaks, peaks - distance, side="right").tolist()
    hi = np.searchsorted(peaks, peaks + distance, side="left").tolist()
    state = bytearray(peaks.size)
    for j in np.lexsort((-peaks, -x[peaks])).tolist():
        if state.find(1, lo[j], hi[j]) < 0:
            state[j] = 1
    return np.frombuffer(state, dtype=np.uint8) == 1


def find_peaks(x, distance, prominence):
    """Positions and heights of peaks: flat tops higher than both neighbours, thinned to a minimum distance by
    height, then kept when they rise at least `prominence` above the higher of their two valleys."""
    starts, stops, level, tops = piece_extremes(x)
    inner = tops[1:-1]
    at = (starts[inner] + stops[inner] - 1) // 2
    left, right = depth_verdicts(level, tops, prominence, False, False)
    good = _spread_out(x, at, distance) & (left[1:-1] == OK) & (right[1:-1] == OK)
    return at[good].tolist(), level[inner][good].tolist()


def settle(pos, h, state, before, after, apart):
    """States of a block's peaks (0 unknown, 1 stays, 2 goes) as far as the neighbours' peaks near the
    borders settle them. `before` and `after`: those peaks as (pos, h, state)."""
    own, before, after = len(pos), list(before), list(after)
    if not own:
        return []
    pos = np.array([b["pos"] for b in before] + list(pos) + [b["pos"] for b in after], np.int64)
    h = np.array([b["h"] for b in before] + list(h) + [b["h"] for b in after], float)
    known = [b["state"] for b in before] + list(state) + [b["state"] for b in after]
    lo = np.searchsorted(pos, pos - apart, side="right").tolist()
    hi = np.searchsorted(pos, pos + apart, side="left").tolist()
    stays, goes, unsure = 1, 2, 3
    mark, first, last = bytearray(len(pos)), len(before), len(before) + own
    for j in np.lexsort((-pos, -h)).tolist():  # only what is higher can decide
        if known[j]:
            mark[j] = known[j]
        elif not first <= j < last:
            mark[j] = unsure
        elif mark.find(stays, lo[j], hi[j]) >= 0:
            mark[j] = goes
        else:
            mark[j] = unsure if mark.find(unsure, lo[j], hi[j]) >= 0 else stays
    return [0 if m == unsure else m for m in mark[first:last]]


NONE = -1


def _stays(zone, at):
    """The zone's peaks with the one at a position staying (NONE: no one)."""
    return [{**dict(z), "state": 1 if z["pos"] == at else 2} for z in zone]


def _choices(zone):
    """The peaks of a border zone that may stay. Two that stay are `apart` samples apart, as wide as the
    zone, so at most one does."""
    sure = [z["pos"] for z in zone if z["state"] == 1]
    return sure or [NONE] + [z["pos"] for z in zone if z["state"] == 0]


def border_table(pos, h, state, before, after, apart, start, stop):
    """Every (a, b, low, high): with a staying in the zone before the block and b in that after it, `low` stays in
    the block's first `apart` samples and `high` in its last ones."""
    out = []
    for a in _choices(before):
        for b in _choices(after):
            got = settle(pos, h, state, _stays(before, a), _stays(after, b), apart)
            kept = [p for p, s in zip(pos, got) if s == 1]
            out.append((a, b, next((p for p in kept if p < start + apart), NONE),
                        next((p for p in reversed(kept) if p >= stop - apart), NONE)))
    return out


def settled_with(pos, h, state, before, after, apart, a, b):
    return settle(pos, h, state, _stays(before, a), _stays(after, b), apart)


def agree(tables):
    """(a, b) of each of some neighbouring blocks, such that what each assumes of the next is what that one
    says. Whether a peak stays depends on higher ones only, so there is exactly one such choice."""
    layers, before = [], None
    for rows in tables:
        now = {}
        for a, b, low, high in rows:
            if before is None or (a, low) in before:
                now[high, b] = (a, b, None if before is None else (a, low))
        layers.append(now)
        before = now
    key, out = next(iter(layers[-1])), []
    for layer in reversed(layers):
        a, b, key = layer[key]
        out.append((a, b))
    return out[::-1]
