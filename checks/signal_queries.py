"""Segments, windows, signal transforms, peaks, beats, transit times."""

from pyspark.sql import functions as F

from checks import views as V
from checks.manifest_queries import WIN_SQL, sample_windows, segments_sql
from checks.registry import query, r, rs, tidy, with_
from pulsemill.functions import arrays as A
from pulsemill.operators import filters as X_filters, peaks as P, signals as S, transit as X
from pulsemill.operators.windows import apply_mask, finite_segments, fixed_windows, tag_segments
from pulsemill.functions.numeric import round_even
from pulsemill.sources import results
from pulsemill.sources.storage import scratch_path

FINITE3 = "ecg is not null and ppg is not null and abp is not null"
KEYS = ["split", "record_id", "window_index"]

# ---------------------------------------------------------------- windows as points

WPOINTS = ("wp", """
select w.split, w.subject_id, w.record_id, w.window_index, s.i - 8 * w.window_index as j, s.ppg, s.abp, s.ecg
from win w join samples s on s.record_id = w.record_id and s.i >= 8 * w.window_index and s.i < 8 * w.window_index + 16
where w.n_bad = 0""")

WIN3_SQL = ("win", WIN_SQL[1].replace("ppg is null or abp is null", "ppg is null or abp is null or ecg is null"))
BASE = ("samples", WIN_SQL, WPOINTS)
BASE3 = ("samples", WIN3_SQL, WPOINTS)


def long(df, *cols, keys=KEYS):
    """Array columns as rows (keys, pos, values)."""
    return tidy(df.select(*keys, F.posexplode(F.arrays_zip(*cols)).alias("pos", "__v")).select(
        *keys, "pos", *[F.col(f"__v.{c}").alias(c) for c in cols]))


def segs(samples, cols=("ecg", "ppg", "abp"), n=8):
    return finite_segments(samples, list(cols), n)


def tagged(spark, d, cols=("ecg", "ppg", "abp"), n=8):
    s = V.samples(spark, d)
    return tag_segments(s, segs(s, cols, n))


TAG = ("tag", """
select s.*, g.seg_start, g.seg_end from samples s join segs g on s.record_id = g.record_id and s.i >= g.seg_start and s.i < g.seg_end""")


@query("e1_finite_segments", with_("samples", segments_sql(FINITE3, 4)) + """
select record_id, seg_start, cast(seg_end as bigint) as seg_end from segs""")
def e1(spark, d):
    return finite_segments(V.samples(spark, d), ["ecg", "ppg", "abp"], 4, block=16)


@query("e2_fixed_windows", with_("samples", WIN_SQL) + f"""
select split, subject_id, record_id, window_index, cast(8 * window_index as bigint) as source_start_index,
 cast(8 * window_index + 16 as bigint) as source_end_index, {r('2.0 * window_index', 'source_start_sec')}, {r('2.0 * window_index + 4', 'source_end_sec')},
 (select {r('sum(ppg)', 'x')} from samples s where s.record_id = win.record_id and s.i >= 8 * window_index and s.i < 8 * window_index + 16) as ppg_sum
from win where n_bad = 0""")
def e2(spark, d):
    w = sample_windows(spark, d)
    return tidy(w.select("split", "subject_id", "record_id", "window_index", "source_start_index",
                         "source_end_index", "source_start_sec", "source_end_sec",
                         A.array_sum("ppg").alias("ppg_sum")))


@query("e2_tumbling_windows", with_("samples", ("win", """
select record_id, cast(floor(i / 20) as bigint) as window_index, count(*) as n, count(ppg) as ok, max(i) + 1 as e, max(ppg) as top
from samples group by record_id, floor(i / 20) having count(*) = 20 and count(ppg) = 20""")) + f"""
select record_id, window_index, cast(e as bigint) as source_end_index, {r('top')} from win""")
def e2b(spark, d):
    w = fixed_windows(V.samples(spark, d), 5.0, 5.0, ["ppg"])
    return tidy(w.select("record_id", "window_index", "source_end_index", F.array_max("ppg").alias("top")))


def resample_sql(src, n, t, keep, cols):
    """Linear resampling of windows of n points held as rows (split, record_id, window_index, j)."""
    vals = ", ".join(f"a.{c} + (b.{c} - a.{c}) * (g.pos * {n} / {t}.0 - a.j) as {c}" for c in cols)
    return f"""
select a.split, a.record_id, a.window_index, g.pos, {vals}
from (select unnest(range({keep})) as pos) g join {src} a on a.j = least(cast(floor(g.pos * {n} / {t}.0) as bigint), {n - 1})
join {src} b on a.split = b.split and a.record_id = b.record_id and a.window_index = b.window_index
 and b.j = least(cast(floor(g.pos * {n} / {t}.0) as bigint) + 1, {n - 1})"""


@query("e3_resample_linear", with_(*BASE, ("rs", resample_sql("wp", 16, 20, 18, ["ppg", "abp"]))) + f"""
select split, record_id, window_index, cast(pos as int) as pos, {rs('ppg', 'abp')} from rs""")
def e3(spark, d):
    w = sample_windows(spark, d)
    w = w.withColumns({c: A.resample_linear(c, 20, 18) for c in ("ppg", "abp")})
    return long(w, "ppg", "abp")


def rate_ctes(rates, fs_out):
    """Tables of the taps and of the reduced rates, both by source rate."""
    taps, pairs = [], []
    for fs in rates:
        up, down = S.rational_rates(fs, fs_out)
        h = S.polyphase_taps(up, down)
        taps.append(f"select cast({fs} as double) as fs, unnest(range({len(h)})) as t, unnest({h!r}) as h")
        pairs.append(f"select cast({fs} as double) as fs, {up} as up, {down} as down, {len(h) // 2} as half")
    return [("taps", " union all ".join(taps)), ("rates", " union all ".join(pairs))]


RATES, FS_OUT = (4.0, 8.0), 5.0
RATE_CTES = rate_ctes(RATES, FS_OUT)


def polyphase_sql(cols, src="tag"):
    sums = ", ".join(f"sum(s.{c} * taps.h) as {c}" for c in cols)
    return f"""
select s.record_id, s.seg_start, s.fs, m.m, {sums} from {src} s join rates r on r.fs = s.fs
join (select distinct t.record_id, t.seg_start, unnest(range(cast(ceil((t.seg_end - t.seg_start) * r.up / cast(r.down as double)) as bigint))) as m
 from (select distinct record_id, seg_start, seg_end, fs from {src}) t join rates r on r.fs = t.fs where t.seg_end - t.seg_start >= 2) m
 on m.record_id = s.record_id and m.seg_start = s.seg_start
join taps on taps.fs = s.fs and taps.t = r.half + m.m * r.down - (s.i - s.seg_start) * r.up group by s.record_id, s.seg_start, s.fs, m.m"""


def rated(spark, d, cols, gaps=(23, 29, 31)):
    s = V.two_rates(V.samples(spark, d, gaps))
    return tag_segments(s, segs(s, cols))


@query("e4_resample_polyphase", with_(("one_rate", V.SQL["samples"]), ("samples", V.TWO_RATES_SQL), segments_sql(FINITE3, 8), TAG, *RATE_CTES,
       ("o", polyphase_sql(["ppg", "abp"]))) + f"""
select record_id, seg_start, cast(m as bigint) as m, {rs('ppg', 'abp')} from o""")
def e4(spark, d):
    t = rated(spark, d, ("ecg", "ppg", "abp")).withColumn("ppg", F.col("ppg").cast("double"))
    return tidy(S.resample_polyphase(t, ["ppg", "abp"], None, FS_OUT, block=16).drop("seg_end"))


ZSQL = ("z", """
select *, case when stddev_pop({c}) over w > 1e-12 then ({c} - avg({c}) over w) / stddev_pop({c}) over w else 0.0 end as z
from tag window w as (partition by record_id, seg_start)""")


@query("e5_zscore", with_("samples", segments_sql(FINITE3, 4), TAG, (ZSQL[0], ZSQL[1].format(c="ecg"))) + f"""
select record_id, i, {r('z')} from z""")
def e5(spark, d):
    t = tagged(spark, d, n=4)
    return tidy(S.zscore(t, "ecg", "z", "zero").select("record_id", "i", "z"))


@query("e5_zscore_drop", with_("samples", segments_sql(FINITE3, 4), ("tag0", TAG[1]), ("tag", "select * from (select *, stddev_pop(abp) over (partition by record_id, seg_start) as sd from tag0) where sd > 1e-12"),
       (ZSQL[0], ZSQL[1].format(c="abp"))) + f"""
select record_id, i, {r('z')} from z""")
def e5b(spark, d):
    t = tagged(spark, d, n=4)
    return tidy(S.zscore(t, "abp", "z", "drop").select("record_id", "i", "z"))


UNIT_SQL = ("unit", """
select *, case when sd > 1e-12 then -1.0 + 2.0 * ((ppg - m) / sd - (lo - m) / sd) / ((hi - m) / sd - (lo - m) / sd) end as u from (
 select *, avg(ppg) over w as m, stddev_pop(ppg) over w as sd, min(ppg) over w as lo, max(ppg) over w as hi
 from wp window w as (partition by split, record_id, window_index))""")


@query("e6_unit_range", with_(*BASE, UNIT_SQL) + f"""
select split, record_id, window_index, cast(j as int) as pos, {r('u')} from unit where u is not null""")
def e6(spark, d):
    w = sample_windows(spark, d).withColumn("u", A.unit_range("ppg")).where("u is not null")
    return long(w, "u")


@query("e7_minmax", with_(*BASE, ("rs", resample_sql("wp", 16, 20, 18, ["ppg", "abp"])), ("k", """
select min(ppg) as p0, max(ppg) as p1, min(abp) as a0, max(abp) as a1 from rs where split in ('train', 'val')""")) + f"""
select split, record_id, window_index, cast(pos as int) as pos, {r('(ppg - p0) / (p1 - p0)', 'ppg')}, {r('(abp - a0) / (a1 - a0)', 'abp')} from rs, k""")
def e7(spark, d):
    w = sample_windows(spark, d)
    w = w.withColumns({c: A.resample_linear(c, 20, 18) for c in ("ppg", "abp")})
    return long(S.apply_minmax(w, S.fit_minmax(w, ["ppg", "abp"]), ["ppg", "abp"]), "ppg", "abp")


@query("e8_gradient_kernel", with_(*BASE) + f"""
select split, record_id, window_index, cast(j as int) as pos, {r('coalesce(lead(ppg) over w, 0) - coalesce(lag(ppg) over w, 0)', 'g')}
from wp window w as (partition by split, record_id, window_index order by j)""")
def e8(spark, d):
    return long(sample_windows(spark, d).withColumn("g", A.gradient_kernel("ppg")), "g")


def gradient_sql(src, c, out):
    return (f"select *, case when i = seg_start then lead({c}) over w - {c} when i = seg_end - 1 then {c} - lag({c}) over w "
            f"else (lead({c}) over w - lag({c}) over w) / 2 end as {out} from {src} window w as (partition by record_id, seg_start order by i)")


@query("e9_derivatives", with_("samples", segments_sql(FINITE3, 4), TAG, ("g1", gradient_sql("tag", "ppg", "vpg")),
       ("g2", gradient_sql("g1", "vpg", "apg")), ("g3", gradient_sql("g2", "apg", "jpg"))) + f"""
select record_id, i, {rs('vpg', 'apg', 'jpg')} from g3""")
def e9(spark, d):
    t = tagged(spark, d, n=4)
    return tidy(S.derivatives(t, "ppg", block=16).select("record_id", "i", "vpg", "apg", "jpg"))


@query("e10_smooth_zero_phase", with_("samples", segments_sql(FINITE3, 10), TAG, ("ends", """
select record_id, seg_start, seg_end, arg_min(ppg, i) as x0, arg_max(ppg, i) as x1 from tag group by record_id, seg_start, seg_end"""),
       ("ext", """
select record_id, seg_start, seg_end, i, ppg as x from tag union all
select t.record_id, t.seg_start, t.seg_end, 2 * t.seg_start - t.i, 2 * x0 - ppg from tag t join ends e using (record_id, seg_start) where t.i > t.seg_start and t.i <= t.seg_start + 9 union all
select t.record_id, t.seg_start, t.seg_end, 2 * (t.seg_end - 1) - t.i, 2 * x1 - ppg from tag t join ends e using (record_id, seg_start) where t.i < t.seg_end - 1 and t.i >= t.seg_end - 10"""),
       ("f", "select *, avg(x) over (partition by record_id, seg_start order by i rows between 2 preceding and current row) as f from ext"),
       ("b", "select *, avg(f) over (partition by record_id, seg_start order by i rows between current row and 2 following) as b from f")) + f"""
select record_id, i, {r('b', 'smooth')} from b where i >= seg_start and i < seg_end""")
def e10(spark, d):
    t = tagged(spark, d, n=10)
    return tidy(S.smooth_zero_phase(t, "ppg", "smooth", 3, block=16).select("record_id", "i", "smooth"))


@query("e11_pad_multiple", with_(*BASE) + f"""
select split, record_id, window_index, cast(j as int) as pos, {r('ppg', 'x')} from wp union all
select distinct split, record_id, window_index, cast(unnest([16, 17, 18, 19]) as int), 0.0 from wp""")
def e11(spark, d):
    w = sample_windows(spark, d)
    return long(w.withColumn("x", A.pad_multiple("ppg", 5)), "x")


@query("e12_block_pyramid", with_(*BASE) + " union all ".join(f"""
select split, record_id, window_index, {k} as level, cast(floor(j / {k}) as int) as pos, {r('avg(abp)', 'x')} from wp
group by split, record_id, window_index, floor(j / {k})""" for k in (2, 4, 8, 16)))
def e12(spark, d):
    w = sample_windows(spark, d)
    levels = F.array(*[F.struct(F.lit(k).alias("level"), A.block_means("abp", k).alias("x"))
                       for k in (2, 4, 8, 16)])
    rows = w.select(*KEYS, F.explode(levels).alias("l")).select(*KEYS, "l.level", "l.x")
    return long(rows, "x", keys=KEYS + ["level"])


@query("e13_pack_slots", with_(*BASE) + """
select split, record_id, window_index, slot, cast(16 * slot + j as int) as pos, round(x, 8) + 0.0 as x, round(x, 8) + 0.0 as viewed from (
 select split, record_id, window_index, 0 as slot, j, ppg as x from wp union all
 select split, record_id, window_index, 1, j, (abp - 100) / 50 from wp union all
 select split, record_id, window_index, 2, j, ppg from wp union all
 select split, record_id, window_index, 3, j, 0.0 from wp)""")
def e13(spark, d):
    w = sample_windows(spark, d)
    scaled = F.transform("abp", lambda v: (v - 100.0) / 50.0)
    w = w.withColumn("full", A.pack_slots("ppg", scaled, "ppg"))
    views = F.array(*[F.struct(F.lit(n).alias("slot"), A.only_slot(A.slot_view("full", n), n).alias("one"))
                      for n in range(4)])
    rows = w.select(*KEYS, "full", F.explode(views).alias("v")).select(
        *KEYS, "v.slot", F.col("full").alias("x"), F.col("v.one").alias("viewed"))
    out = long(rows, "x", "viewed", keys=KEYS + ["slot"])
    return out.where(F.floor(F.col("pos") / 16) == F.col("slot"))


LABELLED = ("lab", """
select record_id, seg_start, fs, cast(floor(k * 5) as bigint) as a, max(abp) as sbp, min(abp) as dbp, avg(abp) as mean_p, sum(z * (m - k * 5)) as moment, count(*) as n
from (select o.*, unnest(range(greatest(0, cast(ceil((m - 9) / 5.0) as bigint)), cast(floor(m / 5.0) as bigint) + 1)) as k from o) group by record_id, seg_start, fs, k having count(*) = 10""")
VIEW_BAND = (0.2, 1.5)


def band_pass_ctes(src, name):
    """The recurrence sample by sample over mirrored lists, one section after the other, there and back."""
    sections = {fs: (X_filters.band_pass_sections(fs, *VIEW_BAND), X_filters.steady_state(X_filters.band_pass_sections(fs, *VIEW_BAND)))
                for fs in RATES}
    n = X_filters.reach_of(sections[RATES[0]][0])
    out = [(name + "_l", f"""
select record_id, seg_start, seg_end, fs, list(z order by i) as x, list(abp order by i) as p from {src} group by record_id, seg_start, seg_end, fs having count(*) > {n}"""),
           (name + "_e", f"""
select *, list_concat([2 * x[1] - v for v in list_reverse(x[2:{n + 1}])], x, [2 * x[len(x)] - v for v in list_reverse(x[len(x) - {n}:len(x) - 1])]) as y from {name}_l""")]
    last = name + "_e"
    for turn in ("f", "b"):
        out.append((f"{name}_{turn}", f"select *, y[1] as c0 from {last}" if turn == "f" else
                    f"select * exclude (c0) replace (list_reverse(y) as y), y[len(y)] as c0 from {last}"))
        last = f"{name}_{turn}"
        for k in range(4):
            values = [f"select cast({fs} as double) as fs, {', '.join(f'cast({float(v)!r} as double) as {c}' for c, v in zip(('b0', 'b1', 'b2', 'a1', 'a2', 's1', 's2'), [*sos[k], *rest[2 * k:2 * k + 2]]))}"
                      for fs, (sos, rest) in sections.items()]
            out += [(f"{name}_{turn}c{k}", " union all ".join(values)), (f"{name}_{turn}{k}", f"""
select t.* replace (list_reduce(y, lambda acc, v: list_concat([b1 * v - a1 * (b0 * v + acc[1]) + acc[2], b2 * v - a2 * (b0 * v + acc[1])], acc[3:], [b0 * v + acc[1]]),
 [s1 * c0, s2 * c0]::DOUBLE[])[3:] as y) from {last} t join {name}_{turn}c{k} c on c.fs = t.fs""")]
            last = f"{name}_{turn}{k}"
    out.append((name, f"""
select record_id, seg_start, seg_end, fs, seg_start + unnest(range(len(p))) as i, unnest(list_reverse(y)[{n + 1}:len(y) - {n}]) as z, unnest(p) as abp from {last}"""))
    return out


@query("e14_labelled_segments", with_(("one_rate", V.few_gaps_sql()), ("samples", V.TWO_RATES_SQL), segments_sql("ppg is not null and abp is not null", 8), ("tag0", TAG[1]),
       ("tag", "select * from (select *, stddev_pop(ppg) over (partition by record_id, seg_start) as sd from tag0) where sd > 1e-12"),
       (ZSQL[0], ZSQL[1].format(c="ppg")), *band_pass_ctes("z", "zb"), *RATE_CTES, ("o", polyphase_sql(["z", "abp"], "zb")), LABELLED) + f"""
select record_id, seg_start, a as target_start_index, a + 10 as target_end_index,
 {r('(seg_start + round_even(a * fs / 5.0, 0)) / fs', 'target_start_sec')}, {r('(seg_start + round_even((a + 10) * fs / 5.0, 0)) / fs', 'target_end_sec')},
 {rs('sbp', 'dbp')}, {r('mean_p', 'map_mean')}, {r('moment')} from lab""")
def e14(spark, d):
    t = rated(spark, d, ("ppg", "abp"), V.FEW_GAPS)
    out = S.labelled_segments(t, "ppg", "abp", None, FS_OUT, 10, 5, block=16, band=VIEW_BAND)
    moment = A.array_sum(F.transform("ppg", lambda x, i: x * i))
    return tidy(out.select("record_id", "seg_start", "target_start_index", "target_end_index",
                           "target_start_sec", "target_end_sec", "sbp", "dbp",
                           F.col("map").alias("map_mean"), moment.alias("moment")))


@query("e15_case_labels", with_("scalar_preds") + f"""
select case when subject_id % 9 = 0 then null else cast(subject_id as varchar) end as subject_id, case_key % 10 as case_key, count(*) as n_segments,
 {r('avg(sbp_true)', 'sbp')}, {r('avg(dbp_true)', 'dbp')}, {r('avg(map_true)', 'map')} from scalar_preds group by 1, 2""")
def e15(spark, d):
    p = V.scalar_preds(spark, d)
    s = p.select(F.when(F.col("subject_id") % 9 != 0, F.col("subject_id").cast("string")).alias("subject_id"),
                 (F.col("case_key") % 10).alias("case_key"), F.col("sbp_true").alias("sbp"),
                 F.col("dbp_true").alias("dbp"), F.col("map_true").alias("map"))
    return tidy(S.case_labels(s, ["subject_id", "case_key"]))


@query("e16_apply_mask", with_("points") + f"""
select window_id, i, {r('case when i % 3 <> 0 then y_true end', 'y_true')}, {r('case when i % 3 <> 0 then y_pred end', 'y_pred')} from points""")
def e16(spark, d):
    from pulsemill.plans.jobs import explode_points
    p = explode_points(V.windows(spark, d), ["window_id"]).withColumn(
        "i", F.col("i").cast("bigint")).withColumn("m", F.col("i") % 3 != 0)
    return tidy(apply_mask(p, "m", ["y_true", "y_pred"]).select("window_id", "i", "y_true", "y_pred"))


# ---------------------------------------------------------------- peaks and beats

def peaks_sql(name, src, key, x="x"):
    """CTEs that find peaks. `src` has rows (key, i, x, dist, thr); the last CTE is `name`
    with (key, p)."""
    k = ", ".join(key)
    on = lambda a, b: " and ".join(f"{a}.{c} = {b}.{c}" for c in key)
    pre = name + "_"
    return [
        (pre + "chg", f"select *, case when {x} <> lag({x}) over (partition by {k} order by i) then 1 else 0 end as c from {src}"),
        (pre + "grp", f"select *, sum(c) over (partition by {k} order by i) as g from {pre}chg"),
        (pre + "run", f"select {k}, g, min(i) as s, max(i) as e, min({x}) as v, min(dist) as dist, min(thr) as thr from {pre}grp group by {k}, g"),
        (pre + "top", f"""select {k}, (s + e) // 2 as p, v, dist, thr from (
 select *, lag(v) over (partition by {k} order by g) as a, lead(v) over (partition by {k} order by g) as b from {pre}run) where v > a and v > b"""),
        (pre + "far", f"""select {k}, thr, unnest(list_reduce(list(cast(p as bigint) order by v desc, p desc), lambda acc, q:
 case when len(list_filter(acc, lambda z: abs(z - q) < dist)) = 0 then list_append(acc, q) else acc end, []::BIGINT[])) as p
 from {pre}top group by {k}, dist, thr"""),
        (pre + "h", f"select f.*, s.{x} as v from {pre}far f join {src} s on {on('f', 's')} and s.i = f.p"),
        (pre + "lim", f"""select {', '.join('h.' + c for c in key)}, h.p, h.v, h.thr, max(case when s.i < h.p and s.{x} > h.v then s.i end) as lo,
 min(case when s.i > h.p and s.{x} > h.v then s.i end) as hi from {pre}h h join {src} s on {on('h', 's')} group by {', '.join('h.' + c for c in key)}, h.p, h.v, h.thr"""),
        (name, f"""select {', '.join('l.' + c for c in key)}, l.p from {pre}lim l join {src} s on {on('l', 's')}
 group by {', '.join('l.' + c for c in key)}, l.p, l.v, l.thr
 having l.v - greatest(min(case when s.i <= l.p and s.i > coalesce(l.lo, -1) then s.{x} end), min(case when s.i >= l.p and s.i < coalesce(l.hi, 1e15) then s.{x} end)) >= l.thr"""),
    ]


WINDOW_X = ("wx", """
select window_id, i, y_true as x, greatest(1, round_even(0.3 * count(*) over w / 4.0, 0)) as dist, greatest(1e-6, 0.1 * stddev_pop(y_true) over w) as thr
from (select * from points where window_id in (select window_id from points group by window_id having count(*) >= 8 and count(y_true) = count(*)))
window w as (partition by window_id)""")
WINDOW_PEAKS = [WINDOW_X, *peaks_sql("pk", "wx", ["window_id"])]
BEAT_CUTS = ("cuts", """
select window_id, p as peak, coalesce((lag(p) over w + p) // 2, 0) as beat_start, coalesce((p + lead(p) over w) // 2, n) as beat_end
from pk join (select window_id, count(*) as n from points group by window_id) using (window_id) window w as (partition by window_id order by p)""")
SEGS = ("bsegs", "select * from cuts where beat_end - beat_start >= 3 and peak >= beat_start and peak < beat_end")
STATS = ("bstats", """
select s.window_id, s.beat_start, s.peak, max(case when p.i = s.peak then y_true end) as t_sbp, min(y_true) as t_dbp, avg(y_true) as t_map, count(y_true) = count(*) as t_ok,
 max(case when p.i = s.peak then y_pred end) as p_sbp, min(y_pred) as p_dbp, avg(y_pred) as p_map, count(y_pred) = count(*) as p_ok
from bsegs s join points p on p.window_id = s.window_id and p.i >= s.beat_start and p.i < s.beat_end group by s.window_id, s.beat_start, s.peak""")


def window_segments(spark, d):
    w = V.windows(spark, d)
    return w.withColumn("peaks", P.detect_peaks("y_true", 4.0)).withColumn(
        "segs", P.beat_segments("peaks", F.size("y_true")))


@query("f1_detect_peaks", with_("points", *WINDOW_PEAKS) + "select window_id, cast(p as bigint) as peak from pk")
def f1(spark, d):
    w = V.windows(spark, d)
    return w.select("window_id", F.explode(P.detect_peaks("y_true", 4.0)).alias("peak"))


SEG_X = lambda c, sign, thr: f"""
select record_id, seg_start, i, {sign} * (case when sd > 1e-12 then ({c} - m) / sd else 0.0 end) as x, greatest(1, round_even(0.3 * fs, 0)) as dist, {thr} as thr
from (select *, avg({c}) over w as m, stddev_pop({c}) over w as sd from tag window w as (partition by record_id, seg_start))"""
TRANSIT = ["samples", segments_sql(FINITE3, 8), TAG, ("ex", SEG_X("ecg", "1.0", "0.5")), *peaks_sql("rp", "ex", ["record_id", "seg_start"]),
           ("fx", SEG_X("ppg", "-1.0", "0.1")), *peaks_sql("ft", "fx", ["record_id", "seg_start"])]


@query("f2_r_peaks_and_feet", with_(*TRANSIT) + """
select 'r' as kind, record_id, seg_start, cast(p as bigint) as peak from rp union all
select 'foot', record_id, seg_start, cast(p as bigint) from ft""")
def f2(spark, d):
    s = V.samples(spark, d)
    g = segs(s)
    rp = X.ecg_r_peaks(s, g).select(F.lit("r").alias("kind"), "record_id", "seg_start", F.col("r").alias("peak"))
    ft = X.ppg_feet(s, g).select(F.lit("foot").alias("kind"), "record_id", "seg_start", F.col("foot").alias("peak"))
    return rp.unionByName(ft)


@query("f3_beat_segments", with_("points", *WINDOW_PEAKS, BEAT_CUTS, SEGS) + """
select window_id, cast(beat_start as bigint) as beat_start, cast(beat_end as bigint) as beat_end, cast(peak as bigint) as peak from bsegs""")
def f3(spark, d):
    return window_segments(spark, d).select("window_id", F.explode("segs").alias("s")).select(
        "window_id", F.col("s.start").alias("beat_start"), F.col("s.end").alias("beat_end"),
        F.col("s.peak").alias("peak"))


@query("f4_beat_stats", with_("points", *WINDOW_PEAKS, BEAT_CUTS, SEGS, STATS) + f"""
select window_id, cast(peak as bigint) as peak, {r('p_sbp', 'sbp')}, {r('p_dbp', 'dbp')}, {r('p_map', 'map_mean')} from bstats where p_ok""")
def f4(spark, d):
    w = window_segments(spark, d).select("window_id", F.explode(P.beat_stats("y_pred", "segs")).alias("b"))
    return tidy(w.select("window_id", "b.peak", "b.sbp", "b.dbp", F.col("b.map").alias("map_mean")))


PAIRS = [("feet", """
select record_id, seg_start, p as foot, lead(p) over w as next_foot, count(*) over (partition by record_id, seg_start) as nf from ft
window w as (partition by record_id, seg_start order by p)"""),
         ("lab", """
select r.record_id, r.seg_start, r.p as r, min(f.foot) as foot from rp r left join feet f on f.record_id = r.record_id and f.seg_start = r.seg_start
 and f.nf >= 2 and f.foot >= r.p + round_even(0.08 * 4, 0) and f.foot <= r.p + round_even(0.5 * 4, 0) group by r.record_id, r.seg_start, r.p"""),
         ("lab2", """
select l.*, f.next_foot, case when l.foot is null then 'no_ppg_foot' when f.next_foot is null then 'no_next_ppg_foot' end as drop_reason
from lab l left join feet f on f.record_id = l.record_id and f.seg_start = l.seg_start and f.foot = l.foot"""),
         ("beats", """
select l.record_id, l.seg_start, l.r, l.foot, l.next_foot, (l.foot - l.r) / 4.0 as ptt_sec, max(s.abp) as sbp_true, min(s.abp) as dbp_true, avg(s.abp) as map_true,
 max(s.split) as split, max(s.subject_id) as subject_id
from lab2 l join samples s on s.record_id = l.record_id and s.i >= l.foot and s.i < l.next_foot where l.drop_reason is null
group by l.record_id, l.seg_start, l.r, l.foot, l.next_foot""")]
EXTRACT = {"min_segment_sec": 2.0}


@query("f5_pair_ptt", with_(*TRANSIT, *PAIRS) + f"""
select record_id, cast(r as bigint) as ecg_r_index, cast(foot as bigint) as ppg_foot_index, cast(next_foot as bigint) as next_ppg_foot_index,
 cast(row_number() over (partition by record_id order by r) - 1 as bigint) as beat_index_in_record, {rs('ptt_sec', 'sbp_true', 'dbp_true', 'map_true')} from beats""")
def f5(spark, d):
    beats = X.extract_beats(V.samples(spark, d), **EXTRACT)[0]
    return tidy(X.number_beats(beats).select(
        "record_id", F.col("r").alias("ecg_r_index"), F.col("foot").alias("ppg_foot_index"),
        F.col("next_foot").alias("next_ppg_foot_index"), "beat_index_in_record", "ptt_sec",
        "sbp_true", "dbp_true", "map_true"))


@query("f6_extraction_report", with_(*TRANSIT, *PAIRS) + """
select (select count(distinct record_id) from samples) as records, (select count(distinct record_id) from beats) as records_with_beats,
 (select count(*) from segs) as finite_segments, (select count(*) from ft) as ppg_feet, count(*) as r_peaks, count(*) as candidate_r_peaks,
 count(case when drop_reason is null then 1 end) as paired_beats, count(case when drop_reason = 'no_ppg_foot' then 1 end) as dropped_no_ppg_foot,
 count(case when drop_reason = 'no_next_ppg_foot' then 1 end) as dropped_no_next_ppg_foot, cast(0 as bigint) as dropped_empty_abp_interval from lab2""")
def f6(spark, d):
    s = V.samples(spark, d)
    return X.extraction_report(s, *X.extract_beats(s, **EXTRACT))


@query("f7_pulse_triplets", with_("points", *WINDOW_PEAKS, ("tri", """
select * from (select window_id, p, lag(p) over w as a, lead(p) over w as b from pk window w as (partition by window_id order by p)) where a is not null and b is not null and p - a >= 3 and b - p >= 3"""),
       ("tro", """
select t.window_id, t.p, arg_min(case when q.i < t.p then q.i end, case when q.i < t.p then (q.y_true, q.i) end) as tb,
 arg_min(case when q.i >= t.p then q.i end, case when q.i >= t.p then (q.y_true, q.i) end) as ta, max(case when q.i = t.p then y_true end) as top,
 min(case when q.i < t.p then y_true end) as lo1, min(case when q.i >= t.p then y_true end) as lo2
from tri t join points q on q.window_id = t.window_id and q.i >= t.a and q.i < t.b group by t.window_id, t.p, t.a, t.b""")) + f"""
select window_id, cast(p as bigint) as peak, cast(tb as bigint) as trough_before, cast(ta as bigint) as trough_after, {r('top - least(lo1, lo2)', 'pulse_pressure')}
from tro where tb < p and p < ta and top - least(lo1, lo2) > 0""")
def f7(spark, d):
    w = V.windows(spark, d).withColumn("peaks", P.detect_peaks("y_true", 4.0))
    return tidy(P.pulse_triplets(w, "y_true", "peaks", ["window_id"]))


@query("f8_decay_tau", with_("tau_samples", ("t", """
select segment_id, count(*) as n_samples, min(p - p_inf) as lo, regr_slope(ln(p - p_inf), i * dt) as slope from tau_samples group by segment_id""")) + f"""
select segment_id, n_samples, {r('case when n_samples >= 3 and lo > 1e-6 and slope < 0 then ln(-1 / slope) end', 'log_tau')} from t""")
def f8(spark, d):
    from pulsemill.operators.runs import decay_tau
    return tidy(decay_tau(V.tau_samples(spark, d)))


@query("s9_write_beat_predictions", with_(*TRANSIT, *PAIRS) + f"""
select split, record_id, cast(row_number() over (partition by record_id order by r) - 1 as bigint) as beat_index_in_record,
 cast(r as bigint) as ecg_r_index, {rs('ptt_sec', 'sbp_true', 'map_true')}, {r('sbp_true + 1', 'sbp_pred')} from beats""")
def s9(spark, d):
    from pulsemill.functions import fixed
    path = scratch_path(spark, "beats")
    keys = ["split", "subject_id", "record_id"]
    beats = X.number_beats(X.extract_beats(V.samples(spark, d), keys=keys, **EXTRACT)[0], keys)
    beats = beats.withColumns({
        "source": F.lit("events"), "hadm_id": F.lit(None).cast("string"),
        "source_start_index": F.col("foot"), "source_end_index": F.col("next_foot"),
        "ecg_r_index": F.col("r"), "ppg_foot_index": F.col("foot"),
        "next_ppg_foot_index": F.col("next_foot"),
        **{f"{m}_pred": F.col(f"{m}_true") + 1 for m in fixed.SCALAR_METRICS}})
    results.write_beat_predictions(beats, path)
    back = spark.read.option("header", True).csv(path)
    return tidy(back.select(
        "split", F.col("record_id").cast("bigint").alias("record_id"),
        F.col("beat_index_in_record").cast("bigint").alias("beat_index_in_record"),
        F.col("ecg_r_index").cast("bigint").alias("ecg_r_index"),
        *[F.col(c).cast("double").alias(c) for c in ("ptt_sec", "sbp_true", "map_true", "sbp_pred")]))
