"""Quality rules: a table of thresholds compiled into one projection.

Words are runs of characters other than ASCII white space. NULL and empty texts have no
words, fail the base rule and are not kept. Rows are independent, so ties, repeated rows and
empty tables need no care; extra columns of the input are not read.
"""

from pyspark.sql import Column, DataFrame, functions as F

# Frequent function words of four languages.
STOP_WORDS = [
    "the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "with", "as", "was", "on",
    "der", "die", "und", "den", "das", "von", "zu", "mit", "ist", "ein", "eine", "sich", "im",
    "de", "la", "le", "et", "les", "des", "en", "un", "une", "du", "est", "pour", "dans", "que",
    "el", "y", "los", "del", "las", "por", "con", "se", "su", "al", "lo", "es", "no", "para"]

# metric, lowest, highest: a document outside any of them is not kept. All are in percent of
# the named base, so that every comparison is one of whole numbers.
THRESHOLDS = [
    ("word_chars", "n_words", 150, 1500),
    ("n_symbols", "n_words", None, 30),
    ("n_stop_words", "n_words", 2, None),
    ("n_upper_words", "n_words", None, 60),
    ("n_dup_lines", "n_lines", None, 50),
    ("n_bullet_lines", "n_lines", None, 90),
    ("n_ellipsis_lines", "n_lines", None, 30),
]
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SPACE = r"[\x20\x09-\x0D]"


def measures(text: Column, df: DataFrame) -> DataFrame:
    """Add the count columns of every rule; each step is a plain projection."""
    t = F.coalesce(text, F.lit(""))
    df = df.withColumn("__t", t).withColumn(
        "__trim", F.regexp_replace("__t", f"^{SPACE}+|{SPACE}+\\z", ""))
    df = df.withColumn("__w", F.when(F.col("__trim") == "", F.array().cast("array<string>"))
                       .otherwise(F.split("__trim", SPACE + "+")))
    df = df.withColumn("__lines", F.filter(F.split("__t", "\n"),
                                           lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    n = F.size("__w").cast("long")
    # 3-word windows in the order of their hash, then their words, so that equal ones stand together
    # whatever else has the same hash.
    df = df.withColumn("n_words", n).withColumn("__s", F.expr("""sort_array(transform(
        case when size(__w) < 3 then array() else sequence(0, size(__w) - 3) end, i -> struct(
            xxhash64(__w[i], __w[i + 1], __w[i + 2]) as h, __w[i] as a, __w[i + 1] as b, __w[i + 2] as c, i as i)))"""))
    same = " and ".join(f"__s[j].{f} = __s[j {{d}} 1].{f}" for f in "habc")
    df = df.withColumn("__hit", F.expr(f"""case when size(__s) < 2 then array() else
        transform(filter(sequence(0, size(__s) - 1), j -> (j > 0 and {same.format(d='-')})
                         or (j < size(__s) - 1 and {same.format(d='+')})), j -> __s[j].i) end"""))
    df = df.withColumn("n_repeat_words", F.expr("""cast(size(array_distinct(flatten(transform(
        __hit, i -> array(i, i + 1, i + 2))))) as bigint)"""))

    def gone(pattern):
        return (F.length("__t") - F.length(F.regexp_replace("__t", pattern, ""))).cast("long")

    def share(name, cond):
        return F.size(F.filter(name, cond)).cast("long")

    lines = F.col("__lines")
    return df.select(
        *[c for c in df.columns if not c.startswith("__")],
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        gone("[#*$%&|<>]").alias("n_symbols"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        share("__w", lambda x: x.isin(STOP_WORDS)).alias("n_stop_words"),
        share("__w", lambda x: x.rlike("^[A-Z][A-Z]+[!.,?]*\\z")).alias("n_upper_words"),
        share("__lines", lambda x: x.rlike(r"^[\x20\x09]*[-*•]")).alias("n_bullet_lines"),
        share("__lines", lambda x: x.rlike(r"(\.\.\.|…)\z")).alias("n_ellipsis_lines"))


def verdict(thresholds=THRESHOLDS) -> Column:
    """All thresholds as one condition."""
    ok = F.lit(True)
    for metric, base, low, high in thresholds:
        scaled, n = F.col(metric) * 100, F.col(base)
        if low is not None:
            ok = ok & (scaled >= n * low)
        if high is not None:
            ok = ok & (scaled <= n * high)
    return ok


def judge(docs: DataFrame, thresholds=THRESHOLDS) -> DataFrame:
    """doc_id, all counts, base_failed and kept for every document."""
    m = measures(F.col("text"), docs.select("doc_id", "text")).drop("text")
    failed = (F.col("n_words") < MIN_WORDS) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    m = m.withColumn("base_failed", failed)
    return m.withColumn("kept", ~F.col("base_failed") & verdict(thresholds))


def judge_sql(thresholds=THRESHOLDS) -> str:
    """The same over a `documents` view for another SQL engine."""
    rules = []
    for metric, base, low, high in thresholds:
        if low is not None:
            rules.append(f"{metric} * 100 >= {base} * {low}")
        if high is not None:
            rules.append(f"{metric} * 100 <= {base} * {high}")
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return f"""
with base as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
w0 as (select r, doc_id, t, [x for x in string_split_regex(t, '[\\x20\\x09-\\x0D]+') if x <> ''] as w,
 [x for x in string_split(t, chr(10)) if regexp_matches(x, '[^\\x20\\x09-\\x0D]')] as ls from base),
pos as (select r, unnest(w) as a, unnest(range(len(w))) as i, w from w0),
win as (select r, i, w[i + 1] as a, w[i + 2] as b, w[i + 3] as c from pos where i + 3 <= len(w)),
dup as (select r, i, count(*) over (partition by r, a, b, c) as k from win),
cov as (select r, count(distinct i + d) as n_repeat_words from
 (select r, i, unnest([0, 1, 2]) as d from dup where k > 1) group by r),
m as (select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_repeat_words, 0) as n_repeat_words,
 cast(length(array_to_string(w, '')) as bigint) as word_chars,
 cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
 cast(len(ls) as bigint) as n_lines, cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines,
 cast(len([x for x in w if x in ({stop})]) as bigint) as n_stop_words,
 cast(len([x for x in w if regexp_matches(x, '^[A-Z][A-Z]+[!.,?]*\\z')]) as bigint) as n_upper_words,
 cast(len([x for x in ls if regexp_matches(x, '^[\\x20\\x09]*[-*•]')]) as bigint) as n_bullet_lines,
 cast(len([x for x in ls if regexp_matches(x, '(\\.\\.\\.|…)\\z')]) as bigint) as n_ellipsis_lines
 from w0 left join cov using (r)),
f as (select *, n_words < {MIN_WORDS} or n_repeat_words * 100 > n_words * {MAX_REPEAT_PERCENT} as base_failed from m)
select *, not base_failed and {' and '.join(rules)} as kept from f"""
