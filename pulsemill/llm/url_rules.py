"""URL filters: pattern rules found by their rarest literal token.

A rule is a host with a path prefix (`example.net/en/`, which fits the host and its
subdomains) or a pattern (`^` a separator or the end, `*` anything) looked for anywhere in
host and path. Every rule is filed under the one of its literal tokens that the fewest urls
have; a url looks up its own tokens and runs only the regular expressions found there. Rules
without a whole literal token are run on every url.

NULL urls and urls without `://` have an empty host and path; no rule fits them and they are
allowed. The rule list is a small configuration, bounded by MAX_RULES.
"""

import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

MAX_RULES = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_DOWN = str.maketrans(UPPER, LOWER)

# Host and path rules, and the patterns used where none of them fits.
LIST_RULES = [("net/", "block"), ("example.net/en/", "allow"),
              ("example.com/de/", "block"), ("org/fr/", "allow")]
PATTERN_RULES = [
    ("-win.", "block"), ("^casino^", "block"), ("^poker^", "block"), ("^betting^", "block"),
    ("^porn^", "block"), ("^xxx^", "block"), ("^escort^", "block"), ("^warez^", "block"),
    ("^torrent^", "block"), ("^adserver^", "block"), ("^doubleclick^", "block"),
    ("^login^*^redirect^", "block"), ("^wp-login.php^", "block"), ("^cart^checkout^", "block"),
    ("^cheap-pills^", "block"), ("^free-download^*.exe^", "block")]


def compiled(rule: str, listed: bool) -> tuple:
    """(regular expression over host + path, literal tokens that every match contains whole)."""
    if listed:
        host, _, path = rule.partition("/")
        text = r"^(?:[^/]*\.)?" + re.escape(host) + re.escape("/" + path)
        # the first label and what ends in a separator are whole; a last bare piece is not
        low = path.translate(_DOWN)
        whole = re.findall(r"[a-z0-9]+", host) + re.findall(r"[a-z0-9]+(?=[^a-z0-9])", low)
        return text, whole
    text = "".join({"^": r"(?:[^a-z0-9]|^|$)", "*": ".*"}.get(c, re.escape(c)) for c in rule)
    whole = [m[1] for m in re.finditer(r"(?<=[^a-z0-9*])([a-z0-9]+)(?=[^a-z0-9*])", rule)]
    return text, whole


def host_and_path(url):
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return host, F.when(path.startswith("/"), path).otherwise("")


def addresses(pages: DataFrame) -> DataFrame:
    host, path = host_and_path(F.col("url"))
    return pages.select("page_id", "url", F.coalesce(host, F.lit("")).alias("host"),
                        F.coalesce(path, F.lit("")).alias("path"))


def _target():
    return F.concat("host", F.translate("path", UPPER, LOWER))


def rule_index(pages: DataFrame, list_rules, pattern_rules) -> tuple:
    """(token -> rules, rules to run always), with rarest tokens counted over all urls."""
    rules = [(r, a, True) for r, a in list_rules] + [(r, a, False) for r, a in pattern_rules]
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} are supported")
    made = [(r, a, listed, *compiled(r, listed)) for r, a, listed in rules]
    wanted = sorted({t for m in made for t in m[4]})
    seen = {}
    if wanted:
        spark = pages.sparkSession
        names = F.broadcast(spark.createDataFrame([(t,) for t in wanted], "token string"))
        tokens = addresses(pages).select(F.explode(F.array_distinct(
            F.regexp_extract_all(_target(), F.lit("([a-z0-9]+)"), 1))).alias("token"))
        seen = {r[0]: r[1] for r in tokens.join(names, "token", "left_semi")
                .groupBy("token").count().collect()}
    index, always = {}, []
    for rule, action, listed, pattern, whole in made:
        entry = (rule, action, listed, pattern)
        if whole:
            index.setdefault(min(whole, key=lambda t: (seen.get(t, 0), t)), []).append(entry)
        else:
            always.append(entry)
    return index, always


def judge(pages: DataFrame, list_rules=LIST_RULES, pattern_rules=PATTERN_RULES) -> DataFrame:
    """page_id, host, path, rule (the longest listed rule that fits, else NULL), pattern (the
    longest pattern that fits where no listed rule does), verdict. One row per input row."""
    index, always = rule_index(pages, list_rules, pattern_rules)

    def run(batches):
        # a listed rule keeps the case of paths; patterns look at lower case
        ready = {t: [(*e[:3], re.compile(e[3])) for e in es] for t, es in index.items()}
        rest = [(*e[:3], re.compile(e[3])) for e in always]
        words = re.compile("[a-z0-9]+")
        for b in batches:
            rules, patterns, verdicts = [], [], []
            for host, path in zip(b.column("host").to_pylist(), b.column("path").to_pylist()):
                rule, pattern, action = None, None, "allow"
                if host or path:
                    exact, low = host + path, host + path.translate(_DOWN)
                    found = [e for t in set(words.findall(low)) for e in ready.get(t, ())] + rest
                    hits = [(e[2], len(e[0]), e[0], e[1]) for e in found
                            if e[3].search(exact if e[2] else low)]
                    if hits:
                        listed, _, name, action = max(hits)
                        rule, pattern = (name, None) if listed else (None, name)
                rules.append(rule)
                patterns.append(pattern)
                verdicts.append(action)
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("host"), b.column("path"),
                 *[pa.array(x, pa.string()) for x in (rules, patterns, verdicts)]],
                names=["page_id", "host", "path", "rule", "pattern", "verdict"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return addresses(pages).select("page_id", "host", "path").mapInArrow(
        run, f"page_id {kind}, host string, path string, rule string, pattern string, verdict string")



def judge_sql(list_rules=LIST_RULES, pattern_rules=PATTERN_RULES) -> str:
    """The same over a `pages` view for another SQL engine, every rule against every url."""
    def q(s):
        return "'" + s.replace("'", "''") + "'"
    rows = [(r, a, l, compiled(r, l)[0]) for rs, l in ((list_rules, True), (pattern_rules, False))
            for r, a in rs]
    values = ", ".join(f"({q(r)}, {q(a)}, {str(l).lower()}, {q(x)})" for r, a, l, x in rows)
    return f"""
with rules(name, action, listed, pattern) as (values {values}),
a as (select row_number() over () as n, page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
p as (select n, page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') as host,
 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from a),
hit as (select n, listed, name, action, row_number() over (partition by n order by listed desc, length(name) desc, name desc) as k
 from p join rules on regexp_matches(host || case when listed then path else translate(path, '{UPPER}', '{LOWER}') end, pattern))
select page_id, host, path, case when listed then name end as rule, case when not listed then name end as pattern,
 coalesce(action, 'allow') as verdict from p left join (select * from hit where k = 1) using (n)"""
