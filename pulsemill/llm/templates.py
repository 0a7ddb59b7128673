"""HTML extraction by template deduction over the pages of a host.

Tokens are tags and texts with the path of structural elements above them. The occurrence vector
of a token says how often each page of the host has it; it is kept as two sums of a mixing
function of page and count, which add up in any order, so a host of any size is handled by
partial sums. Tokens with equal vectors form an equivalence class. The class of tokens that
every page has once is the root of the template, classes of elements below it nest by their
paths. What lies between the tokens of the template are slots; the main slot is the innermost
element, once on its pages and no leaf block, that holds most of the text outside links and outside elements
that are known not to be content, or its highest ancestor, up to an article, main or body element, that adds
such text which is not common to the host's pages. Texts of the root class belong to the template.

Inside the main element, everything is kept in page order except such non-content elements.
Pages without that element (another layout, an unknown host, a single page) use their whole body by
the same rules, less the texts of the root class. Equal pages of a host count as one, and a host of fewer than
ROOT_PAGES different pages has no root class and no main element.
NULL and empty html give an empty text; NULL urls count as one host. Repeated
rows are extracted each; extra columns are not read. A table without pages gives no rows.
"""

import html as entities
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from pulsemill.llm import batches
from pulsemill.llm.url_rules import host_and_path
from pulsemill.sources.storage import materialize

ROOT_PAGES, COMMON, MAIN_SHARE = 5, 0.2, 0.6
TOKENS_HELD = 300_000

# Element kinds of the markup language and usual names of parts around articles.
BLOCKS = set("address article aside blockquote body br caption center dd details dialog div dl dt "
             "fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li "
             "main nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
STACKED = BLOCKS - {"br", "hr"} | {"button", "select", "iframe", "svg", "object", "map"}
RAW = "script|style|noscript|template|textarea|xmp"
NEVER = set("nav aside footer form header head title button select iframe svg object map dialog menu".split())
LEAVES = set("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote caption figcaption legend option summary".split())
TOPS = {"article", "main", "body", "html"}
NAMES = set("ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments cookie "
            "cookies consent disqus footer header masthead menu nav navbar navigation newsletter notice "
            "notices pager pagination popup promo related share sharing sidebar social sponsor sponsored "
            "subscribe subscription toolbar widget".split())

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>"
    r"|<[/!?a-zA-Z][^>]*(?:>|\Z)|([^<]+|<)", re.S | re.I)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPACE = re.compile(r"\s+")
_DIGITS = re.compile(r"\d+")


class Walk:
    """Events of one page: (text, path, in link, not content) per text and the opened paths."""

    def __init__(self, page: str):
        self.opened, self.texts = [], []
        stack, never, link = [], 0, 0
        path = ""
        for m in _TOKEN.finditer(page):
            name = m[3]
            if m[5] is not None:
                self.texts.append((m[5], path, link > 0, never > 0))
            elif name:
                name = name.lower()
                if name == "a":
                    link = 0 if m[2] else 1
                if name in BLOCKS:
                    self.texts.append((None, path, False, never > 0))
                if name not in STACKED:
                    continue
                if m[2]:
                    for k in range(len(stack) - 1, -1, -1):
                        if stack[k][0] == name:
                            never -= sum(s[2] for s in stack[k:])
                            path = stack[k][1]
                            del stack[k:]
                            link = 0
                            break
                    continue
                while stack and _ends(stack[-1][0], name):
                    never -= stack[-1][2]
                    path = stack.pop()[1]
                words = " ".join(a or b or c for a, b, c in _NAMED.findall(m[4])).lower()
                words = _DIGITS.sub("0", words)
                parts = set(re.split(r"[^a-z]+", words))
                skip = name in NEVER or bool(parts & NAMES)
                stack.append((name, path, skip))
                never += skip
                path = f"{path}>{name}" + (f".{'.'.join(words.split())}" if words else "")
                self.opened.append(path)


def _ends(open_name, name):
    """Whether a new element closes an open one whose end tag may be left out."""
    if open_name == "p":
        return name in BLOCKS
    return open_name == name and name in ("li", "dt", "dd", "tr", "td", "th", "option") or (
        open_name in ("td", "th") and name in ("td", "th", "tr")) or open_name in (
        "h1", "h2", "h3", "h4", "h5", "h6") and name in BLOCKS


def plain(s: str) -> str:
    return _SPACE.sub(" ", entities.unescape(s)).strip()


def text_key(path: str, text: str) -> str:
    return f"#{path}#{xxhash.xxh64_hexdigest(text)}"


def page_tokens(page: str):
    """(token -> count, token -> words outside links and non-content, element path -> such words of its
    parent). An element has the words of all that is in it."""
    w = Walk(page)
    counts, mass = {}, {}
    for p in w.opened:
        counts[p] = counts.get(p, 0) + 1
    for text, path, link, never in w.texts:
        if text is None or text.isspace():
            continue
        k = text_key(path, plain(text))
        counts[k] = counts.get(k, 0) + 1
        if not link and not never:
            n = len(text.split())
            mass[k] = mass.get(k, 0) + n
            while path:
                mass[path] = mass.get(path, 0) + n
                path = path[:path.rindex(">")]
    return counts, mass, {p: mass.get(p[:p.rindex(">")], 0) for p in counts if not p.startswith("#")}


STATS = "host string, token string, pages long, once long, f1 long, f2 long, mass long, around long"


def token_stats(pages: DataFrame) -> DataFrame:
    """Per host and token: different pages that have it, those that have it once, vector sums, text."""
    def run(stream):
        held = {}

        def flush():
            keys = list(held)
            vals = np.array(list(held.values()), np.int64).reshape(-1, 6)
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()),
                 *[pa.array(vals[:, i]) for i in range(6)]], names=[c.split()[0] for c in STATS.split(", ")])

        for b in stream:
            for host, who, page in zip(*(b.column(c).to_pylist() for c in ("host", "page", "html"))):
                counts, mass, around = page_tokens(page or "")
                counts[""] = 1
                for t, n in counts.items():
                    h = xxhash.xxh64_intdigest(f"{who}:{n}")
                    e = held.get((host, t))
                    if e is None:
                        e = held[host, t] = [0, 0, 0, 0, 0, 0]
                    e[0] += 1
                    e[1] += n == 1
                    e[2] += h & 0x7FFFFFFF
                    e[3] += h >> 33
                    e[4] += mass.get(t, 0)
                    e[5] += around.get(t, 0)
                if len(held) >= TOKENS_HELD:
                    yield flush()
        if held:
            yield flush()

    rows = _different(pages).mapInArrow(run, STATS)
    sums = [F.sum(c).alias(c) for c in ("pages", "once", "f1", "f2", "mass", "around")]
    return rows.groupBy("host", "token").agg(*sums)


def _different(pages: DataFrame) -> DataFrame:
    """page (hash of host and html), host and html of the different pages of every host. Only pages that
    may be repeated are moved."""
    own = pages.select("html", _host().alias("host")).withColumn("page", F.xxhash64("host", "html"))
    again = materialize(own.groupBy("page").count().where("count > 1").select("page"))
    words = batches.sieve(again, "page")
    return batches.sift(own, "page", words, False).unionByName(
        batches.sift(own, "page", words).dropDuplicates(["page"]))


def _host():
    return F.coalesce(host_and_path(F.col("url"))[0], F.lit(""))


TEMPLATE = "host string, main string, constants array<string>, n_classes long"


def _name(path):
    return path[path.rfind(">") + 1:].split(".")[0]


def _deepest(elements: pd.DataFrame) -> str:
    """The innermost element with most of the text. Elements that are there once on the pages that have
    them can be slots, other than those of one paragraph or heading."""
    slots = elements[(elements["once"] == elements["pages"]) & ~elements["token"].map(_name).isin(LEAVES)]
    top = slots["mass"].max() if len(slots) else 0
    if not top:
        return ""
    deep = slots[slots["mass"] >= MAIN_SHARE * top].assign(depth=lambda d: d["token"].str.count(">"))
    return deep.sort_values(["depth", "mass", "token"], ascending=[False, False, True])["token"].iloc[0]


def _widened(main: str, elements: pd.DataFrame, texts: pd.DataFrame) -> str:
    """The highest ancestor that adds text besides that of many pages, or the element itself."""
    known = {t: (m, a, o == p) for t, m, a, o, p in zip(*(elements[c] for c in ("token", "mass", "around", "once", "pages")))}
    shared = [(t[1:t.rindex("#")], m) for t, m in zip(texts["token"], texts["mass"])]
    at, more = main, False
    while at and _name(at) not in TOPS:
        up = at[:at.rindex(">")]
        mass, around, _ = known[at]
        more |= around - mass > sum(m for p, m in shared if _within(p, up) and not _within(p, at))
        if up in known and known[up][2] and more:
            main, more = up, False
        at = up
    return main


def deduce(pages: DataFrame) -> DataFrame:
    """One template per host: the main element, the constant texts, the number of classes."""
    stats = materialize(token_stats(pages).where("pages > 1 or token not like '#%'"))
    every = stats.where("token = ''").select("host", F.col("pages").alias("n"), F.col("f1").alias("r1"),
                                             F.col("f2").alias("r2"))
    common = stats.join(every, "host").where(F.col("pages") >= F.col("n") * COMMON)

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        root = (pdf["f1"] == pdf["r1"]) & (pdf["f2"] == pdf["r2"])
        texts = pdf["token"].str.startswith("#")
        n = int(pdf["n"].iloc[0])
        deep = _deepest(pdf[~texts & (pdf["token"] != "")]) if n >= ROOT_PAGES else ""
        main = _widened(deep, pdf[~texts], pdf[texts])
        # a whole body is not all article
        article = deep if _name(main) in ("body", "html") else main
        # what the main element has belongs to the article, even where all pages have it
        constants = sorted(t for t in pdf["token"][root & texts] if not (article and _within(t[1:t.rindex("#")], article))) \
            if n >= ROOT_PAGES else []
        classes = pdf[~texts].groupby(["f1", "f2", "pages"]).ngroups
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "main": [main],
                             "constants": [constants], "n_classes": [classes]})

    return common.groupBy("host").applyInPandas(choose, TEMPLATE)


def _within(path, main):
    return path == main or path.startswith(main + ">")


def main_text(page: str, main: str, constants) -> str:
    w = Walk(page)
    # a main element inside a non-content one does not occur: its mass would be zero
    inside = main and main in w.opened
    out, block = [], []
    for text, path, link, never in [*w.texts, (None, "", False, False)]:
        if text is None:
            t = plain("".join(block))
            if t:
                out.append(t)
            block = []
        elif not never and (not inside or _within(path, main)):
            if constants and not text.isspace() and text_key(path, plain(text)) in constants:
                continue
            block.append(text)
    return "\n".join(out)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars and main (path of the element used) for every page."""
    templates = materialize(deduce(pages)).select("host", "main", "constants")
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(stream):
        for b in stream:
            texts = [main_text(p or "", m or "", set(c or ())) for p, m, c in zip(
                *(b.column(c).to_pylist() for c in ("html", "main", "constants")))]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64()), b.column("main")],
                names=["page_id", "url", "text", "n_chars", "main"])

    return (pages.select("page_id", "url", "html", _host().alias("host")).join(templates, "host", "left")
            .mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long, main string"))
