"""Links of catalogue pages and their match with a registry of instruments."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin, urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..functions import lexicon as lx
from ..functions.tables import small, with_composed
from ..functions.text import col, fold, normalize_digits, stems, tokens

CONTEXT_CHARS = 300
_BLOCKS = frozenset("li tr td th p div article section dd dt h1 h2 h3 h4 h5 h6 figcaption caption".split())


class _Anchors(HTMLParser):
    """Anchors as (href, text, enclosing blocks); text of a block is a range of all text seen."""

    def __init__(self):
        super().__init__()
        self.seen: list[str] = []
        self.open: list[list[int]] = []  # start, end (None as long as open) of blocks that are open
        self.anchor = None
        self.found: list[tuple[str, str, list[list]]] = []

    def handle_starttag(self, tag, attrs):
        if tag in _BLOCKS:
            self.open.append([len(self.seen), None])
        elif tag == "img":
            self.handle_startendtag(tag, attrs)
        elif tag == "a":
            self.flush()
            given = dict(attrs)
            href = (given.get("href") or "").strip()
            if href and not href.lower().startswith(lx.SKIPPED_SCHEMES):
                self.anchor = (href, [given.get("title") or ""])

    def handle_startendtag(self, tag, attrs):
        if tag == "img" and self.anchor:
            self.anchor[1].append(dict(attrs).get("alt") or "")

    def handle_data(self, data):
        self.seen.append(data)
        if self.anchor:
            self.anchor[1].append(data)

    def handle_endtag(self, tag):
        if tag == "a":
            self.flush()
        elif tag in _BLOCKS and self.open:
            self.open.pop()[1] = len(self.seen)

    def flush(self):
        if self.anchor:
            self.found.append((self.anchor[0], " ".join(" ".join(self.anchor[1]).split()), self.open[::-1]))
            self.anchor = None


def find_links(html: str, base: str, same_host: bool = True) -> list[dict]:
    """Distinct http(s) links (the first of each URL) with their text, and as context the text of the smallest
    enclosing block that says more than the link, if it is short."""
    parser = _Anchors()
    parser.feed(html)
    parser.close()
    parser.flush()
    host, out = (urlparse(base).hostname or "").lower(), {}
    for href, text, around in parser.found:
        try:
            url = urldefrag(urljoin(base, href)).url
            parts = urlparse(url)
            own = (parts.hostname or "").lower()
        except ValueError:
            continue
        if parts.scheme not in ("http", "https") or same_host and own != host or url in out:
            continue
        context = ""
        for a, b in around:
            said = " ".join("".join(parser.seen[a:b]).split())
            if len(said) > len(text):
                context = said if len(said) <= CONTEXT_CHARS else ""
                break
        out[url] = {"url": url, "text": text, "context": context}
    return list(out.values())


@F.pandas_udf(ArrayType(StructType([StructField(n, StringType()) for n in ("url", "text", "context")])))
def _links(html: pd.Series, base: pd.Series, same_host: pd.Series) -> pd.Series:
    return pd.Series([find_links(h or "", b or "", s) for h, b, s in zip(html, base, same_host)])


def page_links(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html", same_host: bool = True) -> DataFrame:
    """id, position, url, text, context of the links of each page."""
    rows = pages.select(id_col, F.posexplode(_links(html, url, F.lit(same_host))).alias("position", "l"))
    return rows.select(id_col, "position", "l.*")


def host_of(url) -> Column:
    return F.lower(F.regexp_extract(col(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def allowed(rows: DataFrame, hosts: DataFrame, url: str = "url") -> DataFrame:
    """Rows whose host is in the list, exactly."""
    return rows.join(small(hosts.select(F.lower("host").alias("__host")).distinct()), host_of(url) == F.col("__host"), "left_semi")


def hops_allowed(hops: Column, hosts: list[str]) -> Column:
    """Whether every URL of a chain of redirects is on a listed host."""
    return F.forall(hops, lambda u: host_of(u).isin(hosts))


def _terms(folded) -> Column:
    return F.array_distinct(stems(F.array_join(F.filter(tokens(folded), lambda w: F.length(w) > 1), " ")))


def _standalone(text: Column, number: Column) -> Column:
    return F.regexp_like(text, F.concat(F.lit(r"(?<![0-9])\Q"), number, F.lit(r"\E(?![0-9])")))


def score_links(links: DataFrame, registry: DataFrame) -> DataFrame:
    """Each pair of a link and a registered instrument (key, type, number, year, title) that share a title term, with
    score, number_year, coverage, from_context, strong.

    A pair without a common title term stays below any floor over 0.4, so that pairs are found by an equi-join on
    terms instead of a cross join; the registry is broadcast if it is as small as a list kept by hand.
    """
    reg = with_composed(registry, "title").withColumn("__t", _terms(fold("title"))).where(F.size("__t") > 0)
    rows = with_composed(links, "text", "context").withColumns({"__ft": fold("text"), "__fc": fold("context")}).withColumns({"__x": _terms("__ft"), "__y": _terms("__fc")})
    terms = reg.select("key", F.explode("__t").alias("term"))
    keyed = rows.withColumn("term", F.explode(F.array_union("__x", "__y")))
    pairs = keyed.join(small(terms), "term").drop("term").distinct().join(small(reg), "key")
    share = lambda side: F.size(F.array_intersect("__t", side)) / F.size("__t")
    typed = lambda text: F.coalesce(*[F.when(F.col("type") == k, _any(F.col(text), words)) for k, words in lx.TYPE_WORDS.items()], F.lit(False))
    own, ctx = normalize_digits(F.concat_ws(" ", "text", "url")), normalize_digits("context")
    pairs = pairs.withColumns({"__cov": share("__x"), "__ctx": share("__y")})
    pairs = pairs.withColumns({"__y1": _standalone(own, F.col("year")), "__n1": _standalone(own, F.col("number")), "__y2": _standalone(ctx, F.col("year")), "__n2": _standalone(ctx, F.col("number"))})
    weak = (F.col("context") != "") & (F.col("__cov") < 0.5) & ~(F.col("__y1") & F.col("__n1"))
    pairs = pairs.withColumn("from_context", weak & ((F.col("__ctx") > F.col("__cov")) | (F.col("__y2") & F.col("__n2"))))
    use = lambda a, b: F.when(F.col("from_context"), b).otherwise(a)
    pairs = pairs.withColumns({"coverage": use(F.col("__cov"), F.greatest("__cov", "__ctx")), "__y": use(F.col("__y1"), F.col("__y2")), "__n": use(F.col("__n1"), F.col("__n2")), "__k": typed("__ft") | (F.col("from_context") & typed("__fc"))})
    both = F.when(F.col("__y") & F.col("__n"), 0.30).when(F.col("__y"), 0.15).when(F.col("__n"), 0.05).otherwise(0.0)
    total = 0.5 * F.col("coverage") + both + F.when(F.col("__k"), 0.10).otherwise(0.0)
    total = total * F.when(F.col("from_context"), 0.85).when(F.length("text") < 4, 0.5).otherwise(1.0)
    pairs = pairs.withColumn("score", F.least(F.round(total, 3), F.lit(1.0))).withColumn("number_year", F.col("__y") & F.col("__n"))
    strong = (F.col("score") >= 0.9) & F.col("number_year") & (F.col("coverage") >= 0.6) & ~F.col("from_context")
    shown = F.coalesce(*[F.when(c != "", c) for c in (use(F.col("text"), F.col("context")), F.col("context"))], F.lit(""))
    return pairs.select(*links.columns, "key", "score", "number_year", "coverage", "from_context", strong.alias("strong"), shown.alias("shown"))


def _any(folded: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | folded.contains(w)
    return out


def match_registry(links: DataFrame, registry: DataFrame, floor: float = 0.4, top: int = 4) -> DataFrame:
    """The best links of each instrument at or above the floor, by score and then the shorter text: with rank."""
    order = Window.partitionBy("key").orderBy(F.desc("score"), F.length("shown"), "url")
    scored = score_links(links, registry).where(F.col("score") >= floor)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
