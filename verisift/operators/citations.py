"""Inline citation markers: parsing with positions, malformed markers, resolution, clean rendering, sections."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import lexicon as lx
from ..functions.text import article_key, col, normalize_digits, positions, strip_zeros

_D = "[0-9٠-٩۰-۹]"
#: Groups: type, number, year, article, article with bis.
MARKER = rf"⟦\s*BH\s*:\s*(law|dl|dec|ord|reg)\s*:\s*({_D}+)\s*/\s*({_D}{{4}})\s*(?::\s*م\s*({_D}+)\s*({lx.BIS_FORMS})?\s*)?⟧"
LOOSE_MARKER = r"⟦[^⟧]{0,120}⟧"


def parse_markers(docs: DataFrame, text: str = "text") -> DataFrame:
    """A row for each valid marker, in document order: raw, pos, type, number, year, article, bis, instrument_id,
    article_key, ref_id, next to the columns of docs."""
    rows = docs.withColumn("__m", F.explode(positions(F.col(text), MARKER)))
    part = lambda k: F.regexp_extract("__m.raw", MARKER, k)
    number, year, article = (strip_zeros(normalize_digits(part(2))), normalize_digits(part(3)), strip_zeros(normalize_digits(part(4))))
    rows = rows.select(*docs.columns, "__m.raw", "__m.pos", part(1).alias("type"), number.alias("number"), year.alias("year"), F.when(part(4) != "", article).alias("article"), (part(5) != "").alias("bis"))
    rows = rows.withColumn("instrument_id", F.concat("type", F.lit(":"), "number", F.lit("/"), "year"))
    rows = rows.withColumn("article_key", F.when(F.col("article").isNotNull(), article_key("article", "bis")))
    return rows.withColumn("ref_id", F.concat_ws(":", "instrument_id", "article_key"))


def malformed_markers(docs: DataFrame, text: str = "text") -> DataFrame:
    """A row for each thing in marker brackets that is no valid marker: raw, pos."""
    rows = docs.withColumn("__m", F.explode(positions(F.col(text), LOOSE_MARKER)))
    return rows.where(~F.col("__m.raw").rlike(f"^(?:{MARKER})$")).select(*docs.columns, "__m.raw", "__m.pos")


def to_marker(type_, number, year, article, bis) -> Column:
    art = F.when(col(article).isNotNull(), F.concat(F.lit(":م"), col(article), F.when(col(bis), lx.BIS).otherwise(""))).otherwise("")
    return F.concat(F.lit("⟦BH:"), col(type_), F.lit(":"), col(number), F.lit("/"), col(year), art, F.lit("⟧"))


def to_arabic(type_, number, year, article, bis, title=None) -> Column:
    """How a citation is written out: the article, if any, of the title, or of type, number and year."""
    kind = F.coalesce(*[F.when(col(type_) == k, v) for k, v in lx.TYPE_NAMES.items()], F.lit("قانون"))
    named = F.concat(kind, F.lit(" رقم ("), col(number), F.lit(") لسنة "), col(year))
    art = F.when(col(article).isNotNull(), F.concat(F.lit("المادة ("), col(article), F.when(col(bis), f" {lx.BIS}").otherwise(""), F.lit(") من "))).otherwise("")
    return F.concat(art, F.coalesce(col(title), named) if title is not None else named)


def render_clean(text) -> Column:
    """The text without markers: no deeper indentation, no blank before punctuation, no double or trailing blanks."""

    def line(x):
        bare = F.regexp_replace(x, MARKER, "")
        pad, own = F.regexp_extract(bare, r"^[ \t]*", 0), F.regexp_extract(x, r"^[ \t]*", 0)
        body = F.substr(bare, F.length(pad) + 1)
        body = F.regexp_replace(F.regexp_replace(body, r"[ \t]+([،.؛:])", "$1"), r"[ \t]{2,}", " ")
        return F.regexp_replace(F.concat(F.left(pad, F.least(F.length(pad), F.length(own))), body), r"\s+$", "")

    return F.array_join(F.transform(F.split(col(text), "\n"), line), "\n")


def sections(docs: DataFrame, text: str = "text") -> DataFrame:
    """A row for each Markdown heading of levels 1 to 4: section (from 1), heading, body up to the next heading."""
    mark = "\u0001"
    cut = F.split(F.regexp_replace(F.col(text), r"(?m)^(\s{0,3}#{1,4}\s*.+)$", f"{mark}$1"), mark)
    rows = docs.select(*docs.columns, F.posexplode(cut).alias("section", "__s")).where("section > 0")
    return rows.select(*docs.columns, "section", F.regexp_extract("__s", r"^\s*[^\n]*", 0).alias("heading"), F.regexp_replace("__s", r"^\s*[^\n]*", "").alias("body"))


def resolve(refs: DataFrame, instruments: DataFrame, articles: DataFrame) -> DataFrame:
    """ok and reason (instrument_missing, unverified, article_missing, or null) for refs (instrument_id, article_key).

    Reasons are tested in this order; a reference without an article needs its instrument only.
    """
    known = instruments.select(F.col("id").alias("instrument_id"), F.coalesce("verified", F.lit(False)).alias("__verified"), F.lit(True).alias("__known"))
    there = articles.select("instrument_id", "article_key").distinct().withColumn("__there", F.lit(True))
    rows = refs.join(known, "instrument_id", "left").join(there, ["instrument_id", "article_key"], "left")
    reason = F.when(F.col("__known").isNull(), "instrument_missing").when(~F.col("__verified"), "unverified").when(F.col("article_key").isNotNull() & F.col("__there").isNull(), "article_missing")
    return rows.select(*refs.columns, reason.isNull().alias("ok"), reason.alias("reason"))


_BOUND = re.compile(r"[.؟!]|\n[ \t]*\n|\n[ \t]*#{1,6}[^\n]*|\n[ \t]*[-*>]\s")
LEAST_CLAUSE = 25


def span_of_claim(text: str, pos: int, length: int, previous_end: int = 0, next_start: int | None = None) -> str:
    """The sentence around a marker, between the neighbouring markers, and narrowed to its clause if that is long enough.

    A single newline does not end a sentence; an empty line, a heading line or a list item does.
    """
    after = _BOUND.search(text, pos + length)
    end = after.start() if after else len(text)
    start = max([m.end() for m in _BOUND.finditer(text, 0, pos)], default=0)
    if heading := re.match(r"[ \t]*#{1,6}[^\n]*\n", text[start:end]):
        start += heading.end()
    start, end = max(start, previous_end), min(end, len(text) if next_start is None else next_start)
    left = max(text.rfind(c, start, pos) for c in "،؛")
    rights = [p for c in "،؛" if (p := text.find(c, pos + length, end)) >= 0]
    inner = (left + 1 if left >= 0 else start, min(rights, default=end))
    if inner[1] - inner[0] >= LEAST_CLAUSE:
        start, end = inner
    return " ".join(re.sub("⟦[^⟧]*⟧", " ", text[start:end]).split())


@F.pandas_udf(StringType())
def _claims(text: pd.Series, pos: pd.Series, length: pd.Series, before: pd.Series, after: pd.Series) -> pd.Series:
    return pd.Series([span_of_claim(t, p, n, b, None if a < 0 else a) for t, p, n, b, a in zip(text, pos, length, before, after)])


def with_claims(docs: DataFrame, text: str = "text") -> DataFrame:
    """parse_markers(docs) with the claim that each marker stands for.

    The neighbours of a marker come from the sorted array of its own document, so that nothing is shuffled.
    """
    ends = F.transform(positions(F.col(text), MARKER), lambda m: F.struct(m["pos"].alias("pos"), (m["pos"] + F.length(m["raw"])).alias("end")))
    rows = parse_markers(docs.withColumn("__all", ends), text)
    before = F.coalesce(F.array_max(F.transform(F.filter("__all", lambda m: m["pos"] < F.col("pos")), lambda m: m["end"])), F.lit(0))
    after = F.coalesce(F.array_min(F.transform(F.filter("__all", lambda m: m["pos"] > F.col("pos")), lambda m: m["pos"])), F.lit(-1))
    return rows.withColumn("claim", _claims(text, "pos", F.length("raw"), before, after)).drop("__all")
