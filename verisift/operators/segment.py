"""Statutes into articles, enactment formulae, and whether a text is what it is said to be."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions.text import article_key, article_label, col, ordinal, strip_zeros

_WORDS = "|".join(sorted(lx.ordinals(), key=lambda w: (-len(w), w)))
#: Groups: number, its bis, ordinal word.
HEADING = rf"(?:^|\n)[ \t]*(?:ال)?مادة(?:\s*رقم)?\s*(?:[(\[]?\s*([0-9]+)\s*({lx.BIS_FORMS})?\s*[)\]]?|({_WORDS}))[ \t]*[:：.\-–—]?[ \t]*"
#: Groups: kind, number, year.
ENACTMENT = r"(مرسوم\s+بقانون|مرسوم|قانون|قرار|أمر)\s*رقم\s*[(\[]?\s*([0-9]{1,4})\s*[)\]]?\s*(?:ل?سنة|لعام)\s*[(\[]?\s*([0-9]{4})"


def segment_articles(docs: DataFrame, text: str = "text", id_col: str = "instrument_id") -> DataFrame:
    """Articles of normalised texts: id, position (order of the first heading), article_key, number, bis, label, text.

    What precedes the first heading is left out, and so are empty bodies. An article that occurs more than once
    keeps its first place and its longest body (the first of equally long ones).
    """
    marked = F.regexp_replace(F.col(text), HEADING, "\u0001$1\u0002$2\u0002$3\u0002")
    rows = docs.select(id_col, F.posexplode(F.split(marked, "\u0001")).alias("position", "s")).where("position > 0")
    parts = F.split("s", "\u0002", 4)
    number = F.when(F.get(parts, F.lit(0)) != "", strip_zeros(F.get(parts, F.lit(0)))).otherwise(ordinal(F.get(parts, F.lit(2))).cast("string"))
    body = F.regexp_replace(F.get(parts, F.lit(3)), r"^\s+|\s+$", "")
    rows = rows.select(id_col, "position", number.alias("number"), (F.get(parts, F.lit(1)) != "").alias("bis"), body.alias("text")).where("text <> ''")
    rows = rows.withColumn("article_key", article_key("number", "bis")).withColumn("label", article_label("number", "bis"))
    return rows.groupBy(id_col, "article_key", "number", "bis", "label").agg(
        F.min("position").alias("position"), F.max_by("text", F.struct(F.length("text"), -F.col("position"))).alias("text")
    )


def enactments(text) -> Column:
    """Distinct formulae of a normalised text in order: array<struct<kind, number, year>>."""
    part = lambda k: F.regexp_extract_all(col(text), F.lit(ENACTMENT), F.lit(k))
    zipped = F.arrays_zip(part(1).alias("kind"), part(2).alias("number"), part(3).alias("year"))
    tidy = lambda x: F.struct(F.regexp_replace(x["kind"], r"\s+", " ").alias("kind"), strip_zeros(x["number"]).alias("number"), x["year"].alias("year"))
    return F.array_distinct(F.transform(zipped, tidy))


def identity_matches(found: Column, type_, number, year) -> Column:
    """Null if there is no formula, else whether one names this number and year with a type that it may stand for."""
    types = F.create_map(*[x for k, v in lx.KIND_TYPES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])

    def fits(x):
        return (x["number"] == strip_zeros(number)) & (x["year"] == col(year)) & F.array_contains(F.element_at(types, x["kind"]), col(type_))

    return F.when(F.size(found) > 0, F.exists(found, fits))
