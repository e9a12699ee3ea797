"""Quantities (value, unit) in running text as Column expressions: digits, number words, compounds and duals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as lx
from .text import col, fold

_VALUES = lx.ONES | lx.TENS | lx.HUNDREDS | lx.THOUSANDS
_AND = "و"
_FOUND = "array<struct<value:double,last:int,unit:string>>"


def _lookup(words: dict, key: Column, kind: str) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in words.items() for x in kv]), key).cast(kind)


def number_tokens(text) -> Column:
    """Runs of letters or of digits of the folded text. Percent signs are words, and the conjunction is a token of its
    own where a number word or a dual follows it."""
    folded = fold(F.regexp_replace(col(text), "[%٪]", " بالمائة "))
    apart = F.regexp_replace(F.translate(folded, "_", " "), r"(?<=[0-9])(?=[^0-9 ])|(?<=[^0-9 ])(?=[0-9])", " ")
    joined = "|".join(sorted([*_VALUES, *lx.DUALS], key=lambda w: (-len(w), w)))
    apart = F.regexp_replace(F.concat(F.lit(" "), apart, F.lit(" ")), f"(?<= ){_AND}(?=(?:{joined}) )", f"{_AND} ")
    return F.filter(F.split(apart, " +"), lambda t: t != "")


def _phrases(tokens: Column) -> Column:
    """Numbers of a text and the token (from 1) that each ends with; duals with their unit.

    One fold over the tokens. Its state is the sum of a number that may go on (sum), whether a conjunction has come
    after it (joined), the place, and what is complete.
    """
    state = F.struct(F.lit(None).cast("double").alias("sum"), F.lit(False).alias("joined"), F.lit(0).alias("at"), F.array().cast(_FOUND).alias("found"))

    def entry(value, last, unit=None):
        return F.struct(value.cast("double").alias("value"), last.cast("int").alias("last"), (F.lit(None).cast("string") if unit is None else unit).alias("unit"))

    def complete(s):
        return entry(s["sum"], F.when(s["joined"], s["at"] - 1).otherwise(s["at"]))

    def step(s, token):
        value, scale, dual = _lookup(_VALUES, token, "double"), _lookup(lx.THOUSANDS, token, "double"), _lookup(lx.DUALS, token, "string")
        begun, at = s["sum"].isNotNull(), s["at"] + 1
        adds = begun & s["joined"] & value.isNotNull()
        waits = begun & ~s["joined"] & (token == _AND)
        scaled = begun & ~s["joined"] & scale.isNotNull() & (s["sum"] < 1000)
        anew = ~(adds | waits | scaled)
        here = F.when(scaled, entry(s["sum"] * scale, at)).when(anew & dual.isNotNull(), entry(F.lit(2), at, dual)).when(anew & token.rlike("^[0-9]+$"), entry(token, at))
        done = F.array_compact(F.array(F.when(anew & begun, complete(s)), here))
        return F.struct(
            F.when(adds, s["sum"] + value).when(waits, s["sum"]).when(anew & dual.isNull(), value).alias("sum"),
            F.coalesce(waits, F.lit(False)).alias("joined"),
            at.alias("at"),
            F.when(F.size(done) > 0, F.concat(s["found"], done)).otherwise(s["found"]).alias("found"),
        )

    return F.aggregate(tokens, state, step, lambda s: F.when(s["sum"].isNotNull(), F.concat(s["found"], F.array(complete(s)))).otherwise(s["found"]))


def quantities(text) -> Column:
    """array<struct<value, unit>>: distinct quantities, sorted. The unit is that of the first unit word among the
    UNIT_REACH tokens that follow, empty if there is none or a dual comes first. Null and empty texts have none. The
    text is in the composed normal form (a UDF, which no expression over tokens may hold)."""
    tokens = number_tokens(F.coalesce(col(text), F.lit("")))
    names = {w: "%" for w in lx.PERCENT_WORDS} | dict.fromkeys(lx.DUALS, "") | lx.UNITS

    def unit(n):
        near = F.transform(F.slice(tokens, n["last"] + 1, lx.UNIT_REACH), lambda t: _lookup(names, t, "string"))
        return F.coalesce(n["unit"], F.get(F.array_compact(near), F.lit(0)), F.lit(""))

    return F.array_sort(F.array_distinct(F.transform(_phrases(tokens), lambda n: F.struct(n["value"].alias("value"), unit(n).alias("unit")))))


def conflicting(claim: Column, article: Column) -> Column:
    """The claim's quantities whose unit the article uses, but never with that value."""

    def wrong(q):
        return (q["unit"] != "") & F.exists(article, lambda a: a["unit"] == q["unit"]) & ~F.exists(article, lambda a: (a["unit"] == q["unit"]) & (a["value"] == q["value"]))

    return F.filter(claim, wrong)
