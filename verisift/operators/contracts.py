"""Clause rules against contracts, and the legal bases of the rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions.tables import small, with_composed
from ..functions.text import col, fold, snippet
from .citations import parse_markers, resolve
from .retrieval import candidates, search

#: Rules: ctype (null: all types), part (required or void), key, label, basis (structural or statutory), patterns, why, sanad.
RULES = "ctype string, part string, key string, label string, basis string, patterns array<string>, why string, sanad string, search_terms array<string>"


def placeholders(text) -> Column:
    """Distinct places left to be filled in, sorted."""
    return F.sort_array(F.array_distinct(F.regexp_extract_all(col(text), F.lit(f"({lx.PLACEHOLDER})"), F.lit(1))))


def bases(rules: DataFrame, instruments: DataFrame, articles: DataFrame) -> DataFrame:
    """Whether the legal basis of each statutory rule resolves: key, part, ctype, base_ok, base_reason."""
    first = parse_markers(rules.select("ctype", "part", "key", F.coalesce("sanad", F.lit("")).alias("sanad")), "sanad")
    first = first.groupBy("ctype", "part", "key").agg(F.min_by(F.struct("instrument_id", "article_key"), "pos").alias("r")).select("ctype", "part", "key", "r.*")
    found = resolve(first, instruments, articles).select(F.col("ctype").alias("__t"), F.col("part").alias("__p"), F.col("key").alias("__k"), "ok", "reason")
    rows = rules.join(found, F.col("ctype").eqNullSafe(F.col("__t")) & (F.col("part") == F.col("__p")) & (F.col("key") == F.col("__k")), "left")
    none = F.when(F.trim(F.coalesce("sanad", F.lit(""))) == "", "no_base").otherwise("invalid_base")
    return rows.select(*rules.columns, F.coalesce("ok", F.lit(False)).alias("base_ok"), F.when(F.col("ok"), None).otherwise(F.coalesce("reason", none)).alias("base_reason"))


def clause_findings(contracts: DataFrame, rules: DataFrame, id_col: str = "doc_id", ctype: str = "ctype", text: str = "text") -> DataFrame:
    """A row for each contract and rule of its type: present, and status (found, problem, manual, none).

    A required clause that is missing and a void one that is there are problems; if the rule's statutory basis does
    not resolve, it is left to someone to look at. rules: as returned by bases(); a list kept by hand, broadcast.
    """
    folded = F.transform("patterns", lambda p: fold(p))
    r = small(rules.withColumn("__patterns", folded).withColumn("__type", F.col("ctype")).drop("ctype"))
    docs = with_composed(contracts.select(id_col, F.col(ctype).alias("ctype"), F.col(text).alias("__f")), "__f").withColumn("__f", fold("__f"))
    # Rules of all types are attached once, as an array, so that no contract is joined with the rules of other types.
    packed = r.groupBy("__type").agg(F.collect_list(F.struct("part", "key", "label", "basis", "__patterns", "base_ok", "base_reason")).alias("__r"))
    common = packed.where("__type is null").select(F.col("__r").alias("__common"))
    docs = docs.join(small(packed.where("__type is not null")), F.col("ctype") == F.col("__type"), "left")
    docs = docs.join(F.broadcast(common), F.lit(True), "left")  # one row
    none = F.array().cast(packed.schema["__r"].dataType)
    rows = docs.select(id_col, "ctype", "__f", F.explode(F.concat(F.coalesce("__common", none), F.coalesce("__r", none))).alias("x"))
    present = F.exists("x.__patterns", lambda p: F.col("__f").contains(p))
    rows = rows.select(id_col, "ctype", "x.part", "x.key", "x.label", "x.basis", "x.base_ok", "x.base_reason", present.alias("present"))
    wrong = (F.col("part") == "required") != F.col("present")
    status = F.when(~wrong, F.when(F.col("present"), "found").otherwise("none")).when((F.col("basis") == "statutory") & ~F.col("base_ok"), "manual").otherwise("problem")
    return rows.withColumn("status", status)


def clause_report(contracts: DataFrame, rules: DataFrame, id_col: str = "doc_id", ctype: str = "ctype", text: str = "text") -> DataFrame:
    """A row for each contract: passed, found, problems, manual (sorted keys), placeholders."""
    of = lambda s: F.sort_array(F.collect_list(F.when(F.col("status") == s, F.col("key"))))
    found = clause_findings(contracts, rules, id_col, ctype, text).groupBy(id_col).agg(of("found").alias("found"), of("problem").alias("problems"), of("manual").alias("manual"))
    rows = contracts.select(id_col, F.col(ctype).alias("ctype"), placeholders(text).alias("placeholders")).join(found, id_col, "left")
    none = F.array().cast("array<string>")
    rows = rows.select(id_col, "ctype", *[F.coalesce(c, none).alias(c) for c in ("found", "problems", "manual", "placeholders")])
    return rows.withColumn("passed", (F.size("problems") == 0) & (F.size("placeholders") == 0))


def statutory_items(rules: DataFrame) -> DataFrame:
    """Rules with a statutory basis, and a row for each of their search terms."""
    return rows_of_terms(rules.where("basis = 'statutory'"))


def rows_of_terms(rules: DataFrame) -> DataFrame:
    terms = F.when(F.size(F.coalesce("search_terms", F.array())) > 0, F.col("search_terms")).otherwise(F.array("label"))
    return rules.select("ctype", "part", "key", "sanad", F.posexplode(terms).alias("term_index", "term"))


def base_counts(with_bases: DataFrame) -> DataFrame:
    """Statutory rules by state of their basis: filled, empty, broken."""
    state = F.when(F.col("base_ok"), "filled").when(F.col("base_reason") == "no_base", "empty").otherwise("broken")
    return with_bases.where("basis = 'statutory'").groupBy(state.alias("state")).agg(F.count("*").alias("rules"))


def type_counts(rules: DataFrame) -> DataFrame:
    return rules.groupBy("ctype").agg(F.count_if(F.col("part") == "required").alias("required"), F.count_if(F.col("part") == "void").alias("void"))


def proposals(rules: DataFrame, articles: DataFrame, instruments: DataFrame, limit: int = 5) -> DataFrame:
    """Candidates for the statutory rules (as returned by bases()) that have no basis: ctype, part, key, label, why,
    place, instrument_id, article_key, snippet. Each search term of a rule is a search of its own; their hits come in
    the order of terms and ranks, each article once, the first limit. Rules without a hit have one row without an
    article."""
    open_ = rules.where("basis = 'statutory' and trim(coalesce(sanad, '')) = ''")
    item = F.concat_ws("/", "ctype", "part", "key")
    terms = rows_of_terms(open_).withColumn("item", item).withColumn("query", F.concat_ws("#", "item", F.col("term_index").cast("string")))
    hits = search(articles, instruments, terms, "query", "term", limit=limit)
    found = hits.join(terms.select("query", "item", "term_index"), "query")
    best = candidates(found, "item", "term_index", ["instrument_id", "article_key"], limit)
    best = best.join(articles.select("instrument_id", "article_key", snippet("text", 420).alias("snippet")), ["instrument_id", "article_key"])
    return open_.withColumn("item", item).select("item", "ctype", "part", "key", "label", "why").join(best, "item", "left").drop("item")


def sheet_answers(sheets: DataFrame, text: str = "text", answer: str = "المعتمد") -> DataFrame:
    """Filled lines of review sheets with a section ``## type/key`` for each rule: ctype, key, sanad."""
    rows = sheets.select(F.explode(F.split(F.regexp_replace(text, r"(?m)^##\s+(\S+?)/(\S+)\s*$", "\u0001$1\u0002$2\u0002"), "\u0001")).alias("s"))
    parts = F.split("s", "\u0002", 3)
    said = F.regexp_extract(F.get(parts, F.lit(2)), rf"\*\*\Q{answer}\E:\*\*([^\n]*)", 1)
    said = F.trim(F.regexp_replace(said, r"^[\s`]+|[\s`]+$", ""))
    return rows.where(F.size(parts) == 3).select(F.get(parts, F.lit(0)).alias("ctype"), F.get(parts, F.lit(1)).alias("key"), said.alias("sanad")).where("sanad <> ''")


def with_accepted(rules: DataFrame, answers: DataFrame, instruments: DataFrame, articles: DataFrame) -> DataFrame:
    """rules with the bases of answers (ctype, key, sanad) that resolve in place of their own."""
    keyed = answers.select(F.concat_ws("\u0001", "ctype", "key").alias("key"), "sanad")
    new = accepted_bases(keyed, instruments, articles).select(F.col("key").alias("__k"), F.col("sanad").alias("__new"))
    rows = rules.withColumn("__k", F.concat_ws("\u0001", "ctype", "key")).join(small(new), "__k", "left")
    return rows.withColumn("sanad", F.coalesce("__new", "sanad")).select(*rules.columns)


def accepted_bases(answers: DataFrame, instruments: DataFrame, articles: DataFrame) -> DataFrame:
    """Answers (key, sanad) of a review sheet whose basis resolves; only these may be entered into the rules."""
    refs = parse_markers(answers, "sanad")
    first = refs.groupBy("key").agg(F.min_by(F.struct("raw", "instrument_id", "article_key"), "pos").alias("r")).select("key", "r.*")
    return resolve(first, instruments, articles).where("ok").select("key", F.col("raw").alias("sanad"))
