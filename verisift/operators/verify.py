"""Whether a cited article says what it is cited for, and the gate that documents must pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions.quantities import conflicting, quantities
from ..functions.tables import held, release
from ..functions.text import col, composed, line_of
from .citations import MARKER, malformed_markers, resolve, sections, with_claims
from .retrieval import overlap


def frames(text, patterns: dict[str, str] = lx.FRAMES) -> Column:
    """Names of the modal frames of a text, in order."""
    return F.filter(F.array(*[F.when(col(text).rlike(p), F.lit(name)) for name, p in patterns.items()]), lambda x: x.isNotNull())


def _some(*xs: Column) -> Column:
    return F.filter(F.array(*xs), lambda x: x.isNotNull())


def support(pairs: DataFrame, idf: DataFrame | None, keys: list[str], min_overlap: Column | float = lx.MIN_OVERLAP, patterns: dict[str, str] = lx.FRAMES) -> DataFrame:
    """pairs (claim, article) with verdict (supported, conflicting, adjudicate), overlap, conflicts, doubts, frames.

    Conflicts: a quantity that the article has in that unit with other values only; a permission or entitlement
    where the article prohibits. Doubts: little overlap; a strong frame that the article lacks; an exception of the
    article that the claim leaves out.
    """
    rows = overlap(pairs, idf, keys).withColumn("claim_frames", frames("claim", patterns)).withColumn("article_frames", frames("article", patterns))
    rows = rows.withColumns({"__c": composed("claim"), "__a": composed("article")})
    rows = rows.withColumns({"__q": quantities("__c"), "__p": quantities("__a")}).drop("__c", "__a")
    has = lambda side, name: F.array_contains(side, name)
    wrong = F.transform(conflicting(F.col("__q"), F.col("__p")), lambda q: F.concat(F.lit("quantity:"), q["value"].cast("string"), F.lit(" "), q["unit"]))
    permits = (has("claim_frames", "permission") | has("claim_frames", "entitlement")) & ~has("claim_frames", "prohibition")
    modal = _some(F.when(permits & has("article_frames", "prohibition") & ~has("article_frames", "permission"), F.lit("modality")))
    doubts = _some(
        F.when(F.col("overlap") < min_overlap, F.lit("overlap")),
        *[F.when(has("claim_frames", f) & ~has("article_frames", f), F.lit(f"frame:{f}")) for f in lx.STRONG_FRAMES],
        F.when(has("article_frames", "exception") & ~has("claim_frames", "exception"), F.lit("exception")),
    )
    rows = rows.withColumn("conflicts", F.concat(wrong, modal)).withColumn("doubts", doubts).drop("__q", "__p")
    return rows.withColumn("verdict", F.when(F.size("conflicts") > 0, "conflicting").when(F.size("doubts") > 0, "adjudicate").otherwise("supported"))


def threshold(setting, calibrated: float | None) -> tuple[float, str]:
    """Least overlap and where it comes from: ``auto`` takes a calibrated one; what is no number gives the default."""
    if isinstance(setting, str) and setting.strip().lower() == "auto":
        return (calibrated, "calibrated") if calibrated is not None else (lx.MIN_OVERLAP, "default, not calibrated")
    try:
        return float(setting), "fixed"
    except (TypeError, ValueError):
        return lx.MIN_OVERLAP, "default"


def amendment_warning(amendments, consolidated) -> Column:
    """Names of amendments that a text does not include yet, or null. amendments: array<struct<type, number, year>>."""
    part = lambda a, k: F.coalesce(a[k].cast("string"), F.lit("?"))
    names = F.transform(col(amendments), lambda a: F.concat(part(a, "type"), F.lit(" "), part(a, "number"), F.lit("/"), part(a, "year")))
    return F.when((F.size(col(amendments)) > 0) & ~F.coalesce(col(consolidated), F.lit(False)), F.array_join(names, "، "))


def parse_amendments(json) -> Column:
    """The JSON of a store as array<struct>; null if it is not valid."""
    return F.from_json(col(json), "array<struct<type:string,number:string,year:string>>")


def gazette_ref(issue, date) -> Column:
    ref = F.concat_ws(" ", F.when(F.coalesce(col(issue), F.lit("")) != "", F.concat(F.lit("الجريدة الرسمية عدد ("), col(issue), F.lit(")"))), F.when(F.coalesce(col(date).cast("string"), F.lit("")) != "", F.concat(F.lit("بتاريخ "), col(date).cast("string"))))
    return F.when(ref != "", ref)


def provenance_line(tier, retrieved_at) -> Column:
    name = F.coalesce(*[F.when(col(tier) == k, v) for k, v in lx.SOURCE_TIERS.items()], col(tier))
    day = F.left(col(retrieved_at).cast("string"), F.lit(10))
    line = F.concat_ws(" · ", F.when(name != "", name), F.when(day != "", F.concat(F.lit("استُرجع "), day)))
    return F.when(line != "", line)


def provenance_gap(url, issue, date) -> Column:
    """What a record lacks of url, gazette_issue and gazette_date."""
    empty = lambda c: F.coalesce(F.trim(col(c).cast("string")), F.lit("")) == ""
    return _some(F.when(empty(url), F.lit("url")), F.when(empty(issue), F.lit("gazette_issue")), F.when(empty(date), F.lit("gazette_date")))


def gate(docs: DataFrame, instruments: DataFrame, articles: DataFrame, idf: DataFrame | None, id_col: str = "doc_id", min_citations: int = 0, min_overlap: float = lx.MIN_OVERLAP, contract: bool = False, legal_section: str = lx.LEGAL_SECTION) -> DataFrame:
    """A report for each document: passed, needs_adjudication, exit_code (0 passed, 3 to be adjudicated, 1 failed),
    citations_total, citations_resolved, problems, adjudicate, amendment_notes.

    A citation whose claim conflicts with its article is a problem and does not count as resolved; one to be
    adjudicated does. Malformed markers, unresolved ones, too few citations and legal sections without one (not in
    contracts) are problems. Each amended instrument is noted once.
    """
    docs = docs.select(id_col, "text")
    cited = with_claims(docs)
    line = line_of("text", "pos")
    cited = cited.select(id_col, "pos", "raw", "ref_id", "instrument_id", "article_key", "claim", line.alias("line"))
    found = resolve(cited, instruments, articles)
    body = articles.select("instrument_id", "article_key", F.col("text").alias("article"))
    pairs = found.where("ok and article_key is not null").join(body, ["instrument_id", "article_key"]).select(id_col, "pos", "claim", "article")
    judged = support(pairs, idf, [id_col, "pos"], min_overlap).select(id_col, "pos", "verdict", "conflicts", "doubts", "overlap")
    rows = found.join(judged, [id_col, "pos"], "left")
    bad = F.coalesce(F.col("verdict") == "conflicting", F.lit(False))
    said = lambda what: F.struct(F.col("line"), F.concat_ws(" ", what, F.col("raw")).alias("problem"))
    problem = F.when(~F.col("ok"), F.array(said(F.col("reason")))).when(bad, F.transform("conflicts", lambda c: said(c))).otherwise(F.array().cast("array<struct<line:int,problem:string>>"))
    per_doc = rows.withColumn("__p", problem).groupBy(id_col).agg(
        F.count("*").alias("citations_total"),
        F.count_if(F.col("ok") & ~bad).alias("citations_resolved"),
        F.flatten(F.collect_list("__p")).alias("p1"),
        F.sort_array(F.collect_list(F.when(F.col("verdict") == "adjudicate", F.struct("line", "ref_id", "doubts")))).alias("adjudicate"),
    )
    malformed = malformed_markers(docs).groupBy(id_col).agg(F.collect_list(F.struct(line.alias("line"), F.concat(F.lit("malformed "), F.col("raw")).alias("problem"))).alias("p2"))
    bare = sections(docs).where(F.col("heading").rlike(rf"^\s{{0,3}}#{{1,4}}\s*.*({legal_section})") & F.col("body").rlike(r"\S") & ~F.col("body").rlike(MARKER))
    bare = bare.where(F.lit(not contract)).groupBy(id_col).agg(F.collect_list(F.struct(F.lit(0).alias("line"), F.concat(F.lit("uncited section "), F.regexp_replace("heading", r"^[\s#]+|[\s#]+$", "")).alias("problem"))).alias("p3"))
    notes = rows.where("ok").select(id_col, "instrument_id").distinct()
    if "amendments" in instruments.columns:
        warned = instruments.select(F.col("id").alias("instrument_id"), F.concat(F.col("title"), F.lit(": "), amendment_warning("amendments", "consolidated")).alias("note")).where("note is not null")
        notes = notes.join(warned, "instrument_id").groupBy(id_col).agg(F.sort_array(F.collect_set("note")).alias("amendment_notes"))
    else:
        notes = notes.where("false").select(id_col, F.array().cast("array<string>").alias("amendment_notes"))
    out = docs.select(id_col)
    for part in (per_doc, malformed, bare, notes):
        out = out.join(part, id_col, "left")
    none = F.array().cast("array<struct<line:int,problem:string>>")
    n = F.coalesce("citations_resolved", F.lit(0))
    few = F.when(n < min_citations, F.array(F.struct(F.lit(0).alias("line"), F.lit("too few citations").alias("problem")))).otherwise(none)
    out = out.withColumn("problems", F.sort_array(F.concat(F.coalesce("p1", none), F.coalesce("p2", none), F.coalesce("p3", none), few)))
    out = out.withColumn("passed", F.size("problems") == 0).withColumn("needs_adjudication", F.size(F.coalesce("adjudicate", F.array())) > 0)
    code = F.when(~F.col("passed"), 1).when(F.col("needs_adjudication"), 3).otherwise(0)
    return out.select(id_col, "passed", "needs_adjudication", code.alias("exit_code"), F.coalesce("citations_total", F.lit(0)).alias("citations_total"), n.alias("citations_resolved"), "problems", "adjudicate", F.coalesce("amendment_notes", F.array().cast("array<string>")).alias("amendment_notes"))


def calibrate(articles: DataFrame, idf: DataFrame, samples: int = lx.SAMPLES, miss_rate: float = lx.MISS_RATE, seed: int = lx.SEED) -> DataFrame:
    """One row: threshold, articles, samples, miss_rate, adjudication_rate, reliable.

    Claims are stretches of 45 to 75 % of an article's words (six at least) with some words dropped. Each is compared
    with its own article and with a wrong one: mostly a neighbour in the same instrument, else any. The threshold
    is where misattributed claims pass at the wanted rate, between a floor and a ceiling. All draws are hashes of
    seed and sample, so that the result depends on the data alone. articles: instrument_id, article_key, text.
    """
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    usable = articles.withColumn("__w", words).where(F.size("__w") >= lx.MIN_WORDS).select("instrument_id", "article_key", "text", "__w")
    n = usable.count()
    spark = articles.sparkSession
    shape = "threshold double, articles long, samples long, miss_rate double, adjudication_rate double, reliable boolean"
    if n < lx.LEAST_ARTICLES:
        return spark.createDataFrame([(lx.FLOOR, n, 0, None, None, False)], shape)
    draw = lambda *what: F.pmod(F.xxhash64(F.lit(seed), *what), F.lit(1 << 30)) / float(1 << 30)
    # The articles with the smallest hashes: a partial top k in every task. Few articles are drawn more than once.
    repeated = usable.select("instrument_id", "article_key", "text", "__w", F.explode(F.sequence(F.lit(0), F.lit(-(-samples // n) - 1))).alias("__r"))

    def drawn(what: str) -> DataFrame:
        h = F.xxhash64(F.lit(seed), F.lit(what), "instrument_id", "article_key", "text", "__r")
        best = repeated.withColumn("__h", h).orderBy("__h", "instrument_id", "article_key").limit(samples)
        return best.withColumn("s", F.row_number().over(Window.orderBy("__h", "instrument_id", "article_key", "__r")))  # of `samples` rows

    own = held(drawn("article"))
    size = F.size("__w")
    span = F.greatest(F.lit(6), F.floor(size * (0.45 + 0.3 * draw(F.col("s"), F.lit("span")))).cast("int"))
    first = F.floor(draw(F.col("s"), F.lit("start")) * (F.greatest(F.lit(0), size - span) + 1)).cast("int")
    chunk = F.slice("__w", first + 1, span)
    kept = F.filter(chunk, lambda w, i: draw(F.col("s"), F.lit("word"), i) > 0.18)
    claim = F.array_join(F.when(F.size(kept) > 0, kept).otherwise(chunk), " ")
    mine = own.select("s", "instrument_id", F.col("article_key").alias("__k"), claim.alias("claim"), F.col("text").alias("__own"))
    # Neighbours in the instrument, by keys: reduced before the shuffle, however large an instrument is.
    beside = usable.select("instrument_id", "article_key", "text").join(F.broadcast(mine.select("s", "instrument_id", "__k")), "instrument_id")
    side = lambda test, pick: pick(F.when(test, F.col("text")), F.when(test, F.col("article_key")))
    beside = beside.groupBy("s").agg(side(F.col("article_key") < F.col("__k"), F.max_by).alias("__before"), side(F.col("article_key") > F.col("__k"), F.min_by).alias("__after"))
    either = F.when(draw(F.col("s"), F.lit("side")) < 0.5, F.coalesce("__before", "__after")).otherwise(F.coalesce("__after", "__before"))
    rows = mine.join(beside, "s", "left").join(drawn("other").select("s", F.col("text").alias("__any")), "s", "left")
    wrong = F.coalesce(F.when(draw(F.col("s"), F.lit("near")) < 0.6, either), F.col("__any"))
    pairs = mine.select("s", "claim", F.col("__own").alias("article"), F.lit(True).alias("right"))
    pairs = pairs.union(rows.where(wrong != F.col("__own")).select("s", "claim", wrong.alias("article"), F.lit(False)))
    scored = held(overlap(pairs, idf, ["s", "right"]).select("s", "right", "overlap"))
    wrong_n = scored.where("not right").count()
    release(own)
    if not wrong_n:
        return spark.createDataFrame([(lx.FLOOR, n, scored.count(), None, None, False)], shape)
    at = min(wrong_n - 1, round((1 - miss_rate) * (wrong_n - 1)))
    raw = scored.where("not right").orderBy("overlap").limit(at + 1).agg(F.max("overlap")).first()[0]  # at most `samples` rows
    cut = round(min(lx.CEILING, max(lx.FLOOR, raw)), 2)
    rate = lambda side, test: F.round(F.avg(F.when(F.col("right") == side, test.cast("double"))), 3)
    return scored.agg(
        F.lit(cut).alias("threshold"), F.lit(n).cast("long").alias("articles"), F.count_if("right").alias("samples"),
        rate(False, F.col("overlap") >= cut).alias("miss_rate"), rate(True, F.col("overlap") < cut).alias("adjudication_rate"), F.lit(n >= lx.MIN_ARTICLES).alias("reliable"),
    )
