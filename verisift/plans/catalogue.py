"""Registered queries over the driver's tables, and the same in SQL where SQL can express it.

A document is an instrument, each of its lines an article; labels.quality = 1 makes it verified, its language is its
practice area and its source its tier. Claims are benchmark items, catalogue pages are pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import spread, with_composed
from ..functions.text import fold, snippet, stems, thousands, tokens
from ..operators import citations, contracts, fields, links, retrieval, verify, workflow
from ..sources import documents as files
from ..sources import store, worddoc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    quality = labels.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = docs.select("doc_id", "lang", "source").join(quality, "doc_id", "left")
    return rows.select(
        F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("k"), F.col("doc_id").cast("string")).alias("key"), F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"),
        (F.coalesce("quality", F.lit(0)) == 1).alias("verified"), F.array("lang").alias("practice_areas"), F.col("source").alias("source_tier"),
        F.array().cast("array<struct<type:string,number:string,year:string>>").alias("amendments"), F.lit(False).alias("consolidated"), F.lit(None).cast("timestamp").alias("retrieved_at"), F.lit(None).cast("string").alias("source_url"),
    )


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.articles_of_lines(table(spark, sf_dir, "documents"))


#: The same views in SQL.
_VIEWS = """
instruments AS (SELECT CAST(d.doc_id AS VARCHAR) AS id, 'k' || d.doc_id AS key, 'Document ' || d.doc_id AS title, coalesce(l.quality, 0) = 1 AS verified, d.lang, d.source
  FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id),
lines AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
articles AS (SELECT CAST(doc_id AS VARCHAR) AS instrument_id, CAST(n AS VARCHAR) AS article_key, parts[n] AS text
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS n FROM lines))"""


def _fold(expr: str) -> str:
    return f"trim(regexp_replace(lower({expr}), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))"


def _words(expr: str) -> str:
    return f"list_filter(string_split({_fold(expr)}, ' '), lambda w: w <> '')"


QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# -- the store --------------------------------------------------------------------------------------------------------


@query(f"WITH {_VIEWS} SELECT (SELECT count(*) FROM instruments) AS instruments, (SELECT count(*) FROM instruments WHERE verified) AS verified, 0 AS unconsolidated, (SELECT count(*) FROM articles) AS articles")
def corpus_stats(spark, sf_dir):
    return store.stats(instruments(spark, sf_dir), articles(spark, sf_dir)).drop("oldest")


@query(f"WITH {_VIEWS} SELECT i.id, i.title, i.verified, count(a.article_key) AS articles FROM instruments i LEFT JOIN articles a ON a.instrument_id = i.id GROUP BY ALL")
def instrument_article_counts(spark, sf_dir):
    return store.article_counts(instruments(spark, sf_dir), articles(spark, sf_dir))


@query("SELECT DISTINCT 'k' || conv_id AS key FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM documents)")
def missing_instruments(spark, sf_dir):
    registry = table(spark, sf_dir, "conversations").select(F.concat(F.lit("k"), F.col("conv_id").cast("string")).alias("key"))
    return store.missing(registry, instruments(spark, sf_dir))


@query("SELECT conv_id, turn, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text) = 1")
def upsert_latest(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return store.upsert(turns.where("turn = 0"), turns, ["conv_id"], [F.desc("turn"), "role", "text"])


@query(f"WITH {_VIEWS}, n AS (SELECT lower(text) AS k, text, instrument_id FROM articles) SELECT md5(k) AS line_key, max(length(text)) AS longest, count(*) AS copies FROM n GROUP BY k HAVING count(*) > 1")
def dedupe_longest(spark, sf_dir):
    rows = articles(spark, sf_dir).groupBy(F.lower("text").alias("k")).agg(F.max(F.length("text")).alias("longest"), F.count("*").alias("copies"))
    return rows.where("copies > 1").select(F.md5(F.col("k").cast("binary")).alias("line_key"), "longest", "copies")


@query(f"WITH {_VIEWS} SELECT a.instrument_id, a.article_key, a.text, i.title, i.verified FROM articles a JOIN instruments i ON i.id = a.instrument_id WHERE i.verified")
def export_verified(spark, sf_dir):
    return store.export(instruments(spark, sf_dir).where("verified"), articles(spark, sf_dir)).select("instrument_id", "article_key", "text", "title", "verified")


# -- text -------------------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, {_fold('text')} AS folded, len({_words('text')}) AS n_tokens FROM documents")
def text_fold_tokens(spark, sf_dir):
    return with_composed(table(spark, sf_dir, "documents"), "text").withColumn("folded", fold("text")).select("doc_id", "folded", F.size(tokens("folded")).alias("n_tokens"))


@query(f"SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({_words('text')}) AS term FROM documents) GROUP BY term")
def doc_term_frequency(spark, sf_dir):
    return with_composed(table(spark, sf_dir, "documents"), "text").select(F.explode(F.array_distinct(stems(fold("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


@query("SELECT doc_id, CASE WHEN length(text) <= 100 THEN text WHEN contains(left(text, 100), ' ') THEN regexp_extract(left(text, 100), '(?s)^(.*) ', 1) || ' …' ELSE left(text, 100) || ' …' END AS snippet FROM documents")
def snippets(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", snippet("text", 100).alias("snippet"))


@query("""SELECT event_type, count(*) AS n, CASE WHEN sum(event_id) >= 1e6 THEN printf('%.1fM', sum(event_id) / 1e6) WHEN sum(event_id) >= 1e3 THEN printf('%.1fK', sum(event_id) / 1e3) ELSE CAST(sum(event_id) AS VARCHAR) END AS shown
  FROM events GROUP BY event_type""")
def usage_totals(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("s")).select("event_type", "n", thousands("s").alias("shown"))


@query("""WITH b AS (SELECT doc_id, text, length(text) AS n, length(regexp_replace(text, '[^\\p{L}]', '', 'g')) AS letters, length(regexp_replace(text, '[^\\x{600}-\\x{6FF}]', '', 'g')) AS ar,
    length(regexp_replace(text, '\\s', '', 'g')) AS chars, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS words,
    length(regexp_replace(text, '[^\\x{FFFD}]', '', 'g')) AS bad FROM documents),
  t AS (SELECT doc_id, text, length(trim(text)) < 20 AS a, letters > 0 AND ar < 0.25 * letters AS b, bad > 3 AS c, words > 30 AND chars < 2.2 * words AS d, words > 30 AND n - chars > 0.55 * n AS e FROM b)
  SELECT doc_id, CASE WHEN trim(text) = '' THEN 0 ELSE greatest(0, round(1 - (a::INT * 0.4 + b::INT * 0.3 + c::INT * 0.3 + d::INT * 0.35 + e::INT * 0.2), 2)) END::DOUBLE AS confidence,
    CASE WHEN trim(text) = '' THEN 1 ELSE a::INT + b::INT + c::INT + d::INT + e::INT END AS n_warnings FROM t""")
def quality_assess(spark, sf_dir):
    confidence, warnings = files.assess("text", F.lit("text"))
    return table(spark, sf_dir, "documents").select("doc_id", confidence.alias("confidence"), F.size(warnings).alias("n_warnings"))


@query("""SELECT conv_id, turn, kind, count(*) AS blocks FROM (
  SELECT conv_id, turn, CASE WHEN line = '' THEN 'blank' WHEN regexp_matches(line, '^[-*•]\\s+') THEN 'bul' WHEN regexp_matches(line, '^[0-9]+[.)]\\s+') THEN 'num' WHEN starts_with(line, '>') THEN 'quote' ELSE 'p' END AS kind
  FROM (SELECT conv_id, turn, trim(unnest(['# ' || role, '- ' || text])) AS line FROM conversations)
  WHERE NOT starts_with(line, '# ')) WHERE kind = 'bul' GROUP BY ALL""")
def markdown_bullets(spark, sf_dir):
    # A heading and a bullet of one line for each turn.
    md = F.concat(F.lit("# "), "role", F.lit("\n- "), F.regexp_replace("text", r"[\s\x{85}\x{2028}\x{2029}]+", " "))
    docs = table(spark, sf_dir, "conversations").select("conv_id", "turn", md.alias("text"))
    return worddoc.block_rows(docs, ["conv_id", "turn"]).where("kind = 'bul'").groupBy("conv_id", "turn", "kind").agg(F.count("*").alias("blocks"))


# -- retrieval --------------------------------------------------------------------------------------------------------

_BM25 = f"""
p AS (SELECT instrument_id, article_key, {_words('text')} AS ws FROM articles),
stat AS (SELECT count(*) AS n, sum(len(ws)) / count(*) AS avg_len FROM p),
post AS (SELECT instrument_id, article_key, len_ AS doc_len, term, count(*) AS tf FROM (SELECT instrument_id, article_key, len(ws) AS len_, unnest(ws) AS term FROM p) GROUP BY ALL),
q AS (SELECT DISTINCT item_id, qterm FROM (SELECT item_id, unnest({_words('text')}) AS qterm FROM benchmark) WHERE length(qterm) > 1),
met AS (SELECT v.term, u.qterm FROM (SELECT DISTINCT term FROM post) v JOIN (SELECT DISTINCT qterm FROM q) u ON left(v.term, 2) = left(u.qterm, 2) AND starts_with(v.term, u.qterm)),
hit AS (SELECT qterm, instrument_id, article_key, doc_len, sum(tf) AS tf FROM post JOIN met USING (term) GROUP BY ALL),
rare AS (SELECT qterm, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END AS idf FROM (SELECT qterm, count(*) AS df FROM hit GROUP BY qterm), stat),
scored AS (SELECT item_id, instrument_id, article_key, sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doc_len / avg_len))) AS score
  FROM hit JOIN rare USING (qterm) JOIN q USING (qterm), stat GROUP BY ALL)"""
_BM25_TOP = f"""WITH {_VIEWS}, {_BM25},
first AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, instrument_id, article_key) <= 32)
SELECT item_id, instrument_id, article_key, round(score, 6) AS score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, instrument_id, article_key) AS rank
FROM first JOIN instruments ON id = instrument_id WHERE verified /*areas*/
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, instrument_id, article_key) <= 8"""


def _bm25(spark, sf_dir, areas=None):
    claims = table(spark, sf_dir, "benchmark")
    claims = claims.withColumn("areas", F.array(F.lit(areas))) if areas else claims
    found = retrieval.search(articles(spark, sf_dir), instruments(spark, sf_dir), claims, "item_id", "text", "areas" if areas else None)
    return found.withColumn("score", F.round("score", 6))


@query(_BM25_TOP)
def bm25_top_k(spark, sf_dir):
    return _bm25(spark, sf_dir)


@query(_BM25_TOP.replace("/*areas*/", "AND lang = 'en'"))
def bm25_by_area(spark, sf_dir):
    return _bm25(spark, sf_dir, "en")


_IDF = f"""df AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT instrument_id, article_key, unnest({_words('text')}) AS term FROM va) WHERE length(term) > 2 GROUP BY term),
idf AS (SELECT term, df, ln(((SELECT count(*) FROM va) + 1) / (df + 0.5)) AS idf FROM df)"""
_VERIFIED = "va AS (SELECT a.* FROM articles a JOIN instruments i ON i.id = a.instrument_id WHERE i.verified)"


def _verified_articles(spark, sf_dir):
    return articles(spark, sf_dir).join(instruments(spark, sf_dir).where("verified").select(F.col("id").alias("instrument_id")), "instrument_id")


@query(f"WITH {_VIEWS}, {_VERIFIED}, {_IDF} SELECT term, df, round(idf, 9) AS idf FROM idf")
def term_idf(spark, sf_dir):
    return retrieval.term_idf(_verified_articles(spark, sf_dir)).withColumn("idf", F.round("idf", 9))


@query(f"""WITH {_VIEWS}, {_VERIFIED}, {_IDF},
c AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_words('text')}) AS term FROM benchmark) WHERE length(term) > 2),
d AS (SELECT doc_id, list_distinct({_words('text')}) AS ws FROM documents WHERE doc_id IN (SELECT item_id FROM benchmark)),
w AS (SELECT c.item_id, c.term, coalesce(idf, (SELECT max(idf) FROM idf)) AS w FROM c LEFT JOIN idf USING (term))
SELECT item_id, round(sum(CASE WHEN list_contains(ws, term) THEN w ELSE 0 END) / sum(w), 6) AS overlap FROM w JOIN d ON doc_id = item_id GROUP BY item_id""")
def support_overlap(spark, sf_dir):
    claims = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("claim"))
    pairs = claims.join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("article")), "item_id")
    out = retrieval.overlap(pairs, retrieval.term_idf(_verified_articles(spark, sf_dir)), ["item_id"])
    return out.select("item_id", F.round("overlap", 6).alias("overlap"))


@query(f"""WITH a AS (SELECT item_id, unnest(list_distinct({_words('text')})) AS t, len(list_distinct({_words('text')})) AS n FROM benchmark),
p AS (SELECT page_id, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS h FROM pages), b AS (SELECT page_id, unnest(list_distinct({_words('h')})) AS t, len(list_distinct({_words('h')})) AS n FROM p)
SELECT item_id, page_id, round(count(*) / (any_value(a.n) + any_value(b.n) - count(*)), 9) AS similarity FROM a JOIN b USING (t) GROUP BY item_id, page_id HAVING count(*) / (any_value(a.n) + any_value(b.n) - count(*)) >= 0.2""")
def title_similarity(spark, sf_dir):
    """Pairs of a claim and a page's heading of similarity 0.2 or more: they share a word, so an equi-join finds them."""
    words = lambda c: F.array_distinct(tokens(fold(c)))
    a = table(spark, sf_dir, "benchmark").withColumn("w", words("text")).select("item_id", F.explode("w").alias("t"), F.size("w").alias("n"))
    b = table(spark, sf_dir, "pages").withColumn("w", words(F.regexp_extract("html", "<h1>([^<]*)</h1>", 1))).select("page_id", F.explode("w").alias("t"), F.size("w").alias("m"))
    pairs = a.join(b, "t").groupBy("item_id", "page_id", "n", "m").agg(F.count("*").alias("c"))
    return pairs.select("item_id", "page_id", F.round(F.col("c") / (F.col("n") + F.col("m") - F.col("c")), 9).alias("similarity")).where("similarity >= 0.2")


# -- citations --------------------------------------------------------------------------------------------------------


def _drafts(spark, sf_dir):
    """Every turn of a conversation cites a line of a document, some of which are not there."""
    marker = F.concat(F.lit(" ⟦BH:law:"), (F.col("conv_id") * 3).cast("string"), F.lit("/2012:م"), (F.col("turn") * 5 + 1).cast("string"), F.lit("⟧ x"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.col("text"), marker).alias("text"))


@query("""SELECT conv_id, turn, length(text) + 1 AS pos, 'law:' || CAST(conv_id * 3 AS VARCHAR) || '/2012:' || CAST(turn * 5 + 1 AS VARCHAR) AS ref_id, text || ' x' AS clean FROM (
  SELECT conv_id, turn, text FROM conversations WHERE NOT contains(text, '⟦') AND NOT regexp_matches(text, '[ \\t]{2}|[ \\t](\\n|$)|[ \\t][،.؛:]'))""")
def parse_citations(spark, sf_dir):
    plain = table(spark, sf_dir, "conversations").where(~F.col("text").contains("⟦") & ~F.col("text").rlike(r"[ \t]{2}|[ \t](\n|$)|[ \t][،.؛:]")).select("conv_id", "turn")
    drafts = _drafts(spark, sf_dir).join(plain, ["conv_id", "turn"], "left_semi")
    return citations.parse_markers(drafts).select("conv_id", "turn", "pos", "ref_id", citations.render_clean("text").alias("clean"))


def _resolved(spark, sf_dir):
    refs = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("conv_id") * 3).cast("string").alias("instrument_id"), (F.col("turn") * 5 + 1).cast("string").alias("article_key"))
    return citations.resolve(refs, instruments(spark, sf_dir), articles(spark, sf_dir))


_RESOLVED = f"""{_VIEWS}, r AS (SELECT conv_id, turn, CAST(conv_id * 3 AS VARCHAR) AS instrument_id, CAST(turn * 5 + 1 AS VARCHAR) AS article_key FROM conversations),
resolved AS (SELECT r.*, CASE WHEN i.id IS NULL THEN 'instrument_missing' WHEN NOT i.verified THEN 'unverified' WHEN a.article_key IS NULL THEN 'article_missing' END AS reason
  FROM r LEFT JOIN instruments i ON i.id = r.instrument_id LEFT JOIN (SELECT DISTINCT instrument_id, article_key FROM articles) a ON a.instrument_id = r.instrument_id AND a.article_key = r.article_key)"""


@query(f"WITH {_RESOLVED} SELECT conv_id, turn, instrument_id, article_key, reason IS NULL AS ok, reason FROM resolved")
def resolve_citations(spark, sf_dir):
    return _resolved(spark, sf_dir).select("conv_id", "turn", "instrument_id", "article_key", "ok", "reason")


@query(f"WITH {_RESOLVED} SELECT coalesce(reason, 'ok') AS reason, count(*) AS n FROM resolved GROUP BY ALL")
def unresolved_reasons(spark, sf_dir):
    return _resolved(spark, sf_dir).groupBy(F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT conv_id, turn, length(text) + 1 AS pos, '⟦BH:' || role || '⟧' AS raw FROM conversations WHERE NOT contains(text, '⟦')")
def malformed_tokens(spark, sf_dir):
    docs = table(spark, sf_dir, "conversations").where(~F.col("text").contains("⟦"))
    docs = docs.select("conv_id", "turn", F.concat("text", F.lit(" ⟦BH:"), "role", F.lit("⟧ ⟦BH:law:1/2000:م1⟧")).alias("text"))
    return citations.malformed_markers(docs).select("conv_id", "turn", "pos", "raw")


@query("SELECT doc_id, n AS section, '## ' || (CASE n WHEN 1 THEN source ELSE lang END) AS heading, length(text) + (CASE n WHEN 1 THEN 2 ELSE 1 END) AS body_chars FROM documents, (VALUES (1), (2)) v(n) WHERE NOT regexp_matches(text, '(?m)^\\s{0,3}#')")
def document_sections(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where(~F.col("text").rlike(r"(?m)^\s{0,3}#"))
    text = F.concat(F.lit("## "), "source", F.lit("\n"), "text", F.lit("\n## "), "lang", F.lit("\n"), "text")
    return citations.sections(docs.select("doc_id", text.alias("text"))).select("doc_id", "section", "heading", F.length("body").alias("body_chars"))


@query()
def gate_report(spark, sf_dir):
    drafts = _drafts(spark, sf_dir)
    drafts = drafts.withColumn("text", F.regexp_replace("text", "⟦BH:law:([0-9]+)/2012", "⟦BH:law:$1/2012"))
    inst = instruments(spark, sf_dir).withColumn("id", F.concat(F.lit("law:"), "id", F.lit("/2012")))
    art = articles(spark, sf_dir).withColumn("instrument_id", F.concat(F.lit("law:"), "instrument_id", F.lit("/2012")))
    docs = drafts.select(F.concat_ws("-", "conv_id", "turn").alias("doc_id"), "text")
    report = verify.gate(docs, inst, art, retrieval.term_idf(_verified_articles(spark, sf_dir)))
    return report.select("doc_id", "passed", "needs_adjudication", "exit_code", "citations_total", "citations_resolved", F.size("problems").alias("n_problems"))


@query()
def calibration_threshold(spark, sf_dir):
    verified = _verified_articles(spark, sf_dir)
    return verify.calibrate(verified, retrieval.term_idf(verified))


# -- fields -----------------------------------------------------------------------------------------------------------


def _places(kind: str, text: str, pattern: str, value: str) -> str:
    """SQL of the matches of a pattern: doc_id, kind, raw, value, line. text may have its runs of digits between chr(1) and
    chr(2), which stands for what RE2 lacks: that no digit comes before or after."""
    bare = lambda x: f"replace(replace({x}, chr(1), ''), chr(2), '')"
    return f"""SELECT doc_id, '{kind}' AS kind, trim({bare('raw')}) AS raw, {value} AS value, pos, length(left(text, pos)) - length(replace(left(text, pos), chr(10), '')) + 1 AS line FROM (
      SELECT doc_id, text, raws[i] AS raw, CAST(list_sum(list_transform(gaps[1:i], lambda g: length({bare('g')}))) + coalesce(list_sum(list_transform(raws[1:i - 1], lambda r: length({bare('r')}))), 0) AS BIGINT) AS pos
      FROM (SELECT doc_id, text, gaps, raws, unnest(range(1, len(raws) + 1)) AS i FROM (SELECT doc_id, text, regexp_split_to_array({text}, '{pattern}') AS gaps, regexp_extract_all({text}, '{pattern}') AS raws FROM marked)))"""


def _iso(y: str, m: str, d: str) -> str:
    return f"CASE WHEN {y} > 0 AND try_cast(printf('%04d-%02d-%02d', {y}, {m}, {d}) AS DATE) IS NOT NULL THEN printf('%04d-%02d-%02d', {y}, {m}, {d}) END"


_DAY = r"\x01([0-9]{1,4})\x02\s*[/\-.]\s*\x01([0-9]{1,2})\x02\s*[/\-.]\s*\x01([0-9]{2,4})\x02"
_GROUPS = [f"CAST(regexp_extract(raw, '{_DAY}', {k}) AS INT)" for k in (1, 2, 3)]
_YEAR = f"(CASE WHEN length(regexp_extract(raw, '{_DAY}', 3)) = 4 THEN {_GROUPS[2]} WHEN {_GROUPS[2]} < 70 THEN {_GROUPS[2]} + 2000 ELSE {_GROUPS[2]} + 1900 END)"
_DATE = f"coalesce(CASE WHEN length(regexp_extract(raw, '{_DAY}', 1)) = 4 THEN {_iso(*_GROUPS)} ELSE coalesce({_iso(_YEAR, _GROUPS[1], _GROUPS[0])}, {_iso(_YEAR, _GROUPS[0], _GROUPS[1])}) END, '?' || replace(replace(raw, chr(1), ''), chr(2), ''))"
#: The kinds of fields that Latin texts can have; the others are in the Arabic frames.
_FIELDS = f"""marked AS (SELECT doc_id, text, regexp_replace(text, '([0-9]+)', chr(1) || '\\1' || chr(2), 'g') AS mt FROM documents),
places AS ({_places("date", "mt", _DAY, _DATE)}
  UNION ALL {_places("percent", "text", "[0-9]+(?:[.][0-9]+)?[[:space:]]*%", "regexp_extract(raw, '^[0-9]+([.][0-9]+)?')")}
  UNION ALL {_places("idnum", "mt", "[\\x01][0-9]{8,11}[\\x02]", "replace(replace(raw, chr(1), ''), chr(2), '')")}),
fields AS (SELECT doc_id, kind, arg_min(raw, pos) AS raw, value, line FROM places GROUP BY doc_id, kind, value, line)"""


@query(f"WITH {_FIELDS} SELECT doc_id, kind, raw, value, line FROM fields")
def critical_fields(spark, sf_dir):
    return fields.critical_fields(table(spark, sf_dir, "documents"), ["doc_id"]).drop("context")


@query(f"""WITH {_FIELDS} SELECT doc_id, 'impossible_date' AS code, raw AS field, line FROM fields WHERE kind = 'date' AND starts_with(value, '?')
UNION ALL SELECT doc_id, 'over_100_percent', value, line FROM fields WHERE kind = 'percent' AND CAST(value AS DOUBLE) > 100
UNION ALL SELECT doc_id, 'impossible_birth_date', value, line FROM fields WHERE kind = 'idnum' AND length(value) = 9
  AND {_iso("1900 + TRY_CAST(left(value, 2) AS INT)", "TRY_CAST(substr(value, 3, 2) AS INT)", "TRY_CAST(substr(value, 5, 2) AS INT)")} IS NULL""")
def field_inconsistencies(spark, sf_dir):
    return fields.consistency(table(spark, sf_dir, "documents"), ["doc_id"])


@query("""WITH t AS (SELECT doc_id, 'a' AS reader, text FROM documents UNION ALL SELECT doc_id, 'b', replace(text, '7', '1') FROM documents),
f AS (SELECT DISTINCT doc_id, reader, v AS value FROM (SELECT doc_id, reader, unnest(regexp_split_to_array(text, '[^0-9]+')) AS v FROM t) WHERE length(v) BETWEEN 8 AND 11)
SELECT doc_id, 'idnum' AS kind, value, min(reader) AS read_by, CASE min(reader) WHEN 'a' THEN 'b' ELSE 'a' END AS missed_by FROM f GROUP BY doc_id, value HAVING count(*) = 1""")
def reader_disagreement(spark, sf_dir):
    """Two readings of each document, of which the second takes 7 for 1: numbers of 8 to 11 digits that one has."""
    docs = table(spark, sf_dir, "documents")
    both = docs.select("doc_id", F.lit("a").alias("reader"), "text").union(docs.select("doc_id", F.lit("b"), F.replace("text", F.lit("7"), F.lit("1"))))
    found = fields.critical_fields(both, ["doc_id", "reader"]).where("kind = 'idnum'")
    out = fields.disagreements(found, both.select("doc_id", "reader"), ["doc_id"])
    return out.select("doc_id", "kind", "value", F.array_join("read_by", ",").alias("read_by"), F.array_join("missed_by", ",").alias("missed_by"))


# -- contracts --------------------------------------------------------------------------------------------------------

#: Rules for the Latin texts of the tables: type, part, key, basis, patterns, sanad.
_RULES = [
    (None, "required", "license", "structural", ["license", "all rights reserved", "cc by"], None),
    ("en", "required", "the", "structural", ["the of", "of the"], None),
    ("en", "void", "insult", "structural", ["idiot", "pathetic", "loser"], None),
    ("de", "required", "und", "structural", ["und der", "der und"], None),
    ("fr", "void", "secret", "statutory", ["token"], ""),
    ("de", "void", "secret", "statutory", ["token"], ""),
]


def _rules(spark, sf_dir):
    rows = [(t, p, k, k, b, x, "", s, []) for t, p, k, b, x, s in _RULES]
    inst = instruments(spark, sf_dir)
    return contracts.bases(spark.createDataFrame(rows, contracts.RULES), inst, articles(spark, sf_dir))


_RULE_VALUES = ", ".join(f"({'NULL' if t is None else repr(t)}, {p!r}, {k!r}, {b!r}, {x!r})" for t, p, k, b, x, _ in _RULES)


@query(f"""WITH r(ctype, part, key, basis, patterns) AS (VALUES {_RULE_VALUES}), d AS (SELECT doc_id, lang, {_fold('text')} AS f FROM documents),
x AS (SELECT doc_id, lang AS ctype, part, key, basis, len(list_filter(patterns, lambda p: contains(f, p))) > 0 AS present FROM d JOIN r ON r.ctype IS NULL OR r.ctype = lang)
SELECT doc_id, ctype, part, key, present, CASE WHEN (part = 'required') = present THEN CASE WHEN present THEN 'found' ELSE 'none' END WHEN basis = 'statutory' THEN 'manual' ELSE 'problem' END AS status FROM x""")
def clause_presence(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("ctype", F.col("lang"))
    return contracts.clause_findings(docs, _rules(spark, sf_dir)).select("doc_id", "ctype", "part", "key", "present", "status")


@query("SELECT page_id, len(list_distinct(regexp_extract_all(html, '<[^<>\\n]{1,80}>'))) AS n_placeholders FROM pages WHERE NOT contains(html, '[اختر:')")
def placeholders(spark, sf_dir):
    return table(spark, sf_dir, "pages").where(~F.col("html").contains("[اختر:")).select("page_id", F.size(contracts.placeholders("html")).alias("n_placeholders"))


# -- pages ------------------------------------------------------------------------------------------------------------


@query()
def page_text(spark, sf_dir):
    return files.page_texts(table(spark, sf_dir, "pages"))


@query()
def page_links(spark, sf_dir):
    return links.page_links(table(spark, sf_dir, "pages"))


@query()
def link_match_top4(spark, sf_dir):
    """Links against a registry of all languages' heading words: the titles are the distinct folded texts of links."""
    found = links.page_links(table(spark, sf_dir, "pages"))
    titles = found.where(F.length("text") > 3).select(fold("text").alias("title")).distinct()
    registry = titles.select(F.col("title").alias("key"), F.lit("law").alias("type"), F.lit("36").alias("number"), F.lit("2012").alias("year"), "title")
    return links.match_registry(found, registry).select("key", "page_id", "url", "score", "rank")


@query("SELECT page_id, url FROM pages WHERE regexp_extract(lower(url), '^[a-z]+://([^/?#:]*)', 1) IN ('www.example.com', 'blog.tionsh.example.net', 'ththed.example.org', 'tionsh.example.net')")
def allowlist_hosts(spark, sf_dir):
    hosts = spark.createDataFrame([(h,) for h in ("www.example.com", "blog.tionsh.example.net", "ththed.example.org", "TIONSH.example.net")], "host string")
    return links.allowed(table(spark, sf_dir, "pages"), hosts).select("page_id", "url")


# -- workflow ---------------------------------------------------------------------------------------------------------

_ALLOWED = [("view", "click"), ("click", "view"), ("click", "purchase"), ("view", "signup"), ("signup", "view"), ("error", "view"), ("view", "view")]
_ALLOWED_VALUES = ", ".join(map(str, _ALLOWED))


def _allowed(spark):
    return spark.createDataFrame(_ALLOWED, "from_stage string, to_stage string")


@query(f"""WITH a(f, t) AS (VALUES {_ALLOWED_VALUES}), s AS (SELECT user_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS f, event_type AS t FROM events)
SELECT user_id, f AS from_stage, t AS to_stage, count(*) AS n FROM s WHERE f IS NOT NULL AND (f, t) NOT IN (SELECT (f, t) FROM a) GROUP BY ALL""")
def stage_transition_violations(spark, sf_dir):
    steps = workflow.transitions(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type")
    return workflow.violations(steps, _allowed(spark)).select("user_id", "from_stage", "to_stage", "n")


@query(f"""WITH RECURSIVE a(f, t) AS (VALUES {_ALLOWED_VALUES}), w(stage, steps) AS (SELECT 'signup', 0 UNION SELECT a.t, w.steps + 1 FROM w JOIN a ON a.f = w.stage WHERE w.steps < 6)
SELECT stage, min(steps) AS steps FROM w GROUP BY stage""")
def reachability(spark, sf_dir):
    return workflow.reachable(_allowed(spark), "signup")
