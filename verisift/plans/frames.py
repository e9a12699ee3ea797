"""Queries over small inline frames of Arabic legal text, which the driver's tables lack, with pinned results.

The expected rows are what the operators have to give for these texts; SQL only lists them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.quantities import quantities
from ..operators import citations, contracts, fields, links, segment, verify, workflow
from ..sources import store

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def pinned(columns: str, *rows: tuple):
    """Registers a query with the rows that it returns, in any order."""

    def value(x):
        return "NULL" if x is None else str(x).upper() if isinstance(x, bool) else f"CAST({x!r} AS DOUBLE)" if isinstance(x, float) else repr(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(spark)
        ORACLE_SQL[f.__name__] = f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(value, r)) + ')' for r in rows)}) AS t({columns})"
        return f

    return register


STATUTE = """قانون رقم (36) لسنة 2012 بإصدار قانون العمل

ديباجة

المادة (1)
في تطبيق أحكام هذا القانون.

المادة (2) :
لا تسري أحكام هذا القانون.

مادة رقم (٣)
تُحسب مدة الخدمة.

المادة الرابعة
يجب أن يكون العقد مكتوباً.

المادة (99 مكرراً) -
للعامل الحق في إجازة.

المادة (1)
نص أطول من النص الأول للمادة الأولى بكثير."""
TITLE = "قانون رقم (٣٦) لسنة ٢٠١٢ بإصدار قانون العمل"
LAW = {
    "99": "يستحق العامل إجازة سنوية بأجر أساسي لا تقل مدتها عن ثلاثين يوماً بواقع يومين ونصف عن كل شهر.",
    "111": "يقع باطلاً كل فصل يكون تعسفياً أو مخالفاً لأحكام هذا القانون، ويستحق العامل تعويضاً عادلاً تقدره المحكمة.",
    "2": "لا تسري أحكام هذا القانون على موظفي الحكومة والأشخاص الاعتبارية العامة.",
    "5": "لا يجوز لصاحب العمل إنهاء الخدمة أثناء الإجازة",
}


def _corpus(spark) -> tuple[DataFrame, DataFrame]:
    base = dict.fromkeys(store.INSTRUMENTS.names)
    labour = base | {"id": "law:36/2012", "key": "labour", "type": "law", "number": "36", "year": "2012", "title": "قانون العمل", "verified": True, "practice_areas": ["labour"], "amendments": [("law", "31", "2014")], "consolidated": False}
    other = base | {"id": "law:9/2015", "key": "arb", "type": "law", "number": "9", "year": "2015", "title": "قانون التحكيم", "verified": False, "practice_areas": [], "amendments": [], "consolidated": False}
    instruments = spark.createDataFrame([tuple(x.values()) for x in (labour, other)], store.INSTRUMENTS)
    articles = [("law:36/2012", k, k, False, f"المادة ({k})", t) for k, t in LAW.items()] + [("law:9/2015", "1", "1", False, "المادة (1)", "نص التحكيم")]
    return instruments, spark.createDataFrame(articles, store.ARTICLES)


def _cases(spark, *texts: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(texts, 1)), "k long, text string")


@pinned("article_key, number, bis, label, text",
    ("1", "1", False, "المادة (1)", "نص أطول من النص الأول للمادة الأولى بكثير."), ("2", "2", False, "المادة (2)", "لا تسري أحكام هذا القانون."),
    ("3", "3", False, "المادة (3)", "تحسب مدة الخدمة."), ("4", "4", False, "المادة (4)", "يجب أن يكون العقد مكتوبا."), ("99-مكرر", "99", True, "المادة (99 مكرر)", "للعامل الحق في إجازة."))
def arabic_segmentation(spark):
    df = spark.createDataFrame([("law:36/2012", STATUTE), ("law:2/2000", "لا مواد"), ("law:3/2000", None)], "instrument_id string, text string")
    return segment.segment_articles(df.withColumn("text", text.normalize("text"))).select("article_key", "number", "bis", "label", "text")


@pinned("k, matches, formulae",
    (1, "true", "قانون 36/2012"), (2, "false", "قانون 36/2012"), (3, "false", "قانون 36/2012"), (4, "true", "مرسوم 19/2001"), (5, "none", ""), (6, "true", "قانون 36/2012;قانون 31/2014"), (7, "false", "قانون 12/1971"))
def arabic_identity(spark):
    cases = [
        (1, TITLE, "law", "36", "2012"), (2, TITLE, "law", "37", "2012"), (3, TITLE, "ord", "36", "2012"), (4, "مرسوم رقم (19) لسنة 2001", "dl", "019", "2001"), (5, "المادة (1) نص ما", "law", "1", "2000"),
        (6, TITLE + "\nمعدل بالقانون رقم (31) لسنة 2014", "law", "36", "2012"), (7, "بعد الاطلاع على القانون رقم (12) لسنة 1971", "law", "36", "2012"),
    ]
    rows = spark.createDataFrame(cases, "k long, t string, type string, number string, year string").withColumn("f", segment.enactments(text.normalize("t")))
    shown = F.array_join(F.transform("f", lambda x: F.concat(x["kind"], F.lit(" "), x["number"], F.lit("/"), x["year"])), ";")
    return rows.select("k", F.coalesce(segment.identity_matches(F.col("f"), "type", "number", "year").cast("string"), F.lit("none")).alias("matches"), shown.alias("formulae"))


@pinned("k, value, unit",
    (1, 30.0, "يوم"), (2, 30.0, "يوم"), (3, 45.0, "يوم"), (4, 120.0, "يوم"), (5, 2.0, "سنه"), (6, 5000.0, "دينار"), (7, 50.0, "%"), (8, 3.0, "يوم"), (8, 5.0, "يوم"), (9, 1120.0, "دينار"), (10, 2.0, "شهر"), (10, 20.0, ""))
def arabic_quantities(spark):
    df = _cases(spark, "خلال 30 يوما", "ثلاثين يوماً", "خمسة وأربعين يوماً", "مائة وعشرين يوما", "سنتين", "خمسة آلاف دينار", "نسبة 50%", "ثلاثة أو 5 أيام", "ألف ومائة وعشرون دينارا", "عشرون شهرين")
    return df.select("k", F.explode(quantities("text")).alias("q")).select("k", "q.value", "q.unit")


@pinned("k, verdict, conflicts, doubts",
    (1, 'supported', '', ''),
    (2, 'conflicting', 'quantity:45.0 يوم', ''),
    (3, 'supported', '', ''),
    (4, 'conflicting', 'modality', ''),
    (5, 'adjudicate', '', 'overlap;frame:prohibition'),
    (6, 'adjudicate', '', 'exception'))
def arabic_support(spark):
    cases = [
        (1, "كل فصل تعسفي يقع باطلاً ويستحق العامل تعويضاً عادلاً تقدره المحكمة", LAW["111"]), (2, "يستحق العامل إجازة لا تقل عن خمسة وأربعين يوماً", LAW["99"]),
        (3, "إجازة لا تقل عن ثلاثين يوماً", LAW["99"]), (4, "يجوز لصاحب العمل إنهاء الخدمة", LAW["5"]), (5, "يحظر على صاحب العمل إنهاء الخدمة أثناء الإجازة", LAW["99"]), (6, "تسري أحكام هذا القانون على جميع العاملين", LAW["2"]),
    ]
    got = verify.support(spark.createDataFrame(cases, "k long, claim string, article string"), None, ["k"])
    return got.select("k", "verdict", F.array_join("conflicts", ";").alias("conflicts"), F.array_join("doubts", ";").alias("doubts"))


NOTE = (
    "# مذكرة\n\n## ثالثًا: الأسانيد\nلما كان مفاد المادة (99) ⟦BH:law:36/2012:م99⟧ أن العامل يستحق إجازة "
    "سنوية لا تقل عن ثلاثين يوماً، وكانت المادة (111) ⟦BH:law:36/2012:م111⟧ تقضي ببطلان الفصل التعسفي، فإن الدعوى تقوم.\n"
)


@pinned("doc_id, passed, exit_code, citations_total, citations_resolved, problems, notes",
    (1, True, 3, 2, 2, '', 'قانون العمل: law 31/2014'),
    (2, False, 1, 1, 0, '0:too few citations;1:instrument_missing ⟦BH:law:99/2012:م1⟧;1:malformed ⟦BH:خطأ⟧', ''),
    (3, False, 1, 1, 1, '0:uncited section الدفوع', 'قانون العمل: law 31/2014'),
    (4, False, 1, 1, 0, '0:too few citations;1:quantity:45.0 يوم ⟦BH:law:36/2012:م99⟧', 'قانون العمل: law 31/2014'),
    (5, False, 1, 0, 0, '0:too few citations', ''))
def arabic_gate(spark):
    drafts = [
        (1, NOTE), (2, "نص ⟦BH:law:99/2012:م1⟧ و⟦BH:خطأ⟧"), (3, "## الدفوع\nحجة بلا سند\n## خاتمة\nنص ⟦BH:law:36/2012:م99⟧ إجازة العامل السنوية بأجر أساسي ثلاثين يوماً"),
        (4, "يستحق العامل إجازة سنوية بأجر أساسي ⟦BH:law:36/2012:م99⟧ مدتها خمسة وأربعون يوماً"), (5, "لا شيء"),
    ]
    got = verify.gate(spark.createDataFrame(drafts, "doc_id long, text string"), *_corpus(spark), None, min_citations=1)
    said = F.array_join(F.transform("problems", lambda p: F.concat(p["line"].cast("string"), F.lit(":"), p["problem"])), ";")
    return got.select("doc_id", "passed", "exit_code", "citations_total", "citations_resolved", said.alias("problems"), F.array_join("amendment_notes", ";").alias("notes"))


_FIELD_TEXTS = (
    "حرر في 14/03/2024", "بتاريخ 2024-03-14", "الموافق 14 مارس 2024", "في ١٤/٠٣/٢٠٢٤", "في 14/03/99", "الأجر 620.500 دينارًا", "قيمة الدعوى 12,500 دينار", "BHD 750", "مهلة ثلاثين يومًا",
    "من 01/01/2020 إلى 01/01/2021 لمدة ثلاث سنوات", "رقم 123456789 و1234567", "نسبة 12.5%", "سطر\nفي 12 رمضان 1445", "حرر في 31/02/2024",
)


@pinned("k, kind, raw, value, line",
    (1, 'date', '14/03/2024', '2024-03-14', 1),
    (2, 'date', '2024-03-14', '2024-03-14', 1),
    (3, 'date', '14 مارس 2024', '2024-03-14', 1),
    (4, 'date', '14/03/2024', '2024-03-14', 1),
    (5, 'date', '14/03/99', '1999-03-14', 1),
    (6, 'money', '620.500 دينار', '620.500 دينار', 1),
    (7, 'money', '12,500 دينار', '12500 دينار', 1),
    (8, 'money', 'BHD 750', '750 bhd', 1),
    (9, 'duration', '30 يوم', '30 يوم', 1),
    (10, 'date', '01/01/2020', '2020-01-01', 1),
    (10, 'date', '01/01/2021', '2021-01-01', 1),
    (10, 'duration', '3 سنه', '3 سنه', 1),
    (11, 'idnum', '123456789', '123456789', 1),
    (12, 'percent', '12.5%', '12.5', 1),
    (13, 'date', '12 رمضان 1445', 'هجري:12 رمضان 1445', 2),
    (14, 'date', '31/02/2024', '?31/02/2024', 1))
def arabic_fields(spark):
    return fields.critical_fields(_cases(spark, *_FIELD_TEXTS), ["k"]).drop("context")


@pinned("k, code, field, line",
    (1, 'impossible_date', '31/02/2024', 1),
    (2, 'hijri_date', '12 رمضان 1445', 1),
    (3, 'dinar_decimals', '620.50 دينار', 1),
    (5, 'total_differs', '800 دينار', 1),
    (9, 'mixed_digits', '12٣45', 1),
    (10, 'impossible_birth_date', '879912345', 1),
    (12, 'over_100_percent', '150', 1),
    (7, 'duration_differs', '3 سنه', 1))
def arabic_faults(spark):
    return fields.consistency(_cases(
        spark, "حرر في 31/02/2024", "في 12 رمضان 1445", "الأجر 620.50 دينارًا", "الأجر 620.500 دينارًا", "الأساسي 620 دينارًا والسكن 150 دينارًا والمجموع 800 دينار",
        "الأساسي 620 دينارًا والسكن 150 دينارًا والمجموع 770 دينار", "يستمر العقد من 01/01/2020 إلى 01/01/2021 لمدة ثلاث سنوات", "الموافق 14 مارس 2024\nينتهي في 14/04/2024\nمدة الخدمة خمس سنوات",
        "المبلغ 12٣45 دينار", "الرقم الشخصي 879912345", "الرقم الشخصي 870512345", "خصم 150%",
    ), ["k"])


@pinned("k, folded, stems",
    (1, 'الفصل التعسفي فصلا تعسفيا والعاملين لل ابن', 'فصل تعسف فصل تعسفي عامل لل ابن'),
    (2, 'الشركه اذا', 'شرك اذا'),
    (3, 'الماده 99 12', 'ماد 99 12'),
    (4, 'a_b c² د', 'a_b c² د'))
def arabic_stems(spark):
    df = _cases(spark, "الفصل التعسفي فصلاً تعسفياً والعاملين لل ابن", "الشركة إذا", "المادة (٩٩) ۱۲ ــ", "A_b, C²!  ؟د").withColumn("f", text.fold(text.composed("text")))
    return df.withColumn("folded", F.col("f")).select("k", "folded", F.array_join(text.stems("folded"), " ").alias("stems"))


@pinned("ref_id, raw, clean",
    ('law:36/2012:99', '⟦BH:law:36/2012:م99⟧', 'ولما كان الثابت أن المادة (99) من قانون العمل\nقد قررت حقًا، وكان مفاد المادة (١٥٦)\nأن الالتزام ينقضي، ووفقًا للقانون و.\n'),
    ('dl:19/2001:156', '⟦BH:dl:19/2001:م١٥٦⟧', 'ولما كان الثابت أن المادة (99) من قانون العمل\nقد قررت حقًا، وكان مفاد المادة (١٥٦)\nأن الالتزام ينقضي، ووفقًا للقانون و.\n'),
    ('law:9/2015', '⟦BH:law:9/2015⟧', 'ولما كان الثابت أن المادة (99) من قانون العمل\nقد قررت حقًا، وكان مفاد المادة (١٥٦)\nأن الالتزام ينقضي، ووفقًا للقانون و.\n'),
    ('law:7/2000:3-مكرر', '⟦BH:law:7/2000:م3مكررا⟧', 'ولما كان الثابت أن المادة (99) من قانون العمل\nقد قررت حقًا، وكان مفاد المادة (١٥٦)\nأن الالتزام ينقضي، ووفقًا للقانون و.\n'))
def arabic_markers(spark):
    draft = "ولما كان الثابت أن المادة (99) من قانون العمل ⟦BH:law:36/2012:م99⟧\nقد قررت حقًا، وكان مفاد المادة (١٥٦)\n⟦BH:dl:19/2001:م١٥٦⟧ أن الالتزام ينقضي، ووفقًا للقانون ⟦BH:law:9/2015⟧ و⟦BH:law:7/2000:م3مكررا⟧.\n"
    return citations.parse_markers(_cases(spark, draft)).select("ref_id", "raw", citations.render_clean("text").alias("clean"))


@pinned("doc_id, passed, found, problems, manual, placeholders",
    (1, True, 'leave;parties;wage', '', '', ''),
    (2, False, 'parties', 'leave;waiver', 'wage', '<الاسم>;[اختر: أ أو ب]'),
    (3, False, '', 'parties', '', ''),
    (4, True, 'parties;price', '', 'bad', ''))
def arabic_clauses(spark):
    rules = spark.createDataFrame([
        (None, "required", "parties", "p", "structural", ["الطرف الأول"], "w", None, None), ("work", "required", "wage", "w", "statutory", ["الأجر"], "w", "", ["أجر"]),
        ("work", "required", "leave", "l", "statutory", ["إجازة"], "w", "⟦BH:law:36/2012:م99⟧", []), ("work", "void", "waiver", "v", "structural", ["يتنازل العامل"], "w", None, None),
        ("sale", "required", "price", "x", "structural", ["الثمن"], "w", None, None), ("sale", "void", "bad", "b", "statutory", ["باطل"], "w", "⟦BH:law:36/2012:م500⟧", []),
    ], contracts.RULES)
    docs = [(1, "work", "الطرف الاول ... الاجر ... اجازة"), (2, "work", "الطرف الأول يتنازل العامل <الاسم> [اختر: أ أو ب] <الاسم>"), (3, "other", "x"), (4, "sale", "الطرف الأول الثمن باطل")]
    got = contracts.clause_report(spark.createDataFrame(docs, "doc_id long, ctype string, text string"), contracts.bases(rules, *_corpus(spark)))
    return got.select("doc_id", "passed", *[F.array_join(c, ";").alias(c) for c in ("found", "problems", "manual", "placeholders")])


@pinned("key, url, score, strong, from_context",
    ('labour', 'https://Host/a.pdf', 0.765, False, True),
    ('trade', 'https://Host/dir/b?x=1', 0.9, True, False))
def arabic_links(spark):
    html = """<ul><li>قانون العمل رقم 36 لسنة 2012 <a href="/a.pdf#x">تحميل</a></li><li><a href="b?x=1">قانون التجارة رقم 7 لسنة 1987</a><li>
      <a href='mailto:x'>m</a><a href="http://other/c">out</a><a href="/a.pdf">again</a><a href="/i"><img alt="صورة"></a></ul>"""
    rows = links.page_links(spark.createDataFrame([(1, "https://Host/dir/", html), (2, None, None)], "page_id long, url string, html string"))
    registry = spark.createDataFrame([("labour", "law", "36", "2012", "قانون العمل"), ("trade", "law", "7", "1987", "قانون التجارة")], "key string, type string, number string, year string, title string")
    return links.match_registry(rows, registry).where("rank = 1").select("key", "url", "score", "strong", "from_context")


@pinned("key, status, verified, articles",
    ('ok', 'ok', True, 5),
    ('gap', 'ok', False, 5),
    ('wrong', 'identity', False, 0),
    ('title', 'title', False, 0),
    ('short', 'short_text', False, 0),
    ('none', 'no_articles', False, 0))
def arabic_import(spark):
    body = STATUTE + "\n" + "كلمة " * 60
    rows = [
        ("ok", "36", "قانون العمل", body, "1"), ("gap", "36", "قانون العمل", body, ""), ("wrong", "37", "قانون العمل", body, "1"), ("title", "36", "قانون آخر تماما", body, "1"), ("short", "36", "قانون العمل", "نص", "1"),
        ("none", "36", "قانون العمل", "كلمة " * 60, "1"),
    ]
    df = spark.createDataFrame(rows, "key string, number string, title string, text string, gazette_issue string").withColumns({"type": F.lit("law"), "year": F.lit("2012"), "hint": F.lit(""), "url": F.lit("u"), "gazette_date": F.lit("2012-01-01")})
    # Each is an import of its own: they are the same instrument.
    out = None
    for key, *_ in rows:
        decided, found = store.import_decisions(df.where(F.col("key") == key).withColumn("text", text.normalize("text")), verify.provenance_gap("url", "gazette_issue", "gazette_date"))
        one = decided.select("key", "status", "verified").crossJoin(found.agg(F.count("*").alias("articles")))  # one row each
        out = one if out is None else out.union(one)
    return out


@pinned("stage, fault", ("e", "unreachable"), ("b", "exit_not_allowed"), ("e", "incomplete_review"), ("z", "unknown_stage"))
def pipeline_faults(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "d"), ("e", "a"), ("a", "z")], "from_stage string, to_stage string")
    stages = spark.createDataFrame([("a", "work", [], None), ("b", "review", ["a", "z"], "r"), ("d", "work", [], None), ("e", "review", [], None)], "key string, kind string, exits array<string>, reviewed_by string")
    return workflow.pipeline_faults(stages, edges, "a")


@pinned("confirmed, corrected, blank, unreadable", (1, 1, 1, 1))
def sheet_confirmations(spark):
    answers = [(1, "620.500 دينارًا", "620.500دينارًا"), (1, "14/03/2024", "15/03/2024"), (1, "x", "غير مقروء"), (1, "y", " ")]
    return fields.confirmations(spark.createDataFrame(answers, "doc_id long, raw string, answer string"), ["doc_id"]).drop("doc_id")
