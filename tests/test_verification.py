"""Semantics of the verification operators on small Arabic frames."""

import datetime
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from verisift.functions import lexicon, quantities, text
from verisift.operators import citations, contracts, fields, links, retrieval, segment, verify, workflow
from verisift.sources import documents, store, worddoc


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()))
    return df.select(expr.alias("x")).first().x


# -- text -------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "fn, given, want",
    [
        (text.normalize_digits, "المادة (٩٩) ۱۲", "المادة (99) 12"),
        (text.strip_marks, "العَامِل ــ", "العامل "),
        (text.fold, "الشركة إذا", "الشركه اذا"),
        (text.fold, "A_b, C²!  ؟د", "a_b c² د"),
        (text.normalize, "é  x\n\n\n\ny‏ ", "é x\n\ny"),
        (text.strip_zeros, "007", "7"),
        (text.strip_zeros, "000", "0"),
        (text.unescape_xml, "&lt;a&gt; &amp;", "<a> &"),
        (lambda c: text.snippet(c, 9), "eins zwei drei", "eins …"),
        (lambda c: text.snippet(c, 4), "abcdefgh", "abcd …"),
        (lambda c: text.snippet(c, 40), "kurz", "kurz"),
        (text.thousands, "1234567", "1.2M"),
        (text.thousands, "999", "999"),
    ],
)
def test_scalars(spark, fn, given, want):
    assert one(spark, fn("t"), t=given) == want


def test_stems(spark):
    got = one(spark, text.stems(text.fold("t")), t="الفصل التعسفي فصلاً تعسفياً والعاملين لل ابن")
    assert got == ["فصل", "تعسف", "فصل", "تعسفي", "عامل", "لل", "ابن"]
    assert one(spark, text.similarity(text.fold("a"), text.fold("b")), a="قانون العمل في القطاع الأهلي", b="قانون العمل فى القطاع الاهلى") == 1.0
    assert one(spark, text.similarity(text.fold("a"), text.fold("b")), a="قانون العمل في القطاع الأهلي", b="قانون التجارة") < 0.3
    assert one(spark, text.similarity(text.fold("a"), text.fold("b")), a="", b="x") == 0.0
    assert one(spark, text.ordinal("w"), w="السابع عشر") == 17 and one(spark, text.ordinal("w"), w="كتاب") is None
    assert one(spark, text.line_of("t", F.lit(4)), t="a\nb\nc") == 3


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
نص أطول من النص الأول للمادة الأولى بكثير.

المادة (7)

المادة (8)
آخر"""


def test_segmentation(spark):
    df = spark.createDataFrame([("law:1/2000", STATUTE), ("law:2/2000", "no articles"), ("law:3/2000", None)], "instrument_id string, text string")
    rows = segment.segment_articles(df.withColumn("text", text.normalize("text"))).orderBy("position").collect()
    assert [r.article_key for r in rows] == ["1", "2", "3", "4", "99-مكرر", "8"]
    assert rows[0].text.startswith("نص أطول") and rows[4].bis and rows[4].label == "المادة (99 مكرر)" and rows[4].number == "99"
    assert rows[3].text == "يجب أن يكون العقد مكتوبا." and not any("ديباجة" in r.text for r in rows)


LAB = "قانون رقم (٣٦) لسنة ٢٠١٢ بإصدار قانون العمل"


@pytest.mark.parametrize(
    "said, type_, number, year, want",
    [
        (LAB, "law", "36", "2012", True), (LAB, "law", "37", "2012", False), (LAB, "law", "36", "2013", False), (LAB, "ord", "36", "2012", False),
        ("مرسوم رقم (19) لسنة 2001", "dl", "19", "2001", True), ("المادة (1) نص ما", "law", "1", "2000", None),
        (LAB + "\nمعدل بالقانون رقم (31) لسنة 2014", "law", "36", "2012", True), ("بعد الاطلاع على القانون رقم (12) لسنة 1971", "law", "36", "2012", False),
    ],
)
def test_identity(spark, said, type_, number, year, want):
    df = spark.createDataFrame([(said, type_, number, year)], "t string, type string, number string, year string").withColumn("t", text.normalize("t"))
    assert df.select(segment.identity_matches(segment.enactments("t"), "type", "number", "year")).first()[0] is want


def test_enactments(spark):
    got = one(spark, segment.enactments(text.normalize("t")), t=f"{LAB} ... {LAB} مرسوم  بقانون رقم 019 لسنة 2001 قانون رقم (9) لعام 2015")
    assert [tuple(x) for x in got] == [("قانون", "36", "2012"), ("مرسوم بقانون", "19", "2001"), ("قانون", "9", "2015")]


# -- citations --------------------------------------------------------------------------------------------------------

DRAFT = "ولما كان الثابت أن المادة (99) من قانون العمل ⟦BH:law:36/2012:م99⟧\nقد قررت حقًا، وكان مفاد المادة (١٥٦)\n⟦BH:dl:19/2001:م١٥٦⟧ أن الالتزام ينقضي، ووفقًا للقانون ⟦BH:law:9/2015⟧ و⟦BH:law:7/2000:م3مكررا⟧.\n"


def test_markers(spark):
    rows = citations.parse_markers(spark.createDataFrame([(1, DRAFT), (2, ""), (3, None)], "doc_id long, text string")).orderBy("pos").collect()
    assert [r.ref_id for r in rows] == ["law:36/2012:99", "dl:19/2001:156", "law:9/2015", "law:7/2000:3-مكرر"]
    assert all(DRAFT[r.pos :].startswith(r.raw) for r in rows)
    df = spark.createDataFrame([r.asDict() for r in rows[:1]], "type string, number string, year string, article string, bis boolean")
    r = df.select(citations.to_marker("type", "number", "year", "article", "bis").alias("m"), citations.to_arabic("type", "number", "year", "article", "bis").alias("a")).first()
    assert (r.m, r.a) == ("⟦BH:law:36/2012:م99⟧", "المادة (99) من قانون رقم (36) لسنة 2012")
    bad = "المادة (5) ⟦BH:law:خمسة/2012:م5⟧ و⟦مرجع غير صالح⟧ و⟦BH:law:1/2020:م1⟧"
    df = spark.createDataFrame([(1, bad)], "doc_id long, text string")
    assert citations.parse_markers(df).count() == 1
    assert sorted((r.pos, r.raw) for r in citations.malformed_markers(df).collect()) == [(bad.find("⟦"), "⟦BH:law:خمسة/2012:م5⟧"), (bad.find("⟦مرجع"), "⟦مرجع غير صالح⟧")]


M = "⟦BH:law:36/2012:م99⟧"


@pytest.mark.parametrize(
    "given, want",
    [
        (f"المادة (99) من قانون العمل {M} تقرر ذلك.", "المادة (99) من قانون العمل تقرر ذلك."), (f"سطر\n{M} تقرر للعامل", "سطر\nتقرر للعامل"),
        ("1. طلب\n    - فرعي\n        - أعمق", "1. طلب\n    - فرعي\n        - أعمق"), ("نص  فيه   فراغ ،ونقطة", "نص فيه فراغ،ونقطة"), (f"نص {M}  \nتالٍ", "نص\nتالٍ"),
    ],
)
def test_clean(spark, given, want):
    assert one(spark, citations.render_clean("t"), t=given) == want


CORPUS = {
    "99": "يستحق العامل إجازة سنوية بأجر أساسي لا تقل مدتها عن ثلاثين يوماً بواقع يومين ونصف عن كل شهر.",
    "111": "يقع باطلاً كل فصل يكون تعسفياً أو مخالفاً لأحكام هذا القانون، ويستحق العامل تعويضاً عادلاً تقدره المحكمة.",
    "2": "لا تسري أحكام هذا القانون على موظفي الحكومة والأشخاص الاعتبارية العامة.",
    "5": "لا يجوز لصاحب العمل إنهاء الخدمة أثناء الإجازة",
}


@pytest.fixture(scope="module")
def corpus(spark):
    inst = [
        {"id": "law:36/2012", "key": "labour", "type": "law", "number": "36", "year": "2012", "title": "قانون العمل", "verified": True, "practice_areas": ["labour"], "amendments": [("law", "31", "2014")], "consolidated": False},
        {"id": "law:9/2015", "key": "arb", "type": "law", "number": "9", "year": "2015", "title": "قانون التحكيم", "verified": False, "practice_areas": [], "amendments": [], "consolidated": False},
    ]
    instruments = spark.createDataFrame([tuple(x.get(n) for n in store.INSTRUMENTS.names) for x in inst], store.INSTRUMENTS)
    articles = spark.createDataFrame([("law:36/2012", k, k, False, f"المادة ({k})", t) for k, t in CORPUS.items()] + [("law:9/2015", "1", "1", False, "المادة (1)", "نص التحكيم")], store.ARTICLES)
    return instruments, articles


def test_resolve(spark, corpus):
    refs = spark.createDataFrame([("law:36/2012", "99"), ("law:36/2012", None), ("law:36/2012", "500"), ("law:9/2015", "1"), ("law:1/1900", "1")], "instrument_id string, article_key string")
    got = {(r.instrument_id, r.article_key): (r.ok, r.reason) for r in citations.resolve(refs, *corpus).collect()}
    assert got == {("law:36/2012", "99"): (True, None), ("law:36/2012", None): (True, None), ("law:36/2012", "500"): (False, "article_missing"), ("law:9/2015", "1"): (False, "unverified"), ("law:1/1900", "1"): (False, "instrument_missing")}


@pytest.mark.parametrize(
    "given, want",
    [
        ("خلال 30 يوما", [(30.0, "يوم")]), ("ثلاثين يوماً", [(30.0, "يوم")]), ("خمسة وأربعين يوماً", [(45.0, "يوم")]), ("مائة وعشرين يوما", [(120.0, "يوم")]),
        ("سنتين", [(2.0, "سنه")]), ("خمسة آلاف دينار", [(5000.0, "دينار")]), ("نسبة 50%", [(50.0, "%")]), ("2.5 يوم", [(2.0, "يوم"), (5.0, "يوم")]), ("", []), (None, []),
        ("ثلاثة أو 5 أيام", [(3.0, "يوم"), (5.0, "يوم")]), ("عشرون شهرين", [(2.0, "شهر"), (20.0, "")]), ("ألف ومائة وعشرون دينارا", [(1120.0, "دينار")]), ("ثلاثة آلاف وخمسمائة دينار", [(500.0, "دينار"), (3000.0, "دينار")]),
        ("خمسة عشر و يوم", [(5.0, "يوم"), (10.0, "يوم")]), ("مائة و", [(100.0, "")]), ("ب12ج3", [(3.0, ""), (12.0, "")]),
    ],
)
def test_quantities(spark, given, want):
    assert [tuple(q) for q in one(spark, quantities.quantities("t"), t=given)] == want


@pytest.mark.parametrize(
    "claim, article, verdict, why",
    [
        ("كل فصل تعسفي يقع باطلاً ويستحق العامل تعويضاً عادلاً تقدره المحكمة", "111", "supported", None),
        ("يستحق العامل إجازة لا تقل عن خمسة وأربعين يوماً", "99", "conflicting", "quantity:45.0 يوم"),
        ("إجازة لا تقل عن ثلاثين يوماً", "99", None, None),
        ("يجوز لصاحب العمل إنهاء الخدمة", "5", "conflicting", "modality"),
        ("يحظر على صاحب العمل إنهاء الخدمة أثناء الإجازة", "99", "adjudicate", "frame:prohibition"),
        ("تسري أحكام هذا القانون على جميع العاملين", "2", "adjudicate", "exception"),
        ("تعويض قدره 5000 دينار", "99", "adjudicate", "overlap"),
    ],
)
def test_support(spark, claim, article, verdict, why):
    df = spark.createDataFrame([(1, claim, CORPUS[article])], "k long, claim string, article string")
    r = verify.support(df, None, ["k"]).first()
    assert verdict is None and not r.conflicts or r.verdict == verdict
    assert why is None or why in r.conflicts + r.doubts


def test_frames(spark):
    assert one(spark, verify.frames("t"), t="لا يجوز لصاحب العمل ذلك") == ["prohibition"]
    assert "nullity" in one(spark, verify.frames("t"), t=CORPUS["111"]) and one(spark, verify.frames("t"), t=CORPUS["2"]) == ["exception"]


NOTE = (
    "# مذكرة\n\n## ثالثًا: الأسانيد\nلما كان مفاد المادة (99) ⟦BH:law:36/2012:م99⟧ أن العامل يستحق إجازة "
    "سنوية لا تقل عن ثلاثين يوماً، وكانت المادة (111) ⟦BH:law:36/2012:م111⟧ تقضي ببطلان الفصل التعسفي، فإن الدعوى تقوم.\n"
)


def test_claims(spark):
    first, second = citations.with_claims(spark.createDataFrame([(1, NOTE)], "doc_id long, text string")).orderBy("pos").collect()
    assert "الأسانيد" not in first.claim and "ثلاثين" in first.claim and "بطلان" not in first.claim
    assert "بطلان" in second.claim and "ثلاثين" not in second.claim and "⟦" not in first.claim + second.claim


def test_gate(spark, corpus):
    drafts = {
        1: NOTE,
        2: "نص ⟦BH:law:99/2012:م1⟧ و⟦BH:خطأ⟧",
        3: "## الدفوع\nحجة بلا سند\n## خاتمة\nنص ⟦BH:law:36/2012:م99⟧ إجازة العامل السنوية بأجر أساسي ثلاثين يوماً",
        4: "يستحق العامل إجازة سنوية بأجر أساسي ⟦BH:law:36/2012:م99⟧ مدتها خمسة وأربعون يوماً",
        5: "لا شيء",
    }
    df = spark.createDataFrame(list(drafts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in verify.gate(df, *corpus, None, min_citations=1).collect()}
    assert got[1].passed and got[1].citations_resolved == got[1].citations_total == 2 and len(got[1].amendment_notes) == 1
    assert [p.problem.split()[0] for p in got[2].problems] == ["too", "instrument_missing", "malformed"] and got[2].exit_code == 1
    assert [p.problem for p in got[3].problems] == ["uncited section الدفوع"]
    assert got[4].citations_resolved == 0 and any("quantity:45.0" in p.problem for p in got[4].problems)
    assert [p.problem for p in got[5].problems] == ["too few citations"]
    contract = {r.doc_id: r for r in verify.gate(df, *corpus, None, contract=True).collect()}
    assert contract[3].passed and contract[5].exit_code == 0 and contract[1].exit_code in (0, 3)
    assert {r.doc_id for r in worddoc.releasable(df, verify.gate(df, *corpus, None), "doc_id").collect()} <= {1, 3, 5}


def test_threshold_and_notes(spark):
    assert verify.threshold("auto", 0.61) == (0.61, "calibrated") and verify.threshold("AUTO", None)[0] == 0.35
    assert verify.threshold("0.5", None) == (0.5, "fixed") and verify.threshold("x", 0.9) == (0.35, "default")
    assert one(spark, verify.amendment_warning(verify.parse_amendments("j"), F.lit(False)), j='[{"type":"law","number":31,"year":2014}]') == "law 31/2014"
    assert one(spark, verify.amendment_warning(verify.parse_amendments("j"), F.lit(True)), j='[{"type":"law"}]') is None
    assert one(spark, verify.amendment_warning(verify.parse_amendments("j"), F.lit(False)), j="broken") is None
    assert one(spark, verify.gazette_ref("a", "b"), a="3063", b="") == "الجريدة الرسمية عدد (3063)" and one(spark, verify.gazette_ref("a", "b"), a="", b="") is None
    assert one(spark, verify.provenance_gap("a", "b", "c"), a=" ", b="1", c="") == ["url", "gazette_date"]


# -- retrieval --------------------------------------------------------------------------------------------------------


def test_bm25_formula(spark, corpus):
    import math

    instruments, articles = corpus
    queries = spark.createDataFrame([(1, "الفصل التعسفي"), (2, "؟"), (3, "تحكيم")], "q long, t string")
    got = retrieval.search(articles, instruments, queries, "q", "t").collect()
    assert [(r.q, r.article_key, r["rank"]) for r in got] == [(1, "111", 1)]  # the unverified instrument is left out
    stems = [r.s for r in articles.select(text.stems(text.fold("text")).alias("s")).collect()]
    average = sum(map(len, stems)) / len(stems)
    want = 0.0
    for t in ("فصل", "تعسف"):
        n = sum(any(s.startswith(t) for s in d) for d in stems)
        d = next(d for d in stems if any(s.startswith("تعسف") for s in d))
        tf = sum(s.startswith(t) for s in d)
        want += math.log((len(stems) - n + 0.5) / (n + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / average))
    assert got[0].score == pytest.approx(want)
    areas = spark.createDataFrame([(1, "إجازة", ["labour"]), (2, "إجازة", ["tax"])], "q long, t string, a array<string>")
    assert {r.q for r in retrieval.search(articles, instruments, areas, "q", "t", areas="a").collect()} == {1}


def test_overlap(spark, corpus):
    idf = retrieval.term_idf(corpus[1])
    pairs = spark.createDataFrame([(1, "تعويض الفصل التعسفي", CORPUS["111"]), (2, "تعويض الفصل التعسفي", CORPUS["2"]), (3, "من في", CORPUS["2"])], "k long, claim string, article string")
    got = {r.k: r.overlap for r in retrieval.overlap(pairs, idf, ["k"]).collect()}
    assert got[1] > 0.6 and got[2] == 0 and got[3] == 0


def test_calibration(spark):
    import random

    rng = random.Random(7)
    topics = [[f"موضوع{t}كلمه{i}" for i in range(40)] for t in range(8)]
    rows = [(f"law:{n // 32}", str(n), " ".join(rng.choice(topics[n % 8]) if rng.random() < 0.6 else f"خاص{n}لفظ{rng.randrange(9)}" for _ in range(40))) for n in range(250)]
    articles = spark.createDataFrame(rows, "instrument_id string, article_key string, text string")
    r = verify.calibrate(articles, retrieval.term_idf(articles)).first()
    assert r.reliable and r.articles == 250 and r.samples == 600 and r.miss_rate <= 0.06 and 0.25 <= r.threshold <= 0.75
    assert verify.calibrate(articles, retrieval.term_idf(articles)).first() == r
    few = verify.calibrate(articles.limit(5), retrieval.term_idf(articles)).first()
    assert few.threshold == 0.25 and not few.reliable and few.miss_rate is None


# -- fields -----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "given, kind, want",
    [
        ("حرر في 14/03/2024", "date", ["2024-03-14"]), ("بتاريخ 2024-03-14", "date", ["2024-03-14"]), ("الموافق 14 مارس 2024", "date", ["2024-03-14"]), ("في ١٤/٠٣/٢٠٢٤", "date", ["2024-03-14"]),
        ("في 14/03/99", "date", ["1999-03-14"]), ("الأجر 620.500 دينارًا", "money", ["620.500 دينار"]), ("قيمة الدعوى 12,500 دينار", "money", ["12500 دينار"]), ("BHD 750", "money", ["750 bhd"]),
        ("مهلة ثلاثين يومًا", "duration", ["30 يوم"]), ("خلال شهرين", "duration", ["2 شهر"]), ("من 01/01/2020 إلى 01/01/2021 لمدة ثلاث سنوات", "duration", ["3 سنه"]),
        ("رقم 123456789 و1234567", "idnum", ["123456789"]), ("نسبة 12.5%", "percent", ["12.5"]),
    ],
)
def test_fields(spark, given, kind, want):
    df = spark.createDataFrame([(1, given), (2, None)], "k long, text string")
    assert [r.value for r in fields.critical_fields(df, ["k"]).collect() if r.kind == kind] == want


def test_field_places(spark):
    df = spark.createDataFrame([(1, "x\nفي ٠١/٠٢/٢٠٢٠ و 01/02/2020\n 01/02/2020  123456789")], "k long, text string")
    got = {(r.kind, r.raw, r.value, r.line, r.context) for r in fields.critical_fields(df, ["k"]).collect()}
    around = "x في ٠١/٠٢/٢٠٢٠ و 01/02/2020 01/02/2020 123456789"
    assert got == {("date", "01/02/2020", "2020-02-01", 2, around), ("date", "01/02/2020", "2020-02-01", 3, around), ("idnum", "123456789", "123456789", 3, around)}


@pytest.mark.parametrize(
    "given, code, there",
    [
        ("حرر في 31/02/2024", "impossible_date", True), ("في 12 رمضان 1445", "hijri_date", True), ("الأجر 620.50 دينارًا", "dinar_decimals", True), ("الأجر 620.500 دينارًا", "dinar_decimals", False),
        ("الأساسي 620 دينارًا والسكن 150 دينارًا والمجموع 800 دينار", "total_differs", True), ("الأساسي 620 دينارًا والسكن 150 دينارًا والمجموع 770 دينار", "total_differs", False),
        ("يستمر العقد من 01/01/2020 إلى 01/01/2021 لمدة ثلاث سنوات", "duration_differs", True), ("الموافق 14 مارس 2024\nينتهي في 14/04/2024\nمدة الخدمة خمس سنوات", "duration_differs", False),
        ("المبلغ 12٣45 دينار", "mixed_digits", True), ("الرقم الشخصي 879912345", "impossible_birth_date", True), ("الرقم الشخصي 870512345", "impossible_birth_date", False), ("خصم 150%", "over_100_percent", True),
    ],
)
def test_consistency(spark, given, code, there):
    df = spark.createDataFrame([(1, given), (2, None)], "k long, text string")
    assert any(x.code == code for x in fields.consistency(df, ["k"]).collect()) == there


def test_readers(spark):
    texts = [(1, "a", "الأجر 620 دينارًا والمهلة ثلاثون يومًا"), (1, "b", "الأجر 620 دينارًا والمهلة سبعة وثلاثون يومًا"), (2, "a", "5%")]
    df = spark.createDataFrame(texts, "doc_id long, reader string, text string")
    got = fields.disagreements(fields.critical_fields(df, ["doc_id", "reader"]), df, ["doc_id"]).collect()
    assert sorted((r.doc_id, r.kind, r.value, tuple(r.read_by), tuple(r.missed_by)) for r in got) == [(1, "duration", "30 يوم", ("a",), ("b",)), (1, "duration", "37 يوم", ("b",), ("a",))]


def test_sheets(spark):
    items = spark.createDataFrame([(1, 1, "620.500 دينارًا"), (1, 2, "14/03/2024"), (1, 3, "x"), (1, 4, "y")], "doc_id long, n int, raw string")
    sheet = worddoc.worksheets(items, "doc_id", "n", {"read": "raw"}, "original").first().sheet
    for answer in ("620.500دينارًا", "15/03/2024", "غير مقروء"):
        sheet = sheet.replace("- **original:** \n", f"- **original:** {answer}\n", 1)
    rows = worddoc.read_worksheets(spark.createDataFrame([(1, sheet)], "doc_id long, sheet string"), "doc_id", {"read": "raw"}, "original")
    got = fields.confirmations(rows, ["doc_id"]).first()
    assert (got.confirmed, got.corrected, got.unreadable, got.blank) == (1, 1, 1, 1)


# -- links and pages --------------------------------------------------------------------------------------------------


def test_links(spark):
    html = """<ul><li>قانون العمل رقم 36 لسنة 2012 <a href="/a.pdf#x">تحميل</a></li><li><a href="b?x=1">قانون التجارة رقم 7 لسنة 1987</a><li>
      <a href='mailto:x'>m</a><a href="http://other/c">out</a><a href="/a.pdf">again</a><a href="/i"><img alt="صورة"></a></ul>"""
    page = spark.createDataFrame([(1, "https://Host/dir/", html), (2, None, None)], "page_id long, url string, html string")
    rows = links.page_links(page)
    got = [(r.url, r.text) for r in rows.orderBy("position").collect()]
    assert got == [("https://Host/a.pdf", "تحميل"), ("https://Host/dir/b?x=1", "قانون التجارة رقم 7 لسنة 1987"), ("https://Host/i", "صورة")]
    registry = spark.createDataFrame([("labour", "law", "36", "2012", "قانون العمل"), ("trade", "law", "7", "1987", "قانون التجارة")], "key string, type string, number string, year string, title string")
    best = {r.key: r for r in links.match_registry(rows, registry).where("rank = 1").collect()}
    assert best["trade"].url.endswith("b?x=1") and best["trade"].strong and best["trade"].score == pytest.approx(0.9)
    assert best["labour"].url.endswith("a.pdf") and best["labour"].from_context and not best["labour"].strong and best["labour"].score == pytest.approx(0.765)
    hosts = spark.createDataFrame([("gov.bh",)], "host string")
    urls = spark.createDataFrame([("https://gov.bh/x",), ("https://GOV.BH:443",), ("https://gov.bh.evil.com/",), ("https://evil.com/gov.bh",), ("https://a@gov.bh/",), ("https://notgov.bh",), (None,)], "url string")
    assert sorted(r.url for r in links.allowed(urls, hosts).collect()) == ["https://GOV.BH:443", "https://a@gov.bh/", "https://gov.bh/x"]
    assert one(spark, links.hops_allowed(F.col("h"), ["gov.bh"]), h=["https://gov.bh/1", "https://evil.com"]) is False


# -- contracts and workflow -------------------------------------------------------------------------------------------


def test_contracts(spark, corpus):
    rules = spark.createDataFrame(
        [
            (None, "required", "parties", "p", "structural", ["الطرف الأول"], "w", None, None),
            ("work", "required", "wage", "w", "statutory", ["الأجر"], "w", "", ["أجر"]),
            ("work", "required", "leave", "l", "statutory", ["إجازة"], "w", "⟦BH:law:36/2012:م99⟧", []),
            ("work", "void", "waiver", "v", "structural", ["يتنازل العامل"], "w", None, None),
            ("sale", "required", "price", "x", "structural", ["الثمن"], "w", None, None),
            ("sale", "void", "bad", "b", "statutory", ["باطل"], "w", "⟦BH:law:36/2012:م500⟧", []),
        ],
        contracts.RULES,
    )
    based = contracts.bases(rules, *corpus)
    assert {(r.key): r.base_reason for r in based.where("basis = 'statutory'").collect()} == {"wage": "no_base", "leave": None, "bad": "article_missing"}
    docs = [(1, "work", "الطرف الاول ... الاجر ... اجازة"), (2, "work", "الطرف الأول يتنازل العامل <الاسم> [اختر: أ أو ب] <الاسم>"), (3, "other", "x"), (4, "sale", "الطرف الأول الثمن باطل")]
    got = {r.doc_id: r for r in contracts.clause_report(spark.createDataFrame(docs, "doc_id long, ctype string, text string"), based).collect()}
    assert got[1].passed and got[1].found == ["leave", "parties", "wage"]
    assert not got[2].passed and got[2].problems == ["leave", "waiver"] and got[2].manual == ["wage"] and got[2].placeholders == ["<الاسم>", "[اختر: أ أو ب]"]
    assert got[3].problems == ["parties"] and got[4].passed and got[4].manual == ["bad"]
    assert {r.state: r.rules for r in contracts.base_counts(based).collect()} == {"empty": 1, "filled": 1, "broken": 1}
    answers = spark.createDataFrame([("wage", "⟦BH:law:36/2012:م99⟧"), ("leave", "⟦BH:law:1/1900:م1⟧"), ("x", "")], "key string, sanad string")
    assert [r.key for r in contracts.accepted_bases(answers, *corpus).collect()] == ["wage"]
    assert contracts.statutory_items(rules).where("key = 'wage'").first().term == "أجر"
    assert {r.ctype: (r.required, r.void) for r in contracts.type_counts(rules).collect()}["work"] == (2, 1)


def test_workflow(spark):
    log = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "a"), (2, 1, "a"), (2, 2, "c")], "case long, at long, stage string")
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "d"), ("e", "a")], "from_stage string, to_stage string")
    bad = workflow.violations(workflow.transitions(log, "case", ["at"], "stage"), edges).collect()
    assert [(r.case, r.from_stage, r.to_stage) for r in bad] == [(2, "a", "c")]
    assert {(r.stage, r.steps) for r in workflow.reachable(edges, "a").collect()} == {("a", 0), ("b", 1), ("d", 2)}
    stages = spark.createDataFrame([("a", "work", [], None), ("b", "review", ["a", "z"], "r"), ("d", "work", [], None), ("e", "review", [], None)], "key string, kind string, exits array<string>, reviewed_by string")
    assert {tuple(r) for r in workflow.pipeline_faults(stages, edges, "a").collect()} == {("e", "unreachable"), ("b", "exit_not_allowed"), ("e", "incomplete_review")}
    use = workflow.usage(spark.createDataFrame([("x", 900, 100, 500, 3), ("x", 100, 900, 500, 4)], "agent string, input long, cached long, output long, cents long"), "agent").first()
    assert (use.total, use.shown, use.cache_ratio, use.cents) == (3000, "3.0K", 0.5, 7)


# -- store and files --------------------------------------------------------------------------------------------------


def test_store(spark, tmp_path, corpus):
    instruments, articles = corpus
    old = spark.createDataFrame([("law:1/2000", "k")], "id string, key string")
    up = store.upgrade(old)
    assert up.schema.names == store.INSTRUMENTS.names and up.first().amendments == [] and up.first().verified is False and store.upgrade(up).collect() == up.collect()
    new = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 1, 3)], "k string, v int, n int")
    got = store.upsert(spark.createDataFrame([("a", 0, 0), ("c", 9, 0)], "k string, v int, n int"), new, ["k"], [F.desc("n")])
    assert {(r.k, r.v) for r in got.collect()} == {("a", 2), ("b", 1), ("c", 9)}
    path = str(tmp_path / "articles")
    store.replace_articles(articles, path)
    store.replace_articles(articles.where("instrument_id = 'law:9/2015'").withColumn("text", F.lit("new")), path)
    back = store.read_articles(spark, path)
    assert back.count() == articles.count() and back.where("text = 'new'").count() == 1
    assert store.orphans(articles, instruments).count() == 0
    s = store.stats(instruments, articles).first()
    assert (s.instruments, s.verified, s.articles, s.unconsolidated) == (2, 1, 5, 1)
    assert {r.id: r.articles for r in store.article_counts(instruments, articles).collect()} == {"law:36/2012": 4, "law:9/2015": 1}
    assert [r.article_key for r in store.export(instruments, articles).collect()] == ["2", "5", "99", "111", "1"]
    assert [r.key for r in store.missing(spark.createDataFrame([("labour",), ("tax",)], "key string"), instruments).collect()] == ["tax"]


def test_import(spark):
    body = STATUTE + "\n" + "كلمة " * 60
    rows = [
        ("ok", "law", "36", "2012", "قانون العمل", "", body, "u", "1", "2012-01-01"),
        ("gap", "law", "36", "2012", "قانون العمل", "", body, "u", "", None),
        ("wrong", "law", "37", "2012", "قانون العمل", "", body, "u", "1", "2012-01-01"),
        ("title", "law", "36", "2012", "قانون آخر تماما", "", body, "u", "1", "2012-01-01"),
        ("short", "law", "36", "2012", "قانون العمل", "", "نص", "u", "1", "2012-01-01"),
        ("none", "law", "36", "2012", "قانون العمل", "", "كلمة " * 60, "u", "1", "2012-01-01"),
    ]
    df = spark.createDataFrame(rows, "key string, type string, number string, year string, title string, hint string, text string, url string, gazette_issue string, gazette_date string")
    for key, status, verified in (("ok", "ok", True), ("gap", "ok", False), ("wrong", "identity", False), ("title", "title", False), ("short", "short_text", True), ("none", "no_articles", False)):
        decided, articles = store.import_decisions(df.where(F.col("key") == key).withColumn("text", text.normalize("text")), verify.provenance_gap("url", "gazette_issue", "gazette_date"))
        r = decided.first()
        assert r.status == status and (key in ("short", "none") or r.verified == verified), key
        assert (articles.count() > 0) == (status == "ok")
    staged = spark.createDataFrame([("a", "x.txt"), ("a", "x.html")], "key string, path string")
    reg = spark.createDataFrame([("a", None), ("b", "http://x"), ("c", " ")], "key string, url string")
    assert {r.key: (r.action, r.path) for r in store.actions(reg, staged).collect()} == {"a": ("staged", "x.html"), "b": ("fetch", None), "c": ("manual", None)}


def archive(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


W = "<w:document><w:body>{}</w:body></w:document>"
FILES = {
    "a.docx": (archive({"word/document.xml": W.format("<w:p><w:t>نص أول &amp; آخر</w:t></w:p><w:p><w:t>ثان</w:t></w:p>"), "word/footnotes.xml": "<w:p>حاشية</w:p>"}), "docx", None, "نص أول & آخر\nثان\n\n[الحواشي]\nحاشية"),
    "b.odt": (archive({"content.xml": "<text:h>عنوان</text:h><text:p>متن</text:p>"}), "odt", None, "عنوان\nمتن"),
    "c.rtf": (rb"{\rtf1{\fonttbl{\f0 Arial;}}" + bytes([92]) + b"u1606?" + bytes([92]) + b"u1589?" + rb"\par x}", "rtf", None, None),
    "d.html": ("<!doctype html><head><title>T</title></head><body><nav>n</nav><p>فقرة<p>أخرى".encode(), "html", None, "فقرة\nأخرى"),
    "e.txt": ("نص عربي بسيط".encode("windows-1256"), "text", None, "نص عربي بسيط"),
    "f.txt": (b"%PDF-1.4 x", "pdf", "no_backend:pdftotext", ""),
    "g.docx": (archive({"word/document.xml": '<!DOCTYPE x [<!ENTITY a "b">]><w:p>x</w:p>'}), "docx", "xml_definitions", ""),
    "h.docx": (archive({"word/document.xml": "0" * 3_000_000}), "docx", "compression_ratio", ""),
    "i.docx": (archive({"word/document.xml": W, "../evil": "x"}), "docx", "dangerous_path", ""),
    "j.zip": (archive({f"{i}": "" for i in range(3)}), "zip", "archive", ""),
    "k.docx": (archive({"word/document.xml": W} | {f"m{i}": "" for i in range(3_001)}), "docx", "too_many_members", ""),
    "l.bin": (bytes(range(256)) * 20, "unknown", "unknown_format", ""),
    "m.txt": (b"", None, "empty", ""),
    "n.doc": (b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1xx", "ole", "old_office", ""),
}


def test_files(spark):
    if documents.backends()["pdftotext"]:
        pytest.skip("a PDF backend is installed")
    df = spark.createDataFrame([(k, bytearray(v[0])) for k, v in FILES.items()], "path string, content binary")
    got = {r.path: r for r in documents.extract(df).collect()}
    for path, (_, fmt, error, said) in FILES.items():
        assert (got[path].fmt, got[path].error) == (fmt, error), path
        assert said is None or got[path].text == said, path
    assert "نص" in got["c.rtf"].text and "Arial" not in got["c.rtf"].text
    assert "suffix_differs" in got["f.txt"].warnings and "suffix_differs" not in got["a.docx"].warnings
    assert not got["m.txt"].ok and got["d.html"].sha256 == __import__("hashlib").sha256(FILES["d.html"][0]).hexdigest()


@pytest.mark.parametrize(
    "given, warning",
    [("ن ص م ق ط ع ة ح ر و ف " * 10, "split_letters"), ("ﺍﻟﻌﻤﻞ " * 20, "presentation_forms"), ("قصير", "short"), ("", "empty"), ("latin text only " * 9, "few_arabic_letters"), ("نص ���� عربي كامل طويل بما يكفي", "replacement_characters")],
)
def test_assess(spark, given, warning):
    confidence, warnings = documents.assess("t", F.lit("text"))
    assert warning in one(spark, warnings, t=given) and one(spark, confidence, t=given) < 1
    assert one(spark, confidence, t="نص عربي سليم وطويل بما يكفي لأن يقبل") == 1.0


def test_word(spark):
    md = "# عنوان\n\nسطر أول\nسطر ثان **غليظ**\n\n1. بند\n- نقطة\n> اقتباس\n---\n| أ | ب |\n|---|:--|\n| ج | |\n#### h4\n##### p5"
    blocks = one(spark, worddoc.markdown_blocks("t"), t=md)
    assert [(b.kind, b.text) for b in blocks] == [
        ("h1", "عنوان"), ("p", "سطر أول سطر ثان **غليظ**"), ("num", "1. بند"), ("bul", "نقطة"), ("quote", "اقتباس"), ("rule", ""), ("row", "أ — ب"), ("row", "ج"), ("h4", "h4"), ("p", "##### p5"),
    ]
    raw = worddoc.word_documents(spark.createDataFrame([(1, md, "T & t")], "doc_id long, text string, title string"), "doc_id", notice="مسودة").first().docx
    fmt, said = documents._told(spark.createDataFrame([("x", bytearray(raw))], "path string, content binary")).first().fmt, documents.office_text(bytes(raw), *documents.DOCX_BREAKS)
    assert fmt == "docx" and "سطر أول سطر ثان غليظ" in said and "مسودة" in said and "• نقطة" in said
    import xml.dom.minidom

    with zipfile.ZipFile(io.BytesIO(bytes(raw))) as z:
        for name in z.namelist():
            xml.dom.minidom.parseString(z.read(name))


def test_stream(spark, tmp_path):
    import json

    from verisift.streaming import ingest

    (tmp_path / "staged").mkdir()
    body = STATUTE.replace("٣", "3") + "\n" + "كلمة " * 60
    row = {"key": "a", "type": "law", "number": "36", "year": "2012", "title": "قانون العمل", "hint": "", "text": body, "url": "u", "gazette_issue": "1", "gazette_date": str(datetime.date(2012, 1, 1))}
    (tmp_path / "staged" / "1.json").write_text(json.dumps(row) + "\n", encoding="utf-8")
    where = [f"{tmp_path}/{n}" for n in ("staged", "articles", "decisions", "checkpoint")]
    ingest.follow(spark, *where).awaitTermination()
    assert store.read_articles(spark, where[1]).count() == 6
    row |= {"text": body.replace("المادة (8)\nآخر", "")}
    (tmp_path / "staged" / "2.json").write_text(json.dumps(row) + "\n", encoding="utf-8")
    ingest.follow(spark, *where).awaitTermination()
    keys = {r.article_key for r in store.read_articles(spark, where[1]).collect()}
    assert "7" in keys and "8" not in keys and spark.read.parquet(where[2]).count() == 2


def test_proposals_and_answers(spark, corpus):
    rules = spark.createDataFrame([("c", "required", "leave", "إجازة العامل", "statutory", ["x"], "why", "", ["إجازة سنوية", "الفصل"]), ("c", "void", "none", "كلمةغريبة", "statutory", ["x"], "", None, []), ("c", "required", "set", "x", "statutory", ["x"], "", "⟦BH:law:36/2012:م99⟧", [])], contracts.RULES)
    got = contracts.proposals(rules, corpus[1], corpus[0]).collect()
    assert {r.key for r in got} == {"leave", "none"} and [r.article_key for r in got if r.key == "none"] == [None]
    assert [r.place for r in sorted((r for r in got if r.key == "leave"), key=lambda r: r.place)][0] == 1
    sheet = "# x\n## c/leave\n**البند:** y\n- `z`\n**المعتمد:** `⟦BH:law:36/2012:م99⟧` \n---\n## c/none\n**المعتمد:** \n## c/set\n**المعتمد:** ⟦BH:law:1/1900:م1⟧\n"
    answers = contracts.sheet_answers(spark.createDataFrame([(sheet,)], "text string"))
    assert {(r.ctype, r.key, r.sanad) for r in answers.collect()} == {("c", "leave", "⟦BH:law:36/2012:م99⟧"), ("c", "set", "⟦BH:law:1/1900:م1⟧")}
    new = contracts.with_accepted(rules, answers, *corpus)
    assert {r.key: r.sanad for r in new.collect()} == {"leave": "⟦BH:law:36/2012:م99⟧", "none": None, "set": "⟦BH:law:36/2012:م99⟧"}


def test_frontmatter(spark):
    say = lambda t: one(spark, workflow.frontmatter("t"), t=t)
    got = say("---\nname: 'a: b'\ntitle: x\ntitle: y\n# no: c\n---\nbody --- x")
    assert (got.fields, got.body, got.fault) == ({"name": "a: b", "title": "y"}, "\nbody --- x", None)
    assert say("---\ndescription: >-\n  x\n---\n").fault == "block_scalar:description" and say("x").fault == "no_frontmatter" and say("x").fields is None


def test_store_extras(spark, tmp_path, corpus):
    reg = spark.createDataFrame([("a",), ("b",)], "key string")
    assert [r.key for r in store.only(reg, ["b", "x"]).collect()] == ["b"]
    with pytest.raises(ValueError):
        store.only(reg, ["x"])
    assert one(spark, store.is_date("t"), t="2024-01-31") and not one(spark, store.is_date("t"), t="2024-1-31\n") and not one(spark, store.is_date("t"), t=None)
    store.write_export(*corpus, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == store.export(*corpus).count()
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "x.bin").write_bytes(b"%PDF-1")
    row = store.manifest(documents.read_files(spark, str(tmp_path / "f"))).first()
    assert (row.fmt, row.bytes, len(row.sha256)) == ("pdf", 6, 64)
    df = spark.createDataFrame([(1, "5% و 6%"), (1, "12/12/2020")], "doc_id long, text string")
    assert {(r.kind, r.n) for r in fields.kind_counts(fields.critical_fields(df, ["doc_id"]), ["doc_id"]).collect()} == {("percent", 2), ("date", 1)}


def test_composed_forms_fold_alike(spark):
    assert one(spark, text.fold(text.composed("t")), t="cafe\u0301 e\u0301x") == "café éx" == one(spark, text.fold(text.composed("t")), t="café éx")
    df = spark.createDataFrame([(1, "cafe\u0301")], "k long, text string")
    assert [r.term for r in retrieval.postings(df, ["k"]).collect()] == ["café"]


def test_lexicon():
    words = lexicon.ordinals()
    assert words["الأولى"] == words["الاول"] == 1 and words["الثانية عشرة"] == 12 and words["الحادي عشر"] == 11 and words["العشرين"] == 20


def test_web_and_readings(spark):
    staged = [("a.HTML", "<p>é</p><title>T</title>".encode()), ("b.txt", "نص".encode("windows-1256")), ("c.txt", b"x<HTML><body><nav>n</nav><p>y"), ("d.pdf", b"%PDF-"), ("e", b"x")]
    df = spark.createDataFrame([(p, bytearray(c)) for p, c in staged], "path string, content binary")
    assert {r.path: (r.text, r.title) for r in documents.web_text(df).collect()} == {"a.HTML": ("é", "T"), "b.txt": ("نص", ""), "c.txt": ("x\ny", "")}
    assert [r.x for r in df.select(documents.unsupported_reason("path").alias("x")).collect()] == [None, None, None, "suffix:pdf", "no_suffix"]
    assert {(r.path, r.reader) for r in documents.readings(df.where("path <> 'd.pdf'")).collect()} == {("a.HTML", "only"), ("b.txt", "only"), ("c.txt", "only"), ("e", "only")}
