"""Ranking by BM25: what is shuffled, bounds of memory, rows that share their keys, and folding of Latin texts."""

import random

import pytest
from pyspark.sql import functions as F

from verisift.functions import lexicon, text
from verisift.operators import retrieval
from verisift.plans import catalogue


@pytest.fixture(scope="module")
def words():
    rng = random.Random(3)
    return lambda n: " ".join("".join(rng.choice("abcd") for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def lines(spark, words):
    rows = [(f"i{n // 4 % 150}", f"{n // 600}.{n % 4}", words(20) if n % 3 else "ab abc abcd") for n in range(1200)]
    articles = spark.createDataFrame(rows, "instrument_id string, article_key string, text string").repartition(4).cache()
    instruments = spark.createDataFrame([(f"i{n}", n % 3 > 0, [["x"], ["y"], []][n % 3 - 1]) for n in range(150)], "id string, verified boolean, practice_areas array<string>")
    queries = spark.createDataFrame([(n, words(8), ["x"] if n % 2 else None) for n in range(12)], "q long, t string, a array<string>")
    return articles, instruments, queries


def shuffled(spark, run):
    """Rows that stages have written for a shuffle while run() ran."""
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm

    def all_():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        none = jvm.java.util.ArrayList()
        stages = store.stageList(none, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), none)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = all_()
    run()
    return all_() - before


def test_hits_are_not_shuffled(spark, lines):
    """Before, each term of each article and each score was: over 100,000 rows here."""
    articles, instruments, queries = lines
    assert shuffled(spark, lambda: retrieval.search(articles, instruments, queries, "q", "t", limit=2).collect()) < 10_000


def found(df):
    return sorted((r.q, r["rank"], r.instrument_id, r.article_key, round(r.score, 8)) for r in df.collect())


@pytest.mark.parametrize("how", [{}, {"filter_first": True}, {"areas": "a"}, {"areas": "a", "filter_first": True}])
def test_bounds_of_memory_and_postings_change_nothing(lines, monkeypatch, how):
    articles, instruments, queries = lines
    want = found(retrieval.search(articles, instruments, queries, "q", "t", limit=3, **how))
    assert len(want) == 36
    kept = retrieval.postings(articles, ["instrument_id", "article_key"])
    assert found(retrieval.search(articles, instruments, queries, "q", "t", limit=3, index=kept, **how)) == want
    for name, value in (("STRETCH", 200), ("SUMS", 7), ("HELD_BACK", 5), ("WORDS", 3), ("BROADCAST_ROWS", 50)):
        monkeypatch.setattr(retrieval, name, value)
    assert found(retrieval.search(articles, instruments, queries, "q", "t", limit=3, **how)) == want


def test_repeated_ids_and_empty_texts_as_in_sql(spark, words, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    docs = [(n % 40, f"{words(9)}\n\n{words(5 + n % 2)}" if n % 7 else [None, ""][n % 2], ["en", "de"][n % 3 % 2]) for n in range(90)]
    tables = {
        "documents": spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("source", F.lit("s")),
        "labels": spark.createDataFrame([(n, n % 2) for n in range(40)], "doc_id long, quality int"),
        "benchmark": spark.createDataFrame([(n // 2, words(6)) for n in range(8)] + [(9, None), (10, ".")], "item_id long, text string"),
    }
    for name, df in tables.items():
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        duckdb.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    for query in ("bm25_top_k", "bm25_by_area"):
        want = duckdb.sql(f"SELECT item_id, instrument_id, article_key, score FROM ({catalogue.ORACLE_SQL[query]})").fetchall()
        got = [tuple(r) for r in catalogue.QUERIES[query](spark, str(tmp_path)).select("item_id", "instrument_id", "article_key", "score").collect()]
        assert sorted(got) == sorted(want) and len(want) > 10


def test_latin_texts_fold_as_all_others(spark):
    rng = random.Random(5)
    signs = [chr(n) for n in range(0x300)] + list(" \n\t_-") * 30
    rows = [("".join(rng.choice(signs) for _ in range(60)) + rng.choice(["", "", "ة٣", "é‏"]),) for _ in range(400)] + [("",), (None,), ("İI",)]
    full = F.translate(F.lower(text.normalize("t", False)), *lexicon.LETTER_FORMS)
    full = F.trim(F.regexp_replace(full, r"[^\p{L}\p{N}_]+", " "))
    df = spark.createDataFrame(rows, "t string")
    assert df.where(~full.eqNullSafe(text.fold("t")) | ~text.composed("t").eqNullSafe(F.coalesce(text._nfc("t"), "t"))).count() == 0
