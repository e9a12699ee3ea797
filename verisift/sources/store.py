"""The corpus store: tables of instruments and articles, upserts, schema upgrades, statistics and export."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DateType, DoubleType, IntegerType, StringType, StructField, StructType, TimestampType

from ..functions.tables import small
from ..functions.text import article_key, article_label, fold, similarity
from ..operators.segment import enactments, identity_matches, segment_articles
from .documents import sniffed

_S, _B = StringType(), BooleanType()
_AMENDMENT = StructType([StructField(n, _S) for n in ("type", "number", "year")])


def _schema(**types) -> StructType:
    return StructType([StructField(n, t) for n, t in types.items()])


INSTRUMENTS = _schema(
    id=_S, key=_S, type=_S, number=_S, year=_S, title=_S, source_url=_S, source_domain=_S, retrieved_at=TimestampType(), sha256=_S, verified=_B, title_match=DoubleType(),
    gazette_issue=_S, gazette_date=DateType(), amendments=ArrayType(_AMENDMENT), consolidated=_B, source_tier=_S, practice_areas=ArrayType(_S),
)
ARTICLES = _schema(instrument_id=_S, article_key=_S, number=_S, bis=_B, label=_S, text=_S)
#: As they are stored: see replace_articles.
STORED = _schema(**{f.name: f.dataType for f in ARTICLES}, bucket=IntegerType())
BUCKETS = 64
#: What columns that an older store lacks are filled with; others are null.
DEFAULTS = {"amendments": "array()", "practice_areas": "array()", "consolidated": "false", "verified": "false"}
#: A text shorter than this, or without an article, is rejected.
LEAST_TEXT = 200
#: The title is looked for in so many characters of the text.
TITLE_CHARS = 4_000


def upgrade(df: DataFrame, schema: StructType = INSTRUMENTS) -> DataFrame:
    """df with the columns of the schema, in its order and types; missing ones get their defaults. Doing it twice
    changes nothing."""
    old = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in old else F.expr(DEFAULTS.get(f.name, "null"))).cast(f.dataType).alias(f.name) for f in schema])


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list | None = None) -> DataFrame:
    """old without the keys of new, and new; of several new rows of a key the last in order stays."""
    if order:
        last = Window.partitionBy(*keys).orderBy(*order)
        new = new.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")
    return old.join(new.select(*keys).distinct(), keys, "left_anti").select(*new.columns).unionByName(new)


def replace_articles(new: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Replaces the articles of the instruments in new, and of these only. The store is a folder for each bucket of a
    hash of the instrument; buckets with one of these instruments are written anew, with what else they hold."""
    bucket = F.pmod(F.xxhash64("instrument_id"), F.lit(buckets)).cast("int").alias("bucket")
    new = new.select(*ARTICLES.names, bucket)
    try:
        old = new.sparkSession.read.schema(STORED).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        old = None
    if old is not None:
        touched, ids = new.select("bucket").distinct(), new.select("instrument_id").distinct()
        new = old.join(touched, "bucket", "left_semi").join(small(ids), "instrument_id", "left_anti").select(*new.columns).unionByName(new)
    new.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STORED).parquet(path).select(*ARTICLES.names)


def orphans(articles: DataFrame, instruments: DataFrame) -> DataFrame:
    """Articles whose instrument is not there."""
    return articles.join(instruments.select(F.col("id").alias("instrument_id")), "instrument_id", "left_anti")


def stats(instruments: DataFrame, articles: DataFrame) -> DataFrame:
    """One row: instruments, verified, articles, oldest (retrieval of a verified one), unconsolidated."""
    i = instruments.agg(
        F.count("*").alias("instruments"), F.count_if("verified").alias("verified"),
        F.min(F.when(F.col("verified"), F.col("retrieved_at"))).alias("oldest"),
        F.count_if((F.size("amendments") > 0) & ~F.coalesce("consolidated", F.lit(False))).alias("unconsolidated"),
    )
    return i.crossJoin(articles.agg(F.count("*").alias("articles")))  # one row each


def article_counts(instruments: DataFrame, articles: DataFrame) -> DataFrame:
    counts = articles.groupBy("instrument_id").agg(F.count("article_key").alias("articles"))
    rows = instruments.join(counts, F.col("id") == F.col("instrument_id"), "left")
    return rows.select("id", "title", "verified", F.coalesce("articles", F.lit(0)).alias("articles"))


def missing(registry: DataFrame, instruments: DataFrame) -> DataFrame:
    """Registered keys that have not been imported."""
    return registry.select("key").distinct().join(instruments.select("key"), "key", "left_anti")


def export(instruments: DataFrame, articles: DataFrame) -> DataFrame:
    """Articles with their instruments, sorted as they are exported: by instrument and number; write it as JSON lines."""
    rows = articles.join(instruments.select(F.col("id").alias("instrument_id"), "title", "source_url", "verified"), "instrument_id")
    return rows.orderBy("instrument_id", F.expr("try_cast(number AS int)"), "article_key")


def write_export(instruments: DataFrame, articles: DataFrame, path: str) -> None:
    """The export as JSON lines, in its order: files are named by their place in it."""
    export(instruments, articles).write.mode("errorifexists").json(path, ignoreNullFields=False)


def only(registry: DataFrame, keys: list[str]) -> DataFrame:
    """The registered instruments with one of the keys; an error if there is none."""
    rows = registry.where(F.col("key").isin(*keys))
    if rows.isEmpty():
        raise ValueError(f"no instrument has one of the keys {' '.join(keys)}")
    return rows


def is_date(c):
    """Whether a text has the form yyyy-mm-dd."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")).rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z")


def manifest(staged: DataFrame, fetched: DataFrame | None = None) -> DataFrame:
    """A record for each staged file (path, content, modificationTime, as of the binaryFile source): path, fmt, bytes,
    sha256, staged_at; with fetched (path, url, final_url, hops, status) also where it came from. upsert() merges it
    into an older manifest by path."""
    rows = staged.select("path", sniffed("content").alias("fmt"), F.octet_length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.col("modificationTime").alias("staged_at"))
    return rows if fetched is None else rows.join(fetched.select("path", "url", "final_url", "hops", "status"), "path", "left")


def title_match(title, hint, text):
    """Largest similarity of the title with a line of the hint or of the start of the text; 1 if the title is in them."""
    start = F.concat_ws("\n", hint, F.left(text, F.lit(TITLE_CHARS)))
    lines = F.filter(F.split(start, "\n"), lambda x: F.trim(x) != "")
    best = F.array_max(F.transform(lines, lambda x: similarity(fold(title), fold(x))))
    return F.when((fold(title) != "") & fold(start).contains(fold(title)), 1.0).otherwise(F.coalesce(best, F.lit(0.0)))


def import_decisions(staged: DataFrame, gaps, threshold: float = 0.6, strict: bool = True, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """Instruments to import with their status, and their articles.

    staged: key, type, number, year, title, hint, text (normalised) and what else the store takes. status is ok or
    why it is rejected: short_text, no_articles, identity, title. Only what has the right title, does not state
    another identity and (if strict) lacks nothing of its provenance is verified; force imports title and identity
    faults, unverified. gaps: a column with the list of what the provenance lacks.
    """
    rows = staged.withColumn("id", F.concat("type", F.lit(":"), "number", F.lit("/"), "year")).withColumn("gap", gaps)
    rows = rows.withColumn("title_match", title_match(F.col("title"), F.col("hint"), F.col("text"))).withColumn("identity", identity_matches(enactments("text"), "type", "number", "year"))
    articles = segment_articles(rows.withColumnRenamed("id", "instrument_id"))
    n = articles.groupBy(F.col("instrument_id").alias("id")).agg(F.count("*").alias("n_articles"))
    rows = rows.join(n, "id", "left").withColumn("n_articles", F.coalesce("n_articles", F.lit(0)))
    title_ok, denied = F.col("title_match") >= threshold, F.coalesce(~F.col("identity"), F.lit(False))
    status = F.when(F.length(F.coalesce("text", F.lit(""))) < LEAST_TEXT, "short_text").when(F.col("n_articles") == 0, "no_articles")
    if not force:
        status = status.when(denied, "identity").when(~title_ok, "title")
    complete = (F.size("gap") == 0) if strict else F.lit(True)
    rows = rows.withColumn("status", status.otherwise("ok")).withColumn("verified", title_ok & ~denied & complete)
    return rows, articles.join(rows.where("status = 'ok'").select(F.col("id").alias("instrument_id")), "instrument_id", "left_semi").select(*ARTICLES.names)


def tallies(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("status").agg(F.count("*").alias("instruments"))


def actions(registry: DataFrame, staged: DataFrame) -> DataFrame:
    """What to do for each registered key: staged, fetch (it has a URL) or manual. staged: key, path; the best suffix
    of several files of a key is taken."""
    rank = F.coalesce(*[F.when(F.lower("path").endswith(s), i) for i, s in enumerate((".html", ".htm", ".txt", ".docx", ".odt", ".rtf", ".pdf"))], F.lit(99))
    best = staged.groupBy("key").agg(F.min_by("path", F.struct(rank, "path")).alias("path"))
    rows = registry.join(best, "key", "left")
    return rows.withColumn("action", F.when(F.col("path").isNotNull(), "staged").when(F.trim(F.coalesce("url", F.lit(""))) != "", "fetch").otherwise("manual"))


def articles_of_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Each line of a document as an article, numbered from 1, with its place."""
    lines = docs.select(F.col(id_col).cast("string").alias("instrument_id"), F.posexplode(F.split(text, "\n")).alias("n", "text"))
    number = (F.col("n") + 1).cast("string")
    bis = F.lit(False)
    return lines.select("instrument_id", article_key(number, bis).alias("article_key"), number.alias("number"), bis.alias("bis"), article_label(number, bis).alias("label"), "text")
