"""Benchmark decontamination by SimHash windows and multi-index Hamming blocks. Native: DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import row_id, save, small_enough, table

SHINGLE_WORDS = 5
SIMILARITY = 0.8
#: Largest number of differing bits of 64 between a window's fingerprint and an item's.
RADIUS = 18
#: Up to so many shingles of an item, bits are counted in fields of 16 bits; beyond, each in a number of its own.
MAX_SHINGLES = (1 << 16) - 1
#: Up to so many item shingles or fingerprint blocks are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _shingles(words: Column, size: Column, k: Column) -> Column:
    """All runs of k words, repeats included."""
    return F.transform(F.sequence(F.lit(1), size - k + 1), lambda i: F.concat_ws(" ", F.slice(words, i, k)))


def _with_fingerprint(df: DataFrame, hashes: str, out: str, wide: bool = False) -> DataFrame:
    """Adds the SimHash of 64 bits of a column of hashes: a bit is 1 if set in over half of them.

    Of up to MAX_SHINGLES hashes, every 16th bit is counted at once, in four fields of 16 bits of a long; if wide,
    each bit is counted alone, for any number.
    """
    step, ones_of = (64, 1) if wide else (16, 0x0001000100010001)

    def counted(j: int):
        return lambda acc, h: acc + F.shiftrightunsigned(h, j).bitwiseAND(F.lit(ones_of).cast("long"))

    sums = {f"__sums{j}": F.aggregate(hashes, F.lit(0).cast("long"), counted(j)) for j in range(step)}
    fp = F.lit(0).cast("long")
    for b in range(64):
        ones = F.col(f"__sums{b}") if wide else F.shiftrightunsigned(f"__sums{b % 16}", b // 16 * 16).bitwiseAND(0xFFFF)
        bit = F.lit(1 << b if b < 63 else -(1 << 63)).cast("long")
        fp = fp.bitwiseOR(F.when(ones * 2 > F.size(hashes), bit).otherwise(F.lit(0).cast("long")))
    return df.withColumns(sums).withColumn(out, fp).drop(*sums)


def _hashes(shingles: str) -> Column:
    return F.transform(shingles, lambda s: F.xxhash64(s))


def _block_masks(radius: int) -> list[int]:
    """radius + 1 blocks of adjoining bits: two fingerprints within the radius agree on one of them."""
    n = radius + 1
    edges = [64 * i // n for i in range(n + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def _shared_weight(a: Column, b: Column) -> Column:
    """Sum over shingles of the smaller of its two numbers of occurrences."""
    one = lambda s: F.least(F.size(F.filter(a, lambda x: x == s)), F.size(F.filter(b, lambda x: x == s)))
    return F.aggregate(F.array_intersect(a, b), F.lit(0), lambda acc, s: acc + one(s))


def leaks(docs: DataFrame, items: DataFrame, doc_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """Documents that hold a benchmark item: doc_id, item_id, word_start, n_words, similarity of the best window.

    A window has as many words as the item. Windows are placed where a document's shingle is one of an item's (a
    window without a common shingle has similarity 0, so none is lost) and clamped to the document. Window and item
    fingerprints of equal window size meet in an equi-join on radius + 1 blocks of bits, which yields every pair
    within the radius, each once. Then the similarity is computed on the shingles themselves, weighted by their
    numbers of occurrences (sum of the smaller over sum of the larger numbers); it must reach the threshold.
    Items of fewer than shingle_words words are one shingle.

    Null or empty texts and items without a word match nothing. Repeated document rows are judged one by one, a
    repeated (item, text) counts once; null ids are returned as null. Of equally similar windows the first is
    reported. Texts are read whole, other columns are ignored, and an empty table on either side gives no row.
    """
    k = F.lit(shingle_words)
    i = items.select(F.col(item_col).alias("item_id"), words_of(F.col(text_col)).alias("iw")).distinct()
    i = i.withColumn("n", F.size("iw")).where("n > 0").withColumn("k", F.least(k, F.col("n")))
    i = i.withColumn("ish", _shingles(F.col("iw"), F.col("n"), F.col("k"))).select("item_id", "n", "k", "ish")

    by_size = i.groupBy("k").agg(F.max("n")).collect()  # at most shingle_words rows
    wide = any(n > MAX_SHINGLES for _, n in by_size)
    sizes = sorted(k for k, _ in by_size)
    words = docs.select(row_id().alias("rid"), F.col(doc_col).alias("doc_id"), words_of(F.col(text_col)).alias("w")).withColumn("size", F.size("w"))
    windows, kept = None, None
    for s in sizes:
        seeds = i.where(F.col("k") == s).select("n", F.posexplode("ish").alias("o", "s"))
        pieces = F.split("s", " ")
        seeds = seeds.select(F.xxhash64(*[F.get(pieces, F.lit(j)) for j in range(s)]).alias("h"), "n", "o").distinct()
        few = small_enough(seeds, BROADCAST_ROWS)
        if not few and kept is None:  # positions are shuffled without the words, which join them afterwards
            kept = words = save(words, "words")
        at = words.where(F.col("size") >= s).select("rid", "doc_id", "w", "size", F.explode(F.sequence(F.lit(0), F.col("size") - s)).alias("p"))
        at = at.withColumn("h", F.xxhash64(*[F.get("w", F.col("p") + j) for j in range(s)]))
        hit = at.join(F.broadcast(seeds), "h") if few else at.select("rid", "p", "h").join(seeds, "h").join(words, "rid")
        start = F.greatest(F.lit(0), F.least(F.col("p") - F.col("o"), F.col("size") - F.col("n")))
        hit = hit.select("rid", "doc_id", "n", start.alias("start"), F.lit(s).alias("k"), F.concat_ws(" ", F.slice("w", start + 1, F.col("n"))).alias("window"))
        windows = hit if windows is None else windows.unionByName(hit)
    if windows is None:
        return words.select("doc_id", F.lit(None).cast(items.schema[item_col].dataType).alias("item_id"), F.lit(0).alias("word_start"), F.lit(0).alias("n_words"), F.lit(0.0).alias("similarity")).where("false")

    masks = _block_masks(radius)
    blocks = lambda fp: F.explode(F.array(*[F.struct(F.lit(b).alias("b"), F.col(fp).bitwiseAND(F.lit(m)).alias("v")) for b, m in enumerate(masks)])).alias("e")
    # A number of partitions of its own: few bytes, but much work for each window.
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    w = windows.groupBy("rid", "doc_id", "n", "start", "k", "window").agg(F.lit(1).alias("one")).repartition(tasks, "rid", "start", "n")
    w = w.withColumn("ww", F.split("window", " "))
    w = w.withColumn("wsh", _shingles(F.col("ww"), F.size("ww"), F.least(F.col("k"), F.size("ww")))).withColumn("wh", _hashes("wsh"))
    w = _with_fingerprint(w, "wh", "wfp", wide)
    w = w.select("rid", "doc_id", "n", "start", "wsh", "wfp", blocks("wfp")).select("*", "e.b", "e.v").drop("e")
    i = _with_fingerprint(i.withColumn("ih", _hashes("ish")), "ih", "ifp", wide).select("item_id", "n", "ish", "ifp", blocks("ifp")).select("*", "e.b", "e.v").drop("e")
    i = F.broadcast(i) if small_enough(i, BROADCAST_ROWS // 10) else i
    x = F.col("wfp").bitwiseXOR(F.col("ifp"))
    first = F.coalesce(*[F.when(x.bitwiseAND(F.lit(m)) == 0, F.lit(b)) for b, m in enumerate(masks)])
    near = w.join(i, ["n", "b", "v"]).where((F.bit_count(x) <= radius) & (first == F.col("b")))
    shared = _shared_weight(F.col("wsh"), F.col("ish"))
    near = near.withColumn("shared", shared).withColumn("similarity", F.col("shared") / (F.size("wsh") + F.size("ish") - F.col("shared")))
    near = near.where(F.col("similarity") >= similarity)
    best = near.groupBy("rid", "doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("s"), "n")).alias("m"))
    return best.select("doc_id", "item_id", (-F.col("m.s")).alias("word_start"), F.col("m.n").alias("n_words"), F.col("m.similarity").alias("similarity"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def without_leaks(docs: DataFrame, items: DataFrame, doc_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs, unchanged, that hold no benchmark item. Rows are told apart by id and text, so that those with
    a null id and those that share an id are judged one by one."""
    key = F.struct(F.col(doc_col).alias("__id"), F.xxhash64(text_col).alias("__hash")).alias("doc_id")
    found = leaks(docs.select(key, F.col(text_col).alias("text")), items.withColumnRenamed(text_col, "text"), "doc_id", text_col="text", **how)
    found = save(found.select("doc_id.*").distinct(), "leaks")
    found = F.broadcast(found) if small_enough(found, BROADCAST_ROWS) else found
    return docs.join(found, F.col(doc_col).eqNullSafe(F.col("__id")) & (F.xxhash64(text_col) == F.col("__hash")), "left_anti")


_WORDS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
#: All windows that share a shingle with an item, without fingerprints: what the operator finds within its radius.
SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, iw, len(iw) AS n, least({SHINGLE_WORDS}, len(iw)) AS k FROM (SELECT DISTINCT item_id, {_WORDS} AS iw FROM benchmark) WHERE len(iw) > 0),
ig AS (SELECT item_id, n, k, o, array_to_string(iw[o + 1:o + k], ' ') AS g FROM (SELECT *, unnest(range(0, n - k + 1)) AS o FROM i)),
dg AS (SELECT doc_id, size, p, k, array_to_string(w[p + 1:p + k], ' ') AS g FROM (SELECT doc_id, w, len(w) AS size, k, unnest(range(0, len(w) - k + 1)) AS p FROM d, (SELECT DISTINCT k FROM i))),
win AS (SELECT DISTINCT doc_id, n, k, greatest(0, least(p - o, size - n)) AS start FROM dg JOIN (SELECT DISTINCT n, k, o, g FROM ig) USING (k, g)),
ww AS (SELECT doc_id, n, start, least(k, len(w[start + 1:start + n])) AS k, w[start + 1:start + n] AS w FROM win JOIN d USING (doc_id)),
ws AS (SELECT doc_id, n, start, len(w) - k + 1 AS size, array_to_string(w[j + 1:j + k], ' ') AS g FROM (SELECT *, unnest(range(0, len(w) - k + 1)) AS j FROM ww)),
wc AS (SELECT doc_id, n, start, size, g, count(*) AS c FROM ws GROUP BY ALL),
ic AS (SELECT item_id, n, n - k + 1 AS isize, g, count(*) AS c FROM ig GROUP BY ALL),
m AS (SELECT doc_id, item_id, n, start, size, isize, sum(least(wc.c, ic.c)) AS shared FROM wc JOIN ic USING (n, g) GROUP BY ALL),
s AS (SELECT doc_id, item_id, start, n, shared / (size + isize - shared) AS similarity FROM m)
SELECT doc_id, item_id, start AS word_start, n AS n_words, similarity FROM s WHERE similarity >= {SIMILARITY}
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) = 1
"""
