"""URL filtering by hashed host-suffix and path-prefix expressions. Native: DataFrame functions only."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import row_id, small_enough, table

#: The rules of the registered query: host, path, verdict.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Hex digits of a digest that the join compares first.
PREFIX_DIGITS = 8
#: Up to so many rules are broadcast; more are joined by a shuffle.
BROADCAST_RULES = 200_000
#: With up to so many (host labels, path length) pairs in the rules, each is one expression per URL. Beyond, a URL's host
#: suffixes are joined with the rules' hosts first, and only path lengths of those that are met are expanded.
MAX_SHAPES = 256


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL; both empty if it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    host = F.translate(raw, string.ascii_uppercase, string.ascii_lowercase)
    path = F.regexp_extract(F.substr(rest, F.length(raw) + 1), "^[^?#]*", 0)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rules_frame(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def url_filter(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Verdict of each URL: page id, host, path, rule, verdict.

    A URL is expanded into one expression (host suffix + path prefix) for each shape, i.e. pair of host labels and
    path length, that occurs among the rules. Expressions and rules meet in an equi-join on the first PREFIX_DIGITS
    of their SHA-256 digests; the full digests confirm. The longest rule wins, then the one with the longer host,
    then block. Only one number per URL is aggregated, and the key of that shuffle is the row, so no host is hot.

    Null, empty or malformed URLs have empty host and path and get the default verdict. Repeated rows and null ids
    give a row each. Rules with null or empty host are ignored, a null path counts as empty; repeated rules count
    once. Other columns are ignored. Empty tables give empty or all-default results.
    """
    spark = pages.sparkSession
    r = (
        rules.select(F.translate("host", string.ascii_uppercase, string.ascii_lowercase).alias("rh"), F.coalesce("path", F.lit("")).alias("rp"), F.col("verdict").alias("rv"))
        .where("rh is not null and rh <> '' and rv in ('allow', 'block')")
        .groupBy("rh", "rp").agg(F.max(F.col("rv") == "block").alias("blocks"))
    )
    shapes = sorted(tuple(x) for x in r.select(F.size(F.split("rh", r"\.")), F.length("rp")).distinct().limit(MAX_SHAPES + 1).collect())
    hosts = r.groupBy("rh").agg(F.collect_set(F.length("rp")).alias("lengths"))
    digest = F.sha2(F.concat("rh", F.lit("/"), "rp"), 256)  # no host holds a slash
    r = r.select(F.substring(digest, 1, PREFIX_DIGITS).alias("k"), digest.alias("rule_digest"), "blocks")
    r = F.broadcast(r) if small_enough(r, BROADCAST_RULES) else r

    host, path = split_url(F.col(url_col))
    urls = pages.select(row_id().alias("rid"), F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    urls = urls.withColumn("labels", F.size(F.split("host", r"\.")))
    parts = [
        F.when(
            (F.col("labels") >= n) & (F.length("path") >= m),
            F.struct(F.substring_index("host", ".", -n).alias("h"), F.substring("path", 1, m).alias("p")),
        )
        for n, m in shapes[:MAX_SHAPES]
    ]
    none = F.lit(None).cast("struct<h:string,p:string>")
    own = ["rid", "page_id", "host", "path"]
    if len(shapes) <= MAX_SHAPES:
        keyed = urls.select(*own, F.explode(F.array(none, *parts)).alias("e"))
    else:
        hosts = F.broadcast(hosts) if small_enough(hosts, BROADCAST_RULES) else hosts
        suffixes = urls.select(*own, F.explode(F.transform(F.sequence(F.lit(1), "labels"), lambda n: F.array_join(F.slice(F.split("host", r"\."), -n, n), "."))).alias("rh"))
        met = suffixes.join(hosts, "rh").select(*own, "rh", F.explode("lengths").alias("m")).where(F.length("path") >= F.col("m"))
        met = met.select(*own, F.struct(F.col("rh").alias("h"), F.substr("path", F.lit(1), F.col("m")).alias("p")).alias("e"))
        keyed = urls.select(*own, none.alias("e")).union(met)
    # The first, null expression keeps URLs that no rule can fit.
    keyed = keyed.where(F.col("e").isNotNull() | F.col("e.h").isNull()).withColumn("digest", F.sha2(F.concat("e.h", F.lit("/"), "e.p"), 256))
    met = keyed.join(r, F.substring("digest", 1, PREFIX_DIGITS) == F.col("k"), "left")
    n_host, n_path = F.length("e.h").cast("long"), F.length("e.p").cast("long")
    # Expressions of one URL with equal host and path lengths are equal: this number tells rule and precedence.
    rank = F.shiftleft(n_host + n_path, 32) + n_host * 2 + F.col("blocks").cast("long")
    won = met.groupBy("rid", "page_id", "host", "path").agg(F.max(F.when(F.col("digest") == F.col("rule_digest"), rank)).alias("won"))
    total, low = F.shiftright("won", 32).cast("int"), F.col("won").bitwiseAND(0xFFFFFFFF)
    own_host = F.shiftright(low, 1).cast("int")
    rule = F.when(F.col("won").isNotNull(), F.concat(F.right("host", own_host), F.left("path", total - own_host)))
    verdict = F.when(F.col("won").isNull(), F.lit(default)).when(low.bitwiseAND(1) == 1, "block").otherwise("allow")
    return won.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"), rules_frame(spark))


SQL = f"""
WITH u AS (SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM u),
p AS (SELECT page_id, translate(raw, '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
  regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
rules(rh, rp, rv) AS (VALUES {', '.join(str(x) for x in RULES)}),
m AS (SELECT page_id, host, path, rh || rp AS rule, rv,
  row_number() OVER (PARTITION BY page_id ORDER BY length(rh) + length(rp) DESC, length(rh) DESC) AS k
  FROM p LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(rv, 'allow') AS verdict FROM m WHERE k = 1
"""
