"""Stages of a case, allowed transitions, and token usage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import small
from ..functions.text import col, thousands


def transitions(log: DataFrame, case: str, order: list[str | Column], stage: str) -> DataFrame:
    """Steps of each case from one stage to the next: case, from_stage, to_stage, n."""
    w = Window.partitionBy(case).orderBy(*order)
    steps = log.select(case, F.lag(stage).over(w).alias("from_stage"), F.col(stage).alias("to_stage"))
    return steps.where("from_stage is not null").groupBy(case, "from_stage", "to_stage").agg(F.count("*").alias("n"))


def violations(steps: DataFrame, allowed: DataFrame) -> DataFrame:
    """Steps that the list of allowed ones (from_stage, to_stage) lacks."""
    return steps.join(small(allowed.select("from_stage", "to_stage").distinct()), ["from_stage", "to_stage"], "left_anti")


def reachable(edges: DataFrame, start: str) -> DataFrame:
    """Stages that can be reached from start: stage, steps. A recursive query, as deep as there are stages."""
    spark = edges.sparkSession
    n = edges.select(F.explode(F.array("from_stage", "to_stage")).alias("s")).distinct().count() + 1
    view = f"edges_{uuid.uuid4().hex}"  # a name of its own for each call
    edges.select("from_stage", "to_stage").distinct().createOrReplaceTempView(view)
    return spark.sql(f"""
        WITH RECURSIVE walk(stage, steps) MAX RECURSION LEVEL {n + 1} AS (
          SELECT '{start.replace("'", "''")}' AS stage, 0 AS steps
          UNION ALL SELECT e.to_stage, w.steps + 1 FROM walk w JOIN {view} e ON e.from_stage = w.stage WHERE w.steps < {n})
        SELECT stage, min(steps) AS steps FROM walk GROUP BY stage""")


def pipeline_faults(stages: DataFrame, edges: DataFrame, start: str) -> DataFrame:
    """Faults of a pipeline: stage, fault. stages: key, kind, exits (stages that a review names), reviewed_by."""
    keys = stages.select(F.col("key").alias("stage"))
    unknown = edges.select(F.explode(F.array("from_stage", "to_stage")).alias("stage")).distinct().join(keys, "stage", "left_anti").withColumn("fault", F.lit("unknown_stage"))
    lost = keys.join(reachable(edges, start).select("stage"), "stage", "left_anti").withColumn("fault", F.lit("unreachable"))
    exits = stages.where("kind = 'review'").select(F.col("key").alias("from_stage"), F.explode("exits").alias("to_stage"))
    bad = exits.join(edges, ["from_stage", "to_stage"], "left_anti").select(F.col("from_stage").alias("stage"), F.lit("exit_not_allowed").alias("fault"))
    lacking = stages.where("kind = 'review' and (reviewed_by is null or size(exits) = 0)").select(F.col("key").alias("stage"), F.lit("incomplete_review").alias("fault"))
    return unknown.union(lost).union(bad).union(lacking).distinct()


def frontmatter(text) -> Column:
    """struct<fields, body, fault> of a text that starts with fields between lines of dashes: name: value, a line each.
    Faults: no_frontmatter, or block_scalar:name for values that do not stand on the line of their name."""
    c = col(text)
    parts = F.split(c, "---", 3)
    there = c.startswith("---") & (F.size(parts) == 3)
    lines = F.filter(F.split(F.get(parts, F.lit(1)), "\n"), lambda x: x.rlike(r"^[^\s#:][^:]*:"))
    unquoted = lambda v: F.regexp_replace(F.trim(v), r"^([\"'])(.*)\1$", "$2")
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), unquoted(F.regexp_replace(x, r"^[^:]*:", "")).alias("value")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    block = F.regexp_extract(F.get(parts, F.lit(1)), r"(?m)^(description|name|title|capabilities)\s*:\s*[>|][-+]?\s*$", 1)
    fault = F.when(~there, "no_frontmatter").when(block != "", F.concat(F.lit("block_scalar:"), block))
    return F.struct(F.when(there, F.map_from_entries(last)).alias("fields"), F.when(there, F.get(parts, F.lit(2))).otherwise(c).alias("body"), fault.alias("fault"))


def usage(log: DataFrame, by: str) -> DataFrame:
    """Token totals: by, input, cached, output, total, shown, cache_ratio, cents; log: input, cached, output, cents."""
    sums = log.groupBy(by).agg(*[F.sum(c).alias(c) for c in ("input", "cached", "output", "cents")])
    total = F.col("input") + F.col("cached") + F.col("output")
    ratio = F.when(F.col("input") + F.col("cached") > 0, F.col("cached") / (F.col("input") + F.col("cached")))
    return sums.withColumn("total", total).withColumn("shown", thousands("total")).withColumn("cache_ratio", ratio)


def usage_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """metric, before, after, change (share of before) of two snapshots (metric, value)."""
    b, a = before.select("metric", F.col("value").alias("before")), after.select("metric", F.col("value").alias("after"))
    return b.join(a, "metric", "full").withColumn("change", F.when(F.col("before") != 0, (F.col("after") - F.col("before")) / F.col("before")))
