"""Snapshots against each other: mirrors, indexes, titles, progress, sequences, buckets, stages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusqa.operators.intervals import covering, product, until_next
from corpusqa.operators.scans import previous


def mirror_diff(src: DataFrame, mirror: DataFrame, key: list[str], content: str) -> DataFrame:
    """(key, status): missing in the mirror, different, or extra there."""
    a = src.select(*key, F.md5(content).alias("a"))
    b = mirror.select(*key, F.md5(content).alias("b"))
    status = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").when(F.col("a") != F.col("b"), "differs")
    return a.join(b, key, "full").select(*key, status.alias("status")).where("status IS NOT NULL")


def index_coverage(items: DataFrame, index: DataFrame, key: str, by: str) -> DataFrame:
    """Per ``by``: items, listed ones, items not listed, listed that are no items."""
    a = items.select(by, key).distinct().withColumn("a", F.lit(1))
    b = index.select(by, key).distinct().withColumn("b", F.lit(1))
    return a.join(b, [by, key], "full").groupBy(by).agg(F.count("a").alias("items"), F.count("b").alias("listed"), F.count_if(F.col("b").isNull()).alias("unlisted"), F.count_if(F.col("a").isNull()).alias("extra"))


def title_reconcile(declared: DataFrame, actual: DataFrame, predeclared: bool = False) -> DataFrame:
    """(id, vol, status, severity) of titles declared (vol, id, title) and found (id, title).

    A volume ranges from its first to its last declared id.  A declared one without a section
    (``section_missing``) fails up to the number of sections and warns past it, or if outlines may
    run ahead (``predeclared``), and is listed as ``beyond_source``, too.  A section inside a volume's
    range that the volume does not declare is ``undeclared``; a section in no range is no matter of titles.
    """
    have = actual.select("id", F.col("title").alias("t"), F.lit(True).alias("there"))
    joined = declared.select("vol", "id", F.col("title").alias("d")).join(have, "id", "left")
    status = F.when(F.col("there").isNull(), "section_missing").when(F.coalesce("t", F.lit("")) == "", "heading_absent").when(F.col("d") != F.col("t"), "mismatch")
    judged = joined.select("id", "vol", status.alias("status")).where("status IS NOT NULL")
    n = F.broadcast(actual.agg(F.count_distinct("id").alias("n")))  # one row
    severity = F.when((F.col("status") == "section_missing") & (F.lit(predeclared) | (F.col("id") > F.col("n"))), "warn").otherwise("fail")
    judged = judged.crossJoin(n).select("id", "vol", "status", severity.alias("severity"))
    beyond = judged.where("status = 'section_missing'").select("id", "vol", F.lit("beyond_source").alias("status"), F.lit("warn").alias("severity"))
    ranges = declared.groupBy("vol").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    inside = covering(actual, ranges, "id").select("id", "vol").join(declared.select("vol", "id"), ["vol", "id"], "left_anti")
    return judged.unionByName(beyond).unionByName(inside.select("id", "vol", F.lit("undeclared").alias("status"), F.lit("warn").alias("severity")))


def progress_check(progress: DataFrame, sections: DataFrame, mirror: DataFrame) -> DataFrame:
    """(corpus, rule): declared current against the last section, the total and the mirror."""
    last = sections.groupBy("corpus").agg(F.max("seq").alias("last"))
    joined = progress.join(last, "corpus").join(mirror.select("corpus", F.col("current").alias("mirrored")), "corpus", "left")
    rules = F.array(
        F.when(F.col("current") != F.col("last"), F.lit("current_not_last")),
        F.when(F.col("current") > F.col("total"), F.lit("current_over_total")),
        F.when(~F.col("mirrored").eqNullSafe(F.col("current")), F.lit("mirror_differs")),
    )
    return joined.select("corpus", F.explode(F.array_compact(rules)).alias("rule"))


def sequence_gaps(sections: DataFrame) -> DataFrame:
    """(corpus, seq): numbers from 1 to the last that have no section, found between neighbours."""
    pairs = previous(sections.select("corpus", "seq").where("seq IS NOT NULL").distinct(), ["corpus"], "seq").withColumn("before", F.coalesce("before", F.lit(0)))
    return pairs.where("seq > before + 1").select("corpus", F.explode(F.expr("sequence(before + 1, seq - 1)")).alias("seq"))


def bucket_of(df: DataFrame, starts: DataFrame) -> DataFrame:
    """Add the other columns of ``starts`` (kind, start, ...) of the largest start of a kind that is not above seq (else null)."""
    ranges = until_next(starts, keys=("kind",)).drop("kind")
    return df.join(covering(df, ranges, lo="start").drop("start", "hi"), "seq", "left").select(*df.columns, *(c for c in ranges.columns if c not in ("start", "hi")))


def stage_status(progress: DataFrame, stages: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(corpus, stage, status, has_artifact) for every corpus and stage."""
    every = product(progress.select("corpus", F.col("stage").alias("current")), stages)
    status = F.when(F.col("stage") < F.col("current"), "done").when(F.col("stage") == F.col("current"), "active").otherwise("todo")
    has = artifacts.where("size > 0").select("corpus", "stage", F.lit(True).alias("has")).distinct()
    return every.join(has, ["corpus", "stage"], "left").select("corpus", "stage", status.alias("status"), F.coalesce("has", F.lit(False)).alias("has_artifact"))
