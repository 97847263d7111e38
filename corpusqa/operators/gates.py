"""Findings: classes, rollups, deltas, changed sets, ranges, verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusqa.operators.intervals import covering
from corpusqa.operators.scans import CELL_BITS, previous, running_sum
from corpusqa.schemas import SPACES
from corpusqa.sources import cut


def classify(findings: DataFrame, enforce_from: DataFrame) -> DataFrame:
    """Add class: ``info`` for notes, ``legacy`` before a rule is enforced, else ``fail``."""
    joined = findings.join(enforce_from, "rule", "left")
    kind = F.when(F.col("severity") == "info", "info").when(F.col("seq") < F.coalesce("enforced", F.lit(0)), "legacy").otherwise("fail")
    return joined.withColumn("class", kind).drop("enforced")


def by_rule(findings: DataFrame) -> DataFrame:
    """(rule, n, sections) of findings, for each rule."""
    return findings.groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("corpus", "seq").alias("sections"))


def signal_counts(rows: DataFrame, keys: list[str], pattern: str) -> DataFrame:
    """(keys, signal, n): matches of a pattern."""
    return rows.select(*keys, F.explode(F.regexp_extract_all("text", F.lit(pattern), 0)).alias("signal")).groupBy(*keys, "signal").agg(F.count(F.lit(1)).alias("n"))


def signal_delta(before: DataFrame, after: DataFrame, keys: list[str], pattern: str) -> DataFrame:
    """(keys, signal, added): how many more of each signal a row has after than before."""
    a = signal_counts(before, keys, pattern).withColumnRenamed("n", "was")
    b = signal_counts(after, keys, pattern)
    return b.join(a, [*keys, "signal"], "left").select(*keys, "signal", (F.col("n") - F.coalesce("was", F.lit(0))).alias("added")).where("added > 0")


def changed_sections(before: DataFrame, after: DataFrame, key: list[str], content: str = "text") -> DataFrame:
    """(key, status) of rows added or modified since ``before``."""
    a = before.select(*key, F.md5(content).alias("a"))
    b = after.select(*key, F.md5(content).alias("b"))
    joined = b.join(a, key, "left")
    return joined.select(*key, F.when(F.col("a").isNull(), "added").when(F.col("a") != F.col("b"), "modified").alias("status")).where("status IS NOT NULL")


def _line_tokens(rows: DataFrame, key: list[str], content: str) -> DataFrame:
    """(key, tokens): the lines of a text that aren't blank, the first, second ... of equal ones apart, as hashes."""
    lines = F.filter(F.transform(F.split(F.coalesce(content, F.lit("")), "\n"), lambda l: F.btrim(l, F.lit(SPACES))), lambda l: l != "")
    each = rows.select(*key, F.explode(lines).alias("line")).groupBy(*key, "line").agg(F.count(F.lit(1)).alias("k"))
    return each.select(*key, F.explode(F.transform(F.sequence(F.lit(1), F.col("k").cast("int")), lambda i: F.xxhash64("line", i))).alias("t"))


def similar_sections(a: DataFrame, b: DataFrame, key: list[str], content: str = "text", least: float = 0.5) -> DataFrame:
    """(a_<key>, b_<key>, likeness): pairs of a row of ``a`` and one of ``b`` whose common lines are at least ``least`` of the longer one's lines.

    Candidates share one of the lines that are rarest: of n lines, any n - ceil(least n) + 1 have one in
    common with every text that is alike enough.  Texts without lines are alike to none.
    """
    names = lambda s: [F.col(k).alias(f"{s}_{k}") for k in key]
    x, y = (_line_tokens(df, key, content).select(*names(s), "t") for df, s in ((a, "a"), (b, "b")))
    x, y = cut(x), cut(y)
    df = x.select("t").unionByName(y.select("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df"))

    def listed(tokens: DataFrame, s: str) -> DataFrame:
        by = [f"{s}_{k}" for k in key]
        rows = tokens.join(df, "t").groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("df", "t"))).alias("ts"))
        n = F.size("ts")
        return cut(rows.select(*by, n.alias(f"{s}_n"), F.transform("ts", lambda x: x["t"]).alias(f"{s}_ts"), (n - F.ceil(n * least) + 1).cast("int").alias("head")))

    left, right = listed(x, "a"), listed(y, "b")
    heads = lambda rows, s: rows.select(*(f"{s}_{k}" for k in key), f"{s}_n", F.explode(F.slice(f"{s}_ts", F.lit(1), F.col("head"))).alias("t"))
    near = (F.col("a_n") >= F.col("b_n") * least) & (F.col("b_n") >= F.col("a_n") * least)
    by = [f"{s}_{k}" for s in "ab" for k in key]
    pairs = heads(left, "a").join(heads(right, "b"), "t").where(near).select(*by).distinct()
    both = pairs.join(left.drop("head"), [f"a_{k}" for k in key]).join(right.drop("head"), [f"b_{k}" for k in key])
    likeness = F.size(F.array_intersect("a_ts", "b_ts")) / F.greatest("a_n", "b_n")
    return both.select(*by, likeness.alias("likeness")).where(F.col("likeness") >= least)


def moved_sections(before: DataFrame, after: DataFrame, key: list[str], content: str = "text", least: float = 0.5) -> DataFrame:
    """(key, status, from_<key>, likeness) of rows that are added, modified, renamed or copied since ``before``; keys are unique on either side.

    A row with a new key is ``renamed`` from one whose key is gone, one to one, the pair of the greatest
    likeness first (equal ones by the old key, then the new one; equal texts have likeness 1); what is
    left is ``copied`` from the row of ``before`` that is most alike (of equals the least key), else ``added``.
    """
    old, new = before.select(*key, F.col(content).alias("text")), after.select(*key, F.col(content).alias("text"))
    fresh = cut(new.join(old.select(*key), key, "left_anti"))
    gone = old.join(new.select(*key), key, "left_anti").select(*key)
    # Equal texts: all of one digest are paired in order of their keys, so that no group is multiplied.
    order = lambda df: df.withColumn("turn", F.row_number().over(Window.partitionBy("sign").orderBy(*key)))
    sign = F.md5(F.coalesce("text", F.lit("")))
    was = cut(old.join(gone, key, "left_semi").withColumn("sign", sign))
    now = fresh.withColumn("sign", sign)
    f = [F.col(k).alias(f"from_{k}") for k in key]
    equal = cut(order(now.drop("text")).join(order(was.drop("text")).select(*f, "sign", "turn"), ["sign", "turn"]).select(*key, *(f"from_{k}" for k in key)))
    rest_new = fresh.join(equal.select(*key), key, "left_anti")
    rest_old = was.drop("sign").join(equal.select(*(F.col(f"from_{k}").alias(k) for k in key)), key, "left_anti")
    names = [*key, *(f"from_{k}" for k in key)]
    pairs = similar_sections(rest_old, rest_new, key, "text", least)
    pairs = cut(pairs.select(*(F.col(f"b_{k}").alias(k) for k in key), *(F.col(f"a_{k}").alias(f"from_{k}") for k in key), "likeness"))
    renamed = equal.withColumn("likeness", F.lit(1.0))
    while not pairs.isEmpty():  # pairs that are the best of both their sides are what taking the best pair first would take
        rank = [F.desc("likeness"), *(F.asc(f"from_{k}") for k in key), *(F.asc(k) for k in key)]
        first = lambda by: F.row_number().over(Window.partitionBy(*by).orderBy(*rank))
        best = cut(pairs.withColumn("i", first(key)).withColumn("j", first([f"from_{k}" for k in key])).where("i = 1 AND j = 1").select(*names, "likeness"))
        renamed = cut(renamed.unionByName(best))
        pairs = cut(pairs.join(best.select(*key), key, "left_anti").join(best.select(*(f"from_{k}" for k in key)), [f"from_{k}" for k in key], "left_anti"))
    left = cut(fresh.join(renamed.select(*key), key, "left_anti"))
    same = left.withColumn("sign", sign).drop("text").join(old.withColumn("sign", sign).groupBy("sign").agg(F.min(F.struct(*key)).alias("s")), "sign")
    same = same.select(*key, *(F.col(f"s.{k}").alias(f"from_{k}") for k in key), F.lit(1.0).alias("likeness"))
    alike = similar_sections(old, left.join(same.select(*key), key, "left_anti"), key, "text", least)
    most = alike.groupBy(*(F.col(f"b_{k}").alias(k) for k in key)).agg(F.min(F.struct((-F.col("likeness")).alias("m"), *(F.col(f"a_{k}").alias(k) for k in key))).alias("s"))
    copied = same.unionByName(most.select(*key, *(F.col(f"s.{k}").alias(f"from_{k}") for k in key), (-F.col("s.m")).alias("likeness")))
    moved = renamed.withColumn("status", F.lit("renamed")).unionByName(copied.withColumn("status", F.lit("copied")))
    plain = changed_sections(old, new, key)
    out = plain.withColumnRenamed("status", "plain").join(moved, key, "left")
    return out.select(*key, F.coalesce("status", "plain").alias("status"), *(f"from_{k}" for k in key), "likeness")


def compact_ranges(df: DataFrame, part: str, n: str, most: int = 10, bits: int = CELL_BITS) -> DataFrame:
    """(part, ranges, more): distinct integers as ``a-b`` runs, the first ``most`` and how many more."""
    rows = previous(df.select(part, n).where(F.col(n).isNotNull()).distinct(), [part], n, bits=bits)
    marked = running_sum(rows, [part], n, F.when(F.col(n) == F.col("before") + 1, 0).otherwise(1), "run", bits)
    runs = marked.groupBy(part, "run").agg(F.min(n).alias("a"), F.max(n).alias("b"))
    label = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", "a", "b"))
    listed = runs.where(F.col("run") <= most).groupBy(part).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", label.alias("label")))), lambda x: x["label"]), ",").alias("ranges"))
    total = runs.groupBy(part).agg(F.greatest(F.count(F.lit(1)) - most, F.lit(0)).alias("more"))
    return listed.join(total, part)


def revision_pairs(revisions: DataFrame, doc: str, rev: str) -> DataFrame:
    """Each revision with the text before it (the first: empty)."""
    w = Window.partitionBy(doc).orderBy(rev)
    return revisions.withColumn("before", F.coalesce(F.lag("text").over(w), F.lit("")))


def gate_summary(findings: DataFrame, steps: DataFrame) -> DataFrame:
    """(step, kind, n, failed) of every step (step, kind, rule); only steps of kind ``fail`` can fail."""
    counted = findings.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
    joined = steps.join(counted, "rule", "left")
    return joined.groupBy("step", "kind").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).withColumn("failed", (F.col("kind") == "fail") & (F.col("n") > 0))


def enforced(volumes: DataFrame, sections: DataFrame, ranges: DataFrame) -> DataFrame:
    """(corpus, vol, strict): whether a section of the volume lies in an enrolled range."""
    placed = sections.select("corpus", "seq").join(covering(sections, volumes).select("seq", "vol"), "seq")
    enrolled = covering(sections, ranges.select("lo", "hi")).select("seq", F.lit(True).alias("enrolled")).distinct()
    return placed.join(enrolled, "seq", "left").groupBy("corpus", "vol").agg(F.bool_or(F.coalesce("enrolled", F.lit(False))).alias("strict"))
