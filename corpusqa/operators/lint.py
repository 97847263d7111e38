"""Lint of semi-structured documents: headings, fields, tables, quotes.

All take ``doc_lines`` (doc, pos, line, level, heading, at, key) or documents (doc, text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Severity tiers of the checks.
TIERS = {"glued_heading": 1, "level_jump": 2, "dup_card": 1, "dup_field": 2, "colon": 3, "field_alias": 3, "table_columns": 1, "quote_imbalance": 2}
#: Fixed value: names of persons.
PERSON = r"^[\u4e00-\u9fa5]{2,}$"


def marked_lines(docs: DataFrame) -> DataFrame:
    """Lines (doc, pos, line) with level and heading of heading lines and the key of fields."""
    lines = docs.select("doc", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("pos", F.col("pos").cast("bigint"))
    mark = F.regexp_extract("line", r"^(#{1,6}) +\S", 1)
    key = F.nullif(F.trim(F.regexp_extract("line", r"^- \*\*([^*：:]{1,20})[：:]", 1)), F.lit(""))
    return lines.withColumn("level", F.when(F.length(mark) > 0, F.length(mark))).withColumn("heading", F.when(F.col("level").isNotNull(), F.trim(F.regexp_replace("line", r"^#{1,6} +", "")))).withColumn("key", key)


def with_heading_above(lines: DataFrame) -> DataFrame:
    """Add ``at``, the place of the last heading."""
    above = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("at", F.last(F.when(F.col("level").isNotNull(), F.col("pos")), ignorenulls=True).over(above))


def doc_lines(docs: DataFrame) -> DataFrame:
    """Lines with the heading above them: level and heading of heading lines, ``at`` the last heading's place."""
    return with_heading_above(marked_lines(docs))


def _finding(df: DataFrame, check: str, detail) -> DataFrame:
    return df.select("doc", F.lit(check).alias("check"), F.col("pos").alias("line"), detail.cast("string").alias("detail"))


def lint_glued(lines: DataFrame) -> DataFrame:
    return _finding(lines.where(F.col("level").isNotNull() & F.col("heading").rlike(r"##")), "glued_heading", F.col("heading"))


def lint_level_jump(lines: DataFrame) -> DataFrame:
    heads = lines.where("level IS NOT NULL").withColumn("before", F.lag("level").over(Window.partitionBy("doc").orderBy("pos")))
    return _finding(heads.where("level > before + 1"), "level_jump", F.concat_ws(">", "before", "level"))


def card_name(heading: str) -> Column:
    """A heading without its number and without what follows a bracket, bar, dot, dash, slash or white space."""
    bare = F.trim(F.regexp_replace(heading, r"^[0-9]+[a-z]?[.、]\s*", ""))
    return F.regexp_extract(bare, r"^([^（(｜|·\s—/]*)", 1)


def lint_dup_card(lines: DataFrame, least_level: int = 3, person: str = PERSON) -> DataFrame:
    """Headings of a level with fields whose name, a person's, occurs before among such headings."""
    with_fields = lines.where("key IS NOT NULL AND at IS NOT NULL").select("doc", F.col("at").alias("pos")).distinct()
    cards = lines.where(F.col("level") >= least_level).join(with_fields, ["doc", "pos"], "left_semi").withColumn("name", card_name("heading"))
    first = F.min("pos").over(Window.partitionBy("doc", "level", "name"))
    return _finding(cards.where(F.col("name").rlike(person)).withColumn("first", first).where("pos > first"), "dup_card", F.concat_ws("@", "name", "first"))


def lint_dup_field(lines: DataFrame) -> DataFrame:
    rows = lines.where("key IS NOT NULL").withColumn("first", F.min("pos").over(Window.partitionBy("doc", F.coalesce("at", F.lit(-1)), "key")))
    return _finding(rows.where("pos > first"), "dup_field", F.concat_ws("@", "key", "first"))


def lint_colon(lines: DataFrame) -> DataFrame:
    return _finding(lines.where(F.col("line").rlike(r"^- \*\*[^*：:]{1,20}:")), "colon", F.col("key"))


def lint_field_alias(lines: DataFrame, core: tuple[str, ...]) -> DataFrame:
    """Core keys that a document spells in two ways or more."""
    found = F.expr("get(filter(array(" + ", ".join(f"'{c}'" for c in core) + "), c -> contains(key, c)), 0)")
    rows = lines.where("key IS NOT NULL AND length(key) <= 8 AND NOT key RLIKE '[（(]'").withColumn("core", found).where("core IS NOT NULL")
    out = rows.groupBy("doc", "core").agg(F.array_join(F.array_sort(F.collect_set("key")), "/").alias("spelt"), F.countDistinct("key").alias("n"), F.min("pos").alias("pos")).where("n > 1")
    return _finding(out, "field_alias", F.col("spelt"))


def lint_table_columns(docs: DataFrame) -> DataFrame:
    """Rows of a table whose cells are not as many as its header's (a separator row resets the header)."""
    lines = docs.select("doc", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("pos", F.col("pos").cast("bigint")).withColumn("line", F.trim(F.regexp_replace("line", "`[^`]*`", "")))
    is_row = F.col("line").startswith("|")
    w = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("run", F.sum(F.when(is_row, 0).otherwise(1)).over(w)).where(is_row).withColumn("cells", F.size(F.split("line", r"\|")))
    first = F.col("pos") == F.min("pos").over(Window.partitionBy("doc", "run"))
    separator = F.col("line").rlike(r"^\|[\s:|-]+$")
    header = F.last(F.when(first | separator, F.col("cells")), ignorenulls=True).over(Window.partitionBy("doc", "run").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return _finding(rows.withColumn("header", header).where("cells <> header"), "table_columns", F.concat_ws("/", "cells", "header"))


def lint_quotes(docs: DataFrame, opener: str = "(", closer: str = ")") -> DataFrame:
    """Documents with other numbers of openers and closers: the first closer too many, else the first opener left open."""
    marks = docs.select("doc", F.posexplode(F.split("text", "\n")).alias("pos", "line")).where(F.col("line").contains(opener) | F.col("line").contains(closer))
    chars = marks.select("doc", F.col("pos").cast("bigint").alias("pos"), F.posexplode(F.split("line", "")).alias("i", "c")).where(F.col("c").isin(opener, closer)).withColumn("d", F.when(F.col("c") == opener, 1).otherwise(-1))
    w = Window.partitionBy("doc").orderBy("pos", "i")
    depth = chars.withColumn("s", F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ends = depth.groupBy("doc").agg(F.sum("d").alias("total"), F.min(F.when(F.col("s") < 0, F.struct("pos", "i"))).alias("surplus"), F.min(F.when(F.col("s") >= 0, F.lit(0))).alias("z"))
    # The clamped depth is 0 where the sum is at its running minimum (below 0) or at 0.
    low = depth.withColumn("floor", F.least(F.lit(0), F.min("s").over(w.rowsBetween(Window.unboundedPreceding, 0)))).withColumn("zero", F.col("s") == F.col("floor"))
    last_zero = low.where("zero").groupBy("doc").agg(F.max(F.struct("pos", "i")).alias("last"))
    opens = low.where("d = 1").join(last_zero, "doc", "left").where("last IS NULL OR struct(pos, i) > last").groupBy("doc").agg(F.min("pos").alias("open_pos"))
    out = ends.where("total <> 0").join(opens, "doc", "left")
    return _finding(out.withColumn("pos", F.coalesce("surplus.pos", "open_pos")), "quote_imbalance", F.col("total"))


def lint_all(docs: DataFrame, core: tuple[str, ...], person: str = PERSON, least_level: int = 3) -> DataFrame:
    """(doc, check, line, detail): the findings of all checks of lines, from one reading of the documents.

    Lines are dealt out by document once; every window of the checks is within a document, so that
    they are sorted anew, not moved.  A line's findings are an array.
    """
    in_order = Window.partitionBy("doc").orderBy("pos")
    upto, before = in_order.rowsBetween(Window.unboundedPreceding, 0), in_order.rowsBetween(Window.unboundedPreceding, -1)
    bare = F.trim(F.regexp_replace("line", "`[^`]*`", ""))
    is_row = bare.startswith("|")
    # Only what the checks ask of a line is moved and sorted, and only for lines of which they ask something.
    lines = marked_lines(docs).withColumns({"colon": F.col("line").rlike(r"^- \*\*[^*：:]{1,20}:"), "is_row": is_row, "cells": F.when(is_row, F.size(F.split(bare, r"\|"))), "separator": bare.rlike(r"^\|[\s:|-]+$")})
    lines = with_heading_above(lines.drop("line").where("level IS NOT NULL OR key IS NOT NULL OR colon OR is_row"))
    # A run of rows has as many lines before it that are none, left out or not.
    lines = lines.withColumns({"before": F.last("level", ignorenulls=True).over(before), "run": F.col("pos") - F.count_if("is_row").over(upto)})
    within = Window.partitionBy("doc", "at")
    named = F.when(F.col("level") >= least_level, card_name("heading"))
    is_card = (F.col("level") >= least_level) & (F.col("fields") > 0) & named.rlike(person)
    lines = lines.withColumn("fields", F.when(F.col("at").isNotNull(), F.count("key").over(within)))
    lines = lines.withColumn("first_key", F.min("pos").over(Window.partitionBy("doc", F.coalesce("at", F.lit(-1)), "key")))
    lines = lines.withColumns({"is_card": is_card, "name": named}).withColumn("first_card", F.min(F.when(F.col("is_card"), F.col("pos"))).over(Window.partitionBy("doc", "level", "name")))
    rows_of = Window.partitionBy("doc", "run", "is_row")
    lines = lines.withColumn("top", F.col("pos") == F.min("pos").over(rows_of))
    lines = lines.withColumn("header", F.last(F.when(F.col("top") | F.col("separator"), F.col("cells")), ignorenulls=True).over(rows_of.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    meant = F.expr("get(filter(array(" + ", ".join(f"'{c}'" for c in core) + "), c -> contains(key, c)), 0)")
    lines = lines.withColumn("core", F.when((F.length("key") <= 8) & ~F.col("key").rlike("[（(]"), meant))
    same = Window.partitionBy("doc", "core")
    lines = lines.withColumns({"spelt": F.when(F.col("core").isNotNull(), F.array_sort(F.collect_set("key").over(same))), "first_core": F.min("pos").over(same)})
    told = {
        "glued_heading": (F.col("level").isNotNull() & F.col("heading").contains("##"), F.col("heading")),
        "level_jump": (F.col("level") > F.col("before") + 1, F.concat_ws(">", "before", "level")),
        "dup_card": (F.col("is_card") & (F.col("pos") > F.col("first_card")), F.concat_ws("@", "name", "first_card")),
        "dup_field": (F.col("key").isNotNull() & (F.col("pos") > F.col("first_key")), F.concat_ws("@", "key", "first_key")),
        "colon": (F.col("colon"), F.col("key")),
        "field_alias": ((F.size("spelt") > 1) & (F.col("pos") == F.col("first_core")), F.array_join("spelt", "/")),
        "table_columns": (F.col("is_row") & (F.col("cells") != F.col("header")), F.concat_ws("/", "cells", "header")),
    }
    each = F.array(*(F.when(met, F.struct(F.lit(check).alias("check"), detail.cast("string").alias("detail"))) for check, (met, detail) in told.items()))
    return lines.select("doc", F.col("pos").alias("line"), F.explode(F.array_compact(each)).alias("x")).select("doc", "x.check", "line", "x.detail")


def lint_summary(findings: DataFrame) -> DataFrame:
    """(doc, tier, n, verdict): findings by tier; tier 1 fails the document."""
    tier = F.create_map(*(F.lit(x) for kv in TIERS.items() for x in kv))[F.col("check")]
    out = findings.withColumn("tier", tier).groupBy("doc", "tier").agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("verdict", F.when(F.col("tier") == 1, "fail").otherwise("report"))
