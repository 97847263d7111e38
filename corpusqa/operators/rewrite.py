"""Bulk rewrites: replace rules, paragraph coalescing, marked segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusqa.functions.text import has_own_attribution, occurrences, paragraph_list, visible_length
from corpusqa.schemas import CJK, SPACES, LangPack

KEY = ["corpus", "seq"]


def apply_rules(sections: DataFrame, rules: list[tuple[str, str]], skip: DataFrame | None = None) -> DataFrame:
    """(corpus, seq, text, replaced): rules in order, each counted on what the earlier ones left."""
    rows = sections.join(skip, KEY, "left_anti") if skip is not None else sections
    text, n = F.col("text"), F.lit(0).cast("bigint")
    for old, new in rules:
        n = n + occurrences(text, F.lit(old))
        text = F.replace(text, F.lit(old), F.lit(new))
    return rows.select(*KEY, text.alias("text"), n.alias("replaced"))


def span_blocks(paras: DataFrame, opener: str, closer: str) -> DataFrame:
    """(corpus, seq, first, last): runs from a paragraph that begins with an opener and has no closer to the next with a closer.

    After a paragraph with a closer no run is open, so that runs lie between two of these.
    """
    marked = paras.select(*KEY, "pos", (F.col("para").startswith(opener) & ~F.col("para").contains(closer)).alias("o"), F.col("para").contains(closer).alias("c")).where("o OR c")
    before = Window.partitionBy(*KEY).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    parts = marked.withColumn("part", F.count_if("c").over(before))
    out = parts.groupBy(*KEY, "part").agg(F.min(F.when(F.col("o"), F.col("pos"))).alias("first"), F.max(F.when(F.col("c"), F.col("pos"))).alias("last"))
    return out.where("first < last").select(*KEY, "first", "last")


def _features(para: Column, pack: LangPack) -> Column:
    """What the fold must know of a paragraph."""
    opener, closer = pack.openers[0], pack.closers[0]
    n = visible_length(para).cast("bigint")
    return F.struct(
        para.alias("p"), n.alias("n"), para.startswith(opener).alias("q"), para.contains(opener).alias("o"), para.contains(closer).alias("c"), para.endswith("：").alias("colon"),
        para.rlike(pack.attribution).alias("attr"), has_own_attribution(para, closer).alias("own"), ((n <= 16) & para.rlike(f"^(?:{pack.scene})")).alias("shift"),
    )


def merge_flags(ps: str, target: int) -> Column:
    """For each of the paragraphs ``ps`` (features; with the place of the last closer in ``last_closer``) whether it flows into the one before: a fold with a state of fixed size.

    The state holds the place, what the merged paragraph before is like, and whether a quote runs over
    paragraphs; it only counts as a block up to the last paragraph with a closer.  Flags are gathered as text in
    pieces of bounded length, so that no step copies what it has gathered.
    """
    start = (
        "named_struct('i', 0, 'q', false, 'n', 0L, 'colon', false, 'own', false, 'hc', false, 'opened', false, 'block', false, "
        "'cur', '', 'done', cast(array() AS array<string>))"
    )
    inside = "((a.opened OR (p.q AND NOT p.c)) AND a.i <= last_closer)"
    narrative = f"NOT a.q AND NOT p.q AND a.n < {target} AND (p.attr OR NOT p.o)"
    introduced = "NOT a.q AND p.q AND a.colon"
    attributed = f"a.q AND NOT p.q AND a.n < {target} AND a.own AND NOT p.attr"
    merged = f"a.i > 0 AND a.i < size({ps}) - 1 AND NOT p.shift AND NOT {inside} AND NOT a.block AND (({narrative}) OR ({introduced}) OR ({attributed}))"
    after = (
        "named_struct('i', a.i + 1, 'q', if(m, a.q, p.q), 'n', if(m, a.n + p.n, p.n), 'colon', p.colon, 'own', if(p.c, p.own, m AND a.hc), 'hc', p.c OR (m AND a.hc), "
        f"'opened', NOT p.c AND (a.opened OR p.q), 'block', {inside}, "
        "'cur', concat(if(length(a.cur) < 1024, a.cur, ''), if(m, '1', '0')), 'done', if(length(a.cur) < 1024, a.done, concat(a.done, array(a.cur))))"
    )
    step = f"element_at(transform(array({merged}), m -> {after}), 1)"  # one name for what is read often
    return F.expr(f"aggregate({ps}, {start}, (a, p) -> {step}, a -> flatten(transform(concat(a.done, array(a.cur)), c -> split(c, ''))))")


def coalesce_paragraphs(sections: DataFrame, target: int = 110, pack: LangPack = CJK) -> DataFrame:
    """(corpus, seq, text): heading lines first, then the paragraphs, short ones merged in order (null stays null).

    Nothing but the ends of paragraphs moves: without headings, the paragraphs' characters stay as they are, in their order.
    """
    lines = F.transform(F.split("text", "\n"), lambda l: F.btrim(l, F.lit(SPACES)))
    parts = sections.select(*KEY, F.filter(lines, lambda l: l.startswith("#")).alias("heads"), F.transform(paragraph_list(F.col("text")), lambda p: _features(p, pack)).alias("ps"))
    parts = parts.withColumn("last_closer", F.expr("array_max(transform(ps, (x, j) -> if(x.c, j, -1)))"))
    flagged = parts.withColumn("flags", merge_flags("ps", target))
    # The flags are an argument, not read within the lambda: there the optimizer would put the whole fold, to run it for each paragraph.
    body = F.expr("array_join(zip_with(ps, flags, (x, f) -> concat(if(f = '0', '\\n', ''), x.p)), '')")  # the first flag is 0
    return flagged.select(*KEY, F.concat(F.array_join("heads", "\n"), body).alias("text"), (F.size("heads") > 0).alias("headed")).select(*KEY, F.expr("if(headed, text, substring(text, 2))").alias("text"))


def upsert_segment(docs: DataFrame, segments: DataFrame, begin: str, end: str) -> DataFrame:
    """(doc, text) with the segment of each document between markers.

    It replaces what is between them, else comes after the first heading, else at the top; line ends
    stay as they are; doing it again changes nothing.
    """
    nl = F.when(F.col("text").contains("\r\n"), F.lit("\r\n")).otherwise(F.lit("\n"))
    block = F.concat(F.lit(begin), F.col("nl"), F.replace(F.col("segment"), F.lit("\n"), F.col("nl")), F.col("nl"), F.lit(end))
    i, j = F.instr("text", begin), F.instr("text", end)
    head = F.regexp_extract("text", r"(?m)^(#{1,6} [^\r\n]*)", 1)
    at = F.expr("locate(head, text) + length(head)")
    replaced = F.concat(F.expr("left(text, i - 1)"), F.col("block"), F.expr(f"substring(text, j + {len(end)})"))
    after = F.concat(F.expr("left(text, at - 1)"), F.col("nl"), F.col("block"), F.expr("substring(text, at)"))
    joined = docs.join(segments, "doc", "left").withColumn("nl", nl).withColumn("block", block).withColumn("i", i).withColumn("j", j).withColumn("head", head).withColumn("at", at)
    text = F.when(F.col("segment").isNull(), F.col("text")).when((F.col("i") > 0) & (F.col("j") > F.col("i")), replaced).when(F.col("head") != "", after).otherwise(F.concat("block", "nl", "text"))
    return joined.select("doc", text.alias("text"))
