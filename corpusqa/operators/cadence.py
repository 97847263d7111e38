"""Mentions of names, their cadence over the sections, and the ratchet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusqa.operators.intervals import product
from corpusqa.operators.phrases import phrase_hits
from corpusqa.operators.scans import previous

KEY = ["corpus", "seq"]
#: Slots of the hashes of names' prefixes.
SLOTS = 1 << 20


def mentions(sections: DataFrame, roster: DataFrame) -> DataFrame:
    """(corpus, name, seq, lines): lines with the name or an alias and no negative context.

    ``roster`` (name, aliases, neg) may be of any size: all forms are looked up in one pass over the
    texts.  Null aliases and contexts count as none; empty forms are in no line.
    """
    forms = name_forms(roster, "neg")
    hits = phrase_hits(sections, KEY, forms.select("form"), by_line=True)
    lines = hits.join(forms, "form").groupBy(*KEY, "name", "line").agg(F.bool_or("rules_out").alias("out"), F.bool_or(~F.col("rules_out")).alias("met"))
    return lines.where("met AND NOT out").groupBy("corpus", "name", "seq").agg(F.count(F.lit(1)).alias("lines"))


def name_forms(roster: DataFrame, neg: str | None = None) -> DataFrame:
    """(name, form, rules_out): each name and alias, and, with ``neg``, each negative context, which rules a line out."""
    listed = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    said = F.concat(F.array("name"), listed("aliases")) if "aliases" in roster.columns else F.array("name")
    pairs = F.transform(said, lambda f: F.struct(f.alias("form"), F.lit(False).alias("rules_out")))
    if neg:
        pairs = F.concat(pairs, F.transform(listed(neg), lambda f: F.struct(f.alias("form"), F.lit(True).alias("rules_out"))))
    return roster.select("name", F.explode(pairs).alias("x")).select("name", "x.form", "x.rules_out").where("form IS NOT NULL AND form <> ''").distinct()


def mentions_by_prefix(sections: DataFrame, roster: DataFrame, k: int = 4) -> DataFrame:
    """As ``mentions`` for a roster too large to broadcast: sections and names meet in prefixes of k characters, shorter forms whole."""
    listed = lambda c: F.filter(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != "")).alias(c)
    forms = roster.select("name", listed("aliases"), listed("neg")).select("name", "aliases", "neg", F.explode(F.array_distinct(F.concat(F.array("name"), "aliases"))).alias("form")).where("form <> ''")
    names = forms.withColumn("g", F.substring("form", 1, k))
    sizes = [r[0] for r in names.select(F.length("g")).distinct().collect()] or [k]  # numbers from 1 to k
    each = F.flatten(F.array(*(F.regexp_extract_all("text", F.lit(f"(?s)(?=(.{{{n}}}))"), 1) for n in sorted(sizes))))
    # A text has a piece at each of its characters: those whose slot no name has go before anything is moved.
    slot = F.pmod(F.xxhash64("g"), F.lit(SLOTS)).alias("slot")
    pieces = sections.where(F.length("text") > 0).select(*KEY, F.explode(each).alias("g")).withColumn("slot", slot)
    grams = pieces.join(F.broadcast(names.select(slot).distinct()), "slot", "left_semi").select(*KEY, "g").distinct()  # SLOTS numbers at most
    pairs = grams.join(names, "g").select(*KEY, "name", "aliases", "neg").distinct()
    hit = "(contains(l, name) OR exists(aliases, a -> contains(l, a))) AND NOT exists(neg, x -> contains(l, x))"
    n = F.expr(f"cast(size(filter(split(text, '\\n'), l -> {hit})) AS bigint)")
    return pairs.join(sections, KEY).select("corpus", "name", "seq", n.alias("lines")).where(F.col("lines") > 0)


def cadence(found: DataFrame, roster: DataFrame, sections: DataFrame) -> DataFrame:
    """(corpus, name, sections, lines, first, last, max_gap, tail_gap); names never met have nulls and zeros."""
    gaps = previous(found, ["corpus", "name"], "seq").withColumn("gap", F.col("seq") - F.col("before"))
    by_name = gaps.groupBy("corpus", "name").agg(F.count(F.lit(1)).alias("sections"), F.sum("lines").alias("lines"), F.min("seq").alias("first"), F.max("seq").alias("last"), F.coalesce(F.max("gap"), F.lit(0)).cast("bigint").alias("max_gap"))
    ends = sections.groupBy("corpus").agg(F.max("seq").alias("end"))
    every = product(ends, roster.select("name").distinct())  # each name is reported for each corpus
    out = every.join(by_name, ["corpus", "name"], "left")
    return out.select("corpus", "name", F.coalesce("sections", F.lit(0)).cast("bigint").alias("sections"), F.coalesce("lines", F.lit(0)).cast("bigint").alias("lines"), "first", "last", "max_gap", (F.col("end") - F.col("last")).alias("tail_gap"))


def cadence_violations(rhythm: DataFrame, max_gap: int = 100, tail: int = 100) -> DataFrame:
    """(corpus, name, rule, value): gaps and tails that are too long, names never met."""
    kinds = F.array(
        F.when(F.col("max_gap") >= max_gap, F.struct(F.lit("gap").alias("rule"), F.col("max_gap").alias("value"))),
        F.when(F.col("tail_gap") >= tail, F.struct(F.lit("tail").alias("rule"), F.col("tail_gap").alias("value"))),
        F.when(F.col("sections") == 0, F.struct(F.lit("zero").alias("rule"), F.lit(0).cast("bigint").alias("value"))),
    )
    return rhythm.select("corpus", "name", F.explode(F.array_compact(kinds)).alias("x")).select("corpus", "name", "x.rule", "x.value")


def ratchet(current: DataFrame, baseline: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, prior, value, status): new or worse than the baseline; others pass."""
    prior = baseline.select(*keys, F.col(value).alias("prior"))
    status = F.when(F.col("prior").isNull(), "new").when(F.col(value) > F.col("prior"), "worse").otherwise("pass")
    return current.join(prior, keys, "left").select(*keys, "prior", value, status.alias("status"))
