"""Text tables, metrics by section, rollups by range, drift against a snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusqa.functions.text import body, char_count, occurrences, para_kind, sentence_list, solid, visible_length
from corpusqa.operators.intervals import covering
from corpusqa.schemas import LATIN, MARKS_ONLY, SPACES, LangPack
from corpusqa.sources import cut

KEY = ["corpus", "seq"]
KINDS = ("all", "narrative", "quote")


def paragraphs(sections: DataFrame, pack: LangPack = LATIN) -> DataFrame:
    """(corpus, seq, pos, para, kind, n_chars): trimmed lines that are neither blank nor headings; white space does not count as characters."""
    lines = sections.select(*KEY, F.posexplode(F.transform(F.split("text", "\n"), lambda l: F.btrim(l, F.lit(SPACES)))).alias("pos", "para")).where((F.col("para") != "") & ~F.col("para").startswith("#"))
    return lines.select(*KEY, F.col("pos").cast("bigint").alias("pos"), "para", para_kind(F.col("para"), pack.openers).alias("kind"), visible_length(F.col("para")).cast("bigint").alias("n_chars"))


def sentences(sections: DataFrame, min_len: int = 8, pack: LangPack = LATIN) -> DataFrame:
    """(corpus, seq, sent) of at least ``min_len`` characters without white space; headings and sentences of marks only are left out."""
    return sections.select(*KEY, F.explode(sentence_list(F.col("text"), pack.terminators, min_len)).alias("sent"))


def measure(rows: DataFrame, keys: list[str], pack: LangPack = LATIN, marks: tuple[str, str, str] | None = None, short: int = 20, min_len: int = 8) -> DataFrame:
    """All that the metrics need of a text, as expressions over its row: one pass, nothing is exploded or shuffled.

    keys, chars, hits of the pack's pattern, opens, closes and half-width quotes (``marks``, by default the
    pack's), paragraphs, their characters and short ones by kind, and the hashes of the sentences.  A null
    text has none of anything.
    """
    opener, closer, half = marks or (pack.openers[0], pack.closers[0], '"')
    n = lambda c: occurrences(F.col("text"), F.lit(c))
    parts = rows.select(*keys, F.coalesce("text", F.lit("")).alias("text"), solid(F.coalesce("text", F.lit("")), "\n").alias("solid"))
    ps = F.filter(F.split("solid", "\n"), lambda l: (l != "") & ~l.startswith("#"))
    sents = F.filter(F.split("solid", pack.terminators), lambda s: (F.length(s) >= min_len) & ~s.startswith("#") & ~s.rlike(MARKS_ONLY))
    parts = parts.select(
        *keys, F.when(F.col("text").contains("#"), char_count(F.col("text"))).alias("chars"), F.regexp_count(body(F.col("text")), F.lit(pack.negation)).cast("bigint").alias("hits"), n(opener).alias("opens"), n(closer).alias("closes"), n(half).alias("half"),
        F.transform(ps, lambda p: F.struct((para_kind(p, pack.openers) == "quote").alias("q"), F.length(p).cast("bigint").alias("n"))).alias("ps"),
        F.transform(sents, lambda s: F.struct(F.xxhash64(s).alias("h"), F.hash(s).alias("g"))).alias("sents"),
    )
    stats = []
    for kind in KINDS:
        mine = {"all": F.col("ps"), "narrative": F.filter("ps", lambda p: ~p["q"]), "quote": F.filter("ps", lambda p: p["q"])}[kind]
        total = F.aggregate(mine, F.lit(0).cast("bigint"), lambda a, p: a + p["n"])
        stats += [F.size(mine).cast("bigint").alias(f"n_{kind}"), total.alias(f"chars_{kind}"), F.size(F.filter(mine, lambda p: p["n"] < short)).cast("bigint").alias(f"short_{kind}")]
    counted = F.coalesce("chars", "chars_all").alias("chars")  # without headings, all characters are in paragraphs
    return parts.select(*keys, *(c for c in parts.columns if c not in keys), *stats).select(*keys, counted, "hits", "opens", "closes", "half", *(f"{what}_{kind}" for kind in KINDS for what in ("n", "chars", "short")), "sents")


def paragraph_stats(sections: DataFrame, pack: LangPack = LATIN, short: int = 20) -> DataFrame:
    """Per section with paragraphs: paragraphs, characters and short paragraphs, in all and by kind."""
    return measure(sections, KEY, pack, short=short).select(*KEY, *(f"{what}_{kind}" for kind in KINDS for what in ("n", "chars", "short"))).where("n_all > 0")


def per_10k(counted: DataFrame) -> DataFrame:
    return counted.withColumn("per_10k", F.expr("if(chars = 0, 0, hits * 10000 div chars)").cast("bigint"))


def pattern_density(sections: DataFrame, pattern: str) -> DataFrame:
    """Per section: hits of a pattern outside headings and hits in 10,000 characters."""
    n, chars = F.regexp_count(body(F.col("text")), F.lit(pattern)).cast("bigint"), char_count(F.col("text"))
    return per_10k(sections.select(*KEY, n.alias("hits"), chars.alias("chars")))


def repeated_sentences(sections: DataFrame, min_count: int = 3, min_len: int = 8, pack: LangPack = LATIN) -> DataFrame:
    """(corpus, sent, n, n_sections) of sentences that a corpus has ``min_count`` times or more."""
    return sentences(sections, min_len, pack).groupBy("corpus", "sent").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("seq").alias("n_sections")).where(F.col("n") >= min_count)


def repeats_of(measured: DataFrame, min_count: int = 3) -> DataFrame:
    """(corpus, seq, dups): occurrences of sentences that the corpus has ``min_count`` times or more, by the hashes that ``measure`` took."""
    each = measured.select(*KEY, F.explode("sents").alias("s")).groupBy(*KEY, "s").agg(F.count(F.lit(1)).alias("k"))
    total = each.groupBy("corpus", "s").agg(F.sum("k").alias("n")).where(F.col("n") >= min_count)
    return each.join(total, ["corpus", "s"]).groupBy(*KEY).agg(F.sum("k").alias("dups"))


def repeat_hits(sections: DataFrame, min_count: int = 3, pack: LangPack = LATIN) -> DataFrame:
    """Per section: occurrences of repeated sentences, and their density."""
    measured = cut(measure(sections, KEY, pack).select(*KEY, "chars", "sents"))
    out = measured.join(repeats_of(measured, min_count), KEY, "left")
    return per_10k(out.select(*KEY, F.coalesce("dups", F.lit(0)).cast("bigint").alias("hits"), "chars"))


def lexicon_counts(sections: DataFrame, terms: tuple[str, ...]) -> DataFrame:
    """(corpus, seq, term, n) of the terms that a section has; a fixed list, so no join is needed."""
    pairs = F.array(*(F.struct(F.lit(t).alias("term"), occurrences(F.col("text"), F.lit(t)).alias("n")) for t in terms))
    return sections.select(*KEY, F.explode(F.filter(pairs, lambda x: x["n"] > 0)).alias("x")).select(*KEY, "x.term", "x.n")


def quote_hygiene(sections: DataFrame, opener: str = "(", closer: str = ")", half: str = '"') -> DataFrame:
    """Per corpus: openers, closers, half-width quotes, and what stays unpaired."""
    count = lambda c: F.sum(occurrences(F.col("text"), F.lit(c)))
    out = sections.groupBy("corpus").agg(count(opener).alias("opens"), count(closer).alias("closes"), count(half).alias("half"))
    return out.withColumn("unpaired", F.abs(F.col("opens") - F.col("closes")))


def in_ranges(rows: DataFrame, ranges: DataFrame, key: list[str]) -> DataFrame:
    """The rows whose seq lies in any (lo, hi), once each."""
    return rows.join(covering(rows, ranges.select("lo", "hi")).select("seq").distinct(), "seq", "left_semi").select(*key)


def budget_status(sections: DataFrame, ranges: DataFrame, floor: int, ceiling: int, exempt_ceiling: int, new_from: int) -> DataFrame:
    """(corpus, seq, chars, exempt, status): under the floor, over the ceiling that holds, or ok.  ``sections`` have a text, or chars already."""
    measured = sections.select(*KEY, F.col("chars") if "chars" in sections.columns else char_count(F.col("text")).alias("chars"))
    listed = covering(measured, ranges.select("lo", "hi")).select("seq", F.lit(True).alias("listed")).distinct()
    joined = measured.join(listed, "seq", "left").withColumn("exempt", F.coalesce("listed", F.lit(False)) | (F.col("seq") >= new_from))
    status = F.when(F.col("chars") < floor, "under").when(~F.col("exempt") & (F.col("chars") > ceiling), "over").when(F.col("exempt") & (F.col("chars") > exempt_ceiling), "exempt_over").otherwise("ok")
    return joined.select(*KEY, "chars", "exempt", status.alias("status"))


def section_metrics(measured: DataFrame, budget: DataFrame | None = None) -> DataFrame:
    """What a rollup needs of each section, from its measures (``measure``, with corpus and seq): these, its repeats and its budget class.

    The measures are read more than once: they should be written ones (``cut``).
    """
    out = measured.drop("sents").join(repeats_of(measured), KEY, "left")
    if budget is None:
        out = out.withColumns({"status": F.lit("ok"), "exempt": F.lit(False)})
    else:
        out = out.join(budget.select(*KEY, "status", "exempt"), KEY, "left")
    return out.na.fill(0).na.fill({"status": "ok", "exempt": False})


#: Metrics of a rollup with the direction in which they get worse and their tolerance.
TOLERANCES = [
    ("short_pct", "up", 2), ("nar_mean", "down", 3), ("nar_short_pct", "up", 3), ("quote_mean", "down", 2), ("hits_10k", "up", 2), ("dups_10k", "up", 2),
    ("half", "up", 0), ("unpaired", "up", 0), ("under_floor", "up", 0), ("over_ceil", "up", 0), ("over_exempt", "up", 0),
]


def rollup_metrics(metrics: DataFrame, volumes: DataFrame) -> DataFrame:
    """One row for each (corpus, volume) and one for the whole corpus (vol null, label ``total``), in one aggregation.

    Volumes may overlap or leave sections out; the total has each section once.
    """
    total = lambda c: F.sum(c).alias(c)
    sums = [F.count(F.lit(1)).alias("sections"), F.min("chars").alias("min_chars"), F.max("chars").alias("max_chars")]
    sums += [total(c) for c in ("chars", "hits", "dups", "half", "opens", "closes")]
    sums += [total(f"{what}_{kind}") for kind in ("all", "narrative", "quote") for what in ("n", "chars", "short")]
    sums += [F.count_if(F.col("status") == status).alias(name) for status, name in (("under", "under_floor"), ("over", "over_ceil"), ("exempt_over", "over_exempt"))] + [F.count_if("exempt").alias("exempt")]
    held = covering(metrics, volumes.select("vol", "lo", "hi")).groupBy("seq").agg(F.collect_list(F.col("vol").cast("bigint")).alias("vols"))
    every = F.concat(F.array(F.lit(None).cast("bigint")), F.coalesce("vols", F.array().cast("array<bigint>")))  # the total, and each volume
    out = metrics.join(held, "seq", "left").withColumn("vol", F.explode(every)).groupBy("corpus", "vol").agg(*sums)
    div = lambda a, b, k=1: F.expr(f"if({b} = 0, 0, {a} * {k} div {b})").cast("bigint")
    return out.select(
        "corpus", "vol", F.when(F.col("vol").isNull(), "total").otherwise(F.concat(F.lit("v"), F.col("vol").cast("string"))).alias("label"), "sections", "chars", "min_chars", "max_chars", "hits", "dups", "half",
        F.abs(F.col("opens") - F.col("closes")).alias("unpaired"), "under_floor", "over_ceil", "over_exempt", "exempt", F.col("n_all").alias("paras"), F.col("n_quote").alias("quotes"),
        div("chars", "sections").alias("mean_chars"), div("hits", "chars", 10000).alias("hits_10k"), div("dups", "chars", 10000).alias("dups_10k"),
        div("chars_all", "n_all").alias("mean_para"), div("short_all", "n_all", 100).alias("short_pct"), div("chars_narrative", "n_narrative").alias("nar_mean"), div("short_narrative", "n_narrative", 100).alias("nar_short_pct"),
        div("chars_quote", "n_quote").alias("quote_mean"), div("short_quote", "n_quote", 100).alias("quote_short_pct"), div("n_quote", "n_all", 100).alias("quote_pct"),
    )


def top_k(df: DataFrame, by: str, k: int, part: list[str], tie: str) -> DataFrame:
    """The first ``k`` rows of each part by ``by`` descending, then ``tie``."""
    w = Window.partitionBy(*part).orderBy(F.desc(by), F.asc(tie))
    return df.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)


def unpivot(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    return df.unpivot(keys, metrics, "metric", "value")


def metric_drift(now: DataFrame, prior: DataFrame, tolerances: list[tuple[str, str, int]], keys: list[str]) -> DataFrame:
    """(keys, metric, now, prior, delta, bad): bad where a metric moves the worse way beyond its tolerance."""
    names = [t[0] for t in tolerances]
    a = unpivot(now.select(*keys, *(F.col(m).cast("bigint").alias(m) for m in names)), keys, names).withColumnRenamed("value", "now")
    b = unpivot(prior.select(*keys, *(F.col(m).cast("bigint").alias(m) for m in names)), keys, names).withColumnRenamed("value", "prior")
    rules = now.sparkSession.createDataFrame(tolerances, "metric STRING, worse STRING, tolerance BIGINT")
    joined = a.join(b, [*keys, "metric"]).join(F.broadcast(rules), "metric").withColumn("delta", F.col("now") - F.col("prior"))
    bad = F.when(F.col("worse") == "up", F.col("delta") > F.col("tolerance")).otherwise(F.col("delta") < -F.col("tolerance"))
    return joined.select(*keys, "metric", "now", "prior", "delta", bad.alias("bad"))


def extremes(metrics: DataFrame, floor: int, first: int = 24) -> DataFrame:
    """Per corpus: shortest and longest section, the first sections under the floor and how many more."""
    ends = metrics.groupBy("corpus").agg(F.min(F.struct("chars", "seq")).alias("s"), F.max(F.struct("chars", F.negative("seq").alias("m"))).alias("l"), F.count_if(F.col("chars") < floor).alias("under"))
    low = metrics.where(F.col("chars") < floor)
    kept = low.withColumn("r", F.row_number().over(Window.partitionBy("corpus").orderBy("seq"))).where(F.col("r") <= first)
    listed = kept.groupBy("corpus").agg(F.array_join(F.transform(F.array_sort(F.collect_list("seq")), lambda x: x.cast("string")), ",").alias("listed"))
    out = ends.join(listed, "corpus", "left")
    return out.select("corpus", F.col("s.seq").alias("shortest"), F.col("s.chars").alias("min_chars"), (-F.col("l.m")).alias("longest"), F.col("l.chars").alias("max_chars"), "under", F.coalesce("listed", F.lit("")).alias("listed"), F.greatest(F.col("under") - first, F.lit(0)).cast("bigint").alias("more"))


def compare_states(before: DataFrame, after: DataFrame, pack: LangPack = LATIN) -> DataFrame:
    """Paragraph counts of the changed sections before and after, by corpus."""
    old = before.select(*KEY, F.md5("text").alias("old_md5"))
    changed = after.select(*KEY, F.md5("text").alias("md5")).join(old, KEY).where("md5 <> old_md5").select(*KEY)
    sums = lambda df, tag: paragraph_stats(df.join(changed, KEY, "left_semi"), pack).groupBy("corpus").agg(F.count(F.lit(1)).alias(f"sections_{tag}"), F.sum("n_all").alias(f"paras_{tag}"), F.sum("chars_all").alias(f"chars_{tag}"), F.sum("short_all").alias(f"short_{tag}"))
    return sums(before, "before").join(sums(after, "after"), "corpus")
