"""Document fingerprints from spot signatures, with DataFrame functions only.

An anchor is a common word of one of four languages; its signature is the chain of that word and
the ``CHAIN`` content words (words that are no anchors) that follow it.  The fingerprint is the set
of a text's signatures, as ascending 64-bit hashes; a text with fewer than ``LEAST`` chains also has
the runs of ``CHAIN + 1`` words as signatures (or of all its words, if fewer).  Two fingerprints are compared by Jaccard likeness.  ``near_pairs`` deals
fingerprints out by set length, so that only sets in the same or the next length class can reach
the threshold, and looks for partners through each set's rarest signatures only.

Defined results: null text counts as empty; an empty text has the fingerprint of no words, so that
empty texts are alike; equal texts have equal fingerprints; repeated rows give repeated rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions

#: Common words of English, French, German and Spanish.
ANCHORS = (
    "a an and are as at be been but by can did do for from had has have he her his i if in is it its more no not of on or she so "
    "that the their there they this to was we were what when which who will with you your "
    "au aux avec ce cette ces dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas pour qu que qui "
    "sa se ses son sur un une vous "
    "am auch auf aus bei das dass dem den der die ein eine einen einer es für hat ich im ist mit nach nicht noch nur oder sein sich "
    "sie sind über um und von vor war wie wir wird zu zum zur "
    "al como con del el ella ellos era esta este esto fue ha hay las lo los más me mi muy nos para pero por sin sobre su sus también una unos y ya"
).split()
CHAIN = 2
LEAST = 8


def with_signatures(docs: DataFrame, text: str, name: str) -> DataFrame:
    """Add the signature set of column ``text`` as ``name`` (array<bigint>)."""
    anchors = ", ".join(f"'{w}'" for w in sorted(set(ANCHORS)))
    chain = ", ".join(f"get(content, i - j + {k})" for k in range(CHAIN))
    return (
        docs.withColumn("words", F.expr(f"filter(split(lower(coalesce(`{text}`, '')), '[^\\\\p{{L}}\\\\p{{N}}]+'), w -> w != '')"))
        .withColumn("at", F.expr(f"filter(transform(words, (w, i) -> if(w IN ({anchors}), i, -1)), i -> i >= 0)"))
        .withColumn("content", F.expr(f"filter(words, w -> w NOT IN ({anchors}))"))
        .withColumn("chains", F.expr(f"transform(filter(transform(at, (i, j) -> named_struct('i', i, 'j', j)), x -> x.i - x.j + {CHAIN} <= size(content)), x -> xxhash64(get(words, x.i), {chain.replace('i - j', 'x.i - x.j')}))"))
        # few anchors: every word is one, too
        .withColumn("more", F.expr(f"if(size(chains) < {LEAST}, transform(sequence(0, greatest(size(words) - {CHAIN}, 1) - 1), i -> xxhash64('', slice(words, i + 1, {CHAIN + 1}))), array())"))
        .withColumn(name, F.expr("array_sort(array_distinct(concat(chains, more)))"))
        .drop("words", "at", "content", "chains", "more")
    )


def fingerprint(signatures: str) -> Column:
    """The set as a string: hexadecimal signatures in order."""
    return F.expr(f"array_join(transform({signatures}, s -> hex(s)), '')")


def likeness(a: str, b: str) -> Column:
    """Jaccard likeness of two signature sets."""
    return F.expr(f"cast(size(array_intersect({a}, {b})) AS double) / (size({a}) + size({b}) - size(array_intersect({a}, {b})))")


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Add ``next_<column>`` of the next row by (doc_id, text), null ids first; the last row's next is the first.

    Rows are dealt out by ranges of doc_id (one shuffle); the first row of each range is looked up
    for the range before it.
    """
    n = partitions(docs.sparkSession)
    bounds = sorted(set(docs.where("doc_id IS NOT NULL").stat.approxQuantile("doc_id", [k / n for k in range(1, n)], 0.2 / n)))
    listed = ", ".join(f"{int(b)}L" for b in bounds)
    part = F.expr(f"if(doc_id IS NULL, -1, size(filter(array({listed}), b -> b <= doc_id)))" if bounds else "if(doc_id IS NULL, -1, 0)")
    dealt = docs.withColumn("part", part)
    order = [F.asc_nulls_first("doc_id"), F.asc_nulls_first("text")]
    firsts = dealt.groupBy("part").agg(F.min("doc_id").alias("first_id"))  # a row for each range
    wide = Window.partitionBy(F.lit(0)).orderBy("part")
    firsts = firsts.select("first_id", F.coalesce(F.lag("part").over(wide), F.last("part").over(wide.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("part"))
    heads = docs.join(F.broadcast(firsts), F.col("doc_id").eqNullSafe(F.col("first_id"))).groupBy("part").agg(F.min_by(F.struct(*columns), F.struct(F.col("text").isNotNull(), "text")).alias("head"))
    within = Window.partitionBy("part").orderBy(*order)
    led = dealt.withColumns({f"led_{c}": F.lead(c).over(within) for c in columns} | {"inner": F.lead(F.lit(True)).over(within)})
    out = led.join(heads, "part", "left")
    return out.withColumns({f"next_{c}": F.when(F.col("inner"), F.col(f"led_{c}")).otherwise(F.col(f"head.{c}")) for c in columns}).drop("part", "head", "inner", *(f"led_{c}" for c in columns))


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, whose last quarter is the next text's beginning."""
    signed = with_signatures(docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text")), "text", "signs")
    paired = with_next(signed, ["text", "signs"])
    edited = paired.withColumn("n_chars", F.length("text").cast("long")).withColumn(
        "edited", F.expr("concat(left(text, cast(n_chars - n_chars div 4 AS int)), left(next_text, cast(n_chars div 4 AS int)))")
    )
    edited = with_signatures(edited.drop("text", "next_text"), "edited", "edited_signs")
    return edited.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint("signs").alias("fingerprint"),
        fingerprint("edited_signs").alias("edited_fingerprint"),
        likeness("signs", "edited_signs").alias("near_edited"),
        likeness("signs", "next_signs").alias("near_next"),
    )


def near_pairs(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Pairs (a, b, likeness) of documents whose fingerprints reach ``threshold``.

    Equal fingerprints are collapsed first: pairs are between the smallest doc_id of each class.
    Use ``classes`` for the membership.
    """
    sets = classes(docs).groupBy("class_id").agg(F.first("signs").alias("signs")).withColumn("n", F.size("signs"))
    # Sets of class k can reach the threshold with sets of the classes k and k + 1 only.
    sets = sets.withColumn("length_class", F.floor(F.log(F.col("n").cast("double")) / F.lit(-math.log(threshold)) + 1e-9))
    each = sets.select("class_id", "n", "length_class", F.explode("signs").alias("sign"))
    rarity = each.groupBy("sign").agg(F.count(F.lit(1)).alias("df"))
    ranked = each.join(rarity, "sign").withColumn("rank", F.row_number().over(Window.partitionBy("class_id").orderBy("df", "sign")))
    prefix = ranked.where(F.col("rank") <= F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1).where("df > 1")
    left = prefix.select(F.col("class_id").alias("a"), F.col("n").alias("n_a"), F.col("length_class").alias("class"), "sign", F.col("rank").alias("rank_a"))
    right = prefix.select(F.col("class_id").alias("b"), F.col("n").alias("n_b"), F.explode(F.array(F.col("length_class"), F.col("length_class") - 1)).alias("class"), "sign", F.col("rank").alias("rank_b"))
    met = left.join(right, ["class", "sign"]).where((F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b"))))
    met = met.where(F.col("n_a") >= F.lit(threshold - 1e-9) * F.col("n_b"))
    # What is left in both sets after this signature must suffice.
    room = 1 + F.least(F.col("n_a") - F.col("rank_a"), F.col("n_b") - F.col("rank_b")) + F.least(F.col("rank_a"), F.col("rank_b")) - 1
    met = met.where(room >= F.lit(threshold / (1 + threshold) - 1e-9) * (F.col("n_a") + F.col("n_b"))).select("a", "b").distinct()
    met = met.join(sets.select(F.col("class_id").alias("a"), F.col("signs").alias("x")), "a").join(sets.select(F.col("class_id").alias("b"), F.col("signs").alias("y")), "b")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), likeness("x", "y").alias("likeness")).where(F.col("likeness") >= threshold - 1e-12)


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, signs and class_id, the smallest doc_id with the same fingerprint."""
    signed = with_signatures(docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text"), "text", "signs").drop("text")
    least = signed.groupBy(F.sha2(fingerprint("signs"), 256).alias("digest")).agg(F.min("doc_id").alias("class_id"))
    return signed.withColumn("digest", F.sha2(fingerprint("signs"), 256)).join(least, "digest").drop("digest")
