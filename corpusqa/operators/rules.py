"""Rules over one row, evaluated together in one pass: their findings are rows of one typed table.

A rule is a condition on the columns of a table (for sections: their measures) with what a finding
tells.  New checks are added as rules, not as scans.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusqa.schemas import FINDINGS


@dataclass(frozen=True)
class Rule:
    """``when`` and ``n`` are SQL expressions over the row, ``subject`` and ``detail`` as well (null if there is nothing to tell)."""

    id: str
    severity: str
    when: str
    n: str = "1"
    subject: str = "cast(null AS string)"
    detail: str = "cast(null AS string)"

    def finding(self) -> Column:
        """The finding of a row, null where the condition is not true."""
        told = F.struct(F.lit(self.id).alias("rule"), F.lit(self.severity).alias("severity"), F.expr(self.subject).cast("string").alias("subject"), F.expr(self.n).cast("bigint").alias("n"), F.expr(self.detail).cast("string").alias("detail"))
        return F.when(F.expr(self.when), told)


def evaluate(rows: DataFrame, rules: Iterable[Rule], corpus: str = "corpus", seq: str = "seq") -> DataFrame:
    """The findings (``FINDINGS``) of all ``rules`` on each row; rows are read once, however many rules there are."""
    rules = list(rules)
    if len({r.id for r in rules}) < len(rules):
        raise ValueError("rules have ids of their own")
    if not rules:
        return rows.sparkSession.createDataFrame([], FINDINGS)
    found = rows.select(F.col(corpus).cast("string").alias("corpus"), F.col(seq).cast("bigint").alias("seq"), F.explode(F.array_compact(F.array(*(r.finding() for r in rules)))).alias("x"))
    return found.select("corpus", "x.rule", "x.severity", "seq", "x.subject", "x.n", "x.detail")


def section_rules(floor: int = 4000, ceiling: int = 5000, fragmented: int = 60, dense: int = 20) -> list[Rule]:
    """What the measures of a section (``metrics.measure``) tell of it alone.

    Lengths are in characters; ``fragmented`` is the percentage of short paragraphs and ``dense`` the hits in 10,000
    characters from which on a section is reported.
    """
    return [
        Rule("under_floor", "fail", f"chars < {floor}", "chars", detail=f"concat(chars, ' < {floor}')"),
        Rule("over_ceiling", "warn", f"chars > {ceiling}", "chars", detail=f"concat(chars, ' > {ceiling}')"),
        Rule("no_paragraph", "fail", "n_all = 0", "0"),
        Rule("unpaired_quotes", "fail", "opens <> closes", "abs(opens - closes)", detail="concat_ws('/', opens, closes)"),
        Rule("half_width_quotes", "warn", "half > 0", "half"),
        Rule("fragmented", "info", f"n_all > 0 AND short_all * 100 >= {fragmented} * n_all", "short_all", detail="concat_ws('/', short_all, n_all)"),
        Rule("dense_pattern", "info", f"hits * 10000 > {dense} * chars", "hits"),
    ]


def verdict(findings: DataFrame) -> DataFrame:
    """(corpus, fails, warns, infos, failed): one row for each corpus that has findings; only those of severity ``fail`` fail it."""
    n = lambda s: F.count_if(F.col("severity") == s)
    out = findings.groupBy("corpus").agg(n("fail").alias("fails"), n("warn").alias("warns"), n("info").alias("infos"))
    return out.withColumn("failed", F.col("fails") > 0)
