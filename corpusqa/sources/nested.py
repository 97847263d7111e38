"""Nested JSON ledgers as tables, with every fault of theirs as a finding.

A ledger is a row (corpus, json).  It is parsed once as a variant; each level is a list of fields with
their type and default.  A field that is absent or null takes its default; one of another type than
its own is a fault, takes the default as well, and leaves the rest of the ledger as it is.
Texts of numbers count as numbers.  A corpus may have several ledgers; their rows add up.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusqa.schemas import FINDINGS

_EMPTY = "cast(array() AS array<string>)"


@dataclass(frozen=True)
class Field:
    """A column, where its value is in an element, its type, and what stands for none (SQL)."""

    name: str
    path: str
    type: str
    default: str = "null"


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(corpus, json) of files in folders ``corpus=<name>``, each file as a whole."""
    return spark.read.text(path, wholetext=True).select(F.col("corpus").cast("string"), F.col("value").alias("json"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(corpus, json) of files with a ledger in each line, which names its corpus itself."""
    return spark.read.text(path).select(F.try_variant_get(F.try_parse_json("value"), "$.corpus", "string").alias("corpus"), F.col("value").alias("json"))


def parsed(ledgers: DataFrame) -> DataFrame:
    """(corpus, at, v, faults): the root of each ledger; one that is no JSON object has the fault and no value."""
    whole = F.when(F.ltrim("json", F.lit(" \t\n\r")).startswith("{"), F.try_parse_json("json"))
    return ledgers.select("corpus", F.lit("$").alias("at"), whole.alias("v")).withColumn("faults", F.when(F.col("v").isNull(), F.array(F.lit("$"))).otherwise(F.expr(_EMPTY)))


def _present(v: str, path: str) -> Column:
    inner = F.try_variant_get(v, path, "variant")
    return inner.isNotNull() & ~F.coalesce(F.is_variant_null(inner), F.lit(True))


def fields(rows: DataFrame, wanted: list[Field]) -> DataFrame:
    """``rows`` with a column for each field; ``faults`` lists the paths of those of another type, too."""
    out = rows
    for f in wanted:
        out = out.withColumn(f.name, F.coalesce(F.try_variant_get("v", f.path, f.type), F.expr(f"cast({f.default} AS {f.type})")))
    wrong = F.array_compact(F.array(*(F.when(_present("v", f.path) & F.try_variant_get("v", f.path, f.type).isNull(), F.concat("at", F.lit(f.path[1:]))) for f in wanted)))
    return out.withColumn("faults", F.concat("faults", wrong))


def elements(rows: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """The elements of an array of each row, with the row's other columns, and (corpus, faults) of rows in which it is none."""
    held = F.try_variant_get("v", path, "array<variant>")
    keep = [c for c in rows.columns if c not in ("at", "v", "faults")]
    out = rows.select(*keep, "at", F.posexplode(held).alias("_i", "v"))
    out = out.select(*keep, F.concat("at", F.lit(path[1:] + "["), "_i", F.lit("]")).alias("at"), "v", F.expr(_EMPTY).alias("faults"))
    wrong = rows.where(_present("v", path) & held.isNull()).select("corpus", F.array(F.concat("at", F.lit(path[1:]))).alias("faults"))
    return out, wrong


def faults_of(ledger: str, expected: DataFrame, ledgers: DataFrame, *levels: DataFrame) -> DataFrame:
    """Findings (``FINDINGS``): corpora of ``expected`` without a ledger (info), ledgers and fields that don't parse (fail), by their path."""
    missing = expected.select(F.col("corpus").cast("string")).distinct().join(ledgers.select("corpus").distinct(), "corpus", "left_anti")
    out = missing.select("corpus", F.lit(f"{ledger}_missing").alias("rule"), F.lit("info").alias("severity"), F.lit(None).cast("string").alias("path"))
    for level in levels:
        each = level.select("corpus", F.explode("faults").alias("path"))
        out = out.unionByName(each.select("corpus", F.when(F.col("path") == "$", f"{ledger}_invalid").otherwise(f"{ledger}_field").alias("rule"), F.lit("fail").alias("severity"), "path"))
    none = F.lit(None)
    return out.select("corpus", "rule", "severity", none.cast("bigint").alias("seq"), F.col("path").alias("subject"), F.lit(1).cast("bigint").alias("n"), none.cast("string").alias("detail")).to(_schema(expected.sparkSession))


def _schema(spark: SparkSession):
    return spark.createDataFrame([], FINDINGS).schema


def custody(ledgers: DataFrame, expected: DataFrame) -> dict[str, DataFrame]:
    """steps (corpus, chain, ch, holder, anchors, handover), terminals (corpus, chain, ch, why, forbid) and findings of custody ledgers.

    A step without a number keeps a null one, which its status reports; anchors stay null where none are listed.
    """
    root = parsed(ledgers)
    chains, wrong_chains = elements(root, "$.chains")
    chains = fields(chains, [Field("chain", "$.id", "string", "'(unnamed)'")])
    steps, wrong_steps = elements(chains.select("corpus", "chain", "at", "v", "faults"), "$.steps")
    steps = fields(steps, [Field("ch", "$.ch", "bigint"), Field("holder", "$.holder", "string"), Field("anchors", "$.anchors", "array<string>"), Field("handover", "$.handover", "array<string>", "array()")])
    ends = chains.where(_present("v", "$.terminal")).select("corpus", "chain", "at", "v", F.expr(_EMPTY).alias("faults"))
    ends = fields(ends, [Field("ch", "$.terminal.ch", "bigint"), Field("why", "$.terminal.why", "string"), Field("forbid", "$.terminal.forbid_after", "array<string>", "array()")])
    return {
        "steps": steps.select("corpus", "chain", "ch", "holder", "anchors", "handover"),
        "terminals": ends.where("ch IS NOT NULL").select("corpus", "chain", "ch", "why", "forbid"),
        "findings": faults_of("custody", expected, ledgers, root, wrong_chains, chains, wrong_steps, steps, ends),
    }


def onsets(ledgers: DataFrame, expected: DataFrame) -> dict[str, DataFrame]:
    """onsets (corpus, name, aliases, first_appearance, first_speech) and findings; a null first_appearance means never."""
    root = parsed(ledgers)
    people, wrong = elements(root, "$.characters")
    people = fields(people, [Field("name", "$.name", "string"), Field("aliases", "$.aliases", "array<string>", "array()"), Field("first_appearance", "$.first_appearance", "bigint"), Field("first_speech", "$.first_speech", "bigint")])
    return {"onsets": people.where("name IS NOT NULL").select("corpus", "name", "aliases", "first_appearance", "first_speech"), "findings": faults_of("onsets", expected, ledgers, root, wrong, people)}


def _step(phase: str):
    """An element of a phase's array as a struct, with where it is."""
    return lambda x, i: F.struct(F.lit(phase).alias("phase"), F.concat("at", F.lit(f".{phase}["), i, F.lit("]")).alias("at"), x.alias("v"), F.lit(None).cast("bigint").alias("end"))


def life_windows(ledgers: DataFrame, expected: DataFrame, last_year: int = 779) -> dict[str, DataFrame]:
    """ends (corpus, end), spans (corpus, vol, lo, hi, year_lo, year_hi), overrides (corpus, seq, year), people (corpus, name, born, ends, node, status),
    landings (corpus, name, phase, seq, year, vol, carrier) and findings of life ledgers.

    Chapters of a volume are ``a-b``; ``to`` is ``from`` where it lacks; a range of landings gives its two ends.
    """
    root = fields(parsed(ledgers), [Field("end", "$.book_end_year", "bigint", str(last_year)), Field("years", "$.chapter_year_overrides", "map<string, bigint>", "map()")])
    vols, wrong_vols = elements(root.select("corpus", "at", "v", "faults"), "$.volume_years")
    vols = fields(vols, [Field("vol", "$.vol", "bigint"), Field("year_lo", "$.from", "bigint"), Field("year_hi", "$.to", "bigint"), Field("chapters", "$.chapters", "string")])
    ends = r"^\s*(\d{1,18})\s*[-—–]\s*(\d{1,18})\s*$"
    ranged = F.coalesce(F.col("chapters").rlike(ends), F.lit(False))
    vols = vols.withColumn("faults", F.when(ranged | F.array_contains("faults", F.concat("at", F.lit(".chapters"))), F.col("faults")).otherwise(F.concat("faults", F.array(F.concat("at", F.lit(".chapters"))))))
    spans = vols.where(ranged).select("corpus", "vol", *(F.regexp_extract("chapters", ends, i).cast("bigint").alias(c) for i, c in ((1, "lo"), (2, "hi"))), "year_lo", F.coalesce("year_hi", "year_lo").alias("year_hi"))
    people, wrong_people = elements(root.select("corpus", "at", "v", "faults"), "$.people")
    people = fields(people, [Field("name", "$.name", "string"), Field("born", "$.birth_year", "bigint"), Field("ends", "$.death_year", "bigint"), Field("node", "$.node", "string"), Field("status", "$.status", "string"), Field("first", "$.landed_range.first", "bigint"), Field("last", "$.landed_range.last", "bigint")])
    # Steps of all phases leave a person in one pass; the ends of a range are steps with nothing but a number.
    listed, wrong = [], [wrong_vols, wrong_people]
    for phase in ("landed", "planned"):
        held = F.try_variant_get("v", f"$.{phase}", "array<variant>")
        listed.append(F.coalesce(F.transform(held, _step(phase)), F.array()))
        wrong.append(people.where(_present("v", f"$.{phase}") & held.isNull()).select("corpus", F.array(F.concat("at", F.lit(f".{phase}"))).alias("faults")))
    listed.append(F.transform(F.array_compact(F.array("first", "last")), lambda n: F.struct(F.lit("range").alias("phase"), F.col("at"), F.lit(None).cast("variant").alias("v"), n.alias("end"))))
    steps = people.select("corpus", "name", F.explode(F.concat(*listed)).alias("x")).select("corpus", "name", "x.phase", "x.at", "x.v", "x.end", F.expr(_EMPTY).alias("faults"))
    steps = fields(steps, [Field("seq", "$.chapter", "bigint"), Field("year", "$.year", "bigint"), Field("vol", "$.vol", "bigint"), Field("carrier", "$.kind", "string", "'in_person'")]).withColumn("seq", F.coalesce("seq", "end"))
    columns = ["corpus", "name", "phase", "seq", "year", "vol", "carrier"]
    return {
        "ends": root.where("v IS NOT NULL").select("corpus", "end"),
        "spans": spans,
        "overrides": root.select("corpus", F.explode("years").alias("seq", "year")).select("corpus", F.col("seq").try_cast("bigint").alias("seq"), "year").where("seq IS NOT NULL"),
        "people": people.where("name IS NOT NULL").select("corpus", "name", "born", "ends", "node", "status"),
        "landings": steps.select(*columns).where("name IS NOT NULL"),
        "findings": faults_of("life", expected, ledgers, root, vols, people, steps, *wrong),
    }


def budget(ledgers: DataFrame, expected: DataFrame) -> dict[str, DataFrame]:
    """budget (corpus, floor, ceiling, exempt_ceiling, new_from), exempt (corpus, lo, hi) and findings; a corpus without a ledger has the defaults.

    An exempt range that is not two numbers is a fault.
    """
    root = fields(parsed(ledgers), [Field("floor", "$.floor", "bigint", "4000"), Field("ceiling", "$.ceilingDefault", "bigint", "5000"), Field("exempt_ceiling", "$.ceilingExempt", "bigint"), Field("new_from", "$.newChaptersFrom", "bigint")])
    ranges, wrong = elements(root.select("corpus", "at", "v", "faults"), "$.exemptRanges")
    ranges = fields(ranges, [Field("range", "$.range", "array<bigint>")])
    two = F.coalesce((F.size("range") == 2) & ~F.exists("range", lambda x: x.isNull()), F.lit(False))
    path = F.concat("at", F.lit(".range"))
    ranges = ranges.withColumn("faults", F.when(two | F.array_contains("faults", path), F.col("faults")).otherwise(F.concat("faults", F.array(path))))
    given = root.where("v IS NOT NULL").select("corpus", "floor", "ceiling", F.coalesce("exempt_ceiling", "ceiling").alias("exempt_ceiling"), "new_from")
    every = expected.select(F.col("corpus").cast("string")).distinct().join(given, "corpus", "left")
    filled = every.select("corpus", F.coalesce("floor", F.lit(4000)).alias("floor"), F.coalesce("ceiling", F.lit(5000)).alias("ceiling"), F.coalesce("exempt_ceiling", F.lit(5000)).alias("exempt_ceiling"), "new_from")
    return {"budget": filled, "exempt": ranges.where(two).select("corpus", F.col("range")[0].alias("lo"), F.col("range")[1].alias("hi")), "findings": faults_of("budget", expected, ledgers, root, ranges, wrong)}
