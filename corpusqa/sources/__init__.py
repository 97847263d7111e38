"""Readers and writers of sections, ledgers, snapshots and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusqa.schemas import NUMERALS


def numbered(df: DataFrame, part: str, order: str, name: str = "seq") -> DataFrame:
    """Number the rows of each ``part`` from 1 by ``order``, however many one part has.

    ``order`` is a numeric column.  Rows are dealt out by ranges of it as well, so that a part with
    very many rows is no single group; the rows of earlier ranges are counted and added.  Null
    orders come first; ties keep an arbitrary order.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = sorted(set(df.where(F.col(order).isNotNull()).stat.approxQuantile(order, [k / n for k in range(1, n)], 0.2 / n))) if n > 1 else []
    listed = ", ".join(repr(b) for b in bounds)
    cell = F.expr(f"if({order} IS NULL, -1, size(filter(array({listed}), b -> b <= {order})))") if bounds else F.lit(0)
    dealt = df.withColumn("_cell", cell)
    counts = dealt.groupBy(part, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(part).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.row_number().over(Window.partitionBy(part, "_cell").orderBy(F.asc_nulls_first(order)))
    ranked = dealt.withColumn("_rank", within)
    same = ranked[part].eqNullSafe(before[part]) & (ranked["_cell"] == before["_cell"])
    return ranked.join(before.select(part, "_cell", "_before"), same).select(*(ranked[c] for c in df.columns if c != name), (F.col("_rank") + F.col("_before")).cast("bigint").alias(name))


def sections_from_table(df: DataFrame, corpus: str, order: str, text: str) -> DataFrame:
    """(corpus, seq, doc_id, text): a table's rows as ordered sections."""
    rows = df.select(F.col(corpus).alias("corpus"), F.col(order).alias("doc_id"), F.col(text).alias("text"))
    return numbered(rows, "corpus", "doc_id")


def read_sections(spark: SparkSession, path: str) -> DataFrame:
    """(corpus, seq, text) of ``<path>/<corpus>/chapter-<n>.md``; other files are left out."""
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).withColumn("file", F.col("_metadata.file_path"))
    found = files.where(F.col("file").rlike(r"/chapter-\d+\.md$"))
    return found.select(F.regexp_extract("file", r"([^/]+)/chapter-\d+\.md$", 1).alias("corpus"), F.regexp_extract("file", r"chapter-(\d+)\.md$", 1).cast("bigint").alias("seq"), F.col("value").alias("text"))


def read_ledger(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row for each JSON ledger with an explicit schema; ``_corrupt_record`` holds what doesn't parse."""
    return spark.read.schema(f"{schema}, _corrupt_record STRING").option("multiLine", "true").option("mode", "PERMISSIVE").json(path)


def ledger_findings(ledger: DataFrame, expected: DataFrame, key: str = "corpus") -> DataFrame:
    """(key, rows, finding) of every key of ``expected``: ``invalid`` where its ledger doesn't parse, ``not_applicable`` where it has none."""
    field = next(c for c in ledger.columns if c not in (key, "_corrupt_record"))
    read = ledger.groupBy(key).agg(F.count(field).alias("rows"), F.count("_corrupt_record").alias("bad"))
    out = expected.select(key).distinct().join(read, key, "left")
    finding = F.when(F.col("bad").isNull(), "not_applicable").when(F.col("bad") > 0, "invalid").otherwise("read")
    return out.select(key, F.coalesce("rows", F.lit(0)).cast("bigint").alias("rows"), finding.alias("finding"))


def declared_titles(df: DataFrame, text: str = "text", by: str = "corpus", order: str | None = None) -> DataFrame:
    """(corpus, seq, title) of every ``第N章《T》`` in outline texts; the first of a number holds (of several texts, the first by ``order``)."""
    rx = "第\\\\s*(\\\\d+)\\\\s*章[^《\\n]{0,6}《([^》\\n]+)》"
    pairs = df.select(by, (F.col(order) if order else F.lit(0)).alias("_order"), F.posexplode(F.expr(f"arrays_zip(regexp_extract_all({text}, '{rx}', 1), regexp_extract_all({text}, '{rx}', 2))")).alias("pos", "x"))
    pairs = pairs.select(by, F.struct("_order", "pos").alias("pos"), F.col("x.0").cast("bigint").alias("seq"), F.col("x.1").alias("title"))
    return pairs.groupBy(by, "seq").agg(F.min_by("title", "pos").alias("title"))


def volumes_from_declared(declared: DataFrame) -> DataFrame:
    """(corpus, vol, lo, hi) from declared sections (corpus, vol, seq)."""
    return declared.groupBy("corpus", "vol").agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"))


def numeral(col: Column) -> Column:
    """A volume number in CJK numerals or digits."""
    table = F.create_map(*(F.lit(x) for kv in NUMERALS.items() for x in kv))
    return F.coalesce(table[col], col.try_cast("int"))


def volumes_from_text(df: DataFrame, text: str = "text") -> DataFrame:
    """(corpus, vol, lo, hi) of ``第N卷：M章（第A—B章）`` lines."""
    rx = r"第([一二三四五六七八九十\d]+)卷[^（(\n]{0,40}[（(]第?(\d+)\s*[—\-–~～至]+\s*(\d+)\s*章"
    lines = df.select("corpus", F.explode(F.split(text, "\n")).alias("line")).where(F.col("line").rlike(rx))
    return lines.select("corpus", numeral(F.regexp_extract("line", rx, 1)).cast("bigint").alias("vol"), F.regexp_extract("line", rx, 2).cast("bigint").alias("lo"), F.regexp_extract("line", rx, 3).cast("bigint").alias("hi")).distinct()


def first_volumes(*sources: DataFrame) -> DataFrame:
    """The volumes of the first source that has any for a corpus."""
    out = sources[0]
    for more in sources[1:]:
        out = out.unionByName(more.join(out.select("corpus").distinct(), "corpus", "left_anti"))
    return out


def build_roster(*named: DataFrame, min_len: int = 2, max_len: int = 6, exclude: str | None = None) -> DataFrame:
    """(name, groups): names (name, group) of several sources, trimmed and filtered, with their groups in order."""
    every = named[0].select("name", "group")
    for more in named[1:]:
        every = every.unionByName(more.select("name", "group"))
    every = every.withColumn("name", F.trim("name")).where(F.length("name").between(min_len, max_len))
    if exclude:
        every = every.where(~F.col("name").rlike(exclude))
    return every.groupBy("name").agg(F.array_sort(F.collect_set("group")).alias("groups"))


def table_cells(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, pos, run, cells) of ``|`` table lines; a run ends at any other line."""
    lines = df.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    is_row = F.trim("line").startswith("|")
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("run", F.sum(F.when(is_row, 0).otherwise(1)).over(w).cast("bigint")).where(is_row)
    cells = F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"\|"), F.trim)
    return marked.select(key, F.col("pos").cast("bigint").alias("pos"), "run", cells.alias("cells"))


def seat_holders(cells: DataFrame, key: str, vacant: str = "空|虚位|—|-") -> DataFrame:
    """(key, seat, name) from ranked tables whose second column is the name; vacant seats are skipped."""
    rows = cells.where(F.size("cells") >= 2).select(key, F.col("cells")[0].alias("seat"), F.col("cells")[1].alias("name"))
    return rows.where((F.col("name") != "") & ~F.col("name").rlike(f"^(?:{vacant}|-+|:?-+:?)$") & F.col("seat").rlike(r"\d"))


def publish(df: DataFrame, path: str, key: str = "corpus") -> None:
    """Replace the mirrored partitions of the corpora at hand; other corpora stay (A7, C13)."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def write_report(findings: DataFrame, path: str, kind: str = "json") -> None:
    """A machine-readable report of findings."""
    findings.write.mode("overwrite").format(kind).save(path)


def parse_progress(df: DataFrame, text: str = "text") -> DataFrame:
    """Add stage, current, total (null where absent) and status from a progress text."""
    num = lambda rx: F.regexp_extract(text, rx, 1).try_cast("bigint")
    return df.withColumns(
        {
            "stage": num(r"(?:当前阶段|stage)[^\d\n]{0,12}(\d+)"),
            "current": num(r"(?:当前章节|current)[^\d\n]{0,12}(\d+)"),
            "total": num(r"(?:总章数|total)[^\d\n]{0,12}(\d+)"),
            "status": F.nullif(F.trim(F.regexp_extract(text, r"(?:状态|status)\s*[：:]\s*([^\n]+)", 1)), F.lit("")),
        }
    )


def catalog(sections: DataFrame, progress: DataFrame) -> DataFrame:
    """One row for each corpus: sections, progress and its percentage."""
    counted = sections.groupBy("corpus").agg(F.count(F.lit(1)).alias("sections"))
    joined = counted.join(progress, "corpus", "left").withColumns({"current": F.coalesce("current", F.lit(0).cast("bigint")), "total": F.coalesce("total", F.lit(0).cast("bigint"))})
    percent = F.when(F.col("total") <= 0, 0).otherwise(F.least(F.lit(100), F.floor((F.col("current") * 200 + F.col("total")) / (F.col("total") * 2))))
    return joined.withColumn("percent", percent.cast("bigint")).select("corpus", "sections", "current", "total", "percent")


def upsert(base: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """``base`` with the rows of ``incoming`` in place of those with their key; the last duplicate holds."""
    rows = incoming.groupBy(key).agg(F.max_by(F.struct(*incoming.columns), order).alias("r")).select("r.*")
    return base.join(rows.select(key), key, "left_anti").unionByName(rows.select(*base.columns))


def default_id(title: Column, given: Column) -> Column:
    """The given id, else the title with white space as hyphens."""
    return F.coalesce(F.nullif(given, F.lit("")), F.regexp_replace(F.trim(title), r"\s+", "-"))


def spread(df: DataFrame) -> DataFrame:
    """A scan with fewer splits than the cluster has cores, dealt out to all of them; a larger one stays where it lies."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared scratch folder and read it back (cuts the lineage)."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; a temporary one only where that is unset and all runs in one process."""
    import tempfile
    import uuid

    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"
