"""The tables that the registered queries read, and the same as SQL."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from corpusqa.sources import sections_from_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as sections: corpus = source, numbered by doc_id."""
    return sections_from_table(table(spark, sf_dir, "documents"), "source", "doc_id", "text")


def values(spark: SparkSession, schema: str, *rows: tuple) -> DataFrame:
    """A small fixed parameter table, held by the plan: no Python worker is started to read it."""
    fields = StructType.fromDDL(schema)
    return spark.createDataFrame(pa.Table.from_pylist([dict(zip(fields.names, row)) for row in rows], schema=to_arrow_schema(fields)), fields)


def changed(sections: DataFrame) -> DataFrame:
    """A stated perturbation: every 101st document is gone, every 97th ends in ``!``."""
    return sections.where("doc_id % 101 <> 0").withColumn("text", F.when(F.col("doc_id") % 97 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))


#: What of the prose becomes what in CJK prose: sentences end a line, indents are full-width, some words speak.
CJK_MARKS = ((". ", "。”\n\u3000\u3000“"), (", ", "，"), ("que", "道："), ("und", "\u3000说"), ("the", "”他问"), ("of", "“"), ("en", "。"), ("le", "不是甲而是"), ("\n\u3000\u3000“de", "\n\u3000\u3000次日"), ("sch", "……”\n\u3000"), ("pa", "：\n“"))


def cjk(sections: DataFrame) -> DataFrame:
    """Sections as CJK prose, by ``CJK_MARKS``, below a heading; every seventh has a heading amid its text."""
    text = F.col("text")
    for old, new in CJK_MARKS:
        text = F.replace(text, F.lit(old), F.lit(new))
    middle = F.when(F.col("seq") % 7 == 0, F.concat(F.lit("\n## 其二\n\u3000\n"), text)).otherwise("")
    return sections.withColumn("text", F.concat(F.lit("# 第"), F.col("seq").cast("string"), F.lit("章《某》\n\n\u3000\u3000"), text, middle))


def _cjk_sql() -> str:
    text = "text"
    for old, new in CJK_MARKS:
        text = f"replace({text}, '{old}', '{new}')"
    return "csec AS (SELECT corpus, seq, doc_id, '# 第' || seq || '章《某》\n\n\u3000\u3000' || t || CASE WHEN seq % 7 = 0 THEN '\n## 其二\n\u3000\n' || t ELSE '' END AS text FROM (SELECT *, " + text + " AS t FROM sec))"


SEC = "sec AS (SELECT source AS corpus, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS seq, doc_id, text FROM documents)"
CHANGED = SEC + ", chg AS (SELECT corpus, seq, doc_id, CASE WHEN doc_id % 97 = 0 THEN text || '!' ELSE text END AS text FROM sec WHERE doc_id % 101 <> 0)"
WS = r"[\s\x{0B}\x{A0}\x{1680}\x{180E}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
CHARS = f"length(regexp_replace(regexp_replace(text, '(?m)^#.*$', '', 'g'), '{WS}', '', 'g'))"
BODY = "regexp_replace(text, '(?m)^#.*$', '', 'g')"


def bare(x: str) -> str:
    """Without white space."""
    return f"regexp_replace({x}, '{WS}', '', 'g')"


def trimmed(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def paras(sec: str = "sec") -> str:
    """par (corpus, seq, pos, para, n): trimmed lines, neither blank nor headings, and their visible characters."""
    return f"lines AS (SELECT corpus, seq, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM {sec}), trimmed AS (SELECT corpus, seq, pos, {trimmed('line')} AS para FROM lines), par AS (SELECT corpus, seq, pos, para, length({bare('para')}) AS n FROM trimmed WHERE para <> '' AND NOT starts_with(para, '#'))"


def sents(sec: str = "sec", terminators: str = "[.!?;\n]") -> str:
    """sen (corpus, seq, sent): sentences of eight visible characters or more, but for headings and marks alone."""
    return f"sen0 AS (SELECT corpus, seq, unnest(regexp_split_to_array(text, '{terminators}')) AS raw FROM {sec}), sen1 AS (SELECT corpus, seq, {bare('raw')} AS sent FROM sen0), sen AS (SELECT * FROM sen1 WHERE length(sent) >= 8 AND NOT starts_with(sent, '#') AND NOT regexp_matches(sent, '^[“”‘’\"''（）()《》、，—…\\-.]+$'))"


PARAS = f"{SEC}, {paras()}"
SENTS = f"{SEC}, {sents()}"
CJK_SEC = f"{SEC}, {_cjk_sql()}"
