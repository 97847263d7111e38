"""Queries B1-B10, C1-C13, D1-D3."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusqa.functions import text as fn
from corpusqa.operators import dups, metrics, rewrite
from corpusqa.plans.registry import query
from corpusqa.plans.tables import BODY, CHANGED, CHARS, CJK_SEC, PARAS, SEC, SENTS, changed, cjk, paras, sections, sents, table, values
from corpusqa.schemas import CJK, LATIN
from corpusqa.sources import cut, numbered, publish, scratch, spread
from corpusqa.sources.snapshots import Store

TERMS = LATIN.lexicon
SPEAKERS = ("en", "er", "es", "on")
SPEAKER_VALUES = ", ".join(f"('{n}')" for n in SPEAKERS)
VOLUMES = [(1, 1, 10), (2, 11, 30)]


@query("b1_char_count", f"WITH {SEC} SELECT corpus, seq, {CHARS} AS chars FROM sec")
def b1(spark: SparkSession, d: str) -> DataFrame:
    return sections(spark, d).select("corpus", "seq", fn.char_count(F.col("text")).alias("chars"))


@query("b2_section_title", r"SELECT page_id, CASE WHEN h <> '' THEN h ELSE CAST(page_id AS VARCHAR) END AS title FROM (SELECT page_id, trim(regexp_extract(html, '<h1>([^<]*)</h1>', 1)) AS h FROM pages)")
def b2(spark: SparkSession, d: str) -> DataFrame:
    heading = F.concat(F.lit("# "), F.trim(F.regexp_extract("html", "<h1>([^<]*)</h1>", 1)))
    return table(spark, d, "pages").select("page_id", fn.display_title(fn.section_title(heading, F.col("page_id").cast("string"))).alias("title"))


@query("b3_paragraphs", f"WITH {PARAS} SELECT corpus, seq, CAST(pos AS BIGINT) AS pos, md5(para) AS para, n AS n_chars FROM par")
def b3(spark: SparkSession, d: str) -> DataFrame:
    return metrics.paragraphs(sections(spark, d)).select("corpus", "seq", "pos", F.md5("para").alias("para"), "n_chars")


@query("b4_sentences", f"WITH {SENTS} SELECT corpus, seq, sent, count(*) AS n FROM sen GROUP BY ALL")
def b4(spark: SparkSession, d: str) -> DataFrame:
    return metrics.sentences(sections(spark, d)).groupBy("corpus", "seq", "sent").agg(F.count(F.lit(1)).alias("n"))


@query("b5_para_kind", f"WITH {PARAS} SELECT corpus, CASE WHEN starts_with(para, '\"') THEN 'quote' ELSE 'narrative' END AS kind, count(*) AS n FROM par GROUP BY ALL")
def b5(spark: SparkSession, d: str) -> DataFrame:
    return metrics.paragraphs(sections(spark, d)).groupBy("corpus", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    "b6_short_paragraphs",
    r"""WITH p AS (SELECT page_id, unnest(string_split(html, '<p>')[2:]) AS para FROM pages)
    SELECT page_id, count(*) AS paras, count(*) FILTER (length(trim(regexp_replace(regexp_replace(para, '<[^>]*>', '', 'g'), '&[a-z#0-9]+;', ' ', 'g'))) < 60) AS short FROM p GROUP BY page_id""",
)
def b6(spark: SparkSession, d: str) -> DataFrame:
    paras = table(spark, d, "pages").select("page_id", F.explode(F.expr("slice(split(html, '<p>'), 2, greatest(1, size(split(html, '<p>'))))")).alias("para"))
    return paras.groupBy("page_id").agg(F.count(F.lit(1)).alias("paras"), F.count_if(fn.is_short_para(F.col("para"), 60)).alias("short"))


#: Sentences end in quotes' place: words of the prose stand for names, verbs and quotes.
SPEECH = replace(LATIN, openers=(",",), closers=(",",))
SPOKEN = "SELECT corpus, seq, name FROM {sec}, (VALUES {names}) r(name) WHERE regexp_matches(text, '(?:^|[^xz])' || name || '(?: the| und| que| de)[^.!?\n]{{0,4}},|,(?:[^.!?\n]{{0,11}}[^xz.!?\n])?' || name || '(?: the| und| que| de)')"


@query("b7_speech_hits", f"WITH {SEC} {SPOKEN.format(sec='sec', names=SPEAKER_VALUES)}")
def b7(spark: SparkSession, d: str) -> DataFrame:
    return dups.speech_hits(sections(spark, d), values(spark, "name STRING", *((n,) for n in SPEAKERS)), SPEECH).select("corpus", "seq", "name")


SPEAKER_FORMS = (("en", "en"), ("en", "an"), ("es", "es"), ("es", "ion"))


@query("b7_speech_by_alias", f"WITH {SEC}, said AS ({SPOKEN.format(sec='sec', names=', '.join(f"('{form}')" for _, form in SPEAKER_FORMS))}), of(name, form) AS (VALUES {', '.join(map(str, SPEAKER_FORMS))}) SELECT DISTINCT corpus, seq, of.name FROM said JOIN of ON of.form = said.name")
def b7_alias(spark: SparkSession, d: str) -> DataFrame:
    """Names with an alias each; what an alias says, its name says."""
    roster = values(spark, "name STRING, aliases ARRAY<STRING>", ("en", ["an", None]), ("es", ["ion", ""]))
    return dups.speech_hits(sections(spark, d), roster, SPEECH).select("corpus", "seq", "name")


@query("b8_own_attribution", f"WITH {PARAS} SELECT corpus, seq, CAST(pos AS BIGINT) AS pos, length(regexp_replace(split_part(para, ')', -1), '\\s', '', 'g')) > 0 AS own FROM par WHERE contains(para, ')')")
def b8(spark: SparkSession, d: str) -> DataFrame:
    p = metrics.paragraphs(sections(spark, d)).where(F.col("para").contains(")"))
    return p.select("corpus", "seq", "pos", fn.has_own_attribution(F.col("para"), ")").alias("own"))


@query("b9_scene_shift", f"WITH {PARAS} SELECT corpus, count(*) AS paras, count(*) FILTER (length(regexp_replace(para, '\\s', '', 'g')) <= 16 AND regexp_matches(para, '^(?:The|Und|Que|Les|In)')) AS shifts FROM par GROUP BY corpus")
def b9(spark: SparkSession, d: str) -> DataFrame:
    shift = fn.is_scene_shift(F.col("para"), "The|Und|Que|Les|In")
    return metrics.paragraphs(sections(spark, d)).groupBy("corpus").agg(F.count(F.lit(1)).alias("paras"), F.count_if(shift).alias("shifts"))


@query(
    "b10_span_blocks",
    f"WITH {PARAS}, m AS (SELECT corpus, seq, pos, starts_with(para, 'S') AND NOT contains(para, 'T') AS o, contains(para, 'T') AS c FROM par), p AS (SELECT *, count(*) FILTER (c) OVER (PARTITION BY corpus, seq ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS part FROM m WHERE o OR c) SELECT corpus, seq, min(pos) FILTER (o)::BIGINT AS first, max(pos) FILTER (c)::BIGINT AS last FROM p GROUP BY corpus, seq, part HAVING min(pos) FILTER (o) < max(pos) FILTER (c)",
)
def b10(spark: SparkSession, d: str) -> DataFrame:
    return rewrite.span_blocks(metrics.paragraphs(sections(spark, d)), "S", "T")


STATS = ", ".join(f"count(*) FILTER ({c}) AS n_{k}, coalesce(sum(n) FILTER ({c}), 0)::BIGINT AS chars_{k}, count(*) FILTER ({c} AND n < 20) AS short_{k}" for k, c in (("all", "true"), ("narrative", "NOT starts_with(para, '\"')"), ("quote", "starts_with(para, '\"')")))


CJK_QUOTE = "(starts_with(para, '“') OR starts_with(para, '「'))"
CJK_STATS = STATS.replace("starts_with(para, '\"')", CJK_QUOTE)


@query("b4_sentences_cjk", f"WITH {CJK_SEC}, {sents('csec', CJK.terminators)} SELECT corpus, seq, md5(sent) AS sent, count(*) AS n FROM sen GROUP BY corpus, seq, sent")
def b4_cjk(spark: SparkSession, d: str) -> DataFrame:
    found = metrics.sentences(cjk(sections(spark, d)), pack=CJK)
    return found.groupBy("corpus", "seq", "sent").agg(F.count(F.lit(1)).alias("n")).withColumn("sent", F.md5("sent"))


@query("c1_paragraph_stats_cjk", f"WITH {CJK_SEC}, {paras('csec')} SELECT corpus, seq, {CJK_STATS} FROM par GROUP BY corpus, seq")
def c1_cjk(spark: SparkSession, d: str) -> DataFrame:
    return metrics.paragraph_stats(cjk(sections(spark, d)), CJK)


@query("c2_pattern_density_cjk", f"WITH {CJK_SEC}, m AS (SELECT corpus, seq, len(regexp_extract_all({BODY}, '{CJK.negation}')) AS hits, {CHARS} AS chars FROM csec) SELECT *, CASE WHEN chars = 0 THEN 0 ELSE hits * 10000 // chars END AS per_10k FROM m")
def c2_cjk(spark: SparkSession, d: str) -> DataFrame:
    return metrics.pattern_density(cjk(sections(spark, d)), CJK.negation)


@query("c1_paragraph_stats", f"WITH {PARAS} SELECT corpus, seq, {STATS} FROM par GROUP BY corpus, seq")
def c1(spark: SparkSession, d: str) -> DataFrame:
    return metrics.paragraph_stats(sections(spark, d))


HITS = f"len(regexp_extract_all({BODY}, '[A-Z][a-z]{{4,8}}'))"


@query("c2_pattern_density", f"WITH {SEC}, m AS (SELECT corpus, seq, {HITS} AS hits, {CHARS} AS chars FROM sec) SELECT *, CASE WHEN chars = 0 THEN 0 ELSE hits * 10000 // chars END AS per_10k FROM m")
def c2(spark: SparkSession, d: str) -> DataFrame:
    return metrics.pattern_density(sections(spark, d), LATIN.negation)


@query("c3_repeated_sentences", f"WITH {SENTS} SELECT corpus, sent, count(*) AS n, count(DISTINCT seq) AS n_sections FROM sen GROUP BY corpus, sent HAVING count(*) >= 3")
def c3(spark: SparkSession, d: str) -> DataFrame:
    return metrics.repeated_sentences(sections(spark, d))


@query(
    "c4_repeat_hits",
    f"""WITH {SENTS}, rep AS (SELECT corpus, sent FROM sen GROUP BY ALL HAVING count(*) >= 3), h AS (SELECT corpus, seq, count(*) AS hits FROM sen JOIN rep USING (corpus, sent) GROUP BY ALL),
    m AS (SELECT corpus, seq, coalesce(hits, 0) AS hits, {CHARS} AS chars FROM sec LEFT JOIN h USING (corpus, seq)) SELECT *, CASE WHEN chars = 0 THEN 0 ELSE hits * 10000 // chars END AS per_10k FROM m""",
)
def c4(spark: SparkSession, d: str) -> DataFrame:
    return metrics.repeat_hits(sections(spark, d))


TERM_VALUES = ", ".join(f"('{t}')" for t in TERMS)


@query("c5_lexicon_counts", f"WITH {SEC}, t(term) AS (VALUES {TERM_VALUES}), c AS (SELECT corpus, seq, term, (length(text) - length(replace(text, term, ''))) // length(term) AS n FROM sec, t) SELECT * FROM c WHERE n > 0")
def c5(spark: SparkSession, d: str) -> DataFrame:
    return metrics.lexicon_counts(sections(spark, d), TERMS)


@query("c6_quote_hygiene", "WITH c AS (SELECT source AS corpus, sum(length(text) - length(replace(text, '(', '')))::BIGINT AS opens, sum(length(text) - length(replace(text, ')', '')))::BIGINT AS closes, sum(length(text) - length(replace(text, '\"', '')))::BIGINT AS half FROM documents GROUP BY source) SELECT *, abs(opens - closes) AS unpaired FROM c")
def c6(spark: SparkSession, d: str) -> DataFrame:
    return metrics.quote_hygiene(sections(spark, d))


@query(
    "c7_budget_status",
    f"""WITH {SEC}, m AS (SELECT corpus, seq, {CHARS} AS chars, seq BETWEEN 5 AND 9 OR seq BETWEEN 20 AND 25 OR seq >= 45 AS exempt FROM sec)
    SELECT *, CASE WHEN chars < 300 THEN 'under' WHEN NOT exempt AND chars > 3000 THEN 'over' WHEN exempt AND chars > 6000 THEN 'exempt_over' ELSE 'ok' END AS status FROM m""",
)
def c7(spark: SparkSession, d: str) -> DataFrame:
    return metrics.budget_status(sections(spark, d), values(spark, "lo BIGINT, hi BIGINT", (5, 9), (20, 25)), 300, 3000, 6000, 45)


MARKS = ("(", ")", '"')
COUNTED = ", ".join(f"(length(text) - length(replace(text, '{c}', '')))::BIGINT AS {n}" for c, n in zip(MARKS, ("opens", "closes", "half")))
STAT_COLUMNS = [f"{what}_{kind}" for kind in ("all", "narrative", "quote") for what in ("n", "chars", "short")]
MET = f"""{SENTS[len(SEC) + 2:]}, rep AS (SELECT corpus, sent FROM sen GROUP BY ALL HAVING count(*) >= 3), rh AS (SELECT corpus, seq, count(*) AS dups FROM sen JOIN rep USING (corpus, sent) GROUP BY ALL),
    met AS (SELECT corpus, seq, {CHARS} AS chars, {HITS} AS hits, {COUNTED} FROM sec), st AS (SELECT corpus, seq, {STATS} FROM par GROUP BY ALL),
    full_met AS (SELECT corpus, seq, chars, hits, opens, closes, half, coalesce(dups, 0) AS dups, seq BETWEEN 5 AND 9 OR seq BETWEEN 20 AND 25 OR seq >= 45 AS exempt, {", ".join(f"coalesce({c}, 0) AS {c}" for c in STAT_COLUMNS)} FROM met LEFT JOIN st USING (corpus, seq) LEFT JOIN rh USING (corpus, seq))"""
SUMS = "count(*) AS sections, min(chars) AS min_chars, max(chars) AS max_chars, " + ", ".join(f"sum({c})::BIGINT AS {c}" for c in ["chars", "hits", "dups", "half", *STAT_COLUMNS]) + ", abs(sum(opens) - sum(closes))::BIGINT AS unpaired, count(*) FILTER (chars < 300) AS under_floor, count(*) FILTER (chars >= 300 AND NOT exempt AND chars > 3000) AS over_ceil, count(*) FILTER (exempt AND chars > 6000) AS over_exempt, count(*) FILTER (exempt) AS exempt"
RATIOS = (("mean_chars", "chars", 1, "sections"), ("hits_10k", "hits", 10000, "chars"), ("dups_10k", "dups", 10000, "chars"), ("mean_para", "chars_all", 1, "n_all"), ("short_pct", "short_all", 100, "n_all"), ("nar_mean", "chars_narrative", 1, "n_narrative"), ("nar_short_pct", "short_narrative", 100, "n_narrative"), ("quote_mean", "chars_quote", 1, "n_quote"), ("quote_short_pct", "short_quote", 100, "n_quote"), ("quote_pct", "n_quote", 100, "n_all"))
DIVS = ", ".join(f"coalesce({a} * {k} // nullif({b}, 0), 0) AS {name}" for name, a, k, b in RATIOS)
ROLL = f"""roll AS (SELECT corpus, vol, 'v' || vol AS label, {SUMS} FROM full_met JOIN (VALUES (1, 1, 10), (2, 11, 30)) v(vol, lo, hi) ON seq BETWEEN lo AND hi GROUP BY corpus, vol UNION ALL SELECT corpus, NULL, 'total', {SUMS} FROM full_met GROUP BY corpus),
    rolled AS (SELECT corpus, vol::BIGINT AS vol, label, sections, chars, min_chars, max_chars, hits, dups, half, unpaired, under_floor, over_ceil, over_exempt, exempt, n_all AS paras, n_quote AS quotes, {DIVS} FROM roll)"""


def measured(spark: SparkSession, d: str) -> DataFrame:
    """Documents are measured where they lie; what is numbered, written and read again is their measures, and then the metrics of each section."""
    rows = spread(table(spark, d, "documents").select(F.col("source").alias("corpus"), "doc_id", "text"))
    m = cut(numbered(metrics.measure(rows, ["corpus", "doc_id"], marks=MARKS), "corpus", "doc_id"))
    budget = metrics.budget_status(m, values(spark, "lo BIGINT, hi BIGINT", (5, 9), (20, 25)), 300, 3000, 6000, 45)
    return cut(metrics.section_metrics(m.drop("doc_id"), budget))


@query("c8_rollup", f"WITH {PARAS}, {MET}, {ROLL} SELECT * FROM rolled")
def c8(spark: SparkSession, d: str) -> DataFrame:
    return metrics.rollup_metrics(measured(spark, d), values(spark, "vol BIGINT, lo BIGINT, hi BIGINT", *VOLUMES))


@query("c9_top_repeated_sentences", f"WITH {SENTS}, r AS (SELECT corpus, sent, count(*) AS n, count(DISTINCT seq) AS n_sections FROM sen GROUP BY corpus, sent HAVING count(*) >= 3), k AS (SELECT *, row_number() OVER (PARTITION BY corpus ORDER BY n DESC, sent) AS rank FROM r) SELECT * FROM k WHERE rank <= 5")
def c9(spark: SparkSession, d: str) -> DataFrame:
    return metrics.top_k(metrics.repeated_sentences(sections(spark, d)), "n", 5, ["corpus"], "sent")


DRIFT = ", ".join(f"('{m}', '{w}', {t})" for m, w, t in metrics.TOLERANCES)
DRIFTING = ", ".join(m for m, _, _ in metrics.TOLERANCES)
DRIFT_ROWS = f"SELECT corpus, half, unpaired, under_floor, over_ceil, over_exempt, {DIVS}"


@query(
    "c10_metric_drift",
    f"""WITH {PARAS}, {MET}, n AS (SELECT corpus, {SUMS} FROM full_met GROUP BY corpus), p AS (SELECT corpus, {SUMS} FROM full_met WHERE seq % 2 = 0 GROUP BY corpus),
    nn AS (UNPIVOT ({DRIFT_ROWS} FROM n) ON {DRIFTING} INTO NAME metric VALUE now), pp AS (UNPIVOT ({DRIFT_ROWS} FROM p) ON {DRIFTING} INTO NAME metric VALUE prior),
    t(metric, worse, tolerance) AS (VALUES {DRIFT})
    SELECT corpus, metric, now, prior, now - prior AS delta, CASE WHEN worse = 'up' THEN now - prior > tolerance ELSE now - prior < -tolerance END AS bad FROM nn JOIN pp USING (corpus, metric) JOIN t USING (metric)""",
)
def c10(spark: SparkSession, d: str) -> DataFrame:
    none = values(spark, "vol BIGINT, lo BIGINT, hi BIGINT")
    m = measured(spark, d)
    total = lambda x: metrics.rollup_metrics(x, none)
    return metrics.metric_drift(total(m), total(m.where("seq % 2 = 0")), metrics.TOLERANCES, ["corpus"])


@query(
    "c11_extremes",
    f"""WITH {SEC}, m AS (SELECT corpus, seq, {CHARS} AS chars FROM sec), u AS (SELECT corpus, seq, row_number() OVER (PARTITION BY corpus ORDER BY seq) AS r FROM m WHERE chars < 600),
    l AS (SELECT corpus, string_agg(seq::VARCHAR, ',' ORDER BY seq) AS listed FROM u WHERE r <= 5 GROUP BY corpus)
    SELECT m.corpus, arg_min(seq, chars * 1000000 + seq) AS shortest, min(chars) AS min_chars, arg_max(seq, chars * 1000000 - seq) AS longest, max(chars) AS max_chars, count(*) FILTER (chars < 600) AS under, coalesce(any_value(listed), '') AS listed, greatest(count(*) FILTER (chars < 600) - 5, 0) AS more
    FROM m LEFT JOIN l USING (corpus) GROUP BY m.corpus""",
)
def c11(spark: SparkSession, d: str) -> DataFrame:
    return metrics.extremes(sections(spark, d).select("corpus", "seq", fn.char_count(F.col("text")).alias("chars")), 600, 5)


@query(
    "c12_compare_states",
    f"""WITH {CHANGED}, ch AS (SELECT corpus, seq, s.text AS a, c.text AS b FROM sec s JOIN chg c USING (corpus, seq) WHERE s.text <> c.text),
    was AS (SELECT corpus, seq, a AS text FROM ch), {paras("was").replace("lines", "la").replace("trimmed", "ta").replace("par AS", "pa AS")}, now AS (SELECT corpus, seq, b AS text FROM ch), {paras("now").replace("lines", "lb").replace("trimmed", "tb").replace("par AS", "pb AS")},
    sa AS (SELECT corpus, count(DISTINCT seq) AS sections_before, count(*) AS paras_before, sum(n)::BIGINT AS chars_before, count(*) FILTER (n < 20) AS short_before FROM pa GROUP BY corpus),
    sb AS (SELECT corpus, count(DISTINCT seq) AS sections_after, count(*) AS paras_after, sum(n)::BIGINT AS chars_after, count(*) FILTER (n < 20) AS short_after FROM pb GROUP BY corpus)
    SELECT * FROM sa JOIN sb USING (corpus)""",
)
def c12(spark: SparkSession, d: str) -> DataFrame:
    s = sections(spark, d)
    return metrics.compare_states(s, changed(s))


@query("c13_snapshot_merge", f"WITH {SEC}, m AS (SELECT corpus, seq, {CHARS} AS chars FROM sec) SELECT corpus, count(*) AS sections, sum(chars)::BIGINT AS chars FROM m WHERE corpus NOT LIKE '%3' OR seq % 2 = 0 GROUP BY corpus")
def c13(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark)
    rows = sections(spark, d).select("corpus", "seq", fn.char_count(F.col("text")).alias("chars"))
    publish(rows, path)
    publish(rows.where("corpus LIKE '%3' AND seq % 2 = 0"), path)  # these corpora anew, the others stay
    return spark.read.parquet(path).groupBy(F.col("corpus").cast("string").alias("corpus")).agg(F.count(F.lit(1)).alias("sections"), F.sum("chars").alias("chars"))


@query("c13_snapshot_commits", f"WITH {SEC}, m AS (SELECT corpus, seq, {CHARS} AS chars FROM sec) SELECT corpus, count(*) AS sections, sum(chars)::BIGINT AS chars FROM m WHERE corpus NOT LIKE '%3' OR seq % 2 = 0 GROUP BY corpus")
def c13b(spark: SparkSession, d: str) -> DataFrame:
    """Published, published anew in part, and staged once more without a commit, which readers don't see."""
    store = Store(spark, scratch(spark))
    rows = cut(sections(spark, d).select("corpus", "seq", fn.char_count(F.col("text")).alias("chars")))
    store.publish(rows)
    store.publish(rows.where("corpus LIKE '%3' AND seq % 2 = 0"))
    store.stage(rows.limit(10), "lost")
    return store.read().groupBy("corpus").agg(F.count(F.lit(1)).alias("sections"), F.sum("chars").alias("chars"))


GRAMS = "g AS (SELECT corpus, seq, substr(text, i, 40) AS gram, i FROM sec, unnest(range(1, length(text) - 38)) r(i) WHERE length(text) >= 40)"


@query("d1_section_repeats", f"WITH {SEC}, {GRAMS} SELECT corpus, seq, md5(gram) AS gram, count(*) AS n FROM g GROUP BY corpus, seq, gram HAVING count(*) >= 2")
def d1(spark: SparkSession, d: str) -> DataFrame:
    return dups.section_repeats(sections(spark, d), 40).select("corpus", "seq", F.md5("gram").alias("gram"), "n")


@query(
    "d2_section_repeats_strict",
    r"""WITH sec AS (SELECT source AS corpus, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS seq, regexp_replace(text, '[,.!?:"();''\s-]', '', 'g') AS text FROM documents),
    g AS (SELECT corpus, seq, substr(text, i, 48) AS gram, i FROM sec, unnest(range(1, length(text) - 46)) r(i) WHERE length(text) >= 48)
    SELECT corpus, seq, md5(gram) AS gram, count(*) AS n FROM g GROUP BY corpus, seq, gram HAVING count(*) >= 2 AND max(i) - min(i) >= 48""",
)
def d2(spark: SparkSession, d: str) -> DataFrame:
    return dups.section_repeats(sections(spark, d), 48, strip=r"""[,.!?:"();'\s-]""", apart=True).select("corpus", "seq", F.md5("gram").alias("gram"), "n")


@query("d3_neighbour_repeats", f"WITH {SEC}, {GRAMS}, dg AS (SELECT DISTINCT corpus, seq, gram FROM g) SELECT a.corpus, a.seq, count(*) AS shared FROM dg a JOIN dg b ON a.corpus = b.corpus AND a.gram = b.gram AND b.seq = a.seq + 1 GROUP BY ALL")
def d3(spark: SparkSession, d: str) -> DataFrame:
    return dups.neighbour_repeats(sections(spark, d), 40)
