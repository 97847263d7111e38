"""Declared facts against texts: custody, onsets, life windows, coverage, seats, attributes, knowledge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusqa.operators.intervals import covering, product, until_next
from corpusqa.operators.phrases import contained
from corpusqa.schemas import SPACE
from corpusqa.sources import numeral

#: Kinds of carriers that may appear after a person's end, words of a planting that stands.
CARRIERS = ("document", "reported")
PLANTED = "已在案|已落地|已排|已就位"
#: What a heading of a group of persons has, and words of headings that are no names.
GROUPS = "人物|纪律|关系网|补档|谱系|姓名考|矩阵|圈层|首领|传人|四卫|藩镇|附：|第[一二三]代|丐帮|青城派|崆峒派|海沙帮|河东军|剑南军|夜行司|观天台|烛微阁|八凶|宗师录|朝堂|市井|名单|军中|本节|传说"
NO_NAMES = ("已故", "新増", "随卷更新", "校订条", "岁出场", "双主角")


def custody_status(steps: DataFrame, sections: DataFrame, declared: DataFrame, lo: int, hi: int) -> DataFrame:
    """Steps (corpus, chain, ch, holder, anchors, handover) with their status."""
    there = sections.select("corpus", F.col("seq").alias("ch"), F.lit(True).alias("there")).distinct()
    said = declared.select("corpus", F.col("seq").alias("ch"), F.lit(True).alias("said")).distinct()
    status = (
        F.when(F.col("ch").isNull() | (F.col("ch") < 1), "bad_number")
        .when(F.col("there").isNull(), F.when(F.col("said"), "pending").otherwise("missing"))
        .when(~F.col("ch").between(lo, hi), "skipped")
        .when(F.size(F.coalesce("anchors", F.array().cast("array<string>"))) == 0, "no_anchor")
        .otherwise("active")
    )
    return steps.join(there, ["corpus", "ch"], "left").join(said, ["corpus", "ch"], "left").withColumn("status", status).drop("there", "said")


def _active(steps: DataFrame, sections: DataFrame) -> DataFrame:
    return steps.where("status = 'active'").join(sections.select("corpus", F.col("seq").alias("ch"), "text"), ["corpus", "ch"])


def custody_anchor(steps: DataFrame, sections: DataFrame) -> DataFrame:
    """Active steps whose section has none of their anchors."""
    return _active(steps, sections).where("NOT exists(anchors, a -> contains(text, a))").select("corpus", "chain", "ch", "holder")


def custody_handover(steps: DataFrame, sections: DataFrame) -> DataFrame:
    """Consecutive active steps of different holders without a word of handover in either section."""
    w = Window.partitionBy("corpus", "chain").orderBy("ch", "holder")
    before = F.lag(F.struct("ch", "holder", "handover", "text")).over(w)
    pairs = _active(steps, sections).withColumn("b", before).where("b IS NOT NULL AND b.holder <> holder")
    words = F.concat(F.coalesce("handover", F.expr("cast(array() AS array<string>)")), F.coalesce("b.handover", F.expr("cast(array() AS array<string>)")))
    judged = pairs.withColumn("words", words).withColumn("kind", F.expr("CASE WHEN size(words) = 0 THEN 'no_word' WHEN NOT exists(words, x -> contains(text, x) OR contains(b.text, x)) THEN 'no_evidence' END"))
    return judged.where("kind IS NOT NULL").select("corpus", "chain", F.col("b.ch").alias("from_ch"), "ch", "kind")


def custody_terminal(terminals: DataFrame, sections: DataFrame) -> DataFrame:
    """(corpus, chain, kind, seq, phrase): sections after a chain's end with a forbidden phrase (the first of the list that is there); ends without phrases warn."""
    listed = F.size(F.coalesce("forbid", F.expr("cast(array() AS array<string>)"))) > 0
    phrases = terminals.where(listed).select("corpus", "chain", "ch", F.posexplode("forbid").alias("pos", "form"))
    there = contained(sections, ["corpus", "seq"], phrases).join(phrases, ["corpus", "form"]).where("seq > ch")
    hits = there.groupBy("corpus", "chain", "seq").agg(F.min_by("form", "pos").alias("phrase")).select("corpus", "chain", F.lit("after_end").alias("kind"), "seq", "phrase")
    bare = terminals.where(~listed & F.col("ch").isNotNull()).select("corpus", "chain", F.lit("no_phrases").alias("kind"), F.lit(None).cast("bigint").alias("seq"), F.lit(None).cast("string").alias("phrase"))
    return hits.unionByName(bare)


def onset_violations(onsets: DataFrame, found: DataFrame, speech: DataFrame | None = None) -> DataFrame:
    """(corpus, name, kind, early, first_seq): names met before their declared onset (null: never allowed)."""
    out = found.join(onsets.select("corpus", "name", "first_appearance"), ["corpus", "name"]).where("first_appearance IS NULL OR seq < first_appearance").withColumn("kind", F.lit("appearance"))
    if speech is not None:
        talk = speech.join(onsets.select("corpus", "name", "first_speech"), ["corpus", "name"]).where("seq < first_speech").withColumn("kind", F.lit("speech"))
        out = out.select("corpus", "name", "seq", "kind").unionByName(talk.select("corpus", "name", "seq", "kind"))
    return out.groupBy("corpus", "name", "kind").agg(F.count(F.lit(1)).alias("early"), F.min("seq").alias("first_seq"))


def onset_closure(onsets: DataFrame, found: DataFrame, sections: DataFrame, late_from: int) -> DataFrame:
    """Declared onsets whose section has not the name: ``missing``, ``pending`` (no such section), ``late`` or ``met``."""
    met = found.select("corpus", "name", F.col("seq").alias("first_appearance"), F.lit(True).alias("met"))
    there = sections.select("corpus", F.col("seq").alias("first_appearance"), F.lit(True).alias("there"))
    joined = onsets.join(met, ["corpus", "name", "first_appearance"], "left").join(there, ["corpus", "first_appearance"], "left")
    status = F.when(F.col("first_appearance").isNull() | (F.col("first_appearance") >= late_from), "late").when(F.col("there").isNull(), "pending").when(F.col("met"), "met").otherwise("missing")
    return joined.select("corpus", "name", "first_appearance", status.alias("status"))


def onset_lateness(closure: DataFrame, late_max: int = 10) -> DataFrame:
    """Per corpus: entries, those that are late, met and missing, and a warning above ``late_max`` late ones."""
    n = lambda status: F.count_if(F.col("status") == status)
    out = closure.groupBy("corpus").agg(F.count(F.lit(1)).alias("entries"), n("late").alias("late"), n("met").alias("met"), n("missing").alias("missing"))
    return out.withColumn("warn", F.col("late") > late_max)


def life_windows(landings: DataFrame, people: DataFrame, keys: list[str], end: Column | None = None) -> DataFrame:
    """Landings (keys, at_lo, at_hi, exempt) against windows (born, ends): floor and ceiling violations.

    A start before birth fails for all; a start after the end fails and an end after it warns,
    exempt carriers apart.  With ``end``, the last year of the work, it closes every window, open ones too.
    """
    joined = landings.join(people, keys)
    ends = F.col("ends") if end is None else F.least("ends", end)  # of one null and one value, the value
    kind = F.when(F.col("at_lo") < F.col("born"), "before_birth").when(F.col("exempt"), None).when(F.col("at_lo") > ends, "after_end").when(F.col("at_hi") > ends, "reaches_past")
    return joined.withColumn("kind", kind).where("kind IS NOT NULL")


def life_steps(people: DataFrame) -> DataFrame:
    """(name, phase, seq, year, carrier) of people (name, landed, planned, first, last), landed and planned being arrays of (seq, year, carrier)."""
    step = lambda c: F.expr(f"named_struct('seq', cast({c} AS bigint), 'year', cast(null AS bigint), 'carrier', cast(null AS string))")
    listed = [people.select("name", F.lit(phase).alias("phase"), F.explode(phase).alias("x")) for phase in ("landed", "planned")]
    ranged = people.select("name", F.lit("range").alias("phase"), F.explode(F.array(step("first"), step("last"))).alias("x")).where("x.seq IS NOT NULL")
    columns = ["name", "phase", F.col("x.seq").cast("bigint").alias("seq"), F.col("x.year").cast("bigint").alias("year"), F.coalesce("x.carrier", F.lit("in_person")).alias("carrier")]
    return listed[0].select(*columns).unionByName(listed[1].select(*columns)).unionByName(ranged.select(*columns))


def life_verdicts(steps: DataFrame, people: DataFrame, sections: DataFrame, spans: DataFrame, end: int) -> DataFrame:
    """Steps (corpus, name, seq, year, carrier) whose year is outside the window of people (name, born, ends), with its kind.

    Years are the declared one, else those of the step's volume in ``spans`` (lo, hi, year_lo, year_hi; with corpus, each corpus has its own).
    Steps without a section number are ``undated``, those of sections in no volume ``no_span``; steps
    whose section does not exist are left out.
    """
    undated = steps.where("seq IS NULL").withColumn("kind", F.lit("undated"))
    # Volumes are looked up for sections, not for steps: steps meet their section once, by its whole key.
    there = sections.select("corpus", "seq").distinct()
    keys = tuple(c for c in ("corpus",) if c in spans.columns)
    there = there.join(covering(there, spans, keys=keys), [*keys, "seq"], "left")
    placed = steps.join(there, ["corpus", "seq"]).select(*steps.columns, *(c for c in spans.columns if c not in steps.columns))
    dated = placed.where("lo IS NOT NULL").withColumns({"at_lo": F.coalesce("year", "year_lo"), "at_hi": F.coalesce("year", "year_hi"), "exempt": F.col("carrier").isin(*CARRIERS)})
    out = undated.unionByName(placed.where("lo IS NULL").select(*steps.columns, F.lit("no_span").alias("kind")))
    return out.unionByName(life_windows(dated, people, ["name"], F.lit(end)).select(*steps.columns, "kind"))


def landing_years(landings: DataFrame, overrides: DataFrame, spans: DataFrame) -> DataFrame:
    """Add at_lo and at_hi: the declared year, else the section's override, else its volume's years (else null)."""
    a = landings.join(overrides.select("seq", F.col("year").alias("over")), "seq", "left")
    b = a.join(covering(landings, spans), "seq", "left")
    return b.withColumn("at_lo", F.coalesce("year", "over", "year_lo")).withColumn("at_hi", F.coalesce("year", "over", "year_hi"))


def reconcile_ranges(a: DataFrame, b: DataFrame) -> DataFrame:
    """(vol, status) of two tables (vol, lo, hi, y0, y1): where they differ."""
    x, y = (df.select("vol", F.struct("lo", "hi").alias(f"r{s}"), F.struct("y0", "y1").alias(f"y{s}")) for df, s in ((a, "a"), (b, "b")))
    joined = x.join(y, "vol", "full")
    status = F.when(F.col("ra").isNull(), "only_b").when(F.col("rb").isNull(), "only_a").when(~F.col("ra").eqNullSafe(F.col("rb")), "range").when(~F.col("ya").eqNullSafe(F.col("yb")), "years").otherwise("same")
    return joined.select("vol", status.alias("status"))


def character_cards(docs: DataFrame) -> DataFrame:
    """(doc, card, tokens): the headings of level 3 or 4 that are a person's, numbers left out, with their names (2 to 6 CJK characters), once each.

    Headings with a colon, of groups (``GROUPS``) or without a name are no cards; words of ``NO_NAMES`` are no names.
    """
    line = F.explode(F.split("text", "\n"))
    heads = docs.select("doc", line.alias("line")).select("doc", F.regexp_extract(F.rtrim("line", F.lit("\r")), r"^#{3,4}[\s\x{3000}]+(.*)$", 1).alias("head")).where("head <> ''")
    bare = F.regexp_replace(F.trim(F.regexp_replace("head", f"^{SPACE}+|{SPACE}+$", "")), r"^[0-9]+[a-z]?[.、]\s*", "")
    names = F.filter(F.regexp_extract_all("card", F.lit("[\u4e00-\u9fff]{2,6}"), 0), lambda t: ~t.isin(*NO_NAMES))
    cards = heads.select("doc", bare.alias("card")).where(~F.col("card").contains("：") & ~F.col("card").rlike(GROUPS)).withColumn("tokens", names)
    return cards.where("size(tokens) > 0").distinct()


def uncovered_cards(cards: DataFrame, plan: DataFrame, key: str = "card") -> DataFrame:
    """Cards (card, tokens) none of whose tokens any text of the plan (text) contains."""
    each = cards.select(key, F.explode("tokens").alias("form")).distinct()
    met = contained(plan.select("text"), [], each).select("form").distinct()
    covered = each.join(met, "form", "left_semi").select(key).distinct()
    return cards.select(key).distinct().join(covered, key, "left_anti")


def planting_stands(anchor: str, cutoff: int, volume_limit: int) -> Column:
    """Whether a planting's anchor text says that it stands: by its words, a section up to the cutoff, or a volume up to the limit."""
    sections = F.exists(F.regexp_extract_all(anchor, F.lit(r"ch\s*(\d+)"), 1), lambda n: n.try_cast("bigint") <= cutoff)
    volumes = F.exists(F.regexp_extract_all(anchor, F.lit("卷([一二三四五六七八九十]+)"), 1), lambda n: F.coalesce(numeral(n) <= volume_limit, F.lit(False)))
    return F.col(anchor).rlike(PLANTED) | F.coalesce(sections, F.lit(False)) | volumes


def seat_closure(seats: DataFrame, found: DataFrame, planted: DataFrame, cutoff: int, volume_limit: int = 12) -> DataFrame:
    """Seats (corpus, name): sections up to the cutoff, planting (status, anchor, volume) that qualifies, and the verdict."""
    counted = found.where(F.col("seq") <= cutoff).groupBy("corpus", "name").agg(F.count(F.lit(1)).alias("sections"))
    good = planted.where((F.col("status").isin("planted", "done")) | (F.col("anchor") <= cutoff) | (F.col("volume") <= volume_limit)).select("corpus", "name", F.lit(True).alias("planted")).distinct()
    out = seats.join(counted, ["corpus", "name"], "left").join(good, ["corpus", "name"], "left")
    n, p = F.coalesce("sections", F.lit(0)).cast("bigint"), F.coalesce("planted", F.lit(False))
    verdict = F.when((n == 0) & ~p, "open").when(n <= 1, "thin").otherwise("closed")
    return out.select("corpus", "name", n.alias("sections"), p.alias("planted"), verdict.alias("verdict"))


def seat_summary(closure: DataFrame, thin_max: int = 6) -> DataFrame:
    """Per corpus: seats, open ones, those with one section at most, and a warning above ``thin_max`` of these."""
    out = closure.groupBy("corpus").agg(F.count(F.lit(1)).alias("seats"), F.count_if(F.col("verdict") == "open").alias("open"), F.count_if(F.col("sections") <= 1).alias("thin"))
    return out.withColumn("warn", F.col("thin") > thin_max)


def life_board(people: DataFrame, volumes: DataFrame, slack: int | Column = 1) -> DataFrame:
    """For every volume (vol, lo, hi, y0, y1): people (name, ends, landed, planned) by what it means to them.

    ``last_chance``: they end in it; ``near_end``: they end within ``slack`` after it; ``planned``:
    a section of it is among their planned ones (array); ``pending``: how many of all have nothing
    landed but something planned.
    """
    near = volumes.select("vol", "y0", "y1", (F.col("y1") + slack).alias("far"))
    ending = people.select("ends").join(covering(people, near, "ends", "y0", "far"), "ends")
    last = F.col("ends") <= F.col("y1")
    ended = ending.groupBy("vol").agg(F.count_if(last).alias("last_chance"), F.count_if(~last).alias("near_end"))
    planned = people.select("name", F.explode("planned").alias("seq"))
    here = planned.join(covering(planned, volumes.select("vol", "lo", "hi")), "seq").groupBy("vol").agg(F.count_distinct("name").alias("planned"))
    pending = people.agg(F.count_if((F.col("landed") == 0) & (F.size("planned") > 0)).alias("pending"))  # one row
    board = volumes.join(ended, "vol", "left").join(here, "vol", "left").na.fill(0, ["last_chance", "near_end", "planned"])
    return board.crossJoin(F.broadcast(pending)).select("vol", "last_chance", "near_end", "planned", "pending")


def missing_numbers(volumes: DataFrame, sections: DataFrame) -> DataFrame:
    """(corpus, vol, seq): the numbers of a volume (vol, lo, hi) that have no section."""
    wanted = product(sections.select("corpus").distinct(), volumes.select("vol", "lo", "hi")).select("corpus", "vol", F.explode(F.sequence("lo", "hi")).alias("seq"))
    return wanted.join(sections.select("corpus", "seq"), ["corpus", "seq"], "left_anti").select("corpus", "vol", "seq")


def missing_sections(volumes: DataFrame, sections: DataFrame) -> DataFrame:
    """(corpus, vol, missing, first, last, state) of volumes with missing sections: ``partial``, or ``unwritten`` if all are."""
    gaps = missing_numbers(volumes, sections).groupBy("corpus", "vol").agg(F.count(F.lit(1)).alias("missing"), F.min("seq").alias("first"), F.max("seq").alias("last"))
    state = F.when(F.col("missing") == F.col("hi") - F.col("lo") + 1, "unwritten").otherwise("partial")
    return gaps.join(volumes, "vol").select("corpus", "vol", "missing", "first", "last", state.alias("state"))


def next_volume(missing: DataFrame) -> DataFrame:
    """(corpus, vol, missing): each corpus's first volume with missing sections."""
    return missing.groupBy("corpus").agg(F.min_by(F.struct("vol", "missing"), "vol").alias("x")).select("corpus", "x.*")


def life_board_lists(people: DataFrame, next_from: Column | None = None) -> DataFrame:
    """(name, list) of people (name, landed, planned, ranged, waiting, ends, dies).

    ``no_landing``: nothing landed, but something planned or a range; ``pending``: their status is
    waiting; ``past_ceiling``: known to die and ending at the next volume's start (``next_from``) or
    before, with nothing landed.
    """
    none = F.col("landed") == 0
    past = F.lit(False) if next_from is None else none & F.col("dies") & (F.col("ends") <= next_from)
    kinds = F.array(F.when(none & ((F.col("planned") > 0) | F.col("ranged")), F.lit("no_landing")), F.when(F.col("waiting"), F.lit("pending")), F.when(past, F.lit("past_ceiling")))
    return people.select("name", F.explode(F.array_compact(kinds)).alias("list"))


def attribute_gate(current: DataFrame, baseline: DataFrame, expected: DataFrame) -> DataFrame:
    """(name, status) of attributes (name, value): unexpected, changed, added or removed."""
    joined = current.join(baseline.select("name", F.col("value").alias("prior")), "name", "full").join(expected.select("name", F.col("value").alias("must")), "name", "left")
    status = F.when(F.col("value").isNull(), "removed").when(F.col("must").isNotNull() & (F.col("value") != F.col("must")), "unexpected").when(F.col("prior").isNull(), "added").when(F.col("value") != F.col("prior"), "changed")
    return joined.select("name", status.alias("status")).where("status IS NOT NULL")


def apply_adjudications(candidates: DataFrame, ruled: DataFrame) -> DataFrame:
    """Candidates (corpus, sent) no ruling (corpus, anchor) covers."""
    met = contained(candidates.select("sent").distinct(), ["sent"], ruled, "sent", "anchor").withColumnRenamed("form", "anchor")
    covered = met.join(ruled.select("corpus", "anchor").distinct(), "anchor").select("corpus", "sent").distinct()
    return candidates.join(covered, ["corpus", "sent"], "left_anti")


def resolved_adjudications(ruled: DataFrame, sections: DataFrame) -> DataFrame:
    """Rulings whose anchor no section of their corpus has any more."""
    met = contained(sections, ["corpus"], ruled, form="anchor").withColumnRenamed("form", "anchor").distinct()
    return ruled.join(met, ["corpus", "anchor"], "left_anti").select("corpus", "anchor")


def treated_gate(hits: DataFrame, treated: DataFrame) -> DataFrame:
    """Enrolled sections (corpus, seq, base): fail where they have more hits than stored, else pass; others report."""
    joined = hits.join(treated, ["corpus", "seq"], "full")
    n = F.coalesce("hits", F.lit(0)).cast("bigint")
    return joined.select("corpus", "seq", n.alias("hits"), "base", F.when(F.col("base").isNull(), "report").when(n > F.col("base"), "fail").otherwise("pass").alias("status"))


def setup_closure(setups: DataFrame, now) -> DataFrame:
    """Setups (id, planted, paid, due, status): paid before planted, overdue, or without a payoff."""
    kind = F.when(F.col("paid") < F.col("planted"), "paid_early").when((F.col("due") < now) & (F.col("status") != "paid"), "overdue").when(F.col("paid").isNull(), "no_payoff")
    return setups.withColumn("kind", kind).where("kind IS NOT NULL")


def conflict_outlets(conflicts: DataFrame, plan: DataFrame) -> DataFrame:
    """Conflicts (id, corpus, erupts) whose section is not planned."""
    return conflicts.join(plan.select("corpus", F.col("seq").alias("erupts")), ["corpus", "erupts"], "left_anti")


def bilocation(timeline: DataFrame) -> DataFrame:
    """(person, time, places): more than one place at a time."""
    return timeline.groupBy("person", "time").agg(F.countDistinct("place").alias("places")).where("places > 1")


def knowledge_matrix(facts: DataFrame, secrets: list[str], as_of=None) -> DataFrame:
    """A column for each secret: the person's latest state up to ``as_of`` (by ``seq``, then state)."""
    rows = facts if as_of is None else facts.where(F.col("seq") <= as_of)
    latest = rows.groupBy("person", "secret").agg(F.max(F.struct("seq", "state")).alias("x")).select("person", "secret", "x.state")
    return latest.groupBy("person").pivot("secret", secrets).agg(F.first("state"))


def knowledge_matrices(facts: DataFrame, secrets: list[str], as_of: DataFrame) -> DataFrame:
    """(seq, person, a column for each secret): everyone's states as of each number of ``as_of`` (seq), all from one reading of the facts.

    A fact (person, secret, seq, state) holds up to the next one; of several with one number the greatest state.
    """
    latest = facts.groupBy("person", "secret", "seq").agg(F.max("state").alias("state"))
    spans = until_next(latest.withColumnRenamed("seq", "start"), keys=("person", "secret")).withColumnRenamed("start", "lo")
    held = covering(as_of, spans).select("seq", "person", "secret", "state")
    return held.groupBy("seq", "person").pivot("secret", secrets).agg(F.first("state"))


def knowledge_overreach(uses: DataFrame, facts: DataFrame) -> DataFrame:
    """(person, secret, uses): uses before the person knows, or without ever knowing."""
    known = facts.groupBy("person", "secret").agg(F.min("seq").alias("known_from"))
    early = uses.join(known, ["person", "secret"], "left").where("known_from IS NULL OR seq < known_from")
    return early.groupBy("person", "secret").agg(F.count(F.lit(1)).alias("uses"))
