"""Column functions on section texts and paragraphs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusqa.schemas import MARKS_ONLY, SPACE, SPACES


def char_count(text: Column) -> Column:
    """Characters without heading lines and white space (null: 0)."""
    return visible_length(body(text)).cast("bigint")


def body(text: Column) -> Column:
    """The text without its heading lines (null: empty)."""
    whole = F.coalesce(text, F.lit(""))
    return F.when(whole.contains("#"), F.regexp_replace(whole, r"(?md)^#.*$", "")).otherwise(whole)


def solid(text: Column, keep: str = "") -> Column:
    """The text without its white space, but for the characters of ``keep``."""
    return F.translate(text, "".join(c for c in SPACES if c not in keep), "")


def visible_length(text: Column) -> Column:
    """Characters that are no white space."""
    return F.length(solid(text))


def paragraph_list(text: Column) -> Column:
    """The trimmed lines, headings and blank ones left out, in order (null: null)."""
    return F.filter(F.transform(F.split(text, "\n"), lambda l: F.btrim(l, F.lit(SPACES))), lambda p: (p != "") & ~p.startswith("#"))


def sentence_list(text: Column, terminators: str, min_len: int) -> Column:
    """The sentences (``terminators`` has the line feed, or no other white space) of at least ``min_len`` characters, white space deleted; headings and those of marks only are left out (null: null)."""
    return F.filter(F.split(solid(text, "\n"), terminators), lambda s: (F.length(s) >= min_len) & ~s.startswith("#") & ~s.rlike(MARKS_ONLY))


def section_title(text: Column, fallback: Column) -> Column:
    """The declared title of a numbered heading, else the first heading, else ``fallback``."""
    declared = F.regexp_extract(text, r"第[^章\n]{1,12}章[^《\n]{0,4}《([^》\n]+)》", 1)
    heading = F.regexp_extract(text, r"(?m)^#\s+(.+)$", 1)
    return F.coalesce(F.nullif(F.trim(declared), F.lit("")), F.nullif(F.trim(heading), F.lit("")), fallback)


def display_title(title: Column) -> Column:
    """Without a leading section number."""
    return F.regexp_replace(title, r"^第[^章]{1,12}章[：:\s]*", "")


def para_kind(para: Column, openers: tuple[str, ...]) -> Column:
    """``quote`` for a paragraph that begins with an opening quote, else ``narrative``."""
    starts = F.lit(False)
    for o in openers:
        starts = starts | para.startswith(o)
    return F.when(starts, "quote").otherwise("narrative")


def visible(html: Column) -> Column:
    """Text without tags and entities."""
    return F.regexp_replace(F.regexp_replace(html, "<[^>]*>", ""), "&[a-z#0-9]+;", " ")


def is_short_para(html: Column, n: int = 15) -> Column:
    return F.length(F.trim(visible(html))) < n


def has_own_attribution(para: Column, closer: str = "”") -> Column:
    """Something other than white space follows the last closing quote."""
    rest = F.substring_index(para, closer, -1)
    return (F.instr(para, closer) > 0) & (F.length(F.regexp_replace(rest, SPACE, "")) > 0)


def is_scene_shift(para: Column, pattern: str, most: int = 16) -> Column:
    """A short paragraph that begins with a time marker."""
    return (F.length(F.regexp_replace(para, SPACE, "")) <= most) & para.rlike(f"^(?:{pattern})")


def occurrences(text: Column, term: Column) -> Column:
    """Non-overlapping occurrences of a term (null or empty: 0)."""
    n = F.length(term)
    return F.coalesce(F.when(n > 0, ((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / n).cast("bigint")), F.lit(0).cast("bigint"))
