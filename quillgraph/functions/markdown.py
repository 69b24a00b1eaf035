"""Markdown to plain text, titles, tags and links, as Spark columns.

Patterns here state the notation's fixed forms; `$` and `.` take line feeds only as line ends (`(?d)`).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgraph.functions.text import title_from_filename, trimmed

_BLANK = "[\\t\\n\\f\\r ]"

#: What is taken out of Markdown, in order: pattern and what stands in its place.
STRIP: list[tuple[str, str]] = [
    (r"(?d)<!--.*?-->", ""),
    (rf"(?dms)^```.*?^```{_BLANK}*$", ""),
    (rf"(?dms)^~~~.*?^~~~{_BLANK}*$", ""),
    (r"`[^`]*`", ""),
    (rf"(?dm)^#{{1,6}}{_BLANK}+", ""),
    (r"\*{1,3}([^*]+)\*{1,3}", "$1"),
    (r"_{1,3}([^_]+)_{1,3}", "$1"),
    (r"\[([^\]]*)\]\([^)]*\)", "$1"),
    (r"\[\[[^\]|]+\|([^\]]+)\]\]", "$1"),
    (r"\[\[([^\]|]+)(?:\|)?\]\]", "$1"),
    (r"!\[[^\]]*\]\([^)]*\)", ""),
    (rf"(?dm)^>{_BLANK}?", ""),
    (rf"(?dm)^[-*_]{{3,}}{_BLANK}*$", ""),
    (r"\n{3,}", "\n\n"),
]


def strip_markdown(text: Column) -> Column:
    for pattern, by in STRIP:
        text = F.regexp_replace(text, pattern, by)
    return trimmed(text)


def _front(content: Column) -> Column:
    """Where front matter ends: the text after the opening marks, up to the first line that starts with
    three dashes; null without front matter."""
    rest = F.regexp_replace(F.substring(content, F.lit(4), F.length(content)), r"^\r?\n", "")
    return F.when(content.startswith("---") & (F.instr(rest, "\n---") > 0), rest)


def front_matter(content: Column) -> Column:
    rest = _front(content)
    return F.substring(rest, F.lit(1), F.instr(rest, "\n---") - 1)


def body_of(content: Column) -> Column:
    """The content after front matter, or all of it."""
    rest = _front(content)
    after = F.substring(rest, F.instr(rest, "\n---") + 4, F.length(rest))
    return F.coalesce(F.regexp_replace(after, r"^\r?\n", ""), content)


def tags_of(content: Column) -> Column:
    """tags: [a, b], tags: a, or lines of `- a` below; quotes stay."""
    lines = F.transform(F.split(front_matter(content), "\n"), trimmed)
    at = F.array_position(F.transform(lines, lambda x: x.startswith("tags:")), True).cast("int")
    value = trimmed(F.substring(F.get(lines, at - 1), F.lit(6), F.lit(1 << 30)))
    listed = F.split(F.regexp_extract(value, r"(?s)^\[(.*)\]$", 1), ",")
    below = F.filter(F.slice(lines, at + 1, F.size(lines)), lambda x: x != "")
    stop = F.array_position(F.transform(below, lambda x: x.startswith("- ")), False).cast("int")
    block = F.transform(F.when(stop > 0, F.slice(below, F.lit(1), F.greatest(stop - 1, F.lit(0)))).otherwise(below), lambda x: F.substring(x, F.lit(3), F.length(x)))
    found = F.when(value.rlike(r"(?s)^\[.*\]$"), listed).when(value != "", F.array(value)).otherwise(block)
    clean = F.filter(F.transform(found, trimmed), lambda t: t != "")
    return F.coalesce(F.when(at > 0, clean), F.expr("cast(array() as array<string>)"))


def title_of(content: Column, path: Column) -> Column:
    heading = trimmed(F.regexp_extract(body_of(content), r"(?dm)^#[\t\n\f\r ]+(.+)$", 1))
    return F.when(heading != "", heading).otherwise(title_from_filename(path))


def last_verified(content: Column) -> Column:
    return F.regexp_extract(content, r"<!--[\t\n\f\r ]*last-verified:[\t\n\f\r ]*(\d{4}-\d{2}-\d{2})[\t\n\f\r ]*-->", 1)


def links_of(content: Column) -> Column:
    """Targets of [[wikilinks]], then of [text](relative/path), each once, outside code."""
    bare = F.regexp_replace(content, rf"(?dms)^{_BLANK}*```.*?^{_BLANK}*```{_BLANK}*$|^{_BLANK}*~~~.*?^{_BLANK}*~~~{_BLANK}*$", "")
    bare = F.regexp_replace(bare, r"`[^`\n]+`", "")
    wiki = F.transform(F.regexp_extract_all(bare, F.lit(r"\[\[([^\]]+)\]\]"), F.lit(1)), lambda x: trimmed(F.substring_index(x, "|", 1)))
    inline = F.transform(F.regexp_extract_all(bare, F.lit(r"\[(?:[^\]]*)\]\(([^)]+)\)"), F.lit(1)), trimmed)
    inline = F.filter(inline, lambda x: ~(x.startswith("http://") | x.startswith("https://") | x.startswith("/")))
    inline = F.filter(F.transform(inline, lambda x: F.substring_index(x, "#", 1)), lambda x: x.contains("/") | x.contains("."))
    return F.array_distinct(F.filter(F.concat(wiki, inline), lambda x: x != ""))
