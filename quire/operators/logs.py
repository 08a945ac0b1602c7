"""Sectioned text logs: build, split and clean.

A log is ``**Header**`` sections. :func:`split_pieces` cuts the clean form
(``**Header**\\nbody`` pieces joined by a blank line) with one regex split, for R6.
Section edits (X13-X15) locate one named section by position: from its ``**Header**``
line to the next blank line before a header, wherever the header sits. All row-local:
no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

import re

from quire.constants import BAR_TABLE_SECTION, HTML_HEAD, JSON_FENCED_SECTIONS, LOG_FIELDS, TABLE_MARKDOWN_SECTIONS
from quire.functions.text import html_escape, md_header_fix
from quire.operators.ranges import text_chunks, whole_texts

SEP = "\n\n"


def _names(fields: list[str]) -> str:
    return "(?:" + "|".join(re.escape(n.strip()).replace("\\ ", " ") for n in fields) + ") ?"


def report_text(fields: list[tuple[str, Column]]) -> Column:
    """``**key**`` + blank line + value per field, in field order, joined by a line break."""
    parts = [F.concat(F.lit(f"**{k}**\n\n"), F.coalesce(v.cast("string"), F.lit(""))) for k, v in fields]
    return F.concat_ws("\n", *parts)


def split_pieces(text: Column, fields: list[str] = LOG_FIELDS) -> Column:
    """Pieces as ``array<struct<lead, header, body, is_section>>`` (R6 building block)."""
    pieces = F.split(text, rf"\n\n(?=\*\*{_names(fields)}\*\*\n)", -1)
    head = rf"^(\n*)\*\*({_names(fields)})\*\*\n"

    def piece(p):
        is_sec = p.rlike(head)
        lead = F.regexp_extract(p, r"^(\n*)", 1)
        header = F.when(is_sec, F.regexp_extract(p, head, 2))
        return F.struct(lead.alias("lead"), header.alias("header"), p.alias("_p"), is_sec.alias("is_section"))

    s = F.transform(pieces, piece)
    # body = the piece after its header line
    return F.transform(s, lambda x: F.struct(
        x["lead"].alias("lead"), x["header"].alias("header"),
        F.when(x["is_section"], F.regexp_replace(x["_p"], head, "")).otherwise(x["_p"]).alias("body"),
        x["is_section"].alias("is_section")))


def join_pieces(pieces: Column) -> Column:
    """Inverse of :func:`split_pieces`."""
    return F.array_join(F.transform(pieces, lambda x: F.when(
        x["is_section"], F.concat(x["lead"], F.lit("**"), x["header"], F.lit("**\n"), x["body"])).otherwise(x["body"])),
        SEP)


def sections(logs: DataFrame, text: str = "log_text", key: str = "log_id", fields: list[str] = LOG_FIELDS) -> DataFrame:
    """One row per section ``(key, section_idx, section, body)``; ``fields`` are the headers."""
    p = logs.select(key, split_pieces(F.col(text), fields).alias("_p"))
    p = p.select(key, F.filter("_p", lambda x: x["is_section"]).alias("_s"))
    ex = p.select(key, F.posexplode_outer("_s").alias("_i", "_x")).where(F.col("_i").isNotNull())
    return ex.select(key, (F.col("_i") + 1).cast("int").alias("section_idx"),
                     F.col("_x.header").alias("section"), F.col("_x.body").alias("body"))


def _section_end(fields: list[str]) -> str:
    return rf"\n\n(?=\*\*{_names(fields)}\*\*)"


def _cut(df: DataFrame, col: str, name: str, fields: list[str]):
    """(``df`` with the cuts, found, before, body, after) of the first ``**name**`` section of ``col``: its body goes up to
    the blank line before the next known header, or to the end of the text. Cuts are columns of their own, so each is
    made once per row."""
    x = df.withColumn("_two", F.split(col, rf"\*\*{re.escape(name)}\*\*\n", 2))
    # a leading mark keeps the cut apart from an empty body
    rest = F.concat(F.lit("\u0001"), F.element_at("_two", 2))
    x = x.withColumn("_part", F.when(F.size("_two") == 2, F.split(rest, rf"(?=\n\n\*\*{_names(fields)}\*\*)", 2)))
    first = F.element_at("_part", 1)
    return (x, F.size("_two") == 2, F.element_at("_two", 1), first.substr(F.lit(2), F.length(first)),
            F.coalesce(F.try_element_at("_part", F.lit(2)), F.lit("")))


def fence_section(df: DataFrame, col: str, name: str, fields: list[str] = LOG_FIELDS) -> DataFrame:
    """X13 for one section: wrap its body in a json fence when it starts with ``{`` or ``[``. One pass: the pattern goes to
    the first ``**name**`` line and tries no later one."""
    to = rf"(?s)\A((?>.*?\*\*{re.escape(name)}\*\*\n))"
    return df.withColumn(col, F.regexp_replace(col, to + rf"([\[{{].*?)(?={_section_end(fields)}|\z)", "$1```json\n$2\n```"))


def fence_json(df: DataFrame, col: str, names: list[str] = JSON_FENCED_SECTIONS, fields: list[str] = LOG_FIELDS) -> DataFrame:
    """Fence each named section in turn."""
    for name in names:
        df = fence_section(df, col, name, fields)
    return df


def delete_section(df: DataFrame, col: str, name: str = BAR_TABLE_SECTION, fields: list[str] = LOG_FIELDS) -> DataFrame:
    """Drop one section (header, body and the blank line after it); unchanged if absent."""
    before = rf"(?s)\A((?>.*?(?=\*\*{re.escape(name)}\*\*\n)))\*\*{re.escape(name)}\*\*\n"
    return df.withColumn(col, F.regexp_replace(col, before + rf".*?(?:{_section_end(fields)}|\z)", "$1"))


def strip_table_colons(df: DataFrame, col: str, name: str, fields: list[str] = LOG_FIELDS) -> DataFrame:
    """Remove ``:`` from a section body and put a blank line before it."""
    x, found, before, body, after = _cut(df, col, name, fields)
    return x.withColumn(col, F.when(found, F.concat(
        before, F.lit(f"**{name}**\n\n"), F.replace(body, F.lit(":"), F.lit("")), after)).otherwise(F.col(col))).drop("_two", "_part")


def normalize_header(text: Column, bad: str, good: str) -> Column:
    """Fix one known header spelling (e.g. a trailing blank inside the stars)."""
    return F.replace(text, F.lit(bad), F.lit(good))


def clean_logs(df: DataFrame, col: str, table_sections: list[str] = TABLE_MARKDOWN_SECTIONS) -> DataFrame:
    """X11 -> X12 -> X13 -> X14 -> X15: the whole cleanup chain, one projection per step.

    Meant for a text column read from data: on a constant (literal-only) column every
    step is foldable and the optimizer inlines them into each other.
    """
    df = df.withColumn(col, normalize_header(md_header_fix(F.col(col)),
                                             "**DOCUMENT Reasoning Results -- GPTEval Prediction Evaluation **",
                                             "**DOCUMENT Reasoning Results -- GPTEval Prediction Evaluation**"))
    df = fence_json(df, col)
    df = delete_section(df, col)
    for name in table_sections:
        df = strip_table_colons(df, col, name)
    return df


def html_report(items: DataFrame, key: str, order: str, title: str = "title", content: str = "content") -> DataFrame:
    """One HTML page per key from ordered ``(title, content)`` items.

    JSON content is pretty-printed (sorted keys, four-space indent) into a ``<pre>`` block;
    all content is HTML-escaped with ``<br>`` line breaks. Ranges of a report's items are joined where they lie, so
    the items of a long report are never gathered in one task.
    """
    from quire.operators.jsonops import is_json as json_test
    from quire.operators.jsonops import pretty_json

    is_json = json_test(content)
    pretty = pretty_json(F.when(is_json, F.col(content)))  # only JSON bodies reach Python
    body = F.when(is_json, F.concat(F.lit("<pre>"), html_escape(pretty), F.lit("</pre>"))).otherwise(html_escape(content))
    div = F.concat(F.lit("<div><strong>"), F.coalesce(F.col(title), F.lit("")), F.lit("</strong><p>"),
                   F.coalesce(body, F.lit("")), F.lit("</p></div>"))
    chunks = text_chunks(items, key, [order], div, sep="")
    return whole_texts(chunks, sep="").select(F.col("key").alias(key), F.concat(
        F.lit(HTML_HEAD), F.col("text"), F.lit("</body></html>")).alias("html"))
