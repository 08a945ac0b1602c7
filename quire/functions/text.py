"""String functions as Spark Column expressions.

All of these stay inside whole-stage codegen: no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.constants import ANSWER_KEY

__all__ = [
    "TOKEN_PATTERN", "INT_PATTERN", "token_count", "parse_int", "strip_ws", "answer_parts",
    "after_last", "html_escape", "csv_cell", "fill_template", "md_header_fix",
]

# Unicode word runs or single punctuation marks (a word-tokenizer estimate).
TOKEN_PATTERN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
# White space as Unicode text has it (the regex engine's own class is ASCII only).
BLANKS = (r"[\t-\r\x1c-\x20\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
# A strict integer with optional sign and surrounding blanks.
INT_PATTERN = r"^\s*[+-]?[0-9]+\s*$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def token_count(text) -> Column:
    """Number of matches of :data:`TOKEN_PATTERN` (word runs plus single marks).

    Computed without materialising the matches (``regexp_count`` builds an array of
    every token): each word run collapses to one character, whitespace is removed, and
    every remaining character is one token.
    """
    runs = F.regexp_replace(_c(text), r"[\p{L}\p{N}_]+", "a")
    return F.length(F.regexp_replace(runs, BLANKS + "+", ""))


def strip_ws(text) -> Column:
    """Trim all leading/trailing whitespace (not only spaces, as ``trim`` does)."""
    t = _c(text)
    # the pattern's end also stands before a last line break of these kinds; all other texts need no pattern
    odd = t.endswith("\u0085") | t.endswith("\u2028") | t.endswith("\u2029")
    return F.when(odd, F.regexp_replace(t, r"^\s+|\s+$", "")).otherwise(F.btrim(t, F.lit(" \t\n\x0b\f\r")))


def parse_int(text) -> Column:
    """Strict integer parse; anything else (``' 9.0'``, prose) is NULL."""
    t = _c(text)
    return F.when(t.rlike(INT_PATTERN), strip_ws(t).try_cast("bigint"))


def answer_parts(response, prompt_type, marker: str = ANSWER_KEY) -> tuple[Column, Column]:
    """(rationale, answer).

    For chain-of-thought prompt types whose response holds the marker, the
    rationale is the text before the first marker and the answer the text between
    the first and the second. Otherwise the rationale is NULL and the answer is the
    whole response.
    """
    r, p = _c(response), _c(prompt_type)
    cond = p.contains("CoT") & r.contains(marker)
    rationale = F.when(cond, F.substring_index(r, marker, 1))
    answer = F.when(cond, F.substring_index(F.substring_index(r, marker, 2), marker, -1)).otherwise(r)
    return rationale, answer


def after_last(text, sep: str) -> Column:
    """Text after the last ``sep`` (whole text if absent), whitespace-trimmed."""
    return strip_ws(F.substring_index(_c(text), sep, -1))


def html_escape(text, br: bool = True) -> Column:
    """HTML-escape (``&`` first, quotes included), newlines to ``<br>``."""
    t = _c(text)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        t = F.replace(t, F.lit(a), F.lit(b))
    if br:
        t = F.replace(t, F.lit("\n"), F.lit("<br>"))
    return t


def csv_cell(cell, delimiter: str = "|") -> Column:
    """Minimal CSV quoting: quote a cell holding the delimiter, a quote or a line break."""
    c = F.coalesce(_c(cell), F.lit(""))
    special = "[" + "\\" + delimiter + "\"\r\n]"
    return F.when(c.rlike(special), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
                  ).otherwise(c)


def fill_template(template: str, **slots) -> Column:
    """Fill ``{slot}`` placeholders from columns without re-scanning filled text.

    The template is cut into literal pieces on the driver (it is a parameter, not
    data); the pieces and slot columns are concatenated, so slot values that contain
    ``{other}`` are never rewritten. ``{{`` / ``}}`` unescape to single braces.
    """
    import re

    parts: list[Column] = []
    pos = 0
    for m in re.finditer(r"\{\{|\}\}|\{([A-Za-z_][A-Za-z0-9_]*)\}", template):
        if m.start() > pos:
            parts.append(F.lit(template[pos:m.start()]))
        tok = m.group(0)
        if tok == "{{":
            parts.append(F.lit("{"))
        elif tok == "}}":
            parts.append(F.lit("}"))
        else:
            name = m.group(1)
            if name not in slots:
                raise KeyError(f"template slot {name!r} has no column")
            parts.append(F.coalesce(_c(slots[name]).cast("string"), F.lit("")))
        pos = m.end()
    if pos < len(template):
        parts.append(F.lit(template[pos:]))
    return F.concat(*parts) if parts else F.lit("")


def md_header_fix(text) -> Column:
    """X11: move the line break after each ``**Header**`` in front of it."""
    return F.regexp_replace(_c(text), r"(\*\*.*?\*\*)\n", "\n$1")
