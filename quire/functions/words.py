r"""Word tokens (X4): the Treebank rule cascade as Column expressions.

Words, punctuation, quotes and contractions are told apart by a fixed sequence of substitutions that put blanks around
tokens; what blanks divide at the end are the tokens. Opening double quotes become two backticks, closing ones two
apostrophes. A period is a token of its own only at the end of a sentence, so sentences are found first.

Rules work on one string per text: white space is made one blank, sentences are ended by a line break, and rules for a
sentence's begin or end are multi-line patterns. Patterns keep to what common regular expression engines share (no
look-around), so that other engines give the same tokens.

Sentences are split by rule, not by a trained model: after ``.``, ``?`` or ``!`` with closing quotes or brackets, before
a capital letter, a digit or an opening mark; not after a single capital (an initial) or an abbreviation of
:data:`ABBREVIATIONS`. ``wanna`` and the like are divided only where the rules say so. NULL text gives NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import BLANKS

__all__ = ["ABBREVIATIONS", "RULES", "word_text", "word_tokens", "word_count"]

# ---- fixed values: abbreviations that do not end a sentence ------------------
ABBREVIATIONS = ["Mr", "Mrs", "Ms", "Dr", "Prof", "St", "Jr", "Sr", "vs", "etc", "e.g", "i.e", "Inc", "Ltd", "Co", "No", "Vol", "Fig"]

_CLOSING = r"""["'”’»)\]}]*"""
_OPENING = r"""["'“‘„«`(\[{]*"""
_LETTER = r"a-zA-Z0-9_À-ÖØ-öø-\x{1FFF}\x{2C00}-\x{D7FF}\x{F900}-\x{FDCF}"
# a one-character word that is no clitic (m, t, s, d, n in either case)
_LONE = r"a-ce-lo-ru-zA-CE-LO-RU-Z0-9_À-ÖØ-öø-\x{1FFF}\x{2C00}-\x{D7FF}\x{F900}-\x{FDCF}"
_NOT_SPACE = BLANKS.replace("\\x1c-\\x20", "\\x1c-\\x1f")
_ABBREVIATION = "|".join(a.replace(".", "[.]") for a in ABBREVIATIONS)
_CLOSED = "\ufdd4"  # a noncharacter: a closing double quote while apostrophes are looked at

#: (name, pattern, replacement), applied in this order. Patterns begin with what is rare in a text, and leave single
#: blanks alone, since each is one pass over it.
RULES: list[tuple[str, str, str]] = [
    ("one blank", f"(?:{_NOT_SPACE}| {BLANKS}){BLANKS}*", " "),
    # sentences: an end mark, closing marks, a blank, then a begin. Abbreviations and initials are undone.
    ("sentence end", rf"([.?!]{_CLOSING}) ({_OPENING}[A-ZÀ-ÖØ-Þ0-9])", "$1\n$2"),
    ("abbreviation", rf"""((?:^|[ \n("'“‘«\[{{-])(?:{_ABBREVIATION}|[A-Z])[.])\n""", "$1 "),
    # opening quotes
    ("opening marks", r"(`+|[«“‘„(\[{<])", " $1 "),
    ("opening quotes", """(^|[ \n])("|'')""", "$1 `` "),
    ("apostrophe before a lone letter", rf"'([{_LONE}])([^{_LETTER}]|$)", "' $1$2"),
    # punctuation
    ("period at a sentence's end", r"""(?m)([^.\n])[.]([\])}>"'»”’ ]*)$""", "$1 . $2 "),
    ("colon and comma before no digit", r"([:,])([^0-9]|$)", " $1 $2"),
    ("marks", r"([.]{2,}|--|[;@#$%&?!*\])}>»”’])", " $1 "),
    # closing quotes, apostrophes and clitics before a blank
    ("closing quotes", """(?:''|")""", f" {_CLOSED} "),
    ("clitics", r"(n't|N'T|'(?:ll|LL|re|RE|ve|VE|[sSmMdD])?)( |\n|$)", " $1 $2"),
    ("closed quotes", _CLOSED, "''"),
    # contractions
    ("cannot, gimme, gonna, gotta, lemme", r"(?i)(^|[ \n])(?:(can)(not)|(gim|lem)(me)|(gon)(na)|(got)(ta))\b", "$1$2$4$6$8 $3$5$7$9 "),
    ("d'ye, more'n, wanna, 'tis, 'twas", r"(?i)(^|[ \n])(?:(d)('ye)\b|(more)('n)\b|(wan)(na) |('t)(is\b|was\b))", "$1$2$4$6$8 $3$5$7$9 "),
]


def word_text(text) -> Column:
    """The text with blanks (or line breaks, at sentence ends) between all tokens."""
    t = F.col(text) if isinstance(text, str) else text
    for _, pattern, to in RULES:
        t = F.regexp_replace(t, pattern, to)
    return t


def word_tokens(text) -> Column:
    """The tokens of a text, in order."""
    return F.filter(F.split(word_text(text), "[ \n]+"), lambda w: w != "")


def word_count(text) -> Column:
    """How many tokens a text has, without an array of them."""
    one = F.regexp_replace(word_text(text), "[^ \n]+", "a")
    return F.length(F.regexp_replace(one, "[ \n]+", ""))
