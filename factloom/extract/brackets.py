"""Balanced text as patterns: calls, decorators and bodies with strings and comments inside, whatever stands in them.

``balanced`` is a possessive pattern, so a text is read once and nothing is tried again: strings and comments are units, a bracket
that opens takes all up to the one that closes it, ``DEPTH`` levels deep. It ends before a closing bracket that was not opened in it.
``records`` marks every match of a pattern and cuts the marked groups out in one pass; patterns look ahead for
what follows their head, so that calls inside calls are found as well.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEPTH = 16
RECORD, FIELD = "\x01", "\x02"

# Lexical units. A mark that opens nothing on its line (an apostrophe in a comment, a lifetime) stands for itself.
DOUBLE, SINGLE, BACKTICK = r'"(?:[^"\\\n]++|\\[\s\S])*+"', r"'(?:[^'\\\n]++|\\[\s\S])*+'", r"`(?:[^`\\]++|\\[\s\S])*+`"
TRIPLE = r'"""(?:[^"\\]++|\\[\s\S]|"(?!""))*+"""|' + r"'''(?:[^'\\]++|\\[\s\S]|'(?!''))*+'''"
SLASHES, BLOCK, HASH = r"//[^\n]*+", r"/\*(?:[^*]++|\*(?!/))*+\*/", r"#[^\n]*+"
# a slash after an operator opens a regular expression
PATTERN = r"(?<=[(,=:!&|?;\[{}\n][ \t]{0,9})/(?![*/])(?:[^/\\\n\[]++|\\.|\[(?:[^\]\\\n]++|\\.)*+\])++/"

# a single quote in Rust also opens a lifetime; its strings may go over lines, as Go's raw ones
LINES, CHARACTER = r'"(?:[^"\\]++|\\[\s\S])*+"', r"'(?:[^'\\\n]|\\[^\n]{1,8}?)'"
RAW = r"`[^`]*+`"

STRINGS = {"js": (DOUBLE, SINGLE, BACKTICK), "py": (TRIPLE, DOUBLE, SINGLE), "c": (DOUBLE, SINGLE), "rs": (LINES, CHARACTER), "go": (DOUBLE, CHARACTER, RAW), "prisma": (DOUBLE,)}
COMMENTS = {"py": (HASH,), "prisma": (SLASHES,)}
OTHER = {"js": (PATTERN,)}


def comments(family: str) -> tuple[str, ...]:
    return COMMENTS.get(family, (BLOCK, SLASHES))


def _units(family: str) -> str:
    return "|".join((*comments(family), *STRINGS[family], *OTHER.get(family, ())))


def bracketed(family: str, depth: int = DEPTH) -> str:
    """An opening bracket up to the one that closes it."""
    return r"[(\[{]" + balanced(family, depth - 1) + r"[)\]}]"


def balanced(family: str, depth: int = DEPTH, without: str = "") -> str:
    """Text in which all brackets close; ``without`` are characters that end it at its own level."""
    inner = "|" + bracketed(family, depth) if depth > 0 else ""
    lone = "".join(c for c in "\"'`/#" if c not in without)
    return rf"(?:[^()\[\]{{}}\"'`/#{without}]++|{_units(family)}{inner}|[{lone}])*+"


def item(family: str) -> str:
    """What stands between two commas of a list."""
    return balanced(family, without=",")[:-2] + "++"


def without_comments(text: Column, family: str) -> Column:
    return F.regexp_replace(text, f"({'|'.join((*STRINGS[family], *OTHER.get(family, ())))})|{'|'.join(comments(family))}", "$1")


def items(text: Column, family: str) -> Column:
    """The items of a list, trimmed and without comments; empty ones are left out."""
    found = F.regexp_extract_all(without_comments(text, family), F.lit(item(family)), F.lit(0))
    return F.filter(F.transform(found, lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")


def records(text: Column, pattern: Column | str, fields: int) -> Column:
    """The first ``fields`` groups of every match, as an array of arrays; the pattern must have that many groups."""
    rx = pattern if isinstance(pattern, Column) else F.lit(pattern)
    put = RECORD + FIELD.join(f"${k}" for k in range(1, fields + 1)) + RECORD
    parts = F.split(F.regexp_replace(F.translate(text, RECORD + FIELD, "  "), rx, F.lit(put)), RECORD)
    return F.transform(F.filter(parts, lambda _, k: k % 2 == 1), lambda x: F.split(x, FIELD))


def unquoted(text: Column) -> Column:
    """What stands between quotation marks, with the letters before them (r, f, b) left out."""
    return F.regexp_extract(text, r"(?s)^[A-Za-z]{0,2}(\"\"\"|'''|[\"'`])(.*)\1$", 2)


QUOTED = r"(?s)^[A-Za-z]{0,2}[\"'`].*[\"'`]$"


def joined_literals(text: Column, known: Column, family: str) -> Column:
    """The text that literals and known constants joined by ``+`` make; null where another part takes part.

    ``known`` is an array of (name, value). ``${NAME}`` in a literal is replaced where the name is known.
    """
    term = balanced(family, without="+")[:-2] + "++"
    value = lambda name: F.get(F.filter(known, lambda x: x["name"] == name), F.lit(0))["value"]
    fill = lambda t: F.aggregate(known, t, lambda acc, x: F.replace(acc, F.concat(F.lit("${"), x["name"], F.lit("}")), x["value"]))
    part = lambda t: F.when(t.rlike(QUOTED), F.when(F.contains(t, F.lit("${")), fill(unquoted(t))).otherwise(unquoted(t))).when(t.rlike(r"^[A-Za-z_$][\w$.]*$"), value(F.regexp_extract(t, r"([\w$]+)$", 1)))
    parts = F.transform(F.regexp_extract_all(text, F.lit(term), F.lit(0)), lambda t: part(F.trim(t)))
    whole = F.aggregate(parts, F.lit(""), lambda acc, t: F.concat(acc, t))
    return F.when((F.size(parts) > 0) & ~F.exists(parts, lambda t: t.isNull()), whole)
