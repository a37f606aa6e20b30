"""Correction of optical character recognition by ordered rules, folded into one Column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, py_strip, word_count

_MONTHS = "OCTOBRE|JANVIER|FÉVRIER|MARS|AVRIL|MAI|JUIN|JUILLET|AOÛT|SEPTEMBRE|NOVEMBRE|DÉCEMBRE"
#: Fixed values, in this order: what is matched (ignoring case) and what stands instead.
FIRST_RULES = [
    ("\\bcudi\\b", "Jeudi"), ("\\bcudl\\b", "Jeudi"), ("\\beudi\\b", "Jeudi"),
    ("\\blus\\s+d'infos\\b", "plus d'infos"), ("\\blus\\s+d'fos\\b", "plus d'infos"), ("d'fos\\b", "d'infos"),
    ("\\btol\\s+N°", "LOI N°"), ("\\bou\\s+16\\s+OCTOBRE", "DU 16 OCTOBRE"), (f"\\bou\\s+(\\d{{1,2}})\\s+({_MONTHS})", "DU $1 $2"),
    ("\\bPérode\\b", "Période"), ("\\b[BM]\\s+Période", "BB Période"), ("REPUBLIQUE\\s+DEMOCRATIQUE", "REPUBLIQUE DEMOCRATIQUE"), ("\\s+", " "),
]
WORD_RULES = [
    ("\\bmbre\\b", "décembre"), ("\\bplus d'infos\\b", "plus d'infos"), ("\\bREPUBLIQUE\\b", "REPUBLIQUE"), ("\\bDEMOCRATIQUE\\b", "DEMOCRATIQUE"), ("\\bCONGO\\b", "CONGO"),
    ("\\b24 décembre\\b", "24 décembre"), ("\\b25 décembre\\b", "25 décembre"), ("\\b31 décembre\\b", "31 décembre"), ("\\bou 16\\b", "DU 16"),
]
DATE_RULES = [("(\\d{1,2})\\s+(décembre|mbre)\\s+(\\d{4})", "$1 décembre $3")]
FRENCH_RULES = [
    ("\\bREPUBLIQUE\\s+DEMOCRATIQUE\\s+DU\\s+CONGO\\b", "REPUBLIQUE DEMOCRATIQUE DU CONGO"), (f"\\bou\\s+(\\d{{1,2}})\\s+({_MONTHS})", "DU $1 $2"),
    ("\\b[BM]\\s+Période", "BB Période"), ("\\bJOURNAL\\s+OFFICIEL\\s+REPUBLIQUE\\b", "JOURNAL OFFICIEL\nDE LA\nREPUBLIQUE"),
]


def fold(c: Column, rules: list[tuple[str, str]], flags: str = "(?iuU)") -> Column:
    return reduce(lambda text, rule: F.regexp_replace(text, flags + rule[0], rule[1]), rules, c)


#: Any rule but white space can only change a text that holds one of these, case folded, or matches one of the patterns.
_HINTS = ["cudi", "cudl", "eudi", "d'info", "d'fo", "tol", "pérode", "période", "republique", "democratique", "congo", "mbre", "journal"]
_PATTERNS = ["(?iuU)\\bou\\s+\\d", "(?U)\\d\\s+\\d\\s+\\d{4}"]


def may_change(c: Column) -> Column:
    """Whether any rule but that for white space can fit: fixed words first, which cost little, then two short patterns."""
    folded = F.lower(F.translate(c, "ıİſ", "iis"))  # as case-insensitive patterns fold characters
    hints = lambda x: reduce(lambda a, b: a | b, (x.contains(h) for h in _HINTS))
    return let(folded, hints) | reduce(lambda a, b: a | b, (c.rlike(p) for p in _PATTERNS))


def correct_text(c: Column) -> Column:
    """blank text stays; otherwise dates, patterns, words, spaced digits, French words, then tidy lines.

    Most texts fit no rule; then only white space is tidied.
    """
    month = "\\b(\\d{1,2})\\s+mbre\\s+(\\d{4})\\b"
    december = F.lower(c).contains("décembre")  # day 2 becomes 25 only where the text names the month already
    dated = F.when(december, fold(fold(c, [("\\b2\\s+mbre\\s+(\\d{4})\\b", "25 décembre $1")]), [(month, "$1 décembre $2")])).otherwise(fold(c, [(month, "$1 décembre $2")]))
    text = fold(fold(fold(dated, FIRST_RULES), WORD_RULES), DATE_RULES)
    text = fold(text, [("\\b(\\d)\\s+(\\d)\\s+(\\d{4})\\b", "$1$2$3")], "(?U)")
    plain = F.regexp_replace(c, "(?U)\\s+", " ")
    return F.when(py_strip(c) == "", c).when(may_change(c), tidy(fold(text, FRENCH_RULES))).otherwise(tidy(plain))


def tidy(c: Column) -> Column:
    """single spaces, stripped lines, at most one blank line."""
    lines = F.array_join(F.transform(F.split(F.regexp_replace(F.regexp_replace(c, " +", " "), "\n{3,}", "\n\n"), "\n"), py_strip), "\n")
    return py_strip(F.regexp_replace(lines, "\n\\s*\n\\s*\n", "\n\n"))


def adjust_confidence(text: Column, corrected: Column, confidence: Column) -> Column:
    """a change of over a fifth of the words lowers confidence, else it rises, to 1 at most."""
    before = word_count(text)
    return F.when(F.abs(before - word_count(corrected)) > before * 0.2, confidence * 0.9).otherwise(F.least(F.lit(1.0), confidence * 1.05))
