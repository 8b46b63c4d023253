"""Normalisation of note text as chains of column expressions, and the tokeniser.

Patterns start with flags that give Java the meaning of Unicode classes, line ends at \\n only and ignored case.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLAGS = "(?iumdU)"

#: What is rewritten, in this order. UNITS and VITALS stand for steps that a plain replacement can't take.
#: Characters that look alike or can't be seen (blanks, dashes, bullets) are written as escapes, to be told apart in print.
UNITS, VITALS = "units", "vitals"
RULES: list[tuple[str, str]] = [
    # redaction
    (r"\*{2}[/-]\*{2}[/-]\*{4}", "[DATE-REDACTED]"),
    (r"\*{3,}", "[REDACTED]"),
    (r"(?<=\w)\[(?:REDACTED|DATE-REDACTED)\](?=\w)", " [REDACTED] "),
    # blanks and dashes
    (r"[\u00A0\u2000-\u200B\u202F\u2060]+", " "),
    (r"[\u2013\u2014]+", "-"),
    # question marks that separate
    (r"^\s*\?+\s*$", ""),
    (r"(\s)\?(\s)", "\n"),
    (r"\?{2,}(?!\w)", ""),
    # bullets
    (r"^[\u2022\u25AA\u25CF>\-]\s*", ""),
    # units and ratios
    (UNITS, ""),
    (r"(\d+)\s*(mg)\s*/\s*(\d+)\s*(ml)\b", "$1 $2/$3 $4"),
    # headings: a line ends after the colon. A run of letters, bars and blanks of any length is looked at once, from its
    # start or from where the heading before it ended; its first letter must be followed by two more characters of it
    (r"(?:\G|(?<![A-Za-z/\s]))([/\s]*+[A-Za-z][A-Za-z/\s]{2,}+:)\s*", "$1\n"),
    (VITALS, ""),
    # frequencies and routes
    (r"\bBID\b", "BID (twice daily)"),
    (r"\bTID\b", "TID (three times daily)"),
    (r"\bQID\b", "QID (four times daily)"),
    (r"\bQD\b", "QD (once daily)"),
    (r"\bQHS\b", "QHS (at bedtime)"),
    (r"\bQ(\d+)H\b", "Q$1H (every $1 hours)"),
    (r"\bPRN\b", "PRN (as needed)"),
    (r"\bPO\b", "PO (by mouth)"),
    (r"\bIV\b", "IV (intravenous)"),
    (r"\bSQ\b", "SQ (subcutaneous)"),
    (r"\bIM\b", "IM (intramuscular)"),
    (r"\bmIVF\b", "mIVF (intravenous fluids)"),
    (r"Take\s+(\d+)\s+tablet\s*\((\d+\s*mg)\s+total\)", "Take $1 tablet of $2"),
    # white space
    (r"[ \t]+$", ""),
    (r"\n{3,}", "\n\n"),
    (r"[^\S\n]{2,}", " "),
]
#: Units in lower case, and abbreviations that keep their upper case. Those that hold a digit are left out:
#: only words of letters alone are looked at, so they can never match.
UNIT_NAMES = ("mg", "mcg", "ml", "g", "l", "mcl")
KEPT_UPPER = ("PO", "IV", "IM", "SQ", "PRN", "XR", "ER", "CR", "SR", "BID", "TID", "QID", "QD", "QHS", "QOD", "BP", "HR", "RR")


@F.arrow_udf(T.StringType())
def nfkc(s: pa.Array) -> pa.Array:
    """Unicode NFKC, which Spark has no function for; texts that have that form, as most do, are passed on.

    pyarrow's own kernel leaves letters and their accents apart (23.0.1), which isn't NFKC, so Python's is used.
    """
    done = lambda x: x is None or x.isascii() or unicodedata.is_normalized("NFKC", x)
    return pa.array([x if done(x) else unicodedata.normalize("NFKC", x) for x in s.to_pylist()], pa.string())


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value computed once a row."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _where(there: Callable[[Column], Column], f: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """f, for texts that have what its patterns need; a look for that is cheaper than the patterns."""
    return lambda text: _let(text, lambda t: F.when(there(t), f(t)).otherwise(t))


def _sub(text: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(text, F.lit(FLAGS + pattern), F.lit(by))


def line_ends(text: Column, tab: str = "    ") -> Column:
    """CRLF and CR to LF, tabs to spaces."""
    t = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.replace(t, F.lit("\t"), F.lit(tab))


def _units(text: Column) -> Column:
    """A space between number and unit, the unit in lower case; a unit ends at a word's end, so at most one fits."""
    for unit in UNIT_NAMES:
        text = _sub(text, rf"(\d+)\s*{unit}\b", f"$1 {unit}")
    return text


def _vitals(text: Column) -> Column:
    """Bars to full stops, on lines of vital signs only."""
    told = lambda line: line.rlike(r"(?iuU)\bBP\b") & line.rlike(r"(?iuU)\bPulse\b") & line.contains("|")
    return F.array_join(F.transform(F.split(text, "\n"), lambda x: F.when(told(x), F.replace(x, F.lit(" | "), F.lit(". "))).otherwise(x)), "\n")


def _has(*parts: str) -> Callable[[Column], Column]:
    return lambda t: reduce(lambda x, y: x | y, (t.contains(p) for p in parts))


def _matches(pattern: str) -> Callable[[Column], Column]:
    return lambda t: t.rlike(FLAGS + pattern)


#: What a text must hold for runs of rules to change it: how many rules, and the look for it. None: always applied.
GUARDS: list[tuple[int, Callable[[Column], Column] | None]] = [
    (3, _has("**", "[")), (1, None), (1, _has("\u2013", "\u2014")), (3, _has("?")), (1, None), (1, _matches(rf"\d\s*(?:{'|'.join(UNIT_NAMES)})\b")), (1, _has("/")), (1, _has(":")), (1, _has("|")),
    (12, _matches(r"\b(?:[BTQ]ID|QD|QHS|Q\d+H|PRN|PO|IV|SQ|IM|mIVF)\b")), (1, _has("(")), (1, None), (1, _has("\n\n\n")), (1, None),
]


def _rule(pattern: str, by: str) -> Callable[[Column], Column]:
    return _units if pattern == UNITS else _vitals if pattern == VITALS else lambda t: _sub(t, pattern, by)


def rules(first: int = 0, end: int | None = None) -> Callable[[Column], Column]:
    """The rewrites RULES[first:end], one after another."""
    return lambda text: reduce(lambda t, rule: _rule(*rule)(t), RULES[first:end], text)


def apply_rules(text: Column) -> Column:
    """All rewrites, one after another."""
    at = 0
    for n, guard in GUARDS:
        run = rules(at, at + n)
        text, at = (_where(guard, run) if guard else run)(text), at + n
    return text


#: Pieces whose case is looked at: words, and runs of what stays as it is: lower-case words, if they have over three letters
#: or are no abbreviation in ASCII, and what lies between words. A run has an end, for Java goes a call deeper with each part.
CASED = r"((?:[^\p{L}\p{N}_]++|\p{Ll}{4,}+(?![\p{L}\p{N}_])|(?!(?:KNOWN)(?![\p{L}\p{N}_]))[a-z]{1,3}+(?![\p{L}\p{N}_])){1,60}|[\p{L}\p{N}_]+)".replace("KNOWN", "|".join(KEPT_UPPER).lower())


def repair_case(text: Column) -> Column:
    """Mixed-case words to lower case, known abbreviations to upper case, all else as it is."""
    known = F.array(*map(F.lit, KEPT_UPPER))
    fix = lambda w: (
        F.when((F.length(w) > 3) & (w == F.lower(w)), w).when(~w.rlike(r"^\p{L}+$"), w).when(F.array_contains(known, F.upper(w)), F.upper(w)).when((w != F.lower(w)) & (w != F.upper(w)), F.lower(w)).otherwise(w)
    )
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(CASED), F.lit(1)), fix), "")


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+", ""), r"(?U)\s+\z", "")


def tidy(text: Column) -> Column:
    """Lines without trailing spaces, at most one empty line in a row, none at either end."""
    t = F.regexp_replace(text, r"[ \u00A0]+(?=\n|\z)", "")
    return strip(F.regexp_replace(t, "\n{3,}", "\n\n"))


def clean(text: Column) -> Column:
    """The chain after Unicode normalisation."""
    return tidy(repair_case(apply_rules(line_ends(text))))


def normalise(text: Column | str, unicode: bool = True) -> Column:
    """The whole chain; null becomes empty."""
    t = F.coalesce(text, F.lit(""))
    return clean(nfkc(t) if unicode else t)


def minimal(text: Column | str, unicode: bool = True) -> Column:
    """The light variant: NFKC, LF, tabs to a space, no blanks at line ends."""
    t = F.coalesce(text, F.lit(""))
    t = line_ends(nfkc(t) if unicode else t, " ")
    return F.regexp_replace(t, r"[ \u00A0]+(?=\n|\z)", "")


def tokens(text: Column | str) -> Column:
    """Runs of letters, digits and underscores of the lower-cased text."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
