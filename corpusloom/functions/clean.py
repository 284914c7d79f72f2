"""The ordered text cleaner: 19 column expressions, folded left to right; the order is part of the meaning.

Patterns run in the JVM.  `(?Ud)` gives character classes and line ends their Unicode meaning, and grouped repeats are
possessive, since a backtracking repeat over a long numeric run overflows the regex engine's stack.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

FLAGS = "(?Ud)"
#: Marks of tag-and-transform replacement; stripped from input first.
OPEN, CLOSE = "\ue000", "\ue001"

# The cleaner's patterns (possessive where a group repeats) and replacements.
PATTERNS = {
    "html_breaks": (r"(?i)<br\s*+/?>", " "),
    "html_spans": (r"(?i)</?span[^>]*+>", ""),
    "page_numbers": (r"(?i)(?:p[áa]gina|pg\.?)\s*+\d++(?:\s?de\s?\d++)?", ""),
    "axis_numbers": (r"(?:\b\d{1,3}\b(?:\s++|,)?+\s?+){4,}+", ""),
    "price_runs": (r"(?:R\$\s*+\d++(?:[.,]\d{0,2})?+\s*+){2,}+", ""),
    "bare_currency": (r"\b(?:R\$\s*+){2,}+", ""),
    "decimal_runs": (r"(?:\d++[.,]\d{2}\s*+){2,}+", ""),
    "hyphen_join": (r"(\w)-\s*\n\s*([a-zà-ú])", "$1$2"),
    "line_join": (r"([a-zà-ú,;])\n++([a-zà-ú])", "$1 $2"),
    "spaces": (r" ++", " "),
    "newlines": (r"\n{3,}+", "\n\n"),
    "punctuation": (r"([.?!,;])\1++", "$1"),
    "print_headers": (r"(?i)\d{1,2}/\d{1,2}/\d{2,4},?\s+\d{1,2}:\d{2}\s*(?:AM|PM)?\s+.*", ""),
    "promote_subject": (r"(?mi)^(Assunto:[^\n]+)$", "\n### $1\n"),
    "promote_bold": (r"(?m)^\*\*([^*]{5,120})\*\*\s*$", "\n### $1\n"),
}
CAPS = r"(?m)^[A-ZÀ-Ú0-9\s,.\-/]{10,120}$"
#: The patterns that count as visual garbage in scoring.
GARBAGE = ("page_numbers", "axis_numbers", "price_runs", "bare_currency")


def strip(text: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(text, r"(?U)^\s++|\s++$", "")


def repair_encoding(text: Column) -> Column:
    """UTF-8 once read as Latin-1, repaired whole or not at all."""
    suspect = (F.contains(text, F.lit("Ã")) | F.contains(text, F.lit("Â"))) & ~text.rlike(r"[^\x00-\xff]")
    return F.when(suspect, F.coalesce(F.try_validate_utf8(F.encode(text, "ISO-8859-1").cast("string")), text)).otherwise(text)


def form_feeds(text: Column) -> Column:
    return F.replace(text, F.lit("\f"), F.lit(""))


def rewrite(text: Column, pattern: str, change: Callable[[Column], Column]) -> Column:
    """Each match of a pattern replaced by a function of it: matches are marked, the text is split at the marks, odd pieces are changed."""
    marked = F.regexp_replace(F.translate(text, OPEN + CLOSE, ""), FLAGS + pattern, f"{OPEN}$0{CLOSE}")
    pieces = F.split(marked, f"[{OPEN}{CLOSE}]")
    return F.array_join(F.transform(pieces, lambda x, i: F.when(i % 2 == 1, change(x)).otherwise(x)), "")


def promote_caps(text: Column) -> Column:
    """Blocks in capitals become second-level headings, unless they are one word or digits only."""

    def heading(block: Column) -> Column:
        line = strip(block)
        plain = ~line.rlike(r"(?U)\S\s+\S") | line.rlike(r"(?U)^[\d\s.,\-]+$")
        return F.when(plain, line).otherwise(F.concat(F.lit("\n## "), line, F.lit("\n")))

    return rewrite(text, CAPS, heading)


def _pattern_rule(name: str) -> Callable[[Column], Column]:
    pattern, replacement = PATTERNS[name]
    return lambda text: F.regexp_replace(text, FLAGS + pattern, replacement)


RULES: dict[str, Callable[[Column], Column]] = {
    "repair_encoding": repair_encoding,
    "form_feeds": form_feeds,
    **{k: _pattern_rule(k) for k in list(PATTERNS)[:13]},
    "promote_caps": promote_caps,
    **{k: _pattern_rule(k) for k in ("promote_subject", "promote_bold")},
    "strip": strip,
}


def clean(text: Column, rules: list[str] | None = None) -> Column:
    """The whole cleaner, or the named rules in their order; null is empty."""
    chosen = [f for k, f in RULES.items() if rules is None or k in rules]
    return reduce(lambda t, f: f(t), chosen, F.coalesce(text, F.lit("")))


def garbage_hits(text: Column) -> Column:
    return sum((F.regexp_count(text, F.lit(FLAGS + PATTERNS[k][0])) for k in GARBAGE[1:]), F.regexp_count(text, F.lit(FLAGS + PATTERNS[GARBAGE[0]][0])))
