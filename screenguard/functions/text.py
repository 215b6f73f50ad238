"""Scalar functions of recognised text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..patterns import LABELS, LONGEST_WORD

BLANK = r"(?U)^\s+|\s+\z"


def trimmed(text: Column) -> Column:
    """Without white space at its ends, of any kind Unicode knows."""
    return F.regexp_replace(text, BLANK, "")


def normalised(text: Column) -> Column:
    """Digits and signs that recognition confuses with letters, as letters."""
    return F.translate(text, "1|05@", "llosa")


def collapsed(text: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(text, r"(?U)\s", "")


def is_word(word: Column, words: tuple[str, ...]) -> Column:
    """Whether a lower-case word is in the list; longer ones aren't looked up."""
    return (word != "") & (F.octet_length(word) <= LONGEST_WORD) & word.isin(*words)


def tokens(text: Column) -> Column:
    """Runs of alphabetic characters."""
    return F.filter(F.split(text, r"\P{IsAlphabetic}+"), lambda w: w != "")


def hex_chunk(text: Column) -> Column:
    """A row's hexadecimal digits without 0x and spaces if it holds nothing else and at least 8; else null."""
    body = F.regexp_replace(F.regexp_replace(trimmed(text), "^0[xX]", ""), r"[ \t\n\f\r]", "")
    return F.when(body.rlike(r"^[0-9A-Fa-f]{8,}\z"), body)


def kind_label(kind: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, label in LABELS.items():
        out = F.when(kind == k, label).otherwise(out)
    return out


def frame_name(frame: Column) -> Column:
    return F.format_string("frame_%05d.png", frame)


def bundle_name(bundle: Column) -> Column:
    return F.replace(F.coalesce(bundle, F.lit("unknown")), F.lit("."), F.lit("_"))


def search_term(term: Column) -> Column:
    """Percent-encoded; a space as %20, and slashes as they are."""
    return F.replace(F.replace(F.replace(F.replace(F.url_encode(term), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def terminal_line(line: Column) -> Column:
    """An environment line as a terminal shows it."""
    return F.concat(F.lit("$env:"), F.replace(line, F.lit("="), F.lit(" = '")), F.lit("'"))
