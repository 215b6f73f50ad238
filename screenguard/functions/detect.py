"""Detectors of secrets in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..patterns import DETECTORS, LONGEST_WORD, SEED_RUN, java
from .text import collapsed, normalised, tokens


def seed_bits(text: Column, words: tuple[str, ...]) -> Column:
    """A 1 for each token that is in the word list, a 0 for each other."""
    bit = lambda w: F.when((F.octet_length(F.lower(w)) <= LONGEST_WORD) & F.lower(w).isin(*words), "1").otherwise("0")
    return F.array_join(F.transform(tokens(text), bit), "")


def seed_phrase(text: Column, words: tuple[str, ...]) -> Column:
    """Whether SEED_RUN words of the list follow one another."""
    sizes = [n for w in words if (n := len(w)) <= LONGEST_WORD] or [1]
    token = rf"\p{{IsAlphabetic}}{{{min(sizes)},{max(sizes)}}}+"
    # nearly all texts lack so many tokens of the words' lengths in a row, which costs little to see
    may = text.rlike(rf"(?<!\p{{IsAlphabetic}})(?:{token}\P{{IsAlphabetic}}++){{{SEED_RUN - 1}}}{token}(?!\p{{IsAlphabetic}})") if all(map(str.isascii, words)) else F.lit(True)
    return may & F.contains(seed_bits(text, words), F.lit("1" * SEED_RUN))


def seed_range(text: Column, words: tuple[str, ...]) -> Column:
    """(start, stop) of the first longest run of SEED_RUN or more words, as token numbers from 0; null if none."""
    bits = seed_bits(text, words)
    runs = F.regexp_extract_all(bits, F.lit("(0+|1+)"), F.lit(1))
    # state: where the next run starts, and the best so far
    state = F.struct(F.lit(0).alias("at"), F.lit(0).alias("start"), F.lit(0).alias("n"))

    def step(a: Column, run: Column) -> Column:
        better = run.startswith("1") & (F.length(run) >= SEED_RUN) & (F.length(run) > a["n"])
        return F.struct((a["at"] + F.length(run)).alias("at"), F.when(better, a["at"]).otherwise(a["start"]).alias("start"), F.when(better, F.length(run)).otherwise(a["n"]).alias("n"))

    best = F.aggregate(runs, state, step)
    return F.when(best["n"] > 0, F.struct(best["start"].alias("start"), (best["start"] + best["n"]).alias("stop")))


def high_entropy(token: Column) -> Column:
    return token.rlike("[0-9]") & token.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(token, ""))) >= 8)


def matches(text: Column, kind: str) -> Column:
    """Whether one detector other than the seed phrase's fires."""
    pattern = java(DETECTORS[kind])
    if kind == "SolanaKey":
        return text.rlike(pattern) & ~F.contains(text, F.lit(" "))
    if kind == "HighEntropyToken":
        return F.exists(F.regexp_extract_all(text, F.lit(DETECTORS[kind]), F.lit(0)), high_entropy)
    return text.rlike(pattern)


def scan(text: Column, words: tuple[str, ...]) -> Column:
    """The kinds that fire, in reporting order; a seed phrase stands alone. Empty for null."""
    others = F.array_compact(F.array(*[F.when(matches(text, k), F.lit(k)) for k in DETECTORS]))
    none = F.array().cast("array<string>")
    return F.when(text.isNull(), none).when(seed_phrase(text, words), F.array(F.lit("SeedPhrase"))).otherwise(others)


def scan_row(text: Column, words: tuple[str, ...]) -> Column:
    """Kinds of a row of recognised text: of its normalised, its raw and its collapsed form, each once."""
    thick = collapsed(text)
    none = F.array().cast("array<string>")
    first = F.when(normalised(text) != text, scan(normalised(text), words)).otherwise(none)
    third = F.when((F.octet_length(thick) >= 16) & (thick != text), scan(thick, words)).otherwise(none)
    return F.array_distinct(F.concat(first, scan(text, words), third))
