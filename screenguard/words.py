"""The word list of seed phrases.

The whole public list of 2048 words (BIP-39, English) lies beside this file and is the
default; another one is a parameter: a file of a word a line, by argument or in the
setting ``spark.screenguard.wordlist``. SAMPLE is for tests and examples only.
"""

from __future__ import annotations

import pkgutil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTING = "spark.screenguard.wordlist"
#: A word list is inlined into expressions, so it has a bound.
MOST = 1 << 16

# The public list's words under "a".
SAMPLE = tuple(
    """
    abandon ability able about above absent absorb abstract absurd abuse access accident account accuse achieve acid
    acoustic acquire across act action actor actress actual adapt add addict address adjust admit adult advance advice
    aerobic affair afford afraid again age agent agree ahead aim air airport aisle alarm album alcohol alert alien all
    alley allow almost alone alpha already also alter always amateur amazing among amount amused analyst anchor ancient
    anger angle angry animal ankle announce annual another answer antenna antique anxiety any apart apology appear apple
    approve april arch arctic area arena argue arm armed armor army around arrange arrest arrive arrow art artefact
    artist artwork ask aspect assault asset assist assume asthma athlete atom attack attend attitude attract auction
    audit august aunt author auto autumn average avocado avoid awake aware away awesome awful awkward axis
    """.split()
)


#: The whole public list.
ENGLISH = tuple(pkgutil.get_data(__package__, "bip39_english.txt").decode().split())


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """(word): lines of a file, trimmed, without empty ones, each once."""
    return clean_words(spark.read.text(path))


def clean_words(lines: DataFrame) -> DataFrame:
    """lines (value) -> (word)."""
    word = F.regexp_replace("value", r"(?U)^\s+|\s+\z", "")
    return lines.select(word.alias("word")).where("word <> ''").distinct()


def words(spark: SparkSession, path: str | None = None) -> tuple[str, ...]:
    path = path or spark.conf.get(SETTING, None)
    if not path:
        return ENGLISH
    got = [r["word"] for r in read_words(spark, path).limit(MOST + 1).collect()]
    if len(got) > MOST:
        raise ValueError(f"{path} has more than {MOST} words")
    return tuple(sorted(got))
