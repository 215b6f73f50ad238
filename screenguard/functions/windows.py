"""Foreground windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..patterns import EDITORS, TERMINALS, TITLE_HINTS, WALLETS


def _any(text: Column, parts: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in parts])


def window_verdict(title: Column, process: Column) -> Column:
    """CryptoWallet, SecretsEditor, Terminal or NotSensitive; the first that fits, on lower case."""
    t, p = F.lower(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(process, F.lit("")))
    return F.when(_any(p, WALLETS) | _any(t, WALLETS), "CryptoWallet").when(_any(p, EDITORS) & _any(t, TITLE_HINTS), "SecretsEditor").when(_any(p, TERMINALS), "Terminal").otherwise("NotSensitive")


def verdict_sensitive(verdict: Column) -> Column:
    return verdict != "NotSensitive"
