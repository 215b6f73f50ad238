"""Document fingerprints by locally consistent parsing.

A text is parsed bottom up. Runs of one symbol become one symbol; deterministic coin
tossing turns each symbol and its left neighbour into a label below 6; local maxima of
the labels start phrases; a phrase's name is a hash of its symbols, and the names are the
next level's text. Where two texts share a substring, all phrases but those at its rim
get the same names, wherever it stands. A fingerprint is a bottom-k sketch of the names
of all levels, weighted by the characters that a phrase covers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, prepare, sliced

#: Names of a fingerprint, and hexadecimal digits of each.
NAMES, DIGITS = 64, 12
#: Code points that are parsed together.
PORTION = 1_000_000
#: Names of the first level weigh an eighth of what they cover, so that they count most where there are few others.
FIRST_LEVEL = np.uint64(3)
#: Multipliers of a phrase's places.
_PLACES = np.random.default_rng(5).integers(1 << 62, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x ^= x >> np.uint64(27)
    x *= _C
    x ^= x >> np.uint64(31)
    return x


def _labels(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Coin tossing: symbols that differ from their left neighbours -> labels below 6 that do."""
    for _ in range(4):
        one = x.dtype.type(1)
        d = x.copy()
        d[1:] ^= x[:-1]
        d[first] = x[first] | one
        d &= ~d + one  # the lowest bit in which they differ
        bit = (x & d) != 0
        d -= one
        place = np.bitwise_count(d)
        place += place
        place += bit
        x = place
    return x


def _level(sym: np.ndarray, first: np.ndarray, size: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The next level's names, which of them start a text, and how many characters each covers."""
    new = first.copy()  # runs of one symbol become one
    new[1:] |= sym[1:] != sym[:-1]
    if not new.all():
        start = np.flatnonzero(new)
        run = np.diff(start, append=len(sym))
        size = run if size is None else np.add.reduceat(size, start)
        sym, first = sym[start], first[start]
        many = np.flatnonzero(run > 1)
        if sym.dtype != np.uint64:  # code points stay below 2 ** 21
            sym[many] += (np.minimum(run[many], 1023) << 21).astype(sym.dtype)
        else:
            sym[many] = _mix(sym[many] + run[many].astype(np.uint64) * _A)
    lab = _labels(sym, first)
    cut = np.zeros(len(sym), bool)
    cut[1:-1] = (lab[1:-1] > lab[:-2]) & (lab[1:-1] >= lab[2:]) & ~first[2:]
    cut |= first
    start = np.flatnonzero(cut)
    long = np.diff(start, append=len(sym))
    place = np.arange(len(sym), dtype=np.int32)
    place -= np.repeat(start.astype(np.int32), long)
    place &= len(_PLACES) - 1
    name = np.add.reduceat(_PLACES[place] * sym, start) + long.astype(np.uint64) * _A
    return _mix(name), first[start], long if size is None else np.add.reduceat(size, start)


def sketches(texts: list[str], names: int = NAMES) -> list[np.ndarray]:
    """For each text its ``names`` least ranks, ascending; none for an empty text.

    A name's rank is its hash over its weight, the characters it covers, so the ranks of one
    text mean the same in another.
    """
    out: list[np.ndarray] = [np.empty(0, np.uint64)] * len(texts)
    length = np.fromiter(map(len, texts), np.int64, len(texts))
    sym = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(sym):
        return out
    owner = np.flatnonzero(length)
    first = np.zeros(len(sym), bool)
    first[(np.cumsum(length) - length)[owner]] = True
    size, ranks, whose = None, [], []
    while len(sym):
        sym, first, size = _level(sym, first, size)
        count = np.diff(np.flatnonzero(first), append=len(sym))
        alone = np.repeat(count == 1, count)
        weight = size.astype(np.uint64)
        if not ranks:
            weight = np.where(alone, weight, np.maximum(weight >> FIRST_LEVEL, 1))
        ranks.append(_mix(sym + _A) // weight)
        whose.append(np.repeat(owner, count))
        owner = owner[count > 1]
        sym, first, size = sym[~alone], first[~alone], size[~alone]
    rank, text = np.concatenate(ranks), np.concatenate(whose)
    # the least are nearly always below this; a text for which too few are is sorted whole
    bound = np.minimum(2.0**64 * 4 * names / np.maximum(length, 1), 1.8e19).astype(np.uint64)
    near = rank <= bound[text]
    got = _least(rank[near], text[near], len(texts), names)
    again = np.array([len(g) < names for g in got]) & (np.bincount(text[~near], minlength=len(texts)) > 0)
    if again.any():
        pick = again[text]
        for i, g in enumerate(_least(rank[pick], text[pick], len(texts), names)):
            if again[i]:
                got[i] = g
    return [g >> np.uint64(16) for g in got]


def _least(rank: np.ndarray, text: np.ndarray, texts: int, names: int) -> list[np.ndarray]:
    """Each text's least distinct ranks, ascending."""
    order = np.argsort(rank, kind="stable")
    order = order[np.argsort(text[order], kind="stable")]
    rank, text = rank[order], text[order]
    once = np.ones(len(rank), bool)
    once[1:] = (rank[1:] != rank[:-1]) | (text[1:] != text[:-1])
    rank, text = rank[once], text[once]
    edge = np.searchsorted(text, np.arange(texts + 1))
    return [rank[s : min(e, s + names)] for s, e in zip(edge[:-1], edge[1:], strict=True)]


def fingerprint(sketch: np.ndarray) -> str:
    return "".join(f"{int(r):0{DIGITS}x}" for r in sketch)


def likeness(a: np.ndarray, b: np.ndarray, names: int = NAMES) -> float:
    """Share of the two texts' phrases, by weight, that both have: 1 for equal texts, 0 for nothing shared.

    From the least ranks of the union, Jaccard's ratio J as 2J / (1 + J). Two empty texts
    are alike, one empty text is like no other.
    """
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.union1d(a, b)[:names]
    both = np.isin(union, a) & np.isin(union, b)
    j = both.mean()
    return float(2 * j / (1 + j))


def from_hex(fp: str) -> np.ndarray:
    return np.array([int(fp[i : i + DIGITS], 16) for i in range(0, len(fp), DIGITS)], np.uint64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) of each row's whole text; null texts count as empty, whose fingerprint is empty."""
    prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text", PORTION):
            yield pa.record_batch([b.column(0), pa.array([fingerprint(s) for s in sketches([t or "" for t in b.column(1).to_pylist()])], pa.string())], ["id", "fingerprint"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, fingerprint string")


def edited(text: str, after: str) -> str:
    """The last half of the text replaced by as much of the start of another, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each row.

    The next document is the one of the next greater id, after the last the first; rows of
    one id stand in the order of their texts, and null ids come first. A single document
    is its own next. Null texts count as empty; no rows give no rows; other columns are
    ignored.

    Ids are cut into ranges; each range also gets the first row of the next one. Only the
    ranges' first ids reach the driver.
    """
    spark = docs.sparkSession
    prepare(spark)
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ids = d.select("id")
    n = max(1, 4 * partitions(spark))
    bounds = sorted(set(ids.select(F.percentile_approx("id", [i / n for i in range(1, n)], 100 * n).alias("b")).first()["b"] or []))
    cuts = np.array(bounds, np.int64)

    def place(x: pa.Array) -> np.ndarray:
        at = np.searchsorted(cuts, np.asarray(x.fill_null(0)), side="right").astype(np.int32)
        at[np.asarray(x.is_null())] = -1
        return at

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([pa.array(place(b.column(0))), b.column(0)], ["part", "id"])

    firsts = sorted((r["part"], r["id"]) for r in ids.mapInArrow(ranges, "part int, id long").groupBy("part").agg(F.min("id").alias("id")).collect())
    before = {firsts[i][1]: firsts[i - 1][0] for i in range(len(firsts))}  # the first row of a range is a guest in the one before

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [pa.array(place(b.column(0))), pa.array(np.zeros(b.num_rows, np.int8)), b.column(0), b.column(1)]
            yield pa.record_batch(own, ["part", "guest", "id", "text"])
            who = [i for i, x in enumerate(b.column(0).to_pylist()) if x in before]
            if who:
                guest = b.take(pa.array(who))
                to = [before[x] for x in guest.column(0).to_pylist()]
                yield pa.record_batch([pa.array(to, pa.int32()), pa.array(np.ones(len(to), np.int8)), guest.column(0), guest.column(1)], ["part", "guest", "id", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # rows of one range whose next isn't here yet

        def out(rows: list[tuple], after: str) -> pa.RecordBatch:
            texts = [t for _, t in rows]
            changed = [edited(t, u) for t, u in zip(texts, [*texts[1:], after], strict=True)]
            s = sketches([*texts, after, *changed])
            own, new = s[: len(rows) + 1], s[len(rows) + 1 :]
            return pa.record_batch(
                [
                    pa.array([i for i, _ in rows], pa.int64()),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed], pa.string()),
                    pa.array([fingerprint(x) for x in own[:-1]], pa.string()),
                    pa.array([fingerprint(x) for x in new], pa.string()),
                    pa.array([likeness(a, b) for a, b in zip(own, new, strict=False)], pa.float64()),
                    pa.array([likeness(a, b) for a, b in zip(own, own[1:], strict=False)], pa.float64()),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

        now, chars, done = None, 0, False
        for b in sliced(batches, "text", PORTION):
            for part, guest, i, t in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if part != now:
                    now, done, held, chars = part, False, [], 0
                if done:
                    continue  # further rows of the guest's id
                if chars >= PORTION // 2 or guest:
                    yield out(held, t)
                    held, chars, done = [], 0, bool(guest)
                held.append((i, t))
                chars += len(t)

    kind = "part int, guest byte, id long, text string"
    routed = d.mapInArrow(route, kind).repartition(n, "part").sortWithinPartitions("part", "guest", "id", "text")
    return routed.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
