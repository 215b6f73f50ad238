"""SimHash fingerprints, a Gray-order hierarchical index over them, and near-duplicate groups.

Fingerprints are sorted by Gray rank and cut into parts. A part's node is the bit
pattern that all its fingerprints share. Above the parts and inside each stand nodes of
eight children, that hold the bits their members share beyond the parent's; a fingerprint
goes down from the root, the differences add up on the way, and a whole group goes as
soon as the sum passes the limit. So it visits only the parts that may hold a match.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import partitions, prepare, release, sliced, stored
from .components import connected_components

FANOUT = 8
#: Fingerprints of a part of the index; bounds what a task holds.
PART_ROWS = 16_384
#: Parts at least, so that a fingerprint's visits per part don't depend on a small table's size.
PARTS = 32
#: Pairs of query and node that are looked at together.
FRONTIER = 2_000_000


# ---- fingerprints ---------------------------------------------------------------------


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of ``words`` words, repeats included; one of all words if fewer."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.empty(0, np.uint64)
    joined = b" ".join(w)
    if len(w) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    size = np.fromiter(map(len, w), np.int64, len(w))
    end = np.cumsum(size + 1) - 1
    start = end - size
    h = xxhash.xxh64_intdigest
    return np.array([h(joined[a:b], 42) for a, b in zip(start[: len(w) - words + 1].tolist(), end[words - 1 :].tolist(), strict=True)], np.uint64)


def majority_bits(h: np.ndarray) -> int:
    """Bits that are set in over half of the hashes; 0 for none."""
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 65_536):
        part = h[i : i + 65_536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, fp): the 64-bit fingerprint as a signed long; null or wordless texts give 0."""
    prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text"):
            fp = np.array([majority_bits(shingle_hashes(t.as_py(), words)) for t in b.column(1)], np.uint64)
            yield pa.record_batch([b.column(0), pa.array(fp.view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, fp long")


def hex16(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def gray_rank(fp: Column) -> Column:
    """Place of the fingerprint in Gray order, as a long that sorts like the unsigned rank."""
    for s in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, s))
    return fp.bitwiseXOR(F.lit(-(1 << 63)))


def _gray_order(fp: np.ndarray) -> np.ndarray:
    r = fp.copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return np.argsort(r, kind="stable")


# ---- the index of one part ------------------------------------------------------------


def _levels(lo: np.ndarray, hi: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Nodes over neighbouring groups, from the root down: (shared bits' values, mask). lo, hi: bits all members have, bits any has."""
    out = []
    while len(lo) > 1 or not out:
        cut = np.arange(0, len(lo), FANOUT)
        lo, hi = np.bitwise_and.reduceat(lo, cut), np.bitwise_or.reduceat(hi, cut)
        out.append((lo, ~(lo ^ hi)))
    return out[::-1]


def _descend(levels: list[tuple[np.ndarray, np.ndarray]], leaf: np.ndarray, mask: np.ndarray | None, q: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (query's place, leaf's place) of at most ``limit`` differences under the leaf's mask (all bits if None), in portions."""
    todo = [(0, np.arange(len(q)), np.zeros(len(q), np.int64), np.bitwise_count((q ^ levels[0][0][0]) & levels[0][1][0]).astype(np.int64))]
    while todo:
        level, who, node, diff = todo.pop()
        keep = diff <= limit
        who, node, diff = who[keep], node[keep], diff[keep]
        if not len(who):
            continue
        if len(who) * FANOUT > FRONTIER and len(who) > 1:
            half = len(who) // 2
            todo += [(level, who[:half], node[:half], diff[:half]), (level, who[half:], node[half:], diff[half:])]
            continue
        above = levels[level][1][node]
        last = level + 1 == len(levels)
        below = leaf if last else levels[level + 1][0]
        child = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
        who, diff, above = np.repeat(who, FANOUT), np.repeat(diff, FANOUT), np.repeat(above, FANOUT)
        there = child < len(below)
        child, who, diff, above = child[there], who[there], diff[there], above[there]
        own = ~above if last and mask is None else (mask if last else levels[level + 1][1])[child] & ~above
        diff = diff + np.bitwise_count((q[who] ^ below[child]) & own)
        if last:
            hit = diff <= limit
            if hit.any():
                yield who[hit], child[hit]
        else:
            todo.append((level + 1, who, child, diff))


class GrayIndex:
    """Gray-ordered fingerprints under nodes of shared masked bits, and a union-find over them."""

    def __init__(self, fp: np.ndarray):
        self.order = _gray_order(fp)
        self.fp = fp[self.order]
        self.parent = np.arange(len(fp))
        self.levels = _levels(self.fp, self.fp)

    def matches(self, q: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query's place, fingerprint's place) at ``limit`` or fewer differing bits, in portions."""
        return _descend(self.levels, self.fp, None, q, limit)

    def find(self, x: np.ndarray) -> np.ndarray:
        while True:
            p = self.parent[x]
            if (p == x).all():
                return x
            x = p

    def union(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            a, b = self.find(a), self.find(b)
            apart = a != b
            if not apart.any():
                return
            a, b = a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))
            self.parent = self.parent[self.parent]

    def link(self, q: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """Join all matches of each query; return one (query, fingerprint) link for each that has any."""
        first = np.full(len(q), -1)
        for who, at in self.matches(q, limit):
            new = first[who] < 0
            first[who[new]] = at[new]
            self.union(first[who], at)
        has = first >= 0
        return q[has], self.fp[first[has]]

    def forest(self) -> tuple[np.ndarray, np.ndarray]:
        root = self.find(np.arange(len(self.fp)))
        apart = root != np.arange(len(root))
        return self.fp[apart], self.fp[root[apart]]


def hamming_links(fps: DataFrame, limit: int = 2, part_rows: int = PART_ROWS) -> DataFrame:
    """fps (fp long, distinct) -> (u, v): links whose components are those of all pairs within ``limit`` bits.

    A spanning set of the links within a part and one link for each visiting fingerprint
    that has a match: linear in the fingerprints, whatever the size of a near-copy group.
    Only the bounds and shared patterns of the parts reach the driver, three numbers for
    each ``part_rows`` fingerprints; each fingerprint descends over them to its parts.
    """
    spark = fps.sparkSession
    prepare(spark)
    ranked = fps.select("fp", gray_rank(F.col("fp")).alias("rank"))
    n = ranked.count()
    parts = max(PARTS if n > PARTS else 1, -(-n // part_rows))
    bounds = sorted(set(ranked.select(F.percentile_approx("rank", [i / parts for i in range(1, parts)], min(100 * parts, 1_000_000)).alias("b")).first()["b"] or [])) if parts > 1 else []
    cuts = np.array(bounds, np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array(np.searchsorted(cuts, b.column(1).to_numpy()).astype(np.int32))], ["fp", "own"])

    placed = ranked.mapInArrow(place, "fp long, own int")
    nodes = sorted(placed.groupBy("own").agg(F.expr("bit_and(fp)").alias("lo"), F.expr("bit_or(fp)").alias("hi")).collect())
    part = np.array([r["own"] for r in nodes], np.int32)
    lo, hi = (np.array([r[c] for r in nodes], np.int64).view(np.uint64) for c in ("lo", "hi"))
    top = spark.sparkContext.broadcast((part, lo, ~(lo ^ hi), _levels(lo, hi) if len(lo) else []))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each fingerprint to its own part, and to later parts whose shared bits allow a match."""
        part, value, mask, levels = top.value

        def rows(to: np.ndarray, guest: int, fp: np.ndarray) -> pa.RecordBatch:
            return pa.record_batch([pa.array(to), pa.array(np.full(len(to), guest, np.int8)), pa.array(fp)], ["part", "guest", "fp"])

        for b in batches:
            fp, home = b.column(0).to_numpy(), b.column(1).to_numpy()
            yield rows(home, 0, fp)
            for i in range(0, len(fp), 4096):
                for who, at in _descend(levels, value, mask, fp[i : i + 4096].view(np.uint64), limit):
                    later = part[at] > home[i + who]
                    yield rows(part[at[later]], 1, fp[i + who[later]])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by part, its own fingerprints before its guests."""
        now, held, index = None, [], None

        def out(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
            return pa.record_batch([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

        def built() -> GrayIndex:
            x = GrayIndex(np.concatenate(held).view(np.uint64))
            for i in range(0, len(x.fp), 4096):
                x.link(x.fp[i : i + 4096], limit)
            return x

        for b in batches:
            p, guest, fp = (b.column(i).to_numpy() for i in range(3))
            edge = np.flatnonzero(np.diff(p) | np.diff(guest)) + 1
            for s, e in zip(np.r_[0, edge], np.r_[edge, len(p)], strict=True):
                if s == e:
                    continue
                if p[s] != now:
                    if now is not None:
                        yield out(*(index or built()).forest())
                    now, held, index = p[s], [], None
                if not guest[s]:
                    held.append(fp[s:e])
                    continue
                index = index or built()
                for i in range(s, e, 4096):
                    yield out(*index.link(fp[i : min(i + 4096, e)].view(np.uint64), limit))
        if now is not None:
            yield out(*(index or built()).forest())

    routed = placed.mapInArrow(route, "part int, guest byte, fp long")
    return routed.repartition(max(1, parts), "part").sortWithinPartitions("part", "guest").mapInArrow(search, "u long, v long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, limit: int = 2, part_rows: int = PART_ROWS) -> DataFrame:
    """(id, fp, component): component is the smallest id reachable over links of ``limit`` bits.

    Every row stays, repeated rows too. Texts without words and null texts have the
    fingerprint 0 and link like any other. Null ids never name a component unless all
    ids of it are null; other columns of ``docs`` are ignored. No rows give no rows.
    """
    found = fingerprints(docs, id_col, text_col, words).checkpoint()
    nodes = found.groupBy("fp").agg(F.min("id").alias("least"))
    comp = connected_components(hamming_links(nodes.select("fp"), limit, part_rows)).checkpoint()
    known = nodes.join(comp, nodes.fp == comp.node, "left").select("fp", F.coalesce("component", "fp").alias("root"), "least")
    names = known.groupBy("root").agg(F.min("least").alias("component"))
    by_fp = known.join(names, "root").select("fp", "component")
    return found.join(by_fp, "fp").select("id", "fp", "component")


# ---- near-duplicate texts -------------------------------------------------------------

#: Blocking keys of a text, and minima in each.
BANDS, MINIMA = 8, 3
#: Bins of the sketch that confirms a pair, a byte each; its estimate has a standard error of 0.0125 at 0.8 for long
#: texts, and less for texts of fewer shingles than bins, of which it holds nearly all.
BINS = 1024
#: Chance that two full bins are equal by accident.
ALIKE = 1 / 255
#: Differing bits of fingerprints that the index over the whole table looks for.
BITS = 3
#: Members of a key that are compared in one block at least.
MEMBERS = 512
_SALTS = np.random.default_rng(17).integers(0, 1 << 63, BANDS * MINIMA, np.uint64) * np.uint64(2) + np.uint64(1)


def sketch(h: np.ndarray) -> bytes:
    """For each of BINS ranges of hashes 8 bits of the least in it, from 1 on; 0 for an empty range."""
    if not len(h):
        return bytes(BINS)
    h = np.sort(h)
    which = (h >> np.uint64(54)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, which[1:] != which[:-1]])
    out = np.zeros(BINS, np.uint8)
    out[which[first]] = 1 + (h[first] >> np.uint64(8)) % np.uint64(255)
    return out.tobytes()


def reach(similarity: float) -> int:
    """Bits within which fingerprints of texts alike by ``similarity`` are, but for one in a million.

    Of distinct shingles a bit differs by the angle between the sets; of few shingles, by up to a quarter more.
    """
    p = min(0.5, 1.25 * np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    over, bits = 1.0, -1
    while over > 1e-6:
        bits += 1
        over -= comb(64, bits) * p**bits * (1 - p) ** (64 - bits)
    return bits


def near_pairs(fp: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places a < b whose fingerprints differ in at most ``limit`` bits, in portions, by descent through a Gray index."""
    index = GrayIndex(fp)
    for i in range(0, len(fp), 256):
        for who, at in index.matches(fp[i : i + 256], limit):
            a, b = i + who, index.order[at]
            yield a[a < b], b[a < b]


def linked(rows: np.ndarray, least: float, fp: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (places a, b) whose components are those of all pairs of sketches alike by ``least`` or more.

    ``rows`` holds a sketch a row, ``fp`` their fingerprints. Pairs that the Gray index gives
    within reach are confirmed first. Then, as the reach loses a pair in a million, each row is
    compared with all later ones that no link has joined to it yet. Those that agree with most
    others in most bins come first, so that a text with many copies joins them at once; of few
    rows any order is as fast.
    """
    common = np.zeros(len(rows), np.int64)
    for column in rows.T if len(rows) > 64 else ():
        common += np.bincount(column, minlength=256)[column]
    order = np.argsort(-common, kind="stable")
    rows = np.ascontiguousarray(rows[order])
    none = np.packbits(rows == 0, axis=1).view(np.uint64)
    limit, least = reach(least), ALIKE + least * (1 - ALIKE)
    group, u, v = np.arange(len(rows)), [], []

    def alike(i: np.ndarray | int, j: np.ndarray) -> np.ndarray:
        void = np.bitwise_count(none[j] & none[i]).sum(1, dtype=np.int64)
        same = np.bitwise_count((rows[j] == rows[i]).view(np.uint64)).sum(1, dtype=np.int64) - void
        return same >= least * (BINS - void)

    for a, b in near_pairs(fp[order], limit) if fp is not None else ():
        at = 0
        while at < len(a):
            apart = at + np.flatnonzero(group[a[at:]] != group[b[at:]])[:1024]
            if not len(apart):
                break
            at = apart[-1] + 1
            hit = apart[alike(a[apart], b[apart])]
            for i, j in zip(a[hit].tolist(), b[hit].tolist(), strict=True):
                if group[i] != group[j]:
                    u.append(i)
                    v.append(j)
                    group[group == group[j]] = group[i]
    for i in range(len(rows) - 1):
        later = i + 1 + np.flatnonzero(group[i + 1 :] != group[i])
        if not len(later):
            if (group == group[i]).all():
                break
            continue
        for k in range(0, len(later), 1024):
            j = later[k : k + 1024]
            j = j[alike(i, j)]
            _, first = np.unique(group[j], return_index=True)
            u += [i] * len(first)
            v += j[first].tolist()
            group[np.isin(group, group[j])] = group[i]
    return order[np.array(u, np.int64)], order[np.array(v, np.int64)]


def band_keys(h: np.ndarray) -> list[int]:
    """One key of each band, from the least of MINIMA differently mixed hashes."""
    if not len(h):
        return list(range(BANDS))
    least = np.array([(h * s).min() for s in _SALTS]).reshape(BANDS, MINIMA)
    return [xxhash.xxh64_intdigest(bytes([i]) + row.tobytes()) - (1 << 63) for i, row in enumerate(least)]


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, digest, keep): each row's id and text digest; keep marks the one of the smallest id of each group.

    Equal texts are one class, and a class has the SimHash fingerprint of its distinct shingles.
    The Gray index over all fingerprints gives groups within BITS bits. Texts alike by
    ``similarity`` may differ in more bits than an index over a whole table can look for, so
    min-hash keys deal the classes into parts as well. In each group and part the Gray index
    gives the candidates within reach, until links join them all: members are dealt into
    blocks, and each two blocks meet in a cell that gives fewer links than it has members. A
    link stands if the sketches put the shingles' Jaccard ratio at ``similarity`` or more; what
    the reach leaves out in a part is compared as well. Null texts count as empty; all
    wordless texts are one group. Of a text of any length all shingles count, each once.
    Null ids come last, so that a row with an id is kept where there is one; repeated rows are
    one class; no rows give no rows; other columns are ignored. Texts never travel, only
    their sketches and keys do, once for each distinct text.
    """
    spark = docs.sparkSession
    prepare(spark)
    kind = docs.schema[id_col].dataType.simpleString()

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text"):
            h = [np.unique(shingle_hashes(t.as_py(), words)) for t in b.column(2)]
            fp = np.array([majority_bits(x) for x in h], np.uint64)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(fp.view(np.int64)), pa.array([sketch(x) for x in h], pa.binary()), pa.array([band_keys(x) for x in h], pa.list_(pa.int64()))], ["id", "digest", "fp", "sketch", "bands"])
        release()

    rows = docs.select(F.col(id_col).alias("id"), digest(F.col(text_col)).alias("digest"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ids = rows.select("id", "digest")
    found = rows.mapInArrow(features, f"id {kind}, digest string, fp long, sketch binary, bands array<long>")
    classes = stored(found.groupBy("digest").agg(F.min("id").alias("id"), F.first("fp").alias("fp"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands")))
    near = connected_components(hamming_links(classes.select("fp").distinct(), BITS))
    indexed = classes.join(near, F.col("fp") == F.col("node"), "left").select(F.xxhash64(F.lit("fingerprint"), F.coalesce("component", "fp")).alias("key"), "digest")
    keyed = classes.select(F.explode("bands").alias("key"), "digest").union(indexed)
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    dealt = keyed.join(sizes, "key").withColumn("parts", F.expr(f"ceil(n / greatest({MEMBERS}, 16 * sqrt(n)))")).withColumn("own", F.expr("pmod(xxhash64(digest), parts)"))
    meets = F.expr("if(parts = 1, array(struct(0L as x, 0L as y)), transform(filter(sequence(0L, parts - 1), j -> j <> own), j -> struct(least(own, j) as x, greatest(own, j) as y)))")
    cells = dealt.select("digest", "key", F.explode(meets).alias("c")).select("digest", "key", "c.x", "c.y")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by cell."""
        now, held = None, []

        def out() -> list[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            rows = np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint8).reshape(-1, BINS)
            u, v = linked(rows, similarity, t["fp"].to_numpy().view(np.uint64))
            return pa.table({"u": t["digest"].take(pa.array(u)), "v": t["digest"].take(pa.array(v))}).combine_chunks().to_batches(1 << 20)

        for b in batches:
            if not b.num_rows:
                continue
            at = np.stack([b.column(i).to_numpy() for i in range(3)])
            edge = np.flatnonzero((at[:, 1:] != at[:, :-1]).any(0)) + 1
            for s, e in zip(np.r_[0, edge], np.r_[edge, b.num_rows], strict=True):
                if tuple(at[:, s]) != now:
                    if held:
                        yield from out()
                    now, held = tuple(at[:, s]), []
                held.append(b.slice(s, e - s))
        if held:
            yield from out()
        held.clear()
        release()

    met = cells.join(classes.select("digest", "fp", "sketch"), "digest").select("key", "x", "y", "digest", "fp", "sketch")
    links = met.repartition(partitions(spark), "key", "x", "y").sortWithinPartitions("key", "x", "y").mapInArrow(link, "u string, v string")
    comp = connected_components(links)
    grouped = classes.select("digest", "id").join(comp, classes["digest"] == comp["node"], "left").select("digest", "id", F.coalesce("component", "digest").alias("group"))
    first = grouped.groupBy("group").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "digest")).alias("f")).select(F.col("f.id").alias("kept_id"), F.col("f.digest").alias("kept"))
    return ids.alias("r").join(first.alias("f"), F.expr("r.digest = f.kept and r.id <=> f.kept_id"), "left").select("id", "digest", F.col("kept").isNotNull().alias("keep"))


def digest(text: Column) -> Column:
    return F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs``, all columns: one of each group of near-duplicate texts, that of the smallest id.

    Null and empty texts are one group with all wordless ones; of rows that are equal in id
    and text one stays; null ids come last; no rows give no rows.
    """
    gone = near_duplicate_classes(docs, id_col, text_col, words, similarity)
    keep = gone.where("keep").groupBy("id", "digest").agg(F.count("*").alias("times")).alias("k")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), digest(F.col(text_col)).alias("digest")).alias("d")
    same = rows.join(keep, F.expr("d.id <=> k.id and d.digest = k.digest"))
    # of rows that are equal in id and text one stays
    place = F.row_number().over(W.partitionBy("d.id", "d.digest").orderBy(F.lit(1)))
    return same.select("row", place.alias("place")).where("place = 1").select("row.*")
