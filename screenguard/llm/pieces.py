"""SentencePiece encoding and decoding over a relational lattice.

Texts fall into units that no piece crosses. The corpus's distinct units are exploded
into substrings of bounded length, equi-joined to the piece table, and the surviving
edges grouped by unit; a higher-order aggregate folds them by Viterbi's rule into the
segmentation of greatest total score. Texts are then put together from their units:
the most frequent from a broadcast dictionary of bounded size, the others by a join.

The segmentation is the library's for unigram models (best total score, unknown
characters as bytes, ties to the longer last piece). A BPE model's file holds merge ranks,
which don't add up like log probabilities. By default its pieces are therefore scored by
Zipf's law, the log of one over the rank, less a charge for each piece, which favours few
pieces as merging does; ``scores="file"`` takes the ranks as they are. No model is trained.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, partitions, prepare, reclaim, release, sliced, stored

SPACE = "▁"
#: Numerals that count as word characters but don't join letters (fixed values).
_NUMERALS = "²³¹¼½¾⁰⁴-⁹₀-₉"
#: A unit: spaces before letters, or before other characters.
UNIT = re.compile(f"{SPACE}*(?:[^\\W\\d_{_NUMERALS}]+|(?:(?!{SPACE})[\\W\\d_{_NUMERALS}])+)|{SPACE}+")
#: Characters of a window of a unit; bounds the edges that are grouped in one row.
WINDOW = 64
#: Units of the broadcast dictionary at most, the most frequent; the others are joined.
FREQUENT = 400_000
#: Distinct units that a task counts before it hands them on.
HELD = 300_000
#: Bytes of texts that are cut into units together, and travel in one row.
PORTION = 2_000_000
#: Units whose ids are put together at a time.
STEP = 65_536
UNKNOWN_PENALTY = 10.0
#: Zipf's offset of ranks, and the charge for each piece.
ZIPF, CHARGE = 2.7, 3.0
#: Base of the hash of short units, and its inverse modulo 2 ** 64 (any odd number serves).
_BASE = 0x9E3779B97F4A7C15
#: Characters that one table of the base's powers covers.
_SPAN = 1 << 20


@dataclass
class PieceModel:
    """A piece table: what a .model file says."""

    pieces: list[tuple[str, int, float]]  # text, id, score of normal pieces
    by_id: list[bytes]  # what each id decodes to
    bytes_from: int  # id of the byte piece 0; -1 without byte pieces
    unknown: int

    @property
    def longest(self) -> int:
        return max((len(p) for p, _, _ in self.pieces), default=1)

    @property
    def unknown_score(self) -> float:
        return min((s for _, _, s in self.pieces), default=0.0) - UNKNOWN_PENALTY


def load(path: str | None = None, scores: str = "auto") -> PieceModel:
    """Read a model; by default the installed public one. Its pieces must not cross units.

    scores: "file" for the file's; "auto" for the file's, but Zipf's for a BPE model.
    """
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    proto = pb.ModelProto()
    proto.ParseFromString(m.serialized_model_proto())
    ranked = scores == "auto" and proto.trainer_spec.model_type == 2
    normal, by_id = [], []
    for i in range(m.get_piece_size()):
        p = m.id_to_piece(i)
        if m.is_byte(i):
            by_id.append(bytes([int(p[3:5], 16)]))
        elif m.is_control(i) or m.is_unknown(i) or m.is_unused(i):
            by_id.append(b"" if not m.is_unknown(i) else " ⁇ ".encode())
        else:
            by_id.append(p.encode())
            normal.append((p, i, float(np.float32(m.get_score(i)))))
    bad = [p for p, _, _ in normal if not UNIT.fullmatch(p)]
    if bad:
        raise ValueError(f"pieces that cross units: {bad[:5]}")
    if ranked:  # the best score has rank 1; the file's order decides between equal ones
        order = sorted(range(len(normal)), key=lambda j: -normal[j][2])
        rank = {j: k for k, j in enumerate(order, 1)}
        normal = [(p, i, -math.log(rank[j] + ZIPF) - CHARGE) for j, (p, i, _) in enumerate(normal)]
    first = next((i for i in range(m.get_piece_size()) if m.is_byte(i)), -1)
    if first >= 0 and [by_id[i] for i in range(first, first + 256)] != [bytes([b]) for b in range(256)]:
        raise ValueError("byte pieces don't stand in order")
    return PieceModel(normal, by_id, first, m.unk_id())


def normalise(text: str) -> str:
    """A space in front, and spaces as the piece table writes them; an empty text stays so."""
    return SPACE + text.replace(" ", SPACE) if text else ""


def units(text: str | None) -> list[str]:
    return UNIT.findall(normalise(text)) if text else []


@cache
def _kinds() -> np.ndarray:
    """For each code point 0 for the space sign, 1 for letters, 2 for others: what UNIT tells apart."""
    text = "".join(map(chr, (c for c in range(0x110000) if not 0xD800 <= c < 0xE000)))
    kind = np.full(0x110000, 2, np.uint8)
    for m in re.finditer(f"[^\\W\\d_{_NUMERALS}]+", text):
        kind[np.frombuffer(m[0].encode("utf-32-le"), np.uint32)] = 1
    kind[ord(SPACE)] = 0
    return kind


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2 ** 64."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.ones(_SPAN + WINDOW, np.uint64)
        done = 1
        while done < len(p):  # p[i + done] = p[i] * base ** done
            more = min(done, len(p) - done)
            p[done : done + more] = p[:more] * np.uint64(pow(base, done, 1 << 64))
            done += more
        out.append(p)
    return out[0], out[1]


def hashes(code: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of the runs of code points: polynomials of short ones, from sums up to each place; XXH64 of others."""
    power, back = _powers()
    h = np.empty(len(start), np.uint64)
    edge = np.searchsorted(start, np.arange(0, len(code) + _SPAN, _SPAN))
    for i, (s, e) in enumerate(zip(edge[:-1], edge[1:], strict=True)):
        if s == e:
            continue
        at = i * _SPAN
        part = code[at : at + _SPAN + WINDOW]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part + np.uint32(1)) * power[: len(part)], out=total[1:])
        low = start[s:e] - at
        h[s:e] = (total[np.minimum(low + size[s:e], len(part))] - total[low]) * back[low]
    h += size.astype(np.uint64)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    for i in np.flatnonzero(size > WINDOW).tolist():
        h[i] = xxhash.xxh64_intdigest(code[start[i] : start[i] + size[i]].tobytes())
    return h


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct hashes, ascending; the place of one of each; how many of each)."""
    order = np.argsort(h)
    ranked = h[order]
    first = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]]) if len(h) else np.empty(0, np.int64)
    return ranked[first], order[first], np.diff(first, append=len(h))


class Units:
    """The units of some texts, as arrays: start, size, hash, and where each text's begin."""

    def __init__(self, texts: list[str | None]):
        norm = [normalise(t) if t else "" for t in texts]
        self.joined = "".join(norm)
        self.length = np.fromiter(map(len, norm), np.int64, len(norm))
        code = np.frombuffer(self.joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = _kinds()[code]
        new = np.empty(len(code), bool)
        new[1:] = (kind[1:] != kind[:-1]) & (kind[:-1] != 0)
        at = np.cumsum(self.length) - self.length
        new[at[self.length > 0]] = True
        self.start = np.flatnonzero(new)
        self.size = np.diff(self.start, append=len(code))
        self.hash = hashes(code, self.start, self.size) if len(code) else np.empty(0, np.uint64)
        self.first = np.searchsorted(self.start, np.append(at, len(code)))

    def strings(self, which: np.ndarray) -> list[str]:
        text = self.joined
        return [text[s : s + n] for s, n in zip(self.start[which].tolist(), self.size[which].tolist(), strict=True)]


def runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of all runs, one after the other."""
    end = np.cumsum(size)
    return np.repeat(start - (end - size), size) + np.arange(end[-1] if len(end) else 0)


class Decoder:
    """Bytes of ids, copied out of one flat array."""

    def __init__(self, by_id: list[bytes]):
        self.size = np.fromiter(map(len, by_id), np.int64, len(by_id))
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(by_id), np.uint8)

    def raw(self, ids: np.ndarray) -> bytes:
        return self.flat[runs(self.start[ids], self.size[ids])].tobytes()

    def text(self, ids: np.ndarray) -> str:
        """The text of the ids; bytes that aren't UTF-8 become replacement characters."""
        return self.raw(ids).decode("utf-8", "replace").replace(SPACE, " ").removeprefix(" ")


# ---- the dictionary of units ----------------------------------------------------------


def unit_counts(docs: DataFrame, portion: int = PORTION) -> DataFrame:
    """docs (text) -> (unit, n, size): every distinct unit, how often it stands in all texts, and its characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, count, names = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, object)

        def out() -> pa.RecordBatch:
            units = pa.array(names, pa.string())
            order = pc.sort_indices(units)  # neighbours that are alike compress better
            units = units.take(order)
            return pa.record_batch([units, pa.array(count).take(order), pc.utf8_length(units).cast(pa.int64())], ["unit", "n", "size"])

        for b in sliced(batches, "text", portion):
            cut = Units(b.column(0).to_pylist())
            h, first, n = distinct(cut.hash)
            at = np.searchsorted(seen, h)
            known = np.zeros(len(h), bool)
            known[at < len(seen)] = seen[at[at < len(seen)]] == h[at < len(seen)]
            count[at[known]] += n[known]
            new = ~known
            fresh = np.array([*cut.strings(first[new]), None], object)[:-1]
            place = at[new]
            seen, count, names = np.insert(seen, place, h[new]), np.insert(count, place, n[new]), np.insert(names, place, fresh)
            if len(seen) > HELD:
                yield out()
                seen, count, names = seen[:0], count[:0], names[:0]
        if len(seen):
            yield out()
        release()

    spark = docs.sparkSession
    raw = docs.select("text").mapInArrow(run, "unit string, n long, size long")
    return raw.repartition(partitions(spark), "unit").groupBy("unit").agg(F.sum("n").alias("n"), F.max("size").alias("size"))


def _edges(windows: DataFrame, model: PieceModel) -> DataFrame:
    """windows (..., body, skip, pad) -> a row (..., edge) for each piece or single character that ends in a window.

    body: the window's characters after ``skip`` ones of the window before, that pieces may
    begin in; pad is added to all places. An edge is (end, start, id, score), with -1 less the
    code point as the id of an unknown character. The piece table is broadcast: its size is
    the model's, whatever the corpus.
    """
    spark = windows.sparkSession
    table = spark.createDataFrame([(p, i, s) for p, i, s in model.pieces], "piece string, piece_id int, score double")
    table = F.broadcast(table.withColumn("piece_hash", F.xxhash64("piece")))  # a long joins faster than a string
    keep = [c for c in windows.columns if c not in ("body", "skip", "pad")]
    at = windows.withColumn("s", F.explode(F.expr("sequence(0, cast(length(body) as int) - 1)")))
    sub = at.withColumn("k", F.explode(F.expr(f"sequence(1, least({model.longest}, cast(length(body) as int) - s))"))).where("s + k > skip")
    sub = sub.select(*keep, "k", F.expr("pad + s + k").alias("e"), F.expr("pad + s").alias("s"), F.expr("substring(body, s + 1, k)").alias("sub"))
    edges = sub.join(table, F.xxhash64("sub") == table["piece_hash"], "left").withColumn("piece_id", F.expr("if(sub = piece, piece_id, null)")).where("piece_id is not null or k = 1")
    return edges.select(*keep, F.struct("e", "s", F.expr("coalesce(piece_id, -1 - ascii(sub))").alias("id"), F.when(F.col("piece_id").isNotNull(), F.col("score")).otherwise(F.lit(model.unknown_score)).alias("p")).alias("edge"))


_PLACES_TYPE = "array<struct<e: int, s: int, id: int, p: double>>"
_GOT = "named_struct('e', x.e, 's', x.s, 'id', x.id, 'p', a[x.s].p + x.p)"
#: Viterbi's step. State: for each place so far the best edge into it, with the best score up to it. Edges come by end,
#: longer pieces first; the first of equal scores stays.
_STEP = f"(a, x) -> if(x.e < size(a), if(a[x.s].p + x.p > a[x.e].p, array_append(slice(a, 1, x.e), {_GOT}), a), array_append(a, {_GOT}))"
_TRACE = "(u, x) -> if(x.e = u.at, named_struct('at', x.s, 'ids', array_append(u.ids, x.id)), u)"
_IDS = "cast(array() as array<int>)"


def _start(score: str) -> str:
    return f"named_struct('e', -1, 's', 0, 'id', 0, 'p', {score})"


def _fold_one(edges: str) -> Column:
    """Ids of the best path over the edges of a unit of one window."""
    best = f"aggregate({edges}, cast(array({_start('0D')}) as {_PLACES_TYPE}), {_STEP})"
    return F.expr(f"aggregate(reverse({best}), named_struct('at', cast(size as int), 'ids', {_IDS}), {_TRACE}, u -> reverse(u.ids))")


def _fold_chain(chunks: str, width: int, overlap: int) -> Column:
    """Ids of the best path over windows of edges, in order; the scores of the last places go on from window to window.

    In each window places count from ``overlap`` characters before it, so that place p of
    one is place p + ``width`` of the window before.
    """
    window = f"transform(array(aggregate(c, o.last, {_STEP})), r -> named_struct('last', if(size(r) > {overlap + 1}, slice(r, -{overlap + 1}, {overlap + 1}), r), 'backs', array_append(o.backs, slice(r, {overlap + 2}, size(r)))))[0]"
    before = f"cast(array_append(array_repeat({_start("double('-infinity')")}, {overlap}), {_start('0D')}) as {_PLACES_TYPE})"
    backs = f"aggregate({chunks}, named_struct('last', {before}, 'backs', cast(array() as array<{_PLACES_TYPE}>)), (o, c) -> {window}, o -> o.backs)"
    path = f"transform(array(aggregate(reverse(c), named_struct('at', t.at, 'ids', {_IDS}), {_TRACE})), u -> named_struct('at', u.at + {width}, 'parts', array_append(t.parts, u.ids)))[0]"
    last = f"cast({overlap} + size - {width} * (size({chunks}) - 1) as int)"
    return F.expr(f"aggregate(reverse({backs}), named_struct('at', {last}, 'parts', cast(array() as array<array<int>>)), (t, c) -> {path}, t -> reverse(flatten(t.parts)))")


def _plain(model: PieceModel) -> Column:
    """Final ids of ``ids``: unknown characters become the ids of their UTF-8 bytes, or the unknown id."""
    if model.bytes_from >= 0:
        b = model.bytes_from
        plain = f"""
            case when i >= 0 then array(i)
                 when i > -129 then array({b} - 1 - i)
                 when i > -2049 then array({b} + 192 + ((-1 - i) div 64), {b} + 128 + (-1 - i) % 64)
                 when i > -65537 then array({b} + 224 + ((-1 - i) div 4096), {b} + 128 + ((-1 - i) div 64) % 64, {b} + 128 + (-1 - i) % 64)
                 else array({b} + 240 + ((-1 - i) div 262144), {b} + 128 + ((-1 - i) div 4096) % 64, {b} + 128 + ((-1 - i) div 64) % 64, {b} + 128 + (-1 - i) % 64) end"""
    else:
        plain = f"array(if(i >= 0, i, {model.unknown}))"
    return F.expr(f"if(exists(ids, i -> i < 0), flatten(transform(ids, i -> transform({plain}, j -> cast(j as int)))), ids)")


def segment(found: DataFrame, model: PieceModel) -> DataFrame:
    """found (unit, n, size), distinct and stored -> (unit, n, ids): the lattice of every unit, folded.

    A unit is cut into windows of WINDOW characters; an edge belongs to the window that it
    ends in, so that no group of edges is large, and the fold carries the last scores from
    window to window. A unit of one window, as nearly all are, stays in its partition from
    explosion to fold; the windows of longer ones are spread over tasks.
    """
    spark = found.sparkSession
    width, overlap = max(WINDOW, model.longest), model.longest - 1
    one = found.where(F.col("size") <= width).repartition(partitions(spark), "unit").select("unit", "n", "size", F.col("unit").alias("body"), F.lit(0).alias("skip"), F.lit(0).alias("pad"))
    one = _edges(one, model).groupBy("unit").agg(F.first("n").alias("n"), F.first("size").alias("size"), F.array_sort(F.collect_list("edge")).alias("edges"))
    one = one.select("unit", "n", _fold_one("edges").alias("ids"))
    cut = F.expr(f"transform(parts, (p, w) -> struct(w as w, if(w = 0, p, concat(right(parts[w - 1], {overlap}), p)) as body, if(w = 0, 0, {overlap}) as skip, if(w = 0, {overlap}, 0) as pad))")
    more = found.where(F.col("size") > width).withColumn("key", F.sha2("unit", 256))
    windows = more.select("key", F.expr(f"regexp_extract_all(unit, '(?s).{{1,{width}}}', 0)").alias("parts")).select("key", F.explode(cut).alias("v"))
    windows = windows.select("key", "v.w", "v.body", "v.skip", "v.pad").repartition(partitions(spark), "key", "w")
    chunk = _edges(windows, model).groupBy("key", "w").agg(F.array_sort(F.collect_list("edge")).alias("chunk"))
    chunks = chunk.groupBy("key").agg(F.expr("transform(array_sort(collect_list(struct(w, chunk))), c -> c.chunk)").alias("chunks"))
    long = more.select("key", "unit", "n", "size").join(chunks, "key").select("unit", "n", _fold_chain("chunks", width, overlap).alias("ids"))
    return one.union(long).select("unit", "n", _plain(model).alias("ids"))


# ---- texts ----------------------------------------------------------------------------


class Dictionary:
    """Ids of the frequent units by hash, in a table of open addresses."""

    def __init__(self, names: list[str], edge: np.ndarray, flat: np.ndarray):
        """edge: where in ``flat`` each unit's ids begin, and where the last one's end."""
        size = np.fromiter(map(len, names), np.int64, len(names))
        code = np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), np.uint32)
        h = hashes(code, np.cumsum(size) - size, size) if len(code) else np.empty(0, np.uint64)
        self.hash, self.size, self.start, self.flat = h, np.diff(edge).astype(np.int32), edge[:-1].astype(np.int32), flat
        self.slots = np.full(1 << max(4, (4 * len(h)).bit_length()), -1, np.int32)
        left = np.arange(len(h))
        slot = self._slot(h)
        while len(left):  # into the next slot until it is free
            free = self.slots[slot] < 0
            self.slots[slot[free]] = left[free]
            lost = self.slots[slot] != left
            left, slot = left[lost], (slot[lost] + 1) & (len(self.slots) - 1)

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h & np.uint64(len(self.slots) - 1)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Places of the hashes, -1 for one that isn't there."""
        slot = self._slot(h)
        at = self.slots[slot]
        if len(self.hash):
            wrong = np.flatnonzero((at >= 0) & (self.hash[at] != h))
            while len(wrong):
                slot[wrong] = (slot[wrong] + 1) & (len(self.slots) - 1)
                at[wrong] = self.slots[slot[wrong]]
                wrong = wrong[(at[wrong] >= 0) & (self.hash[at[wrong]] != h[wrong])]
        return at


def _frequent(spark: SparkSession, coded: DataFrame, most: int):
    """At most ``most`` units of the greatest counts, as a broadcast; and whether those are all.

    Counts are told apart to a sixteenth of their binary logarithm, so that the driver gets
    at most a thousand sums.
    """
    level = F.floor(16 * F.log2("n")).alias("level")
    sizes = coded.groupBy(level).agg(F.count("*").alias("c")).orderBy(F.desc("level")).collect()
    total, least = 0, None
    for r in sizes:
        if total + r["c"] > most:
            break
        total, least = total + r["c"], r["level"]
    got = coded.where(level >= (least if least is not None else 1 << 30)).select("unit", "ids").toArrow()
    ids = got["ids"].combine_chunks()
    found = Dictionary(got["unit"].to_pylist(), ids.offsets.to_numpy().copy(), ids.values.to_numpy().astype(np.int32)) if len(got) else Dictionary([], np.zeros(1, np.int64), np.empty(0, np.int32))
    del got, ids
    release()
    return spark.sparkContext.broadcast(found), not sizes or least == sizes[-1]["level"]


def _slices(batches: Iterator[pa.RecordBatch], portion: int = PORTION) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Rows (part, ..., text), some texts of ``portion`` bytes in all at a time or one longer, with a key.

    Cuts depend on the rows and their order alone, not on the batches they come in, so the
    key of a row is the same in every pass.
    """
    held: list[pa.RecordBatch] = []
    size, number = 0, 0

    def out() -> tuple[int, pa.RecordBatch]:
        b = pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else held[0]
        return (b.column(0)[0].as_py() << 32) + number, b

    for b in batches:
        end = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(b.column(b.num_columns - 1)), 0), dtype=np.int64))
        at = 0
        while at < b.num_rows:
            before = end[at - 1] if at else 0
            to = int(np.searchsorted(end, before + portion - size, side="right"))
            to = max(to, at + (not held))
            if to > at:
                held.append(b.slice(at, to - at))
                size += int(end[to - 1] - before)
                at = to
            if at < b.num_rows:
                yield out()
                held, size, number = [], 0, number + 1
    if held:
        yield out()


def _rare(cut: Units, known: Dictionary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in the dictionary of all units; the first of each distinct unit that it lacks; which of those stands where."""
    at = known.find(cut.hash)
    missing = np.flatnonzero(at < 0)
    h, first, _ = distinct(cut.hash[missing])
    return at, missing[first], np.searchsorted(h, cut.hash[missing])


def encode(docs: DataFrame, model: PieceModel | None = None, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT, portion: int = PORTION) -> DataFrame:
    """(id, n_tokens, ids, roundtrip), a row for each row of ``docs``, from whole texts.

    Null and empty texts have no ids. roundtrip: whether the decoded ids are the text again,
    which holds for every text without the character U+2581, that decodes to a space. Repeated
    rows and null ids are kept, other columns ignored; no rows give no rows. A text of any
    length is encoded as a whole; a task holds one text, or some
    of ``portion`` bytes in all: less takes less memory and asks more often for the same units.

    Texts travel once, some megabytes to a row, compressed; the units that the broadcast
    dictionary lacks are asked for once in each such row, by number, and the answers meet the
    texts in one shuffle. Both passes cut the texts alike, as they read the same rows in the
    same order; where the plan of ``docs`` doesn't promise that order, it is stored first.
    """
    spark = docs.sparkSession
    prepare(spark)
    model = model or load(spark.conf.get("spark.screenguard.pieces", None))
    kind = docs.schema[id_col].dataType.simpleString()
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    if d._jdf.queryExecution().toRdd().outputDeterministicLevel().toString() != "DETERMINATE":
        d = stored(d)
    found = stored(unit_counts(d, portion))
    reclaim(spark)
    coded = stored(segment(found, model))
    discard(found)
    common, whole = _frequent(spark, coded, frequent)
    reclaim(spark)
    by_id, wide = model.by_id, 2 if len(model.by_id) < 1 << 16 else 4

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each slice the units that must be joined, by number."""
        known = common.value
        for key, b in _slices(batches, portion):
            cut = Units(b.column(1).to_pylist())
            _, first, _ = _rare(cut, known)
            if len(first):
                h = np.array([xxhash.xxh64_intdigest(u.encode("utf-8", "surrogatepass"), 42) for u in cut.strings(first)], np.uint64)
                yield pa.record_batch([pa.array(np.full(len(first), key)), pa.array(np.arange(len(first), dtype=np.int32)), pa.array(h.view(np.int64))], ["slice", "number", "hash"])
        release()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each slice's rows as one row."""
        press = zstandard.ZstdCompressor(level=5)
        for key, b in _slices(batches, portion):
            b, sink = b.select([1, 2]), pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, b.schema) as out:
                out.write_batch(b)
            yield pa.record_batch([pa.array([key]), pa.array([-1], pa.int32()), pa.array([press.compress(sink.getvalue())], pa.binary())], ["slice", "number", "body"])
        release()

    def assemble(b: pa.RecordBatch, answers: tuple[np.ndarray, np.ndarray], back: Decoder) -> pa.RecordBatch:
        """answers: where the ids of each numbered unit begin and end, and the ids."""
        known = common.value
        texts = b.column(1).to_pylist()
        cut = Units(texts)
        at, _, which = _rare(cut, known)
        missing = at < 0
        edge, more = answers
        start, size = known.start[np.maximum(at, 0)] if len(known.start) else np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        size[~missing] = known.size[at[~missing]]
        start[missing], size[missing] = edge[:-1][which], np.diff(edge)[which]
        ids, raw, n = np.empty(int(size.sum()), np.int32), [], 0
        for i in range(0, len(at), STEP):  # a few units at a time, as indexes take more than what they fetch
            s, k, rare = start[i : i + STEP], size[i : i + STEP], missing[i : i + STEP]
            place, asked = runs(s, k), np.repeat(rare, k)
            part = ids[n : n + len(place)]
            part[~asked], part[asked] = known.flat[place[~asked]], more[place[asked]]
            raw.append(back.raw(part))
            n += len(place)
        total = np.append(0, np.cumsum(size))[cut.first]  # of ids before each text
        if b"".join(raw) == cut.joined.encode("utf-8", "surrogatepass"):
            same = [SPACE not in (t or "") for t in texts]
        else:
            same = [back.text(ids[s:e]) == (t or "") for s, e, t in zip(total[:-1], total[1:], texts, strict=True)]
        return pa.record_batch([b.column(0), pa.array(np.diff(total)), pa.ListArray.from_arrays(pa.array(total.astype(np.int32)), pa.array(ids)), pa.array(same)], ["id", "n_tokens", "ids", "roundtrip"])

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by slice, its texts (number -1) before its answers."""
        unpack, back, now, held, sizes, ids = zstandard.ZstdDecompressor(), Decoder(by_id), None, None, [], []

        def out() -> pa.RecordBatch:
            edge = np.append(0, np.cumsum(np.concatenate(sizes))) if sizes else np.zeros(1, np.int64)
            try:
                return assemble(held, (edge, np.concatenate(ids) if ids else np.empty(0, np.int32)), back)
            finally:
                release()

        for b in batches:
            key, number = b.column(0).to_numpy(), b.column(1).to_numpy()
            cut = np.r_[0, np.flatnonzero(np.diff(key)) + 1, len(key)] if len(key) else []
            for s, e in zip(cut[:-1], cut[1:], strict=True):
                if key[s] != now:
                    if held is not None:
                        yield out()
                    now, held, sizes, ids = key[s], None, [], []
                if number[s] < 0:
                    with pa.ipc.open_stream(unpack.decompress(b.column(2)[int(s)].as_py())) as r:
                        held = r.read_next_batch()
                    s += 1
                if s < e:  # answers come by number, none is left out
                    raw = b.column(2).slice(s, e - s)
                    sizes.append(np.asarray(pc.binary_length(raw), np.int64) // wide)
                    ids.append(np.frombuffer(b"".join(raw.to_pylist()), f">u{wide}").astype(np.int32))
        if held is not None:
            yield out()
        release()

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = Decoder(by_id)
        for b in sliced(batches, "text", portion):
            yield assemble(b, (np.zeros(1, np.int64), np.empty(0, np.int32)), back)
        release()

    schema = f"id {kind}, n_tokens long, ids array<int>, roundtrip boolean"
    if whole:
        return d.mapInArrow(alone, schema)
    # a column, as the task's own number is another one above a union
    d = d.select(F.spark_partition_id().alias("part"), "id", "text")
    asked = d.select("part", "text").mapInArrow(ask, "slice long, number int, hash long")
    # units meet by XXH64, as the dictionary's do by a hash; a collision would show in roundtrip
    body = F.unhex(F.array_join(F.transform("ids", lambda i: F.lpad(F.hex(i), 2 * wide, "0")), "")).alias("body")
    answers = asked.join(coded.select(F.xxhash64("unit").alias("hash"), body), "hash").select("slice", "number", "body")
    both = d.mapInArrow(packed, "slice long, number int, body binary").union(answers)
    return both.repartition(partitions(spark), "slice").sortWithinPartitions("slice", "number").mapInArrow(texts, schema)
