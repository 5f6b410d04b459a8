"""Removal of long repeated substrings by bucket-pointer refinement, spread over a cluster.

Every byte window of `length` bytes that also starts anywhere else is to go. Windows are sorted into buckets, as the
suffixes of a suffix array are, and a bucket is refined by sorting its members on the identifiers that they have at later
offsets (Spark sorts them by bucket and identifiers and groups what is equal). Identifiers of q-grams are 64-bit, made by
doubling: that of 2h bytes comes from the two of h bytes at offsets 0 and h, from 8 bytes up.

- Initial buckets: the least 128-gram of each window (its anchor). Windows that follow each other and share an anchor
  are one range; equal windows have equal anchors, so they meet in one bucket. A range that is alone cannot repeat.
- A bucket is refined by the identifiers at all offsets that its ranges cover. A class of two ranges or more is repeated
  in full. Where a bucket has several classes, one range of each class is cut into cells of 32, then 4, then 1 window.
- A refined bucket holds what agrees in the bytes common to a cell. Its pointer is its least member, as a bucket pointer
  of a suffix array is a place in it, and the cells that come of its members start in the bucket of that pointer: they are
  sorted only against each other, on the identifiers at the offsets that a smaller cell has in common besides. Pointers
  are updated with each refinement and reused by the next, and what is alone in its bucket is dropped at once.

The work left shrinks with each level, as only cells at the edge of a repeat are cut further; nothing but counts and
one representative of each class goes on, so copies by the thousand cost no more than two.

The same is done over words instead of bytes where passages of so many words are asked for: a word's hash takes a byte's
place, and spans of words become spans of bytes at the end.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored, text_chunks, utf8
from .ngram_join import words


class Unit(NamedTuple):
    """What texts are sequences of: bytes of one unit as they are stored, units in an anchor, widths of cells from the whole
    of a range (a multiple of the next) down to 1."""

    size: int
    anchor: int
    cells: tuple[int, ...]

    def lengths(self) -> tuple[int, int]:
        """Shortest and longest windows: two grams (of two anchors each) have to cover what a cell's windows have in common and
        all that they cover, and three of them a range."""
        gram, wide = 2 * self.anchor, self.cells[1]
        return gram + wide - 1, min(2 * gram - wide + 1, 7 * self.anchor // 2)


BYTES, WORDS = Unit(1, 128, (512, 32, 4, 1)), Unit(8, 16, (64, 8, 1))
#: Bytes of text that are taken at once: a pass holds many times as much in arrays of 64-bit numbers.
CHUNK = 1 << 18
#: Longer documents are taken in segments of so many window starts; ranges end where segments do.
SEGMENT = 4 << 20
#: Bits of an anchor's place in a segment; the bits above are its rank among the anchors of a window.
PLACE_BITS = 24

C1, C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def join_ids(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The identifier of a string from those of two parts."""
    t = a * C1
    t ^= t >> np.uint64(32)
    t += b
    t *= C2
    t ^= t >> np.uint64(29)
    return t


def gram_ids(raw: np.ndarray, q: int) -> np.ndarray:
    """Identifiers of the q units from every place of raw on: bytes (q = 8, 16, 32, ...) or 64-bit hashes (q = 1, 2, 4, ...)."""
    if len(raw) < q:
        return np.zeros(0, np.uint64)
    raw = np.ascontiguousarray(raw)
    x, h = (np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,)).copy(), 8) if raw.dtype == np.uint8 else (raw, 1)
    while h < q:
        x = join_ids(x[:-h], x[h:])
        h *= 2
    return x


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w that follow each other."""
    n = len(x)
    full = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = x
    full = full.reshape(-1, w)
    head = np.minimum.accumulate(full, axis=1).ravel()
    tail = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(tail[: n - w + 1], head[w - 1 : n])


def ranges(raw: np.ndarray, at: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Ranges of windows by anchor: row, first window, number of windows, anchor less first window, core, union."""
    w = length - anchor + 1
    sizes = np.diff(at)
    some = sizes >= length
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int32, np.int32, np.int64, np.int64))
    if not some.any():
        return none
    ids = gram_ids(raw, anchor)
    low = np.uint64((1 << PLACE_BITS) - 1)
    least = sliding_min(ids & ~low | np.arange(len(ids), dtype=np.uint64), w)
    edge = np.zeros(len(raw) + 1, np.int8)
    edge[at[:-1][some]] += 1
    edge[at[1:][some] - length + 1] -= 1
    starts = np.flatnonzero(np.cumsum(edge[:-1]))
    place = (least[starts] & low).astype(np.int64)
    cut = np.flatnonzero((np.diff(place) != 0) | (np.diff(starts) != 1))
    first, last, place = starts[np.r_[0, cut + 1]], starts[np.r_[cut, len(starts) - 1]], place[np.r_[0, cut + 1]]
    end = last + length
    double = lambda i: join_ids(ids[i], ids[i + anchor])
    shape = ((place - first) << 20 | (place - last)).astype(np.uint64)
    union = join_ids(join_ids(double(first), double(first + (end - first - 2 * anchor) // 2)), join_ids(double(end - 2 * anchor), shape))
    row = np.searchsorted(at, first, "right") - 1
    return row, first - at[row], (last - first + 1).astype(np.int32), (place - first).astype(np.int32), ids[place].view(np.int64), union.view(np.int64)


def _segments(raw: np.ndarray, at: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(units, offsets, units before) of what is taken at once; every window lies in one of them."""
    if len(raw) <= SEGMENT + length:
        yield raw, at, 0
        return
    for lo in range(0, len(raw) - length + 1, SEGMENT):
        piece = raw[lo : lo + SEGMENT + length - 1]
        yield piece, np.array([0, len(piece)]), lo


def _keys(docs: DataFrame, text: str, key: str) -> DataFrame:
    """d and k tell documents apart, t is the text; a null text is empty."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.coalesce(F.col(key).cast("long"), F.lit(-1)).alias("d"), F.xxhash64(t).alias("k"), t.alias("t"))


def _units(raw: np.ndarray, at: np.ndarray, unit: Unit) -> tuple[np.ndarray, np.ndarray]:
    """Texts as sequences of units, and the offsets of texts in them."""
    if unit.size == 1:
        return raw, at
    hashes, _, _, offsets = words(raw, at)
    return hashes, offsets


def anchored(docs: DataFrame, length: int, unit: Unit, text: str, key: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, raw, at in text_chunks(batch.column(2), CHUNK):
                for piece, offsets, before in _segments(*_units(raw, at, unit), length):
                    row, first, span, back, core, union = ranges(piece, offsets, length, unit.anchor)
                    if len(row):
                        own = pa.array(row + lo)
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), *map(pa.array, (first + before, span, back, core, union))], ["d", "k", "first", "span", "back", "core", "union"])

    return _keys(docs, text, key).mapInArrow(run, "d long, k long, first long, span int, back int, core long, union long")


def contexts(docs: DataFrame, asked: DataFrame, length: int, unit: Unit, text: str, key: str) -> DataFrame:
    """The units that asked ranges (d, k, first, span, back, core, n) cover. Of rows that repeat (d, k) a task reads one."""
    lists = asked.groupBy("d", "k").agg(F.collect_list(F.struct("first", "span", "back", "core", "n")).alias("r"))
    met = _keys(docs, text, key).join(lists, ["d", "k"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            pairs = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            new = [i for i, pair in enumerate(pairs) if pair not in seen and not seen.add(pair)]
            if len(new) < len(pairs):
                batch = batch.take(pa.array(new, pa.int64()))
            for lo, hi, raw, at in text_chunks(batch.column(2), CHUNK):
                raw, at = _units(raw, at, unit)
                part = batch.slice(lo, hi - lo)
                lists = part.column(3)
                row = np.repeat(np.arange(hi - lo), lists.value_lengths().to_numpy(zero_copy_only=False))
                flat = lists.flatten()
                first, span = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                begin, end = (at[row] + first) * unit.size, (at[row] + first + span + length - 1) * unit.size
                data = raw.tobytes()
                for i in range(0, len(row), 4096):
                    j = i + 4096
                    parts = [data[b:e] for b, e in zip(begin[i:j].tolist(), end[i:j].tolist(), strict=True)]
                    own = pa.array(row[i:j])
                    yield pa.RecordBatch.from_arrays([part.column(0).take(own), part.column(1).take(own), *(flat.field(x).slice(i, j - i) for x in range(5)), pa.array(parts, pa.binary())], ["d", "k", "first", "span", "back", "core", "n", "bytes"])

    rows = met.mapInArrow(run, "d long, k long, first long, span int, back int, core long, n long, bytes binary")
    return rows.withColumn("ctx", F.monotonically_increasing_id())


def cells(ctx: DataFrame, asked: DataFrame, before: int, width: int, length: int, unit: Unit) -> DataFrame:
    """Cut asked cells (ctx, cell, n, pointer), `before` windows wide, into cells of `width`: ctx, cell, n, s, e, core (bucket
    by the pointer and the units common to the cell), union (all that it covers)."""
    lists = asked.groupBy("ctx").agg(F.collect_list(F.struct("cell", "n", "pointer")).alias("r"))
    met = ctx.select("ctx", "bytes", "span", "back").join(lists, "ctx")
    gram = 2 * unit.anchor

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, at in text_chunks(batch.column(1), CHUNK):
                part = batch.slice(lo, hi - lo)
                if unit.size > 1:
                    raw, at = np.ascontiguousarray(raw).view(np.uint64), at // unit.size
                ids = gram_ids(raw, gram)
                lists = part.column(4)
                each = before // width
                row = np.repeat(np.repeat(np.arange(hi - lo), lists.value_lengths().to_numpy(zero_copy_only=False)), each)
                flat = lists.flatten()
                cell = np.repeat(flat.field(0).to_numpy(zero_copy_only=False).astype(np.int64), each) + np.tile(np.arange(each) * width, len(flat))
                n = np.repeat(flat.field(1).to_numpy(zero_copy_only=False), each)
                pointer = np.repeat(flat.field(2).to_numpy(zero_copy_only=False).view(np.uint64), each)
                span, back = (part.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
                high = np.minimum(cell + width - 1, back[row])
                low = np.maximum(cell, back[row] - span[row] + 1)
                ok = low <= high
                row, cell, n, high, low, pointer = row[ok], cell[ok], n[ok], high[ok], low[ok], pointer[ok]
                base = at[row] + back[row]
                inner = join_ids(ids[base - cell], ids[base - cell - width + 1 + length - gram])
                inner = join_ids(join_ids(pointer, cell.astype(np.uint64)), inner)
                outer = join_ids(join_ids(ids[base - high], ids[base - low + length - gram]), (high << 20 | low).astype(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row)), *map(pa.array, (cell.astype(np.int32), n, (back[row] - high).astype(np.int64), (back[row] - low + length).astype(np.int64), inner.view(np.int64), outer.view(np.int64)))],
                    ["ctx", "cell", "n", "s", "e", "core", "union"],
                )

    return met.mapInArrow(run, "ctx long, cell int, n long, s long, e long, core long, union long")


def _marks(docs: DataFrame, length: int, unit: Unit, text: str, key: str) -> DataFrame:
    """d, k, s, e: intervals of units whose windows of `length` units all start elsewhere too. The tables of the way there go."""
    shortest, longest = unit.lengths()
    if not shortest <= length <= longest:
        raise ValueError(f"length must be {shortest} to {longest}")
    made = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        made.append(stored(df, name))
        return made[-1]

    rows = keep(anchored(docs, length, unit, text, key), "anchors")
    classes = keep(rows.groupBy("core", "union").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("d", "k", "first", "span", "back")).alias("rep")), "classes")
    twice = classes.filter("n > 1").select("core", "union")
    marks = [rows.join(twice, ["core", "union"]).select("d", "k", F.col("first").alias("s"), (F.col("first") + F.col("span") + (length - 1)).alias("e"))]
    split = classes.groupBy("core").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("core")
    asked = classes.join(split, "core").select("rep.*", "core", "n")
    ctx = keep(contexts(docs, asked, length, unit, text, key), "contexts")
    asked = ctx.select("ctx", F.lit(0).alias("cell"), "n", F.col("core").alias("pointer"))
    before = unit.cells[0]
    own = ctx.select("ctx", "d", "k", "first")
    for width in unit.cells[1:]:
        rows = keep(cells(ctx, asked, before, width, length, unit), "cells")
        classes = rows.groupBy("core", "union").agg(F.sum("n").alias("n"), F.min(F.struct("ctx", "cell")).alias("rep"))
        if width > 1:
            classes = keep(classes, "classes")
            split = classes.groupBy("core").agg(F.count(F.lit(1)).alias("m"), F.min("rep").alias("least")).filter("m > 1")
            pointer = F.xxhash64("least.ctx", "least.cell")
            asked = classes.join(split.select("core", pointer.alias("pointer")), "core").select("rep.*", "n", "pointer")
        twice = classes.filter("n > 1").select("core", "union")
        found = rows.filter("n = 1").join(twice, ["core", "union"]).select("ctx", "s", "e")
        marks.append(found.join(own, "ctx").select("d", "k", (F.col("first") + F.col("s")).alias("s"), (F.col("first") + F.col("e")).alias("e")))
        before = width
    every = marks[0]
    for m in marks[1:]:
        every = every.unionByName(m)
    every = stored(every, "marks")
    discard(*made)
    return every


def _by_text(marks: DataFrame) -> DataFrame:
    """Rows that repeat (d, k) have the same spans."""
    return marks.groupBy("d", "k").agg(F.collect_set(F.struct(*marks.columns[2:])).alias("spans"))


def repeated_spans(docs: DataFrame, length: int = 400, text: str = "text", key: str = "doc_id") -> DataFrame:
    """d, k, spans array<struct<s, e>>: byte intervals whose windows of `length` bytes all start elsewhere too."""
    return _by_text(_marks(docs, length, BYTES, text, key))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of intervals that overlap or touch."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            if e > out[-1][1]:
                out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
    return out


def _in_bytes(lists: pa.Array, texts: pa.Array) -> Iterator[list[tuple[int, int]]]:
    """The spans of each text in bytes; those of words (w) go from their first word's begin to their last one's end."""
    for lo, hi, raw, at in text_chunks(texts, CHUNK):
        spans = [[(x["s"], x["e"], x["w"]) for x in r or []] for r in lists.slice(lo, hi - lo).to_pylist()]
        if any(w for r in spans for _, _, w in r):
            _, begin, end, offsets = words(raw, at)
        for i, r in enumerate(spans):
            yield [(int(begin[offsets[i] + s] - at[i]), int(end[offsets[i] + e - 1] - at[i])) if w else (s, e) for s, e, w in r]


def remove_repeats(docs: DataFrame, length: int = 400, text: str = "text", key: str = "doc_id", n_words: int = 0) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans, removed array<struct<s, e>>, kept (binary) and kept_text added.

    kept_text is kept as text, without the bytes of characters that a cut has split.

    Every byte covered by a `length`-byte string that also starts anywhere else in the table, the same document
    included, is removed; judged on the input, so all copies go. Documents are UTF-8 bytes, a null text is empty, and
    texts shorter than length keep everything. Rows that repeat key and text are copies of each other. Other columns
    stay as they are (columns with the names added are replaced).

    Where n_words is given, passages of so many words (split at ASCII white space, A-Z lower-cased) that also start anywhere
    else go besides, however few bytes they have; the white space around them stays.
    """
    added = ["n_bytes", "n_removed", "n_spans", "removed", "kept", "kept_text"]
    docs = docs.select(*[c for c in docs.columns if c not in added])
    names = docs.columns
    at = names.index(text)
    keyed = docs.select(*[docs[c].alias(f"c{i}") for i, c in enumerate(names)], F.coalesce(docs[key].cast("long"), F.lit(-1)).alias("d"), F.xxhash64(F.coalesce(docs[text], F.lit(""))).alias("k"))
    marks = _marks(docs, length, BYTES, text, key).withColumn("w", F.lit(False))
    if n_words:
        marks = marks.unionByName(_marks(docs, n_words, WORDS, text, key).withColumn("w", F.lit(True)))
    met = keyed.join(_by_text(marks), ["d", "k"], "left").drop("d", "k")
    runs = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8(batch.column(at))
            data = raw.tobytes()
            spans = list(map(merged, _in_bytes(batch.column(len(names)), batch.column(at))))
            kept = []
            for i, cut in enumerate(spans):
                lo, parts = int(offsets[i]), []
                begin = lo
                for s, e in cut:
                    parts.append(data[lo : begin + s])
                    lo = begin + e
                parts.append(data[lo : int(offsets[i + 1])])
                kept.append(b"".join(parts))
            size = np.diff(offsets)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(names)], pa.array(size), pa.array(size - np.fromiter(map(len, kept), np.int64, len(kept))), pa.array(list(map(len, spans)), pa.int64()), pa.array([[{"s": s, "e": e} for s, e in x] for x in spans], runs), pa.array(kept, pa.binary()), pa.array([x.decode("utf-8", "ignore") for x in kept])],
                [*batch.schema.names[: len(names)], *added],
            )

    fields = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema))
    return met.mapInArrow(run, f"{fields}, n_bytes long, n_removed long, n_spans long, removed array<struct<s: bigint, e: bigint>>, kept binary, kept_text string").toDF(*names, *added)


def brute_force_words(texts: list[str | None], n_words: int) -> list[list[tuple[int, int]]]:
    """The byte spans of each text that repeated windows of words cover, by a dictionary of all windows (for tests)."""
    found = [[(m.start(), m.end(), m[0].lower()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", (t or "").encode())] for t in texts]
    windows = [[tuple(x[2] for x in f[i : i + n_words]) for i in range(len(f) - n_words + 1)] for f in found]
    seen = Counter(w for r in windows for w in r)
    return [merged([(f[i][0], f[i + n_words - 1][1]) for i, w in enumerate(r) if seen[w] > 1]) for f, r in zip(found, windows, strict=True)]


def brute_force(texts: list[str | None], length: int) -> list[bytes]:
    """What is left of each text, by a dictionary of all windows (for tests)."""
    raw = [(t or "").encode() for t in texts]
    seen: dict[bytes, int] = {}
    for r in raw:
        for i in range(len(r) - length + 1):
            h = hashlib.sha256(r[i : i + length]).digest()
            seen[h] = seen.get(h, 0) + 1
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[hashlib.sha256(r[i : i + length]).digest()] > 1:
                gone[i : i + length] = b"\1" * length
        out.append(bytes(b for b, g in zip(r, gone, strict=True) if not g))
    return out
