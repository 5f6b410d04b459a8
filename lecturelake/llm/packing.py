"""Best-fit packing of token sequences as a vector bin packing.

A bin (sequence) has three capacities: tokens, documents and attention cost (the sum of squared lengths). Pieces of
documents go, longest first, into that open bin which fits under every constraint and scores best, by the weighted
dot product of demand and residual capacity or by the weighted norm of what would be left.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import ScanBPE, encoder
from .common import stored


@dataclass(frozen=True)
class Capacity:
    """What a sequence can hold, and how residual capacity is weighed.

    With the defaults only tokens bind: each document has at least one token, and a sum of squares is at most the
    square of the sum. score: "norm" (least weighted norm of the residual) or "dot" (largest weighted dot product).
    """

    tokens: int = 4096
    documents: int = 4096
    attention: int = 4096 * 4096
    weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3)
    score: str = "norm"


def token_pieces(docs: DataFrame, path: str, size: int, end_id: int = 1, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Cut every document's ids (encoded text, then end_id) into pieces of at most `size`: key, piece, start, length, ids_crc32, ids.

    Only documents longer than size have several pieces. Null text is empty text, which leaves end_id alone; ids are
    binary, little-endian unsigned 32-bit integers. Repeated rows give repeated pieces.
    """
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, ScanBPE)
        for batch in batches:
            rows, piece, start, ids = [], [], [], []
            for i, t in enumerate(batch.column(1)):
                raw = bpe.encode_bytes(t.as_py()) + tail
                for j in range(0, len(raw), 4 * size):
                    rows.append(i)
                    piece.append(j // (4 * size))
                    start.append(j // 4)
                    ids.append(raw[j : j + 4 * size])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                ["k", "piece", "start", "length", "ids_crc32", "ids"],
            )

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(docs[key].alias("k"), docs[text].alias("t")).mapInArrow(run, f"k {kind}, piece int, start long, length long, ids_crc32 long, ids binary")
    return out.withColumnRenamed("k", key)


def best_fit(lengths: np.ndarray, cap: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of every length, by vector best-fit over decreasing lengths.

    Open bins with equal residuals are alike, so they are kept as classes: the choice is made among distinct
    residual vectors, and the number of candidates stays small whatever the number of bins.
    """
    n = len(lengths)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    full = np.array([cap.tokens, cap.documents, cap.attention], np.float64)
    weights = np.array(cap.weights, np.float64)
    room = np.zeros((1024, 3))  # residuals of the open classes
    members: list[list[int]] = []  # bins of each class
    place: dict[tuple, int] = {}
    free: list[int] = []
    made = 0
    for i in np.argsort(-lengths, kind="stable"):
        need = np.array([lengths[i], 1, float(lengths[i]) ** 2])
        if (need > full).any():
            raise ValueError(f"a piece of {lengths[i]} tokens fits no sequence")
        k, best = len(members), -1
        if k:
            rest = room[:k] - need
            fits = rest.min(axis=1) >= 0
            if fits.any():
                if cap.score == "norm":
                    value = -(((rest / full) ** 2) @ weights)
                else:
                    value = ((room[:k] / full) * (need / full)) @ weights
                best = int(np.argmax(np.where(fits, value, -np.inf)))
        if best < 0:
            b, left = made, full - need
            made += 1
        else:
            b, left = members[best].pop(), room[best] - need
            if not members[best]:
                place.pop(tuple(room[best]))
                room[best] = -1
                free.append(best)
        bins[i], offsets[i] = b, cap.tokens - int(left[0] + need[0])
        if left[0] >= 1 and left[1] >= 1 and left[2] >= 1:
            at = place.get(tuple(left))
            if at is None:
                at = free.pop() if free else len(members)
                if at == len(members):
                    members.append([])
                    if at == len(room):
                        room = np.vstack([room, np.zeros_like(room)])
                room[at] = left
                place[tuple(left)] = at
            members[at].append(b)
    return bins, offsets


def pack(pieces: DataFrame, cap: Capacity | None = None, length: str = "length", group_rows: int = 20_000) -> DataFrame:
    """Add sequence_id and offset to pieces.

    Pieces are dealt at random into groups of about group_rows (their number follows the input), and each group is
    packed by itself: a group leaves at most a few sequences part-filled, so the total stays within a fraction of a
    per cent of one global packing, while no task ever holds more than a group. Full pieces are sequences of their own
    (with numbers below 0) and go into no group. Every input row comes out once, repeated rows as often as they come,
    and other columns stay whatever their names, but for sequence_id and offset, which are replaced; an empty table
    gives an empty result. A null length raises, as does one over the capacity. Rows are dealt by their place in the
    table, so pieces had better be a stored one, which a lost executor's tasks read again in the same order.
    """
    cap = cap or Capacity()
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    size = f"c{names.index(length)}"
    pieces = pieces.select(*[pieces[c].alias(f"c{i}") for i, c in enumerate(names)])
    fills = cap.documents >= 1 and cap.attention >= cap.tokens**2
    full = F.coalesce(F.col(size) == cap.tokens, F.lit(False)) & F.lit(fills)
    groups = max(1, round(pieces.filter(~full).count() / group_rows))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        bins, offsets = best_fit(pdf[size].to_numpy(np.int64), cap)
        pdf["sequence_id"] = bins * groups + int(key[0])
        pdf["offset"] = offsets
        return pdf.drop(columns="dealt_to")

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)
    spread = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("int")
    rest = pieces.filter(~full).withColumn("dealt_to", spread).groupBy("dealt_to").applyInPandas(run, f"{fields}, sequence_id long, offset long")
    alone = pieces.filter(full).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return rest.union(alone).toDF(*names, "sequence_id", "offset")


def pack_documents(docs: DataFrame, path: str, cap: Capacity | None = None, end_id: int = 1, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Tokenize, cut and pack: key, piece, start, length, ids_crc32, sequence_id, offset (the ids stay out of the shuffle).

    Pieces without ids are written to the shared folder first, so that texts are encoded once.
    """
    cap = cap or Capacity()
    pieces = token_pieces(docs, path, cap.tokens, end_id, text, key).drop("ids")
    return pack(stored(pieces, "pieces"), cap)
