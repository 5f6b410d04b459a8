"""Ranked lexical search over a K2-treap of the term-document grid.

Documents are dealt out to shards. A shard's grid has a row for each of its terms and a column for each of its documents,
in the order of their keys; a posting's value is its impact. A quadtree over the grid keeps, level by level and in Morton
order, for every cell that isn't empty which of its quarters aren't empty (a mask) and the highest impact in it (as what it
lacks to its parent's). Rows are ordered by how many documents hold the term, so that neighbours have cells alike.

A query item descends from the root with one path for each of its terms' rows; all paths share a range of documents. The
sum of weights times maxima of the cells that the paths are in bounds the score of every document in the range, so ranges
are taken best first (of equal bounds, the one that begins first), and what is taken at the width of one document is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, mix, short_batches, stored, text_chunks
from .ngram_join import powers

#: Bytes of text and documents that fill a shard; shards that one group of items' copies meets; ranges taken at once.
SHARD_BYTES, SHARD_DOCS, GROUP_SHARDS, TAKEN = 6 << 20, 1 << 13, 4, 32
#: Bytes of a long text hashed at once; it is cut where no term goes on.
HASHED = 1 << 19

TERM = np.zeros(256, bool)
TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LETTER = np.random.default_rng(713).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
LETTER[0x41:0x5B] = LETTER[0x61:0x7B]
BITS = np.array([bin(i).count("1") for i in range(16)], np.int64)


def term_hashes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the terms of UTF-8 texts, and the offsets of texts in them. Terms are maximal runs of 0-9, A-Z, a-z and
    everything beyond ASCII; A-Z is taken as a-z."""
    hashes, sizes, lo, text = [], np.zeros(len(at) - 1, np.int64), 0, 0
    while text < len(at) - 1:
        hi = max(text + 1, int(np.searchsorted(at, lo + HASHED, "right")) - 1)
        end = int(at[hi])
        if hi == text + 1 and end - lo > HASHED:  # a long text, or what is left of it, up to where a term ends
            end = lo + HASHED
            while end < at[hi] and TERM[raw[end]]:
                gap = np.flatnonzero(~TERM[raw[end : min(end + HASHED, int(at[hi]))]])
                end = end + int(gap[0]) if len(gap) else min(end + HASHED, int(at[hi]))
            cut = np.array([0, end - lo])
        else:
            cut = at[text : hi + 1] - lo
            cut[0] = 0
        part = raw[lo:end]
        inside = TERM[part]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edge = cut[1:-1]
        edge = edge[(edge > 0) & (edge < len(part))]
        begins[edge] = inside[edge]
        ends[edge - 1] = inside[edge - 1]
        first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        up, down = powers(len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(LETTER[part] * up[:-1], out=total[1:])
        hashes.append(mix((total[last] - total[first]) * down[first]))
        sizes[text:hi] += np.diff(np.searchsorted(first, cut))
        lo = end
        if end == at[hi]:
            text = hi
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.r_[0, np.cumsum(sizes)]


def corpus_size(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """How many texts hold a term, and how many terms all texts hold, with repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = 0
        for batch in batches:
            for _, _, raw, at in text_chunks(batch.column(0)):
                sizes = np.diff(term_hashes(raw, at)[1])
                n, total = n + int((sizes > 0).sum()), total + int(sizes.sum())
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total], pa.int64())], ["n", "total"])

    row = docs.select(text).mapInArrow(run, "n long, total long").agg(F.sum("n"), F.sum("total")).first()
    return int(row[0] or 0), int(row[1] or 0)


def spread(x: np.ndarray) -> np.ndarray:
    """The bits of 32-bit numbers, each with a zero before it."""
    x = x.astype(np.uint64)
    for shift, keep in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(keep)
    return x


def treap(rows: np.ndarray, columns: np.ndarray, values: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Masks of the cells of every level but the last, and maxima of every level, from the root down, of distinct points.

    The quarters of a cell are numbered 2 * (lower half of the rows) + (right half of the columns).
    """
    height = max(int(rows.max()).bit_length(), int(columns.max()).bit_length())
    code = spread(rows) << np.uint64(1) | spread(columns)
    order = np.argsort(code)
    code, top = code[order], values[order]
    masks, maxima = [], [top]
    for _ in range(height):
        parent = code >> np.uint64(2)
        first = np.flatnonzero(np.r_[True, parent[1:] != parent[:-1]])
        masks.append(np.bitwise_or.reduceat(np.uint8(1) << (code & np.uint64(3)).astype(np.uint8), first))
        top = np.maximum.reduceat(top, first)
        maxima.append(top)
        code = parent[first]
    return masks[::-1], maxima[::-1]


def squeezed(masks: list[np.ndarray], maxima: list[np.ndarray]) -> bytes:
    """A treap as bytes: its height, the root's maximum, then a level's masks and what its cells' children lack to them."""
    parts = [np.array([len(masks), maxima[0][0]], "<i8").tobytes()]
    for mask, above, below in zip(masks, maxima[:-1], maxima[1:], strict=True):
        parts += [mask.tobytes(), (np.repeat(above, BITS[mask]) - below).astype("<u4").tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


class Treap:
    """A treap read from its bytes, for searching."""

    def __init__(self, raw: bytes):
        raw = zstandard.ZstdDecompressor().decompress(raw)
        self.height, top = (int(x) for x in np.frombuffer(raw, "<i8", 2))
        at, above = 16, np.array([top], np.int32)
        #: A last entry of nothing stands for the cell -1, which is empty. Nine bytes a cell.
        self.masks, self.first, self.maxima = [], [], [np.array([top, 0], np.int32)]
        for _ in range(self.height):
            mask = np.frombuffer(raw, np.uint8, len(above), at)
            sizes = BITS[mask]
            at += len(mask)
            n = int(sizes.sum())
            above = np.repeat(above, sizes) - np.frombuffer(raw, "<u4", n, at).astype(np.int32)
            at += 4 * n
            self.masks.append(np.r_[mask, np.uint8(0)])
            self.first.append(np.r_[np.cumsum(sizes) - sizes, 0].astype(np.int32))
            self.maxima.append(np.r_[above, np.int32(0)])

    def best(self, rows: np.ndarray, weights: np.ndarray, k: int, floor: int = 1) -> list[tuple[int, int]]:
        """(score, column) of the k columns with the highest sums of weights times the values in these rows, ties to the
        smaller column; columns below floor (1 or more) are left out."""
        found: list[tuple[int, int]] = []
        bound = int(self.maxima[0][0]) * int(weights.sum())
        if not self.height:
            return [(bound, 0)] if bound >= floor else []
        # (-bound, first column, level, cells of the paths, row of these): equal bounds come by column
        heap = [(-bound, 0, 0, 0, np.zeros(len(rows), np.int64))] if bound >= floor else []
        made = 1
        while heap:
            worst = (-found[-1][0], found[-1][1]) if len(found) == k else (0, 0)
            taken: dict[int, list] = {}
            for _ in range(TAKEN):
                if not heap or heap[0][:2] > worst:
                    break
                top = heappop(heap)
                taken.setdefault(top[2], []).append(top)
            if not taken:
                break
            for level, ranges in taken.items():
                cells = np.stack([r[4] for r in ranges])
                shift = self.height - level - 1
                lower = 2 * ((rows >> shift) & 1)
                mask, first, maxima = self.masks[level][cells].astype(np.int64), self.first[level][cells], self.maxima[level + 1]
                for half in (0, 1):
                    quarter = lower + half
                    inner = np.where(mask >> quarter & 1, first + BITS[mask & ((1 << quarter) - 1)], -1)
                    bounds = maxima[inner] @ weights
                    for i in np.flatnonzero(bounds >= floor).tolist():
                        entry = (-int(bounds[i]), ranges[i][1] + (half << shift))
                        if entry > worst:
                            continue
                        if shift:
                            made += 1
                            heappush(heap, (*entry, level + 1, made, inner[i]))
                        else:
                            found.append((int(bounds[i]), entry[1]))
            found.sort(key=lambda x: (-x[0], x[1]))
            del found[k:]
        return found


def grid(keys: pa.Array, texts: list[tuple[np.ndarray, np.ndarray]], n_docs: int, n_terms: int) -> dict | None:
    """A shard's row of the index, from its documents' keys and (term hashes, sizes); None if no document has a term."""
    size = np.concatenate([s for _, s in texts])
    order = pc.sort_indices(keys, null_placement="at_end").to_numpy()
    order = order[size[order] > 0]
    if not len(order):
        return None
    column = np.empty(len(size), np.int64)
    column[order] = np.arange(len(order))
    terms, row = np.unique(np.concatenate([h for h, _ in texts]), return_inverse=True)
    row *= len(order)
    row += np.repeat(column, size)
    cell, times = np.unique(row, return_counts=True)
    row, column = cell // len(order), cell % len(order)
    held = np.bincount(row)
    place = np.empty(len(terms), np.int64)
    place[np.argsort(-held, kind="stable")] = np.arange(len(terms))
    damping = np.array([100 - 50 + 50 * n * n_docs // n_terms for n in size[order].tolist()], np.int64)
    impact = 1_000_000_000 * times // (1000 * times + 20 * damping[column])
    return {"keys": keys.take(pa.array(order)).to_pylist(), "terms": terms.view(np.int64), "rows": place.astype(np.int32), "dfs": held.astype(np.int32), "treap": squeezed(*treap(place[row], column, impact))}


def build_index(docs: DataFrame, text: str = "text", key: str = "doc_id") -> tuple[DataFrame, int]:
    """The stored index of whole texts, and how many of them have terms.

    A row is a shard: keys of its documents, terms by hash with their rows in the grid and their document counts, and the
    treap. Null and empty texts have no terms and no column. Rows with a null key are documents like others, their keys
    come last; every row that repeats a key is a document of its own. Other columns are not read.
    """
    spark = docs.sparkSession
    short_batches(spark)
    n_docs, n_terms = corpus_size(docs, text)
    names = ["shard", "keys", "terms", "rows", "dfs", "treap"]
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, keys, texts, n_bytes, n_rows = TaskContext.get().partitionId(), 0, [], [], 0, 0

        def shard() -> Iterator[pa.RecordBatch]:
            row = grid(pa.chunked_array(keys).combine_chunks(), texts, n_docs, n_terms) if keys else None
            if row:
                columns = [pa.array([task << 32 | made], pa.int64()), pa.array([row["keys"]], pa.list_(keys[0].type))]
                columns += [pa.ListArray.from_arrays([0, len(row[n])], pa.array(row[n])) for n in names[2:5]]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([row["treap"]], pa.binary())], names)

        for batch in batches:
            for lo, hi, raw, at in text_chunks(batch.column(1)):
                hashes, offsets = term_hashes(raw, at)
                keys.append(batch.column(0).slice(lo, hi - lo))
                texts.append((hashes, np.diff(offsets)))
                n_bytes, n_rows = n_bytes + len(raw), n_rows + hi - lo
                if n_bytes >= SHARD_BYTES or n_rows >= SHARD_DOCS:
                    yield from shard()
                    made, keys, texts, n_bytes, n_rows = made + 1, [], [], 0, 0
        yield from shard()

    rows = docs.select(docs[key].alias("k"), docs[text].alias("t")).mapInArrow(run, f"shard long, keys array<{kind}>, terms array<long>, rows array<int>, dfs array<int>, treap binary")
    return stored(rows, "ranked-index"), n_docs


def item_terms(items: DataFrame, text: str, key: str) -> DataFrame:
    """item, term: the distinct term hashes of every item; rows that repeat an item's key are one item."""
    kind = items.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, at in text_chunks(batch.column(1)):
                hashes, offsets = term_hashes(raw, at)
                owner = np.repeat(np.arange(lo, hi), np.diff(offsets))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array(hashes.view(np.int64))], ["item", "term"])

    return items.select(items[key].alias("item"), items[text].alias("t")).mapInArrow(run, f"item {kind}, term long").distinct()


def search(index: DataFrame, n_docs: int, items: DataFrame, k: int = 50, text: str = "text", item_key: str = "item_id", key: str = "doc_id") -> DataFrame:
    """item key, rank (from 1), document key, score: the k documents of highest score above 0 of each item (all, if fewer).

    Equal scores go by ascending key, null keys last. An item without terms that documents hold gets no rows; items that
    share a key are one item with the terms of all, also under a null key. Every group of shards is met by a copy of every
    item, shards first: a task holds one group's treaps and passes the items by, and what the group's earlier shards gave
    an item is the floor for the later ones.
    """
    spark = index.sparkSession
    asked = stored(item_terms(items, text, item_key), "ranked-terms")
    counts = index.select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.dfs").alias("df"))
    counts = counts.join(asked.select("term").distinct(), "term").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    weighted = asked.join(counts.select("term", weight.alias("weight")), "term").filter("weight > 0")
    weighted = weighted.groupBy("item").agg(F.collect_list(F.struct("term", "weight")).alias("t")).select("item", F.col("t.term").alias("terms"), F.col("t.weight").alias("weights"))
    groups = max(1, -(-index.count() // GROUP_SHARDS))
    shards = index.select(F.pmod(F.xxhash64("shard"), F.lit(groups)).alias("g"), "shard", "keys", "terms", "rows", "treap")
    copies = weighted.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<bigint>")).alias("g"), "item", "terms", "weights")
    met = shards.unionByName(copies, allowMissingColumns=True).repartition("g").sortWithinPartitions("g", F.col("shard").asc_nulls_last())
    item_kind, kind = items.schema[item_key].dataType.simpleString(), index.schema["keys"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, own = None, []
        for batch in batches:
            g, shard, keys, terms, rows, raw, item, weights = (batch.column(batch.schema.get_field_index(n)) for n in ("g", "shard", "keys", "terms", "rows", "treap", "item", "weights"))
            out_item, out_key, out_score = [], [], []
            for i in range(batch.num_rows):
                if g[i].as_py() != group:
                    group, own = g[i].as_py(), []
                of = terms[i].values.to_numpy()
                if shard[i].is_valid:
                    own.append((keys[i].values, of.view(np.uint64).copy(), rows[i].values.to_numpy().copy(), Treap(raw[i].as_py())))
                    continue
                asked_terms, w = of.view(np.uint64), weights[i].values.to_numpy()
                best, floor = [], 1
                for names, hashes, places, tree in own:
                    at = np.minimum(np.searchsorted(hashes, asked_terms), len(hashes) - 1)
                    there = hashes[at] == asked_terms
                    if there.any():
                        best += [(score, names[c]) for score, c in tree.best(places[at[there]].astype(np.int64), w[there], k, floor)]
                        if len(best) >= k:
                            best.sort(key=lambda x: -x[0])
                            floor = max(1, best[k - 1][0])
                out_item += [item[i].as_py()] * len(best)
                out_key += [key_.as_py() for _, key_ in best]
                out_score += [score for score, _ in best]
            yield pa.RecordBatch.from_arrays([pa.array(out_item, item.type), pa.array(out_key, keys.type.value_type), pa.array(out_score, pa.int64())], ["item", "key", "score"])

    found = met.mapInArrow(run, f"item {item_kind}, key {kind}, score long")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("key").asc_nulls_last()))
    top = found.withColumn("rank", place).filter(F.col("rank") <= k)
    return top.select(F.col("item").alias(item_key), "rank", F.col("key").alias(key), "score")


def rank(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """build_index and search in one."""
    index, n_docs = build_index(docs)
    return search(index, n_docs, items, k)
