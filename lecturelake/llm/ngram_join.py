"""Exact self-join of documents by the Jaccard similarity of their word n-grams, and the groups that its links form.

Documents with equal n-gram sets are one node. A partner lacks at most `slack` of a node's n-grams, so a node of which
more than that occur nowhere else is alone and goes no further; this is told from the n-grams in a range of the hashes.
The nodes left order their n-grams by exact counts, rare first: two sets of the similarity asked for share an n-gram in
their prefixes, and n-grams that no other node has, which come first, are never indexed. Candidates pass a length filter,
a positional filter and two suffix filters (bounds on the overlap from counts of n-grams in parts of their order, before
and after whole sets are fetched); what is left is verified once per pair on the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import roots
from .common import blocks, discard, mix, stored, text_chunks

N, THRESHOLD = 5, 80  # words in an n-gram; per cent
#: Size of the table of n-gram counts that tells very frequent ones (2 ** SKETCH_BITS counters), and ranges of the first
#: suffix filter.
SKETCH_BITS, RANGES = 20, 16
#: An n-gram counted this often beyond twice the mean counter is very frequent: its postings are dealt out by document.
PART = 2048
#: The range of hashes in which n-grams without a partner are counted, in units of the share that a partner may lack.
LOOK = 1.5
#: Postings that a task gathers before it deals them out.
GATHERED = 1 << 20
#: Rounds against pivots at most; pairs of postings that make another round worth it, as a multiple of all postings, if
#: the round before has halved them.
ROUNDS, CROSS = 4, 4
#: Bytes of text hashed at once; longer ones are split at white space.
HASHED = 1 << 21
#: The low bits of a node's identifier that go with n-grams where they are only counted.
NODE_BITS = np.uint64((1 << 40) - 1)

_rng = np.random.default_rng(20240)
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
LOWER = np.arange(256)
LOWER[65:91] += 32
BYTE = BYTE[LOWER]
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
WORD = _rng.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse, modulo 2 ** 64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 20)
        with np.errstate(over="ignore"):
            for name, b in (("up", BASE), ("down", np.uint64(pow(int(BASE), -1, 2**64)))):
                x = np.full(size, b, np.uint64)
                x[0] = 1
                _powers[name] = np.multiply.accumulate(x)
    return _powers["up"][:n], _powers["down"][:n]


def words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words (A-Z lower-cased, split at white space and document ends), their begins and ends in raw, and the
    offsets of documents in them."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(at), np.int64)
    if len(raw) > HASHED and len(at) == 2:  # one long text, hashed from one white space to the next
        parts, lo = [], 0
        while lo < len(raw):
            hi = min(len(raw), lo + HASHED)
            while hi < len(raw) and not SPACE[raw[hi]]:
                gap = np.flatnonzero(SPACE[raw[hi : hi + HASHED]])
                hi = hi + int(gap[0]) if len(gap) else min(len(raw), hi + HASHED)
            hashes, begin, end, _ = _hash_words(raw[lo:hi], np.array([0, hi - lo]))
            parts.append((hashes, begin + lo, end + lo))
            lo = hi
        hashes, begin, end = map(np.concatenate, zip(*parts, strict=True))
        return hashes, begin, end, np.array([0, len(hashes)])
    return _hash_words(raw, at)


def word_hashes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words, and the offsets of documents in them."""
    hashes, _, _, offsets = words(raw, at)
    return hashes, offsets


def _hash_words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    inside = ~SPACE[raw]
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    after[-1], after[:-1] = False, inside[1:]
    edge = at[1:-1]
    before[edge[edge < len(raw)]] = False
    after[edge[edge > 0] - 1] = False
    begin = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    up, down = powers(len(raw))
    total = np.empty(len(raw) + 1, np.uint64)
    total[0] = 0
    np.cumsum(BYTE[raw] * up, out=total[1:])
    return mix((total[end] - total[begin]) * down[begin]), begin, end, np.searchsorted(begin, at)


def gram_sets(raw: np.ndarray, at: np.ndarray, n: int = N) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of every document; with 1 to n - 1 words, the whole sequence is the one n-gram."""
    words, offsets = word_hashes(raw, at)
    full = np.zeros(0, np.uint64)
    if len(words) >= n:
        full = words[: len(words) - n + 1] * WORD[0]
        for j in range(1, n):
            full = full + words[j : len(words) - n + 1 + j] * WORD[j]
        full = mix(full)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= n:
            h = np.sort(full[a : b - n + 1])
            out.append(h if len(h) < 2 else h[np.r_[True, h[1:] != h[:-1]]])
        elif b > a:
            out.append(mix((words[a:b] * WORD[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def node_id(grams: np.ndarray) -> int:
    """A 64-bit identifier of a set of n-grams."""
    return int((mix(grams ^ np.uint64(0xA5A5A5A5DEADBEEF)).sum() ^ np.uint64(len(grams))).astype(np.uint64).view(np.int64))


def slack(size: Column | int, threshold: int) -> Column | int:
    """How many of its n-grams a partner of a set of this size may lack; a prefix is one n-gram longer."""
    if isinstance(size, int):
        return size - -(-threshold * size // 100)
    return size - F.ceil(size * threshold / F.lit(100))


def least_overlap(a: Column, b: Column, threshold: int) -> Column:
    """What sets of sizes a and b must share: the least o with 100 o >= threshold (a + b - o)."""
    return F.ceil((a + b) * threshold / F.lit(100 + threshold))


def _look(threshold: int) -> np.uint64:
    """The largest hash of the range that is looked at for n-grams without a partner."""
    return np.uint64(min(2**64 - 1, int(LOOK * (100 - threshold) / 100 * 2.0**64)))


def _profiles(docs: DataFrame, n: int, threshold: int, text: str, key: str) -> DataFrame:
    """Per document: d, h (hash of its text), size, node, looked (n-grams in the range looked at), ranges; and per task,
    in rows of their own, counts of n-grams by bucket."""
    rows = docs.select(F.col(key).cast("long").alias("d"), F.xxhash64(text).alias("h"), F.col(text).alias("t"))
    width, limit = 1 << 16, _look(threshold)
    names = ["d", "h", "size", "node", "looked", "ranges", "chunk", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in batches:
            for lo, hi, raw, at in text_chunks(batch.column(2)):
                sets = gram_sets(raw, at, n)
                all_grams = np.concatenate(sets)
                if len(all_grams):
                    counts += np.bincount((all_grams & np.uint64(len(counts) - 1)).astype(np.int64), minlength=len(counts)).astype(np.uint32)
                size = np.fromiter(map(len, sets), np.int64, len(sets))
                looked = np.array([np.searchsorted(s, limit, "right") for s in sets], np.int64)
                spread = [np.bincount((s >> np.uint64(60)).astype(np.int64), minlength=RANGES).tolist() for s in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(size), pa.array([node_id(s) for s in sets], pa.int64()), pa.array(looked), pa.array(spread, pa.list_(pa.int32())), pa.nulls(hi - lo, pa.int32()), pa.nulls(hi - lo, pa.binary())], names)
        chunks = [(i, c) for i, c in enumerate(counts.reshape(-1, width)) if c.any()]
        none = len(chunks)
        yield pa.RecordBatch.from_arrays([*(pa.nulls(none, pa.int64()) for _ in range(5)), pa.nulls(none, pa.list_(pa.int32())), pa.array([i for i, _ in chunks], pa.int32()), pa.array([c.tobytes() for _, c in chunks], pa.binary())], names)

    return rows.mapInArrow(run, "d long, h long, size long, node long, looked long, ranges array<int>, chunk int, counts binary")


def _frequent(profiles: DataFrame) -> np.ndarray:
    """Buckets of very frequent n-grams: the place of each among them, from 1 on by count, else 0 (a table of fixed size)."""

    def add(key: tuple, tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in tables:
            for x in batch.column(1):
                c = np.frombuffer(x.as_py(), np.uint32).astype(np.uint64)
                total = c if total is None else total + c
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()])], ["chunk", "counts"])

    counts = np.zeros(1 << SKETCH_BITS, np.uint32)
    part = profiles.filter("chunk is not null").select("chunk", "counts")
    # partial sums first, so that no task takes the tables of all others
    part = part.withColumn("salt", F.pmod(F.xxhash64("counts"), F.lit(8)).cast("int"))

    def add_salted(key: tuple, tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from add(key[:1], tables)

    once = part.select("chunk", "counts", "salt").groupBy("chunk", "salt").applyInArrow(add_salted, "chunk int, counts binary")
    for r in once.groupBy("chunk").applyInArrow(add, "chunk int, counts binary").collect():
        c = np.frombuffer(r.counts, np.uint32)
        counts[r.chunk * len(c) : (r.chunk + 1) * len(c)] = c
    hot = np.flatnonzero(counts > int(2 * counts.mean()) + PART)
    place = np.zeros(len(counts), np.int32)
    place[hot[np.lexsort((hot, counts[hot]))]] = np.arange(1, len(hot) + 1)
    return place


def _packed(g: np.ndarray, bottom: int, top: int) -> tuple[int, bytes, bytes]:
    """Sorted numbers from bottom to top in few bytes: low bytes as they are, the rest as a bitmap of ascending places."""
    g = g - np.uint64(bottom)
    low = next((k for k in range(1, 8) if (top - bottom) >> 8 * k <= 8 * len(g)), 7)
    high = (g >> np.uint64(8 * low)).astype(np.int64) + np.arange(len(g))
    bits = np.zeros(int(high[-1]) + 1 if len(g) else 0, bool)
    bits[high] = True
    return low, np.ascontiguousarray(g.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :low]).tobytes(), np.packbits(bits).tobytes()


def _unpacked(low: int, rest: bytes, bitmap: bytes, bottom: int) -> np.ndarray:
    high = np.flatnonzero(np.unpackbits(np.frombuffer(bitmap, np.uint8)))
    high = (high - np.arange(len(high))).astype(np.uint64) << np.uint64(8 * low)
    wide = np.zeros((len(high), 8), np.uint8)
    wide[:, :low] = np.frombuffer(rest, np.uint8).reshape(-1, low)
    return high + wide.view("<u8").ravel() + np.uint64(bottom)


def _cuts(block: np.ndarray) -> list[tuple[int, int]]:
    """Where runs of one block begin and end."""
    at = np.r_[0, np.flatnonzero(np.diff(block)) + 1, len(block)]
    return list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)) if len(block) else []


def _shared(docs: DataFrame, frequent: np.ndarray, n: int, threshold: int, text: str) -> DataFrame:
    """k (low bits of a node), shared: how many of a node's n-grams in the range looked at another node has too."""
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(frequent > 0)
    n_blocks, limit = 4 * blocks(spark), _look(threshold)
    span = (int(limit) >> 16) // n_blocks + 1  # n-grams are told apart by 48 bits here: a false meeting only costs time

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = table.value
        low = np.uint64(len(hot) - 1)
        seen: set[int] = set()
        grams, nodes, held = [], [], 0

        def dealt() -> pa.RecordBatch:
            g, v = np.concatenate(grams), np.concatenate(nodes)
            known = hot[(g & low).astype(np.int64)]
            apart = v[known]
            g, v = g[~known] >> np.uint64(16), v[~known]
            order = np.argsort(g)
            g, v = g[order], v[order]
            block = (g // np.uint64(span)).astype(np.int32)
            rows = []
            for a, b in _cuts(block):
                at = int(block[a]) * span
                rows.append((int(block[a]), *_packed(g[a:b], at, at + span), np.ascontiguousarray(v[a:b].view(np.uint8).reshape(-1, 8)[:, :5]).tobytes(), b""))
            # very frequent n-grams are shared without a look; their nodes go to blocks of their own
            block = (mix(apart) % np.uint64(n_blocks)).astype(np.int32)
            order = np.argsort(block, kind="stable")
            apart, block = apart[order], block[order]
            rows += [(int(block[a]), 1, b"", b"", b"", apart[a:b].tobytes()) for a, b in _cuts(block)]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), *(pa.array([r[i] for r in rows], pa.binary()) for i in range(2, 6))], ["block", "low", "rest", "bitmap", "v", "apart"])

        for batch in batches:
            for _, _, raw, at in text_chunks(batch.column(0)):
                for s in gram_sets(raw, at, n):
                    if not len(s) or (node := node_id(s)) in seen:
                        continue
                    if len(seen) < 1 << 20:
                        seen.add(node)
                    s = s[: np.searchsorted(s, limit, "right")]
                    grams.append(s)
                    nodes.append(np.full(len(s), np.uint64(node & int(NODE_BITS))))
                    held += len(s)
                if held >= GATHERED:
                    yield dealt()
                    grams, nodes, held = [], [], 0
        if held:
            yield dealt()

    def met(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = key[0].as_py() * span
        g, v, apart = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], []
        for batch in batches:
            for _, low, rest, bitmap, nodes, other in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                g.append(_unpacked(low, rest, bitmap, at)[: len(nodes) // 5])
                wide = np.zeros((len(nodes) // 5, 8), np.uint8)
                wide[:, :5] = np.frombuffer(nodes, np.uint8).reshape(-1, 5)
                v.append(wide.view("<u8").ravel())
                apart.append(np.frombuffer(other, np.uint64))
        g, v = np.concatenate(g), np.concatenate(v)
        order = np.lexsort((v, g))
        g, v = g[order], v[order]
        once = np.r_[True, (g[1:] != g[:-1]) | (v[1:] != v[:-1])][: len(g)]  # a node counts once, whatever its copies
        g, v = g[once], v[once]
        same = g[1:] == g[:-1]
        hit = (np.r_[same, False] | np.r_[False, same])[: len(g)]
        k, c = np.unique(np.concatenate([v[hit], *apart]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(c.astype(np.int64))], ["k", "shared"])

    dealt = docs.select(F.col(text).alias("t")).mapInArrow(run, "block int, low int, rest binary, bitmap binary, v binary, apart binary")
    return dealt.groupBy("block").applyInArrow(met, "k long, shared long").groupBy("k").agg(F.sum("shared").alias("shared"))


def _members(nodes: DataFrame, shared: DataFrame, threshold: int) -> DataFrame:
    """Of nodes, those that are not alone: of their n-grams in the range looked at, at most `slack` occur nowhere else."""
    met = nodes.join(shared, F.col("node").bitwiseAND(F.lit(int(NODE_BITS))) == F.col("k"), "left")
    return met.filter(F.col("looked") - F.coalesce("shared", F.lit(0)) <= slack(F.col("size"), threshold)).select("node", "d", "h", "size", "ranges")


def _sets(docs: DataFrame, members: DataFrame, n: int, text: str, key: str) -> DataFrame:
    """node, grams (its sorted n-gram hashes), from the text of one document of each member."""
    spark = docs.sparkSession
    mark = spark.sparkContext.broadcast(_bitmap(members))
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(-1)).alias("d"), F.xxhash64(text).alias("h"), F.col(text).alias("t"))

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = mark.value
        for batch in batches:
            h = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            yield batch.filter(pa.array(on[(h % np.uint64(len(on))).astype(np.int64)]))

    asked = members.select(F.coalesce("d", F.lit(-1)).alias("d"), "h", "node")
    texts = rows.mapInArrow(marked, "d long, h long, t string").join(asked, ["d", "h"]).dropDuplicates(["d", "h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, at in text_chunks(batch.column(1)):
                sets = gram_sets(raw, at, n)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "grams"])

    return texts.select("node", "t").mapInArrow(run, "node long, grams binary")


def _postings(sets: DataFrame, frequent: np.ndarray, threshold: int) -> DataFrame:
    """Prefix n-grams that another member has too: gram, node, size, pos (its place in the node's rare-first order), alone
    (how many of the node's n-grams nobody else has).

    N-grams are counted exactly where they meet, and those with company go back to their nodes, where the prefix is
    taken. Very frequent ones, ordered after all others by a table of counts, need no count and never meet in one place.
    """
    table = sets.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = table.value
        low = np.uint64(len(place) - 1)
        for batch in batches:
            for i in range(batch.num_rows):
                g = np.frombuffer(batch.column(1)[i].as_buffer(), np.uint64)
                if len(g):
                    n = pa.array(np.full(len(g), batch.column(0)[i].as_py(), np.int64))
                    yield pa.RecordBatch.from_arrays([n, pa.array(np.full(len(g), len(g), np.int32)), pa.array(g.view(np.int64)), pa.array(place[(g & low).astype(np.int64)])], ["node", "size", "gram", "place"])

    rows = sets.select("node", "grams").mapInArrow(run, "node long, size int, gram long, place int")
    met = rows.filter("place = 0").drop("place").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("gram"))).filter("n > 1")
    hot = rows.filter("place > 0").select("node", "size", "gram", (F.col("place") + F.lit(1 << 40)).alias("n"))
    own = Window.partitionBy("node")
    placed = met.union(hot).withColumn("alone", (F.col("size") - F.count(F.lit(1)).over(own)).cast("int"))
    placed = placed.withColumn("pos", F.col("alone") + F.row_number().over(own.orderBy("n", "gram")) - 1)
    return placed.filter(F.col("pos") <= slack(F.col("size"), threshold)).select("gram", "node", "size", "pos", "alone")


def _fits(threshold: int) -> Column:
    """The length and positional filters on a pair of postings x and y; the smaller set needs a shorter prefix."""
    need = least_overlap(F.col("x.size"), F.col("y.size"), threshold)
    low, high = F.least("x.size", "y.size"), F.greatest("x.size", "y.size")
    short = F.when(F.col("x.size") <= F.col("y.size"), F.col("x.pos")).otherwise(F.col("y.pos"))
    return (low * 100 >= high * threshold) & (short <= low - least_overlap(low, low, threshold)) & (F.least(F.col("x.size") - F.col("x.pos"), F.col("y.size") - F.col("y.pos")) >= need)


def most_shared(x: np.ndarray, y: np.ndarray, depth: int = 3) -> int:
    """A bound on what two sorted sets share: both are cut where x's middle lies, part by part, to a depth."""
    if not depth or not len(x) or not len(y):
        return min(len(x), len(y))
    m = len(x) // 2
    j = int(np.searchsorted(y, x[m]))
    same = int(j < len(y) and y[j] == x[m])
    return same + most_shared(x[:m], y[:j], depth - 1) + most_shared(x[m + 1 :], y[j + same :], depth - 1)


def similar(x: np.ndarray, y: np.ndarray, threshold: int) -> bool:
    """Whether two sorted sets are as similar as asked for; the suffix filter goes first."""
    if most_shared(x, y) < -(-threshold * (len(x) + len(y)) // (100 + threshold)):
        return False
    both = np.sort(np.concatenate([x, y]), kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= threshold * (len(both) - shared)


def _verified(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Of pairs (a, b), those that pass the suffix filter and whose whole sets are similar enough."""
    met = pairs.join(sets, pairs.a == sets.node).select("a", "b", F.col("grams").alias("ga"))
    met = met.join(sets, met.b == sets.node).select("a", "b", "ga", F.col("grams").alias("gb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), threshold) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    return met.mapInArrow(run, "a long, b long")


def _possible(pairs: DataFrame, members: DataFrame, threshold: int) -> DataFrame:
    """Of pairs (a, b), those that pass the first suffix filter: what their ranges of hashes can share is enough."""
    side = lambda x: members.select(F.col("node").alias(x), F.col("size").alias(f"{x}_size"), F.col("ranges").alias(f"{x}_ranges"))
    met = pairs.join(side("a"), "a").join(side("b"), "b")
    most = F.aggregate(F.zip_with("a_ranges", "b_ranges", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    return met.filter(most >= least_overlap(F.col("a_size"), F.col("b_size"), threshold)).select("a", "b")


def _reached(links: list[DataFrame]) -> DataFrame:
    """node, comp: the one of the nodes that links (a, b) reach that stands for them, for all nodes that they name."""
    every = links[0]
    for x in links[1:]:
        every = every.union(x)
    return roots(every).select(F.col("id").alias("node"), F.col("to").alias("comp"))


def _hubs(links: DataFrame) -> DataFrame:
    """node, comp: where a few steps from a node to its pivot (a to b) lead. Nodes of one comp are linked; those of two
    may be, so that a step too few costs time alone."""
    own = links.groupBy("a").agg(F.min("b").alias("b"))
    now = stored(own.select(F.col("a").alias("node"), F.col("b").alias("comp")), "hubs")
    far = now.select(F.col("node").alias("comp"), F.col("comp").alias("far"))
    once = stored(now.join(far, "comp", "left").select("node", F.coalesce("far", "comp").alias("comp")), "hubs")
    discard(now)
    return once


def _links(docs: DataFrame, profiles: DataFrame, nodes: DataFrame, n: int, threshold: int, text: str, key: str) -> list[DataFrame]:
    """Stored tables of links (a, b) between nodes, enough to reach what all links reach."""
    frequent = _frequent(profiles)
    members = stored(_members(nodes, _shared(docs, frequent, n, threshold, text), threshold), "members")
    sets = stored(_sets(docs, members, n, text, key), "sets")
    postings = stored(_postings(sets, frequent, threshold), "postings")
    used, links, tried, active, before = [members, sets, postings], [], None, postings, None
    total = postings.count()

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """The links among pairs that have not been tried before, stored."""
        nonlocal tried
        if tried is not None:
            known = tried.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
            pairs = pairs.join(known, (F.least("a", "b") == F.col("lo")) & (F.greatest("a", "b") == F.col("hi")), "left_anti")
        pairs = stored(pairs, "pairs")
        used.append(pairs)
        tried = pairs if tried is None else tried.union(pairs)
        links.append(stored(_verified(pairs, sets, threshold), name))
        return links[-1]

    for turn in range(ROUNDS):
        # In each n-gram's list one node is the pivot, and each node is verified against the best of its pivots. First
        # those come that have few n-grams of their own: a copy's edits are n-grams that nobody shares, an original has
        # few of them, and its copies are nearest to it.
        rank = F.struct("alone", "node") if turn == 0 else F.struct(F.xxhash64("node", F.lit(turn)).alias("alone"), "node")
        pivots = active.groupBy("gram").agg(F.min(F.struct(rank.alias("rank"), "node", "size", "pos")).alias("p")).select("gram", "p.rank", "p.node", "p.size", "p.pos")
        pairs = active.alias("x").join(pivots.alias("y"), "gram").filter(F.col("x.node") != F.col("y.node")).filter(_fits(threshold))
        best = pairs.groupBy(F.col("x.node").alias("a")).agg(F.min(F.struct("y.rank", "y.node")).alias("best"))
        found = verified(best.select("a", F.col("best.node").alias("b")), "links")
        hubs = _hubs(found) if turn == 0 else _reached(links)
        used += [hubs] if turn == 0 else []
        # what is left: lists whose members are not all known to be linked
        placed = postings.join(hubs, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        mixed = placed.groupBy("gram").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("gram")
        active = stored(placed.join(mixed, "gram"), "active")
        used.append(active)
        totals = active.groupBy("gram", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("gram").agg(F.sum("n").alias("all"), F.sum(F.col("n") * F.col("n")).alias("own"))
        left = totals.agg(F.sum((F.col("all") * F.col("all") - F.col("own")) / 2)).first()[0] or 0
        if left <= CROSS * total or (before is not None and 2 * left > before):
            break
        before = left
    if left:
        # pairs of components in a list, then the members of either: members of one component never meet
        # (the filters as far as a whole component can tell: sizes, n-grams from here on, and a prefix short enough)
        early = F.col("pos") <= F.col("size") - least_overlap(F.col("size"), F.col("size"), threshold)
        groups = active.groupBy("gram", "comp").agg(F.count(F.lit(1)).alias("n"), F.min("size").alias("lo"), F.max("size").alias("hi"), F.max(F.col("size") - F.col("pos")).alias("rest"), F.bool_or(early).alias("early"))
        g, h = groups.alias("g"), groups.alias("h")
        # the smaller component's members come first, so that the larger one's are only met under the filters
        smaller = F.struct("g.n", "g.comp") < F.struct("h.n", "h.comp")
        sizes = (F.col("g.hi") * 100 >= F.col("h.lo") * threshold) & (F.col("h.hi") * 100 >= F.col("g.lo") * threshold)
        enough = F.least("g.rest", "h.rest") >= least_overlap(F.col("g.lo"), F.col("h.lo"), threshold)
        short = (F.col("g.early") & (F.col("g.lo") <= F.col("h.hi"))) | (F.col("h.early") & (F.col("h.lo") <= F.col("g.hi")))
        met = g.join(h, (F.col("g.gram") == F.col("h.gram")) & smaller & sizes & enough & short)
        met = met.select(F.col("g.gram").alias("gram"), F.col("g.comp").alias("ca"), F.col("h.comp").alias("cb"))
        x = active.select("gram", F.col("comp").alias("ca"), F.struct("node", "size", "pos").alias("x"))
        y = active.select("gram", F.col("comp").alias("cb"), F.struct("node", "size", "pos").alias("y"))
        pairs = met.join(x, ["gram", "ca"]).join(y, ["gram", "cb"]).filter(_fits(threshold))
        pairs = pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
        verified(_possible(pairs, members, threshold), "links")
    discard(*used)
    return links


def _bitmap(members: DataFrame, bits: int = 1 << 23) -> np.ndarray:
    """A fixed-size set of the texts asked for: one that it names falsely costs time alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = np.zeros(bits, bool)
        for batch in batches:
            on[(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64) % np.uint64(bits)).astype(np.int64)] = True
        packed = np.packbits(on).reshape(64, -1)
        rows = [(i, x.tobytes()) for i, x in enumerate(packed) if x.any()]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], ["part", "bits"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.frombuffer(pdf["bits"].iloc[0], np.uint8).copy()
        for other in pdf["bits"].iloc[1:]:
            x |= np.frombuffer(other, np.uint8)
        return pd.DataFrame({"part": pdf["part"].iloc[:1], "bits": [x.tobytes()]})

    out = np.zeros((64, bits // 512), np.uint8)
    for r in members.select("h").mapInArrow(run, "part int, bits binary").groupBy("part").applyInPandas(merge, "part int, bits binary").collect():
        out[r.part] = np.frombuffer(r.bits, np.uint8)
    return np.unpackbits(out).astype(bool)


def near_duplicates(docs: DataFrame, n: int = N, threshold: int = THRESHOLD, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per document: key, n_shingles (size of its set), component_id (smallest key that links reach, its own included).

    A-Z is lower-cased and words are runs without ASCII white space; a document's set holds its distinct n-word
    shingles, with fewer words the whole sequence as one. Two documents link when 100 * intersection >= threshold *
    union, in whole numbers. Documents without words, null texts included, link with nothing and are their own
    component. Keys are whole numbers or what casts to them. Rows that repeat a key are one document as far as
    components go, and come out as often as they come in. A null key has no part in the smallest key; its component is
    that of its links, or null. Only key and text are read. Sets are told apart by 64-bit hashes of words and n-grams.
    """
    profiles = stored(_profiles(docs, n, threshold, text, key), "profiles")
    rows = profiles.filter("size is not null")
    rep = F.min(F.struct(F.coalesce("d", F.lit(-1)).alias("d"), "h"))
    nodes = rows.filter("size > 0").groupBy("node").agg(F.min("d").alias("least"), rep.alias("rep"), F.first("size").cast("int").alias("size"), F.first("looked").alias("looked"), F.first("ranges").alias("ranges"))
    nodes = stored(nodes.select("node", "least", "rep.d", "rep.h", "size", "looked", "ranges"), "nodes")
    links = _links(docs, profiles, nodes, n, threshold, text, key)
    # rows of one key with different sets are one document
    twice = rows.filter("size > 0 and d is not null").groupBy("d").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a < b")
    spread = rows.filter("size > 0").join(twice.select("d", "a"), "d").filter(F.col("node") != F.col("a")).select("a", F.col("node").alias("b"))
    comps = _reached([*links, spread])
    discard(*links)
    first = nodes.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = first.groupBy("comp").agg(F.min("least").alias("component_id"))
    first = first.join(least, "comp").select("node", "component_id")
    out = rows.join(first, "node", "left")
    own = F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("d"))
    return out.select(F.col("d").alias(key), F.col("size").alias("n_shingles"), own.alias("component_id"))


def keep_one(docs: DataFrame, n: int = N, threshold: int = THRESHOLD, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs without those whose component has a smaller key; all columns stay. Documents without words are kept.

    Rows with a null key are all kept, also where they link with other rows. Rows that repeat a kept key all stay.
    """
    groups = near_duplicates(docs, n, threshold, text, key)
    kept = groups.filter(F.col("component_id") == F.col(key)).select(F.col(key).alias("kept_key")).distinct()
    return docs.join(kept, docs[key].cast("long") == kept.kept_key, "left_semi").union(docs.filter(docs[key].isNull()))
