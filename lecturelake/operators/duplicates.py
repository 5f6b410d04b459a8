"""Frames that show the same: pairs of a group within profiles of metrics, without comparing all pairs.

Every profile bounds the Hamming distance of a hash. Two hashes of a distance of at most d agree in at least k of d + k
bands of their bits, so frames meet in cells of k bands' values, each pair in the first cell that it shares, and the other
metrics are only computed for what meets. Bits that are the same in all frames tell nothing apart and are in no band.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored

METRICS = ("phash", "dhash", "changed", "edge", "mse", "hist", "content_phash", "content_dhash", "content_changed", "content_edge", "content_mse", "content_hist")

#: Cells that a frame is put in, unless agreement in two bands alone takes more.
MOST_CELLS = 300
#: Work to compare two hashes that meet by chance, of that to put one in a cell.
MEETING = 0.1


@dataclass(frozen=True)
class Profiles:
    """The bounds of the three profiles and of the stricter one that needs no review; hashes of `bits` bits, whose
    bounds are for 256."""

    bits: int = 256
    phash: int = 30
    dhash: int = 34
    strict_phash: int = 18
    content_phash: int = 18
    content_dhash: int = 24
    sure_phash: int = 22
    sure_content_phash: int = 20
    mismatch: float = 0.18
    xor: float = 0.045

    def at_most(self, name: str) -> int:
        return getattr(self, name) * self.bits // 256

    def reason(self, m: dict[str, Column]) -> Column:
        strict = (m["phash"] <= self.at_most("strict_phash")) & (m["dhash"] <= self.at_most("content_dhash")) & (m["content_changed"] <= 0.14) & (m["content_mse"] <= 0.030) & (m["content_edge"] >= 0.72)
        near = (m["phash"] <= self.at_most("phash")) & (m["dhash"] <= self.at_most("dhash")) & (m["changed"] <= 0.055) & (m["mse"] <= 0.018) & (m["edge"] >= 0.86) & (m["hist"] >= 0.985)
        content = (m["content_phash"] <= self.at_most("content_phash")) & (m["content_dhash"] <= self.at_most("content_dhash")) & (m["content_changed"] <= 0.10) & (m["content_mse"] <= 0.025) & (m["content_edge"] >= 0.90) & (m["content_hist"] >= 0.97) & (m["hist"] >= 0.95)
        return F.when(strict, "strict").when(near, "near-identical").when(content, "content")

    def sure(self, m: dict[str, Column]) -> Column:
        hashes = (m["phash"] <= self.at_most("sure_phash")) & (m["content_phash"] <= self.at_most("sure_content_phash"))
        small = (m["changed"] <= 0.065) & (m["content_changed"] <= 0.08) & (m["mse"] <= 0.007) & (m["content_mse"] <= 0.009)
        return hashes & small & (m["edge"] >= 0.87) & (m["content_edge"] >= 0.87) & (m["hist"] >= 0.995) & (m["content_hist"] >= 0.995)


def hamming(a: list[Column], b: list[Column]) -> Column:
    """The distance of two hashes, words of 64 bits each."""
    return reduce(lambda s, d: s + d, [F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a, b, strict=True)])


def bands(hash_: Column, words: int, most: int) -> list[Column]:
    """At least most + 2 bands of a hash of so many words, together all of its bits."""
    each = min(64, -(-(most + 2) // words))
    cuts = [64 * i // each for i in range(each + 1)]
    part = lambda w, lo, hi: F.shiftrightunsigned(F.get(hash_, F.lit(w)), lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1))
    return [part(w, lo, hi) if hi - lo < 64 else F.get(hash_, F.lit(w)) for w in range(words) for lo, hi in zip(cuts, cuts[1:], strict=False)]


def dealt(varying: list[int], n: int) -> list[list[int]]:
    """The places of a hash's varying bits, dealt out to n bands; where bits are few, some bands are empty and always agree."""
    return [varying[len(varying) * i // n : len(varying) * (i + 1) // n] for i in range(n)]


def agreeing(hashes: int, a_group: float, bits: int, most: int) -> int:
    """In how many bands hashes are to agree to meet, from 2 on: the number with the least work for cells and chance meetings."""
    cost = lambda k: comb(most + k, k) * hashes * (1 + MEETING * a_group / 2 ** (1 + bits * k / (most + k)))
    return min((k for k in range(2, 6) if k == 2 or comb(most + k, k) <= MOST_CELLS), key=cost)


def near_hashes(frames: DataFrame, group: str, hash_: str, words: int, most: int) -> DataFrame:
    """g, a, b: pairs of frames (group, id, hash_) of one group, a < b, whose hashes differ in `most` bits or fewer, once each.

    Frames of one hash meet others as one, named by the least id of them; pairs of hashes are told apart to frames after.
    """
    h = [f"h{w}" for w in range(words)]
    x = frames.select(F.col(group).alias("g"), "id", *[F.get(hash_, F.lit(w)).alias(c) for w, c in enumerate(h)]).dropna(subset=["g", *h])
    one = x.groupBy("g", *h).agg(F.min("id").alias("one"), F.count(F.lit(1)).alias("frames"))
    told = one.groupBy("g").agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{k}{w}") for w, c in enumerate(h) for k, f in (("some", F.bit_or), ("all", F.bit_and))])
    told = told.agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("each"), *[f(f"{k}{w}").alias(f"{k}{w}") for w in range(words) for k, f in (("some", F.bit_or), ("all", F.bit_and))]).first()
    varying = [64 * w + i for w in range(words) for i in range(64) if told["n"] and (told[f"some{w}"] & ~told[f"all{w}"]) >> i & 1]
    k = agreeing(told["n"] or 0, told["each"] or 0.0, len(varying), most)
    parts = dealt(varying, most + k)

    def masks(places: list[int]) -> list[int]:
        """Of each word, the bits at these places; as Spark's signed longs."""
        m = [sum(1 << (p % 64) for p in places if p // 64 == w) for w in range(words)]
        return [v - (1 << 64) if v >> 63 else v for v in m]

    cells = list(combinations(range(len(parts)), k))
    struct = lambda i, m: F.struct(F.lit(i).alias("cell"), *[F.lit(v).cast("long").alias(f"m{w}") for w, v in enumerate(m)])
    put = one.select("g", "one", *h, F.inline(F.array(*[struct(i, masks(sorted(sum((parts[j] for j in c), [])))) for i, c in enumerate(cells)])))
    at = [f"at{w}" for w in range(words)]
    put = put.select("g", "one", *h, "cell", *[F.col(c).bitwiseAND(F.col(f"m{w}")).alias(f"at{w}") for w, c in enumerate(h)])
    a, b = (put.select(*at, "cell", "g", F.col("one").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in h]) for s in "ab")
    ha, hb = ([F.col(f"{s}_{c}") for c in h] for s in "ab")
    # the cell of a pair is that of the last k bands that agree: from its first band on no other does
    agrees = lambda p: reduce(lambda s, c: s & c, [u.bitwiseXOR(v).bitwiseAND(F.lit(m).cast("long")) == 0 for u, v, m in zip(ha, hb, masks(p), strict=True) if m], F.lit(True))
    first = F.element_at(F.array(*[F.lit(c[0]) for c in cells]), F.col("cell") + 1)
    others = reduce(lambda s, c: s + c, [F.when((first <= j) & agrees(p), 1).otherwise(0) for j, p in enumerate(parts)])
    met = a.join(b, [*at, "cell", "g"]).filter("a < b").filter(hamming(ha, hb) <= most).filter(others == k).select("g", F.col("a").alias("one_a"), F.col("b").alias("one_b"))
    met = met.union(one.filter("frames > 1").select("g", "one", "one"))
    of = x.withColumn("one", F.min("id").over(Window.partitionBy("g", *h)))
    for s in "ab":
        met = met.join(of.select("g", F.col("one").alias(f"one_{s}"), F.col("id").alias(s)), ["g", f"one_{s}"])
    return met.filter("one_a <> one_b or a < b").select("g", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def duplicate_edges(frames: DataFrame, group: str, metrics: Callable[[Column, Column], dict[str, Column]], profiles: Profiles = Profiles()) -> DataFrame:
    """group, a, b, reason, sure: pairs of a group's frames of different scenes, a < b, that a profile takes for the same.

    frames: group, id (unique in a group), scene, base, phash and content_phash (array<bigint>), and what metrics, a function of
    two frames' structs, needs for the METRICS and, for agendas, agenda_like, agenda_mismatch and agenda_xor: an agenda whose text
    has changed too much is none. sure: both are base frames and the stricter bounds hold. Frames without a hash meet nothing.
    """
    words = profiles.bits // 64
    # hashes of frames may be costly, and are read six times
    x = stored(frames.filter(F.col("phash").isNotNull() & F.col("content_phash").isNotNull()), "frames")
    met = near_hashes(x, group, "phash", words, profiles.at_most("phash")).union(near_hashes(x, group, "content_phash", words, profiles.at_most("content_phash"))).distinct()
    side = lambda s: x.select(F.col(group).alias("g"), F.col("id").alias(s), F.struct(*[c for c in x.columns if c != group]).alias(f"f{s}"))
    # the first join leaves a frame's pairs side by side, which pack well; the second does not sort what is wide by now
    met = met.join(side("a").hint("merge"), ["g", "a"]).join(side("b").hint("shuffle_hash"), ["g", "b"]).filter("fa.scene <> fb.scene")
    m = metrics(F.col("fa"), F.col("fb"))
    names = ["base_a", "base_b", *METRICS, "agenda_like", "agenda_mismatch", "agenda_xor"]
    met = met.select("g", "a", "b", F.col("fa.base").alias("base_a"), F.col("fb.base").alias("base_b"), *[m[n].alias(n) for n in names[2:]])
    # filters do not pass inline, so what metrics share is computed once and not again in each place that asks for it
    met = met.select("g", "a", "b", F.inline(F.array(F.struct(*names))))
    m = {n: F.col(n) for n in met.columns}
    vetoed = m["agenda_like"] & ((m["agenda_mismatch"] > profiles.mismatch) | (m["agenda_xor"] > profiles.xor))
    out = met.withColumn("reason", profiles.reason(m)).filter(F.col("reason").isNotNull() & ~F.coalesce(vetoed, F.lit(False)))
    sure = m["base_a"] & m["base_b"] & F.col("reason").isin("strict", "near-identical") & profiles.sure(m)
    return out.select(F.col("g").alias(group), "a", "b", "reason", sure.alias("sure"))
