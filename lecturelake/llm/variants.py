"""Spelling variants: words one edit apart are found by a frontier of states that meets the edges of a trie level by level.

The trie is a table of edges between nodes, one trie for the words and one for the words read backwards; a chain of nodes
without a branch or a word's end is one edge whose label has several characters. A state is (word, position, node, edits).
A word's states without edits are the nodes of its own path, which the building of the trie knows. Met with the edges,
a state takes its edit at the first character that differs, and then follows equal labels only; a state with one edit that
has used its word up at a word's end is a pair of neighbours. Of an edit's two sides one is at least half the word, so an
edit is tried in the second half of the path only, in one of the two tries; near the roots, where every word could turn
anywhere, there are no states.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, mix, stored
from .ngram_join import powers

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words that the numpy pass takes at once.
BLOCK = 4096


def count_words(docs: DataFrame, text: str = "text", key: str = "doc_id", least_chars: int = 5, least_count: int = 3, typo_in: int = 97) -> DataFrame:
    """word, n: how often each word occurs in whole texts, for words of at least so many code points and occurrences.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF; only A-Z is lower-cased. Of every typo_in-th (key, run), told
    by the crc32 of "key:run", one character is deleted (a null key is an empty string there). Null texts have no words;
    repeated rows count as often as they come. Other columns are not read.
    """
    runs = F.regexp_extract_all(F.translate(docs[text], UPPER, LOWER), F.lit("[a-zÀ-ÿ]+"), F.lit(0))
    words = docs.select(F.coalesce(docs[key].cast("string"), F.lit("")).alias("k"), F.explode(runs).alias("run")).filter(F.length("run") >= least_chars)
    h = F.crc32(F.concat("k", F.lit(":"), "run").cast("binary"))
    at = (h % F.length("run")).cast("int")
    cut = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    word = F.when(h % typo_in == 0, cut).otherwise(F.col("run"))
    return words.select(word.alias("word")).filter(F.length("word") >= least_chars).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)


def paths(words: DataFrame) -> DataFrame:
    """wid, back, depth, node, step, word, n: the nodes of every word's path from the middle on, forwards and backwards.

    step is the next code point, 0 at the word's end. Nodes are named by hashes of what leads to them, words (wid) by the
    node of their end; word and n stand there alone.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), BLOCK):
                own, n = batch["word"].iloc[lo : lo + BLOCK].to_numpy(object), batch["n"].iloc[lo : lo + BLOCK].to_numpy()
                size = np.fromiter(map(len, own), np.int64, len(own))
                word = np.repeat(np.arange(len(own)), size + 1)  # a node for each of the size + 1 depths
                depth = np.arange(len(word)) - np.repeat(np.cumsum(size + 1) - size - 1, size + 1)
                first = (np.cumsum(size) - size)[word]
                up, down = powers(int(size.sum()) + 1)
                names = None
                for back in (False, True):
                    codes = np.frombuffer("".join([w[::-1] for w in own] if back else own).encode("utf-32-le"), np.uint32)
                    total = np.zeros(len(codes) + 1, np.uint64)
                    np.cumsum(mix(codes.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
                    node = mix((total[first + depth] - total[first]) * down[first] + np.uint64(1 + back)).astype(np.int64)
                    at_end = depth == size[word]
                    step = np.where(at_end, 0, np.r_[codes, 0][first + depth]).astype(np.int32)
                    if names is None:
                        names = node[at_end]
                    rows = depth >= (size[word] - 1) // 2
                    told = at_end & (not back)
                    yield pd.DataFrame({
                        "wid": names[word][rows], "back": back, "depth": depth[rows].astype(np.int32), "node": node[rows], "step": step[rows],
                        "word": np.where(told, own[word], None)[rows], "n": pd.array(np.where(told, n[word], 0)[rows], "Int64"),
                    })

    return words.select("word", "n").mapInPandas(run, "wid long, back boolean, depth int, node long, step int, word string, n long")


def trie(words: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of words (word, n): wid, word, n; the tries' edges node, child, label, end_wid (the word that ends at the child), next
    (the characters that the child's labels begin with); and every word's own path wid, word (backwards in the backward trie), path array of (depth, node, end_wid).

    Both tries are one table, as their nodes have names of their own. A node without a branch or an end is part of a label.
    A node has an edge for each character at most, so that the join of a hot node's states can be split at a small cost
    (AQE's skew join does it).
    """
    steps = stored(paths(words), "variants-paths")
    named = stored(steps.filter("word IS NOT NULL").select("wid", "word", "n"), "variants-words")
    turns = steps.groupBy("node").agg(F.min("step").alias("low"), F.max("step").alias("high"), F.max(F.when(F.col("step") == 0, F.col("wid"))).alias("end_wid"))
    own = steps.select("wid", "back", "depth", "node").join(turns.filter("low <> high OR low = 0").select("node", "end_wid"), "node")
    own = own.groupBy("wid", "back").agg(F.sort_array(F.collect_list(F.struct("depth", "node", "end_wid"))).alias("path"))
    routes = own.join(named.drop("n"), "wid").select("wid", F.when(F.col("back"), F.reverse("word")).otherwise(F.col("word")).alias("word"), "path")
    routes = stored(routes, "variants-routes")
    discard(steps)
    two = F.transform(F.slice("path", 2, F.size("path")), lambda b, i: F.struct(F.get("path", i).alias("a"), b.alias("b")))
    edges = routes.select("word", F.explode(two).alias("x")).select(
        F.col("x.a.node").alias("node"),
        F.col("x.b.node").alias("child"),
        F.substr("word", F.col("x.a.depth") + 1, F.col("x.b.depth") - F.col("x.a.depth")).alias("label"),
        F.col("x.b.end_wid").alias("end_wid"),
    )
    edges = stored(edges.dropDuplicates(["node", "child"]), "variants-edges")
    onward = edges.groupBy(F.col("node").alias("child")).agg(F.array_join(F.collect_set(F.substr("label", F.lit(1), F.lit(1))), "").alias("next"))
    with_next = stored(edges.join(onward, "child", "left"), "variants-edges")
    discard(edges)
    return named, with_next, routes


def alive(word: Column, pos: Column, end_wid: Column, onward: Column) -> Column:
    """Whether a state is a pair, or an edge goes on from where it is."""
    return F.when(pos == F.length(word), end_wid.isNotNull()).otherwise(F.instr(onward, F.substr(word, pos + 1, F.lit(1))) > 0)


def first_edit(word: Column, pos: Column, label: Column) -> Column:
    """Positions in the word, of which an edit where it first differs from a label leads to the label's end."""
    size, rest = F.length(label), F.substr(label, F.lit(2))
    inside = pos < F.length(word)
    exchanged = F.when(inside & (rest == F.substr(word, pos + 2, size - 1)), pos + size)
    inserted = F.when(rest == F.substr(word, pos + 1, size - 1), pos + size - 1)
    deleted = F.when(inside & (label == F.substr(word, pos + 2, size)), pos + 1 + size)
    differs = ~inside | (F.substr(word, pos + 1, F.lit(1)) != F.substr(label, F.lit(1), F.lit(1)))
    return F.when(differs, F.array_compact(F.array(exchanged, inserted, deleted)))


def neighbours(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(wid, word, n of words by a number of their own; wid, near, near_word, near_n): of distinct words (word, n), all
    pairs, in both orders, that one inserted, deleted or replaced code point tells apart. Both are stored tables.

    A round takes every state one edge on, so there are as many as the longest path has branches and ends behind an edit.
    Words are told by 64-bit hashes; pairs are checked on the words themselves.
    """
    named, edges, routes = trie(words)
    states = routes.select("wid", "word", F.explode("path").alias("x")).filter(F.col("x.depth") >= F.floor(F.length("word") / 2))
    # where the one edit deletes the word's last character, no edge is met
    found = [states.filter(F.col("x.end_wid").isNotNull() & (F.col("x.depth") == F.length("word") - 1)).select("wid", F.col("x.end_wid").alias("near"))]
    met = states.select("wid", "word", F.col("x.depth").alias("pos"), F.col("x.node").alias("node")).join(edges, "node")
    met = met.withColumn("pos", F.explode(first_edit(F.col("word"), F.col("pos"), F.col("label"))))
    used = [edges, routes]
    while True:
        met = met.filter(alive(F.col("word"), F.col("pos"), F.col("end_wid"), F.col("next")))
        now = stored(met.select("wid", "word", "pos", F.col("child").alias("node"), "end_wid"), "variants-frontier")
        used.append(now)
        found.append(now.filter(F.col("pos") == F.length("word")).select("wid", F.col("end_wid").alias("near")))
        if len(found) == 16:
            found = [stored(reduce(DataFrame.union, found), "variants-found")]
            used.append(found[0])
        states = now.filter(F.col("pos") < F.length("word")).drop("end_wid")
        if states.isEmpty():
            break
        size = F.length("label")
        met = states.join(edges, "node").filter(F.col("label") == F.substr("word", F.col("pos") + 1, size)).withColumn("pos", F.col("pos") + size)
    pairs = reduce(DataFrame.union, found).distinct()
    near = named.select(F.col("wid").alias("near"), F.col("word").alias("near_word"), F.col("n").alias("near_n"))
    pairs = pairs.join(near, "near").join(named.select("wid", "word"), "wid").filter(F.levenshtein("word", "near_word", 1) == 1)
    out = stored(pairs.select("wid", "near", "near_word", "near_n"), "variants-pairs")
    discard(*used)
    return named, out


def variants(words: DataFrame, ratio: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n for distinct words (word, n).

    A word's form is its near word of largest n, ties to the smallest in code-point order, if that n is at least ratio
    (2 or more) times its own; root is where forms lead to. Without a near word n_near is 0, without a form form and
    form_n are null and root is the word.
    """
    if ratio < 2:
        raise ValueError("forms must occur at least twice as often, or they could lead in a circle")
    named, pairs = neighbours(words)
    best = pairs.groupBy("wid").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near_word")).alias("best"))
    taken = -F.col("best.minus") >= ratio * F.col("n")
    forms = named.join(best, "wid", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(taken, F.col("best.near_word")).alias("form"), F.when(taken, -F.col("best.minus")).alias("form_n")
    )
    forms = stored(forms, "variants-forms")
    discard(named, pairs)
    roots = forms.select("word", F.coalesce("form", "word").alias("root"))
    while True:
        jump = roots.select(F.col("word").alias("root"), F.col("root").alias("far"))
        further = stored(roots.join(jump, "root").select("word", F.col("far").alias("root"), (F.col("far") != F.col("root")).alias("moved")), "variants-roots")
        if hasattr(roots, "stored_path"):
            discard(roots)
        roots = further
        if roots.filter("moved").isEmpty():
            return forms.join(roots.drop("moved"), "word").select("word", "form", "root", "n", "n_near", "form_n")
