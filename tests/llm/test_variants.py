import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lecturelake.llm import variants
from lecturelake.llm.queries import QUERIES
from tests.oracle import SF

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_counts(rows, least_chars=5, least_count=3):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least_chars:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= least_count}


def apart_by_one(a, b):
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return a != b and (a[k + 1 :] == b[k + 1 :] or a[k:] == b[k + 1 :] or a[k + 1 :] == b[k:])


def plain_variants(words):
    near = {a: [b for b in words if abs(len(a) - len(b)) < 2 and apart_by_one(a, b)] for a in words}
    form = {}
    for w, n in words.items():
        if near[w]:
            best = min(near[w], key=lambda x: (-words[x], x))
            if words[best] >= 2 * n:
                form[w] = best
    out = set()
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(near[w]), words.get(form.get(w))))
    return out


def rows_of(df):
    rows = [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert rows_of(QUERIES["op12_spelling_variants"](spark, SF)) == plain_variants(plain_counts([tuple(r) for r in docs]))


@pytest.mark.parametrize("letters", ["ab", "abcdeé", "aÿ\U0001f600"])
def test_variants_equal_brute_force(spark, letters):
    rng = random.Random(len(letters))
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(0, 9))): rng.randint(1, 400) for _ in range(500)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert rows_of(variants.variants(df)) == plain_variants(words)


def test_chains_long_words_and_ties(spark):
    words = {"x" * 4000 + "y": 5, "x" * 4000: 10, "x" * 3999 + "zy": 20, "z" * 2000 + "q" * 2000: 1, "z" * 1999 + "q" * 2000: 2}
    words |= {"aaaaa" + "b" * k: 2**k for k in range(12)}  # nested words, and a chain of eleven forms
    words |= {"colour": 3, "color": 6, "colouR": 6, "colours": 6}  # ties to the smallest
    got = rows_of(variants.variants(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert got == plain_variants(words)
    by_word = {r[0]: r for r in got}
    assert by_word["aaaaa"][2] == "aaaaa" + "b" * 11 and by_word["colour"][1] == "color"


def test_odd_tables(spark):
    rows = [(1, "Alpha alphA ALPHA"), (1, "Alpha alphA ALPHA"), (None, "alpha Élan Élan"), (2, None), (3, ""), (4, "12 ab"), (5, "q" * 30_000 + " " + "q" * 30_000)]
    df = spark.createDataFrame([(*r, 7, "clash") for r in rows], "doc_id long, text string, n int, word string")
    got = {r.word: r.n for r in variants.count_words(df, least_count=1).collect()}
    assert got == plain_counts(rows, least_count=1)
    assert variants.count_words(df.limit(0)).count() == 0 and variants.variants(variants.count_words(df.limit(0))).count() == 0
    one = spark.createDataFrame([("alone", 3)], "word string, n long")
    assert rows_of(variants.variants(one)) == {("alone", None, "alone", 3, 0, None)}
    with pytest.raises(ValueError, match="twice"):
        variants.variants(one, ratio=1)


def test_a_hot_prefix(spark):
    words = spark.range(3000).select(F.concat(F.lit("prefix"), F.lpad(F.conv("id", 10, 26), 3, "0")).alias("word"), (F.col("id") % 50 + 1).alias("n"))
    assert rows_of(variants.variants(words)) == plain_variants({r.word: r.n for r in words.collect()})
