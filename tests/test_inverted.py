"""The stored index against a plain computation, and what a query reads of it."""

import math
import random
import re
from collections import Counter

import pytest

from lecturelake.operators import inverted

TOKEN = re.compile("[0-9A-Za-z가-힣_#+./-]+")


def tokens(text):
    return [w for w in TOKEN.findall((text or "").lower()) if len(w) > 1]


def plain(docs, query):
    fields, df = {}, Counter()
    for key, title, keywords, summary in docs:
        f = {"t": Counter(tokens(title)), "k": Counter(), "s": Counter(tokens(summary))}
        for term, weight in keywords or []:
            term = re.sub(r"\s+", " ", term.strip()).lower()
            if term:
                f["k"][term] += weight
            for w in tokens(term):
                f["k"][w] += weight * 0.5
        fields[key] = f
        df.update(set(f["t"]) | set(f["k"]) | set(f["s"]))
    length = {k: float(sum(sum(c.values()) for c in f.values())) for k, f in fields.items()}
    n, mean = len(docs), sum(length.values()) / len(docs)
    out = {}
    for key, f in fields.items():
        norm = 1.2 * (1 - 0.75 + 0.75 * (length[key] or mean) / mean)
        score = 0.0
        for term, w in query.items():
            tf = 1.5 * f["t"][term] + 2 * f["k"][term] + 0.5 * f["s"][term]
            if tf > 0:
                score += w * math.log(1 + (n - df[term] + 0.5) / (df[term] + 0.5)) * tf * 2.2 / (tf + norm)
        if score > 0:
            out[key] = score
    return out


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(9)
    words = ["heap", "Stack", "queue", "x", "trees", "운영체제", "a.b", "the", "of"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(rng.randint(0, n)))
    out = [(i, text(4), [(f"{rng.choice(words)} {rng.choice(words)}", 0.5), (rng.choice(words), 1.0)], text(40)) for i in range(300)]
    return [*out, (300, None, None, None), (301, "", [(" ", 1.0)], ""), (302, "heap", [], "rare")]


def test_scores_equal_a_plain_computation(spark, docs):
    df = spark.createDataFrame([(*d, 7) for d in docs], "id long, title string, keywords array<struct<term string, weight double>>, summary string, term int")
    for slices in (65_536, 40):
        index = inverted.build(df, "id", "title", "keywords", "summary", per_slice=slices)
        for query in ({"heap": 1.0, "stack queue": 0.5, "운영체제": 2.0, "absent": 1.0}, {"rare": 1.0}, {"absent": 1.0}, {}):
            want = plain(docs, query)
            got = {r.id: r.score for r in inverted.scores(index, query, "id").collect()}
            assert got == pytest.approx(want)
            best = [r.id for r in inverted.top(index, query, "id", 10).collect()]
            assert len(best) == min(10, len(want)) and [want[i] for i in best] == pytest.approx(sorted(want.values(), reverse=True)[:10])
    assert inverted.scores(inverted.build(df.limit(0), "id", "title", "keywords", "summary"), {"heap": 1.0}, "id").count() == 0


def test_a_query_reads_its_own_terms_alone(spark, docs):
    df = spark.createDataFrame(docs, "id long, title string, keywords array<struct<term string, weight double>>, summary string")
    index = inverted.build(df, "id", "title", "keywords", "summary")
    rows = inverted.blocks_of(index, {"rare": 1.0})
    plan = rows._jdf.queryExecution().explainString(rows._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert re.search(r"PartitionFilters: \[[^\]]*part", plan) and re.search(r"PushedFilters: \[[^\n]*term", plan)
    read = {r.part for r in rows.select("part").distinct().collect()}
    assert len(read) == 1 and index.blocks.select("part").distinct().count() > 5
