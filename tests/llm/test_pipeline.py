import random
import re

import corpus_pipeline
from lecturelake.llm.suffix import brute_force
from tests.llm.test_ngram_join import brute


def corpus():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    texts = [text(rng.randint(30, 160)) for _ in range(24)]
    texts += [texts[0], texts[1] + " tail", texts[2].replace("a", "a", 1), "mail me at bob.b@mail1.example.com now " + text(40), None, "", "123 %%"]
    shared = text(90)
    texts += [text(60) + " " + shared, shared + " " + text(80)]
    return [(i, t, "en" if i % 2 else "xx", "s", None if t is None else len(t)) for i, t in enumerate(texts)]


def test_stages_equal_brute_force(spark, tmp_path):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_duplicates", "repeated_passages", "personal_data", "packing"]
    df.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        out[name] = {r.doc_id: r for r in docs.collect()}
        if name != "packing":
            assert docs.columns == before.columns
    first = out["language_id"]
    assert not {i for i, t, *_ in rows if not re.search("[a-z]", t or "")} & set(first)
    kept = sorted(first)
    _, comps = brute([first[i].text for i in kept])
    second = [i for k, i in enumerate(kept) if comps[k] == k]
    assert sorted(out["near_duplicates"]) == second
    left = brute_force([first[i].text for i in second], 400)
    third = out["repeated_passages"]
    assert {i: third[i].text for i in second} == {i: x.decode() for i, x in zip(second, left, strict=True)}
    assert all(third[i].n_chars == len(third[i].text) for i in second)
    fourth = out["personal_data"]
    assert all((fourth[i].text == third[i].text) == ("@" not in third[i].text) for i in second)
    assert sum(r.length for r in spark.read.parquet(str(tmp_path / "packing")).collect()) > 0 and set(out["packing"]) == set(second)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == spark.read.parquet(str(tmp_path / "packing")).count()


def test_passages_of_over_fifty_words_go(spark):
    # 55 words in 250 bytes, in documents that are no near copies; 50 words stay
    rng = random.Random(3)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5))) for _ in range(n))
    long, short = text(55), text(50)
    assert len(long) < 287
    own = [text(90) for _ in range(6)]
    texts = [f"{own[i]} {long}" if i < 3 else f"{short} {own[i]}" for i in range(5)] + [own[5]]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.repeated_passages(spark, df, "").collect()}
    assert got == {i: f"{own[i]} " if i < 3 else texts[i] for i in range(6)}
