import random

from lecturelake.llm import ngram_join, suffix


def corpus(seed, n=40):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(9))
    text = lambda k: "".join(word() for _ in range(k))
    shared = [text(rng.randint(40, 160)) for _ in range(4)]
    docs = [text(rng.randint(0, 200)) for _ in range(n)]
    for i in range(0, n, 3):
        p = rng.choice(shared)
        a = rng.randint(0, len(docs[i]))
        docs[i] = docs[i][:a] + p[rng.randint(0, 30) :] + docs[i][a:]
    docs += [docs[0], docs[3], docs[3][:300] + "X" + docs[3][300:], docs[6] + docs[6], "ab" * 600, "a" * 1500, None, "", "x" * 400]
    docs += [docs[9][:500] + rng.choice("qrstuv") + docs[9][501:] for _ in range(6)]
    return docs


def test_equals_brute_force(spark, monkeypatch):
    for seed, segment in ((1, 1 << 22), (2, 700)):
        monkeypatch.setattr(suffix, "SEGMENT", segment)
        texts = corpus(seed)
        rows = [(i, t, "s") for i, t in enumerate(texts)]
        df = spark.createDataFrame(rows, "doc_id long, text string, kept string").repartition(3)
        got = {r.doc_id: r for r in suffix.remove_repeats(df, 400).collect()}
        want = suffix.brute_force(texts, 400)
        for i, (t, w) in enumerate(zip(texts, want, strict=True)):
            assert bytes(got[i].kept) == w, (seed, i)
            assert got[i].n_bytes - got[i].n_removed == len(w) and got[i].text == t
            assert got[i].n_bytes == len((t or "").encode())
            assert sum(x.e - x.s for x in got[i].removed) == got[i].n_removed and len(got[i].removed) == got[i].n_spans


def test_empty_null_and_repeated_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert suffix.remove_repeats(df).count() == 0
    t = "".join(chr(97 + (i * i) % 26) for i in range(900))
    df = spark.createDataFrame([(1, t), (1, t), (None, t), (None, None), (5, "short")], "doc_id long, text string")
    got = sorted((r.n_bytes, r.n_removed, r.n_spans) for r in suffix.remove_repeats(df).collect())
    assert got == [(0, 0, 0), (5, 0, 0)] + [(900, 900, 1)] * 3


def test_repeated_rows_share_their_spans(spark):
    # a text with a passage of another one, as a thousand equal rows, and once more without a key
    rng = random.Random(4)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    passage = words(200)
    long = words(60) + passage + words(60)
    rows = [(1, long)] * 1000 + [(None, long), (2, "x" + passage + words(50)), (3, words(300))]
    spans = {(r.d, r.k): r.spans for r in suffix.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert max(map(len, spans.values())) < 60
    got = suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = dict(zip([t for _, t in rows[999:]], suffix.brute_force([t for _, t in rows[999:]], 400), strict=True))
    assert len(got) == len(rows) and all(bytes(r.kept) == want[r.text] for r in got)


def test_short_passages_of_many_words(spark, monkeypatch):
    # windows of 51 words, most under 400 bytes, by all windows; cut texts go in small segments and stretches too
    for seed, segment, hashed in ((5, 1 << 22, 1 << 21), (6, 60, 300)):
        monkeypatch.setattr(suffix, "SEGMENT", segment)
        monkeypatch.setattr(ngram_join, "HASHED", hashed)
        rng = random.Random(seed)
        text = lambda n: rng.choice("\n \t").join("".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(n))  # noqa: B023, E731
        shared = [text(n) for n in (50, 51, 52, 60, 75, 200)]
        docs = [text(rng.randint(0, 150)) for _ in range(30)]
        for i in range(24):
            docs[i] += " " + shared[i % 6].replace("a", "A" if i % 4 else "a") + "\n" + text(rng.randint(0, 60))
        docs += [docs[1] + " " + docs[1], "a b " * 80, "x " * 51, "x " * 50, "", None, shared[3].replace(" ", "\n"), docs[2], docs[2]]
        df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3)
        got = {r.doc_id: r for r in suffix.remove_repeats(df, n_words=51).collect()}
        left, some = suffix.brute_force(docs, 400), 0
        for i, (t, spans) in enumerate(zip(docs, suffix.brute_force_words(docs, 51), strict=True)):
            raw = (t or "").encode()
            gone = {b for s, e in spans for b in range(s, e)}
            some += bool(spans) and len(left[i]) == len(raw)
            for s, e in ((x.s, x.e) for x in got[i].removed):
                gone -= set(range(s, e))
            assert not gone, (seed, i)
            if len(left[i]) == len(raw):
                assert [(x.s, x.e) for x in got[i].removed] == spans, (seed, i)
        assert some > 10
