import hashlib
import random
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lecturelake.llm import bpe, langid, packing, pii, quality, topk, toxicity, warc
from lecturelake.llm.queries import ORACLES, QUERIES, TOKENIZER
from tests.oracle import SF, compare, connection

PATH = public_tokenizers.path(TOKENIZER)
ODD = ["'s", "<|endoftext|>", "<|startoftext|>", "<|", "Σ", "İ", "ﬁ", "é", "é", "\x1c", "\x85", "\xa0", "12", "½", "中", "😀", "\0", "</w>", "'LL", "a", "B", " ", "\n", "###", "abc" * 30]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    compare(connection(), QUERIES[name](spark, SF), ORACLES[name])


def test_bpe_equals_the_library(spark):
    library = Tokenizer.from_file(PATH)
    rng = random.Random(3)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 14))) for _ in range(2000)] + [None, ""]
    texts += [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    scan = bpe.ScanBPE(PATH)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    full = {r.doc_id: r for r in bpe.encode_decode(df, PATH).collect()}
    short = {r.doc_id: r for r in bpe.digests(df, PATH).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        assert list(full[i].ids) == ids and full[i].decoded == back and scan.encode(t) == ids
        assert short[i].n_tokens == len(ids) and short[i].decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()
        assert short[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_packing_is_whole_tight_and_gapless(spark):
    library = Tokenizer.from_file(PATH)
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + [None, "", "word " * 9000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = packing.pack_documents(df, PATH).collect()
    want = {i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    seen = {}
    for r in rows:
        ids = want[r.doc_id][r.start : r.start + r.length]
        assert r.start == 4096 * r.piece and len(ids) == r.length and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        seen.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(r.length for r in rows) == sum(map(len, want.values()))
    for parts in seen.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 4096
    assert len(seen) <= -(-sum(r.length for r in rows) // 4096) + 3


def test_packing_keeps_every_constraint():
    lengths = np.random.default_rng(1).integers(1, 60, 500)
    for score in ("norm", "dot"):
        cap = packing.Capacity(tokens=100, documents=4, attention=4000, weights=(1.0, 0.5, 0.5), score=score)
        bins, offsets = packing.best_fit(lengths, cap)
        for b in np.unique(bins):
            own = np.flatnonzero(bins == b)
            x = lengths[own][np.argsort(offsets[own])]
            assert x.sum() <= 100 and len(x) <= 4 and (x**2).sum() <= 4000
            assert np.array_equal(np.sort(offsets[own]), np.cumsum(x) - x)
    assert packing.best_fit(np.zeros(0, np.int64), cap)[0].size == 0


def test_topk_with_ties_sparse_rows_and_bad_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 7)
    rng = random.Random(4)
    rows = [(i, [rng.choice([0.0, 0.001, 0.5, -0.25]) for _ in range(6)]) for i in range(60)]
    rows += [(60, None), (61, [1.0, None]), (62, [float("nan")] * 6), (63, [float("inf")] * 6), (None, [1.0] * 6), (64, []), (5, rows[5][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    good = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q in {i for i, _ in good if i % 10 == 0}:
        v = next(v for i, v in good if i == q)
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q)[:10]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    got = [tuple(r) for r in topk.top_k(df, F.col("vec_id") % 10 == 0).collect()]
    assert sorted(got) == sorted(want)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_warc_round_trip_and_damage(spark):
    long = "<p>" + "ö x" * 60
    rows = [(3, "http://a/ü b", long), (1, None, long), (2, "http://b", long), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (None, "u", long), (7, "u\r\nWARC-Type: x", "\r\n\r\n")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    dictionary = warc.train_dictionary(spark.read.parquet(f"{SF}/pages.parquet"))
    archives = warc.write_archives(warc.mark_revisits(df), dictionary)
    got = {r.page_id: r for r in warc.read_archives(archives).collect()}
    assert len(got) == len(rows)
    for i, url, html in rows:
        raw = (html or "").encode()
        r = got[i]
        assert r.url == url and r.payload_bytes == len(raw) and r.payload_digest == hashlib.sha256(raw).hexdigest()
        revisit = html == long and i != 1
        assert (r.record_type, r.refers_to) == (("revisit", 1) if revisit else ("response", None))
        assert revisit or bytes(r.payload) == raw
    content = bytes(archives.filter("length(content) > 0").first().content)
    assert struct.unpack("<I", content[:4])[0] == warc.DICTIONARY_MAGIC
    size = struct.unpack("<I", content[4:8])[0]
    squeezed = zstandard.ZstdCompressor().compress(content[8 : 8 + size])
    other = struct.pack("<II", warc.DICTIONARY_MAGIC, len(squeezed)) + squeezed + content[8 + size :]
    broken = bytearray(content)
    broken[-6] ^= 255
    table = spark.createDataFrame([("ok", other), ("cut", content[:-3]), ("bad", bytes(broken)), ("none", None)], "archive string, content binary")
    errors = {(r.archive, r.error is None) for r in warc.read_archives(table, on_error="report").collect()}
    assert ("ok", True) in errors and ("ok", False) not in errors and ("cut", False) in errors and ("bad", False) in errors
    with pytest.raises(Exception, match="cut"):
        warc.read_archives(table.filter("archive = 'cut'")).collect()
    with pytest.raises(warc.ArchiveError):
        warc.parse_record(warc.record_bytes(1, "u", b"abc", hashlib.sha256(b"abc").hexdigest())[:-1])


def test_language_id_is_accurate_and_defined_for_odd_texts(spark):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text", "lang")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    dictionaries = langid.learn(docs, ~held)
    rows = langid.identify(docs.filter(held), dictionaries).collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.95
    assert sum(r.rejected for r in rows) / len(rows) < 0.03
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "12 %", "x"), (4, "the of and", "x")], "doc_id long, text string, score string")
    got = {r.doc_id: r for r in langid.identify(odd, dictionaries).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and all(got[i].rejected and got[i].score == 0 for i in (1, 2, 3))
    assert got[4].lang_pred in dictionaries and 0 <= got[4].score <= 1
    assert langid.identify(odd.limit(0), dictionaries).count() == 0 and langid.identify(odd, {}).filter("lang_pred = 'und'").count() == 4


def test_a_rare_label_leaves_the_other_languages_as_they_are(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("lang is not null").select("doc_id", "text", "lang")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    rare = spark.createDataFrame([(-1, "zq a mistyped label zq.", "zz")], docs.schema)
    dictionaries = langid.learn(docs.union(rare), ~held | (F.col("lang") == "zz"))
    assert min(len(v) for k, v in dictionaries.items() if k != "zz") > 1000 and dictionaries["zz"] == b"zq a mistyped label zq."
    rows = langid.identify(docs.filter(held & (F.col("lang") != "zz")), dictionaries).collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.9
    assert sum(r.rejected for r in rows) / len(rows) < 0.05


def test_clean_texts_are_kept_at_any_length(spark):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet").filter("lang is not null and text is not null").select("doc_id", "text", "lang")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    dictionaries = langid.learn(docs, ~held)
    english = " ".join(r.text for r in docs.filter(held & (F.col("lang") == "en")).orderBy("doc_id").collect())
    long = (english * (6_000_000 // len(english) + 1))[:6_000_000]
    short = ["The shor.", "Thre er. And erhe.", "Hahere ananing re.", "Ente erkeitung chst."]
    rows = spark.createDataFrame(list(enumerate([long, *short])), "doc_id long, text string")
    got = sorted((r.doc_id, r.lang_pred, r.rejected) for r in langid.identify(rows, dictionaries).select("doc_id", "lang_pred", "rejected").collect())
    assert got == [(i, "de" if i == 4 else "en", False) for i in range(5)]


def test_toxicity_learns_words_and_misspellings(spark):
    docs, labels = (spark.read.parquet(f"{SF.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = toxicity.learn(docs, labels, ~held)
    rows = toxicity.score(docs.filter(held).join(labels, "doc_id"), model).select("toxic", "score", "predicted").collect()
    assert sum(r.toxic == r.predicted for r in rows) / len(rows) > 0.85
    scorer = toxicity.Scorer(model.gram_logits(), 0.0)
    assert scorer.word("moronns") > scorer.word("thention")
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "the of")], "doc_id long, text string")
    assert all(0 <= r.score <= 1 for r in toxicity.score(odd, model).collect()) and toxicity.score(odd.limit(0), model).count() == 0
    neutral = toxicity.fit(["a b"], [0])
    assert {r.predicted for r in toxicity.score(odd, neutral).collect()} <= {0, 1}


def test_toxicity_reads_runs_without_white_space_whole():
    texts = [f"{a} {b} day" for a in ("moron", "idiot") for b in ("moron", "idiot", "stupid")] * 4 + ["nice day", "good morning day", "nice good day"] * 8
    model = toxicity.fit(texts, [1] * 24 + [0] * 24, buckets=1 << 10)
    scorer = toxicity.Scorer(model.gram_logits(), float(model.bias[1] - model.bias[0]))
    head = "nice,day," * 6
    clean, toxic = scorer.score(head + "good,day," * 50), scorer.score(head + "moron,idiot," * 50)
    assert clean < 0.5 < toxic
    run = "".join(chr(0x4E00 + 7 * i) for i in range(500))
    pieces = toxicity.words_of(run)
    assert {run[i : i + 5] for i in range(496)} == {p[i : i + 5] for p in pieces for i in range(len(p) - 4)} and max(map(len, pieces)) <= 40


def base(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    hit = {i + j for i, x in enumerate(windows) if windows.count(x) > 1 for j in range(8)}
    n = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit))
    return *n, n[0] < 20 or 100 * n[4] > 30 * n[0]


def test_quality_equals_brute_force(spark):
    rng = random.Random(5)
    texts = [rng.choice([" ", "\n", "\t "]).join(rng.choice(["a", "É😀", "b#", "<c>", "dd"]) for _ in range(rng.randint(0, 60))) for _ in range(80)]
    texts += [None, "", " \n\n", "x y z w v u t s " * 9, "l m\nl m\n \nl m"]
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, kept string")
    trusted = spark.createDataFrame([(0,), (1,), (None,), (0,)], "doc_id long")
    rows = {r.doc_id: r for r in quality.score(df, trusted, buckets=64).collect()}
    # the ratio, from buckets that Spark hashes and counts that Python makes
    grams = {r.doc_id: r.g for r in df.select("doc_id", quality.gram_buckets(quality.word_hashes(quality.words_of(F.coalesce("text", F.lit("")))), 64).alias("g")).collect()}
    raw, target = np.full(64, 0.5), np.full(64, 0.5)
    for i, g in grams.items():
        for b in g:
            raw[b] += 1
            target[b] += i in (0, 1)
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    for i, t in enumerate(texts):
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(t), i
        want = ratio[list(grams[i])].mean() if grams[i] else None
        assert (r.score is None) == (want is None) and (want is None or abs(r.score - want) < 1e-9)
        assert r.kept == (not r.base_failed and want is not None and want >= quality.LEAST_SCORE)
    assert quality.score(df.limit(0), trusted).count() == 0


def test_surrogates(spark):
    a = 'Mail ann.lee@mail3.example.com or ANN.LEE@MAIL3.EXAMPLE.COM, call +1 (499) 555-6503. Mr. John Smith and Mrs. Anna Smith: 4929348385146306, 8.196.197.208, token = "1eb9c654e721b4f812088970e66a6345cee33dd6"'
    rows = [(1, a, "x"), (2, a, "y"), (3, "again ann.lee@mail3.example.com or +14995556503", "z"), (4, None, "n"), (5, "", "e"), (6, "nothing here. version 3.", "q"), (7, a, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_entities string")
    got = {r.doc_id: r for r in pii.pseudonymize(df, "k").collect()}
    one = got[1].text
    for secret in ("ann.lee", "ANN.LEE", "555-6503", "499", "Smith", "John", "4929348385146306", "8.196.197.208", "1eb9c654"):
        assert secret not in one
    mail = re.search(r"[a-z]+\.[a-z]+@[a-z]+\d\.example\.com", one)[0]
    assert mail.upper() in one and mail in got[3].text
    phone = re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", one)[0]
    assert re.sub("[^0-9]", "", phone) in got[3].text
    man, woman = re.search(r"Mr\. (\w+) (\w+) and Mrs\. (\w+) (\w+):", one).group(1, 3)
    assert man in pii.GIVEN["male"] and woman in pii.GIVEN["female"]
    assert re.search(r'token = "[0-9a-f]{40}"$', one) and re.search(r" 4\d{15}, ", one)
    assert one == got[2].text == got[7].text and got[1].n_entities == 8 and "secret" in got[1].entity_kinds
    assert got[4].text is None and got[5].text == "" and got[6].text == rows[5][1] and got[6].n_entities == 0
    assert pii.pseudonymize(df.limit(0), "k").count() == 0


def test_surrogates_stay_distinct_in_a_crowded_space(spark):
    # ten thousand possible values, of which many are real: draws collide, and are drawn again
    e = spark.range(300).select(F.lit("secret").alias("kind"), F.format_string("%03d", F.col("id")).alias("canon"))
    m = pii.mapping(e, "k").collect()
    real = {r.canon for r in m}
    assert len({r.drawn for r in m}) == 300 and not real & {r.drawn for r in m}


def test_surrogates_of_every_script_come_to_an_end(spark, monkeypatch):
    rounds = []

    def stored(df, name, keep=pii.stored):
        rounds.append(name)
        assert len(rounds) < 40, "surrogates are drawn for ever"
        return keep(df, name)

    monkeypatch.setattr(pii, "stored", stored)
    mails = ["홍길동@회사.한국", "王小明@公司.cn", "łżź@ęąść.pl", "ğış@şğ.com.tr", "आमर@कखग.in", "ᚠᚢᚦ@ᚱᚲ.org", "𠀀𠀁@𠀂𠀃.cn", "١٢٣@عرب.com"]
    small = [f"{a}@{b}.com" for a in "aeiou" for b in "aeiou"]  # as many as there are surrogates of this form
    texts = ["Password: __________ x", "Secret:\n\n-------- y", "Dr. Արամ came", *(f"mail {m} now" for m in mails + small)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r for r in sorted(pii.pseudonymize(df, "k").collect())]
    assert [r.text for r in got[:2]] == texts[:2] and got[0].n_entities == got[1].n_entities == 0
    name = re.fullmatch(r"Dr\. ([Ա-Ֆ][ա-ֆ]{3}) came", got[2].text)
    assert name and name[1] != "Արամ"
    shown = [re.fullmatch(r"mail (\S+@\S+) now", r.text)[1] for r in got[3:]]
    assert all(r.n_entities == 1 for r in got[2:]) and len(set(shown)) == len(shown) and not set(shown) & {*mails, *small}
    for old, new in zip(mails, shown, strict=False):
        # drawn letters can hit the old ones by chance, yet not most of a name's
        assert len(new) >= len(old) and sum(a == b for a, b in zip(old.split(".")[0], new, strict=False) if a != "@") <= 2
    assert re.fullmatch(r"[가-힣]{3}@[가-힣]{2}\.한국", shown[0]) and re.fullmatch(r"[一-龥]{3}@[一-龥]{2}\.cn", shown[1])
