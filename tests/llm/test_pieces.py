import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from lecturelake.llm import pieces
from lecturelake.llm.queries import PIECES
from tests.oracle import SF

PATH = public_tokenizers.path(PIECES)
ODD = ["▁", " ", "  ", " " * 5, " " * 15, " " * 16, " " * 31, "a", "The", "ing", "²", ".", "².", "12", "中", "国", "😀", "é", "e\u0301", "\n", "\t", "\0", "<s>", "</s>", "<unk>", "<0x41>", "\xa0", "\ufffd", "x" * 40, "_", "__", "ß", "»,", "ation", "(", "\"", "”", "½", "٣"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces(PATH)


def test_ids_and_texts_equal_the_library(library, model):
    rng = random.Random(7)
    own = list(model.ranks)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 12))) for _ in range(6000)]
    texts += ["".join(rng.choice(own) for _ in range(rng.randint(0, 6))) for _ in range(6000)]
    texts += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz  .,éñ") for _ in range(rng.randint(0, 40))) for _ in range(6000)]
    texts += [" " * k for k in range(70)] + ["a" + " " * k + "b" for k in range(70)] + ["ab" * 50_000, "中文" * 20_000, " " * 50_000]
    for t in texts:
        ids = library.encode(t)
        assert model.encode(t) == ids, t[:80]
        assert model.decode(ids) == library.decode(ids), t[:80]


def test_pair_tests_equal_merging_the_joint_string(model):
    rng = random.Random(8)
    own = [i for i, p in enumerate(model.pieces) if p in model.ranks]

    def merged(text):
        symbols = list(text)
        while found := [(r, i) for i in range(len(symbols) - 1) if (r := model.ranks.get(symbols[i] + symbols[i + 1])) is not None]:
            i = min(found)[1]
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        return symbols

    blanks = [i for i in own if set(model.pieces[i]) == {"▁"}]
    pairs = [(a, b) for a in blanks for b in blanks] + [(rng.choice(own), rng.choice(own)) for _ in range(4000)]
    for a, b in pairs:
        joint = [model.pieces[a], model.pieces[b]]
        assert model.compatible(a, b) == (merged("".join(joint)) == joint), joint


def test_any_ids_decode_as_in_the_library(library, model):
    rng = random.Random(9)
    for _ in range(5000):
        ids = [rng.choice([rng.randint(0, 300), rng.randint(0, 31999)]) for _ in range(rng.randint(0, 7))]
        assert model.decode(ids) == library.decode(ids), ids


def test_whole_vocabulary_cuts(model, monkeypatch):
    # the coarser ways to cut give the same ids
    texts = ["ab cd, ef  12.5 ² x", " a▁b", "don't (stop)", "\n\n a", "é中 b"]
    for i in (1, 2):
        monkeypatch.setattr(pieces, "CUTS", pieces.CUTS[i:] if i == 1 else pieces.CUTS[-1:])
        other = pieces.Pieces(PATH)
        assert [other.encode(t) for t in texts] == [model.encode(t) for t in texts]


def test_tables(spark, library):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + [None, "", " ", "a" * 100_000, "same", "same"]
    rows = [(None if t == "same" else i, t, "x", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")
    full = sorted(((r.doc_id is None, r.doc_id or 0), list(r.ids), r.decoded) for r in pieces.encode_decode(df, PATH).collect())
    short = sorted(((r.doc_id is None, r.doc_id or 0), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.digests(df, PATH).collect())
    want = sorted(((k is None, k or 0), library.encode(t or ""), library.decode(library.encode(t or ""))) for k, t, *_ in rows)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert full == want
    assert short == sorted((k, len(ids), sha(",".join(map(str, ids))), sha(back)) for k, ids, back in want)
    assert pieces.digests(df.limit(0), PATH).count() == 0 and pieces.encode_decode(df.limit(0), PATH).count() == 0
