"""BPE encoding and decoding with a priority queue of merge ranks over a doubly linked list of symbols."""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain, pairwise
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: White space in Unicode's sense. Python's str.split() takes the four separators 1C to 1F besides.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
ODD_SPACE = regex.compile(r"[\x1c-\x1f]")
SPLIT_SPACE = regex.compile(f"[{SPACE}]+")

#: Distinct words that an encoder remembers at most; after that it starts afresh. Only speed depends on it.
CACHE_WORDS = 1_500_000


def byte_letters() -> list[str]:
    """The printable letter for each byte: Latin-1's visible ones stand for themselves, the others follow from 256 on."""
    seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in seen else chr(next(rest)) for b in range(256)]


class BPE:
    """Encoder and decoder for a vocabulary file of the tokenizers library whose model is byte-level BPE with word ends.

    Normalization: NFC, white space to blanks, lower case letter by letter. Special tokens found in a text become their
    own ids, as that library does it unless told otherwise. Symbols outside the vocabulary are dropped (there is no
    unknown token).
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        pairs = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        # a pair of ids as one integer -> rank; rank -> the id of what it makes
        self.ranks = {self.vocab[a] << 32 | self.vocab[b]: rank for rank, (a, b) in enumerate(pairs)}
        self.made = [self.vocab[a + b] for a, b in pairs]
        self.suffix = model.get("end_of_word_suffix") or ""
        letters = byte_letters()
        self.letters = letters
        self.inner = [self.vocab.get(c) for c in letters]
        self.last = [self.vocab.get(c + self.suffix) for c in letters]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")")
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(split["pattern"]["Regex"].replace(r"\s", SPACE)).findall
        self.strings = dict((i, s) for s, i in self.vocab.items()) | {i: s for s, i in self.special.items()}
        self.byte_of = {c: b for b, c in enumerate(letters)}
        self.cache: dict[str, bytes] = {}

    def merge(self, piece: str) -> list[int]:
        """Ids of one piece: merge the pair of least rank, leftmost first, until none is left."""
        raw, inner = piece.encode(), self.inner
        symbols = [inner[b] for b in raw]
        symbols[-1] = self.last[raw[-1]]
        if None in symbols:
            symbols = [s for s in symbols if s is not None]
        n, rank_of = len(symbols), self.ranks.get
        if n < 2:
            return symbols
        # queue entries: rank and place in one integer, so that equal ranks come leftmost first
        bits = max(12, n.bit_length())
        low = (1 << bits) - 1
        queue = [r << bits | i for i, (a, b) in enumerate(pairwise(symbols)) if (r := rank_of(a << 32 | b)) is not None]
        if not queue:
            return symbols
        heapify(queue)
        after = [*range(1, n), -1]
        before = [*range(-1, n - 1)]
        while queue:
            top = heappop(queue)
            i, rank = top & low, top >> bits
            j, a = after[i], symbols[i]
            if a < 0 or j < 0 or rank_of(a << 32 | symbols[j]) != rank:
                continue  # stale: one of the two has been merged since
            symbols[i] = new = self.made[rank]
            symbols[j] = -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if (r := rank_of(new << 32 | symbols[k])) is not None:
                    heappush(queue, r << bits | i)
            h = before[i]
            if h >= 0 and (r := rank_of(symbols[h] << 32 | new)) is not None:
                heappush(queue, r << bits | h)
        return [s for s in symbols if s >= 0]

    def word(self, word: str) -> tuple[int, ...]:
        """Ids of a normalized word without white space."""
        if word.isalpha():
            return tuple(self.merge(word))
        return tuple(chain.from_iterable(map(self.merge, self.pieces(word))))

    def words(self, text: str) -> list[str]:
        """The normalized words of a stretch of text without special tokens."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        return [w for w in SPLIT_SPACE.split(text) if w] if ODD_SPACE.search(text) else text.split()

    def encode_bytes(self, text: str | None) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers; words met before come from the cache."""
        out: list[bytes] = []
        for stretch in self.special_split.split(text) if text and "<|" in text else (text,) if text else ():
            if stretch in self.special:
                out.append(pack("<I", self.special[stretch]))
                continue
            words = self.words(stretch)
            found = list(map(self.cache.get, words))
            if None in found:
                if len(self.cache) >= CACHE_WORDS:
                    self.cache.clear()
                for i, x in enumerate(found):
                    if x is None and (x := self.cache.get(words[i])) is None:
                        ids = self.word(words[i])
                        x = self.cache[words[i]] = pack(f"<{len(ids)}I", *ids)
                    found[i] = x
            out += found
        return b"".join(out)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """Concatenate the vocabulary's strings; letters stand for bytes again and the suffix of a word's end stays in place.

        The file names no decoder, and the tokenizers library then joins the tokens' strings with blanks.
        """
        return " ".join(map(self.strings.__getitem__, ids))


class ScanBPE(BPE):
    """The same ids; in short pieces the least rank is looked for by a scan, which beats a queue there."""

    def merge(self, piece: str) -> list[int]:
        raw, inner = piece.encode(), self.inner
        if len(raw) > 40:
            return super().merge(piece)
        symbols = [inner[b] for b in raw]
        symbols[-1] = self.last[raw[-1]]
        if None in symbols:
            return super().merge(piece)
        rank_of, made, never = self.ranks.get, self.made, len(self.made)
        ranks = [rank_of(a << 32 | b, never) for a, b in pairwise(symbols)]
        while ranks and (rank := min(ranks)) < never:
            i = ranks.index(rank)
            symbols[i] = new = made[rank]
            del symbols[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank_of(new << 32 | symbols[i + 1], never)
            if i:
                ranks[i - 1] = rank_of(symbols[i - 1] << 32 | new, never)
        return symbols


_loaded: dict[tuple[type, str], BPE] = {}


def encoder(path: str, kind: type[BPE] = BPE) -> BPE:
    """The encoder for a file, once for each Python process."""
    if (kind, path) not in _loaded:
        _loaded[kind, path] = kind(path)
    return _loaded[kind, path]


def encode_decode(df: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Encode every whole text and decode it again: key, ids array<int>, decoded string.

    A null or empty text gives no ids and an empty string. Other columns are not read; repeated rows give repeated rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            ids = [bpe.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([bpe.decode(x) for x in ids], pa.string())], ["k", "ids", "decoded"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(df[key].alias("k"), df[text].alias("t")).mapInArrow(run, f"k {kind}, ids array<int>, decoded string").withColumnRenamed("k", key)


def digests(df: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Of encode_decode, only digests leave Python: key, n_tokens, ids_sha256 (decimal ids joined by blanks), decoded_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        names = {i: str(i) for i in bpe.strings}.__getitem__
        sha = hashlib.sha256
        for batch in batches:
            n, a, b = [], [], []
            for t in batch.column(1):
                ids = bpe.encode(t.as_py())
                n.append(len(ids))
                a.append(sha(" ".join(map(names, ids)).encode()).hexdigest())
                b.append(sha(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], ["k", "n", "a", "b"])

    kind = df.schema[key].dataType.simpleString()
    out = df.select(df[key].alias("k"), df[text].alias("t")).mapInArrow(run, f"k {kind}, n long, a string, b string")
    return out.toDF(key, "n_tokens", "ids_sha256", "decoded_sha256")
