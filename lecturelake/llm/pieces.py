"""SentencePiece BPE encoding and decoding with a prefix table: the unique last token of every prefix of a text.

A sequence of tokens is what merging gives if and only if each two neighbours are what merging gives for their joint
string. So the last token of a prefix is the one token that ends there (an Aho-Corasick automaton lists them, longest
first) and is compatible with the last token of the prefix before it; ids are then read from the table backwards.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import chain, groupby, pairwise

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2

SPACE = "▁"
#: Ways to cut a text where no token can reach across, finest first: words, single digits, other signs, each with the blanks
#: before it; words with the blanks before them; not at all. A vocabulary takes the first that cuts none of its tokens.
CUTS = tuple(re.compile(p, re.S) for p in (rf"{SPACE}*(?:[^\W\d_²]+|\d|(?:[^\w{SPACE}]|[_²])+)|{SPACE}+", rf"{SPACE}*[^{SPACE}]+|{SPACE}+", ".+"))
#: Kinds of pieces in the vocabulary file.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
START, UNK = -1, 0
#: Entries that a process remembers at most, and the length up to which a word is remembered. Only speed depends on them.
CACHE_WORDS, CACHE_PAIRS, CACHE_CHARS = 1_500_000, 4_000_000, 48


class Remembered(dict):
    """What a function of a string gives, for short strings met before."""

    def __init__(self, function: Callable[[str], tuple[int, ...]]):
        self.function = function

    def __missing__(self, key: str) -> tuple[int, ...]:
        value = self.function(key)
        if len(key) <= CACHE_CHARS:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[key] = value
        return value


class Pieces:
    """Encoder and decoder for a sentencepiece model of type BPE with byte fallback and no normalization but for blanks."""

    def __init__(self, path: str):
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix:
            raise ValueError("a model of type BPE with byte fallback, a dummy prefix and no normalization is needed")
        if {p.type for p in model.pieces} - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("user-defined and unused pieces are not supported")
        self.pieces = [p.piece for p in model.pieces]
        places = {s: i for i, s in enumerate(sorted({p.score for p in model.pieces if p.type == NORMAL}, reverse=True))}
        #: string -> place of its score; pieces of equal score merge leftmost first
        self.ranks = {p.piece: places[p.score] for p in model.pieces if p.type == NORMAL}
        if any(c not in self.ranks for p in self.ranks for c in p):
            raise ValueError("every character of a piece must be a piece")
        self.bytes = {}
        self.surfaces = [p.piece.replace(SPACE, " ").encode() for p in model.pieces]
        self.automaton = ahocorasick.Automaton()
        for i, p in enumerate(model.pieces):
            if p.type == NORMAL:
                self.automaton.add_word(p.piece, i)
            elif p.type == BYTE:
                b = int(p.piece[3:-1], 16)
                self.bytes[b], self.surfaces[i] = i, bytes([b])
            else:
                self.surfaces[i] = (model.trainer_spec.unk_surface if p.type == UNKNOWN else "").encode()
        self.automaton.make_automaton()
        self.byte_ids = frozenset(self.bytes.values())
        self.lengths = list(map(len, self.pieces))
        self.lengths[UNK] = 1
        self.cut = next(c for c in CUTS if all(c.fullmatch(p) and len(c.findall(p)) == 1 for p in self.ranks)).findall
        self.words_apart = self.cut != CUTS[-1].findall
        self.histories: dict[int, tuple[list, list]] = {}
        self.pairs: dict[int, bool] = {}
        self.parts, self.words = Remembered(self.ids), Remembered(self.word)

    def history(self, token: int) -> tuple[list, list]:
        """What merging a token's own characters does at its two ends: (rank, left end after), (rank, right end after).

        An end waits for the merges before, so its rank is the highest since it last changed. Of two neighbours merged
        side by side, the one whose next rank is lower changes first. A token that merging doesn't give has no right end.
        """
        if (known := self.histories.get(token)) is None:
            symbols, rank = list(self.pieces[token]), self.ranks.get
            left, right, low, high = [(-1, symbols[0])], [(-1, symbols[-1])], -1, -1
            while found := [(r, i) for i, (a, b) in enumerate(pairwise(symbols)) if (r := rank(a + b)) is not None]:
                r, i = min(found)
                low, high = max(low, r), max(high, r)
                symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
                if i == 0:
                    left.append((low, symbols[0]))
                    low = -1
                if i == len(symbols) - 1:
                    right.append((high, symbols[-1]))
                    high = -1
            known = self.histories[token] = (left, right if len(symbols) == 1 else [])
        return known

    def keeps(self, a: int, b: int) -> bool:
        """Whether no merge reaches across from a into b before both are whole; of equal ranks the leftmost comes first."""
        right, left = self.history(a)[1], self.history(b)[0]
        if not right or not self.history(b)[1]:
            return False
        rank, never, i, j = self.ranks.get, len(self.ranks), 0, 0
        while True:
            next_a = right[i + 1][0] if i + 1 < len(right) else never
            next_b = left[j + 1][0] if j + 1 < len(left) else never
            across = rank(right[i][1] + left[j][1], never)
            if across < next_a and across <= next_b and across < never:
                return False
            if next_a == never and next_b == never:
                return True
            if next_a <= next_b:
                i += 1
            else:
                j += 1

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging keeps token b next to token a; START and UNK (which nothing merges with) ask for b alone."""
        key = (a + 1) << 32 | b
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) >= CACHE_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = bool(self.history(b)[1]) if a in (START, UNK) else self.keeps(a, b)
        return known

    def table(self, text: str) -> list[int]:
        """For every length of prefix, the last token of the prefix's encoding (UNK: a character outside the vocabulary)."""
        last = [UNK] * (len(text) + 1)
        last[0] = START
        lengths, pairs, done = self.lengths, self.pairs.get, -1
        for end, token in self.automaton.iter(text):
            if end != done:
                before = last[end + 1 - lengths[token]]
                ok = pairs((before + 1) << 32 | token)
                if ok or ok is None and self.compatible(before, token):
                    last[end + 1] = token
                    done = end
        return last

    def ids(self, text: str) -> tuple[int, ...]:
        """Ids of a stretch whose ends no token crosses, read from its table backwards."""
        last, out, i = self.table(text), [], len(text)
        while i:
            token = last[i]
            if token == UNK:
                if text[i - 1] in self.ranks:
                    raise ValueError("no token ends a prefix: the vocabulary is not one of merges")
                out += [self.bytes[b] for b in reversed(text[i - 1].encode())]
            else:
                out.append(token)
            i -= self.lengths[token]
        return tuple(reversed(out))

    def word(self, word: str) -> tuple[int, ...]:
        """Ids of a blank and what follows up to the next one."""
        return tuple(chain.from_iterable(map(self.parts.__getitem__, self.cut(SPACE + word))))

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text (null: empty); words and parts of words met before come from caches."""
        if not text:
            return []
        if self.words_apart and "  " not in text and SPACE not in text and text[0] != " ":
            return [*chain.from_iterable(map(self.words.__getitem__, text.split(" ")))]
        return [*chain.from_iterable(map(self.parts.__getitem__, self.cut(SPACE + text.replace(" ", SPACE))))]

    def decode(self, ids: list[int]) -> str:
        """The tokens' strings without the blank that every text gets in front; bytes that are no UTF-8 are U+FFFD each."""
        surfaces = list(map(self.surfaces.__getitem__, ids))
        first = next((i for i, s in enumerate(surfaces) if s), None)
        if first is not None and self.pieces[ids[first]].startswith(SPACE):
            surfaces[first] = surfaces[first][1:]
        try:
            return b"".join(surfaces).decode()
        except UnicodeDecodeError:
            runs = groupby(zip(ids, surfaces, strict=True), lambda x: x[0] in self.byte_ids)
            return "".join((bytes_text if is_bytes else bytes.decode)(b"".join(s for _, s in run)) for is_bytes, run in runs)


def bytes_text(raw: bytes) -> str:
    """UTF-8 read character by character; a byte that begins none is U+FFFD."""
    out, i = [], 0
    while i < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[i : i + n].decode())
                i += n
                break
            except UnicodeDecodeError:
                pass
        else:
            out.append("\ufffd")
            i += 1
    return "".join(out)


_loaded: dict[str, Pieces] = {}


def encoder(path: str) -> Pieces:
    """The encoder for a file, once for each Python process."""
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def encode_decode(df: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Encode every whole text and decode it again: key, ids array<int>, decoded string.

    A null or empty text gives no ids and an empty string. Other columns are not read; repeated rows give repeated rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(path)
        for batch in batches:
            ids = [model.encode(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(list(map(model.decode, ids)), pa.string())], ["k", "ids", "decoded"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(df[key].alias("k"), df[text].alias("t")).mapInArrow(run, f"k {kind}, ids array<int>, decoded string").withColumnRenamed("k", key)


def digests(df: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Of encode_decode, only digests leave Python: key, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(path)
        names = list(map(str, range(len(model.pieces)))).__getitem__
        for batch in batches:
            n, a, b = [], [], []
            for t in batch.column(1):
                ids = model.encode(t.as_py())
                n.append(len(ids))
                a.append(hashlib.sha256(",".join(map(names, ids)).encode()).hexdigest())
                b.append(hashlib.sha256(model.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["k", "n", "a", "b"])

    kind = df.schema[key].dataType.simpleString()
    out = df.select(df[key].alias("k"), df[text].alias("t")).mapInArrow(run, f"k {kind}, n long, a string, b string")
    return out.toDF(key, "n_tokens", "ids_sha256", "decoded_sha256")
