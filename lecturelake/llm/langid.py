"""Language identification by compression: the language whose dictionary makes a text smallest."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Labelled documents per language and characters of each that a dictionary is made of, and languages at most (more raise).
SAMPLE_DOCUMENTS, SAMPLE_CHARS, LANGUAGES = 120, 1200, 200
#: A text whose two smallest sizes differ by less than this share of the second is rejected.
LEAST_MARGIN = 0.003
#: Texts are compressed in blocks of so many bytes: what a dictionary saves is bounded, so in one piece the margin of a
#: long text would shrink with its length.
BLOCK_BYTES = 8192
#: Texts of fewer bytes whose sizes, in whole bytes, are too close are told by trigrams of the dictionaries.
SHORT_BYTES = 512

LETTER, WORD = regex.compile(r"\p{L}"), regex.compile(r"\p{L}+")
#: Shares that a language's documents are ranked in before they are ranked as a whole.
SHARES = 64


def learn(docs: DataFrame, learnable: Column, text: str = "text", lang: str = "lang", documents: int = SAMPLE_DOCUMENTS, chars: int = SAMPLE_CHARS, languages: int = LANGUAGES) -> dict[str, bytes]:
    """Raw-content dictionaries by language, from a bounded sample of the learnable documents.

    The sample: per language, the `documents` texts of least hash that hold a letter, `chars` characters of each from
    a place that the hash picks. Texts without a language are left out; more than `languages` languages raise. The bounds
    keep the model, and what reaches the driver, the same at any size of the input. Ranks are taken share by share and
    then among the best of all shares, so that no task takes what all tasks of a language have picked.
    """
    rows = docs.filter(learnable & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(lang).cast("string").alias("lang"), F.xxhash64(text).alias("h"), F.col(text).alias("t"))
    at = F.pmod(F.col("h"), F.greatest(F.lit(1), F.length("t") - chars + 1)) + 1
    rows = rows.select("lang", "h", F.substring("t", at.cast("int"), F.lit(chars)).alias("t"))
    some = F.row_number().over(Window.partitionBy("lang", F.pmod("h", F.lit(SHARES))).orderBy("h", "t"))
    rows = rows.withColumn("place", some).filter(F.col("place") <= documents).drop("place")
    first = F.row_number().over(Window.partitionBy("lang").orderBy("h", "t"))
    picked = rows.withColumn("place", first).filter(F.col("place") <= documents).orderBy("lang", "place").limit(languages * documents + 1).collect()
    if len({r.lang for r in picked}) > languages:
        raise ValueError(f"more than {languages} languages")
    out: dict[str, list[str]] = {}
    for r in picked:
        out.setdefault(r.lang, []).append(r.t)
    # each keeps its whole sample: cut to the size of the smallest, a rare or mistyped label would empty all the others
    # lower-cased, as texts are when they are compressed
    return {k: "\n".join(v).lower().encode() for k, v in out.items()}


class Compressors:
    """Sizes of texts under each language's dictionary."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = 6):
        self.langs, self.dictionaries = sorted(dictionaries), dictionaries
        self.trigrams: list[tuple[Counter, Counter]] = []
        self.by = []
        for k in self.langs:
            data = zstandard.ZstdCompressionDict(dictionaries[k], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            self.by.append(zstandard.ZstdCompressor(level=level, dict_data=data, write_content_size=False, write_checksum=False, write_dict_id=False))

    def sizes(self, raw: bytes) -> list[int]:
        """The sums over the blocks of the whole text."""
        blocks = [raw[i : i + BLOCK_BYTES] for i in range(0, len(raw), BLOCK_BYTES)] or [raw]
        return [sum(len(c.compress(b)) for b in blocks) for c in self.by]

    def bits(self, text: str) -> list[float]:
        """Code lengths of a text under each dictionary's character trigrams: sizes that seldom tie."""
        if not self.trigrams:
            for k in self.langs:
                t = _spaced(self.dictionaries[k].decode(errors="ignore"))
                self.trigrams.append((Counter(zip(t, t[1:], t[2:], strict=False)), Counter(zip(t, t[1:], strict=False))))
        t = _spaced(text)
        out = []
        for three, two in self.trigrams:
            out.append(-sum(math.log2((three[x] + 0.1) / (two[x[:2]] + 10)) for x in zip(t, t[1:], t[2:], strict=False)))
        return out

    def judge(self, text: str, least_margin: float) -> tuple[int, float]:
        """The place in langs of a text's language, and its margin to the second-best as a share of the second's size."""
        raw = text.lower().encode()
        best, margin = _least(self.sizes(raw))
        return _least(self.bits(text)) if margin < least_margin and len(raw) < SHORT_BYTES else (best, margin)


def _spaced(text: str) -> str:
    """Lower-case words of letters, a space around each."""
    return f" {' '.join(WORD.findall(text.lower()))} "


def _least(sizes: list[float]) -> tuple[int, float]:
    best = int(np.argmin(sizes))
    rest = min(sizes[:best] + sizes[best + 1 :], default=None)
    return best, 1.0 if rest is None else float((rest - sizes[best]) / rest)


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", least_margin: float = LEAST_MARGIN) -> DataFrame:
    """docs with lang_pred, score and rejected added (columns of these names are replaced).

    Every whole text is compressed once per language, block by block; the smallest sum wins, ties going to the language first in the
    alphabet. score is 0.5 to 1 and rises with the margin to the second-best size. A text that is null or has no
    letter gets `und`, score 0, and is rejected; so is a text whose margin is under least_margin. With a single
    language there is no margin and nothing else is rejected; without any, all is `und`. Repeated rows stay.
    """
    keep = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    docs = docs.select(*keep)
    at = keep.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = Compressors(dictionaries)
        for batch in batches:
            pred, score, out = [], [], []
            for t in batch.column(at):
                t = t.as_py()
                if not by.langs or t is None or not LETTER.search(t):
                    pred.append("und")
                    score.append(0.0)
                    out.append(True)
                    continue
                best, margin = by.judge(t, least_margin)
                pred.append(by.langs[best])
                score.append(float(1 - 0.5 * np.exp(-40 * margin)))
                out.append(bool(margin < least_margin))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred), pa.array(score, pa.float64()), pa.array(out)], [*keep, "lang_pred", "score", "rejected"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, lang_pred string, score double, rejected boolean")
