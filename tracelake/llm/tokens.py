"""Token counts as the tokenizers library gives them for a byte-level BPE vocabulary.

Texts of more than ``CHUNK`` characters are encoded in overlapping chunks with offsets, which are spliced at boundaries that are proven stable:

* A cut between words of the pre-tokenizer that both chunks have, ``MARGIN`` characters or more from the first chunk's end. Its pattern looks ahead, at most past a blank, and never back, so that
  all that follows depends on the text from there on; and the first chunk has seen what could change the cut, special strings included.
* Inside a word that is longer than the overlap: a cut between tokens that both chunks have, after one and the same token, ``MARGIN`` characters or more from the word's start in the second. All
  neighbouring tokens then stand side by side in the encoding of one of the chunks, and a sequence of which every pair is encoded as itself is the encoding of the whole.

If chunks share no such cut, the overlap is doubled; once it reaches the last splice, the first chunk grows instead. In the end that is the whole text, which is exact.

Other texts are encoded by pieces, white space and what follows up to the next: no word of the pre-tokenizer goes on from a character that is not white space to one that is, so each such
place is a stable boundary too, and the counts of pieces seen before are kept (``KEPT`` at most). Texts with white space outside ASCII are encoded whole.

Nothing is shuffled; a task holds one batch of texts, the vocabulary, which the driver reads and broadcasts, and the kept counts.

Defined cases: a null or empty text has no tokens; each row gives one row; strings of special tokens count as those tokens, as is the library's default; all columns are kept, and one named
like the result column is replaced; an empty table gives an empty one.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import read

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024
CHUNK, OVERLAP, MARGIN = 32_768, 256, 32
KEPT = 300_000
#: White space, or what some tables take for it, outside the six ASCII blanks: ranges of code points.
ODD = [(0x1C, 0x1F), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x180E, 0x180E), (0x2000, 0x200F), (0x2028, 0x202F), (0x205F, 0x206F), (0x3000, 0x3000), (0xFEFF, 0xFEFF)]
ODD_BLANK = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in ODD) + "]")
PIECE = re.compile(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")


class _Chunk:
    """The tokens of text[start:end]; places are those of the whole text."""

    def __init__(self, tokenizer: Tokenizer, text: str, start: int, end: int):
        got = tokenizer.encode(text[start:end], add_special_tokens=False)
        self.start, self.end, self.ids = start, end, np.array(got.ids, np.int64)
        self.froms, self.tos = np.array(got.offsets, np.int64).reshape(-1, 2).T + start
        self.words = np.array([-1 if w is None else w for w in got.word_ids], np.int64)

    def cuts(self) -> np.ndarray:
        """The tokens, but the first, that begin where the one before ends. (A token inside a character doesn't.)"""
        return np.flatnonzero(self.froms[1:] == self.tos[:-1]) + 1

    def between(self, start: int, end: int) -> int:
        return int(((self.froms >= start) & (self.froms < end)).sum())


def splice(a: _Chunk, b: _Chunk, after: int) -> int | None:
    """A place after ``after`` from which on b's tokens go on where a's end, as in the encoding of the whole."""
    cut_a, cut_b = a.cuts(), b.cuts()
    cut_a = cut_a[(a.froms[cut_a] > after) & (a.froms[cut_a] <= a.end - MARGIN)]
    at, i, j = np.intersect1d(a.froms[cut_a], b.froms[cut_b], return_indices=True)
    i, j = cut_a[i], cut_b[j]
    words = (a.words[i] != a.words[i - 1]) & (b.words[j] != b.words[j - 1])
    begins = b.froms[np.searchsorted(b.words, b.words[j])]  # of the words in b; their numbers rise
    inside = (a.words[i] == a.words[i - 1]) & (b.words[j] == b.words[j - 1]) & (a.ids[i - 1] == b.ids[j - 1]) & (at - begins >= MARGIN)
    for fit in (words, inside):
        if fit.any():
            return int(at[fit][-1])
    return None


def count_long(tokenizer: Tokenizer, text: str, chunk: int | None = None, overlap: int | None = None) -> int:
    """The tokens of a text of any length, from overlapping chunks."""
    chunk, first = chunk or CHUNK, overlap or OVERLAP
    total, done = 0, 0
    a = _Chunk(tokenizer, text, 0, min(chunk, len(text)))
    while a.end < len(text):
        width, at = min(first, a.end - done), None
        while True:
            start = a.end - width
            b = _Chunk(tokenizer, text, start, min(start + max(chunk, 2 * width), len(text)))
            at = splice(a, b, done)
            if at is not None or start <= done:
                break
            width = min(2 * width, a.end - done)
        if at is None:
            a = _Chunk(tokenizer, text, a.start, min(a.end + max(chunk, a.end - a.start), len(text)))
        else:
            total += a.between(done, at)
            a, done = b, at
    return total + a.between(done, len(text))


class Counter:
    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores belong to Spark's tasks
        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.kept: dict[str, int] = {}

    def _whole(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def count(self, texts: list[str]) -> list[int]:
        out, parts = [0] * len(texts), {}
        for k, t in enumerate(texts):
            if len(t) > CHUNK:
                out[k] = count_long(self.tokenizer, t)
            elif ODD_BLANK.search(t):
                out[k] = self._whole([t])[0]
            else:
                parts[k] = PIECE.findall(t)
        new = list({p for ps in parts.values() for p in ps if p not in self.kept})
        if len(self.kept) + len(new) > KEPT:
            self.kept = {}
            new = list({p for ps in parts.values() for p in ps})
        self.kept.update(zip(new, self._whole(new), strict=True))
        for k, ps in parts.items():
            out[k] = sum(map(self.kept.__getitem__, ps))
        return out


@lru_cache(1)
def _counter(vocabulary: str) -> Counter:
    return Counter(vocabulary)


#: Texts are counted in groups of about so many characters, to bound memory.
GROUP = 1 << 20


def count_tokens(docs: DataFrame, *, text: str = "text", vocabulary: str | None = None, out: str = "n_tokens") -> DataFrame:
    """docs with the number of tokens of each whole text. ``vocabulary``: the path of a byte-level BPE tokenizer of the tokenizers library."""
    with open(vocabulary or public_tokenizers.path(VOCABULARY), encoding="utf-8") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())

    @F.arrow_udf("bigint")
    def scan(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = _counter(sent.value)
        for texts in parts:
            found, group, held = [], [], 0
            for t in texts:
                group.append(t.as_py() or "")
                held += len(group[-1])
                if held >= GROUP:
                    found += counter.count(group)
                    group, held = [], 0
            yield pa.array(found + counter.count(group), pa.int64())

    return docs.withColumn(out, scan(F.col(text)))


def op12_token_counts(spark, sf_dir: str) -> DataFrame:
    found = count_tokens(read(spark, sf_dir, "documents").select("doc_id", "text"))
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return found.select("doc_id", n_bytes.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
