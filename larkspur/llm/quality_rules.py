"""Quality rules over words, lines and the fertility of a public tokenizer.

A text that a vocabulary cuts into many short tokens, into byte fallbacks, or into the same few tokens over and over
is unlike the prose it was made for. What is usual differs between scripts, so each has its own bands.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import words

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\v\f\r"
#: Words that a worker remembers, as bytes and as numbers; beyond them it forgets all.
CACHE_WORDS = 600_000
#: Code points from the first of each row on belong to its script.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "other"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0700, "other"), (0x0900, "devanagari"), (0x0980, "other"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"),
    (0x1F00, "greek"), (0x2000, "latin"), (0x2E80, "han"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0x10000, "other"), (0x20000, "han"), (0x30000, "other"),
)


class Band(NamedTuple):
    """What a script's texts have: characters per token from least to most, a share of byte fallbacks of at most fallback, a token entropy of at least entropy bits."""

    least: float
    most: float
    fallback: float
    entropy: float


BANDS = {
    "latin": Band(1.7, 8.0, 0.10, 5.2),
    "cyrillic": Band(1.2, 8.0, 0.25, 5.2),
    "greek": Band(0.8, 6.0, 0.60, 5.0),
    "hebrew": Band(0.6, 6.0, 0.70, 5.0),
    "arabic": Band(0.6, 6.0, 0.70, 5.0),
    "devanagari": Band(0.4, 6.0, 0.80, 4.5),
    "hangul": Band(0.3, 4.0, 0.95, 4.5),
    "han": Band(0.3, 4.0, 0.95, 4.5),
    "other": Band(0.2, 8.0, 1.00, 4.0),
}
COLUMNS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, script string, chars_per_token double, fallback_share double, token_entropy double"
_KINDS = (pa.int64(),) * 6 + (pa.bool_(),) * 2 + (pa.string(),) + (pa.float64(),) * 3


def script(text: str) -> str:
    """The script of most characters other than ASCII, or latin where those are under a third of what isn't blank or ASCII punctuation."""
    if text.isascii():
        return "latin"
    points = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    far = points[points > 127]
    letters = np.count_nonzero((points | 32) - 97 < 26) + len(far)
    edges = np.array([a for a, _ in SCRIPTS])
    tally: dict[str, int] = {}
    for k, n in enumerate(np.bincount(np.searchsorted(edges, far, "right") - 1, minlength=len(SCRIPTS)).tolist()):
        tally[SCRIPTS[k][1]] = tally.get(SCRIPTS[k][1], 0) + n
    most = max(tally, key=lambda s: tally[s])
    return most if 3 * tally[most] >= letters else "latin"


def repeated(numbers: np.ndarray, width: int = 3) -> int:
    """How many words stand in windows of width words that are found twice or more."""
    n = len(numbers)
    if n <= width:
        return 0
    key = numbers[: n - width + 1]
    for k in range(1, width):
        _, key = np.unique(key * (int(numbers.max()) + 1) + numbers[k : n - width + 1 + k], return_inverse=True)
    often = np.bincount(key)[key] > 1
    covered = np.zeros(n, bool)
    for k in range(width):
        covered[k : n - width + 1 + k] |= often
    return int(covered.sum())


class Vocabulary:
    """Tokens of words, each looked up once: a worker keeps the words it has met, and the tokens of all in one array."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([self.library.IsByte(i) for i in range(self.library.GetPieceSize())])
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.begins, self.pool = np.zeros(1, np.int64), np.empty(0, np.int32)

    def numbers(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """The number of each word of each text."""
        if len(self.known) > CACHE_WORDS:
            self.clear()
        new = list(set().union(*texts).difference(self.known))
        if new:
            tokens = self.library.encode([w.decode("utf-8", "replace") for w in new], num_threads=1)
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            self.begins = np.concatenate([self.begins, self.begins[-1] + np.cumsum([len(x) for x in tokens])])
            self.pool = np.concatenate([self.pool, np.array([i for x in tokens for i in x], np.int32)])
        return [np.fromiter(map(self.known.__getitem__, t), np.int64, len(t)) for t in texts]

    def measures(self, numbers: np.ndarray) -> tuple[int, int, float]:
        """Tokens, byte fallbacks, and the entropy of the tokens in bits."""
        which, times = np.unique(numbers, return_counts=True)
        begins, sizes = self.begins[which], self.begins[which + 1] - self.begins[which]
        places = np.repeat(begins - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        ids, weight = self.pool[places], np.repeat(times, sizes)
        kinds, inverse = np.unique(ids, return_inverse=True)
        n = np.bincount(inverse, weight)
        total = n.sum()
        share = n[n > 0] / max(total, 1)
        return int(total), int(n[self.is_byte[kinds]].sum()), float(-(share * np.log2(share)).sum())


@lru_cache(maxsize=1)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def judge(docs: DataFrame, model: str, bands: dict[str, Band] | None = None) -> DataFrame:
    """The COLUMNS for each row of docs (doc_id, text; other columns are left out).

    base_failed: under 50 words, or more than half of the words stand in repeated windows of three. kept: neither
    that nor outside the bands of the text's script. A null or empty text has no words, zero for every measure, and isn't kept.
    Rows that repeat are judged each for itself; an empty table gives no rows.
    """
    bands = bands or BANDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(model)
        for batch in (b.slice(i, 500) for b in batches for i in range(0, len(b), 500)):
            texts, rows = [t or "" for t in batch.column(1).to_pylist()], []
            found = [words(t) for t in texts]
            for text, numbers in zip(texts, known.numbers(found), strict=True):
                n, chars = len(numbers), len(text) - sum(map(text.count, BLANKS))
                lines = [x for x in text.split("\n") if x.strip(BLANKS)]
                again, kind = repeated(numbers), script(text)
                failed = n < 50 or 100 * again > 50 * n
                tokens, fallbacks, entropy = known.measures(numbers) if n else (0, 0, 0.0)
                per, share, band = chars / max(tokens, 1), fallbacks / max(tokens, 1), bands[kind]
                kept = not failed and band.least <= per <= band.most and share <= band.fallback and entropy >= band.entropy
                rows.append((n, chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), again, failed, kept, kind, per, share, entropy))
            columns = zip(*rows, strict=True) if rows else [[]] * 11
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, _KINDS[1:], strict=True))], names=[c.split()[0] for c in COLUMNS.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, COLUMNS)
