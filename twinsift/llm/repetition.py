"""Repetition inside documents by suffix arrays over words.

The words of several texts are numbered and laid out one after the other, separated by
numbers that occur once. Prefix doubling sorts all suffixes; the ranks of every doubling step
give the longest common prefix of neighbours in the suffix array. The longer of the two
neighbouring prefixes is the longest substring that starts at a position and occurs again
in the same text (words are numbered per text, so nothing is shared between texts). Spans
of repeats of at least `MIN_REPEAT` words are united into a covered fraction.

Tasks only map rows. Memory is bound by `BLOCK_WORDS` words or one text.

Defined cases: null or empty text has no words, so it fails the base rules; null or repeated
doc_id rows are kept as they are; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from twinsift.llm.frames import map_batches

SYMBOL_CHARS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_WINDOW_PERCENT = 20
MIN_REPEAT = 10           # words of a repeat that counts for the covered fraction
MAX_COVERED = 0.15        # of the words
MAX_REPEAT = 50           # words of the longest repeat
BLOCK_WORDS = 300_000


def suffix_repeats(words: np.ndarray) -> np.ndarray:
    """For each position, the length of the longest substring from there that occurs twice.

    `words` holds numbers; separators must be numbers that occur once.
    """
    n = len(words)
    if n < 2:
        return np.zeros(n, dtype=np.int64)
    _, rank = np.unique(words, return_inverse=True)
    levels = [rank]
    step = 1
    open_ = np.flatnonzero(np.bincount(rank)[rank] > 1)   # suffixes not told apart yet
    while len(open_):
        behind = np.full(len(open_), -1, dtype=np.int64)
        near = open_ + step < n
        behind[near] = rank[open_[near] + step]
        order = np.lexsort((behind, rank[open_]))
        at, first, second = open_[order], rank[open_[order]], behind[order]
        new_first = np.append(True, first[1:] != first[:-1])
        starts = new_first | np.append(True, second[1:] != second[:-1])
        place = np.arange(len(at))
        # A rank is the number of smaller suffixes; inside a group of equals it moves up.
        group_start = np.maximum.accumulate(np.where(new_first, place, 0))
        run_start = np.maximum.accumulate(np.where(starts, place, 0))
        smaller = levels[-1].copy() if step > 1 else _as_counts(rank)
        if step == 1:
            first = smaller[at]
        smaller[at] = first + (run_start - group_start)
        rank = smaller
        levels.append(rank)
        step *= 2
        sizes = np.diff(np.append(np.flatnonzero(starts), len(at)))
        open_ = np.sort(at[np.repeat(sizes, sizes) > 1])
    suffix = np.argsort(rank, kind="stable")
    a, b = suffix[:-1].copy(), suffix[1:].copy()
    common = np.zeros(n - 1, dtype=np.int64)
    live = np.arange(n - 1)
    for k in range(len(levels) - 1, -1, -1):
        inside = (a < n) & (b < n)
        same = inside & (levels[k][np.minimum(a, n - 1)] == levels[k][np.minimum(b, n - 1)])
        common[live[same]] += 1 << k
        a[same] += 1 << k
        b[same] += 1 << k
    longest = np.zeros(n, dtype=np.int64)
    longest[suffix[1:]] = common
    longest[suffix[:-1]] = np.maximum(longest[suffix[:-1]], common)
    return longest


def _as_counts(rank: np.ndarray) -> np.ndarray:
    """Dense ranks as the number of smaller entries."""
    sizes = np.bincount(rank)
    return (np.cumsum(sizes) - sizes)[rank]


def covered(lengths: np.ndarray, least: int, starts: np.ndarray) -> np.ndarray:
    """Words of each text inside the union of its repeats of at least `least` words.

    `starts` are the first positions of the texts in `lengths`.
    """
    place = np.arange(len(lengths))
    stops = np.where(lengths >= least, place + lengths, 0)
    inside = np.maximum.accumulate(stops) > place
    sums = np.append(0, np.cumsum(inside))
    ends = np.append(starts[1:], len(lengths))
    return sums[ends] - sums[starts]


def repeated_words(word_lists: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: words in repeats of WINDOW and of MIN_REPEAT words, and the longest repeat."""
    sizes = np.array([len(w) + 1 for w in word_lists], dtype=np.int64)
    numbers = np.empty(int(sizes.sum()), dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    base = 0
    for words, start in zip(word_lists, starts):
        table: dict[bytes, int] = {}
        count = itertools.count(base)
        numbers[start:start + len(words)] = [
            table[w] if w in table else table.setdefault(w, next(count)) for w in words]
        base += len(table)
        numbers[start + len(words)] = base      # the separator behind the text
        base += 1
    lengths = suffix_repeats(numbers)
    longest = np.maximum.reduceat(lengths, starts) if len(starts) else lengths
    return covered(lengths, WINDOW, starts), covered(lengths, MIN_REPEAT, starts), longest


def base_counts(text: str) -> tuple[list[bytes], int, int, int]:
    """Words, their code points, symbols and repeated lines of a text."""
    words = text.encode().split()
    blanks = sum(map(text.count, " \t\n\x0b\x0c\r"))
    symbols = sum(map(text.count, SYMBOL_CHARS))
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return words, len(text) - blanks, symbols, len(lines) - len(set(lines))


def repetition_rules(docs: DataFrame, max_covered: float = MAX_COVERED,
                     max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Base counts, base verdict, covered fraction, longest repeat and verdict of every text."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    schema = StructType(
        [StructField("doc_id", docs.schema["doc_id"].dataType)]
        + [StructField(n, LongType()) for n in names]
        + [StructField("base_failed", BooleanType()), StructField("covered_fraction", DoubleType()),
           StructField("longest_repeat", LongType()), StructField("kept", BooleanType())])

    def judge(ids: list, counted: list[tuple]) -> dict:
        in_windows, in_repeats, longest = repeated_words([c[0] for c in counted])
        n = np.array([len(c[0]) for c in counted], dtype=np.int64)
        failed = (n < MIN_WORDS) | (100 * in_windows > MAX_WINDOW_PERCENT * n)
        fraction = in_repeats / np.maximum(n, 1)
        return {"doc_id": ids, "n_words": n, "word_chars": [c[1] for c in counted],
                "n_symbols": [c[2] for c in counted], "n_dup_lines": [c[3] for c in counted],
                "n_repeat_words": in_windows, "base_failed": failed, "covered_fraction": fraction,
                "longest_repeat": longest,
                "kept": ~failed & (fraction <= max_covered) & (longest <= max_repeat)}

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        for batch in batches:
            ids, counted, words = [], [], 0
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids.append(doc_id)
                counted.append(base_counts(text or ""))
                words += len(counted[-1][0])
                if words >= BLOCK_WORDS:
                    yield judge(ids, counted)
                    ids, counted, words = [], [], 0
            if ids:
                yield judge(ids, counted)

    return map_batches(docs.select("doc_id", "text"), run, schema)
