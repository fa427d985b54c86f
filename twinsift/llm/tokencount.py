"""Token counts by a compiled finite-state transducer.

States: N (nothing pending) and P (one space pending, which joins the next word). Symbols are
words and runs of white space, compiled on first sight: each transition from N or P emits a
number of tokens and leads to a state that depends on the symbol alone. White space emits
all but its last character; a final output settles what a text ends with. A text is cut into
chunks; each chunk becomes a state map (end state and count for either start state), and the
maps of a text are composed by a parallel prefix scan (doubling).

The count of a word of plain characters is the sum over its runs; that of any other word (a
script beyond Latin, an emoji) is asked of the library, for that word alone. The string of a
special token settles what is pending, emits one token and leads back to N, so what stands
between such strings is composed on its own. Tables are bounded by entries and characters, and
are emptied when full. Tasks only map rows, so there is no shuffle.

Defined cases: null text counts as empty (0 bytes, 0 tokens); null or repeated doc_id rows are
kept as they are; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from twinsift.llm.frames import map_batches
from twinsift.llm.lexer import BLANK, CONTRACTIONS, NOT_PLAIN, RUNS, SYMBOLS, slices, spelled

CHUNK_CHARS = 32_768
TABLE_ENTRIES = 400_000
TABLE_CHARS = 16_000_000
ROWS = 500
ROWS_CHARS = 8_000_000
NONE, PENDING = 0, 1
CONTRACTED = re.compile(CONTRACTIONS)


class Transducer(dict):
    """Symbol -> its number, with arrays of emitted counts, end states and final outputs.

    The count of a transition is worked out when it is first taken (until then it is -1),
    from counts of the runs inside the word, which the tokenizer's model gives.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        added = self.tokenizer.get_added_tokens_decoder().values()
        if self.tokenizer.normalizer is not None or any(
                t.lstrip or t.rstrip or t.single_word for t in added):
            raise ValueError("the transducer needs a tokenizer that takes texts as they are")
        longest = sorted((t.content for t in added), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, longest)) or r"(?!)")
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.symbols: list[str] = []
        self.chars = 0
        self.runs: dict[str, int] = {}
        self.emits = np.zeros((0, 2), dtype=np.int32)
        self.ends = np.zeros(0, dtype=np.int8)

    def __missing__(self, symbol: str) -> int:
        self[symbol] = number = len(self)
        self.symbols.append(symbol)
        self.chars += 2 * len(symbol)
        return number

    def size(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _run(self, run: str) -> int:
        count = self.runs.get(run)
        if count is None:
            count = self.runs[run] = len(self.model.tokenize(spelled(run)))
        return count

    def _emitted(self, symbol: str, state: int) -> int:
        if BLANK.match(symbol):
            # Followed by a run, white space gives up its last character: to the run if it
            # is a space, else as a piece of its own. A pending space cannot stand before it.
            return (self.size(symbol[:-1]) if len(symbol) > 1 else 0) + (
                0 if symbol[-1] == " " else self.size(symbol[-1]))
        word = symbol[:-1] if symbol[-1] == " " else symbol
        if NOT_PLAIN.search(word):
            return self.size(" " + word if state == PENDING else word)
        runs = RUNS.findall(word)
        flat: list[str] = []
        for i, run in enumerate(runs):
            cut = 0
            if run[0] == "'" and run[-1].isalpha():
                # A contraction, unless a space is pending: then the apostrophe joins it.
                cut = 1 if i == 0 and state == PENDING else CONTRACTED.match(run).end()
            flat += [run[:cut], run[cut:]] if 0 < cut < len(run) else [run]
        if state == PENDING:
            flat[0] = " " + flat[0]
        return sum(map(self._run, flat))

    def learn(self) -> None:
        """End states of the symbols met for the first time."""
        new = self.symbols[len(self.ends):]
        if new:
            self.ends = np.concatenate(
                [self.ends, np.array([s[-1] == " " for s in new], dtype=np.int8)])
            self.emits = np.concatenate(
                [self.emits, np.full((len(new), 2), -1, dtype=np.int32)])

    def annotate(self, numbers: np.ndarray, states: np.ndarray) -> np.ndarray:
        """Counts of these transitions, worked out where they are new."""
        missing = self.emits[numbers, states] < 0
        if missing.any():
            for code in np.unique(numbers[missing].astype(np.int64) * 2 + states[missing]):
                number, state = divmod(int(code), 2)
                self.emits[number, state] = self._emitted(self.symbols[number], state)
        return self.emits[numbers, states]

    def state_maps(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """End states and counts (chunks x start states) and the final output of each chunk."""
        if len(self) > TABLE_ENTRIES or self.chars > TABLE_CHARS:
            self.reset()
        found = [SYMBOLS.findall(c) for c in chunks]
        sizes = np.array([len(f) for f in found])
        numbers = np.fromiter(
            map(self.__getitem__, itertools.chain.from_iterable(found)), np.int32, sizes.sum())
        self.learn()
        n = len(chunks)
        ends = np.tile(np.array([NONE, PENDING]), (n, 1))
        counts, final = np.zeros((n, 2), dtype=np.int64), np.zeros(n, dtype=np.int64)
        full = np.flatnonzero(sizes)
        if not len(full):
            return ends, counts, final
        stop = np.cumsum(sizes)
        first, last = (stop - sizes)[full], stop[full] - 1
        states = np.empty(len(numbers), dtype=np.int8)
        states[1:] = self.ends[numbers[:-1]]
        states[first] = NONE
        emitted = self.annotate(numbers, states).astype(np.int64)
        pending = self.annotate(numbers[first], np.full(len(first), PENDING, dtype=np.int8))
        counts[full, NONE] = np.add.reduceat(emitted, first)
        counts[full, PENDING] = counts[full, NONE] - emitted[first] + pending
        ends[full] = self.ends[numbers[last]][:, None]
        for i, number in zip(full, numbers[last]):
            symbol = self.symbols[number]
            if BLANK.match(symbol):
                final[i] = self.size(symbol) - self._emitted(symbol, NONE)
        return ends, counts, final


def scan_maps(ends: np.ndarray, counts: np.ndarray, text: np.ndarray) -> tuple:
    """Inclusive prefix composition of the state maps of each text, by doubling.

    ends, counts: (chunks, 2); text: number of the text of each chunk, ascending.
    """
    ends, counts = ends.copy(), counts.copy()
    step, n = 1, len(text)
    while step < n:
        same = np.flatnonzero(text[step:] == text[:-step]) + step
        if not len(same):
            break
        middle = ends[same - step]                                   # state between the two
        new_counts = counts[same - step] + np.take_along_axis(counts[same], middle, 1)
        new_ends = np.take_along_axis(ends[same], middle, 1)
        ends[same], counts[same] = new_ends, new_counts
        step *= 2
    return ends, counts


def count_texts(machine: Transducer, texts: list[str], chunk_chars: int = CHUNK_CHARS) -> list:
    """Tokens of each text."""
    totals = np.zeros(len(texts), dtype=np.int64)
    chunks, owner, text_of = [], [], []
    for i, text in enumerate(texts):
        parts = machine.special.split(text)
        totals[i] = len(parts) - 1
        for part in filter(None, parts):
            for chunk in slices(part, chunk_chars):
                chunks.append(chunk)
                owner.append(len(text_of))
            text_of.append(i)
    if owner:
        owner = np.array(owner)
        ends, counts, final = machine.state_maps(chunks)
        _, counts = scan_maps(ends, counts, owner)
        last = np.flatnonzero(np.append(owner[1:] != owner[:-1], True))
        np.add.at(totals, np.array(text_of), counts[last, NONE] + final[last])
    return totals


def portions(texts: list[str]) -> Iterator[list[str]]:
    """The texts in portions of bounded rows and characters; a longer text is one of its own."""
    start, chars = 0, 0
    for i, text in enumerate(texts):
        if i > start and (i - start >= ROWS or chars + len(text) > ROWS_CHARS):
            yield texts[start:i]
            start, chars = i, 0
        chars += len(text)
    if texts:
        yield texts[start:]


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than `limit` tokens) of every text."""
    schema = StructType([
        StructField("doc_id", docs.schema["doc_id"].dataType), StructField("n_bytes", LongType()),
        StructField("n_tokens", LongType()), StructField("over_limit", BooleanType())])

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        machine = Transducer(tokenizer_path)
        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            counts = np.concatenate([count_texts(machine, p) for p in portions(texts)]
                                    or [np.zeros(0, dtype=np.int64)])
            yield {"doc_id": batch["doc_id"], "n_bytes": [len(t.encode()) for t in texts],
                   "n_tokens": counts, "over_limit": counts > limit}

    return map_batches(docs.select("doc_id", "text"), run, schema)
