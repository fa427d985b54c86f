"""Hierarchical packing of documents into windows of several context sizes.

Each task tokenizes its documents, routes them to the smallest window that holds them (longer
ones are first cut into full windows), opens a window for the longest document left, fills
its gap with the longest shorter documents that fit, and cuts one where none fits. Windows
of a size are dealt into step groups of equal token numbers and like attention cost. There
is no shuffle: a task packs what it reads, so a lost task is simply run again.

Defined cases: null or empty text is a document of the end id alone; doc_id may be null or
repeated (every row is a document of its own); an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.types import (ArrayType, IntegerType, LongType, StructField, StructType)

from twinsift.llm.frames import map_batches
from twinsift.llm.lexer import WORD_PIECES, is_plain, slices, spelled

TIERS = (2048, 1024, 512, 256)
STEP_TOKENS = 65_536
END_ID = 1
BLOCK_TOKENS = 2_000_000
SLICE_CHARS = 1_000_000
TABLE_ENTRIES = 400_000
ENCODE_ROWS = 500
SEQUENCES_PER_TASK = 1 << 33


class WordTable(dict):
    """Lower-cased word -> number of its entry; an entry is a stretch of `ids`.

    A word that is new is cut into pieces, whose ids come from the tokenizer's model. Both
    tables are emptied when they are full.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.specials = tuple(
            t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.pieces: dict[str, list[int]] = {}
        self.sizes, self.fresh = [], []
        self.first = np.zeros(1, dtype=np.int64)   # entry i is ids[first[i]:first[i + 1]]
        self.ids = np.zeros(0, dtype=np.uint32)

    def __missing__(self, word: str) -> int:
        before = len(self.fresh)
        for piece in WORD_PIECES.findall(word):
            ids = self.pieces.get(piece)
            if ids is None:
                ids = [t.id for t in self.model.tokenize(spelled(piece))]
                self.pieces[piece] = ids
            self.fresh += ids
        self.sizes.append(len(self.fresh) - before)
        self[word] = number = len(self)
        return number

    def settle(self) -> None:
        if self.sizes:
            self.first = np.concatenate(
                [self.first, self.first[-1] + np.cumsum(self.sizes, dtype=np.int64)])
            self.ids = np.concatenate([self.ids, np.array(self.fresh, dtype=np.uint32)])
            self.sizes, self.fresh = [], []

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts, as the tokenizer gives them, without added tokens."""
        if len(self) > TABLE_ENTRIES:
            self.reset()
        found: list = []
        for text in texts:
            if not is_plain(text, self.specials):
                ids = self.tokenizer.encode(text, add_special_tokens=False).ids
                found.append(np.array(ids, dtype=np.uint32))
                continue
            parts = []
            for part in slices(text, SLICE_CHARS):
                words = part.lower().split()
                parts.append(np.fromiter(map(self.__getitem__, words), np.int32, len(words)))
            found.append(parts)
        self.settle()
        return [self._ids(f) if isinstance(f, list) else f for f in found]

    def _ids(self, parts: list[np.ndarray]) -> np.ndarray:
        entries = parts[0] if len(parts) == 1 else np.concatenate(parts)
        start = self.first[entries]
        size = self.first[entries + 1] - start
        stop = np.cumsum(size)
        return self.ids[np.arange(stop[-1] if len(stop) else 0)
                        + np.repeat(start - stop + size, size)]


def tier_of(length: int, tiers: tuple[int, ...]) -> int:
    """The smallest window that holds the length; below the smallest one, that."""
    return next((t for t in reversed(tiers) if t >= length), tiers[0])


def fill_windows(pool: list[tuple], tiers: tuple[int, ...]) -> tuple[list[list[tuple]], list]:
    """Windows from pieces (length, document, start), and the pieces of the last open window.

    The pool is sorted by length; every window but the returned rest is full.
    """
    windows: list[list[tuple]] = []
    while pool:
        piece = pool.pop()
        size = tier_of(piece[0], tiers)
        window, gap = [piece], size - piece[0]
        while gap and pool:
            at = bisect_right(pool, (gap, 1 << 62, 0)) - 1
            if at >= 0:
                piece = pool.pop(at)
            else:  # every piece left is longer than the gap: cut the shortest
                length, document, start = pool.pop(0)
                piece = (gap, document, start)
                insort(pool, (length - gap, document, start + gap))
            window.append(piece)
            gap -= piece[0]
        if gap:
            return windows, window
        windows.append(window)
    return windows, []


def binary_windows(pieces: list[tuple]) -> list[list[tuple]]:
    """The last pieces of a task, cut into windows whose sizes are powers of two."""
    windows, pieces = [], list(reversed(pieces))
    left = sum(p[0] for p in pieces)
    while left:
        gap = size = 1 << (left.bit_length() - 1)
        window = []
        while gap:
            length, document, start = pieces.pop()
            took = min(gap, length)
            window.append((took, document, start))
            if length > took:
                pieces.append((length - took, document, start + took))
            gap -= took
        windows.append(window)
        left -= size
    return windows


def step_groups(windows: list[list[tuple]], step_tokens: int) -> list[int]:
    """A group number for each window: groups of one size hold like numbers and like cost."""
    groups, first = [0] * len(windows), 0
    by_size: dict[int, list[int]] = {}
    for i, w in enumerate(windows):
        by_size.setdefault(sum(p[0] for p in w), []).append(i)
    for size in sorted(by_size, reverse=True):
        members = sorted(by_size[size], key=lambda i: (-sum(p[0] ** 2 for p in windows[i]), i))
        count = -(-len(members) * size // step_tokens)
        for rank, i in enumerate(members):
            lap, seat = divmod(rank, count)
            groups[i] = first + (seat if lap % 2 == 0 else count - 1 - seat)
        first += count
    return groups


def pack(docs: DataFrame, tokenizer_path: str, tiers: tuple[int, ...] = TIERS,
         step_tokens: int = STEP_TOKENS, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their places in sequences.

    One row per piece: doc_id, start and length in the document's ids (its text's ids and the
    end id), ids_crc32 over them as little-endian unsigned 32-bit, doc_tokens, sequence_id,
    offset in the sequence, tier (the sequence's length) and step_group; `with_ids` adds the
    ids themselves.
    """
    schema = StructType([StructField("doc_id", docs.schema["doc_id"].dataType)] + [
        StructField(n, LongType()) for n in (
            "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier",
            "step_group")])
    if with_ids:
        schema = schema.add("ids", ArrayType(IntegerType()))
    names = schema.names
    longest = tiers[0]

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        task = TaskContext.get().partitionId() * SEQUENCES_PER_TASK
        encoder = WordTable(tokenizer_path)
        documents: dict[int, tuple] = {}     # number -> (doc_id, ids)
        pool: list[tuple] = []
        counter, tokens, sequences, groups = 0, 0, 0, 0

        def emit(windows):
            nonlocal sequences, groups
            out = {n: [] for n in names}
            numbers = step_groups(windows, step_tokens)
            for window, group in zip(windows, numbers):
                offset, size = 0, sum(p[0] for p in window)
                for length, document, start in window:
                    doc_id, ids = documents[document]
                    piece = ids[start:start + length]
                    row = (doc_id, start, length, zlib.crc32(piece.astype("<u4").tobytes()),
                           len(ids), task + sequences, offset, size, task + groups + group)
                    for n, v in zip(names, row):
                        out[n].append(v)
                    if with_ids:
                        out["ids"].append(piece.astype(np.int32))
                    offset += length
                sequences += 1
            groups += max(numbers, default=-1) + 1
            return out

        def block():
            nonlocal pool, tokens, documents
            windows, pieces = [], []
            for length, document, start in pool:
                while length > longest:
                    windows.append([(longest, document, start)])
                    length, start = length - longest, start + longest
                pieces.append((length, document, start))
            more, rest = fill_windows(sorted(pieces), tiers)
            out = emit(windows + more)
            documents = {p[1]: documents[p[1]] for p in rest}
            pool, tokens = rest, sum(p[0] for p in rest)
            return out

        for batch in batches:
            for at in range(0, len(batch["text"]), ENCODE_ROWS):
                texts = [t or "" for t in batch["text"][at:at + ENCODE_ROWS]]
                for doc_id, ids in zip(batch["doc_id"][at:at + ENCODE_ROWS],
                                       encoder.encode_all(texts)):
                    ids = np.append(ids, np.uint32(END_ID))
                    documents[counter] = (doc_id, ids)
                    pool.append((len(ids), counter, 0))
                    counter, tokens = counter + 1, tokens + len(ids)
                if tokens >= BLOCK_TOKENS:
                    yield block()
        yield block()
        yield emit(binary_windows(pool))

    return map_batches(docs.select("doc_id", "text"), run, schema)
