"""Packing and token counts against the tokenizer library."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from twinsift.llm import packing, tokencount

ODD = ["", " ", "  ", "\n\n ", "a  <|endoftext|> b", "x<|startoftext|>y", "漢字 test", "a\x1cb",
       "it's 's 'st 'll'll", "ΑΣ Σ", "é é", "İstanbul ÀÉ ½²x", "x" * 3000, "!" * 500,
       " \n" * 300, "don't ca'n't ''s"]


def random_texts(count: int) -> list[str]:
    rng = random.Random(1)
    letters = " \n\t'’–abcdeSTLLvemrdÉé²½ß019.,!#×÷\x85\xa0\x00 İʼŉ  '"
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(count)]


@pytest.fixture(scope="module")
def words():
    return packing.WordTable(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def machine():
    return tokencount.Transducer(public_tokenizers.path("byte_bpe_50k.json"))


def test_word_ids_equal_the_library(words):
    for text in random_texts(3000) + ODD:
        want = words.tokenizer.encode(text, add_special_tokens=False).ids
        assert words.encode_all([text])[0].tolist() == want, repr(text)


@pytest.mark.parametrize("chunk", [1, 5, 32_768])
def test_counts_equal_the_library(machine, chunk):
    texts = random_texts(2000) + ODD
    want = [machine.size(t) for t in texts]
    assert tokencount.count_texts(machine, texts, chunk).tolist() == want


@pytest.mark.parametrize("chunk", [1, 7, 32_768])
def test_odd_words_and_special_strings_stay_in_the_transducer(machine, chunk):
    rng = random.Random(5)
    kinds = [" ", "  ", "\n", "\u3000", "\u2003", "\u2028", "\u1680", "\x1c", "\u200b", "\u180e", "漢字", "かな",
             "λόγος", "мир", "שלום", "👩\u200d💻", "e\u0301", "\u0301", "١٢", "Ⅷ", "'s", "'ll", "ab", "7", "!", "_",
             "<|endoftext|>", "<|endoftext", "|>"]
    texts = ["".join(rng.choice(kinds) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    want = [len(machine.tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]
    asked, whole = [], machine.size
    machine.reset()
    machine.size = lambda part: asked.append(part) or whole(part)
    try:
        assert tokencount.count_texts(machine, texts, chunk).tolist() == want
    finally:
        del machine.size
    assert not any("<|endoftext|>" in part for part in asked)
    assert all(len(part.split()) <= 1 for part in asked if not part.isspace() and "\x1c" not in part)


def test_portions_bound_rows_and_characters(monkeypatch):
    monkeypatch.setattr(tokencount, "ROWS", 3)
    monkeypatch.setattr(tokencount, "ROWS_CHARS", 10)
    texts = ["a" * n for n in (1, 2, 3, 4, 25, 0, 0, 9, 9)]
    cut = list(tokencount.portions(texts))
    assert [t for p in cut for t in p] == texts
    assert all(len(p) == 1 or len(p) <= 3 and sum(map(len, p)) <= 10 for p in cut)
    assert list(tokencount.portions([])) == []


def test_full_tables_are_emptied(monkeypatch, words, machine):
    monkeypatch.setattr(packing, "TABLE_ENTRIES", 10)
    monkeypatch.setattr(tokencount, "TABLE_ENTRIES", 10)
    texts = random_texts(50)
    for text in texts:
        assert words.encode_all([text])[0].tolist() == words.tokenizer.encode(
            text, add_special_tokens=False).ids
        assert tokencount.count_texts(machine, [text])[0] == machine.size(text)


def test_scan_composes_state_maps():
    rng = np.random.default_rng(3)
    ends, counts = rng.integers(0, 2, (40, 2)), rng.integers(0, 9, (40, 2))
    text = np.sort(rng.integers(0, 6, 40))
    _, got = tokencount.scan_maps(ends, counts, text)
    for i in range(40):
        for start in (0, 1):
            state, total = start, 0
            for j in range(i + 1):
                if text[j] == text[i]:
                    total, state = total + counts[j, state], ends[j, state]
            assert got[i, start] == total


def test_count_rows(spark):
    docs = spark.createDataFrame(
        [(1, "Hello there", "x"), (1, "Hello there", "x"), (None, None, "y"), (2, "é " * 600, "z")],
        "doc_id long, text string, n_tokens string")
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = sorted(tokencount.token_counts(docs, path).collect(), key=lambda r: r["n_bytes"])
    assert [(r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in rows[:3]] == [
        (None, 0, 0), (1, 11, 2), (1, 11, 2)]
    assert rows[3]["n_bytes"] == 1800 and rows[3]["over_limit"]
    assert tokencount.token_counts(docs.limit(0), path).count() == 0


def check_packing(rows, texts: dict):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert set(pieces) == set(texts)
    for doc_id, found in pieces.items():
        ids = np.array(library.encode(texts[doc_id] or "", add_special_tokens=False).ids + [1],
                       dtype="<u4")
        at = 0
        for r in sorted(found, key=lambda r: r["start"]):
            part = ids[at:at + r["length"]]
            assert r["start"] == at and r["length"] == len(part) > 0
            assert r["ids_crc32"] == zlib.crc32(part.tobytes()) and r["doc_tokens"] == len(ids)
            if "ids" in r:
                assert list(r["ids"]) == part.tolist()
            at += len(part)
        assert at == len(ids)
    for found in sequences.values():
        at = 0
        for r in sorted(found, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == found[0]["tier"] <= 2048 and at & (at - 1) == 0
    return sequences


def test_packing_round_trip(spark, monkeypatch):
    rng = random.Random(4)
    texts = {i: " ".join(rng.choice(["alpha", "beta,", "Gamma"]) for _ in range(
        rng.choice([0, 3, 40, 300, 900, 5000]))) for i in range(120)} | {500: None, None: "odd row"}
    docs = spark.createDataFrame([(k, v, 7) for k, v in texts.items()],
                                 "doc_id long, text string, start int").repartition(3)
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [r.asDict() for r in packing.pack(docs, path, with_ids=True).collect()]
    sequences = check_packing(rows, texts)
    short = [s for s in sequences.values() if s[0]["tier"] < 256]
    assert len(short) <= 3 * 8         # only what a task has left at its end
    again = [r.asDict() for r in packing.pack(docs, path, with_ids=True).collect()]
    assert rows == again
    assert packing.pack(docs.limit(0), path).count() == 0


def test_step_groups_are_balanced():
    rng = random.Random(2)
    windows = []
    for _ in range(300):
        size = rng.choice([2048, 1024, 512])
        cut = rng.randint(1, size - 1)
        windows.append([(cut, 0, 0), (size - cut, 1, 0)])
    groups = packing.step_groups(windows, 16_384)
    tokens, sizes = defaultdict(int), defaultdict(set)
    for w, g in zip(windows, groups):
        tokens[g] += sum(p[0] for p in w)
        sizes[g].add(sum(p[0] for p in w))
    assert all(len(s) == 1 for s in sizes.values())
    assert max(tokens.values()) <= 16_384
    for g in tokens:
        alike = [tokens[x] for x in tokens if sizes[x] == sizes[g]]
        assert max(alike) - min(alike) <= max(sizes[g])
