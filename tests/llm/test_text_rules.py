"""Repetition rules, line dedup, mixing and quality against plain Python."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from tests.compare import connect, difference
from twinsift.llm import linededup, mixing, quality, repetition
from twinsift.llm import queries as registered

FOLDER = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", list(registered.oracle_sql()))
def test_queries_match_sql(spark, name):
    df = registered.queries()[name](spark, FOLDER)
    assert difference(df, connect(FOLDER), registered.oracle_sql()[name]) is None


def slow_repeats(words):
    out = [0] * len(words)
    for i in range(len(words)):
        for j in range(len(words)):
            k = 0
            while i != j and i + k < len(words) and j + k < len(words) and words[i + k] == words[j + k]:
                k += 1
            out[i] = max(out[i], k)
    return out


def slow_covered(lengths, least):
    return len({p for i, n in enumerate(lengths) if n >= least for p in range(i, i + n)})


def test_repeats_equal_brute_force():
    rng = random.Random(3)
    for _ in range(150):
        texts = [[rng.choice([b"a", b"b", b"c"][:rng.randint(1, 3)]) for _ in range(rng.randint(0, 40))]
                 for _ in range(rng.randint(1, 5))]
        windows, repeats, longest = repetition.repeated_words(texts)
        for i, words in enumerate(texts):
            slow = slow_repeats(words)
            assert windows[i] == slow_covered(slow, repetition.WINDOW)
            assert repeats[i] == slow_covered(slow, repetition.MIN_REPEAT)
            assert longest[i] == max(slow + [0])


def test_repetition_rows(spark):
    unique = " ".join(f"w{i}" for i in range(200))
    again = unique + " " + " ".join(f"w{i}" for i in range(30))
    texts = {1: None, 2: "", 3: "a # b | c\n\nx\nx \nx", 4: unique, 5: "la " * 3000, 6: again,
             7: "é漢 " * 12, 8: "one\x1ctwo three"}
    docs = spark.createDataFrame([(k, v, "z") for k, v in [*texts.items(), (4, unique)]],
                                 "doc_id long, text string, kept string")
    rows = repetition.repetition_rules(docs).collect()
    assert sum(r["doc_id"] == 4 for r in rows) == 2
    for r in rows:
        text = texts[r["doc_id"]] or ""
        words = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        assert r["n_words"] == len(words)
        assert r["word_chars"] == sum(map(len, words))
        assert r["n_symbols"] == len(re.findall(r"[#*$%&|<>]", text))
        assert r["n_dup_lines"] == len(lines) - len(set(lines))
        assert r["n_repeat_words"] == (slow_covered(slow_repeats(words), 5) if len(words) < 500 else len(words))
        assert r["base_failed"] == (len(words) < 10 or 100 * r["n_repeat_words"] > 20 * len(words))
    kept = {r["doc_id"]: r["kept"] for r in rows}
    assert kept == {1: False, 2: False, 3: False, 4: True, 5: False, 6: False, 7: False, 8: False}
    assert repetition.repetition_rules(docs.limit(0)).count() == 0


def line_docs(spark):
    shared = "this line stands on very many sites"
    rows = [(i, f"own words of document number {i}\n{shared}\nshort one", f"s{i % 5}") for i in range(40)]
    rows += [(100, "\n".join([shared, shared, "", " " + shared + " "]), "s1"),
             (101, "only on two sites this one\nx", "s1"), (102, "only on two sites this one\ny", "s2"),
             (103, None, "s1"), (104, "", None), (None, shared, None), (105, "a" * 5000, "s9"),
             (0, rows[0][1], "s0")]
    return rows


def line_frame(spark):
    return spark.createDataFrame([(*r, 1, "v") for r in line_docs(spark)],
                                 "doc_id long, text string, source string, n_chars int, rows string")


def slow_lines(rows, min_sites=3, min_words=5, short_percent=10):
    """(doc_id, text, lines, removed) by the rule, line by line."""
    sites, first = defaultdict(set), {}
    for doc_id, text, source in rows:
        for pos, line in enumerate((text or "").split("\n") if text is not None else []):
            if WORD.search(line):
                key, place = line.strip(" \t\n\x0b\x0c\r"), (doc_id is None, doc_id or 0, pos)
                sites[key].add(source or "")
                first[key] = min(first.get(key, place), place)
    every = len(set().union(*sites.values()))
    need = {k: max(min_sites, -(-short_percent * max(0, min_words - len(WORD.findall(k))) * every // 100)) for k in sites}
    out = []
    for doc_id, text, _ in rows:
        lines = text.split("\n") if text is not None else []
        kept = []
        for pos, line in enumerate(lines):
            key = line.strip(" \t\n\x0b\x0c\r")
            if key not in sites or len(sites[key]) < need[key] or first[key] == (doc_id is None, doc_id or 0, pos):
                kept.append(line)
        out.append((doc_id, None if text is None else "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def test_line_dedup_rows(spark):
    docs = line_frame(spark)
    got = sorted(map(tuple, linededup.line_dedup(docs).collect()), key=str)
    assert got == slow_lines(line_docs(spark))
    by_id = {r[0]: r for r in got}
    assert by_id[7] == (7, "own words of document number 7", 3, 2)         # the short line is on five sites of seven
    assert by_id[100] == (100, "", 4, 3) and by_id[101][3] == 0 and by_id[103] == (103, None, 0, 0)
    assert linededup.line_dedup(docs.limit(0)).count() == 0
    long_only = {r["doc_id"]: r["n_removed"] for r in linededup.line_dedup(docs, short_percent=None).collect()}
    assert long_only[7] == 1


@pytest.mark.parametrize("empty", [None, ""])
def test_line_on_three_sites_one_without_name(spark, empty):
    line = "this line stands on three sites"
    docs = spark.createDataFrame([(i, f"{line}\n{i}", s) for i, s in enumerate([empty, "a", "b"])],
                                 "doc_id long, text string, source string")
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in linededup.line_dedup(docs).collect()}
    assert got == {0: (f"{line}\n0", 0), 1: ("1", 1), 2: ("2", 1)}


def test_drop_lines_keeps_columns(spark):
    docs = line_frame(spark)
    out = linededup.drop_lines(docs)
    assert out.columns == docs.columns and out.schema["n_chars"] == docs.schema["n_chars"]
    rows = {r["doc_id"]: r for r in out.collect()}
    assert 100 not in rows and None not in rows and 103 in rows and 104 in rows
    assert rows[7]["n_chars"] == len(rows[7]["text"]) and rows[101]["n_chars"] == 1


def test_short_lines_need_more_sites(spark):
    """Of ten sites a line of three words needs three, of two words three, of one word four."""
    sites = [f"s{i}" for i in range(10)]
    rows = [(i, "\n".join([f"own words of document number {i}", "All rights reserved."]
                          + ["Menu"] * (i < 4) + ["Yes."] * (i < 3) + ["  "]), sites[i]) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for out in (linededup.drop_lines(docs), linededup.line_dedup(docs)):
        got = {r["doc_id"]: r["text"].split("\n")[1:] for r in out.collect()}
        assert got[0] == ["All rights reserved.", "Menu", "Yes.", "  "]
        assert got[2] == ["Yes.", "  "] and got[3] == ["  "] and got[9] == ["  "]


def slow_targets(sizes: dict) -> dict:
    names = sorted((k for k in sizes if k is not None)) + ([None] if None in sizes else [])
    weights = {k: (5, 2, 1)[i % 3] for i, k in enumerate(names)}
    left, free, out = 1.5 * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(weights[k] for k in free)
        full = {k for k in free if 2 * sizes[k] <= level * weights[k] + 1e-9}
        if not full:
            return out | {k: level * weights[k] for k in free}
        for k in full:
            out[k] = 2.0 * sizes[k]
            left -= out[k]
        free -= full
    return out


def test_mixing_meets_targets(spark):
    rng = random.Random(6)
    names = ["b", "a", None, "é", "Z", "empty", "c"]
    rows = [(i, " ".join(["w"] * rng.randint(1, 60)), rng.choice(names[:5] + ["b"] * 4), "k") for i in range(900)]
    rows += [(1000, None, "empty", "k"), (1001, "", "empty", "k"), (None, "x y", "c", "k"), (3, rows[3][1], rows[3][2], "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, target string").repartition(5)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, text, source, _ in rows:
        sizes[source] += len(WORD.findall(text or ""))
    want, taken = slow_targets(sizes), defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    for name, target in want.items():
        assert abs(taken[name] - target) <= 60
    again = mixing.mix(docs.repartition(2)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    mixed = mixing.expand(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r["copies"] for r in got)
    assert mixing.mix(docs.limit(0)).count() == 0


@pytest.mark.parametrize("repeated", [[(7, "w " * 10, "s")] * 500, [(None, "w " * 10, "s")] * 500,
                                      [(None, f"w{i} " * 10, "s") for i in range(500)],
                                      [(7, "w " * 10, "s")] * 300 + [(i, "w " * 7, "s") for i in range(50, 90)]])
def test_mixing_splits_repeated_rows(spark, repeated):
    """Rows that share a draw are taken by count, so the target is met within one document."""
    rows = repeated + [(1000 + i, "w " * 9, "t") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    for source in ("s", "t"):
        own = [r for r in got if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 10
        assert all(r["taken"] <= 2 * r["size"] for r in own)
    again = mixing.mix(docs.repartition(2)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    mixed = mixing.expand(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in got)


def test_quality_learns_held_out(spark):
    rows = [r.asDict() for r in registered.op5_quality(spark, "/root/testdata/sf0.1").collect()]
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    held = [(r["score"], label[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in label]
    good = np.array([s for s, y in held if y == 1])
    bad = np.array([s for s, y in held if y == 0])
    auc = (good[:, None] > bad[None, :]).mean() + (good[:, None] == bad[None, :]).mean() / 2
    assert len(rows) == 10_000 and auc > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)


def test_quality_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, "good words here.", "c"), (3, "x|" * 4000, "d"),
                                  (3, "x|" * 4000, "d")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, None), (2, 1), (2, 0), (None, 1), (3, 0), (99, 1)], "doc_id long, quality int")
    scored = quality.quality_scores(docs, labels).collect()
    assert len(scored) == 5 and all(0 <= r["score"] <= 1 for r in scored)
    none = quality.quality_scores(docs, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert quality.quality_scores(docs.limit(0), labels).count() == 0
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_pairs_learn_what_single_features_cannot():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 3)).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x, y)
    assert model.pairs[0] == (0, 1)
    assert ((model.score(x) > 0.5) == (y > 0.5)).mean() > 0.95


def plain_cut(rows, low, high):
    """The cut of the bins low..high of (bin, residual, weight) rows with the largest gain, or None."""
    def part(keep):
        kept = [r for r in rows if keep(r[0])]
        return sum(r[1] for r in kept) ** 2 / (sum(r[2] for r in kept) + 1), len(kept)

    best = (1e-9, None)
    for cut in range(low + 1, high):
        (left, n), (right, m) = part(lambda b: low <= b < cut), part(lambda b: cut <= b < high)
        gain = left + right - part(lambda b: low <= b < high)[0]
        if min(n, m) >= quality.LEAST and gain > best[0]:
            best = (gain, cut)
    return best[1]


def plain_leaves(rows, low, high, depth):
    cut = plain_cut(rows, low, high) if depth else None
    if cut is None:
        kept = [r for r in rows if low <= r[0] < high]
        return [sum(r[1] for r in kept) / (sum(r[2] for r in kept) + 1)] * (high - low)
    return plain_leaves(rows, low, cut, depth - 1) + plain_leaves(rows, cut, high, depth - 1)


def small_model(monkeypatch, rounds, pairs):
    for name, number in (("ROUNDS", rounds), ("BINS", 8), ("PAIR_BINS", 4), ("PAIRS", pairs)):
        monkeypatch.setattr(quality, name, number)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 3)).astype(np.float32)
    y = (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(size=300) > 0.2).astype(float)
    return x, y, quality.fit(x, y)


def test_boosting_equals_plain_rounds(monkeypatch):
    x, y, model = small_model(monkeypatch, 2, 0)
    bins = [[sum(e <= v for e in model.edges[j]) for v in x[:, j]] for j in range(3)]
    tables = [[0.0] * (len(e) + 1) for e in model.edges]
    start = float(np.log(y.mean() / (1 - y.mean())))
    for _ in range(2):
        for j in range(3):
            totals = [start + sum(tables[k][bins[k][i]] for k in range(3)) for i in range(len(y))]
            chance = [1 / (1 + np.exp(-t)) for t in totals]
            rows = [(b, want - p, p * (1 - p)) for b, want, p in zip(bins[j], y, chance)]
            for b, step in enumerate(plain_leaves(rows, 0, len(tables[j]), 2)):
                tables[j][b] += quality.RATE * step
    assert model.intercept == pytest.approx(start)
    for got, want in zip(model.tables, tables):
        assert got.tolist() == pytest.approx(want)


def test_scores_are_sums_of_table_entries(monkeypatch):
    x, _, model = small_model(monkeypatch, 6, 3)
    assert len(model.pairs) == 3 and all(np.abs(t).max() > 0 for t in model.pair_tables)
    x = np.vstack([x[:50], [[-99, 0, 99]], [[e[0] for e in model.edges]]]).astype(np.float32)
    want = []
    for row in x:
        total = model.intercept
        for edges, values, v in zip(model.edges, model.tables, row):
            total += values[sum(e <= v for e in edges)]
        for (a, b), values in zip(model.pairs, model.pair_tables):
            total += values[sum(e <= row[a] for e in model.pair_edges[a]), sum(e <= row[b] for e in model.pair_edges[b])]
        want.append(1 / (1 + np.exp(-total)))
    assert model.score(x).tolist() == pytest.approx(want)
