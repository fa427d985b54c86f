"""The corpus pipeline: stages, columns, and planted cases."""

import random

import corpus_pipeline
from twinsift.session import materialise


def write_tables(spark, folder: str) -> dict:
    rng = random.Random(9)
    words = [f"word{i}" for i in range(2000)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."
    passage = prose(60)
    texts = {i: f"{prose(80)}\n{prose(60)}" for i in range(150)}
    texts |= {200 + i: f"{prose(70)}\n{passage}" for i in range(9)}           # a shared passage
    texts |= {300 + i: texts[0] for i in range(2)}                            # exact copies
    texts[310] = texts[1].replace("word", "WORD", 1)                          # a copy but for case
    texts |= {400 + i: " ".join(["spam!!", "###"] * 40) + f" {i}" for i in range(60)}
    docs = [(i, t, "en", f"s{i % 4}", len(t)) for i, t in texts.items()]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(
        3).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(i < 400), 0) for i in texts if i % 2]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return texts


def test_pipeline(spark, tmp_path):
    folder = str(tmp_path)
    texts = write_tables(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    after = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != names[-1]:
            assert out.columns == docs.columns
        docs = materialise(out, "test-stage")
        after.append([r.asDict() for r in docs.collect()])
    good, clean, single, mixed, packed = after
    assert {r["doc_id"] for r in good} == {i for i in texts if i < 400}
    lines = {r["doc_id"]: r["text"].split("\n") for r in clean}
    assert len(lines[200]) == 2 and all(len(lines[i]) == 1 for i in range(201, 209))
    assert all(r["text"] == texts[r["doc_id"]] for r in clean if r["doc_id"] < 150)
    ids = {r["doc_id"] for r in single}
    assert ids == ({r["doc_id"] for r in clean} - {310}) - {i for i in (300, 301) if i in lines}
    copies = {}
    for r in mixed:
        copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
    assert set(copies) <= ids and max(copies.values()) <= 2
    size = {r["doc_id"]: len(r["text"].split()) for r in single}
    taken = sum(size[i] * n for i, n in copies.items())
    assert abs(taken - 1.5 * sum(size.values())) < 4 * max(size.values())
    assert {r["doc_id"] for r in packed} == set(copies)
    ends = sum(r["start"] + r["length"] == r["doc_tokens"] for r in packed)
    assert ends == sum(copies.values())
    whole = {k: [r for r in packed if r["doc_id"] == k] for k, n in copies.items() if n == 1}
    text_of = {r["doc_id"]: r["text"] for r in single}
    for k, rows in whole.items():
        got = [x for r in sorted(rows, key=lambda r: r["start"]) for x in r["ids"]]
        assert len(got) == rows[0]["doc_tokens"] and got[-1] == 1 and text_of[k]


def test_run_is_the_stages_in_a_row(spark):
    rows = [r.asDict() for r in corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()]
    assert rows and {"doc_id", "start", "length", "sequence_id", "offset", "ids"} <= set(rows[0])
    assert all(len(r["ids"]) == r["length"] for r in rows)
