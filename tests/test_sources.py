"""Readers, writers and the incremental journal on small files."""

import json
import os

from pyspark.sql import functions as F

from twinsift import schemas
from twinsift.operators import evidence, geo
from twinsift.sources import readers, writers
from twinsift.streaming import journal


def test_image_folder(spark, tmp_path):
    for name in ("Sweet_Corn/Common_Rust/src1_001.JPG", "Sweet_Corn/Common_Rust/notes.txt",
                 "Sweet_Corn/.hidden/.jpg", "Oak/Wilt/a.b.png"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"xyz")
    rows = {r["img"]: r for r in readers.scan_image_folder(spark, str(tmp_path)).collect()}
    assert set(rows) == {"Sweet_Corn__Common_Rust__src1_001", "Oak__Wilt__a.b"}
    corn = rows["Sweet_Corn__Common_Rust__src1_001"]
    assert (corn["crop"], corn["disease"], corn["photographer"]) == ("Sweet Corn", "Common Rust", "src1")
    assert readers.scan_image_folder(spark, str(tmp_path), "sweet corn").count() == 1
    assert readers.scan_image_folder(spark, str(tmp_path), "SWEET_CORN").count() == 1


def test_only_located_files_are_opened(spark, tmp_path, monkeypatch):
    """No root is listed: files beside the located ones are not looked at, and what cannot be read is null."""
    (tmp_path / "a.jpg").write_bytes(b"xyz")
    (tmp_path / "big.jpg").write_bytes(bytes(1000))
    os.mkfifo(tmp_path / "poison.jpg")                # opening it would wait for ever
    os.mkdir(tmp_path / "folder.jpg")
    at = [f"file:{tmp_path}/a.jpg", f"{tmp_path}/a.jpg", f"file:{tmp_path}/folder.jpg", "file:/nowhere/x.jpg", "odd://x/y", None,
          f"file://{tmp_path}/big.jpg", f"{tmp_path}/with space.jpg"]
    located = spark.createDataFrame([(i, p) for i, p in enumerate(at)], "row int, path string")
    monkeypatch.setattr(readers, "FETCHED_BYTES", 4)
    got = {r["row"]: r["content"] for r in readers.image_bytes(located).collect()}
    assert {i: bytes(c) if c is not None else None for i, c in got.items()} == {
        0: b"xyz", 1: b"xyz", 2: None, 3: None, 4: None, 5: None, 6: bytes(1000), 7: None}


def test_image_tree_lists_only_the_crop(spark, tmp_path):
    root = str(tmp_path / "tree")
    rows = [(crop, f"d_{i % 3}", f"{crop}{i}") for crop in ("Sweet Corn", "Oak", "Oakley") for i in range(6)]
    spark.createDataFrame(rows, "crop string, disease string, url string").write.partitionBy(
        "crop", "disease").option("maxRecordsPerFile", 1).text(root)
    everything = readers.scan_image_tree(spark, root, extensions=[".txt"])
    assert everything.count() == 18 and len(everything.inputFiles()) == 18
    assert {(r["crop"], r["disease"]) for r in everything.collect()} == {(c, d.replace("_", " ")) for c, d, _ in rows}
    for name in ("sweet corn", " SWEET_CORN "):
        one = readers.scan_image_tree(spark, root, name, [".txt"])
        plan = one._jdf.queryExecution().executedPlan().toString()
        assert one.count() == 6 and len(one.inputFiles()) == 6
        assert "PartitionFilters: [" in plan and "crop" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert readers.scan_image_tree(spark, root, "oak", [".txt"]).count() == 6
    pruned = everything.filter("disease = 'd 1'")._jdf.queryExecution().executedPlan().toString()
    assert "disease" in pruned.split("PartitionFilters: [")[1].split("]")[0]


def test_graph_store_one_record_per_file(spark, tmp_path):
    for i in range(3):
        record = {"pair_id": f"p{i}", "kind": "disease", "graph": {"confusable": True, "forks": [
            {"axis": "habit", "question": "q", "a_signal": "a", "b_signal": "b", "weight": "decisive"}]}}
        (tmp_path / f"p{i}.json").write_text(json.dumps(record, indent=2))
    got = readers.graph_store(spark, str(tmp_path), one_per_file=True)
    assert sorted(r["pair_id"] for r in got.collect()) == ["p0", "p1", "p2"]
    assert got.filter(F.size("graph.forks") == 1).count() == 3


def test_gazetteer_is_latin1_trimmed_and_skips_bad_rows(spark, tmp_path):
    text = ("USPS\tGEOID\tNAME\tINTPTLAT\tINTPTLONG  \nPR\t1\tMayagüez Municipio\t18.2\t -67.1  \n"
            "IA\t2\tPolk County\t41.6\t-93.5\nIA\t3\tshort\nIA\t4\tBad County\tx\t1\nIA\t5\tPOLK county\t41.7\t-93.6\n")
    (tmp_path / "gaz.txt").write_bytes(text.encode("latin-1"))
    raw = readers.gazetteer_tsv(spark, str(tmp_path))
    got = {(r["usps"], r["county"]): (r["county_lat"], r["county_lon"]) for r in geo.gazetteer(raw).collect()}
    assert got == {("PR", "mayagüez"): (18.2, -67.1), ("IA", "polk"): (41.7, -93.6)}


def test_gazetteer_of_the_published_layout(spark, tmp_path):
    head = "USPS\tGEOID\tANSICODE\tNAME\tALAND\tAWATER\tALAND_SQMI\tAWATER_SQMI\tINTPTLAT\tINTPTLONG   "
    (tmp_path / "gaz.txt").write_text(f"{head}\nIA\t1\t2\tPolk County\t3\t4\t5\t6\t41.6\t-93.5\n")
    got = geo.gazetteer(readers.gazetteer_tsv(spark, str(tmp_path))).collect()
    assert [tuple(r) for r in got] == [("IA", "polk", 41.6, -93.5)]


def test_csv_is_bound_by_header_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text('County,Notes,Description, Image Number\nLake,x,"a, b",7\n')
    row = readers.metadata_csv(spark, str(tmp_path)).first()
    assert (row["Image Number"], row["County"], row["Description"], row["State"]) == ("7", "Lake", "a, b", "")


def test_csv_keeps_quotes_newlines_and_empty_text(spark, tmp_path):
    rows = [("a", 'say "hi", then\nleave', None), ("b", "", "x")]
    df = spark.createDataFrame(rows, "id string, note string, extra string")
    path = str(tmp_path / "csv")
    writers.write_enriched(df, ["id", "note"], ["note", "extra"], path)
    got = readers.metadata_csv(spark, path, ["id", "note", "extra"], line_breaks=True).collect()
    assert sorted(map(tuple, got)) == [("a", 'say "hi", then\nleave', ""), ("b", "", "x")]


def test_items_are_written_without_the_technical_sign(spark, tmp_path):
    df = spark.createDataFrame([("i", "secret")], "item_id string, tech_sign string")
    writers.write_items(df, str(tmp_path / "items"))
    text = "".join((tmp_path / "items" / f).read_text() for f in os.listdir(tmp_path / "items")
                   if f.startswith("part"))
    assert json.loads(text) == {"item_id": "i"}


def test_journal_skips_bad_lines_and_non_objects(spark):
    lines = ['{"type":"result","result":{"pair_id":"p","forks":[]}}', '{"type":"result","result":[1]}',
             '{"type":"result","result":null}', '{"type":"note","result":{"pair_id":"p"}}', "{oops", "",
             '{"type":"result"}']
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    got = readers.journal_results(df).select(
        readers.result_field("pair_id").alias("pair_id"), *[
            f.alias(n) for n, f in zip("eg", readers.has_field(["confusable_documented", "forks"]))]).collect()
    assert [tuple(r) for r in got] == [("p", False, True)]


def test_keyed_json(spark):
    df = spark.createDataFrame([('{"scores":{"a":{"n":1},"b":{"n":2}},"k":3}',)], "doc string")
    whole = df.select(*readers.keyed_json(F.col("doc"), "struct<n:int>", sub_key="scores"))
    assert sorted((r["key"], r["value"]["n"]) for r in whole.collect()) == [("a", 1), ("b", 2)]


def _stream(spark, folder):
    return spark.readStream.schema("kind string, pair_id string, seq long").json(folder)


def test_stream_equals_batch_and_a_rerun_adds_nothing(spark, tmp_path):
    source, store, marks = (str(tmp_path / n) for n in ("in", "store", "marks"))
    parts = [[("e", "p1", 5), ("e", "p1", 2), ("g", "p1", 3), ("e", "p2", 1)],
             [("e", "p1", 6), ("e", "p3", 8), ("g", "p1", 9), ("e", "p3", 7)],
             [("e", "p3", 10), ("g", "p2", 11), ("e", "p2", 12)], [("e", "p1", 13), ("x", "p1", 14)]]
    schema = "kind string, pair_id string, seq long"
    keys = ["kind", "pair_id"]
    for rows in parts:          # every micro-batch restarts the query from its checkpoint
        spark.createDataFrame(rows, schema).write.mode("append").json(source)
        journal.ingest(_stream(spark, source), store, marks, keys, ["seq"]).awaitTermination()
    everything = spark.createDataFrame(sum(parts, []), schema)
    want = sorted(map(tuple, evidence.first_per_key(everything, keys, ["seq"]).collect()))
    got = spark.read.parquet(store).select("kind", "pair_id", "seq")
    assert sorted(map(tuple, got.collect())) == want
    journal.ingest(_stream(spark, source), store, marks, keys, ["seq"]).awaitTermination()
    assert sorted(map(tuple, got.collect())) == want
    # All parts in one run, each a micro-batch of its own.
    again = journal.ingest(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(source),
                           f"{store}-2", f"{marks}-2", keys, ["seq"])
    again.awaitTermination()
    assert len([p for p in again.recentProgress if p["numInputRows"]]) > 2


def test_known_keys_are_state_and_not_read_from_the_store(spark, tmp_path):
    source, store, other, marks = (str(tmp_path / n) for n in ("in", "store", "other", "marks"))
    schema = "kind string, pair_id string, seq long"
    spark.createDataFrame([("e", "p1", 5), ("e", "p2", 1)], schema).write.mode("append").json(source)
    journal.ingest(_stream(spark, source), store, marks, ["kind", "pair_id"], ["seq"]).awaitTermination()
    spark.createDataFrame([("e", "p1", 0), ("e", "p9", 1)], schema).write.mode("append").json(source)
    journal.ingest(_stream(spark, source), other, marks, ["kind", "pair_id"], ["seq"]).awaitTermination()
    assert [(r["pair_id"], r["seq"]) for r in spark.read.parquet(other).collect()] == [("p9", 1)]


def test_replayed_batch_is_idempotent(spark, tmp_path):
    store = str(tmp_path / "store")
    batch = spark.createDataFrame([("e", "p1", 5), ("e", "p2", 1)], "kind string, pair_id string, seq long")
    for _ in range(2):
        journal.append(batch, 0, store)
    assert spark.read.parquet(store).count() == 2


def test_schemas_parse(spark):
    for ddl in (schemas.IMAGE_ROWS, schemas.GRAPH_RECORDS, schemas.ITEMS,
                schemas.LABEL_REPORT, schemas.JOURNAL):
        assert spark.createDataFrame([], ddl).columns
