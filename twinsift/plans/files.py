"""Round trips through the file layouts: written from the given tables, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinsift import schemas
from twinsift.functions import text
from twinsift.operators import geo, items
from twinsift.plans import evidence as evidence_plans
from twinsift.plans import geo as geo_plans
from twinsift.plans import lenses, pipeline
from twinsift.plans import sqltext as s
from twinsift.plans.registry import query
from twinsift.session import scratch_path
from twinsift.sources import readers, writers

c = F.col


_METADATA_SQL = {
    "Image Number": "CAST(p_partkey AS VARCHAR)", "Description": "p_name || ', \"' || p_brand || '\"'",
    "County": "CASE WHEN p_size % 2 = 0 THEN '' ELSE p_type END"}


@query("read_metadata_csv", "SELECT " + ", ".join(
    f"{_METADATA_SQL.get(n, f"'{n} ' || p_size")} AS {n.lower().replace(' ', '_')}"
    for n in schemas.SCRAPED_COLUMNS) + " FROM part")
def read_metadata_csv(t):
    """All columns, written in another order than they are listed, with one more that is ignored."""
    made = {n: F.concat(F.lit(f"{n} "), c("p_size").cast("string")) for n in schemas.SCRAPED_COLUMNS}
    made |= {"Image Number": c("p_partkey").cast("string"),
             "Description": F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"')),
             "County": F.when(c("p_size") % 2 != 0, c("p_type"))}
    path = scratch_path(t.spark, "metadata")
    writers.write_csv(t.part.select(F.lit("more").alias("Notes"), *[
        made[n].alias(n) for n in reversed(schemas.SCRAPED_COLUMNS)]), path)
    rows = readers.metadata_csv(t.spark, path)
    return rows.select(*[c(f"`{n}`").alias(n.lower().replace(" ", "_")) for n in schemas.SCRAPED_COLUMNS])


@query("write_enriched", s.with_lenses("v_sampled", """
SELECT CAST(row_id AS VARCHAR) AS row_id, round(lat, 6) AS lat, round(lon, 6) AS lon, bio1 AS bio1_out,
  bio2 IS NULL AS bio2_missing FROM v_sampled"""))
def write_enriched(t):
    rows = lenses.points(t)
    layers = geo_plans.LAYERS
    features = geo.grid_sample(geo.distinct_points(rows), lenses.cells(t), layers, 10.0)
    path = scratch_path(t.spark, "enriched")
    writers.write_enriched(geo.attach_features(rows, features), ["row_id", "lat", "lon"],
                           ["lon", *layers], path)
    read = readers.metadata_csv(t.spark, path, ["row_id", "lat", "lon", "bio1", "bio2", "bio3"])
    return read.select("row_id", c("lat").cast("double").alias("lat"), c("lon").cast("double").alias("lon"),
                       c("bio1").try_cast("double").alias("bio1_out"), (c("bio2") == "").alias("bio2_missing"))


@query("write_items", s.with_lenses("v_ground", f"""
SELECT 'item-' || img || '-' || pair_id || '-' || side AS item_id, true_label AS true_name, management, 6 AS n_turns,
  split FROM v_ground"""))
def write_items(t):
    built = items.item_skeleton(pipeline.grounded(t))
    built = built.withColumn("dialogue", items.template_dialogue(built)).select(
        "item_id", "kind", "image", "lookalike", "grounding", "split", "dialogue", "cot", "gold", "tech_sign")
    path = scratch_path(t.spark, "items")
    writers.write_items(built, path)
    return readers.items(t.spark, path).select(
        "item_id", c("lookalike.true").alias("true_name"), "gold.management", F.size("dialogue").alias("n_turns"),
        "split")


@query("read_items", """
SELECT conv_id || '-' || turn AS item_id, role AS speaker, text FROM conversations""")
def read_items(t):
    item_id = F.concat_ws("-", c("conv_id").cast("string"), c("turn").cast("string"))
    turns = F.array(F.struct(F.lit("F1").alias("turn"), c("role").alias("speaker"), "text",
                             F.lit(True).alias("has_image")))
    line = F.to_json(F.struct(item_id.alias("item_id"), turns.alias("dialogue")))
    path = scratch_path(t.spark, "item-lines")
    # Every other line is followed by a blank one.
    t.conversations.select(F.when(c("turn") % 2 == 0, F.concat(line, F.lit("\n"))).otherwise(line)).write.text(path)
    first = F.get("dialogue", F.lit(0))
    return readers.items(t.spark, path).select("item_id", first["speaker"].alias("speaker"),
                                               first["text"].alias("text"))


@query("write_manifest", s.with_lenses("v_manifest", """
SELECT pair_id, CAST(n_imgs_total AS VARCHAR) AS n_imgs_total, CASE WHEN web_verified THEN 'true' ELSE 'false' END
  AS web_verified, coalesce(lane_hint, '') AS lane_hint FROM v_manifest"""))
def write_manifest(t):
    json_path, csv_path = scratch_path(t.spark, "manifest"), scratch_path(t.spark, "manifest-csv")
    writers.write_manifest(evidence_plans.manifest(t), json_path, csv_path,
                           ["pair_id", "n_imgs_total", "web_verified", "lane_hint"])
    return readers.metadata_csv(t.spark, csv_path, ["pair_id", "n_imgs_total", "web_verified", "lane_hint"])


@query("load_image_bytes", """
SELECT item_id, CAST(octet_length(encode(text)) + 1 AS BIGINT) AS n_bytes FROM benchmark
UNION ALL SELECT -1 - item_id, NULL FROM benchmark""")
def load_image_bytes(t):
    root = scratch_path(t.spark, "images")
    t.benchmark.select("item_id", "text").write.partitionBy("item_id").text(root)
    listed = (t.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path"))
    item = F.regexp_extract("path", r"item_id=(-?\d+)/", 1).cast("bigint")
    wanted = listed.withColumn("item_id", item)
    missing = t.benchmark.select(F.concat(F.lit(root), F.lit("/none/"), c("item_id").cast("string")).alias("path"),
                                 (-1 - c("item_id")).alias("item_id"))
    return readers.image_bytes(wanted.unionByName(missing)).select(
        "item_id", F.octet_length("content").cast("bigint").alias("n_bytes"))


@query("overwrite_partitions", """
SELECT p_partkey, p_type, p_type <> 'PROMO' AS first_version FROM part""")
def overwrite_partitions(t):
    path = scratch_path(t.spark, "store")
    writers.overwrite_partitions(t.part.select("p_partkey", "p_type", F.lit(True).alias("first_version")),
                                 path, ["p_type"])
    changed = t.part.filter("p_type = 'PROMO'").select("p_partkey", "p_type", F.lit(False).alias("first_version"))
    writers.overwrite_partitions(changed, path, ["p_type"])
    return t.spark.read.parquet(path).select("p_partkey", text.strip(c("p_type")).alias("p_type"), "first_version")
