"""Views that let the given tables stand in for image rows, evidence, graphs and so on.

Every lens is row-local or an ordinary join, so it grows with its tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsift import dims
from twinsift import fixed_values as fv
from twinsift.functions import geo, text
from twinsift.operators import evidence as ev
from twinsift.operators import mining
from twinsift.plans.registry import Tables
from twinsift.session import scratch_path

CROPS = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
PARTS = fv.ANATOMICAL_PARTS


def _pick(values: tuple[str, ...], index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def _brand(number: Column) -> Column:
    return F.concat(F.lit("Brand#"), number.cast("string"))


def image_rows(t: Tables) -> DataFrame:
    """Labelled image rows from `part`: crop = type, disease = brand, state by FIPS = size."""
    c = F.col
    size = c("p_size") % 7
    suffix = (F.when(size == 0, " virus").when(size == 1, " phytoplasma")
              .when(size == 2, " xanthomonas").when(size == 3, " cyst")
              .when(size == 4, " bacterial").otherwise(""))
    state = dims.states(t.spark).select(c("fips").alias("p_size"), c("name").alias("_state"))
    return (t.part.join(F.broadcast(state), "p_size", "left")
            .select(
                c("p_partkey").alias("row_id"), c("p_partkey").cast("string").alias("img"),
                F.concat_ws("/", F.lit("images"), "p_type", F.replace("p_brand", F.lit("#"), F.lit("_")),
                            F.concat(F.lit("s"), (c("p_partkey") % 17).cast("string"), F.lit("_"),
                                     c("p_partkey").cast("string"), F.lit(".jpg"))).alias("url"),
                F.concat(F.lit("source "), (c("p_partkey") % 17).cast("string")).alias("cite"),
                F.coalesce("_state", F.lit("")).alias("state"), c("p_type").alias("crop"),
                c("p_brand").alias("disease"), c("p_type").alias("host_common"),
                F.when(c("p_partkey") % 5 == 0, "").otherwise(F.concat("p_name", suffix))
                .alias("path_sci"),
                c("p_name").alias("path_common"),
                F.split_part("p_name", F.lit(" "), F.lit(2)).alias("descriptor"),
                (c("p_partkey") % 17).cast("string").alias("contributor")))


def embeddings(t: Tables) -> DataFrame:
    """Image vectors: ten classes in two crops, three organ buckets."""
    c = F.col
    return t.embeddings.select(
        F.when(c("label") < 5, "ECONOMY").otherwise("LARGE").alias("crop"),
        _brand(c("label") + 1).alias("disease"),
        F.concat(F.lit("organ"), (c("vec_id") % 3).cast("string")).alias("bucket"),
        c("vec_id").cast("string").alias("img"), "embedding", "vec_id")


def _pair_columns(crop: Column, a: Column, b: Column) -> list[Column]:
    return [text.pair_id(crop, a, b).alias("pair_id"), crop.alias("crop"),
            F.least(a, b).alias("member_a"), F.greatest(a, b).alias("member_b")]


def evidence(t: Tables) -> DataFrame:
    """Web evidence results from `events`, several per pair, ordered by (ts, event_id)."""
    c = F.col
    crop = _pick(CROPS, c("user_id") % 6)
    a = _brand(1 + c("event_id") % 25)
    b = _brand(1 + (F.floor(c("event_id") / 25) + c("user_id")) % 25)
    host = _pick(("https://extension.example.edu/", "https://www.example.edu/",
                  "https://doi.org/", "https://www.example.gov/", "https://blog.example.com/"),
                 c("event_id") % 5)
    url = F.concat(host, c("event_id").cast("string"))
    return (t.events.filter(a != b)
            .select(*_pair_columns(crop, a, b), "ts", "event_id", "event_type",
                    (c("event_id") % 3 != 0).alias("documented"),
                    F.when(c("event_id") % 4 == 0, "").otherwise(c("props")).alias("quote"),
                    url.alias("source_url"), text.source_type(url).alias("source_type")))


def latest_evidence(t: Tables) -> DataFrame:
    """The evidence store: the latest record per pair, with `verified`."""
    store = ev.latest_per_key(evidence(t), ["pair_id"], ["ts", "event_id"])
    return ev.verified_evidence(store)


#: A decision graph without faults, as it stands in a journal line.
_FORKS = ",".join(
    f'{{"axis":"{axis}","question":"q","a_signal":"x","b_signal":"y","weight":"{weight}"}}'
    for axis, weight in zip(fv.FORK_AXES, ("supporting", "decisive", "weak")))
_GRAPH_REST = ('"confusable_reason":"alike","shared_presentation":"both","forks":[' + _FORKS + '],"narrative_a":"a",'
               '"narrative_b":"b","management_a":"a","management_b":"b","geo_localizable_a":true,'
               '"geo_localizable_b":false}}')


def journal_lines(t: Tables) -> DataFrame:
    """One journal line per event (`value`), with ts and event_id.

    Some lines are broken and some are no results. Of the graphs some are valid, some not
    confusable, some ill-typed and some lack most keys. Each line carries its own order.
    """
    e = evidence(t)
    c = F.col
    kind, turn = c("event_type"), c("event_id") % 4
    graph = (F.when(turn == 0, F.lit('"confusable":true,' + _GRAPH_REST))
             .when(turn == 1, F.lit('"confusable":false,' + _GRAPH_REST))
             .when(turn == 2, F.lit('"confusable":"maybe",' + _GRAPH_REST))
             .otherwise(F.lit('"forks":[],"confusable":true}}')))
    tail = (F.when(kind == "click", F.concat(
                F.lit('"confusable_documented":'), c("documented").cast("string"),
                F.lit(","), F.btrim(F.to_json(F.struct(F.coalesce("quote", F.lit("")).alias("quote"))), F.lit("{}")),
                F.lit(',"source_url":"'), c("source_url"), F.lit('","source_type":"'),
                c("source_type"), F.lit('"}}')))
            .when(kind == "view", graph)
            .when(kind == "error", F.concat(F.lit('"farmer_lay_report":"seen in event '),
                                            c("event_id").cast("string"), F.lit('"}}')))
            .when(kind == "signup", F.lit('"forks":[')).otherwise(F.lit('"forks":[]}}')))
    head = F.when(kind == "purchase", "started").otherwise("result")
    line = F.concat(F.lit('{"type":"'), head, F.lit('","ts":"'), c("ts").cast("string"),
                    F.lit('","event_id":'), c("event_id").cast("string"),
                    F.lit(',"result":{"pair_id":"'), c("pair_id"), F.lit('",'), tail)
    no_object = (kind == "purchase") & (c("event_id") % 2 == 0)
    return e.select(F.when(no_object, '{"type":"result","result":"no object"}').otherwise(line).alias("value"),
                    "ts", "event_id")


def journal(t: Tables) -> DataFrame:
    """Journal lines written as text and read back as the source would be."""
    path = scratch_path(t.spark, "journal-text")
    journal_lines(t).select("value").write.text(path)
    return t.spark.read.text(path)


def graph_documents(t: Tables) -> DataFrame:
    """The stored graphs as parsed JSON (`doc`), some with values of a wrong type."""
    c = F.col

    def bent(condition: Column, value: str, plain: Column) -> Column:
        return F.when(condition, F.lit(value)).otherwise(plain)

    fork = F.transform("graph.forks", lambda f, i: bent((c("conv_id") % 31 == 3) & (i == 0), '"fork"', F.to_json(f)))
    body = F.to_json(c("graph").dropFields("confusable", "geo_localizable_a", "forks"))
    made = F.concat(
        F.lit('{"confusable":'), bent(c("conv_id") % 23 == 1, '"yes"', c("graph.confusable").cast("string")),
        F.lit(',"geo_localizable_a":'), bent(c("conv_id") % 29 == 2, "0", c("graph.geo_localizable_a").cast("string")),
        F.lit(',"forks":['), F.array_join(fork, ","), F.lit("],"), F.substr(body, F.lit(2)))
    return graph_store(t).select("pair_id", F.parse_json(bent(c("conv_id") % 37 == 4, "[1]", made)).alias("doc"))


def graph_records(t: Tables) -> DataFrame:
    """Decision graph records: each conversation text gives one graph, each line one fork."""
    c = F.col
    crop = _pick(CROPS, c("conv_id") % 6)
    a = _brand(1 + (c("conv_id") * 7 + c("turn")) % 25)
    b = _brand(1 + (c("conv_id") + c("turn") * 3) % 25)

    def fork(line: Column, i: Column) -> Column:
        axis = F.when((c("conv_id") % 11 == 0) & (i == 0), "colour").otherwise(_pick(fv.FORK_AXES, i % 8))
        middle = F.floor((F.length(line) + 1) / 2).cast("int")
        weight = F.when(i == 1, "decisive").when(i % 2 == 0, "supporting").otherwise("weak")
        return F.struct(
            axis.alias("axis"), line.alias("question"),
            F.substr(line, F.lit(1), middle).alias("a_signal"),
            F.substr(line, middle + 1).alias("b_signal"),
            weight.alias("weight"))

    first = second = c("text")
    lay = F.when(c("turn") % 5 != 4, F.struct(
        F.concat(F.lit("Look closely for "), first).alias("farmer_lay_report"),
        F.concat(F.lit("Look at the leaf: "), first).alias("decisive_lay_a"),
        F.concat(F.lit("Check the stem for "), second).alias("decisive_lay_b"),
        (c("turn") % 2 == 0).alias("decisive_micro_a"),
        (c("turn") % 2 == 1).alias("decisive_micro_b")))
    graph = F.struct(
        (c("conv_id") % 13 != 0).alias("confusable"),
        F.when(c("conv_id") % 19 == 3, " ").otherwise(c("role")).alias("confusable_reason"),
        c("role").alias("shared_presentation"),
        F.transform(F.split("text", "\n"), fork).alias("forks"),
        first.alias("narrative_a"), second.alias("narrative_b"),
        F.concat(F.least(a, b), F.lit(": "), first).alias("management_a"),
        F.when(c("conv_id") % 17 != 5, second).alias("management_b"),
        (c("turn") % 3 == 0).alias("geo_localizable_a"),
        (c("turn") % 3 == 1).alias("geo_localizable_b"), lay.alias("lay"))
    return (t.conversations.filter(a != b)
            .select(*_pair_columns(crop, a, b), "conv_id", "turn", F.lit("disease").alias("kind"),
                    F.when(c("role") == "system", "gold").otherwise("generated").alias("source"),
                    (c("conv_id") * 100 + c("turn")).alias("seq"), graph.alias("graph"))
            .withColumn("member_a_label", c("member_a"))
            .withColumn("member_b_label", c("member_b")))


def graph_store(t: Tables) -> DataFrame:
    """One graph per pair: generated wins over gold, then the latest."""
    g = graph_records(t)
    return ev.graph_union(g.filter("source = 'gold'"), g.filter("source = 'generated'"))


def visibility_labels(t: Tables) -> DataFrame:
    """Visibility labels for the labelled documents, keyed by image, without their texts."""
    c = F.col
    return (t.documents.select("doc_id").join(t.labels, "doc_id")
            .select(c("doc_id").cast("string").alias("img"),
                    _pick(PARTS, c("doc_id") % 8).alias("anatomical_part"),
                    (c("quality") == 1).alias("is_closeup"),
                    (c("toxic") == 0).alias("decisive_sign_visible")))


def lay_observations(t: Tables) -> DataFrame:
    """What a lay person sees on each image."""
    return t.documents.select(F.col("doc_id").cast("string").alias("img"), F.col("text").alias("lay_observation"))


def label_report(t: Tables) -> DataFrame:
    """Label-quality report records, one per labelled document."""
    c = F.col
    crop = _pick(CROPS, F.floor(c("doc_id") / 25) % 6)
    bad, doubtful = c("toxic") == 1, c("quality") == 0
    verdict = (F.when(bad & doubtful, "INCORRECT").when(bad | doubtful, "QUESTIONABLE")
               .otherwise("CORRECT"))
    return t.documents.select("doc_id", "lang").join(t.labels, "doc_id").select(
        crop.alias("crop"),
        F.struct(
            F.when(crop == "STANDARD", "INVALID")
            .when(crop == "SMALL", "MISSPELLED_OR_UNSTANDARDISED").otherwise("VALID").alias("verdict"),
            F.when(crop == "SMALL", " Small grain ").otherwise(crop).alias("canonical_name")
        ).alias("crop_validation"),
        F.struct(
            (crop == "STANDARD").alias("skipped"),
            F.array(F.struct(
                _brand(1 + c("doc_id") % 25).alias("disease"), verdict.alias("verdict"),
                c("lang").alias("reason"))).alias("disease_verdicts")).alias("disease_check"))


def geo_rows(t: Tables) -> DataFrame:
    """Located rows from orders: a point for some, a county, a state or nothing for others."""
    c = F.col
    state = dims.states(t.spark).select(c("fips").alias("_fips"), c("name").alias("_state"))
    joined = (t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
              .join(t.customer.select("c_custkey", "c_nationkey"), c("o_custkey") == c("c_custkey"))
              .join(t.nation.select("n_nationkey", "n_name", "n_regionkey"),
                    c("c_nationkey") == c("n_nationkey"))
              .join(t.region, c("n_regionkey") == c("r_regionkey"))
              .withColumn("_fips", c("n_nationkey") + 1)
              .join(F.broadcast(state), "_fips", "left"))
    key = c("o_orderkey")
    point = key % 100 == 0
    state_name = F.coalesce("_state", F.lit("Elsewhere"))
    county = F.concat(c("n_name"), F.lit(" County"))
    location = (F.when(key % 7 == 0, F.concat_ws(", ", "r_name", "n_name"))
                .when(key % 3 == 0, F.concat_ws(", ", F.lit("United States"), state_name))
                .otherwise(F.concat_ws(", ", F.lit("United States"), state_name, county)))
    return joined.select(
        key.alias("row_id"), "o_orderdate",
        F.when(point, (((key * 37) % 1800) / 10 - 90).cast("string")).otherwise("").alias("lat_text"),
        F.when(point, (((key * 91) % 3600) / 10 - 180).cast("string")).otherwise("").alias("lon_text"),
        location.alias("location"), F.lit("").alias("state"),
        F.when(key % 5 == 0, F.concat(F.col("n_name"), F.lit(" parish"))).otherwise("").alias("county"),
        "n_name", "r_name")


def gazetteer_raw(t: Tables) -> DataFrame:
    """County gazetteer text rows: every nation is a county of the state with its FIPS."""
    c = F.col
    state = dims.states(t.spark).select(c("fips").alias("_fips"), c("usps").alias("_usps"))
    return (t.nation.withColumn("_fips", c("n_nationkey") + 1)
            .join(F.broadcast(state), "_fips", "left")
            .select(c("n_nationkey").alias("row_id"),
                    F.concat(F.coalesce("_usps", F.lit("")), F.lit(" ")).alias("USPS"),
                    F.concat(F.lit(" "), c("n_name"), F.when(c("n_nationkey") % 2 == 0, " County")
                             .otherwise(" Parish")).alias("NAME"),
                    F.when(c("n_nationkey") % 6 == 5, "n/a")
                    .otherwise((c("n_nationkey") + 20.5).cast("string")).alias("INTPTLAT"),
                    (F.lit(-70.25) - c("n_nationkey")).cast("string").alias("INTPTLONG")))


def points(t: Tables) -> DataFrame:
    c = F.col
    return t.customer.select(
        c("c_custkey").alias("row_id"), ((c("c_custkey") * 37) % 1800 / 10 - 90).alias("lat"),
        ((c("c_custkey") * 91) % 3600 / 10 - 180).alias("lon"))


def cells(t: Tables) -> DataFrame:
    """Raster cells at 10 degrees, latest part per cell and layer; nodata when size is 1."""
    c = F.col
    key = c("p_partkey")
    raw = t.part.select(
        F.concat(F.lit("bio"), (1 + F.floor(key / 648) % 3).cast("string")).alias("layer"),
        (key % 18).cast("int").alias("row"), (F.floor(key / 18) % 36).cast("int").alias("col"),
        F.when(c("p_size") == 1, F.lit(-9999.0)).when(c("p_size") == 2, F.lit(0.0))
        .otherwise(c("p_retailprice")).alias("value"), key.alias("k"))
    return (raw.groupBy("layer", "row", "col").agg(F.max_by("value", "k").alias("value"))
            .withColumn("nodata", F.lit(-9999.0)))


def candidate_pairs(t: Tables) -> DataFrame:
    return mining.mine_pairs(image_rows(t))


def zones(df: DataFrame) -> DataFrame:
    return (df.withColumn("zone", geo.zone_code(F.col("lat"), F.col("lon")))
            .withColumn("climate", geo.zone_climate(F.col("lat"), F.col("lon"))))
