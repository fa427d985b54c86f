"""Hand-computed cases of the rules and of the known contradictions."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from twinsift import dims
from twinsift.functions import geo, hashing, labels, text
from twinsift.operators import evidence, gates, geo as geo_ops, items, mining, prompts, ranges, splits

c = F.col


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def lit(x):
    return F.lit(x)


def test_pair_id_is_ordered_and_unicode_aware(spark):
    made = text.pair_id(lit("Común Bean"), lit("Rust"), lit("Late blight (P. inf)"))
    assert value(spark, made) == "común-bean__late-blight--p--inf__rust"
    same = text.pair_id(lit("Común Bean"), lit("Late blight (P. inf)"), lit("Rust"))
    assert value(spark, same) == value(spark, made)


@pytest.mark.parametrize("said, sign", [
    ("Look at the leaf: pale, raised pustules. Then wait", "pale, raised pustules"),
    ("Flip the leaf over, and grey fuzz", "grey fuzz"),
    ("Check the lower stem closely for Dark bands; wash first", "dark bands"),
    ("A long ring of tan concentric bands, with a dark edge", "a long ring of tan concentric bands"),
    ("Short, then long", "short, then long"), ("", ""), (None, ""),
])
def test_head_sign(spark, said, sign):
    assert value(spark, text.head_sign(F.lit(said).cast("string"))) == sign


@pytest.mark.parametrize("raw, day", [
    ("03/04/2019", datetime.date(2019, 3, 4)), ("2019-3-4", datetime.date(2019, 3, 4)),
    ("2019-03-04T05:06:07.1Z", datetime.date(2019, 3, 4)), ("3/4/68", datetime.date(2068, 3, 4)),
    ("3/4/69", datetime.date(1969, 3, 4)), ("03/04/19", datetime.date(2019, 3, 4)),
    ("04.03.2019", None), ("13/40/2019", None), ("", None), (None, None),
])
def test_parse_date(spark, raw, day):
    assert value(spark, geo.parse_date(F.lit(raw).cast("string"))) == day


def test_season_flips_in_the_south(spark):
    assert value(spark, geo.season(lit(1), lit(-10.0))) == "summer"
    assert value(spark, geo.season(lit(1), F.lit(None).cast("double"))) == "winter"
    assert value(spark, geo.season(lit(10), lit(0.0))) == "autumn"


def test_zone_bands_are_half_open(spark):
    for lat, code in ((15.0, "STM"), (14.9, "TLM"), (-15.0, "TLM"), (55.0, "BOR"), (90.0, None)):
        assert value(spark, geo.zone_code(lit(lat), lit(0.0))) == code
    assert value(spark, geo.zone_code(lit(0.0), lit(180.0))) is None


def test_zero_coordinate_counts_as_missing(spark):
    assert value(spark, geo.number_or_missing(lit("0.0"))) is None
    assert value(spark, geo.number_or_missing(lit(" 12.3456789 "))) == 12.345679
    rows = spark.createDataFrame(
        [(1, "0", "5", "Iowa", "", ""), (2, "1", "5", "", "", ""), (3, "", "", "", "", "US, iowa , Polk County"),
         (4, None, None, None, None, "US, Nowhere")],
        "row_id long, lat_text string, lon_text string, state string, county string, location string")
    counties = spark.createDataFrame([("IA", "polk", 41.6, -93.5)],
                                     "usps string, county string, county_lat double, county_lon double")
    tiers = {r["row_id"]: r["geo_precision"] for r in geo_ops.geo_ladder(rows, counties).collect()}
    assert tiers == {1: "state", 2: "point", 3: "county", 4: "none"}


def test_decode_state(spark):
    rows = spark.createDataFrame([("us_37",), ("37",), ("US_37 ",), ("north carolina",), ("Iowa",), ("us_3",),
                                  ("zone",), ("",), (None,)], "code string")
    got = {r["code"]: r["s"] for r in mining.decode_states(rows, "code", "s").collect()}
    assert got == {"us_37": "North Carolina", "37": "North Carolina", "US_37 ": "North Carolina",
                   "north carolina": "North Carolina", "Iowa": "Iowa", "us_3": None, "zone": None, "": None,
                   None: None}


def test_same_organism(spark):
    def same(a, b):
        return value(spark, labels.same_organism(lit(a), lit(b)))

    assert same("Rhizopus stolonifer", "Rhizopus")
    assert same("Phomopsis juniperivora", "Diaporthe juniperovora")
    assert not same("Cercospora sojina", "Ramularia sojina")
    assert not same("", "")
    assert same("Alternaria Sp", "Alternaria solani")


def test_clean_display(spark):
    assert value(spark, labels.clean_display(lit("Genus  Phoma (Ehrenb.) Vuill. "))) == "Phoma"
    assert value(spark, labels.clean_display(lit("Rust De Not."))) == "Rust"


def test_organ_bucket(spark):
    for raw, bucket in (("Foliage", "leaf"), (" Fruit(s) ", "fruit"), ("Bark", "bark"), ("", "other"), (None, "other")):
        assert value(spark, labels.organ_bucket(F.lit(raw).cast("string"))) == bucket


def test_digest_modulo_equals_big_integer_arithmetic(spark):
    import hashlib
    for key in ("a", "20260613|item-1", "ü"):
        want = int(hashlib.sha1(key.encode()).hexdigest(), 16) % 37
        assert value(spark, hashing.digest_modulo(lit(key), 37)) == want


def test_personas(spark):
    rows = dims.personas(spark).orderBy("position").collect()
    ids = [r["persona_id"] for r in rows]
    assert len(ids) == 37 == len(set(ids)) and ids == sorted(ids)
    assert [r["position"] for r in rows] == list(range(37))
    assert ids[0] == "distrustful.A2.high.none"


def test_credible_evidence_needs_type_and_quote(spark):
    rows = spark.createDataFrame(
        [(1, True, "q", "extension"), (2, True, "", "gov"), (3, True, "q", "other"), (4, False, "q", "gov"),
         (5, True, "q", None), (6, None, "q", "gov")],
        "id int, documented boolean, quote string, source_type string")
    assert {r["id"] for r in evidence.verified_evidence(rows).filter("verified").collect()} == {1}


def test_lane_hint_ignores_support_but_is_kept_apart(spark):
    scores = spark.createDataFrame([("p", 0.2, 3, False), ("q", 0.19, 9, True)],
                                   "pair_id string, matched_cross_knn double, matched_support long, ok boolean")
    ev = spark.createDataFrame([("r", "c", "a", "b", True, "q", "u", "gov")],
                               "pair_id string, crop string, member_a string, member_b string, verified boolean, "
                               "quote string, source_url string, source_type string")
    got = {r["pair_id"]: r for r in evidence.merge_evidence(scores, ev).collect()}
    assert got["p"]["lane_hint"] == "image_ambiguous" and got["p"]["lane_hint_supported"] is None
    assert got["q"]["lane_hint"] == got["q"]["lane_hint_supported"] == "image_decisive"
    assert got["r"]["confirmed"] and got["r"]["lane_hint"] is None and not got["r"]["scored"]


def fork(axis="habit", weight="weak", a="x"):
    return (axis, "q", a, "y", weight)


@pytest.mark.parametrize("forks, confusable, problem", [
    ([fork(), fork(weight="decisive"), fork()], True, []),
    ([fork(), fork(), fork()], False, []),
    ([fork(), fork(), fork()], True, ["need exactly 1 decisive fork, found 0"]),
    ([fork(weight="decisive")] * 2, True,
     ["forks must be a list of 3..7 items", "need exactly 1 decisive fork, found 0"]),
    ([fork("colour"), fork(weight="decisive", a=" "), fork(weight=None)], True,
     ["fork[0].axis invalid: 'colour'", "fork[1].a_signal empty", "fork[2].weight invalid: None"]),
])
def test_graph_errors(spark, forks, confusable, problem):
    from twinsift import schemas
    row = (confusable, "r", "s", forks, "n", "n", "m", "m", True, False, None)
    df = spark.createDataFrame([(row,)], f"graph {schemas.GRAPH}")
    assert df.select(gates.graph_errors(c("graph")).alias("e")).first()["e"] == problem


def test_missing_key_ends_the_check(spark):
    from twinsift import schemas
    row = (True, None, "s", [], "n", "n", "m", None, True, False, None)
    df = spark.createDataFrame([(row,)], f"graph {schemas.GRAPH}")
    assert df.select(gates.graph_errors(c("graph")).alias("e")).first()["e"] == [
        "missing key: confusable_reason", "missing key: management_b"]


@pytest.mark.parametrize("said, result", [
    ("What now", ("What now.", False)), ("Are you sure...", ("Are you sure", False)), ("Really?", ("Really?", False)),
    ("It is RUST", ("fallback", True)), ("", ("fallback", True)), ("  ", (".", False)), (None, ("fallback", True)),
])
def test_farmer_line(spark, said, result):
    made = items.farmer_line(F.lit(said).cast("string"), lit("fallback"), F.array(lit("Rust"), lit("")))
    assert tuple(value(spark, made)) == result


def image_rows(spark, n=2000):
    return spark.range(n).select(
        c("id").alias("row_id"), F.concat(F.lit("i"), F.floor(c("id") / 2).cast("string")).alias("img"),
        F.concat(F.lit("s"), (c("id") % 30).cast("string")).alias("state"),
        F.concat(F.lit("c"), (c("id") % 20).cast("string")).alias("crop"))


def test_splits_partition_the_images(spark):
    rows = image_rows(spark)
    made = splits.assign_splits(rows, seed=1)
    assert made.filter("split = 'test_heldout_region'").select("state").distinct().count() == 6
    held = [r["crop"] for r in splits.held_out_crops(rows, 1).collect()]
    assert len(held) == 2
    collapsed = splits.collapse_splits(made)
    assert collapsed.count() == 2000
    assert splits.split_leaks(collapsed).count() == 0
    assert splits.split_leaks(made).count() > 0


def test_splits_do_not_depend_on_partitioning(spark):
    def bag(df):
        return sorted(map(tuple, splits.assign_splits(df, seed=3).select("row_id", "split").collect()))

    rows = image_rows(spark, 400)
    assert bag(rows) == bag(rows.repartition(13).orderBy(F.desc("row_id")))


def test_label_gate_uses_the_name_before_renaming_and_is_idempotent(spark):
    rows = spark.createDataFrame([("1", "Tomatoe", "rust", "Tomatoe"), ("2", "Tomatoe", "scab", "Tomatoe"),
                                  ("3", "TOTAL", "rust", "TOTAL"), ("4", "Corn", "rust", "Corn")],
                                 "img string, crop string, disease string, host_common string")
    from twinsift import schemas
    report = spark.createDataFrame(
        [("Tomatoe", ("MISSPELLED_OR_UNSTANDARDISED", " Tomato "), (False, [("scab", "INCORRECT", "")])),
         ("TOTAL", ("INVALID", "TOTAL"), (True, None)),
         ("Corn", ("VALID", "Corn"), (False, [("rust", "QUESTIONABLE", "")]))], schemas.LABEL_REPORT)
    once = gates.label_gate(rows, report)
    assert sorted(map(tuple, once.select("img", "crop", "host_common").collect())) == [
        ("1", "Tomato", "Tomato"), ("4", "Corn", "Corn")]
    twice = gates.label_gate(once, report)
    assert sorted(map(tuple, twice.collect())) == sorted(map(tuple, once.collect()))
    assert gates.label_gate(rows, report, drop_questionable=True).count() == 1
    assert gates.label_gate(rows, None) is rows


def test_pairs_are_unordered_and_missing_states_count_as_one(spark):
    rows = spark.createDataFrame(
        [(i, "", "c", d, "", "rust virus" if d == "b" else "rust", "Symptoms") for i, d in enumerate("aaabbbccc")],
        "row_id long, state string, crop string, disease string, path_sci string, path_common string, "
        "descriptor string")
    got = {(r["member_a"], r["member_b"]): r["lookalike_prior"] for r in mining.mine_pairs(rows, 3).collect()}
    assert got == {("a", "b"): 1.1, ("a", "c"): 3.1, ("b", "c"): 1.1}


WHOLE = {"confusable": True, "confusable_reason": "r", "shared_presentation": "s", "forks": [
    {"axis": "habit", "question": "q", "a_signal": "a", "b_signal": "b", "weight": w}
    for w in ("weak", "decisive", "supporting")], "narrative_a": "a", "narrative_b": "b", "management_a": "a",
    "management_b": "b", "geo_localizable_a": True, "geo_localizable_b": False}


def first_fork(**changes):
    return {**WHOLE, "forks": [{**WHOLE["forks"][0], **changes}, *WHOLE["forks"][1:]]}


@pytest.mark.parametrize("doc,problems", [
    (WHOLE, []),
    ([WHOLE], ["graph is not an object"]), ("graph", ["graph is not an object"]), (None, ["graph is not an object"]),
    ({k: v for k, v in WHOLE.items() if k not in ("forks", "management_b")},
     ["missing key: forks", "missing key: management_b"]),
    ({**WHOLE, "confusable": "yes"}, ["confusable must be bool"]),
    ({**WHOLE, "confusable": None, "forks": WHOLE["forks"][:1] * 3}, ["confusable must be bool"]),
    ({**WHOLE, "confusable": 1, "forks": WHOLE["forks"][:1] * 3},
     ["confusable must be bool", "need exactly 1 decisive fork, found 0"]),
    ({**WHOLE, "confusable": 0, "forks": WHOLE["forks"][:1] * 3}, ["confusable must be bool"]),
    ({**WHOLE, "confusable_reason": None}, []), ({**WHOLE, "confusable_reason": 3}, []),
    ({**WHOLE, "confusable_reason": " "}, ["confusable_reason empty"]),
    ({**WHOLE, "forks": {"axis": 1}}, ["forks must be a list of 3..7 items", "need exactly 1 decisive fork, found 0"]),
    ({**WHOLE, "forks": None}, ["forks must be a list of 3..7 items", "need exactly 1 decisive fork, found 0"]),
    ({**WHOLE, "forks": ["x", 3, *WHOLE["forks"][1:]]}, ["fork[0] not an object", "fork[1] not an object"]),
    (first_fork(axis=None), ["fork[0].axis invalid: None"]), (first_fork(axis=True), ["fork[0].axis invalid: True"]),
    (first_fork(weight=3), ["fork[0].weight invalid: 3"]), (first_fork(axis="it's"), ['fork[0].axis invalid: "it\'s"']),
    (first_fork(question=None), []), (first_fork(question="\n"), ["fork[0].question empty"]),
    ({**WHOLE, "geo_localizable_b": "no", "geo_localizable_a": None},
     ["geo_localizable_a must be bool", "geo_localizable_b must be bool"]),
])
def test_document_errors(spark, doc, problems):
    df = spark.createDataFrame([(json.dumps(doc),)], "doc string").select(F.parse_json("doc").alias("doc"))
    assert df.select(gates.document_errors(F.col("doc")).alias("e")).first()["e"] == problems


def test_range_facets_and_verdict(spark):
    rows = ([("x", "A", "e", None)] * 40 + [("x", "US", "n", "Ohio")] * 30 + [("x", "US", "n", "n/a")] * 2
            + [("x", "B", "n", None)] * 2 + [("x", None, "", " ")] + [("y", "A", "e", "")])
    df = spark.createDataFrame(rows, "name string, country string, continent string, us_state string")
    facets = {(r["name"], r["facet"], r["value"]): r["n"] for r in ranges.facet_counts(df).collect()}
    assert facets == {("x", "total", ""): 75, ("x", "country", "A"): 40, ("x", "country", "US"): 32, ("x", "country", "B"): 2,
                      ("x", "continent", "e"): 40, ("x", "continent", "n"): 34, ("x", "us_state", "Ohio"): 30,
                      ("x", "us_state", " "): 1, ("y", "total", ""): 1, ("y", "country", "A"): 1, ("y", "continent", "e"): 1}
    profiles = ranges.range_profiles(ranges.facet_counts(df)).selectExpr(
        "*", "'ok' AS status", "'EXACT' AS match_type", "1 AS usage_key", "'SPECIES' AS rank", "false AS generalist")
    got = {r["name"]: r for r in ranges.classify_ranges(profiles, top=2).collect()}
    x = got["x"]
    assert (x["n_countries"], x["eff_countries"], x["n_continents"], x["restriction_class"]) == (3, 2, 2, "localized")
    assert [tuple(c) for c in x["top_countries"]] == [("A", 40), ("US", 32)]
    assert got["y"]["restriction_class"] == "data_poor" and got["y"]["n_us_states"] == 0
    assert ranges.range_profiles(ranges.facet_counts(df.limit(0))).count() == 0


def test_prompt_rows(spark):
    """Prompts from joined columns: missing names, empty lists, the caller's wording."""
    member = ("struct<disease:string,n_imgs:bigint,pathogen_class:string,"
              "descriptors:array<struct<name:string,n:bigint>>,sci_name:string>")
    rows = spark.createDataFrame(
        [("corn", ("rust", 3, "fungal", [("leaf", 2), ("spots", 1)], None), ("smut", 4, "fungal", None, "Ustilago"),
          [], ["South"])],
        f"crop string, member_a {member}, member_b {member}, shared_descriptors array<string>, "
        "shared_regions array<string>")
    assert rows.select(prompts.graph_context(rows)).first()[0] == (
        "CROP: corn\nMEMBER_A: rust (scientific: n/a; class: fungal; 3 images; descriptors: leaf, spots)\n"
        "MEMBER_B: smut (scientific: Ustilago; class: fungal; 4 images; descriptors: )\n"
        "regions of both: South\nshared image descriptors: none")
    people = spark.createDataFrame([("plain", "B1", "low", "none")],
                                   "personality string, language_proficiency string, recall string, confusion string")
    assert people.select(prompts.persona_behaviour({"recall": {"low": "You forget dates."}})).first()[0] == (
        "personality: plain\nlanguage_proficiency: B1\nYou forget dates.\nconfusion: none")
    images = spark.createDataFrame([("corn", "rust"), ("corn", "blight"), ("corn", "rust")], "crop string, disease string")
    assert [tuple(r) for r in prompts.label_question(images).collect()] == [
        ("corn", "Crop: corn\n\nDiseases:\n- blight\n- rust")]
    assert prompts.label_question(images.limit(0)).count() == 0


def test_one_verdict_table_for_both_levels(spark):
    """Bad crops judge no diseases, a null disease is no class, rows of other crops stay."""
    verdict = "struct<disease:string,verdict:string,reason:string>"
    report = spark.createDataFrame(
        [("a", ("VALID", "a"), (False, [("x", "INCORRECT", ""), (None, "INCORRECT", "")])),
         ("b", ("INVALID", "b"), (False, [("x", "INCORRECT", "")])), (None, ("INVALID", None), None),
         ("c", ("VALID", "c"), (True, None))],
        f"crop string, crop_validation struct<verdict:string,canonical_name:string>, "
        f"disease_check struct<skipped:boolean,disease_verdicts:array<{verdict}>>")
    rows = spark.createDataFrame([(c, d, c) for c in ("a", "b", "c", "d", None) for d in ("x", None)],
                                 "crop string, disease string, host_common string")
    got = {(r["crop"], r["disease"]): r["gate_status"] for r in gates.judge_rows(rows, report).collect()}
    want = {(c, d): "kept" for c in ("a", "b", "c", "d", None) for d in ("x", None)}
    want |= {("a", "x"): "incorrect_disease", ("b", "x"): "bad_crop", ("b", None): "bad_crop"}
    assert got == want
