"""Row-local projections: one query per scalar operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinsift import dims
from twinsift import fixed_values as fv
from twinsift.functions import geo, hashing, labels, metadata, text
from twinsift.operators import items, mining
from twinsift.plans import lenses
from twinsift.plans import sqltext as s
from twinsift.plans.registry import query
from twinsift.session import scratch_path
from twinsift.sources import readers

c = F.col
BASE_URL = "https://images.example.org/images"


def _image_tree(t):
    """A folder crop=<type>/disease=<brand> with one file per class, which holds the urls of its images."""
    root = scratch_path(t.spark, "image-tree")
    (lenses.image_rows(t).select("crop", F.replace("disease", F.lit("#"), F.lit("_")).alias("disease"), "url")
     .repartition("crop", "disease").write.partitionBy("crop", "disease").text(root))
    return root


@query("scan_image_folder", s.with_lenses("v_rows", """
SELECT crop, replace(disease, '#', ' ') AS disease, CAST(sum(octet_length(encode(url)) + 1) AS BIGINT) AS n_bytes
FROM v_rows GROUP BY ALL"""))
def scan_image_folder(t):
    return readers.scan_image_tree(t.spark, _image_tree(t), extensions=[".txt"]).select(
        "crop", "disease", c("length").alias("n_bytes"))


@query("scan_crop_pruned", s.with_lenses("v_rows", """
SELECT crop, replace(disease, '#', ' ') AS disease, CAST(sum(octet_length(encode(url)) + 1) AS BIGINT) AS n_bytes
FROM v_rows WHERE crop = 'PROMO' GROUP BY ALL"""))
def scan_crop_pruned(t):
    return readers.scan_image_tree(t.spark, _image_tree(t), " Promo ", [".txt"]).select(
        "crop", "disease", c("length").alias("n_bytes"))


@query("image_paths", s.with_lenses("v_rows", """
SELECT crop || '__' || replace(disease, '#', '_') || '__s' || contributor || '_' || row_id AS img,
  url, crop, replace(disease, '#', ' ') AS disease, 's' || contributor AS photographer FROM v_rows"""))
def image_paths(t):
    return readers.image_rows(lenses.image_rows(t).select("url"), "url").select(
        "img", "url", "crop", "disease", "photographer")


@query("display_name", "SELECT p_partkey, trim(replace(p_brand, '#', ' ')) || ' ' || p_type AS shown FROM part")
def display_name(t):
    folder = F.concat(F.replace("p_brand", F.lit("#"), F.lit("_")), F.lit("_"), c("p_type"), F.lit("_"))
    return t.part.select("p_partkey", text.display_name(folder).alias("shown"))


@query("image_identity", """
SELECT p_type || '__' || p_brand || '__s' || (p_partkey % 17) || '_' || p_partkey || '.v2' AS img,
  's' || (p_partkey % 17) AS source FROM part""")
def image_identity(t):
    name = F.concat(F.lit("s"), (c("p_partkey") % 17).cast("string"), F.lit("_"),
                    c("p_partkey").cast("string"), F.lit(".v2.jpg"))
    stem = text.file_stem(name)
    return t.part.select(text.image_identity(c("p_type"), c("p_brand"), stem).alias("img"),
                         text.source_prefix(stem).alias("source"))


@query("strip_html", rf"""
SELECT page_id, trim(regexp_replace(replace(regexp_replace(html, '<[^>]+>', '', 'g'), '&nbsp;', ' '),
  '{s.SPACE}+', ' ', 'g')) AS plain FROM pages""")
def strip_html(t):
    return t.pages.select("page_id", text.strip_html(c("html")).alias("plain"))


@query("parse_location", s.with_lenses("v_geo", """
SELECT row_id, split_part(location, ', ', 1) AS country, split_part(location, ', ', 2) AS state,
  CASE WHEN contains(location, 'County') THEN n_name END AS county FROM v_geo"""))
def parse_location(t):
    place = F.concat(F.replace("location", F.lit(", "), F.lit(" ,, ")), F.lit(" , "))
    return lenses.geo_rows(t).select(
        "row_id", text.country(place).alias("country"), text.state(place).alias("state"),
        text.county(place).alias("county"))


@query("normalize_number", """
SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 OR o_orderkey % 50 = 25 THEN NULL
  ELSE round((o_orderkey % 50 - 25) / 3, 6) END AS number FROM orders""")
def normalize_number(t):
    raw = F.when(c("o_orderkey") % 9 == 0, "n/a").otherwise(
        F.concat(F.lit(" "), ((c("o_orderkey") % 50 - 25) / 3).cast("string")))
    return t.orders.select("o_orderkey", geo.number_or_missing(raw).alias("number"))


@query("orientation", """
SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'landscape' WHEN 1 THEN 'square' ELSE
  CASE WHEN p_partkey % 9 = 0 OR p_partkey % 50 = 0 THEN NULL
    WHEN p_size >= p_partkey % 50 THEN 'landscape' ELSE 'portrait' END END AS orientation FROM part""")
def orientation(t):
    view = F.when(c("p_size") % 5 == 0, " Landscape").when(c("p_size") % 5 == 1, "SQUARE").otherwise("")
    width = F.when(c("p_partkey") % 9 == 0, "n/a").otherwise(c("p_size").cast("string"))
    return t.part.select("p_partkey", text.orientation(
        view, width, (c("p_partkey") % 50).cast("string")).alias("orientation"))


@query("resolution_url", f"""
SELECT p_partkey, '{BASE_URL}/' || CASE p_size % 8 WHEN 1 THEN '192x128' WHEN 2 THEN '384x256'
  WHEN 4 THEN '1536x1024' WHEN 5 THEN '3072x2048' ELSE '768x512' END || '/' || p_partkey || '.jpg'
  AS image_url FROM part""")
def resolution_url(t):
    code = F.when(c("p_size") % 8 == 7, "large").otherwise((c("p_size") % 8).cast("string"))
    return t.part.select("p_partkey", text.image_url(
        BASE_URL, c("p_partkey").cast("string"), code).alias("image_url"))


@query("flatten_detail", f"""
SELECT CAST(event_id AS VARCHAR) AS image_number, CASE WHEN event_id % 3 = 0 THEN 'Alt ' ELSE 'Main ' END
    || event_type AS scientific_name, event_type AS common_name, 'See ' || props AS description,
  CASE WHEN event_id % 2 = 0 THEN 'portrait' ELSE 'landscape' END AS orientation,
  '{BASE_URL}/1536x1024/' || event_id || '.jpg' AS image_url, 'Country ' || user_id AS country,
  event_type AS state, CASE WHEN event_id % 5 = 0 THEN 'Lake' END AS county,
  'Country ' || user_id || ', ' || event_type || CASE WHEN event_id % 5 = 0 THEN ', Lake county' ELSE '' END AS location,
  CAST(user_id % 7 AS VARCHAR) AS category_id, 'About ' || event_type AS category_name,
  CASE WHEN value <> 0 THEN round(value, 6) END AS lat, CAST(ts AS DATE)::VARCHAR AS date_taken FROM events""")
def flatten_detail(t):
    third = c("event_id") % 3 == 0
    place = F.concat(F.lit("Country "), c("user_id").cast("string"), F.lit(", "), "event_type",
                     F.when(c("event_id") % 5 == 0, ", Lake county").otherwise(""))
    turn = c("event_id") % 4         # the place as an object with a name, or as text
    detail = F.to_json(F.struct(
        F.when(turn == 0, F.struct(place.alias("name"))).when(
            turn == 1, F.struct(F.lit(" ").alias("name"))).alias("location"),
        F.when(c("event_id") % 2 == 0, " ").otherwise(c("event_id").cast("string")).alias("imgnum"),
        c("event_id").alias("imagenumber"),
        F.when(third, "").otherwise(F.concat(F.lit(" Main "), "event_type")).alias("subjectscientificname"),
        F.concat(F.lit("Alt "), "event_type").alias("scientificname"),
        F.concat(F.lit(" "), "event_type").alias("subjectname"),
        F.concat(F.lit("<p>See&nbsp;"), "props", F.lit("</p>\n")).alias("description"),
        F.when(c("event_id") % 2 == 0, "Portrait").otherwise("").alias("view"),
        F.lit("640").alias("width"), F.lit(480).alias("height"), F.lit(4).alias("maxresolution"),
        F.when(turn != 0, place).alias("locationtext"),
        c("value").cast("string").alias("lat"),
        F.date_format("ts", "yyyy-MM-dd").alias("datetaken")))
    flat = metadata.flatten_detail(t.events, detail, BASE_URL, c("user_id") % 7,
                                   F.concat(F.lit("About "), "event_type"))
    return flat.select("category_id", "category_name", "location", "image_number", "scientific_name", "common_name", "description",
                       "orientation", "image_url", "country", "state", "county", "lat", "date_taken")


@query("parse_date", """
SELECT o_orderkey, CASE WHEN o_orderkey % 6 < 5 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END
  AS parsed FROM orders""")
def parse_date(t):
    kind, day = c("o_orderkey") % 6, c("o_orderdate")
    raw = (F.when(kind == 0, F.date_format(day, "MM/dd/yyyy"))
           .when(kind == 1, F.date_format(day, " yyyy-MM-dd "))
           .when(kind == 2, F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T10:20:30.5Z")))
           .when(kind == 3, F.date_format(day, "M/d/yy"))
           .when(kind == 4, F.date_format(day, "M/d/yyyy"))
           .otherwise(F.date_format(day, "dd.MM.yyyy")))
    return t.orders.select("o_orderkey", geo.parse_date(raw).cast("string").alias("parsed"))


@query("season", """
SELECT o_orderkey, ['winter','spring','summer','autumn'][(month(o_orderdate) % 12 // 3 +
  CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 7 <> 0 THEN 2 ELSE 0 END) % 4 + 1] AS season FROM orders""")
def season(t):
    lat = F.when(c("o_orderkey") % 7 != 0, (c("o_orderkey") % 3 - 1) * 10.0)
    return t.orders.select("o_orderkey", geo.season(F.month("o_orderdate"), lat).alias("season"))


@query("dms_to_decimal", """
SELECT p_partkey, round((p_size + (p_partkey % 60) / 60 + (p_partkey * 7 % 60) / 3600)
  * CASE WHEN p_partkey % 4 IN (1, 3) THEN -1 ELSE 1 END, 6) AS degrees FROM part""")
def dms_to_decimal(t):
    ref = F.get(F.array(*[F.lit(x) for x in "NSEW"]), (c("p_partkey") % 4).cast("int"))
    value = geo.dms_to_decimal(c("p_size"), c("p_partkey") % 60, (c("p_partkey") * 7) % 60, ref)
    return t.part.select("p_partkey", F.round(value, 6).alias("degrees"))


@query("decode_state", s.with_lenses("us_states", """
SELECT p_partkey, CASE WHEN p_partkey % 5 = 3 THEN list_aggregate(list_transform(string_split(
    lower(s.name), ' '), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ')
  WHEN p_partkey % 5 = 4 THEN NULL ELSE s.name END AS state
FROM part LEFT JOIN us_states s ON s.fips = p_size"""))
def decode_state(t):
    kind, size = c("p_partkey") % 5, c("p_size").cast("string")
    state = dims.states(t.spark).select(c("fips").alias("p_size"), c("name").alias("_name"))
    coded = (F.when(kind == 0, F.concat(F.lit("us_"), size)).when(kind == 1, F.concat(F.lit(" US_"), size))
             .when(kind == 2, size).when(kind == 3, F.lower("_name")).otherwise("zone"))
    rows = t.part.join(F.broadcast(state), "p_size", "left").select("p_partkey", coded.alias("code"))
    return mining.decode_states(rows, "code", "state").select("p_partkey", "state")


@query("state_centroid", s.with_lenses("v_rows", """
SELECT r.row_id, s.state_lat, s.state_lon FROM v_rows r LEFT JOIN us_states s ON s.name = r.state"""))
def state_centroid(t):
    rows = lenses.image_rows(t)
    odd = F.when(c("row_id") % 2 == 0, F.upper("state")).otherwise(
        F.concat(F.lit(" "), F.replace("state", F.lit(" "), F.lit(". "))))
    spelled = F.when(c("row_id") % 3 == 0, F.concat("state", F.lit("."))).otherwise(
        F.when(c("row_id") % 2 == 0, odd).otherwise(c("state")))
    return mining.state_centroids(rows.withColumn("said", spelled), "said").select(
        "row_id", "state_lat", "state_lon")


@query("census_region", s.with_lenses("v_rows", """
SELECT r.row_id, s.division, s.region FROM v_rows r LEFT JOIN us_states s ON s.name = r.state"""))
def census_region(t):
    state = dims.states(t.spark).select(c("name").alias("state"), "division", "region")
    return (lenses.image_rows(t).select("row_id", "state")
            .join(F.broadcast(state), "state", "left").select("row_id", "division", "region"))


_VECTORS = "CASE climate " + " ".join(
    f"WHEN '{k}' THEN [{', '.join(map(str, v))}]" for k, v in fv.CLIMATE_VECTORS.items()) + (
    " ELSE [0, 0, 0, 0, 0, 0] END")


@query("climate_vector", s.with_lenses("v_points", f"""
SELECT row_id, zone, {', '.join(f'CAST(v[{i}] AS DOUBLE) AS v{i}' for i in range(1, 7))}
FROM (SELECT *, {_VECTORS} AS v FROM (SELECT *, {s.zone('lat', 'lon', 2)} AS zone,
  {s.zone('lat', 'lon', 3)} AS climate FROM v_points))"""))
def climate_vector(t):
    v = lenses.zones(lenses.points(t)).withColumn("v", geo.climate_vector(c("climate")))
    return v.select("row_id", "zone", *[F.get("v", F.lit(i)).alias(f"v{i + 1}") for i in range(6)])


@query("cosine_similarity", """
SELECT a.vec_id, round(greatest(0, least(1, list_cosine_similarity(a.embedding::DOUBLE[],
  b.embedding::DOUBLE[]))), 6) AS similarity
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def cosine_similarity(t):
    following = t.embeddings.select((c("vec_id") - 1).alias("vec_id"), c("embedding").alias("other"))
    return t.embeddings.join(following, "vec_id").select(
        "vec_id", F.round(geo.cosine_similarity(c("embedding"), c("other")), 6).alias("similarity"))


@query("encode_geo_time", s.with_lenses("v_points", f"""
SELECT row_id, {', '.join(f'round(CAST(v[{i}] AS DOUBLE), 4) AS v{i}' for i in range(1, 7))},
  CASE WHEN row_id % 14 BETWEEN 1 AND 12 THEN round(sin(2 * pi() * (row_id % 14) / 12), 4) + 0.0::DOUBLE
    ELSE 0 END AS v7,
  CASE WHEN row_id % 14 BETWEEN 1 AND 12 THEN round(cos(2 * pi() * (row_id % 14) / 12), 4) + 0.0::DOUBLE
    ELSE 0 END AS v8
FROM (SELECT *, {_VECTORS} AS v FROM (SELECT *, {s.zone('lat', 'lon', 3)} AS climate FROM v_points))"""))
def encode_geo_time(t):
    v = lenses.zones(lenses.points(t)).withColumn(
        "v", geo.geo_time_vector(c("climate"), c("row_id") % 14))
    return v.select("row_id", *[
        (F.round(F.get("v", F.lit(i)), 4) + 0.0).alias(f"v{i + 1}") for i in range(8)])


@query("pathogen_class", s.with_lenses("v_rows", f"""
SELECT row_id, {s.PATHOGEN.replace('first_name', 'path_sci')} AS pathogen_class FROM v_rows"""))
def pathogen_class(t):
    return lenses.image_rows(t).select(
        "row_id", labels.pathogen_class(c("path_sci")).alias("pathogen_class"))


@query("normalize_labels", """
SELECT p_partkey, CASE WHEN p_type <> 'STANDARD' THEN lower(p_type) || ' crop' END AS crop,
  p_name AS disease FROM part""")
def normalize_labels(t):
    aliases = (t.part.select(c("p_type").alias("host_name")).distinct()
               .filter(c("host_name") != "STANDARD")
               .withColumn("crop", F.concat(F.lower("host_name"), F.lit(" crop"))))
    subject = F.concat("p_name", F.lit("  ("), F.initcap("p_brand"), F.lit(" L.)"))
    return (t.part.withColumnRenamed("p_type", "host_name").join(aliases, "host_name", "left")
            .select("p_partkey", "crop", labels.strip_parenthetical(subject).alias("disease")))


@query("clean_display", """
SELECT p_partkey, CASE WHEN p_partkey % 5 = 2 THEN p_name || ' x' ELSE p_name END AS shown FROM part""")
def clean_display(t):
    kind, name = c("p_partkey") % 5, c("p_name")
    raw = (F.when(kind == 0, F.concat(F.lit("Genus  "), name))
           .when(kind == 1, F.concat(name, F.lit(" (Ehrenb.) Vuill.")))
           .when(kind == 2, F.concat(name, F.lit("  x (Abc def.) ")))
           .when(kind == 3, F.concat(name, F.lit(" De Not. Sacc.")))
           .otherwise(F.concat(F.replace(name, F.lit(" "), F.lit("   ")), F.lit(" Verkley & U. Braun"))))
    return t.part.select("p_partkey", labels.clean_display(raw).alias("shown"))


_WORDS = rf"string_split_regex({s.strip('text')}, '{s.SPACE}+')"


@query("organism", rf"""
SELECT doc_id, lower(w[1]) AS genus, CASE WHEN regexp_matches(w[2], '\A\p{{Ll}}') THEN lower(w[2]) ELSE '' END
  AS species FROM (SELECT doc_id, {_WORDS} AS w FROM documents)""")
def organism(t):
    return t.documents.select("doc_id", labels.genus(c("text")).alias("genus"),
                              labels.species(c("text")).alias("species"))


def _neighbours(t):
    part = t.part.select("p_partkey", "p_name", "p_brand", "p_type")
    other = part.select((c("p_partkey") - 1).alias("p_partkey"), c("p_name").alias("other_name"),
                        c("p_brand").alias("other_brand"))
    return part.join(other, "p_partkey")


@query("same_organism", """
SELECT p.p_partkey, CASE WHEN p.p_partkey % 4 = 0 THEN split_part(p.p_name, ' ', 1) = split_part(q.p_name, ' ', 1)
  WHEN p.p_partkey % 4 = 1 THEN p.p_name LIKE split_part(q.p_name, ' ', 1) || ' ' || substr(split_part(q.p_name, ' ', 2), 1, 5) || '%'
  ELSE p.p_partkey % 4 = 2 END AS same_organism
FROM part p JOIN part q ON q.p_partkey = p.p_partkey + 1""")
def same_organism(t):
    kind = c("p_partkey") % 4
    a = F.when(kind == 0, F.split_part("p_name", F.lit(" "), F.lit(1))).when(kind == 1, c("p_name")).when(
        kind == 2, F.concat(F.lit("Phomopsis "), F.split_part("p_name", F.lit(" "), F.lit(2)))).otherwise("")
    b = F.when(kind == 2, F.concat(F.lit("Diaporthe "), F.initcap("other_name"))).otherwise(c("other_name"))
    return _neighbours(t).select("p_partkey", labels.same_organism(a, b).alias("same_organism"))


@query("pair_key", f"""
SELECT p.p_partkey, {s.pair_id("p.p_type || ' é!'", 'p.p_brand', "q.p_brand || ' (x)'")} AS pair_id,
  least(p.p_brand, q.p_brand || ' (x)') AS member_a FROM part p JOIN part q ON q.p_partkey = p.p_partkey + 1""")
def pair_key(t):
    crop = F.concat("p_type", F.lit(" é!"))
    other = F.concat("other_brand", F.lit(" (x)"))
    return _neighbours(t).select("p_partkey", text.pair_id(crop, c("p_brand"), other).alias("pair_id"),
                                 F.least("p_brand", other).alias("member_a"))


@query("organ_bucket", """
SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'leaf' WHEN 1 THEN 'fruit' WHEN 2 THEN 'sign'
  WHEN 3 THEN 'whole' WHEN 4 THEN 'other' WHEN 5 THEN '' ELSE p_name END AS bucket FROM part""")
def organ_bucket(t):
    kind = c("p_partkey") % 7
    descriptor = (F.when(kind == 0, "Foliage ").when(kind == 1, "Fruit(s)").when(kind == 2, "Sexual Spore")
                  .when(kind == 3, "Plant(s)").when(kind == 4, "").when(kind == 5, " ")
                  .otherwise(F.upper("p_name")))
    return t.part.select("p_partkey", labels.organ_bucket(descriptor).alias("bucket"))


@query("classify_source", f"""
SELECT page_id, {s.first_rule("replace(replace(url, 'blog.', 'ipm.'), 'example.org', 'example.edu')",
                              fv.SOURCE_TYPE_RULES, 'other')} AS shipped_rules,
  CASE WHEN contains(url, '.org') THEN 'university' WHEN contains(url, '.net') THEN 'extension'
    WHEN contains(url, '//m.') THEN 'gov' ELSE 'other' END AS own_rules FROM pages""")
def classify_source(t):
    url = F.replace(F.replace("url", F.lit("blog."), F.lit("ipm.")), F.lit("example.org"), F.lit("example.edu"))
    own = ((".org", "university"), (".net", "extension"), ("//m.", "gov"))
    return t.pages.select("page_id", text.source_type(url).alias("shipped_rules"),
                          text.source_type(c("url"), own).alias("own_rules"))


_SIGN_SQL = s.head_sign("instruction", """(SELECT doc_id, CASE doc_id % 5
  WHEN 0 THEN 'Look closely with a lens for ' || text WHEN 1 THEN 'Flip the leaf over, and ' || text
  WHEN 2 THEN ' Under side : ' || text WHEN 3 THEN text || ': ' || lang ELSE text END AS instruction
  FROM documents)""")


@query("lay_sign", f"SELECT doc_id, sign FROM ({_SIGN_SQL})")
def lay_sign(t):
    kind = c("doc_id") % 5
    instruction = (F.when(kind == 0, F.concat(F.lit("Look closely with a lens for "), "text"))
                   .when(kind == 1, F.concat(F.lit("Flip the leaf over, and "), "text"))
                   .when(kind == 2, F.concat(F.lit(" Under side : "), "text"))
                   .when(kind == 3, F.concat("text", F.lit(": "), "lang")).otherwise(c("text")))
    return t.documents.select("doc_id", text.head_sign(instruction).alias("sign"))


@query("strip_and_lower_first", f"SELECT doc_id, {s.lower_first(s.strip_tail('text'))} AS line FROM documents")
def strip_and_lower_first(t):
    return t.documents.select("doc_id", text.lower_first(text.strip_tail(c("text"))).alias("line"))


@query("clean_management", f"""
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN {s.strip('text')} ELSE lang || ' x: ' || {s.strip('text')} END
  AS management FROM documents""")
def clean_management(t):
    raw = F.when(c("doc_id") % 3 == 0, F.concat(F.lit(" "), "lang", F.lit(" : "), "text")).otherwise(
        F.concat("lang", F.lit(" x: "), text.strip(c("text"))))
    return t.documents.select("doc_id", text.clean_management(
        raw, F.concat(F.upper("lang"), F.lit(" "))).alias("management"))


_DIGEST = "sha1('20260613|' || img)"
_MOD = "0"
for _w in range(5):
    _MOD = f"(({_MOD}) * 4294967296 + CAST('0x' || substr(h, {1 + 8 * _w}, 8) AS BIGINT)) % 37"


@query("assign_bucket", s.with_lenses("v_rows", f"""
SELECT img, CAST({_MOD} AS BIGINT) AS position FROM (SELECT img, {_DIGEST} AS h FROM v_rows)"""))
def assign_bucket(t):
    key = F.concat(F.lit(f"{fv.DEFAULT_SEED}|"), "img")
    return lenses.image_rows(t).select("img", hashing.digest_modulo(key, fv.N_PERSONAS).alias("position"))


@query("persona_dim", s.with_lenses("personas v_rows", f"""
SELECT id AS persona_id, personality, count(*) AS n_images FROM personas JOIN (
  SELECT {_MOD} AS position FROM (SELECT {_DIGEST} AS h FROM v_rows)) USING (position) GROUP BY ALL"""))
def persona_dim(t):
    return (items.assign_persona(lenses.image_rows(t).select("img"), "img")
            .groupBy("persona_id", "personality").agg(F.count("*").alias("n_images")))


@query("genus_of", "SELECT p_partkey, split_part(p_name, ' ', 1) AS genus FROM part")
def genus_of(t):
    return t.part.select("p_partkey", labels.genus(F.concat(F.lit("  "), F.initcap("p_name"))).alias("genus"))


@query("parse_json_reply", """
SELECT event_id, CASE WHEN event_id % 4 < 3 THEN CAST(regexp_extract(props, '[0-9]+') AS BIGINT) ELSE -1 END
  AS k FROM events""")
def parse_json_reply(t):
    kind = c("event_id") % 4
    reply = (F.when(kind == 0, F.concat(F.lit("```JSON\n"), "props", F.lit("\n```")))
             .when(kind == 1, F.concat(F.lit("The answer is\n"), "props", F.lit(" as asked.")))
             .when(kind == 2, F.concat("props", F.lit("\n"))).otherwise(F.lit("no {answer} here")))
    k = F.try_variant_get(text.json_reply(reply), "$.k", "bigint")
    return t.events.select("event_id", F.coalesce(k, F.lit(-1)).alias("k"))


@query("leak_flag", f"""
SELECT conv_id, turn, {s.strip('c.text')} = '' OR contains(lower(c.text), lower(b.text))
  OR contains(lower(c.text), lower(split_part(b.text, ' ', 3))) AS leaks
FROM conversations c JOIN benchmark b ON b.item_id = c.conv_id % (SELECT count(*) FROM benchmark)""")
def leak_flag(t):
    banned = F.array(c("b_text"), F.lit(""), F.split_part("b_text", F.lit(" "), F.lit(3)))
    b = t.benchmark.select(c("item_id").alias("_key"), c("text").alias("b_text"))
    return (t.conversations.withColumn("_key", c("conv_id") % t.benchmark.count()).join(b, "_key")
            .select("conv_id", "turn", text.leaks(c("text"), banned).alias("leaks")))


@query("format_features", s.with_lenses("v_cells", f"""
SELECT layer, row, col, CASE WHEN value <> -9999 THEN round(value, 3) END AS value_out,
  {s.array_of(fv.KOPPEN_CODES.values())}[(row + col) % 31] AS koppen_code,
  substr({s.array_of(fv.KOPPEN_CODES.values())}[(row + col) % 31], 1, 1)
    AS koppen_major FROM v_cells"""))
def format_features(t):
    code = dims.koppen(t.spark).select(c("class_id").alias("_k"), "koppen_code")
    value = F.when(c("value") != c("nodata"), F.round("value", 3))
    return (lenses.cells(t).withColumn("_k", (c("row") + c("col")) % 31)
            .join(F.broadcast(code), "_k", "left")
            .select("layer", "row", "col", value.alias("value_out"), "koppen_code",
                    F.substring("koppen_code", 1, 1).alias("koppen_major")))


@query("content_key", "SELECT doc_id, sha1(CAST(doc_id AS VARCHAR)) AS cache_key FROM documents")
def content_key(t):
    return t.documents.select("doc_id", hashing.content_key(c("doc_id")).alias("cache_key"))


@query("legend_dims", s.with_lenses("us_states", f"""
SELECT legend, code, label, count(DISTINCT p_partkey) AS n_parts FROM (
  SELECT 'fips_state' AS legend, CAST(fips AS VARCHAR) AS code, name AS label FROM us_states
  UNION ALL SELECT 'koppen', CAST(i AS VARCHAR), k FROM (
    SELECT unnest({s.array_of(fv.KOPPEN_CODES.values())}) AS k,
      unnest(range(1, 31)) AS i)
  UNION ALL SELECT * FROM (VALUES {', '.join(f"('land_cover', '{k}', '{v}')" for k, v in fv.LAND_COVER.items())}))
JOIN part ON code = CAST(p_size AS VARCHAR) GROUP BY ALL"""))
def legend_dims(t):
    sized = t.part.groupBy(c("p_size").cast("string").alias("code")).agg(F.count("*").alias("n_parts"))
    return dims.legend(t.spark).join(sized, "code").select("legend", "code", "label", "n_parts")
