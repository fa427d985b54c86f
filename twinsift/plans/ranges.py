"""Range facets per name."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinsift.operators import ranges
from twinsift.plans import sqltext as s
from twinsift.plans.registry import query
from twinsift.functions import labels

c = F.col


def records(t):
    """(name, country, continent, us_state): a line item's part name and its customer's nation.

    Nations are folded into the first few by the length of the name, so names differ in spread.
    """
    state = F.when(c("n_name") == "UNITED STATES", F.when(c("c_custkey") % 60 == 0, "n/a").when(
        c("c_custkey") % 60 == 1, "").otherwise(F.concat(F.lit("state "), (c("c_custkey") % 60).cast("string"))))
    return (t.lineitem.select("l_orderkey", "l_partkey")
            .join(t.part.select("p_partkey", "p_name"), c("l_partkey") == c("p_partkey"))
            .join(t.orders.select("o_orderkey", "o_custkey"), c("l_orderkey") == c("o_orderkey"))
            .join(t.customer.select("c_custkey", "c_nationkey"), c("o_custkey") == c("c_custkey"))
            .withColumn("c_nationkey", c("c_nationkey") % (1 + 4 * (F.length("p_name") % 7)))
            .join(t.nation, c("c_nationkey") == c("n_nationkey"))
            .join(t.region, c("n_regionkey") == c("r_regionkey"))
            .select(c("p_name").alias("name"), c("n_name").alias("country"), c("r_name").alias("continent"),
                    state.alias("us_state")))


def profiles(t):
    match = (F.when(c("name").startswith("cold g"), "NONE").when(c("name").startswith("cold r"), "HIGHERRANK")
             .otherwise("EXACT"))
    return (ranges.range_profiles(ranges.facet_counts(records(t)))
            .withColumn("status", F.when(c("name") == "blue rod", "failed").otherwise("ok"))
            .withColumn("match_type", match)
            .withColumn("usage_key", F.when(~c("name").startswith("dim r"), F.length("name")))
            .withColumn("rank", F.when(c("name") == "blue ring", "GENUS").otherwise("SPECIES"))
            .withColumn("generalist", c("name").startswith("red ")))


s.add_lens("v_range", """v_facet AS (
  SELECT p_name AS name, n_name AS country, r_name AS continent, count(*) AS n
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey % (1 + 4 * (length(p_name) % 7)) = n_nationkey
  JOIN region ON n_regionkey = r_regionkey GROUP BY ALL),
v_total AS (SELECT name, CAST(sum(n) AS BIGINT) AS total FROM v_facet GROUP BY ALL),
v_eff AS (SELECT name, country, n, round(n / total, 4) AS share FROM v_facet JOIN v_total USING (name)
  WHERE n >= 3 AND n / total >= 0.01),
v_range AS (SELECT t.name, total, (SELECT count(*) FROM v_facet f WHERE f.name = t.name) AS n_countries,
    (SELECT count(*) FROM v_eff e WHERE e.name = t.name) AS eff_countries,
    (SELECT count(*) FROM (SELECT continent FROM v_facet f WHERE f.name = t.name GROUP BY continent HAVING sum(n) >= 3))
      AS n_continents FROM v_total t),
v_us AS (SELECT p_name AS name, count(DISTINCT c_custkey % 60) AS n_us_states
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey % (1 + 4 * (length(p_name) % 7)) = n_nationkey
  WHERE n_name = 'UNITED STATES' AND c_custkey % 60 > 1 GROUP BY ALL),
v_top AS (SELECT name, string_agg(country || ':' || n, ', ' ORDER BY n DESC, country) AS top_countries
  FROM (SELECT * FROM v_facet QUALIFY row_number() OVER (PARTITION BY name ORDER BY n DESC, country) <= 8) GROUP BY ALL),
v_class2 AS (SELECT *, CASE WHEN name LIKE 'red %' THEN 'cosmopolitan'
    WHEN name = 'blue rod' OR name LIKE 'cold g%' OR name LIKE 'dim r%' OR name LIKE 'cold r%' OR name = 'blue ring' OR total < 30 THEN 'data_poor'
    WHEN eff_countries >= 25 OR n_continents >= 4 THEN 'cosmopolitan'
    WHEN eff_countries <= 6 AND n_continents <= 2 THEN 'localized' ELSE 'regional' END AS restriction_class
  FROM v_range)""", ())


@query("effective_countries", s.with_lenses("v_range", "SELECT name, country, n, share FROM v_eff"))
def effective_countries(t):
    return ranges.effective_countries(profiles(t))


@query("top_countries", s.with_lenses("v_range", """
SELECT name, country, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY n DESC, country) AS rank
  FROM v_facet) WHERE rank <= 8"""))
def top_countries(t):
    return ranges.top_countries(profiles(t))


@query("range_class", s.with_lenses("v_range", """
SELECT name, total, n_countries, eff_countries, n_continents, coalesce(n_us_states, 0) AS n_us_states, top_countries,
  restriction_class, CASE
  WHEN name LIKE 'red %' THEN 'named generalist' WHEN name = 'blue rod' OR name LIKE 'cold g%' OR name LIKE 'dim r%' THEN 'no reliable match'
  WHEN name LIKE 'cold r%' OR name = 'blue ring' THEN 'match only at a higher rank'
  WHEN total < 30 THEN total || ' records are too few'
  ELSE CASE restriction_class WHEN 'cosmopolitan' THEN 'present in ' WHEN 'localized' THEN 'restricted to '
    ELSE 'intermediate spread: ' END || eff_countries || ' countries / ' || n_continents || ' continents' END AS reason
FROM v_class2 LEFT JOIN v_us USING (name) JOIN v_top USING (name)"""))
def range_class(t):
    shown = F.transform("top_countries", lambda x: F.concat_ws(":", x["country"], x["n"].cast("string")))
    return ranges.classify_ranges(profiles(t)).select(
        "name", "total", "n_countries", "eff_countries", "n_continents", "n_us_states",
        F.array_join(shown, ", ").alias("top_countries"), "restriction_class", "reason")


@query("range_distribution", s.with_lenses("v_range", """
SELECT restriction_class, count(*) AS n_names, array_to_string(list_sort(list(name))[1:4], ', ') AS examples
FROM v_class2 GROUP BY ALL"""))
def range_distribution(t):
    return ranges.range_distribution(ranges.classify_ranges(profiles(t)))


@query("localizable_names", s.with_lenses("v_range", """
SELECT name, split_part(name, ' ', 1) AS genus FROM v_class2 WHERE restriction_class IN ('localized', 'regional')"""))
def localizable_names(t):
    verdicts = ranges.classify_ranges(profiles(t))
    return verdicts.filter(ranges.is_localizable(c("restriction_class"))).select(
        "name", labels.genus(c("name")).alias("genus"))
