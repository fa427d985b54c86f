"""Fill rates, label quality and visibility reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from twinsift.operators import audit, splits
from twinsift.plans import lenses, pipeline  # noqa: F401 - pipeline states the split in SQL
from twinsift.plans import sqltext as s
from twinsift.plans.registry import query

c = F.col


def _rate(name: str, filled: str, table: str) -> str:
    return (f"SELECT '{name}' AS column_name, {filled} AS filled, count(*) AS total, "
            f"CAST(floor(100 * {filled} / count(*)) AS BIGINT) AS percent FROM {table}")


@query("fill_rates", s.with_lenses("v_geo", f"""
{_rate('lat_text', "count(*) FILTER (has_point)", 'v_geo')}
UNION ALL {_rate('county', "count(*) FILTER (row_id % 5 = 0)", 'v_geo')}
UNION ALL {_rate('state', "count(*) FILTER (false)", 'v_geo')}
UNION ALL {_rate('location', "count(location)", 'v_geo')}
UNION ALL {_rate('o_orderdate', "count(o_orderdate)", 'v_geo')}"""))
def fill_rates(t):
    return audit.fill_rates(lenses.geo_rows(t), ["lat_text", "county", "state", "location", "o_orderdate"])


@query("label_quality_summary", s.with_lenses("v_report", """
SELECT count(*) AS records, count(*) FILTER (crop_verdict = 'INVALID') AS crops_invalid,
  count(*) FILTER (crop_verdict LIKE 'MISS%') AS crops_misspelled,
  count(*) FILTER (crop_verdict = 'VALID') AS crops_valid,
  count(*) FILTER (crop_verdict <> 'INVALID') AS diseases,
  count(*) FILTER (crop_verdict <> 'INVALID' AND verdict = 'INCORRECT') AS diseases_incorrect,
  count(*) FILTER (crop_verdict <> 'INVALID' AND verdict = 'QUESTIONABLE') AS diseases_questionable FROM v_report"""))
def label_quality_summary(t):
    return audit.label_quality_summary(lenses.label_report(t))


@query("visibility_summary", s.with_lenses("v_label", """
SELECT anatomical_part, count(*) AS n_labels, count(*) FILTER (is_closeup) AS n_closeup,
  count(*) FILTER (decisive_sign_visible) AS n_visible FROM v_label GROUP BY ALL"""))
def visibility_summary(t):
    return audit.visibility_summary(lenses.visibility_labels(t))


@query("split_sizes", s.with_lenses("v_split", """
SELECT split, count(*) AS n_items, count(DISTINCT img) AS n_images FROM v_split GROUP BY ALL"""))
def split_sizes(t):
    return splits.split_sizes(splits.assign_splits(lenses.image_rows(t)))
