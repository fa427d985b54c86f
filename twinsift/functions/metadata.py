"""Flattening of image detail records (JSON) into the scraped metadata columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsift.functions import geo, text

DETAIL = (
    "imgnum string, imagenumber string, subjectscientificname string, scientificname string, "
    "subjectname string, subjectdisplayname string, hostname string, hostscientificname string, "
    "descriptorname string, description string, photographer string, organization string, "
    "view string, imageview string, width string, height string, citation string, "
    "maxresolution string, location string, locationtext string, lat string, lon string, "
    "datetaken string, dateacquired string"
)


def flatten_detail(df: DataFrame, detail: Column, base_url: str, category_id: Column | None = None,
                   category_name: Column | None = None) -> DataFrame:
    """All columns of the detail records; alternatives are tried in order, missing stays null.

    The record is parsed once, in a projection of its own. A location may be text or an object
    with a name; the category is that of the listing the record was found in.
    """
    d = F.col("_detail")
    number = text.first_present(d["imgnum"], d["imagenumber"])
    # An object is read as its JSON text.
    named = F.from_json(d["location"], "name string, locationname string")
    given = F.when(F.startswith(F.ltrim(d["location"]), F.lit("{")),
                   text.first_present(named["name"], named["locationname"])).otherwise(d["location"])
    place = text.first_present(given, d["locationtext"])
    no = F.lit(None).cast("string")

    def same(column: str, field: str) -> Column:
        return text.present(d[field]).alias(column)

    return df.select(F.from_json(detail, DETAIL).alias("_detail"),
                     (no if category_id is None else category_id.cast("string")).alias("category_id"),
                     (no if category_name is None else category_name).alias("category_name")).select(
        "category_id", "category_name",
        number.alias("image_number"),
        text.first_present(d["subjectscientificname"], d["scientificname"]).alias("scientific_name"),
        same("common_name", "subjectname"), same("subject", "subjectdisplayname"),
        same("host_name", "hostname"), same("host_scientific_name", "hostscientificname"),
        same("descriptor", "descriptorname"),
        text.present(text.strip_html(d["description"])).alias("description"),
        same("photographer", "photographer"), same("organization", "organization"),
        text.orientation(F.coalesce(text.present(d["view"]), text.present(d["imageview"])),
                         d["width"], d["height"]).alias("orientation"),
        same("citation", "citation"), same("max_resolution", "maxresolution"),
        text.image_url(base_url, number, d["maxresolution"]).alias("image_url"),
        place.alias("location"), text.country(place).alias("country"),
        text.state(place).alias("state"), text.county(place).alias("county"),
        geo.number_or_missing(d["lat"]).alias("lat"), geo.number_or_missing(d["lon"]).alias("lon"),
        same("date_taken", "datetaken"), same("date_acquired", "dateacquired"))
