"""Schemas of the tables the jobs read. Fixed, never inferred."""

from __future__ import annotations

IMAGE_ROWS = (
    "row_id bigint, img string, url string, cite string, state string, crop string, "
    "disease string, host_common string, host_sci string, path_sci string, path_common string, "
    "descriptor string, koppen_major string, photographer string, org string"
)

# Columns of the scraped metadata files
SCRAPED_COLUMNS = (
    "Category ID",
    "Category Name",
    "Image Number",
    "Scientific Name",
    "Common Name",
    "Subject Display Name",
    "Host Name",
    "Host Scientific Name",
    "Descriptor Name",
    "Description",
    "Photographer",
    "Organization",
    "Orientation",
    "Citation",
    "Max Resolution",
    "Image URL",
    "Location",
    "Country",
    "State",
    "County",
    "Lat",
    "Lon",
    "Date Taken",
    "Date Acquired",
)

# Columns of the county gazetteer that are used
GAZETTEER = ("USPS", "GEOID", "NAME", "INTPTLAT", "INTPTLONG")

FORK = ("struct<axis:string,question:string,a_signal:string,b_signal:string,weight:string>")
LAY = ("struct<farmer_lay_report:string,decisive_lay_a:string,decisive_lay_b:string,"
       "decisive_micro_a:boolean,decisive_micro_b:boolean>")
GRAPH = (
    f"struct<confusable:boolean,confusable_reason:string,shared_presentation:string,"
    f"forks:array<{FORK}>,narrative_a:string,narrative_b:string,management_a:string,"
    f"management_b:string,geo_localizable_a:boolean,geo_localizable_b:boolean,lay:{LAY}>"
)
GRAPH_RECORDS = (
    f"pair_id string, kind string, crop string, member_a_label string, member_b_label string, "
    f"source string, graph {GRAPH}"
)

LABEL_REPORT = (
    "crop string, crop_validation struct<verdict:string,canonical_name:string>, "
    "disease_check struct<skipped:boolean,disease_verdicts:array<struct<disease:string,"
    "verdict:string,reason:string>>>"
)

JOURNAL = "type string, result variant"

TURN = "struct<turn:string,speaker:string,text:string,has_image:boolean>"
CHAIN_STEP = "struct<step:string,cites:string,text:string>"
ITEMS = (
    "item_id string, kind string, "
    "image struct<url:string,image_number:string,attribution:string,license_note:string>, "
    "lookalike struct<pair_id:string,crop:string,true:string,distractor:string>, "
    "grounding struct<host:string,disease:string,anatomical_part:string,descriptor:string,"
    f"state:string>, split string, dialogue array<{TURN}>, cot array<{CHAIN_STEP}>, "
    "gold struct<diagnosis:string,ruled_out:string,evidence_from_image:string,"
    "management:string,answerable_from_image:boolean>"
)
