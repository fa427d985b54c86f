"""Readers for the file layouts the pipelines consume. Schemas are always given."""

from __future__ import annotations

import os
import re
import urllib.request
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from twinsift import fixed_values as fv
from twinsift import schemas
from twinsift.functions import text


def image_rows(paths: DataFrame, path: str = "path") -> DataFrame:
    """Image rows from file paths laid out as .../<Host>/<Disease>/<file>.

    Only known image extensions are kept. The id is host, disease and file stem; the stem up to
    its first underscore names the contributing source.
    """
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    stem = text.file_stem(name)
    host, disease = F.element_at(parts, -3), F.element_at(parts, -2)
    return (paths.filter((F.size(parts) >= 3)
                         & text.file_extension(name).isin(*fv.IMAGE_EXTENSIONS))
            .select(text.image_identity(host, disease, stem).alias("img"),
                    F.col(path).alias("url"), text.display_name(host).alias("crop"),
                    text.display_name(disease).alias("disease"),
                    text.source_prefix(stem).alias("photographer"),
                    F.lit("Symptoms").alias("descriptor"), host.alias("host_folder")))


def _any_case(name: str) -> str:
    """Glob pattern for a folder name or its display form, ignoring case."""
    def one(ch: str) -> str:
        if ch in " _":
            return "[ _]"
        return f"[{ch.lower()}{ch.upper()}]" if ch.isalpha() else ("\\" + ch if ch in "*?[]{}\\" else ch)
    return "".join(map(one, name.strip()))


def scan_image_folder(spark: SparkSession, root: str, crop: str | None = None) -> DataFrame:
    """List an image folder <crop>/<disease>/<file> as rows; file contents are never selected, so never read.

    With a crop, only the folders of that name are listed.
    """
    listing = (spark.read.format("binaryFile").load(f"{root}/{_any_case(crop) if crop else '*'}/*").select("path"))
    rows = image_rows(listing)
    return only_crop(rows, crop) if crop else rows


def scan_image_tree(spark: SparkSession, root: str, crop: str | None = None,
                    extensions: Sequence[str] = fv.IMAGE_EXTENSIONS) -> DataFrame:
    """The same for a tree with partition folders crop=<crop>/disease=<disease>, without contents.

    crop and disease are partition columns, so conditions on them prune folders; a crop given here
    also keeps other folders from being listed. Columns: path, length, crop, disease.
    """
    files = (spark.read.option("basePath", root).format("binaryFile")
             .load(f"{root}/crop={_any_case(crop) if crop else '*'}/*").select("path", "length", "crop", "disease"))
    if crop:
        files = files.filter(F.translate(F.lower("crop"), "_", " ") == crop.strip().lower().replace("_", " "))
    return (files.filter(text.file_extension(F.element_at(F.split("path", "/"), -1)).isin(*extensions))
            .withColumns({n: text.display_name(F.col(n)) for n in ("crop", "disease")}))


def only_crop(rows: DataFrame, crop: str) -> DataFrame:
    """Rows of one crop, by folder or display name, ignoring case."""
    wanted = crop.strip().lower()
    return rows.filter((F.lower("host_folder") == wanted) | (F.lower("crop") == wanted))


FETCH_SECONDS = 15
FETCHED_BYTES = 32 << 20        # contents handed on at a time


def _content(path: str) -> bytes | None:
    try:
        if path.startswith(("http://", "https://")):
            return urllib.request.urlopen(path, timeout=FETCH_SECONDS).read()
        if "://" not in path and not path.startswith("file:"):
            path = "file://" + os.path.abspath(path)
        store, inside = pyarrow.fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
        with store.open_input_stream(inside) as f:
            return f.read()
    except Exception:               # whatever keeps a file from being read, its content is missing
        return None


def image_bytes(locators: DataFrame) -> DataFrame:
    """Content of each located file, null where it cannot be read. `locators` has path.

    The located paths are dealt out by hash and only they are opened: nothing is listed. A
    task holds its current contents only.
    """
    rest = [c for c in locators.columns if c != "path"]
    schema = StructType([*locators.select("path", *rest).schema.fields, StructField("content", BinaryType())])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size, at = [], 0, 0
            for i, path in enumerate(batch.column(0).to_pylist()):
                held.append(_content(path) if path else None)
                size += len(held[-1] or b"")
                if size >= FETCHED_BYTES or i == batch.num_rows - 1:
                    part = batch.slice(at, len(held))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(held, pa.binary())],
                                                     names=[*part.schema.names, "content"])
                    held, size, at = [], 0, i + 1

    return locators.select("path", *rest).repartition("path").mapInArrow(fetch, schema)


def _by_header(raw: DataFrame, wanted: Sequence[str]) -> list[Column]:
    """The wanted columns by trimmed header name, whatever their order; null where absent."""
    at = {name.strip(): f"`{name}`" for name in raw.columns}
    return [(F.col(at[w]) if w in at else F.lit(None).cast("string")).alias(w) for w in wanted]


def metadata_csv(spark: SparkSession, path: str, columns: Sequence[str] = schemas.SCRAPED_COLUMNS,
                 line_breaks: bool = False) -> DataFrame:
    """Header CSV with every column as text, bound by header name.

    Missing values and absent columns are empty strings, further columns are ignored. Files split
    into many tasks unless `line_breaks` allows line ends inside quoted values.
    """
    raw = (spark.read.option("header", "true").option("inferSchema", "false")
           .option("multiLine", str(line_breaks).lower()).option("escape", '"').csv(path))
    return raw.select(*_by_header(raw, columns)).fillna("")


def gazetteer_tsv(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated Latin-1 gazetteer with the columns GAZETTEER found by header name.

    Values are trimmed, short rows have nulls. `row_id` orders rows by file and place in it.
    """
    raw = (spark.read.option("sep", "\t").option("header", "true").option("inferSchema", "false")
           .option("encoding", "ISO-8859-1").csv(path))
    place = F.struct("_metadata.file_path", "_metadata.file_block_start",
                     F.monotonically_increasing_id().alias("row"))
    rows = raw.select(*_by_header(raw, schemas.GAZETTEER), place.alias("row_id"))
    return rows.withColumns({n: text.strip(F.col(n)) for n in schemas.GAZETTEER})


def keyed_json(document: Column, value_type: str, key: str = "key",
               value: str = "value", sub_key: str | None = None) -> list[Column]:
    """Explode a JSON object keyed by id; `sub_key` names the object inside the document."""
    whole = f"map<string,{value_type}>"
    if sub_key:
        entries = F.from_json(document, f"struct<`{sub_key}`:{whole}>")[sub_key]
    else:
        entries = F.from_json(document, whole)
    return [F.explode(entries).alias(key, value)]


def graph_store(spark: SparkSession, path: str, one_per_file: bool = False) -> DataFrame:
    """Decision graph records, as JSON lines or as one pretty-printed record per file."""
    return (spark.read.schema(schemas.GRAPH_RECORDS)
            .option("multiLine", str(one_per_file).lower()).json(path))


def journal_results(lines: DataFrame, line: str = "value") -> DataFrame:
    """Object-valued results of a journal, next to the whole record; bad lines are skipped."""
    parsed = lines.select("*", F.try_parse_json(line).alias("record"))
    is_result = F.try_variant_get("record", "$.type", "string") == "result"
    body = F.try_variant_get("record", "$.result", "variant")
    return (parsed.filter(is_result & F.schema_of_variant(body).startswith("OBJECT"))
            .withColumn("result", body))


def items(spark: SparkSession, path: str) -> DataFrame:
    """Item records from JSON lines; blank lines are skipped."""
    return spark.read.schema(schemas.ITEMS).json(path)


def result_field(name: str, kind: str = "string") -> Column:
    return F.try_variant_get("result", f"$.{name}", kind)


def has_field(names: Sequence[str]) -> list[Column]:
    """One flag per name: does the result carry that key?"""
    return [F.try_variant_get("result", f"$.{n}", "variant").isNotNull() for n in names]


def parquet_stream(spark: SparkSession, path: str) -> DataFrame:
    """File stream over a parquet table, be it a folder of files or one file."""
    table = spark.read.parquet(path)
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1)
    folder, _, name = path.rstrip("/").rpartition("/")
    first = table.select("_metadata.file_path", "_metadata.file_name").first()
    if first is None or first["file_path"].rstrip("/").endswith(f"/{name}/{first['file_name']}"):
        return stream.parquet(path)
    return stream.option("pathGlobFilter", name).parquet(folder)
