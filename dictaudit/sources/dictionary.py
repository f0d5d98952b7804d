"""Dictionary sources (S1–S6): XML segments, entry CSVs, embedding maps, candidate-pair CSVs.

All readers take explicit schemas (no inference) and return the entry model
``id string, preferred_name string, definition string`` plus ``segment`` / ``seq`` / ``kind`` where
the source defines them.
"""

from __future__ import annotations

import csv
import logging
import os
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed_values as fv
from ..functions import text as TX
from ..session import materialize

log = logging.getLogger(__name__)

_LABELS = T.StructType([T.StructField("label", T.ArrayType(T.StructType([T.StructField("_VALUE", T.StringType())])))])
_TEXTS = T.StructType([T.StructField("text", T.ArrayType(T.StructType([T.StructField("_VALUE", T.StringType())])))])
XML_SCHEMA = T.StructType([
    T.StructField("_id", T.StringType()),
    T.StructField("_xsi:type", T.StringType()),
    T.StructField("preferred_name", _LABELS),
    T.StructField("definition", _TEXTS),
    T.StructField("_corrupt_record", T.StringType()),
])

ENTRY_SCHEMA = "id string, preferred_name string, definition string"


def _blank_to_null(c):
    s = TX.ustrip(c)
    return F.when(s != "", s)


def scan_xml_records(spark: SparkSession, path: str, row_tag: str = "ontoml:class") -> DataFrame:
    """One row per element ``row_tag`` of the UTF-8 XML files under ``path``: the parsed element ``r``, its
    ``xml``, ``error`` (null for a good element) and where it lies (``file``, ``block``, ``row``, ``part``).

    Files are split by bytes, at the elements' end tags, so one large file is read by many tasks. Every
    element is parsed by itself: a malformed one, or one without its end, is a row with an error, and the
    elements after it are not lost. An end tag inside a comment or a CDATA section ends an element there.
    """
    tag = re.escape(row_tag)
    end = f"</{row_tag}>"
    lines = spark.read.option("lineSep", end).text(path).select(
        F.split("value", rf"(?=<{tag}[\s/>])").alias("parts"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    # what comes before the first start tag is no element
    starts = lines.select("file", "block", "row", F.size("parts").alias("n"), F.posexplode("parts").alias("part", "xml")).where(
        F.col("xml").rlike(rf"^<{tag}[\s/>]"))
    alone = F.regexp_extract("xml", rf"^<{tag}(\s[^<>]*)?/>", 0)
    whole = F.when(alone != "", alone).when(F.col("part") == F.col("n") - 1, F.concat("xml", F.lit(end)))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record", "rowTag": row_tag}
    parsed = starts.withColumn("whole", whole).withColumn("r", F.from_xml("whole", XML_SCHEMA, options))
    error = F.when(F.col("whole").isNull(), "no end tag").when(F.col("r").isNull() | F.col("r._corrupt_record").isNotNull(), "malformed")
    return parsed.select("r", "xml", error.alias("error"), "file", "block", "row", "part")


def xml_losses(spark: SparkSession, path: str, row_tag: str = "ontoml:class") -> DataFrame:
    """Loss accounting of S1: (segment, file, block, error, beginning) of every element that cannot be read."""
    found = scan_xml_records(spark, path, row_tag).where("error is not null")
    return found.select(_segment().alias("segment"), "file", "block", "error", F.substring("xml", 1, 200).alias("beginning"))


def _segment():
    """The last SG_<n> in the path: a segment file name or a segment directory."""
    found = F.regexp_extract("file", fv.SEGMENT_FILE_PATTERN + r"(?!.*SG_\d)", 1)
    return F.when(found != "", found.cast("int"))


def read_dictionary_xml(spark: SparkSession, path: str, mode: str | None = "classes", row_tag: str = "ontoml:class",
                        exclude_segments: list[int] | None = None) -> DataFrame:
    """S1 + S2 + P2: every element ``row_tag`` of the XML files under ``path``, kept when its
    ``xsi:type`` is the mode's type and it has an id; first label and first text, stripped, empty →
    null. ``segment`` comes from the file name (``SG_<n>``), ``seq`` is the position in the scan
    (file block, then row), so "first occurrence" keeps the document order. Elements that cannot be read are
    left out; :func:`xml_losses` lists them. Without a mode (U6) both kinds are read in one plan; ``kind`` tells which.
    """
    records = scan_xml_records(spark, path, row_tag).where("error is null")
    kinds = fv.XML_TYPE_BY_MODE if mode is None else {mode: fv.XML_TYPE_BY_MODE[mode]}
    kind = F.coalesce(*[F.when(F.col("r").getField("_xsi:type") == t, m) for m, t in kinds.items()])
    df = records.select(
        F.col("r._id").alias("id"), _blank_to_null(F.get(F.col("r.preferred_name.label"), 0)["_VALUE"]).alias("preferred_name"),
        _blank_to_null(F.get(F.col("r.definition.text"), 0)["_VALUE"]).alias("definition"), _segment().alias("segment"),
        F.struct("file", "block", "row", "part").alias("seq"), kind.alias("kind")).where("kind is not null and id is not null")
    if exclude_segments:
        df = df.filter(~F.col("segment").isin(list(exclude_segments)) | F.col("segment").isNull())
    return df


def normalised_columns(columns: list[str]) -> dict[str, str]:
    """Map raw CSV headers to ``id / preferred_name / definition``; error on a clash or when no
    definition column exists."""
    mapping: dict[str, str] = {}
    for c in columns:
        role = TX.header_role(TX.normalise_header(c))
        if role is None:
            continue
        if role in mapping.values():
            raise ValueError(f"two columns map to {role!r}: {columns}")
        mapping[c] = role
    if "definition" not in mapping.values():
        raise ValueError(f"column 'definition' not found; columns: {columns}")
    return mapping


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """The records (file, header, record) of the quoted UTF-8 CSV files under ``path``, one text a record, also where
    quoted fields hold line breaks, in the order of the file. Files are split by bytes, so one large file is read by many tasks:

    a line is inside a quoted field when the quotes before it in its file are odd in number. The parity of
    each byte range is counted first; sums over the ranges before then tell where every range begins, and
    with that which lines start records. Lines that are whole records are done; only the lines of
    records of several lines are brought together, by the place of the record's first line.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    odd = (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ranges = lines.groupBy("file", "block").agg(F.sum(odd).alias("odd")).select(
        "file", "block", (F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2).alias("open"))
    inside = Window.partitionBy("file", "block").orderBy("row")
    before = F.coalesce(F.sum(odd).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("open")
    placed = lines.join(ranges, ["file", "block"]).withColumn("starts", before % 2 == 0).withColumn("whole", F.col("starts") & (odd == 0))
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("start", F.last(F.when(F.col("starts"), F.struct("block", "row")), ignorenulls=True).over(so_far)).withColumn(
        "head", (F.col("block") == 0) & (F.row_number().over(inside) == 1))
    placed = materialize(placed.drop("open"), "csv-lines")
    # a record that goes on from an earlier range
    lasts = placed.groupBy("file", "block").agg(F.max("start").alias("last"))
    carried = lasts.select("file", "block", F.last("last", ignorenulls=True).over(earlier).alias("carried"))
    several = placed.where(~F.col("whole")).join(carried, ["file", "block"]).groupBy("file", F.coalesce("start", "carried").alias("start")).agg(
        F.max("head").alias("head"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "row", "value"))), lambda x: x["value"]), "\n").alias("value"))
    records = placed.where("whole").select("file", "head", "start", "value").union(several.select("file", "head", "start", "value")).orderBy("file", "start")
    return records.select("file", F.col("head").alias("header"), F.regexp_replace("value", "\r$", "").alias("record")).where("record <> ''")


def _csv_table(spark: SparkSession, path: str) -> DataFrame:
    """All columns of the CSV files as strings; the files must have one header."""
    records = csv_records(spark, path)
    heads = [r.record for r in records.where("header").select("record").distinct().limit(2).collect()]
    if len(heads) != 1:
        raise ValueError(f"CSV files need one header in common, found {heads or 'none'}")
    names = next(csv.reader([heads[0].lstrip("\ufeff")]))
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    row = F.from_csv("record", schema.simpleString()[7:-1].replace(":", " "), {"escape": '"', "multiLine": "true"})
    return records.where("not header").select(row.alias("r")).select(*[F.col(f"r.c{i}").alias(n) for i, n in enumerate(names)])


def read_entries_csv(spark: SparkSession, path: str, fill_empty: bool = False,
                     na_tokens: list[str] | None = None) -> DataFrame:
    """S3/S4 + P3 + P4: entry CSV with quoted multi-line fields, all columns as strings.

    Only blank cells are null (``na_tokens`` reproduces a reader that also nulls e.g. "NA");
    ``fill_empty`` turns nulls into ``""`` (the all-strings loader). A missing name column is filled
    from the id, or ``""`` without one.
    """
    df = _csv_table(spark, path)
    mapping = normalised_columns(df.columns)
    df = df.select(*[F.col(f"`{src}`").alias(dst) for src, dst in mapping.items()])
    if "preferred_name" not in df.columns:
        df = df.withColumn("preferred_name", F.col("id") if "id" in df.columns else F.lit(""))
    if "id" not in df.columns:
        df = df.withColumn("id", F.lit(None).cast("string"))
    for c in ("id", "preferred_name", "definition"):
        col = F.col(c)
        if na_tokens:
            col = F.when(col.isin(na_tokens), F.lit(None)).otherwise(col)
        df = df.withColumn(c, col)
    if fill_empty:
        df = df.na.fill("", subset=["id", "preferred_name", "definition"])
    return df.select("id", "preferred_name", "definition")


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Fail before planning when a required column is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; have {df.columns}")
    return df


PAIR_COLUMNS = ["distance", "preferred_names_a", "text_a", "preferred_names_b", "text_b"]


def read_candidate_pairs(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """S6 + U2: candidate-pair CSVs per kind (e.g. classes, properties), unioned; a missing file is
    logged and skipped. All columns are read as strings, ``distance`` is then cast to double."""
    schema = ", ".join(f"{c} string" for c in PAIR_COLUMNS)
    parts = []
    for kind, p in paths.items():
        if not _exists(spark, p):
            log.warning("candidate file not found: %s", p)
            continue
        df = (spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema(schema).csv(p)
              .withColumn("kind", F.lit(kind)))
        parts.append(df)
    if not parts:
        return spark.createDataFrame([], schema + ", kind string").withColumn("distance", F.col("distance").cast("double"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("distance", F.col("distance").cast("double"))


def read_embedding_map(spark: SparkSession, path: str) -> DataFrame:
    """``(text string, embedding array<float>)`` from Parquet."""
    return require_columns(spark.read.parquet(path), ["text", "embedding"]).select("text", "embedding")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf).exists(p)


def path_exists(spark: SparkSession, path: str) -> bool:
    return _exists(spark, path) if "://" in path else os.path.exists(path) or _exists(spark, path)


def _xml_escape(c):
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def write_dictionary_xml(entries: DataFrame, path: str, mode: str = "classes", row_tag: str = "ontoml:class",
                         files_per_segment: int = 4, broken=None) -> str:
    """Write entries ``(id, preferred_name, definition, segment)`` as dictionary XML, one directory
    per segment (``…/SG_<n>/``), one element per line; the inverse of :func:`read_dictionary_xml`. Where the
    column ``broken`` is true the element is malformed."""
    ns = ('xmlns:ontoml="urn:iso:std:iso:is:13584:-32:ed-1:tech:xml-schema:ontoml" '
          'xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance"')
    head = F.concat(F.lit(f'<{row_tag} {ns} xsi:type="{fv.XML_TYPE_BY_MODE[mode]}" id="'), _xml_escape(F.col("id")),
                    F.lit('">'))
    name = F.when(F.col("preferred_name").isNotNull(),
                  F.concat(F.lit("<preferred_name><label>"), _xml_escape(F.col("preferred_name")),
                           F.lit("</label></preferred_name>"))).otherwise(F.lit(""))
    definition = F.when(F.col("definition").isNotNull(),
                        F.concat(F.lit("<definition><text>"), _xml_escape(F.col("definition")),
                                 F.lit("</text></definition>"))).otherwise(F.lit(""))
    line = F.concat(head, name, definition, F.lit(f"</{row_tag}>"))
    if broken is not None:
        line = F.when(broken, F.concat(head, F.lit(f"<preferred_name><label></{row_tag}>"))).otherwise(line)
    # One XML document per (segment, bucket) group: a root header row, the elements, a footer row.
    # Each group is one partition value, so one task writes it into one file, in (dir, ord) order.
    bucket = F.pmod(F.xxhash64("id"), F.lit(files_per_segment)).cast("string")
    out = entries.select(F.concat(F.lit("SG_"), F.col("segment").cast("string"), F.lit("_"), bucket).alias("dir"),
                         F.lit(1).alias("ord"), line.alias("value"))
    groups = out.select("dir").distinct()
    container = fv.XML_CONTAINER_BY_MODE[mode]
    header = (f'<?xml version="1.0" encoding="UTF-8"?><ontoml:ontoml {ns}><dictionary><{container}>')
    footer = f"</{container}></dictionary></ontoml:ontoml>"
    doc = (groups.select("dir", F.lit(0).alias("ord"), F.lit(header).alias("value"))
           .unionByName(out)
           .unionByName(groups.select("dir", F.lit(2).alias("ord"), F.lit(footer).alias("value")))
           .repartition("dir").sortWithinPartitions("dir", "ord"))
    doc.select("dir", "value").write.mode("overwrite").partitionBy("dir").text(path)
    return path
