"""File sources and sinks: whole-text corpora, chunk records, manifests."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_META = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("source", T.StringType()), T.StructField("chunk_id", T.StringType()), T.StructField("parent_id", T.StringType()),
    T.StructField("document_id", T.StringType()), T.StructField("source_file", T.StringType()), T.StructField("token_count", T.IntegerType()),
])
RECORD = T.StructType([T.StructField("text", T.StringType()), T.StructField("metadata", _META)])
#: Characters that end a line; source folders and what they hold.
BREAKS = "\n\r\x0b\x0c\x1c\x1d\x1e\u0085\u2028\u2029"
KINDS = {"pdf_to_txt": "pdf_text", "wiki": "wikipedia"}


def write_texts(rows: DataFrame, path: str) -> None:
    """Texts (path, text) as a bundle: JSON lines of a text's path and what its file would hold, in files as large as tasks make them.

    A file for each text costs its making, naming and listing, whatever it holds. A null text is an empty file.
    """
    rows.select("path", F.coalesce("text", F.lit("")).alias("text")).write.json(path)


def bundle(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of the texts written by write_texts, of any length; a broken line is an error."""
    return spark.read.schema("path string, text string").options(mode="FAILFAST", pathGlobFilter="*.json", recursiveFileLookup=True, maxStringLen=2**31 - 1).json(path)


def texts(spark: SparkSession, path: str, root: str = "data/raw/", bundled: bool = False) -> DataFrame:
    """One row per text file, or per text of a bundle: path from root on, folder's kind, name (file name with blanks), text."""
    rows = bundle(spark, path) if bundled else spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.txt").select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    rows = rows.select(F.col("path").alias("p"), "text")
    inside = F.when(F.contains("p", F.lit(root)), F.concat(F.lit(root), F.substring_index("p", root, -1))).otherwise(F.substring_index("p", "/", -1))
    folder = F.element_at(F.split("p", "/"), -2)
    name = F.replace(F.regexp_replace(F.substring_index("p", "/", -1), r"\.txt$", ""), F.lit("_"), F.lit(" "))
    return rows.select(inside.alias("path"), F.when(folder == "pdf_to_txt", "pdf").otherwise("wiki").alias("source"), name.alias("name"), "text")


def records(spark: SparkSession, path: str) -> DataFrame:
    """Chunk or parent records written by write_records, any depth of folders."""
    rows = spark.read.schema(RECORD).json(path, recursiveFileLookup=True, pathGlobFilter="*.json", multiLine=False)
    return rows.select("metadata.*", "text")


def write_records(rows: DataFrame, path: str) -> None:
    """Records as JSON lines in a folder for each name. Files are as large as tasks make them, not one a record."""
    fields = [(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in _META]
    rows.select("text", F.struct(*fields).alias("metadata"), F.col("name").alias("folder")).write.mode("overwrite").partitionBy("folder").json(path)


def empty_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content) of text files without a byte, which file scans leave out: what Spark lists but doesn't scan.

    The listing is Spark's own and runs as a job where there are many folders; it asks no file for its owner or rights.
    """
    found = spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter="*.txt").load(path)
    plain = lambda p: re.sub(r"^file:/+", "file:/", p)
    listed = spark.createDataFrame([(plain(unquote(p)),) for p in found.inputFiles()], "path string")
    scanned = found.select(F.regexp_replace("path", "^file:/+", "file:/").alias("path"))
    return listed.join(scanned, "path", "left_anti").select("path", F.lit(0).cast("long").alias("length"), F.lit(b"").alias("content"))


def manifest(spark: SparkSession, path: str, root: str = "data/raw/", bundled: bool = False) -> DataFrame:
    """One row per text file, or per text of a bundle: document_id, path, source_type, name, sha256, size_bytes, line_count, is_empty."""
    if bundled:
        return _listed(bundle(spark, path).select("path", F.octet_length("text").cast("long").alias("length"), F.encode("text", "UTF-8").alias("content")), root)
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(path).select("path", "length", "content").where("length > 0")
    return _listed(rows.unionByName(empty_files(spark, path)), root)


def _listed(rows: DataFrame, root: str) -> DataFrame:
    text = F.decode("content", "UTF-8")
    relative = F.when(F.contains("path", F.lit(root)), F.substring_index("path", root, -1)).otherwise(F.substring_index("path", "/", -1))
    # breaks are single characters, of which \r\n are one together
    lines = F.length(F.replace(text, F.lit("\r\n"), F.lit("\n"))) - F.length(F.translate(text, BREAKS, "")) + F.when(F.length(F.translate(F.substring(text, -1, 1), BREAKS, "")) > 0, 1).otherwise(0)
    folder = F.element_at(F.split("path", "/"), -2)
    return rows.select(
        F.substring(F.sha2(relative, 256), 1, 16).alias("document_id"), F.concat(F.lit(root), relative).alias("path"),
        F.when(folder == "pdf_to_txt", "pdf_text").otherwise("wikipedia").alias("source_type"),
        F.replace(F.regexp_replace(F.substring_index("path", "/", -1), r"\.txt$", ""), F.lit("_"), F.lit(" ")).alias("name"),
        F.sha2("content", 256).alias("sha256"), F.col("length").alias("size_bytes"), lines.cast("long").alias("line_count"), (~F.rlike(text, F.lit(r"\S"))).alias("is_empty"),
    )


def manifest_digest(rows: DataFrame) -> DataFrame:
    """One row: the hash of the manifest's rows in order of path."""
    said = F.to_json(F.struct(*sorted(rows.columns)))
    listed = rows.agg(F.array_sort(F.collect_list(F.struct("path", said.alias("j")))).alias("r"))
    return listed.select(F.sha2(F.array_join(F.transform("r", lambda x: x["j"]), "\n"), 256).alias("manifest_sha256"))


def manifest_errors(rows: DataFrame, files: DataFrame) -> DataFrame:
    """(document_id, error): repeated ids, missing paths or files, negative line counts."""
    twice = rows.groupBy("document_id").agg(F.count("*").alias("n")).where("n > 1").select("document_id", F.lit("duplicate id").alias("error"))
    pathless = rows.where("coalesce(path, '') = ''").select("document_id", F.lit("no path").alias("error"))
    missing = rows.where("coalesce(path, '') <> ''").join(files.select("path"), "path", "left_anti").select("document_id", F.lit("missing file").alias("error"))
    negative = rows.where("line_count < 0").select("document_id", F.lit("invalid line count").alias("error"))
    return twice.union(pathless).union(missing).union(negative)


def evidence_errors(evidence: DataFrame, files: DataFrame, cases: DataFrame) -> DataFrame:
    """(case_id, error): evidence outside its file's lines or without a file, answerable cases without evidence."""
    joined = evidence.join(files.select(F.col("path").alias("source_file"), "line_count"), "source_file", "left")
    lost = joined.where("line_count is null").select("case_id", F.lit("missing source").alias("error"))
    outside = joined.where("line_count is not null and (line_start < 1 or line_end > line_count)").select("case_id", F.lit("lines out of range").alias("error"))
    bare = cases.where("answerable").join(evidence.select("case_id"), "case_id", "left_anti").select("case_id", F.lit("no evidence").alias("error"))
    return lost.union(outside).union(bare)
