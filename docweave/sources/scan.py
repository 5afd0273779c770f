"""Folders to document rows, and what a run would do with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions.language import confident, detect, direction
from docweave.functions.text import ends_normalised
from docweave.operators.dita import detection_text
from docweave.sources.registry import Registry, default_registry, extension

MAX_BYTES = 100 << 20


class PlanError(Exception):
    """Nothing to do; ``stage`` is scan_source."""

    stage = "scan_source"


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def folder_of(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*?)[/\\]?[^/\\]*$", 1)


def stem(path: Column) -> Column:
    name = file_name(path)
    return F.when(extension(path) == "", name).otherwise(F.regexp_replace(name, r"\.[^.]*$", ""))


def _files(spark: SparkSession, folder: str, recursive: bool) -> DataFrame:
    """The files of a folder, with its subfolders only if ``recursive``."""
    if recursive:
        return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    root = fs.makeQualified(at).toString()
    if not fs.getFileStatus(at).isDirectory():
        raise NotADirectoryError(folder)
    # subfolders are not listed; the filter leaves out what lies in folders named like key=value
    return spark.read.format("binaryFile").load(folder).where(folder_of(F.col("path")) == root).select("path", "modificationTime", "length", "content")


def scan(spark: SparkSession, folder: str, *, recursive: bool = False, registry: Registry | None = None) -> DataFrame:
    """(path, length, document_type, supported) of a folder's files; contents are not
    read. A missing folder raises when the frame is made."""
    kind = (registry or default_registry()).document_type(F.col("path"))
    return _files(spark, folder, recursive).select("path", "length", kind.alias("document_type")).withColumn("supported", F.col("document_type").isNotNull())


def in_order(files: DataFrame) -> DataFrame:
    return files.orderBy(F.lower(file_name(F.col("path"))), "path")


def read_texts(files: DataFrame, *, limit: int = MAX_BYTES, registry: Registry | None = None) -> DataFrame:
    """(source_path, document_type, text, stage, message) of the supported files among
    files(path, length, content), line ends normalised. Files over ``limit`` bytes, whose
    contents are not read, or not in UTF-8 have no text but a stage, read_source, and a
    message. Contents are read once."""
    kind = (registry or default_registry()).document_type(F.col("path"))
    known = files.withColumn("document_type", kind).where("document_type is not null")
    said = lambda m: (F.lit("read_source").alias("stage"), m.alias("message"))
    body = known.where(F.col("length") <= limit).select("path", "document_type", F.col("content").cast("string").alias("body")).withColumn("valid", F.is_valid_utf8("body"))
    read = body.select(F.col("path").alias("source_path"), "document_type", F.when(F.col("valid"), ends_normalised(F.col("body"))).alias("text"), F.when(~F.col("valid"), "read_source").alias("stage"), F.when(~F.col("valid"), "not UTF-8").alias("message"))
    big = known.where(F.col("length") > limit).select(F.col("path").alias("source_path"), "document_type", F.lit(None).cast("string").alias("text"), *said(F.concat(F.lit("larger than "), F.lit(limit), F.lit(" bytes"))))
    return read.unionByName(big)


def read_documents(spark: SparkSession, folder: str, *, recursive: bool = False, limit: int = MAX_BYTES, registry: Registry | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, failures) of the supported files of a folder; see :func:`read_texts`."""
    texts = read_texts(_files(spark, folder, recursive), limit=limit, registry=registry)
    return texts.where("stage is null").drop("stage", "message"), texts.where("stage is not null").select("source_path", "stage", "message")


def folder_files(spark: SparkSession, folder: str, recursive: bool) -> DataFrame:
    """files(path, modificationTime, length, content) of a folder."""
    return _files(spark, folder, recursive)


def relative_folder(path: Column, root: str) -> Column:
    """The folder of a path below ``root``, ending in a slash; empty for ``root`` itself and
    for paths elsewhere."""
    plain = lambda x: F.regexp_replace(x, "^file:/+", "/")
    above, own = F.concat(plain(folder_of(path)), F.lit("/")), F.regexp_replace(plain(F.lit(root.rstrip("/"))), "$", "/")
    return F.when(F.startswith(above, own), F.substr(above, F.length(own) + 1)).otherwise("")


def generated(files: DataFrame, path: str = "path") -> DataFrame:
    """The files that are outputs of another file in the table: ``<stem>_en`` or
    ``<stem>_zh`` beside ``<stem>`` with the same extension."""
    here = files.select(path, folder_of(F.col(path)).alias("dir"), stem(F.col(path)).alias("stem"), extension(F.col(path)).alias("ext"))
    base = here.where(F.col("stem").rlike("(?s)^.+_(en|zh)$")).withColumn("base", F.regexp_replace("stem", "_(en|zh)$", ""))
    originals = here.select("dir", F.col("stem").alias("base"), "ext")
    return base.join(originals, ["dir", "base", "ext"], "left_semi").select(path)


def originals(files: DataFrame, path: str = "path") -> DataFrame:
    return files.join(generated(files, path), path, "left_anti")


def detection_texts(documents: DataFrame) -> DataFrame:
    """documents(document_type, text, ...) with ``detection_text``: what a language is
    detected from, of XML the translatable texts, else the whole text."""
    xml = documents.where("document_type = 'dita'").withColumn("detection_text", detection_text(F.col("text")))
    return documents.where("not document_type <=> 'dita'").withColumn("detection_text", F.col("text")).unionByName(xml)


def plan_items(documents: DataFrame, fallback: str, *, text: str = "text") -> DataFrame:
    """documents with detected_language, detection_confident, resolved_direction and
    uses_fallback_direction."""
    found = documents.withColumn("_d", detect(F.col(text)))
    language = F.col("_d.language")
    return found.select(*documents.columns, language.alias("detected_language"), confident(language).alias("detection_confident"), direction(language, fallback).alias("resolved_direction"), (~confident(language)).alias("uses_fallback_direction"))


def plan_counts(plan: DataFrame, skipped_generated: int = 0) -> DataFrame:
    return plan.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("resolved_direction") == "zh_to_en").alias("zh_to_en"),
        F.count_if(F.col("resolved_direction") == "en_to_zh").alias("en_to_zh"),
        F.count_if("uses_fallback_direction").alias("fallback"),
        F.lit(skipped_generated).cast("long").alias("skipped_generated"),
    )


def checked_plan(files: DataFrame) -> DataFrame:
    """The supported originals, or :class:`PlanError` if there are none."""
    supported = files.where("supported")
    if supported.isEmpty():
        raise PlanError("no supported files")
    left = originals(supported)
    if left.isEmpty():
        raise PlanError("all files are outputs of earlier runs")
    return left
