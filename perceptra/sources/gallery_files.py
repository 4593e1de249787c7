"""Gallery storage: image folders, the appended vector table, reply sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perceptra.operators.gallery import numbered

#: Extensions that count as images of the gallery, with case.
EXTENSIONS = ("jpg", "jpeg", "png", "bmp", "JPG", "PNG")


def images(paths: DataFrame, column: str = "path", extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """(label, kind, rel_path, stem, ext) of paths ``.../<label>/{raw,aligned}/<stem>.<ext>``; others go."""
    part = lambda i: F.regexp_extract(column, r"([^/]+)/(raw|aligned)/([^/]+)\.([^./]+)$", i)
    out = paths.select(part(1).alias("label"), part(2).alias("kind"), part(3).alias("stem"), part(4).alias("ext"))
    rel = F.concat_ws("/", "label", "kind", F.concat_ws(".", "stem", "ext"))
    return out.where(F.col("ext").isin(*extensions)).select("label", "kind", rel.alias("rel_path"), "stem", "ext")


def scan_gallery(spark: SparkSession, root: str) -> DataFrame:
    """The images under ``root``; the files' contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return images(files.select("path"))


def scan_identities(spark: SparkSession, root: str) -> DataFrame:
    """(label): the folders right under ``root``, each an identity, whatever it holds. Only names are listed."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    entries = files.listStatus(folder) if files.exists(folder) else []
    return spark.createDataFrame([(e.getPath().getName(),) for e in entries if e.isDirectory()], "label string")


def model_signature(name: str, backend: str, norm: str, dim: int) -> str:
    return f"{name}-{backend}-{norm}-{dim}"


def append_vectors(new: DataFrame, start: int) -> DataFrame:
    """New vectors (label, path, embedding) with row ids from ``start``, in (label, path) order."""
    return numbered(new, start)


def write_vectors(rows: DataFrame, path: str, signature: str) -> None:
    """Append rows to the store of one model."""
    rows.withColumn("model_sig", F.lit(signature)).write.partitionBy("model_sig").mode("append").parquet(path)


def emit_replies(replies: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``value``: ``{"<key>": text}`` as JSON, ready for a text sink or a stream's foreachBatch."""
    return replies.select(F.to_json(F.struct(F.col(text).alias(key))).alias("value"))
