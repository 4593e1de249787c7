"""Labelled gallery of vectors: statistics, matching, upkeep."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from perceptra.operators.similarity import nearest
from perceptra.storage import materialise

UNKNOWN = "__unknown__"


def identity_centroids(vectors: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """(label, count, centroid): the mean vector over its norm + 1e-9.

    Components are averaged by (label, place), so each task sends one partial
    sum per label and place however many vectors a label has.
    """
    places = vectors.select(label, F.posexplode(vector).alias("i", "v"))
    means = places.groupBy(label, "i").agg(F.avg(F.col("v").cast("double")).alias("m"), F.count("v").alias("n"))
    rows = means.groupBy(label).agg(
        F.max("n").alias("count"), F.array_sort(F.collect_list(F.struct("i", "m"))).alias("m"), F.sum(F.col("m") * F.col("m")).alias("s")
    )
    centroid = F.transform("m", lambda p: p["m"] / (F.sqrt("s") + 1e-9))
    return rows.select(label, "count", centroid.alias("centroid"))


def gallery_stats(vectors: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """(label, count, dim, total): vectors of each label and of all."""
    out = vectors.groupBy(label).agg(F.count(F.lit(1)).alias("count"), F.max(F.size(vector)).alias("dim"))
    return out.withColumn("total", F.lit(vectors.count()))


def match_gallery(
    probes: DataFrame, centroids: DataFrame, threshold: float = 0.4, probe_id: str = "vec_id", label: str = "label"
) -> DataFrame:
    """(probe_id, label, sim): the most similar identity, or ``__unknown__`` below ``threshold``, sim kept."""
    found = nearest(probes, probe_id, centroids, label, 1, candidate_vector="centroid")
    name = F.when(F.col("score") >= threshold, F.col(label).cast("string")).otherwise(UNKNOWN)
    return found.select(probe_id, name.alias(label), F.col("score").alias("sim"))


def retrieve_answers(
    queries: DataFrame, qa: DataFrame, top_k: int = 3, threshold: float = 0.85, query_id: str = "vec_id"
) -> DataFrame:
    """(query_id, rank, qa_id, score, matched_question, answer): the ``top_k`` stored questions of each query.

    answer is given where the best score reaches ``threshold``, else null; the
    best one decides for all ranks.
    """
    found = nearest(queries, query_id, qa.select("qa_id", "embedding"), "qa_id", top_k)
    best = F.max("score").over(Window.partitionBy(query_id))
    out = found.withColumn("best_", best).join(qa.select("qa_id", "question", "answer"), "qa_id")
    return out.select(
        query_id, "rank", "qa_id", "score", F.col("question").alias("matched_question"),
        F.when(F.col("best_") >= threshold, F.col("answer")).alias("answer"),
    )


def identity_counts(
    files: DataFrame, extensions: tuple[str, ...] = ("jpg", "jpeg", "png", "bmp", "webp"), identities: DataFrame | None = None
) -> DataFrame:
    """(label, aligned, raw): images of each identity; one without images is listed with zeros.

    ``identities`` (label) are those that exist, as ``scan_identities`` gives
    them; without it they are the labels of ``files``.
    """
    image = F.lower("ext").isin(*extensions)
    of = lambda kind: F.count_if(image & (F.col("kind") == kind))
    counts = files.groupBy("label").agg(of("aligned").alias("aligned"), of("raw").alias("raw"))
    if identities is None:
        return counts
    known = identities.select("label").distinct().join(counts, "label", "left")
    return known.select("label", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("aligned", "raw")))


def gallery_worklist(files: DataFrame, items: DataFrame) -> DataFrame:
    """Aligned images whose path the index does not hold."""
    path = F.concat_ws("/", "label", "kind", F.concat_ws(".", "stem", "ext"))
    aligned = files.where("kind = 'aligned'").withColumn("path", path)
    return aligned.join(items.select("path"), "path", "left_anti").select("label", "stem", "path")


def align_worklist(files: DataFrame, extensions: tuple[str, ...] = ("jpg", "jpeg", "png", "bmp", "JPG", "PNG")) -> DataFrame:
    """Raw images without an aligned ``<stem>.jpg`` of the same label."""
    done = files.where("kind = 'aligned' and ext = 'jpg'").select("label", "stem")
    raw = files.where((F.col("kind") == "raw") & F.col("ext").isin(*extensions))
    return raw.join(done, ["label", "stem"], "left_anti").select("label", "stem", "ext")


def attach_row_labels(vectors: DataFrame, items: DataFrame, row: str = "row_id") -> DataFrame:
    """Vectors with their item's label; none gives the empty string, of several items the last path wins."""
    last = items.groupBy(row).agg(F.max_by("label", "path").alias("label"))
    return vectors.join(last, row, "left").withColumn("label", F.coalesce("label", F.lit("")))


def numbered(items: DataFrame, start: int = 0, row: str = "row_id") -> DataFrame:
    """Items with dense row ids from ``start`` in (label, path) order.

    Ids come from a distributed sort and the sizes of its partitions, not from
    a window over everything: a row's place in its partition is in the lower
    33 bits of Spark's own id, the partition in the upper ones.
    """
    columns = [c for c in items.columns if c != row]
    placed = materialise(items.select(*columns).orderBy("label", "path").withColumn("id_", F.monotonically_increasing_id()))
    part = F.shiftright("id_", 33)
    sizes = placed.groupBy(part.alias("part_")).agg(F.count(F.lit(1)).alias("n_"))
    before = F.sum("n_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("part_", F.coalesce(before, F.lit(0)).alias("start_"))  # one row for each partition
    numbers = F.col("start_") + F.col("id_").bitwiseAND((1 << 33) - 1) + start
    return placed.join(F.broadcast(starts), part == F.col("part_")).select(*columns, numbers.cast("long").alias(row))


def delete_identities(items: DataFrame, ids: DataFrame) -> DataFrame:
    """The items of all labels but those in ``ids`` (label), with their rows numbered anew."""
    return numbered(items.join(ids.select("label"), "label", "left_anti"))


def deletion_report(items: DataFrame, folders: DataFrame, ids: DataFrame) -> DataFrame:
    """(label, deleted): true if the folder was there or any vector is left after the rebuild."""
    any_left = not items.join(ids.select("label"), "label", "left_anti").isEmpty()
    known = folders.select("label").distinct().withColumn("there_", F.lit(True))
    there = F.coalesce("there_", F.lit(False)) | F.lit(any_left)
    return ids.select("label").distinct().join(known, "label", "left").select("label", there.alias("deleted"))


def unique_names(names: DataFrame, column: str = "name") -> DataFrame:
    """``unique_name``: the name, with ``_1``, ``_2`` ... for its later rows in order of ``position``."""
    n = F.row_number().over(Window.partitionBy(column).orderBy("position")) - 1
    return names.withColumn("unique_name", F.when(n == 0, F.col(column)).otherwise(F.concat_ws("_", column, n.cast("string"))))


def refresh_gallery(files: DataFrame, items: DataFrame, vectors: DataFrame, embed) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Index what is new: (items, vectors, centroids) after embedding the worklist.

    ``embed`` turns the worklist into (label, path, embedding). New rows are
    numbered from the present count in (label, path) order.
    """
    start = items.count()
    new = numbered(embed(gallery_worklist(files, items)).select("label", "path", "embedding"), start)
    all_items = items.select("path", "label", "row_id").unionByName(new.select("path", "label", "row_id"))
    all_vectors = vectors.select("row_id", "embedding").unionByName(new.select("row_id", "embedding"))
    return all_items, all_vectors, identity_centroids(attach_row_labels(all_vectors, all_items))
