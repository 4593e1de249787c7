"""User models over tables: text and image encoders, and one call per group of frames."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_EPS = 1e-9


def _unit(v: np.ndarray) -> np.ndarray:
    v = np.asarray(v, np.float32)
    return v / (np.linalg.norm(v, axis=1, keepdims=True) + _EPS)


def _parts(n: int, size: int) -> Iterator[slice]:
    return (slice(i, i + size) for i in range(0, n, size))


def embed_text(
    df: DataFrame, load: Callable[[], Callable[[list[str]], np.ndarray]], id_column: str, text_column: str = "text",
    batch: int = 64, prefix: str = "query: ",
) -> DataFrame:
    """(id, embedding array<float>): ``load`` makes the encoder once per task; vectors have unit length.

    A null text is encoded as the bare prefix.
    """

    def run(batches):
        encode = load()
        for b in batches:
            texts = [prefix + (t or "") for t in b.column(1).to_pylist()]
            parts = [_unit(encode(texts[p])) for p in _parts(len(texts), batch)]
            rows = np.concatenate(parts).tolist() if parts else []
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.float32()))], [id_column, "embedding"])

    return df.select(id_column, text_column).mapInArrow(run, f"{id_column} {dict(df.dtypes)[id_column]}, embedding array<float>")


def embed_images(
    df: DataFrame, load: Callable[[], Callable[[list[bytes]], list]], id_column: str, image_column: str = "content", max_batch: int = 4
) -> DataFrame:
    """(id, embedding): as embed_text over images; those for which the encoder gives None are left out."""

    def run(batches):
        encode = load()
        for b in batches:
            ids, images = b.column(0).to_pylist(), b.column(1).to_pylist()
            kept, rows = [], []
            for p in _parts(len(images), max_batch):
                for i, v in zip(ids[p], encode(images[p]), strict=True):
                    if v is not None:
                        kept.append(i)
                        rows.append(_unit(np.asarray(v)[None])[0].tolist())
            yield pa.RecordBatch.from_arrays(
                [pa.array(kept, b.schema.field(0).type), pa.array(rows, pa.list_(pa.float32()))], [id_column, "embedding"]
            )

    return df.select(id_column, image_column).mapInArrow(run, f"{id_column} {dict(df.dtypes)[id_column]}, embedding array<float>")


def apply_model(groups: DataFrame, load: Callable[[], Callable[[list, str], str]], prompt: str, items: str = "items") -> DataFrame:
    """``reply`` and ``error`` beside each group: one call per group; a call that fails gives its message as error."""
    place = groups.columns.index(items)

    def run(batches):
        call = load()
        for b in batches:
            replies, errors = [], []
            for group in b.column(place).to_pylist():
                try:
                    replies.append(call(group, prompt))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  the row carries it
                    replies.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(replies, pa.string()), pa.array(errors, pa.string())], [*b.schema.names, "reply", "error"]
            )

    ddl = ", ".join(f"`{c}` {t}" for c, t in groups.dtypes) + ", reply string, error string"
    return groups.mapInArrow(run, ddl)


def unpack_embeddings(df: DataFrame, id_column: str, column: str = "embedding_b64") -> DataFrame:
    """(id, embedding): base64 of little-endian float32 as arrays; null gives null."""

    def run(batches):
        for b in batches:
            rows = [None if d is None else np.frombuffer(d, "<f4").tolist() for d in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.float32()))], [id_column, "embedding"])

    binary = df.select(id_column, F.unbase64(column).alias("b"))
    return binary.mapInArrow(run, f"{id_column} {dict(df.dtypes)[id_column]}, embedding array<float>")
