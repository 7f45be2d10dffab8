"""Media columns: texts stored as baseline JPEG images, and images read as dimensions, thumbnails and hashes.

Defined results: a null text is stored as an empty one. A payload is the text in UTF-8 and zero bytes up to a positive
multiple of 64; a payload of more than 524,224 bytes is several images in one value. A null media value, or one that is
no baseline JPEG, has null features. Equal texts give equal media. All columns of the input stay, except those of the
names that are added, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavelworks.llm.jpeg import ROW, average_hash, store, thumbnails
from gavelworks.llm.words import bytes_of, slices

# Bytes of texts, or of media, that are worked on together.
BATCH_BYTES = 1_000_000


def _kept(df: DataFrame, *new: str) -> tuple[list[str], str]:
    kept = [c for c in df.columns if c not in new]
    source = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in kept]
    return kept, ", ".join(source)


def store_texts(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """``docs`` with their texts as media."""
    kept, source = _kept(docs, media)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, BATCH_BYTES):
                data, offsets = bytes_of(part.column(text))
                data = data.tobytes()
                payloads = [data[a:b] + bytes(-(b - a) % ROW if b > a else ROW) for a, b in zip(offsets, offsets[1:])]
                columns = [part.column(c) for c in kept]
                yield pa.record_batch([*columns, pa.array(store(payloads), pa.binary())], names=[*kept, media])

    return docs.mapInArrow(each, f"{source}, `{media}` binary")


def _read(files: list[bytes]) -> list[list[np.ndarray] | None]:
    try:
        return thumbnails(files)
    except (ValueError, IndexError, KeyError, TypeError):
        # One of them is broken: find out which.
        return [None] if len(files) == 1 else [_read([f])[0] for f in files]


def read_media(df: DataFrame, media: str = "media") -> DataFrame:
    """``df`` with ``images``: of each image in ``media`` its width and height in blocks, thumbnail and hash."""
    kept, source = _kept(df, "images")
    kind = "array<struct<across:int,down:int,thumbnail:binary,hash:string>>"
    arrow = pa.list_(
        pa.struct([("across", pa.int32()), ("down", pa.int32()), ("thumbnail", pa.binary()), ("hash", pa.string())])
    )

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, media, BATCH_BYTES):
                files = part.column(media).to_pylist()
                found = iter(_read([f for f in files if f is not None]))
                images = [None if f is None else next(found) for f in files]
                rows = [
                    None if some is None else [(p.shape[1], p.shape[0], p.tobytes(), average_hash(p)) for p in some]
                    for some in images
                ]
                columns = [part.column(c) for c in kept]
                yield pa.record_batch([*columns, pa.array(rows, arrow)], names=[*kept, "images"])

    return df.mapInArrow(each, f"{source}, images {kind}")


def payload(images: str = "images"):
    """The bytes that ``store_texts`` put into the images."""
    parts = F.transform(images, lambda i: i["thumbnail"])
    return F.aggregate(parts, F.lit(b""), lambda a, b: F.concat(a, b))
