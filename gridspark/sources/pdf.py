"""PDF files as pages, tokens and rules: one Arrow pass from file bytes to page primitives."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.functions import geometry as G
from gridspark.schemas import BBOX

_WORDS = "array<struct<text:string,x0:double,y0:double,x1:double,y1:double>>"
_IMAGES = "array<struct<x0:double,y0:double,x1:double,y1:double,w:int,h:int,gray:binary>>"
_RULES = "array<struct<x0:double,y0:double,x1:double,y1:double>>"
PRIMITIVES = f"doc_id string, page_index int, page_count int, width double, height double, words {_WORDS}, rules {_RULES}, images {_IMAGES}, undrawn array<string>, error string"


@dataclass
class PdfFrames:
    """``pages(doc_id, page_index, width, height)``, ``tokens`` and ``rules`` in points from the top left, ``errors(doc_id, page_index, error)``."""

    primitives: DataFrame
    pages: DataFrame
    tokens: DataFrame
    rules: DataFrame
    errors: DataFrame


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per page; a file or page that cannot be read becomes a row with its error, never an exception."""
    from gridspark.kernels import pdf

    schema = pa.schema([
        ("doc_id", pa.string()), ("page_index", pa.int32()), ("page_count", pa.int32()), ("width", pa.float64()), ("height", pa.float64()),
        ("words", pa.list_(pa.struct([("text", pa.string()), *((s, pa.float64()) for s in G.SIDES)]))),
        ("rules", pa.list_(pa.struct([(s, pa.float64()) for s in G.SIDES]))),
        ("images", pa.list_(pa.struct([*((s, pa.float64()) for s in G.SIDES), ("w", pa.int32()), ("h", pa.int32()), ("gray", pa.binary())]))),
        ("undrawn", pa.list_(pa.string())), ("error", pa.string()),
    ])
    for b in batches:
        for doc_id, content, wanted in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            rows = []
            try:
                doc = pdf.Document(content or b"")
            except Exception as e:  # noqa: BLE001  a broken file is data
                rows.append({"doc_id": doc_id, "error": f"{type(e).__name__}: {e}"})
            else:
                for i in range(len(doc.pages)):
                    if wanted is not None and i not in wanted:
                        continue
                    row = {"doc_id": doc_id, "page_index": i, "page_count": len(doc.pages)}
                    try:
                        p = doc.page(i)
                        row |= {"width": p.width, "height": p.height, "words": [vars(w) for w in p.words], "rules": [dict(zip(G.SIDES, r, strict=True)) for r in p.rules]}
                        row |= {"images": [vars(x) for x in p.images], "undrawn": p.undrawn}
                    except Exception as e:  # noqa: BLE001
                        row["error"] = f"{type(e).__name__}: {e}"
                    rows.append(row)
                if not doc.pages:
                    rows.append({"doc_id": doc_id, "page_count": 0})
            yield pa.RecordBatch.from_pylist(rows, schema)


def read_pdf(files: DataFrame, wanted: DataFrame | None = None) -> PdfFrames:
    """``files(path, content)``, and ``wanted(doc_id, indices)`` to read some pages only; pages are chosen before they are interpreted."""
    rows = files.select(F.col("path").alias("doc_id"), "content")
    if wanted is not None:
        rows = rows.join(wanted.select("doc_id", "indices"), "doc_id", "left")
    else:
        rows = rows.withColumn("indices", F.lit(None).cast("array<int>"))
    prim = rows.mapInArrow(_split, PRIMITIVES)
    return frames(prim)


def frames(prim: DataFrame) -> PdfFrames:
    good = prim.filter("error is null and page_index is not null")
    words = good.select("doc_id", "page_index", F.posexplode("words").alias("token_idx", "w"))
    tokens = words.select("doc_id", "page_index", "token_idx", "w.text", F.struct(*[F.col(f"w.{s}").alias(s) for s in G.SIDES]).cast(BBOX).alias("bbox"), F.lit("pt").alias("unit"), F.lit(1.0).alias("confidence"))
    rules = good.select("doc_id", "page_index", F.explode("rules").alias("r")).select("doc_id", "page_index", "r.*")
    return PdfFrames(prim, good.select("doc_id", "page_index", "width", "height"), tokens, rules, prim.filter("error is not null").select("doc_id", "page_index", "error"))


def scan(spark: SparkSession, path: str) -> DataFrame:
    """``(path, content)`` of the PDF files under any path that Spark can read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", True).load(path).select("path", "content")


def from_bytes(spark: SparkSession, files: dict[str, bytes]) -> DataFrame:
    return spark.createDataFrame(list(files.items()), "path string, content binary")
