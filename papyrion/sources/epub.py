"""E-books: chapters of a zip file as rows (SRC-01, SRC-02, JOIN-01), and the PDF payload source (SRC-16)."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrion import schemas
from papyrion.sources import html as dom

XHTML = "application/xhtml+xml"
EXTENSIONS = (".epub", ".html", ".htm", ".pdf", ".srt", ".mkv", ".mp4", ".mov", ".m4v", ".webm")
CHAPTERS = "path string, id string, ord int, href string, mediaType string, entryName string, title string, html string, error string"


def dispatch(files: DataFrame, path: str = "path") -> DataFrame:
    """SRC-01: adds the lower-cased extension and whether it is known."""
    ext = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    return files.withColumn("extension", ext).withColumn("supported", F.col("extension").isin(*EXTENSIONS))


def chapters_of(content: bytes) -> list[dict]:
    """Manifest items that the zip has, in order; of equal ids the last holds in the place of the first."""
    archive = zipfile.ZipFile(io.BytesIO(content))
    names = set(archive.namelist())
    package = next((n for n in archive.namelist() if n.endswith(".opf")), None)
    if package is None:
        raise ValueError("the file has no package document")
    base, found = posixpath.dirname(package), {}
    for item in ElementTree.fromstring(archive.read(package)).iter():
        if item.tag.rpartition("}")[2] != "item" or item.get("media-type") != XHTML:
            continue
        entry = posixpath.join(base, unquote(item.get("href") or ""))
        if entry in names:
            html = archive.read(entry).decode("utf-8", "replace")
            found[item.get("id")] = {"id": item.get("id"), "href": item.get("href"), "mediaType": XHTML, "entryName": entry, "title": dom.first_heading(dom.parse(html)), "html": html}
    return [c | {"ord": k} for k, c in enumerate(found.values())]


def chapters(files: DataFrame) -> DataFrame:
    """SRC-02: rows of (path, content) to chapters; a file that cannot be read gives one row with an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in CHAPTERS.split(", ")]
        types = [pa.int32() if n == "ord" else pa.string() for n in names]
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows += [{"path": path, **c} for c in chapters_of(content)]
                except Exception as e:  # noqa: BLE001  a broken file is a row
                    rows.append({"path": path, "error": f"{type(e).__name__}: {e}"})
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(names, types, strict=True)], names=names)

    return files.select("path", "content").mapInArrow(run, CHAPTERS)


def read(spark: SparkSession, path: str) -> DataFrame:
    return chapters(spark.read.format("binaryFile").load(path))


def payload_blocks(files: DataFrame, column: str = "value") -> DataFrame:
    """SRC-16: rows of (doc, JSON payload) to blocks, of the payload or of its pages; payloads older than version 2 are left out."""
    rows = files.select("doc", F.from_json(column, schemas.PAYLOAD).alias("p")).where("p is not null and coalesce(p.version, 2) >= 2")
    blocks = F.coalesce(F.col("p.blocks"), F.flatten(F.col("p.pages.blocks")))
    return rows.select("doc", F.inline(blocks))


def payload_rules(files: DataFrame, column: str = "value") -> DataFrame:
    """SRC-16: rule lines of payloads as (doc, page, bbox); page numbers come as text and go as integers."""
    rows = files.select("doc", F.from_json(column, schemas.PAYLOAD)["pageLineHints"].alias("m")).select("doc", F.explode("m").alias("page", "boxes"))
    return rows.select("doc", F.col("page").cast("int").alias("page"), F.explode("boxes").alias("bbox"))
