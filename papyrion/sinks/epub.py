"""Chapters back into e-books and pages (SNK-01, SNK-02)."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrion.functions.text import slug


def rebuild(content: bytes, entries: dict[str, str]) -> bytes:
    """The archive with some entries replaced; order, times and the uncompressed first entry stay."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as old, zipfile.ZipFile(out, "w") as new:
        for info in old.infolist():
            data = entries[info.filename].encode() if info.filename in entries else old.read(info)
            new.writestr(info, data, compress_type=info.compress_type)
    return out.getvalue()


def write_epub(files: DataFrame, chapters: DataFrame) -> DataFrame:
    """SNK-01: (path, content): each file with its chapters' new html; a book is one group."""
    changed = chapters.where("entryName is not null").groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("entryName", "html"))).alias("entries"))
    joined = files.select("path", "content").join(changed, "path", "left")

    def run(frames):
        for pdf in frames:
            done = [rebuild(c, dict(e) if e is not None else {}) for c, e in zip(pdf["content"], pdf["entries"], strict=True)]
            yield pd.DataFrame({"path": pdf["path"], "content": done})

    return joined.mapInPandas(run, "path string, content binary")


def output_name(stem: Column, selection: Column, code: Column, extension: Column, kind: str = "chap") -> Column:
    """SNK-13: stem, selection (if any), language code, extension."""
    part = F.when(selection.isNotNull(), F.concat(F.lit(f"_{kind}-"), slug(selection))).otherwise("")
    return F.concat(stem, part, F.lit("_"), code, F.lit("."), extension)


def write_html(rows: DataFrame, path: str) -> None:
    """SNK-02: one document per row."""
    rows.select("html").write.mode("overwrite").text(path)
