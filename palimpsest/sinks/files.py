"""Many small files of a table, written by its tasks to any store that pyarrow knows; local paths are folders that all executors see."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def asset_folder(path: str) -> str:
    """The folder of a file's pictures, beside it: named after the file."""
    parent, _, name = path.rpartition("/")
    stem = name.rsplit(".", 1)[0] if "." in name[1:] else name
    return f"{parent}/{stem or 'documento'}_assets" if parent else f"{stem or 'documento'}_assets"


def under(folder: str, *names: Column) -> Column:
    return F.concat(F.lit(folder.rstrip("/") + "/"), *names)


def write_files(rows: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Writes ``content`` (text or bytes) of each row to its ``path``, making folders on the way; path and bytes of what was written.

    Nothing is written before the result is used. Each file goes to a temporary name first and then to its place, so a task
    that runs again, or a reader that comes early, finds whole files only.
    """

    def run(batches: Iterator[pd.DataFrame]):
        from pyarrow import fs

        for part in batches:
            out = []
            for r in part.itertuples():
                system, place = fs.FileSystem.from_uri(r.path) if "://" in r.path or r.path.startswith("file:") else (fs.LocalFileSystem(), r.path)
                folder, _, name = place.rpartition("/")
                if folder:
                    system.create_dir(folder, recursive=True)
                temporary = f"{folder}/.{name}.{uuid.uuid4().hex}.tmp" if folder else f".{name}.{uuid.uuid4().hex}.tmp"
                with system.open_output_stream(temporary) as f:
                    f.write(bytes(r.content))
                system.move(temporary, place)
                out.append((r.path, len(r.content)))
            yield pd.DataFrame(out, columns=["path", "bytes"])

    return rows.select(F.col(path).alias("path"), F.col(content).cast("binary").alias("content")).mapInPandas(run, "path string, bytes long")
