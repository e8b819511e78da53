"""A sink of one text file per row, as a Python data source whose tasks commit or leave nothing.

    spark.dataSource.register(sinks.TextFiles)
    df.select("name", "text").write.format("one_file_per_row").mode("append").save(path)

Each attempt of a task writes into a staging folder of its own. Only the attempts that Spark chose are
committed, by renaming their folders (`layout` "parts", the default: one rename for a task) or by moving
their files side by side into `path` ("flat", for sets that people browse). A failed or killed attempt's
files stay in the staging folder, which commit and abort remove, and readers pass over folders that
begin with "_". A name may not be null, hold a slash or come twice.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from .places import file_system


@dataclass
class Attempt(WriterCommitMessage):
    folder: str
    part: int
    files: int


class TextFilesWriter(DataSourceWriter):
    def __init__(self, path: str, layout: str, overwrite: bool):
        if layout not in ("parts", "flat"):
            raise ValueError(f"unknown layout {layout!r}; known: parts, flat")
        self.path, self.layout, self.overwrite, self.job = path, layout, overwrite, uuid.uuid4().hex
        self.staging = f"{path.rstrip('/')}/_staging-{self.job}"

    def write(self, rows: Iterator[Row]) -> Attempt:
        context = TaskContext.get()
        part, attempt = (context.partitionId(), context.taskAttemptId()) if context else (0, uuid.uuid4().hex)
        files, folder = file_system(f"{self.staging}/{part}-{attempt}")
        seen: set[str] = set()
        for r in rows:
            name = r["name"]
            if not name or "/" in name or name in (".", "..") or name in seen:
                raise ValueError(f"not a name, or a name twice: {name!r}")
            if not seen:
                files.create_dir(folder)
            seen.add(name)
            with files.open_output_stream(f"{folder}/{name}") as out:
                out.write((r["text"] or "").encode())
        return Attempt(f"{self.staging}/{part}-{attempt}", part, len(seen))

    def commit(self, messages: list[Attempt | None]) -> None:
        from pyarrow.fs import FileSelector, FileType

        files, root = file_system(self.path)
        done = [m for m in messages if m is not None and m.files]
        files.create_dir(root)
        if self.layout == "flat":
            moves = [(f.path, f"{root}/{f.base_name}") for m in done for f in files.get_file_info(FileSelector(file_system(m.folder)[1]))]
        else:
            moves = [(file_system(m.folder)[1], f"{root}/part-{m.part:05d}-{self.job}") for m in done]
        targets = [t for _, t in moves]
        taken = [f.path for f in files.get_file_info(targets) if f.type != FileType.NotFound] if not self.overwrite else []
        if taken or len(set(targets)) < len(targets):
            self.abort(messages)
            raise ValueError(f"names are there already, or come twice: {[os.path.basename(t) for t in taken][:5]}")
        if self.overwrite:
            for f in files.get_file_info(FileSelector(root)):
                if not f.base_name.startswith("_staging-"):
                    (files.delete_dir if f.type == FileType.Directory else files.delete_file)(f.path)
        for source, target in moves:
            files.move(source, target)
        self._clear()

    def abort(self, messages: list[Attempt | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        from pyarrow.fs import FileType

        files, staging = file_system(self.staging)
        if files.get_file_info(staging).type == FileType.Directory:
            files.delete_dir(staging)


class TextFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "one_file_per_row"

    def schema(self) -> str:
        return "name string, text string"

    def writer(self, schema: StructType, overwrite: bool) -> TextFilesWriter:
        if missing := {"name", "text"} - set(schema.names):
            raise ValueError(f"columns missing: {sorted(missing)}")
        return TextFilesWriter(self.options["path"], self.options.get("layout", "parts"), overwrite)
