"""A data source that writes lines into files by name, each file by the task that has its rows."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The store and the path in it; paths without a scheme are local."""
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))


@dataclass
class Files(WriterCommitMessage):
    names: list[str]


class NamedFiles(DataSource):
    """``format("named_files")`` for rows (file, line), all rows of a file in one partition and together.

    Options: path, header (the first line of each file), note (a file that gets the names written, as JSON).
    A task writes under temporary names and renames its files at its end; a job that fails removes
    the files of its tasks, so it leaves none, and the commit drops what lost tasks have left.
    """

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "file string, line string"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options)


class _Writer(DataSourceArrowWriter):
    def __init__(self, options):
        self.path, self.header, self.note = options["path"].rstrip("/"), options.get("header"), options["note"]
        self.pending = f"_pending-{uuid.uuid4().hex}"
        store, path = opened(self.path)
        store.create_dir(f"{path}/{self.pending}", recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Files:
        store, path = opened(self.path)
        attempt = f"{path}/{self.pending}/{uuid.uuid4().hex}"
        names: list[str] = []
        out = None
        try:
            for batch in iterator:
                for file, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if not names or names[-1] != file:
                        if out:
                            out.close()
                        else:
                            store.create_dir(attempt)
                        names.append(file)
                        out = store.open_output_stream(f"{attempt}/{len(names)}", compression=None)
                        if self.header is not None:
                            out.write(self.header.encode() + b"\n")
                    out.write((line or "").encode() + b"\n")
        finally:
            if out:
                out.close()
        if len(set(names)) < len(names):
            raise ValueError("the rows of a file are not together")
        done: list[str] = []
        try:
            for i, name in enumerate(names):
                store.move(f"{attempt}/{i + 1}", f"{path}/{name}")
                done.append(name)
        except BaseException:
            for name in done:
                store.delete_file(f"{path}/{name}")
            raise
        return Files(names)

    def commit(self, messages: list[Files | None]) -> None:
        store, path = opened(self.path)
        named = sorted(n for m in messages if m is not None for n in m.names)
        with opened(self.note)[0].open_output_stream(opened(self.note)[1]) as out:
            out.write(json.dumps(named).encode())
        store.delete_dir(f"{path}/{self.pending}")

    def abort(self, messages: list[Files | None]) -> None:
        store, path = opened(self.path)
        for n in (n for m in messages if m is not None for n in m.names):
            store.delete_file(f"{path}/{n}")
        store.delete_dir(f"{path}/{self.pending}")


def write_named(rows: DataFrame, path: str, *, note: str, header: str | None = None) -> list[str]:
    """Writes rows (file, line) as ``NamedFiles`` does; the names of the files, sorted."""
    rows.sparkSession.dataSource.register(NamedFiles)
    out = rows.select("file", "line").write.format("named_files").mode("append").option("note", note)
    (out if header is None else out.option("header", header)).save(path)
    store, at = opened(note)
    with store.open_input_stream(at) as file:
        return json.loads(file.read())
