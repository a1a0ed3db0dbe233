"""One file for each row, published when the whole job has ended: a writer that stages, commits and aborts."""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: columns of what is written: a file's name, with its ending, and its text
FILE = "nome string, conteudo string"


@dataclass
class _Staged(WriterCommitMessage):
    """The folder of one attempt of a task, and its files."""

    attempt: str
    files: int


class _FilesWriter(DataSourceWriter):
    """Each attempt of a task writes a folder of its own beside the target; only those that the job commits reach it.

    What a failed, lost or doubled attempt has written is never looked at and goes with the staging folder.
    """

    def __init__(self, folder: str, overwrite: bool):
        self.target, self.overwrite = folder.rstrip("/"), overwrite
        self.staging = f"{self.target}.staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        context = TaskContext.get()
        attempt = f"{context.partitionId()}-{context.taskAttemptId()}"
        folder = os.path.join(self.staging, attempt)
        os.makedirs(folder)
        files = 0
        for row in iterator:
            if not row["nome"] or os.path.basename(row["nome"]) != row["nome"] or row["nome"] in (".", ".."):
                raise ValueError(f"no name for a file: {row['nome']!r}")
            # a name that comes twice is an error
            with open(os.path.join(folder, row["nome"]), "x", encoding="utf-8", newline="") as f:
                f.write(row["conteudo"] or "")
            files += 1
        return _Staged(attempt, files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """All files into one folder first; the target changes only when they are all there under different names."""
        done = os.path.join(self.staging, "done")
        os.makedirs(done)
        for message in messages:
            folder = os.path.join(self.staging, message.attempt)
            for name in os.listdir(folder):
                if os.path.lexists(os.path.join(done, name)):
                    raise FileExistsError(f"two rows for one file: {name}")
                os.rename(os.path.join(folder, name), os.path.join(done, name))
        if (found := len(os.listdir(done))) != (told := sum(m.files for m in messages)):
            raise OSError(f"{found} files staged of {told} written")
        if not os.path.lexists(self.target):
            os.rename(done, self.target)
        elif self.overwrite:
            before = os.path.join(self.staging, "before")
            os.rename(self.target, before)
            try:
                os.rename(done, self.target)
            except OSError:
                os.rename(before, self.target)
                raise
        else:
            for name in os.listdir(done):
                os.replace(os.path.join(done, name), os.path.join(self.target, name))
        shutil.rmtree(self.staging)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


class FilesSource(DataSource):
    """``df.write.format("document_files").mode("append" | "overwrite").save(folder)``, nome and conteudo by name."""

    @classmethod
    def name(cls) -> str:
        return "document_files"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if not {"nome", "conteudo"} <= set(schema.fieldNames()):
            raise ValueError(f"columns nome, conteudo are asked for, not {schema.fieldNames()}")
        return _FilesWriter(self.options["path"], overwrite)


def publish(files: DataFrame, folder: str, overwrite: bool = False) -> None:
    """The files of (nome, conteudo) in a folder on a file system that driver and executors share.

    A new folder, or one that is overwritten, appears whole by a rename; else the files
    join those that are there, same names in their place, once all are written. A job
    that fails before leaves the folder as it was. Names that come twice, are empty or
    hold a path are errors; a null text is an empty file; no rows make an empty folder.
    """
    files.sparkSession.dataSource.register(FilesSource)
    files.select("nome", "conteudo").write.format("document_files").mode("overwrite" if overwrite else "append").save(folder)
