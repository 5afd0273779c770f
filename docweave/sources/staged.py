"""Files that tasks write and one commit publishes.

A task writes into a staging folder beside the target, under names that hold its attempt,
so a task that runs twice, or beside a copy of itself, disturbs nothing. Spark hands the
driver one message a task that won; ``commit`` moves its files to their places, and
``abort`` takes the staging folder away. A commit that is repeated finds its files moved.

Files go through Arrow's file systems, so a folder may be local, a mount, HDFS or an
object store; a move within one of the first three is a rename.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, field

import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage


def store(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder and the folder's path in it."""
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder))


@dataclass
class Moves(WriterCommitMessage):
    """(staged name, final name) of a task's files."""

    files: list[tuple[str, str]] = field(default_factory=list)


class StagedWriter(DataSourceArrowWriter):
    """The commit protocol; a subclass's ``write`` opens files through ``stage``."""

    def __init__(self, folder: str) -> None:
        self.folder = folder
        self.staging = f".staging-{uuid.uuid4().hex}"

    def stage(self, system: pafs.FileSystem, root: str, name: str, moves: Moves):
        """A stream into a staged file that a commit moves to ``name``."""
        task = TaskContext.get()
        staged = f"{self.staging}/{task.taskAttemptId()}/{len(moves.files)}"
        system.create_dir(f"{root}/{self.staging}/{task.taskAttemptId()}", recursive=True)
        stream = system.open_output_stream(f"{root}/{staged}", compression=None)
        moves.files.append((staged, name))
        return stream

    def commit(self, messages: list[Moves | None]) -> None:
        system, root = store(self.folder)
        made: set[str] = set()
        for staged, name in (x for m in messages if m is not None for x in m.files):
            above = f"{root}/{name}".rpartition("/")[0]
            if above not in made:
                system.create_dir(above, recursive=True)
                made.add(above)
            if system.get_file_info(f"{root}/{staged}").type == pafs.FileType.File:
                system.move(f"{root}/{staged}", f"{root}/{name}")
        self._clear(system, root)

    def abort(self, messages: list[Moves | None]) -> None:
        self._clear(*store(self.folder))

    def _clear(self, system: pafs.FileSystem, root: str) -> None:
        if system.get_file_info(f"{root}/{self.staging}").type == pafs.FileType.Directory:
            system.delete_dir(f"{root}/{self.staging}")
