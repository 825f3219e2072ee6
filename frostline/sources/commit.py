"""Files that tasks write out of sight, and that a writer's commit puts in their place."""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyarrow import fs
from pyspark.sql.datasource import WriterCommitMessage

HIDDEN = "_writing"  # Spark's readers pass over names that begin so


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or an address, and the path in it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    """The files of a task: their names, under its folder out of sight."""

    folder: str
    names: list[str] = field(default_factory=list)


class HiddenFolder:
    """What the tasks of one write have in common: a folder below the target that readers don't see."""

    def __init__(self, path: str) -> None:
        self.path, self.hidden = path.rstrip("/"), f"{HIDDEN}-{uuid.uuid4().hex}"

    def task(self) -> tuple[fs.FileSystem, str, Written]:
        """A folder of its own for a task, and each try of one."""
        files, root = file_system(self.path)
        mine = Written(uuid.uuid4().hex)
        return files, f"{root}/{self.hidden}/{mine.folder}", mine

    def put(self, files: fs.FileSystem, folder: str, mine: Written, name: str, content: bytes) -> None:
        if name.startswith("/") or ".." in name.split("/"):
            raise ValueError(f"a file's name must stay below the target: {name}")
        files.create_dir(f"{folder}/{name}".rsplit("/", 1)[0], recursive=True)
        with files.open_output_stream(f"{folder}/{name}") as out:
            out.write(content)
        mine.names.append(name)

    def commit(self, messages: Iterable[Written | None]) -> None:
        """Moves all files to their places. A name that two tasks wrote is an error, and nothing is moved then."""
        files, root = file_system(self.path)
        done = [m for m in messages if m is not None]
        names = [n for m in done for n in m.names]
        if len(names) != len(set(names)):
            self.abort()
            raise ValueError("a file was written twice")
        for folder in {n.rpartition("/")[0] for n in names}:
            files.create_dir(f"{root}/{folder}", recursive=True)
        for message in done:
            for name in message.names:
                files.move(f"{root}/{self.hidden}/{message.folder}/{name}", f"{root}/{name}")
        self.abort()

    def abort(self) -> None:
        """Deletes all that isn't in its place."""
        files, root = file_system(self.path)
        if files.get_file_info(f"{root}/{self.hidden}").type == fs.FileType.Directory:
            files.delete_dir(f"{root}/{self.hidden}")
