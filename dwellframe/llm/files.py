"""Binary files in the shared folder, written and read by tasks through its own file system."""

from __future__ import annotations

import uuid

from pyarrow import fs


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder (local, HDFS, S3 or GCS) and the path in it."""
    return fs.FileSystem.from_uri(uri)


class Replacing:
    """Writes a file under another name and moves it when complete.

    A task that is run again, or twice at once, replaces the file by an equal one.
    """

    def __init__(self, folder: str, name: str):
        self.fs, root = open_fs(folder)
        self.fs.create_dir(root, recursive=True)
        self.path, self.temporary = f"{root}/{name}", f"{root}/_{name}-{uuid.uuid4().hex}"

    def __enter__(self):
        self.stream = self.fs.open_output_stream(self.temporary)
        return self.stream

    def __exit__(self, kind, *_):
        self.stream.close()
        if kind is None:
            self.fs.move(self.temporary, self.path)
        else:
            self.fs.delete_file(self.temporary)
