"""Files of any scheme that the cluster shares, from Python workers."""

from __future__ import annotations

import os
import uuid

from pyarrow import fs


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" in uri or uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), os.path.abspath(uri)


class Attempt:
    """A file that appears under its name only when complete.

    A task that dies leaves nothing under the final name; a task that runs
    twice writes the same bytes twice, so the later rename changes nothing.
    """

    def __init__(self, system: fs.FileSystem, path: str) -> None:
        self.system, self.path, self.temp = system, path, f"{path}.{uuid.uuid4().hex}.tmp"

    def __enter__(self):  # noqa: ANN204
        self.out = self.system.open_output_stream(self.temp, buffer_size=1 << 20)
        return self.out

    def __exit__(self, kind, *_) -> None:  # noqa: ANN001
        self.out.close()
        if kind is None:
            self.system.move(self.temp, self.path)
        else:
            self.system.delete_file(self.temp)
