"""A data source that lists files of folder trees without ever entering folders that are left out.

    spark.dataSource.register(FolderFiles)
    spark.read.format("folder_files").option("depth", 3).option("skip", "node_modules,build").load(root)

Options: `depth` (levels of the tree whose files are listed, 1 is the top folder alone), `hidden` (false: names that begin with a
dot are left out), `skip` (folder names, comma-separated), `packages` (endings of folders that count as one thing),
`visits` (files that are looked at in a partition at most; what comes after isn't listed; without it all are). Every
folder of the first level is a partition that its task walks, the top folder's own files are another; folders and
files come in order of name, so a limit cuts the same way each time. Paths are those of a store that pyarrow knows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, bytes long, mtime timestamp, rel string, kind string, dir string"
PACKAGES = ".app,.photoslibrary"


def children(store: fs.FileSystem, folder: str) -> list[fs.FileInfo]:
    """What is in a folder, by name."""
    return sorted(store.get_file_info(fs.FileSelector(folder)), key=lambda f: f.base_name)


@dataclass
class Subtree(InputPartition):
    """A folder of the first level, or (walk is false) the top folder without its folders."""

    root: str
    rel: str
    walk: bool

    def __post_init__(self):
        super().__init__(self.rel)


class FolderReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.roots = [p for p in options.get("path", "").split(",") if p]
        self.depth, self.hidden = int(options.get("depth", 3)), options.get("hidden", "false").lower() == "true"
        self.skip = {s for s in options.get("skip", "").split(",") if s}
        self.packages = tuple(s for s in options.get("packages", PACKAGES).split(",") if s)
        self.visits = int(options["visits"]) if options.get("visits") else None

    def _store(self, root: str) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root.rstrip("/") or "/")

    def _enters(self, f: fs.FileInfo) -> bool:
        name = f.base_name
        return f.type == fs.FileType.Directory and name not in self.skip and not name.endswith(self.packages or ("/",)) and (self.hidden or not name.startswith("."))

    def partitions(self) -> list[Subtree]:
        out = []
        for root in self.roots:
            store, top = self._store(root)
            out.append(Subtree(root, "", False))
            if self.depth > 1:
                out += [Subtree(root, f.base_name, True) for f in children(store, top) if self._enters(f)]
        return out

    def read(self, partition: Subtree) -> Iterator[tuple]:
        store, top = self._store(partition.root)
        folders, seen = [(partition.rel, 2 if partition.walk else 1)], 0
        while folders:
            rel, level = folders.pop()
            inner = []
            for f in children(store, f"{top}/{rel}" if rel else top):
                at = f"{rel}/{f.base_name}" if rel else f.base_name
                if f.type == fs.FileType.File:
                    if self.visits is not None and seen >= self.visits:
                        return
                    seen += 1
                    if self.hidden or not f.base_name.startswith("."):
                        yield (f.path, f.size, f.mtime, at, f.extension.lower(), rel)
                elif partition.walk and level < self.depth and self._enters(f):
                    inner.append((at, level + 1))
            folders += reversed(inner)


class FolderFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "folder_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FolderReader:
        return FolderReader(dict(self.options))
