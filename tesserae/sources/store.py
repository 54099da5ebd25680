"""Managed collections: snapshots of Parquet with an atomically replaced manifest.

A collection is a folder of snapshot versions. A write makes a whole new
snapshot and then replaces the catalog file in one move, for all collections
of a transaction together; readers keep the version they opened. Every change
reads the catalog again under the store's lock and touches its own entries
only; a snapshot is switched only if its collection still has the one that it
was made from. As the move is the commit, a writer that dies leaves unused
files (``vacuum`` removes them) and a lock that expires. The root may be a path
that all machines share or a URI of any store that pyarrow knows.
"""

from __future__ import annotations

import hashlib
import json
import os
import posixpath
import re
import time
import uuid
from contextlib import contextmanager
from datetime import datetime, timezone

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..errors import EngineError
from .sealed import seal, unseal

#: The form of a collection's name.
NAME = re.compile(r"^[A-Za-z0-9][A-Za-z0-9_\-.]*$")
#: Seconds after which a lock counts as left by a dead writer, and seconds that a writer waits for one.
LEASE, PATIENCE = 600, 20
EMPTY = "id string, _version long, _createdAt string, _updatedAt string"


def checked(name: str) -> str:
    if not NAME.match(name) or len(name.encode()) > 128 or ".." in name or name.endswith("."):
        raise EngineError(f"{name!r} is no name for a collection")
    return name


class Folder:
    """Files below a path or URI."""

    def __init__(self, uri: str) -> None:
        self.uri = uri.rstrip("/")
        self.store, self.base = fs.FileSystem.from_uri(self.uri)

    def at(self, name: str) -> str:
        return posixpath.join(self.base, name)

    def exists(self, name: str) -> bool:
        return self.store.get_file_info(self.at(name)).type != fs.FileType.NotFound

    def read(self, name: str) -> dict:
        with self.store.open_input_stream(self.at(name)) as f:
            return json.loads(f.read())

    def write(self, name: str, said: dict) -> None:
        """Beside the old file first, then in its place."""
        self.store.create_dir(posixpath.dirname(self.at(name)), recursive=True)
        temp = self.at(f"{name}.{uuid.uuid4().hex}")
        with self.store.open_output_stream(temp) as f:
            f.write(json.dumps(said).encode())
        self.store.move(temp, self.at(name))

    def claim(self, name: str, said: dict, spark: SparkSession) -> bool:
        """Make a file that is not there yet; of several that try, one succeeds."""
        self.store.create_dir(self.base, recursive=True)
        if isinstance(self.store, fs.LocalFileSystem):
            try:
                out = os.open(self.at(name), os.O_CREAT | os.O_EXCL | os.O_WRONLY)
            except FileExistsError:
                return False
            with os.fdopen(out, "w") as f:
                f.write(json.dumps(said))
            return True
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.uri}/{name}")
        if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).createNewFile(path):
            return False
        with self.store.open_output_stream(self.at(name)) as f:
            f.write(json.dumps(said).encode())
        return True

    def age(self, name: str) -> float | None:
        """Seconds since a file was written; nothing where there is none."""
        info = self.store.get_file_info(self.at(name))
        return None if info.type == fs.FileType.NotFound or info.mtime is None else time.time() - info.mtime.timestamp()

    def digest(self, name: str) -> str:
        found = hashlib.sha256()
        with self.store.open_input_stream(self.at(name)) as f:
            while block := f.read(1 << 20):
                found.update(block)
        return found.hexdigest()

    def folders(self, name: str = "") -> list[str]:
        found = self.store.get_file_info(fs.FileSelector(self.at(name), allow_not_found=True))
        return sorted(i.base_name for i in found if i.type == fs.FileType.Directory)

    def files(self, name: str) -> list[str]:
        found = self.store.get_file_info(fs.FileSelector(self.at(name)))
        return sorted(i.base_name for i in found if i.type == fs.FileType.File)

    def copy_from(self, other: Folder, there: str, here: str) -> None:
        self.store.create_dir(posixpath.dirname(self.at(here)), recursive=True)
        fs.copy_files(other.at(there), self.at(here), source_filesystem=other.store, destination_filesystem=self.store)


class Store:
    """The catalog of one root folder."""

    def __init__(self, spark: SparkSession, root: str, key: bytes | None = None) -> None:
        self.spark, self.folder, self.key = spark, Folder(root), key
        self.schemas: dict[str, dict] = {}  # of staged snapshots
        self.catalog: dict = {}
        self.refresh()

    # the catalog

    def refresh(self) -> None:
        """What is on disk now."""
        self.catalog = self.folder.read("catalog.json") if self.folder.exists("catalog.json") else {"collections": {}, "views": {}}

    @contextmanager
    def alone(self):
        """One writer at a time: a lock file that only one can make; it expires after LEASE seconds."""
        token, until = uuid.uuid4().hex, time.time() + PATIENCE
        while not self.folder.claim("write.lock", {"token": token}, self.spark):
            age = self.folder.age("write.lock")
            if age is not None and age > LEASE:
                # of several that find it expired, the one that can move it away goes on
                gone = f"write.lock.{token}"
                try:
                    self.folder.store.move(self.folder.at("write.lock"), self.folder.at(gone))
                    self.folder.store.delete_file(self.folder.at(gone))
                except OSError:
                    pass
                continue
            if time.time() > until:
                raise EngineError("another writer holds the store")
            time.sleep(0.05)
        try:
            yield
        finally:
            self.folder.store.delete_file(self.folder.at("write.lock"))

    @contextmanager
    def changing(self):
        """The catalog as it is on disk, to be changed by one writer; it is replaced in one move."""
        with self.alone():
            self.refresh()
            yield self.catalog
            self.folder.write("catalog.json", self.catalog)

    @property
    def collections(self) -> dict:
        return self.catalog["collections"]

    @property
    def views(self) -> dict:
        return self.catalog["views"]

    def settings(self, name: str) -> dict:
        if name not in self.collections:
            raise EngineError(f"there is no collection {name}")
        return self.collections[name]

    def create(self, name: str) -> None:
        """An entry in this catalog; the disk has it with the next change."""
        self.collections.setdefault(checked(name), {"folder": name, "snapshot": None, "version": 0, "indexes": [], "uniques": [], "schema": {}, "ttl": None})

    def set(self, name: str, **settings) -> None:
        """Change a collection's entry, which is made where there is none."""
        with self.changing():
            self.create(name)
            self.collections[name] |= settings

    def set_view(self, name: str, text: str) -> None:
        with self.changing():
            self.views[checked(name)] = text

    def rename(self, name: str, to: str) -> None:
        with self.changing():
            if to in self.collections:
                raise EngineError(f"{to} exists already")
            self.collections[checked(to)] = self.settings(name)
            del self.collections[name]

    # snapshots

    def path(self, name: str, snapshot: str) -> str:
        return f"{self.folder.uri}/{name}/{snapshot}"

    def read(self, name: str) -> DataFrame:
        entry = self.settings(name)
        if entry["snapshot"] is None:
            return self.spark.createDataFrame([], EMPTY)
        return self._load(entry, name, entry["snapshot"], entry.get("fields"))

    def _load(self, entry: dict, name: str, snapshot: str, fields: dict | None) -> DataFrame:
        folder = entry.get("folder", name)
        path = self.path(folder, snapshot)
        if entry.get("sealed"):
            return unseal(self.spark.read.parquet(path), folder, self._key(), T.StructType.fromJson(fields))
        if entry.get("format", "parquet") == "json":
            return self.spark.read.schema(T.StructType.fromJson(fields)).json(path)
        return self.spark.read.parquet(path)

    def _key(self) -> bytes:
        if self.key is None:
            raise EngineError("the collection is encrypted; a key is needed")
        return self.key

    def stage(self, name: str, df: DataFrame) -> str:
        """Write a snapshot in the collection's format."""
        entry = self.collections.get(name, {})
        snapshot, folder = f"v{uuid.uuid4().hex}", entry.get("folder", checked(name))
        self.schemas[snapshot] = df.schema.jsonValue()
        if entry.get("sealed"):
            seal(df, folder, self._key()).write.parquet(self.path(folder, snapshot))
        else:
            df.write.format(entry.get("format", "parquet")).save(self.path(folder, snapshot))
        return snapshot

    def staged(self, name: str, snapshot: str) -> DataFrame:
        return self._load(self.collections.get(name, {}), name, snapshot, self.schemas[snapshot])

    def change(self, name: str, **settings) -> None:
        """Rewrite a collection under new settings of its storage."""
        entry, df = self.settings(name), self.read(name)
        seen, before = entry["snapshot"], dict(entry)
        entry |= settings
        try:
            self.commit({name: self.stage(name, df)}, {name: seen}, {name: settings})
        except BaseException:
            entry.update(before)
            raise

    def commit(self, staged: dict[str, str], seen: dict[str, str | None], settings: dict[str, dict] | None = None) -> None:
        """Switch the named collections to their staged snapshots in one step, if they still have the ones that were seen."""
        with self.changing():
            late = [n for n in staged if self.collections.get(n, {}).get("snapshot") != seen.get(n)]
            if late:
                raise EngineError(f"{', '.join(late)} changed meanwhile")
            for name, snapshot in staged.items():
                self.create(name)
                entry = self.collections[name]
                entry |= (settings or {}).get(name, {})
                entry["snapshot"], entry["version"] = snapshot, entry["version"] + 1
                entry["fields"] = self.schemas.pop(snapshot)

    def discard(self, name: str, snapshot: str) -> None:
        """Remove a staged snapshot that is not to be used."""
        folder = self.collections.get(name, {}).get("folder", name)
        self.schemas.pop(snapshot, None)
        self.folder.store.delete_dir(self.folder.at(f"{folder}/{snapshot}"))

    def drop(self, name: str) -> None:
        with self.changing():
            self.settings(name)
            del self.collections[name]

    def vacuum(self, older: float = 86_400) -> int:
        """Remove snapshots that no collection has and that are older than so many seconds; gives their number."""
        n = 0
        with self.alone():
            self.refresh()
            used = {(e["folder"], e["snapshot"]) for e in self.collections.values()}
            for folder in self.folder.folders():
                for snapshot in self.folder.folders(folder):
                    at = f"{folder}/{snapshot}"
                    if (folder, snapshot) not in used and re.fullmatch("v[0-9a-f]{32}", snapshot) and self.folder.age(at) > older:
                        self.folder.store.delete_dir(self.folder.at(at))
                        n += 1
        return n

    # backups

    def backup(self, path: str, base: str | None = None) -> dict:
        """Snapshots and catalog as they are, with a digest of each file; with base only files that it lacks."""
        to = Folder(path)
        self.refresh()
        known = Folder(base).read("backup.json")["files"] if base else {}
        files = {}
        for entry in self.collections.values():
            if entry["snapshot"]:
                at = f"{entry['folder']}/{entry['snapshot']}"
                files |= {f"{at}/{f}": known.get(f"{at}/{f}") or self.folder.digest(f"{at}/{f}") for f in self.folder.files(at)}
        for f in files:
            if f not in known:
                to.copy_from(self.folder, f, f"files/{f}")
        to.write("backup.json", {"files": files, "base": base, "catalog": self.catalog, "at": datetime.now(timezone.utc).isoformat()})
        return {"files": len(files), "copied": len(set(files) - set(known))}

    def verify(self, path: str) -> dict[str, str]:
        """Where each file of a backup lies in its chain; every one must be there and have its digest."""
        said, found = Folder(path).read("backup.json"), {}
        for f, digest in said["files"].items():
            at = path
            while not Folder(at).exists(f"files/{f}"):
                at = Folder(at).read("backup.json")["base"]
                if at is None:
                    raise EngineError(f"{f} is in no backup of the chain")
            if Folder(at).digest(f"files/{f}") != digest:
                raise EngineError(f"{f} is damaged in the backup")
            found[f] = at
        return found

    def restore(self, path: str) -> dict:
        """The store as a backup holds it, once all of it is verified; collections made since then go."""
        said, places = Folder(path).read("backup.json"), self.verify(path)
        for f, at in places.items():
            self.folder.copy_from(Folder(at), f"files/{f}", f)
        with self.changing() as now:
            now.clear()
            now.update(said["catalog"])
        return {"collections": len(self.collections), "files": len(places)}
