"""Object storage under a dataset's root: get, range, put, put-if-absent, list, delete; on local disk or any Hadoop file system."""

from __future__ import annotations

import os
import tempfile
import uuid
from dataclasses import dataclass
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from .. import errors as E


@dataclass(frozen=True)
class ObjectMeta:
    key: str
    bytes: int


def check_key(key: str) -> str:
    """`key` if it is relative and has only normal parts."""
    parts = key.split("/")
    if not key or key.startswith("/") or "\\" in key or "\0" in key or any(p in ("", ".", "..") for p in parts):
        raise E.UnsafeManifestPath(f"unsafe object key {key!r}", key=key)
    return key


class LocalBackend:
    """Files below a directory. A put is a rename of a synced file, put-if-absent a hard link: both atomic."""

    def __init__(self, root: str):
        self.root = root.removeprefix("file://").rstrip("/")

    def url(self, key: str) -> str:
        return f"file://{self.root}/{check_key(key)}"

    def _path(self, key: str) -> Path:
        return Path(self.root, check_key(key))

    def exists(self) -> bool:
        return os.path.isdir(self.root)

    def parent_exists(self) -> bool:
        return Path(self.root).parent.is_dir()

    def create(self) -> None:
        os.makedirs(self.root, exist_ok=True)

    def get(self, key: str) -> bytes:
        try:
            return self._path(key).read_bytes()
        except FileNotFoundError:
            raise E.ObjectNotFound(f"no object {key!r}", key=key) from None

    def get_range(self, key: str, start: int, length: int) -> bytes:
        try:
            with self._path(key).open("rb") as f:
                f.seek(start)
                return f.read(length)
        except FileNotFoundError:
            raise E.ObjectNotFound(f"no object {key!r}", key=key) from None

    def _staged(self, key: str, data: bytes) -> tuple[str, Path]:
        target = self._path(key)
        target.parent.mkdir(parents=True, exist_ok=True)
        handle, name = tempfile.mkstemp(prefix=f".tmp-{os.getpid()}-", dir=target.parent)
        with os.fdopen(handle, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        return name, target

    def put(self, key: str, data: bytes) -> None:
        name, target = self._staged(key, data)
        os.replace(name, target)
        target.with_name(f".{target.name}.crc").unlink(missing_ok=True)  # Hadoop's checksum of what was there
        self._sync(target.parent)

    def put_if_absent(self, key: str, data: bytes) -> None:
        name, target = self._staged(key, data)
        try:
            os.link(name, target)
        except FileExistsError:
            raise E.ObjectAlreadyExists(f"object {key!r} exists", key=key) from None
        finally:
            os.unlink(name)
        self._sync(target.parent)

    @staticmethod
    def _sync(folder: Path) -> None:
        handle = os.open(folder, os.O_RDONLY)
        try:
            os.fsync(handle)
        finally:
            os.close(handle)

    def list(self, prefix: str) -> list[ObjectMeta]:
        """Objects below the folder `prefix`, by key; hidden checksum files and commit marks are none."""
        top = self._path(prefix)
        found = (p for p in top.rglob("*") if p.is_file() and not p.name.endswith(".crc") and p.name != "_SUCCESS")
        return sorted((ObjectMeta(f"{prefix}/{p.relative_to(top).as_posix()}", p.stat().st_size) for p in found), key=lambda m: m.key)

    def delete(self, key: str) -> None:
        path = self._path(key)
        path.unlink(missing_ok=True)
        path.with_name(f".{path.name}.crc").unlink(missing_ok=True)


#: Schemes of Hadoop file systems whose rename is atomic and fails where something is.
ATOMIC_RENAME = ("hdfs", "viewfs", "file")


class HadoopBackend:
    """Objects of a file system that Spark reads. put-if-absent renames a finished object without overwriting, in one step.

    Where renaming copies or overwrites, as in object stores, two writers could both publish a version, so those are refused.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.root, self._jvm, self._gateway = root.rstrip("/"), spark.sparkContext._jvm, spark.sparkContext._gateway
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path_of(self.root).getFileSystem(self._conf)

    def _path_of(self, url: str):
        return self._jvm.org.apache.hadoop.fs.Path(url)

    def url(self, key: str) -> str:
        return f"{self.root}/{check_key(key)}"

    def exists(self) -> bool:
        return self._fs.exists(self._path_of(self.root))

    def parent_exists(self) -> bool:
        return self._fs.exists(self._path_of(self.root).getParent())

    def create(self) -> None:
        self._fs.mkdirs(self._path_of(self.root))

    def _open(self, key: str):
        path = self._path_of(self.url(key))
        if not self._fs.exists(path):
            raise E.ObjectNotFound(f"no object {key!r}", key=key)
        return self._fs.open(path)

    def get(self, key: str) -> bytes:
        stream = self._open(key)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def get_range(self, key: str, start: int, length: int) -> bytes:
        stream = self._open(key)
        try:
            stream.seek(start)
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(self._jvm.org.apache.commons.io.input.BoundedInputStream(stream, length)))
        finally:
            stream.close()

    def _write(self, path, data: bytes, overwrite: bool) -> None:
        stream = self._fs.create(path, overwrite)
        try:
            stream.write(data)
            stream.hsync()
        finally:
            stream.close()

    def put(self, key: str, data: bytes) -> None:
        self._write(self._path_of(self.url(key)), data, True)

    def put_if_absent(self, key: str, data: bytes) -> None:
        path = self._path_of(self.url(key))
        scheme = self._fs.getUri().getScheme()
        if scheme not in ATOMIC_RENAME:
            raise E.DurabilityUnsupported(f"no atomic put-if-absent on {scheme}://", scheme=scheme)
        part = self._path_of(f"{self.root}/{key.rpartition('/')[0]}/.tmp-{os.getpid()}-{uuid.uuid4().hex}")
        self._write(part, data, True)
        hadoop = self._jvm.org.apache.hadoop.fs
        how = self._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
        how[0] = getattr(hadoop, "Options$Rename").NONE
        try:
            hadoop.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(self._fs.makeQualified(part), self._fs.makeQualified(path), how)
        except Py4JJavaError as error:
            self._fs.delete(part, False)
            if "FileAlreadyExists" not in error.java_exception.getClass().getName():
                raise OSError(str(error.java_exception)) from error
            raise E.ObjectAlreadyExists(f"object {key!r} exists", key=key) from None

    def list(self, prefix: str) -> list[ObjectMeta]:
        top = self._path_of(self.url(prefix))
        if not self._fs.exists(top):
            return []
        files, out = self._fs.listFiles(top, True), []
        base = self._fs.makeQualified(top).toString()
        while files.hasNext():
            f = files.next()
            name = f.getPath().getName()
            if not name.endswith(".crc") and name != "_SUCCESS":
                out.append(ObjectMeta(f"{prefix}/{f.getPath().toString()[len(base) + 1 :]}", f.getLen()))
        return sorted(out, key=lambda m: m.key)

    def delete(self, key: str) -> None:
        self._fs.delete(self._path_of(self.url(key)), False)


def backend_for(spark: SparkSession, root: str) -> LocalBackend | HadoopBackend:
    scheme = root.partition("://")[0] if "://" in root else "file"
    return LocalBackend(root) if scheme == "file" else HadoopBackend(spark, root)
