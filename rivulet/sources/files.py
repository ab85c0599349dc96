"""Small files and folders in any file system Spark can reach, from the driver."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

from rivulet.sources import hashing

#: Smaller files are read whenever they are asked for.
SMALL = 100_000


class Files:
    def __init__(self, spark: SparkSession, records: str | None = None):
        """``records`` is a folder that keeps what is known of files between runs."""
        self.spark, self.records = spark, records
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """Writes a file that must not exist yet; False if it does."""
        fs, p = self._at(path)
        try:
            out = fs.create(p, False)
        except Exception as e:
            if "already exists" in str(e).lower():
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def write(self, path: str, text: str) -> None:
        """Replaces a file in one step; a reader sees the old or the new text, whatever fails in between."""
        temporary = f"{path}.{uuid.uuid4().hex}"
        self.create(temporary, text)
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.jvm.org.apache.hadoop.fs.Path(path).toUri(), self.conf) if "://" in path else self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.conf)
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context.rename(self.jvm.org.apache.hadoop.fs.Path(temporary), self.jvm.org.apache.hadoop.fs.Path(path), options)

    def move(self, path: str, to: str) -> bool:
        fs, p = self._at(path)
        return fs.rename(p, self._at(to)[1])

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def mkdirs(self, path: str) -> None:
        fs, p = self._at(path)
        fs.mkdirs(p)

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        if not fs.exists(p):
            return []
        return sorted(s.getPath().getName() for s in fs.listStatus(p) if not s.getPath().getName().endswith(".crc"))

    def fingerprint(self, path: str) -> str | None:
        """A hash of a file's content, or of a folder's files and their names; null if there is none. Of a URL what its server says of its version.

        With ``records`` the sizes, times and hashes of files are kept there, and only
        files whose size or time differ from what is kept, and small ones, are read. Large ones are read by the
        executors, unless only the driver can open them.
        """
        from rivulet.plans.deps import digest

        if path.startswith(("http://", "https://")):
            return None if (state := hashing.url_state(path)) is None else digest("url", state)
        fs, p = self._at(path)
        if not fs.exists(p):
            return None
        found = self._listed(fs, p)
        record = f"{self.records}/{digest(path)}.json" if self.records else None
        known = {k: tuple(v) for k, v in json.loads(self.read(record)).items()} if record and self.exists(record) else {}
        hashes = {name: known[name][2] for name, (_, size, time) in found.items() if size >= SMALL and known.get(name, ())[:2] == (size, time)}
        todo = {name: x for name, x in found.items() if name not in hashes}
        large = [(at, size) for at, size, _ in todo.values() if size >= SMALL and hashing.readable(at)]
        by_path = hashing.hash_files(self.spark, large) if large else {}
        for name, (at, size, _) in todo.items():
            hashes[name] = by_path[at] if at in by_path else self._hash(at, size)
        if record and todo:
            self.write(record, json.dumps({name: (size, time, hashes[name]) for name, (_, size, time) in found.items()}))
        return digest(*[f"{name}={hashes[name]}" for name in sorted(found)])

    def _listed(self, fs, p) -> dict[str, tuple[str, int, int]]:
        """(path, size, time) of a file, or of all files below a folder by their names within it."""
        if not fs.getFileStatus(p).isDirectory():
            s = fs.getFileStatus(p)
            return {"": (self._path(s), s.getLen(), s.getModificationTime())}
        top = len(fs.makeQualified(p).toUri().getPath().rstrip("/")) + 1
        found, more = {}, fs.listFiles(p, True)
        while more.hasNext():
            s = more.next()
            if not s.getPath().getName().endswith(".crc"):
                found[s.getPath().toUri().getPath()[top:]] = (self._path(s), s.getLen(), s.getModificationTime())
        return found

    @staticmethod
    def _path(status) -> str:
        uri = status.getPath().toUri()
        return uri.getPath() if uri.getScheme() in (None, "file") else uri.toString()

    def _hash(self, path: str, size: int) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)

        class Pieces:
            def read(_, n: int) -> bytes:
                return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(self.jvm.org.apache.commons.io.input.BoundedInputStream(stream, n)))

        try:
            return hashing.driver_hash(Pieces(), size)
        finally:
            stream.close()
