"""A store of source files and snapshots, below one path of any file system that Spark reaches."""

from __future__ import annotations

import hashlib
import json
import mimetypes

from pyspark.sql import SparkSession

#: The longest object that passes through the driver; larger ones are read by Spark as binaryFile rows.
LARGEST = 256 << 20


class ObjectStore:
    """Single objects by key: put, get, stat, list and delete, each through the driver."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, key: str):
        if ".." in key.split("/"):
            raise ValueError(f"bad key {key!r}")
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{key}" if key else self.root)

    @staticmethod
    def key(prefix: str, dataset: str, document: str, content: bytes, name: str) -> str:
        """prefix/dataset/document/sha256.ext: equal contents have equal keys."""
        ext = f".{name.rsplit('.', 1)[-1].lower()}" if "." in name.rsplit("/", 1)[-1] else ""
        return f"{prefix}/{dataset}/{document}/{hashlib.sha256(content).hexdigest()}{ext}"

    def put(self, key: str, content: bytes) -> str:
        """Writes an object whole or not at all; one that is there already is left."""
        at = self._at(key)
        if self.fs.exists(at):
            return key
        part = self._at(f"{key}.part-{hashlib.sha256(content).hexdigest()[:12]}")
        out = self.fs.create(part, True)
        out.write(bytearray(content))
        out.close()
        if not self.fs.rename(part, at):
            self.fs.delete(part, False)
        return key

    def get(self, key: str) -> bytes:
        size = self.stat(key)["size"]
        if size > LARGEST:
            raise ValueError(f"{key} has {size} bytes; read it with Spark")
        return bytes(self.spark.read.format("binaryFile").load(f"{self.root}/{key}").select("content").first()[0])

    def stat(self, key: str) -> dict:
        """size and type; KeyError without such an object."""
        at = self._at(key)
        if not self.fs.exists(at):
            raise KeyError(key)
        return {"size": self.fs.getFileStatus(at).getLen(), "type": mimetypes.guess_type(key)[0] or "application/octet-stream"}

    def list(self, prefix: str) -> list[str]:
        """Keys below a folder, in order."""
        at = self._at(prefix)
        if not self.fs.exists(at):
            return []
        files, out = self.fs.listFiles(at, True), []
        base = self.fs.getFileStatus(self._at("")).getPath().toString()
        while files.hasNext():
            out.append(files.next().getPath().toString().removeprefix(base).lstrip("/"))
        return sorted(out)

    def delete(self, prefix: str) -> int:
        """Deletes an object or a folder; how many objects went."""
        at = self._at(prefix)
        if not self.fs.exists(at):
            return 0
        n = len(self.list(prefix)) or 1
        self.fs.delete(at, True)
        return n

    def resolve(self, prefix: str) -> tuple[str, str]:
        """(key, type) of a document: its first .pdf, else its first object."""
        keys = self.list(prefix)
        if not keys:
            raise KeyError(prefix)
        key = next((k for k in keys if k.lower().endswith(".pdf")), keys[0])
        return key, self.stat(key)["type"]

    # -- snapshots of one document
    @staticmethod
    def snapshot_key(prefix: str, dataset: str, iri: str) -> str:
        return f"{prefix}/{dataset}/snapshots/{hashlib.sha256(iri.encode()).hexdigest()[:16]}.json"

    def save_snapshot(self, prefix: str, dataset: str, iri: str, state: dict) -> str:
        """One document's rows as JSON; a newer snapshot takes the place of the old one."""
        key = self.snapshot_key(prefix, dataset, iri)
        self.delete(key)
        return self.put(key, json.dumps({"iri": iri, **state}, sort_keys=True, default=str).encode())

    def load_snapshot(self, prefix: str, dataset: str, iri: str) -> dict | None:
        try:
            return json.loads(self.get(self.snapshot_key(prefix, dataset, iri)))
        except KeyError:
            return None
