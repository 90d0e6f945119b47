"""Small files of a collection, such as its manifest, in any store that Spark's Hadoop configuration knows."""

from __future__ import annotations

import json
import re
import tempfile
import threading
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

_LOCK = threading.Lock()


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a temporary folder where the master is this machine; a cluster without that setting is an error."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured
    if not sc.getCheckpointDir():
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="trawl-checkpoints-"))
    return sc.getCheckpointDir()


class Files:
    def __init__(self, spark: SparkSession):
        self._jvm, self._conf, self._gateway = spark._jvm, spark._jsc.hadoopConfiguration(), spark.sparkContext._gateway

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def exists(self, path: str) -> bool:
        store, p = self._at(path)
        return store.exists(p)

    def delete(self, path: str) -> bool:
        store, p = self._at(path)
        return store.delete(p, True)

    def list(self, path: str) -> list[str]:
        store, p = self._at(path)
        return sorted(s.getPath().getName() for s in store.listStatus(p)) if store.exists(p) else []

    def size(self, path: str) -> int:
        """Bytes below a path."""
        store, p = self._at(path)
        return store.getContentSummary(p).getLength() if store.exists(p) else 0

    def copy(self, source: str, to: str) -> None:
        a, p = self._at(source)
        b, q = self._at(to)
        self._jvm.org.apache.hadoop.fs.FileUtil.copy(a, p, b, q, False, True, self._conf)

    def read_json(self, path: str) -> dict:
        store, p = self._at(path)
        stream = store.open(p)
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def create_json(self, path: str, value: dict) -> bool:
        """Written aside, then renamed to a path that must not exist yet; false if another writer was first, and then nothing has changed."""
        aside = f"{path}.{uuid.uuid4().hex}"
        store, p = self._at(aside)
        out = store.create(p, True)
        out.write(bytearray(json.dumps(value, sort_keys=True).encode()))
        out.close()
        with _LOCK:  # a local file system renames over what is there, so writers of this process take turns to look
            if not self.exists(path) and self._renamed(aside, path, "NONE"):
                return True
        self.delete(aside)
        return False

    def _renamed(self, source: str, to: str, how: str) -> bool:
        store, p = self._at(source)
        _, target = self._at(to)
        kind = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self._gateway.new_array(kind, 1)
        options[0] = getattr(kind, how)
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(store.makeQualified(p).toUri(), self._conf)
        try:
            context.rename(store.makeQualified(p), store.makeQualified(target), options)
        except Py4JJavaError as error:
            if how == "NONE" and "FileAlreadyExists" in str(error.java_exception.getClass().getName()):
                return False
            raise
        return True

    def write_json(self, path: str, value: dict) -> None:
        """Written aside, then renamed over the old one, so a reader sees either."""
        aside = f"{path}.{uuid.uuid4().hex}"
        store, p = self._at(aside)
        out = store.create(p, True)
        out.write(bytearray(json.dumps(value, sort_keys=True).encode()))
        out.close()
        self._renamed(aside, path, "OVERWRITE")
