"""Folders and small files through Hadoop's file systems, so that any scheme works; and a pointer that moves atomically."""

from __future__ import annotations

import atexit
import json
import re
import tempfile
import threading
import uuid

from pyspark.sql import SparkSession

#: Session, folder and thread of all work folders.
_made: list[tuple[SparkSession, str, int]] = []


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names. Only if that is unset, and all runs on this machine, a temporary one."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if not base:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise RuntimeError("on a cluster spark.checkpoint.dir has to name a shared folder")
        base = tempfile.mkdtemp(prefix="keyloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def work_folder(spark: SparkSession) -> str:
    """A fresh folder name below the shared folder, deleted when the interpreter ends."""
    path = f"{checkpoint_dir(spark)}/keyloom-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_clean)
    _made.append((spark, path, threading.get_ident()))
    return path


def made() -> int:
    """How many work folders there have been so far; see drop_since."""
    return len(_made)


def drop_since(at: int, keep: str | None = None) -> None:
    """Deletes the work folders that this thread made since made() was `at`, but for one: when nothing reads their
    tables any more."""
    for spark, path, thread in _made[at:]:
        if path != keep and thread == threading.get_ident():
            delete(spark, path)


def last_made() -> str:
    """The folder that this thread made last."""
    return next(path for _, path, thread in reversed(_made) if thread == threading.get_ident())


def _clean() -> None:
    for spark, path, _ in _made:
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001  the session is over; nothing is left to do it with
            return


def _at(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _at(spark, path)
    fs.delete(p, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names below a folder; none if it isn't there."""
    p, fs = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


class Pointer:
    """A small JSON file that is replaced by renaming a draft: readers see the old one or the new one, whole."""

    def __init__(self, spark: SparkSession, root: str, name: str = "current.json") -> None:
        self.spark, self.root, self.path = spark, root.rstrip("/"), f"{root.rstrip('/')}/{name}"

    def read(self) -> dict | None:
        p, fs = _at(self.spark, self.path)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def write(self, entries: dict) -> None:
        jvm, gateway = self.spark.sparkContext._jvm.org.apache.hadoop.fs, self.spark.sparkContext._gateway
        at, fs = _at(self.spark, self.path)
        draft = jvm.Path(f"{self.root}/.draft-{uuid.uuid4().hex}")
        stream = fs.create(draft, True)
        stream.write(bytearray(json.dumps(entries).encode()))
        stream.close()
        context = jvm.FileContext.getFileContext(jvm.Path(self.root).toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = gateway.new_array(jvm.Options.Rename, 1)
        options[0] = jvm.Options.Rename.OVERWRITE
        context.rename(draft, at, options)
