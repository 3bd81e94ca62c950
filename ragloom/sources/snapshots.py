"""Versioned tables: data goes to new folders, and a small manifest that is renamed into place says which of them are current.

A reader resolves the manifest once and keeps reading the folders it names, whatever is published meanwhile. A write that fails
before its manifest is in place changes nothing. Of two writers that publish the same version, the later one gets `Conflict`.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

FOLDER = "_versions"


class Conflict(RuntimeError):
    """Another writer has published this version."""


def at(spark: SparkSession, path: str):
    """(file system, path) in Hadoop's terms."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, path: str) -> list[int]:
    """The published versions, oldest first."""
    fs, p = at(spark, f"{path}/{FOLDER}")
    names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))


def manifest(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, dict]:
    """(version, what it says) of the given or the last version; (0, {}) where nothing is published."""
    if version is None:
        version = max(versions(spark, path), default=0)
        if not version:
            return 0, {}
    fs, p = at(spark, f"{path}/{FOLDER}/{version:012}.json")
    stream = fs.open(p)
    try:
        return version, json.loads(bytes(stream.readAllBytes()))
    finally:
        stream.close()


def publish(spark: SparkSession, path: str, says: dict, after: int) -> int:
    """Make ``says`` the version that follows ``after``."""
    fs, p = at(spark, f"{path}/{FOLDER}/{after + 1:012}.json")
    _, draft = at(spark, f"{path}/{FOLDER}/.draft-{uuid.uuid4().hex}")
    out = fs.create(draft)
    out.write(json.dumps(says).encode())
    out.close()
    if fs.exists(p) or not fs.rename(draft, p):
        fs.delete(draft, False)
        raise Conflict(f"version {after + 1} of {path} is already there")
    return after + 1


def fresh(tag: str = "data") -> str:
    """A new folder's name."""
    return f"{tag}-{uuid.uuid4().hex}"


def prune(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Delete all but the last ``keep`` versions, and the folders that only they name or that no version names. No reader of an older
    version and no writer may be at work."""
    every = versions(spark, path)
    named = json.dumps([manifest(spark, path, v)[1] for v in every[-keep:]])
    for v in every[:-keep]:
        fs, p = at(spark, f"{path}/{FOLDER}/{v:012}.json")
        fs.delete(p, False)
    fs, p = at(spark, path)
    for f in fs.listStatus(p):
        name = f.getPath().getName()
        if name != FOLDER and f'"{name}' not in named:
            fs.delete(f.getPath(), True)
