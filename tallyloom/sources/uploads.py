"""A folder of uploaded files on any file system that Hadoop knows: clean names with a time, no way out of the folder."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import SparkSession


def clean_name(name: str) -> str:
    """The last part of a path with everything but letters, digits, dot, underscore and hyphen as an underscore."""
    return re.sub(r"[^A-Za-z0-9._-]+", "_", re.split(r"[\\/]", name)[-1]).lstrip(".") or "file"


def _place(spark: SparkSession, path: str) -> tuple:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def resolve(spark: SparkSession, root: str, name: str) -> str:
    """The path of a stored file; a name that isn't a plain one, or isn't there, is an error."""
    if name != clean_name(name):
        raise ValueError(f"not a stored name: {name}")
    fs, p = _place(spark, f"{root.rstrip('/')}/{name}")
    if not fs.exists(p):
        raise FileNotFoundError(name)
    return fs.makeQualified(p).toString()


def keep_upload(spark: SparkSession, root: str, name: str, content: bytes, at: datetime) -> str:
    """Write an upload under its clean name with the time before it; its path."""
    stored = f"{at:%Y%m%d_%H%M%S_%f}_{clean_name(name)}"
    fs, p = _place(spark, f"{root.rstrip('/')}/{stored}")
    out = fs.create(p, False)
    try:
        out.write(bytearray(content))
    finally:
        out.close()
    return resolve(spark, root, stored)


def pick(spark: SparkSession, root: str, name: str | None = None) -> str:
    """The named file, or the only one; none or several is an error that lists them, the latest first."""
    if name:
        return resolve(spark, root, name)
    fs, p = _place(spark, root)
    files = [f for f in (fs.listStatus(p) if fs.exists(p) else []) if f.isFile() and not f.getPath().getName().startswith((".", "_"))]
    if not files:
        raise FileNotFoundError(f"no files in {root}")
    if len(files) > 1:
        names = [f.getPath().getName() for f in sorted(files, key=lambda f: -f.getModificationTime())]
        raise ValueError(f"several files in {root}, name one of them: {', '.join(names)}")
    return files[0].getPath().toString()
