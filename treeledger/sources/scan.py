"""Folder scans and the media they lie on."""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODE = "rel_path string, name string, type string, size long, mtime string, inode long, dev long, depth int, link_target string"


def format_time(seconds: float) -> str:
    """Local time, as listings print it."""
    return time.strftime("%Y-%m-%d_%H:%M:%S", time.localtime(seconds))


def walk(root: str, progress: Callable[[int], None] = lambda n: None) -> Iterator[tuple]:
    """Nodes below a folder, parents first. Links are not followed; what cannot be read is left out."""
    stack, n = [("", root, 0)], 0
    while stack:
        rel, folder, depth = stack.pop()
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError:
            continue
        for e in entries:
            try:
                st = e.stat(follow_symlinks=False)
                target = os.readlink(e.path) if e.is_symlink() else None
            except OSError:
                continue
            kind = "link" if target is not None else "directory" if e.is_dir(follow_symlinks=False) else "file"
            path = f"{rel}/{e.name}" if rel else e.name
            yield path.replace("\\", "/"), e.name, kind, 0 if kind == "directory" else st.st_size, format_time(st.st_mtime), st.st_ino, st.st_dev, depth, target
            if kind == "directory":
                stack.append((path, e.path, depth + 1))
            n += 1
            if n % 200 == 0:
                progress(n)


def scan_folder(spark: SparkSession, root: str, progress: Callable[[int], None] = lambda n: None) -> DataFrame:
    """Nodes of one folder of the driver's machine."""
    return spark.createDataFrame(list(walk(root, progress)), NODE)


def scan_folders(spark: SparkSession, roots: list[str]) -> DataFrame:
    """Nodes of many folders that executors can read, one task for each; `root` names the folder."""
    import pandas as pd

    names = [c.split()[0] for c in NODE.split(", ")]

    def run(batches):
        for b in batches:
            for root in b["root"]:
                rows = []
                for r in walk(root):
                    rows.append((root, *r))
                    if len(rows) == 20_000:
                        yield pd.DataFrame(rows, columns=["root", *names])
                        rows = []
                yield pd.DataFrame(rows, columns=["root", *names])

    return spark.createDataFrame([(r,) for r in roots], "root string").repartition(max(1, len(roots))).mapInPandas(run, "root string, " + NODE)


def preview(nodes: DataFrame, hash_min_size: int) -> DataFrame:
    """What a scan would bring: files, bytes, and those that a threshold would have digested."""
    files, size = nodes.where("type = 'file'"), F.col("size")
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"), F.count_if(size >= hash_min_size).alias("hashed_files"), F.coalesce(F.sum(F.when(size >= hash_min_size, size)), F.lit(0)).alias("hashed_bytes"))


@dataclass(frozen=True)
class ReadProfile:
    small_readers: int
    large_readers: int
    large_from: int | None
    physical_order: bool
    min_size: int
    sampled: bool


def profile_for(medium: str) -> ReadProfile:
    """How to read a medium: solid state in parallel and whole; anything else with few readers, in physical order and sampled."""
    return ReadProfile(32, 32, None, False, 0, False) if medium == "ssd" else ReadProfile(4, 1, 32 << 20, True, 64 << 10, True)


def medium_of(path: str, mounts: str = "/proc/mounts", blocks: str = "/sys/class/block") -> tuple[str, str | None]:
    """(hdd, ssd, network, optical or unknown; file system) of a path, on Linux."""
    try:
        lines = [line.split() for line in Path(mounts).read_text().splitlines()]
        real = os.path.realpath(path)
        at = [x for x in lines if len(x) > 2 and (real == x[1] or real.startswith(x[1].rstrip("/") + "/"))]
        device, _, fs = max(at, key=lambda x: len(x[1]))[:3]
    except (OSError, ValueError):
        return "unknown", None
    if fs in ("nfs", "nfs4", "cifs", "smb3", "sshfs", "fuse.sshfs"):
        return "network", fs
    if fs in ("iso9660", "udf"):
        return "optical", fs
    try:
        own = Path(blocks, os.path.basename(os.path.realpath(device))).resolve()
        turns = next(p for p in (own / "queue/rotational", own.parent / "queue/rotational") if p.exists()).read_text().strip()
        return ("hdd" if turns == "1" else "ssd"), fs
    except (OSError, StopIteration):
        return "unknown", fs
