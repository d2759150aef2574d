"""Listings that `tree -J` prints, flattened to nodes."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

NODE = "document string, rel_path string, name string, type string, size long, mtime string, inode long, dev long, depth long, root_dev long"
_KINDS = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]


def walk(text: str) -> Iterator[tuple]:
    """(rel_path, name, type, size, mtime, inode, dev, depth, root_dev) of a listing, parents before children.

    The root element is left out and its children stand at depth 0; `report` elements are skipped anywhere; a missing size
    is 0. Depth is read off the parent's path, so a name with a slash counts as several steps. Invalid JSON raises ValueError.
    """
    try:
        roots = json.loads(text)
    except ValueError as e:
        raise ValueError(f"Invalid tree JSON: {e}") from None
    roots = [r for r in roots if r.get("type") != "report"]
    root_dev = roots[0].get("dev") if roots else None
    stack = [("", child) for r in reversed(roots) for child in reversed(r.get("contents") or [])]
    while stack:
        parent, e = stack.pop()
        if e.get("type") == "report":
            continue
        name = e.get("name", "")
        path = f"{parent}/{name}" if parent else name
        yield path, name, e.get("type", "file"), e.get("size") or 0, e.get("time"), e.get("inode"), e.get("dev"), parent.count("/") + 1 if parent else 0, root_dev
        stack.extend((path, child) for child in reversed(e.get("contents") or []))


def flatten(documents: DataFrame, key: str, text: str) -> DataFrame:
    """Nodes of every listing; `document` names the listing. Nesting may be of any depth."""

    def run(batches):
        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows = []
                for node in walk(t.as_py()):
                    rows.append((k, *node))
                    if len(rows) == 10_000:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    return documents.select(documents[key].cast("string"), text).mapInArrow(run, NODE)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in NODE.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _KINDS, strict=True)], names)
