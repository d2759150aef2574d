"""Scalar functions of the catalogue as Column expressions; all run inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Trusted file systems, size buckets (upper bounds, exclusive) and tier floors.
TRUSTED_FILESYSTEMS = ("ntfs", "refs", "ext2", "ext3", "ext4", "xfs", "btrfs", "apfs", "hfs+", "hfsplus", "zfs")
BUCKETS = (("00. empty", 1), ("01. <1K", 1 << 10), ("02. 1K-4K", 1 << 12), ("03. 4K-16K", 1 << 14), ("04. 16K-64K", 1 << 16), ("05. 64K-256K", 1 << 18), ("06. 256K-1M", 1 << 20), ("07. 1M-4M", 1 << 22), ("08. 4M-16M", 1 << 24), ("09. 16M-64M", 1 << 26), ("10. 64M-256M", 1 << 28), ("11. 256M-1G", 1 << 30), ("12. 1G-4G", 1 << 32), ("13. 4G-8G", 1 << 33), ("14. >=8G", None))
TIER_FLOORS = (("A", 100), ("B", 99), ("C", 70), ("D", 55), ("E", 45))
PALETTE_SIZE = 8


def node_key(source_id: Column, rel_path: Column) -> Column:
    """A node's id: the first 60 bits of a digest of source and path. Needs no shuffle and no counter, and parents' ids follow from paths."""
    return F.conv(F.substring(F.md5(F.concat(source_id.cast("string"), F.lit(":"), rel_path)), 1, 15), 16, 10).cast("long")


def parent_path(rel_path: Column) -> Column:
    """All but the last step; empty at the top."""
    return F.regexp_extract(rel_path, r"(?s)^(.*)/[^/]*$", 1)


def base_name(rel_path: Column) -> Column:
    return F.regexp_extract(rel_path, r"(?s)([^/]*)$", 1)


def ext(name: Column) -> Column:
    """Lower-cased text after the last dot, empty where that dot is the first character or there is none."""
    return F.lower(F.regexp_extract(name, r"(?s)^.+\.([^.]*)$", 1))


def mtime_seconds(mtime: Column) -> Column:
    """Seconds of a `YYYY-MM-DD_HH:MM:SS` time, null where it is not one. Independent of the session's time zone."""
    part = lambda at: F.substring(mtime, at, 2).cast("int")
    day = F.try_to_timestamp(F.substring(mtime, 1, 10), F.lit("yyyy-MM-dd")).cast("date")
    seconds = F.unix_date(day).cast("long") * 86400 + part(12) * 3600 + part(15) * 60 + part(18)
    return F.when(mtime.rlike(r"^\d{4}-\d{2}-\d{2}_([01]\d|2[0-3]):[0-5]\d:[0-5]\d$"), seconds)


def mtime_match(a: Column, b: Column, a_s: Column | None = None, b_s: Column | None = None) -> Column:
    """strong, moderate or null. Equal texts are strong even when they are no times; otherwise up to 2 s apart is strong, and whole hours up to 14 moderate."""
    gap = F.abs((mtime_seconds(a) if a_s is None else a_s) - (mtime_seconds(b) if b_s is None else b_s))
    return F.when((a == b) | (gap <= 2), "strong").when((gap > 0) & (gap % 3600 == 0) & (gap <= 14 * 3600), "moderate")


def mtime_norm(mtime: Column) -> Column:
    """Even seconds; a missing time is the least number and an unreadable one the next."""
    s = mtime_seconds(mtime)
    return F.when(mtime.isNull(), F.lit(-(1 << 63))).when(s.isNull(), F.lit(-(1 << 63) + 1)).otherwise(s - F.pmod(s, F.lit(2)))


def contains_folded(name: Column, query: str, case_sensitive: bool = False) -> Column:
    """Whether the query occurs in the name; false for a null name, true for an empty query."""
    found = name.contains(query) if case_sensitive else F.lower(name).contains(query.lower())
    return F.coalesce(found, F.lit(False))


def glob_contains(name: Column, query: str, case_sensitive: bool = False) -> Column:
    """Like contains_folded, with * for any text and ? for one character; there is no escape."""
    query, name = (query, name) if case_sensitive else (query.lower(), F.lower(name))
    pattern = "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in query)
    return F.coalesce(name.rlike("(?s)" + pattern), F.lit(False))


def search_match(name: Column, query: str, case_sensitive: bool = False) -> Column:
    """The search predicate: a substring, or a glob when the query has * or ?."""
    return (glob_contains if "*" in query or "?" in query else contains_folded)(name, query, case_sensitive)


def hash_kind_for(size: Column, threshold: int | None) -> Column:
    return F.lit("full") if threshold is None else F.when(size < threshold, "full").otherwise("sampled")


def filesystem_is_trusted(fs: Column) -> Column:
    return F.coalesce(F.lower(fs).isin(*TRUSTED_FILESYSTEMS), F.lit(False))


def normalize_type(kind: Column) -> Column:
    return F.when(kind == "directory", "directory").otherwise("file")


def cache_volume_id(volume_id: Column, dev: Column) -> Column:
    return F.coalesce(F.nullif(volume_id, F.lit("")), dev.cast("string"))


def size_bucket(size: Column) -> Column:
    out = None
    for label, top in BUCKETS:
        out = (F if out is None else out).when(size < top, label) if top is not None else out.otherwise(label)
    return out


def match_tier(confidence: Column) -> Column:
    """The tier whose band [floor, next stricter floor) holds a confidence; null under the last."""
    out = None
    for tier, floor in TIER_FLOORS:
        out = (F if out is None else out).when(confidence >= floor, tier)
    return out


def snap_match_floor(confidence: float) -> int:
    """The loosest floor that is no lower than a confidence; the strictest for any above it."""
    return min((f for _, f in TIER_FLOORS if f >= confidence), default=TIER_FLOORS[0][1])


UNITS = ("B", "KB", "MB", "GB", "TB", "PB")


def format_bytes(n: Column) -> Column:
    """Size in units of 1024: no decimals for bytes and from 10 on, else one."""
    out = F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
    for i, unit in enumerate(UNITS[1:], 1):
        v = n / float(1024**i)
        text = F.when(v >= 10, F.floor(v + 0.5).cast("string")).otherwise(F.format_string("%.1f", F.floor(v * 10 + 0.5) / 10))
        out = out.when(n < 1024 ** (i + 1), F.concat(text, F.lit(f" {unit}"))) if unit != "PB" else out.otherwise(F.concat(text, F.lit(" PB")))
    return out


def widest_bytes(most: int) -> int:
    """Length of the longest text that format_bytes gives for any size up to `most`: the longest of a unit is that just under the next unit."""
    from math import floor

    def text(n: int) -> str:
        step = min(5, max(0, (max(n, 1).bit_length() - 1) // 10))
        v = n / 1024**step
        return f"{floor(v + 0.5)} {UNITS[step]}" if step == 0 or v >= 10 else f"{floor(v * 10 + 0.5) / 10:.1f} {UNITS[step]}"

    tops = [1024**i - 1 for i in range(1, 63) if 1024**i - 1 <= most]
    return max(len(text(n)) for n in [most, *tops])


def format_time(time: Column) -> Column:
    """A listing's time with a space between date and time; a dash for none."""
    return F.coalesce(F.regexp_replace(F.nullif(time, F.lit("")), "^([^_]*)_", "$1 "), F.lit("—"))


def pct(value: Column, digits: int = 0) -> Column:
    """Clamped to 0-100 and rounded half up."""
    scale = 10.0**digits
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(100.0), value)) * scale + 0.5) / scale


def tree_order(kind: Column, name: Column, node_id: Column) -> list[Column]:
    """Sort keys of a tree's rows: folders first, then names with digit runs by value and case folded, then the raw name, then the id."""
    digits = F.regexp_replace(F.lower(name), r"(\d+)", "\u0000$1\u0000")
    runs = F.transform(F.split(digits, "\u0000"), lambda p: F.when(p.rlike(r"^\d+$"), F.lpad(p, 20, "0")).otherwise(p))
    return [(kind != "directory"), F.array_join(runs, ""), name, node_id]


def source_color(source_id: Column) -> Column:
    return F.pmod(source_id, F.lit(PALETTE_SIZE))


def confidence_tone(confidence: Column) -> Column:
    return F.when(confidence >= 95, "strong").when(confidence >= 75, "medium").otherwise("weak")


def join_path(parts: Column, separator: str = "/") -> Column:
    return F.array_join(F.filter(parts, lambda p: p != ""), separator)


def path_segments(path: Column) -> Column:
    return F.filter(F.split(path, r"[/\\]"), lambda p: p != "")


def highlights(name: Column, query: str, case_sensitive: bool = False) -> Column:
    """The runs of a name that a query marks; none where lower-casing changes its length."""
    pattern = "(?s)" + ("" if case_sensitive else "(?iu)") + "".join({"*": ".*?", "?": "."}.get(c, re.escape(c)) for c in query)
    runs = F.filter(F.regexp_extract_all(name, F.lit(pattern), F.lit(0)), lambda x: x != "")
    return F.when(F.length(F.lower(name)) == F.length(name), runs).otherwise(F.array().cast("array<string>"))
