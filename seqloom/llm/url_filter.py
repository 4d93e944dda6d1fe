"""URL filter by rules in a sorted digest array (operator 4).

The rules' strings are kept in a folder: their 64-bit xxhash keys, sorted, in one file that tasks map into memory, and
the strings, in the same order, for confirmation. A url's candidates (each suffix of its host's labels with each path
prefix as long as some rule's path) are hashed, found by vectorised binary search, and confirmed against the strings,
so that two strings with one key do no harm. The longest rule that fits wins. The array says block only for what
it holds: a url that no rule fits is allowed.

The driver writes the two files to the shared folder, and SparkContext.addFile brings them to each executor; each task maps
them. Their size is checked against max_bytes first.

Defined results: a null url, or one without ://, has an empty host and path, no rule, and is allowed. Repeated rows
count each; an empty table gives an empty table; an empty rule list allows all.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, new_path

Rule = tuple[str, str, str]
#: The contract's rules: host, path, verdict.
RULES: list[Rule] = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path: after the first :// up to /, ? or #, and from there up to ? or #."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    tail = rest[end:]
    stop = min((i for i in map(tail.find, "?#") if i >= 0), default=len(tail))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), tail[:stop]


def write_digests(rules: Sequence[Rule], folder: str, max_bytes: int = 2 << 30, key=xxhash.xxh64_intdigest) -> tuple[str, str]:
    """The array's two files in a folder (a path or a URI). Strings are kept as offsets and bytes; the verdict is a string's first
    byte. The later of two equal rules stays."""
    last = {h + p: v for h, p, v in rules}
    items = sorted((key(s.encode()), s, v) for s, v in last.items())
    if (need := sum(25 + len(s.encode()) for _, s, _ in items)) > max_bytes:
        raise ValueError(f"the rules take {need} bytes, the limit is {max_bytes}")
    name, (to, base) = uuid.uuid4().hex, fs.FileSystem.from_uri(folder)
    to.create_dir(base, recursive=True)
    blob = [v[0].encode() + s.encode() for _, s, v in items]
    paths = sorted({len(p) for _, p, _ in rules})
    keys = np.array([len(items), len(paths), *paths, *(k for k, _, _ in items)], np.uint64).tobytes()
    strings = np.cumsum([0, *map(len, blob)], dtype=np.int64).tobytes() + b"".join(blob)
    for part, data in (("keys", keys), ("strings", strings)):
        with to.open_output_stream(f"{base}/{part}-{name}") as f:
            f.write(data)
    return f"{folder}/keys-{name}", f"{folder}/strings-{name}"


class DigestArray:
    """The files, mapped into memory."""

    def __init__(self, keys: str, strings: str, key=xxhash.xxh64_intdigest):
        words = np.memmap(keys, np.uint64, "r")
        n, p = int(words[0]), int(words[1])
        self.lengths, self.keys, self.hash = [int(x) for x in words[2 : 2 + p]], words[2 + p :], key
        self.offsets = np.memmap(strings, np.int64, "r", shape=(n + 1,))
        self.blob = np.memmap(strings, np.uint8, "r", offset=8 * (n + 1)) if n else np.zeros(0, np.uint8)

    def find(self, strings: list[bytes]) -> list[str | None]:
        """The verdict of each string, None where the array lacks it."""
        out: list[str | None] = [None] * len(strings)
        if not strings or not len(self.keys):
            return out
        probe = np.fromiter(map(self.hash, strings), np.uint64, len(strings))
        first, last = np.searchsorted(self.keys, probe), np.searchsorted(self.keys, probe, "right")
        for i in np.flatnonzero(first < last):
            for k in range(first[i], last[i]):
                item = self.blob[self.offsets[k] : self.offsets[k + 1]].tobytes()
                if item[1:] == strings[i]:
                    out[i] = "allow" if item[:1] == b"a" else "block"
        return out

    def judge(self, urls: list[tuple[str, str]]) -> list[tuple[str | None, str]]:
        """The rule and the verdict of each host and path."""
        tries: list[bytes] = []
        of: list[int] = []
        for i, (host, path) in enumerate(urls):
            labels = host.split(".")
            for k in range(len(labels)):
                suffix = ".".join(labels[k:])
                for n in self.lengths:
                    if suffix and n <= len(path):
                        tries.append((suffix + path[:n]).encode("utf-8", "surrogatepass"))
                        of.append(i)
        best: list[tuple[str | None, str]] = [(None, "allow")] * len(urls)
        for i, s, verdict in zip(of, tries, self.find(tries), strict=True):
            if verdict and len(rule := s.decode()) > len(best[i][0] or ""):
                best[i] = (rule, verdict)
        return best


def judge_urls(spark: SparkSession, urls: DataFrame, id_col: str, url_col: str, rules: Sequence[Rule]) -> DataFrame:
    """id_col, host, path, rule, verdict of each row. No shuffle."""
    files = write_digests(rules, new_path(spark, "digests"))
    for f in files:
        spark.sparkContext.addFile(f)
    names = [os.path.basename(f) for f in files]
    held: list[DigestArray] = []

    def judged(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not held:
            held.append(DigestArray(*(SparkFiles.get(n) for n in names)))
        parts = [split_url(u) for u in batch.column(1).to_pylist()]
        found = held[0].judge(parts)
        columns = [[h for h, _ in parts], [p for _, p in parts], [r for r, _ in found], [v for _, v in found]]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in columns)], ["_id", "host", "path", "rule", "verdict"])

    kind = urls.schema[id_col].dataType.simpleString()
    rows = urls.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url"))
    return map_batches(rows, judged, f"_id {kind}, host string, path string, rule string, verdict string").withColumnRenamed("_id", id_col)


ORACLE_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*', 0, 's') AS raw, rest FROM u),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*', 0, 's') AS path FROM h),
r(rh, rp, rv) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m AS (SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(rv, length(rh || rp)) AS v FROM p JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
SELECT p.page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM p LEFT JOIN m ON p.page_id = m.page_id
"""
