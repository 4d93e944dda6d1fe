"""Host-level quality rules (operator 10).

Each text gets base statistics and fails the base rules or not. Failures are then counted by host (any column: source,
domain); each host's rate is shrunk with an empirical beta prior, fitted to all hosts by moments, and a host whose
shrunken rate is above the limit is rejected as a whole. The verdict goes back to its documents.

Defined results: a null or empty text has no words, so it fails; a null host is a host of its own; repeated rows count
each; an empty table gives an empty table; only the named columns are read, so others may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, key_of, map_batches, materialized, with_groups

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_ODD = np.uint64(0x9E3779B97F4A7C15)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of so many words that is found twice or more."""
    n = len(words)
    if n <= window:
        return 0
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    key = np.zeros(n - window + 1, np.uint64)
    for k in range(window):
        key = key * _ODD + h[k : n - window + 1 + k]
    order = np.sort(key)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    at = np.flatnonzero(np.isin(key, twice))
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + window, -1)
    return int((np.cumsum(change)[:-1] > 0).sum())


def text_stats(text: str | None) -> tuple[int, int, int, int, int]:
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    spaces = len(raw) - len(raw.translate(None, SPACES))
    return len(words), len(text) - spaces, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def failed_base(stats: tuple[int, int, int, int, int]) -> bool:
    return stats[0] < 20 or 100 * stats[4] > 30 * stats[0]


def _stats(batch: pa.RecordBatch) -> pa.RecordBatch:
    columns = zip(*(text_stats(x) for x in batch.column(2).to_pylist()), strict=True) if batch.num_rows else [[]] * 5
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in columns)], ["_id", "_host", *(x.split()[0] for x in STATS.split(", "))])


def base_stats(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """A row for each document: _id, _host, the statistics and base_failed."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = map_batches(docs.select(F.col(id_col).alias("_id"), key_of(F.col(host_col)).alias("_host"), F.col(text_col).cast("string").alias("_text")), _stats, f"_id {kind}, _host string, {STATS}")
    return rows.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """alpha and beta by moments from hosts(n, fails). One row of sums comes to the driver. Without spread between the
    hosts, the prior is as strong as a million documents, so that every host gets the mean."""
    s = hosts.agg(F.sum("n").alias("n"), F.sum("fails").alias("f"), F.count("*").alias("hosts"), F.sum(F.col("fails") * F.col("fails") / F.col("n")).alias("ff")).first()
    if not s["n"]:
        return 1.0, 1.0
    mean = min(max(s["f"] / s["n"], 1e-6), 1 - 1e-6)
    between = s["ff"] / s["n"] - (s["f"] / s["n"]) ** 2 - mean * (1 - mean) * s["hosts"] / s["n"]
    strength = min(max(mean * (1 - mean) / between - 1, 2.0), 1e6) if between > 1e-12 else 1e6
    return mean * strength, (1 - mean) * strength


def host_verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_rate: float = 0.5) -> DataFrame:
    """The statistics, base_failed and kept of each document. Two small shuffles: counts by host, then verdicts to rows,
    where a host with very many rows is dealt over several tasks. Texts are read once and never shuffled."""
    rows = materialized(base_stats(docs, id_col, text_col, host_col), "rules")
    hosts = rows.groupBy("_host").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("fails"))
    alpha, beta = beta_prior(hosts)
    verdicts = materialized(hosts.select("_host", ((F.col("fails") + alpha) / (F.col("n") + alpha + beta) <= max_rate).alias("host_kept")), "verdicts")
    out = with_groups(rows, verdicts, "_host", F.struct("_id", "n_words", "word_chars"))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("host_kept")).withColumnRenamed("_id", id_col).drop("_host", "host_kept")


ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS host FROM documents),
w AS (SELECT *, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(x, chr(10)), lambda y: regexp_matches(y, '[^\x20\x09-\x0D]')) AS ls FROM t),
win AS (SELECT doc_id, i, list_slice(ws, i, i + 7) AS k FROM w, unnest(generate_series(1, len(ws) - 7)) AS s(i) WHERE len(ws) >= 8),
two AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + j) AS c FROM two, unnest(generate_series(0, 7)) AS o(j) GROUP BY doc_id),
s AS (SELECT w.doc_id, host, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
  length(regexp_replace(x, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(c, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id),
b AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM s),
h AS (SELECT host, count(*)::DOUBLE AS n, sum(base_failed::INT)::DOUBLE AS f FROM b GROUP BY host),
m AS (SELECT sum(f) / sum(n) AS raw, least(greatest(sum(f) / sum(n), 1e-6), 1 - 1e-6) AS mu, sum(f * f / n) / sum(n) AS ff, count(*) / sum(n) AS hn FROM h),
v AS (SELECT mu, ff - raw * raw - mu * (1 - mu) * hn AS between_ FROM m),
p AS (SELECT mu, CASE WHEN between_ > 1e-12 THEN least(greatest(mu * (1 - mu) / between_ - 1, 2.0), 1e6) ELSE 1e6 END AS k FROM v),
d AS (SELECT host, (f + mu * k) / (n + k) <= 0.5 AS host_kept FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND host_kept) AS kept FROM b JOIN d USING (host)
"""


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_rate: float = 0.5) -> DataFrame:
    """The rows of docs that the rules and their host's verdict keep, with all their columns, whatever their names. Texts
    are judged once, on their way to a written table of those that pass; for the others it has the host only, so that
    hosts are counted from it. Unless very many hosts are rejected, texts are not shuffled."""

    def judged(batch: pa.RecordBatch) -> pa.RecordBatch:
        stats = [text_stats(x) for x in batch.column(2).field(text_col).to_pylist()]
        failed = pa.array([failed_base(s) for s in stats], pa.bool_())
        return pa.RecordBatch.from_arrays([batch.column(0), failed, batch.column(2)], ["_host", "_failed", "_row"])

    text = F.col(text_col).cast("string").alias(text_col)
    rows = docs.select(key_of(F.col(host_col)).alias("_host"), F.lit(False).alias("_failed"), F.struct(*[text if c == text_col else F.col(c) for c in docs.columns]).alias("_row"))
    rows = map_batches(rows, judged, rows.schema).select("_host", "_failed", F.when(~F.col("_failed"), F.col("_row")).alias("_row"))
    rows = materialized(rows, "rules")
    hosts = rows.groupBy("_host").agg(F.count("*").alias("n"), F.sum(F.col("_failed").cast("long")).alias("fails"))
    alpha, beta = beta_prior(hosts)
    rejected = materialized(hosts.where((F.col("fails") + alpha) / (F.col("n") + alpha + beta) > max_rate).select("_host"), "rejected")
    return rows.where("NOT _failed").join(rejected, "_host", "left_anti").select("_row.*")
