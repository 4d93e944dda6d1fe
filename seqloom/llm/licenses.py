"""License scan by MinHash bands (operator 5).

Texts and license templates are cut into shingles of `width` words. A template of m shingles is looked for in all
overlapping windows of ceil(1.25 m) shingles. Window and template are candidates if they agree in one of `bands` minima;
minima of all windows come from doubling: that of a window is the lesser of two overlapping halves', each as long as the
greatest power of two in it. Candidates are verified: the share of the template's shingles that the window contains must
reach `share`.

A window that contains four fifths of a template has a similarity of 0.8 / (1 + 1.25 - 0.8) = 0.55 or more; 16 bands of
one minimum miss it at a chance of 0.000003, and the windows around it count too.

Templates are a dict, or a table by `templates_from`: whole short licenses, notices of longer ones, and lines that name a
license (`license_texts`). What holds the wording of two templates is reported under both names.

Defined results: a null or empty text has no match; a text shorter than a window is one window; repeated rows give repeated
results; an empty table gives an empty table. Only the named columns are read.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches
from .license_texts import TEMPLATES

WIDTH, BANDS, SHARE = 3, 16, 0.8
TEXTS_AT_ONCE = 400_000
_WORD = re.compile(rb"[a-z0-9\x80-\xff]+")
_M = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and digits, in lower case, and of anything beyond ASCII."""
    return _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


def shingles(words: list[bytes], width: int = WIDTH) -> np.ndarray:
    """A hash for each run of so many words, in order; of fewer words, the whole sequence as one."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    key = np.full(n, min(len(h), width), np.uint64)
    for k in range(min(width, len(h))):
        key = (key ^ h[k : k + n]) * _M
        key ^= key >> np.uint64(29)
    return key


class Index:
    """The templates: their shingles, window and minima."""

    def __init__(self, templates: dict[str, str], width: int = WIDTH, bands: int = BANDS, share: float = SHARE):
        self.width, self.share = width, share
        rng = np.random.default_rng(17)
        self.by = rng.integers(0, 1 << 63, bands, np.uint64) * np.uint64(2) + np.uint64(1)
        self.names = sorted(templates)
        self.sets = [np.unique(shingles(words_of(templates[n]), width)) for n in self.names]
        self.windows = [-(-5 * len(s) // 4) for s in self.sets]
        self.minima = [[self.scrambled(s, a).min() for a in self.by] for s in self.sets]

    @staticmethod
    def scrambled(keys: np.ndarray, a: np.uint64) -> np.ndarray:
        return ((keys * a) >> np.uint64(32)).astype(np.uint32)

    def candidates(self, keys: np.ndarray, gaps: np.ndarray) -> list[np.ndarray]:
        """For each template, the starts of windows that agree with it in some band. Gaps count as above all minima."""
        found: list[list[np.ndarray]] = [[] for _ in self.names]
        for band, a in enumerate(self.by):
            least, w = self.scrambled(keys, a), 1
            least[gaps] = 0xFFFFFFFF
            while True:
                for t, window in enumerate(self.windows):
                    if w <= window < 2 * w and len(least) > window - w:
                        found[t].append(np.flatnonzero(np.minimum(least[: len(least) - (window - w)], least[window - w :]) == self.minima[t][band]))
                if 2 * w > max(self.windows) or len(least) <= w:
                    break
                least, w = np.minimum(least[:-w], least[w:]), 2 * w
        return [np.unique(np.concatenate(f)) if f else np.zeros(0, np.int64) for f in found]

    def matches(self, texts: list[str | None]) -> list[list[tuple[str, int, int, float]]]:
        """name, first word, end and greatest share of each match in each text. Windows that overlap are one match. The texts
        are laid out in one array, with gaps so long that no window that can match has shingles of two."""
        out: list[list[tuple[str, int, int, float]]] = [[] for _ in texts]
        if not self.names or not texts:
            return out
        gap = max(w - int(self.share * len(s)) + 1 for w, s in zip(self.windows, self.sets, strict=True))
        parts = [shingles(words_of(t), self.width) for t in texts]
        # what comes behind the last text is as long as a window, so that each start has one
        starts = np.cumsum([0, *(len(p) + gap for p in parts[:-1]), *(len(p) + max(self.windows) for p in parts[-1:])])
        keys, gaps = np.zeros(starts[-1], np.uint64), np.ones(starts[-1], bool)
        for p, s in zip(parts, starts, strict=False):
            keys[s : s + len(p)] = p
            gaps[s : s + len(p)] = False
        ends = starts[:-1] + np.array([len(p) for p in parts])
        for name, wanted, w, at in zip(self.names, self.sets, self.windows, self.candidates(keys, gaps), strict=True):
            if not len(at):
                continue
            owner = np.searchsorted(starts, at, "right") - 1
            verified: dict[int, list[tuple[int, int, float]]] = defaultdict(list)
            for i, k in zip(at.tolist(), owner.tolist(), strict=True):
                share = len(np.intersect1d(keys[i : min(i + w, ends[k])], wanted)) / len(wanted) if i < ends[k] else 0.0
                if share >= self.share:
                    inside = np.flatnonzero(np.isin(keys[i : min(i + w, ends[k])], wanted))
                    verified[k].append((i - starts[k] + inside[0], i - starts[k] + inside[-1] + self.width, share))
            for k, hits in verified.items():
                hits.sort()
                first, end, best = hits[0]
                for a, b, s in hits[1:]:
                    if a < end:
                        end, best = max(end, b), max(best, s)
                    else:
                        out[k].append((name, int(first), int(end), best))
                        first, end, best = a, b, s
                out[k].append((name, int(first), int(end), best))
        return out


def templates_from(rows: DataFrame, name_col: str = "name", text_col: str = "text", most: int = 10_000) -> dict[str, str]:
    """Templates from a table, `most` rows at most; of equal names the least text. Rows without a word are left out."""
    got = rows.select(F.col(name_col).cast("string").alias("n"), F.col(text_col).cast("string").alias("t")).where("n IS NOT NULL AND t IS NOT NULL").limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} templates")
    out = {r["n"]: r["t"] for r in sorted(got, key=lambda r: (r["n"], r["t"]), reverse=True)}
    return {n: out[n] for n in sorted(out) if words_of(out[n])}


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, share: float = SHARE) -> DataFrame:
    """id_col and matches: license, first word, end and share of each match, in the order of name and place. The templates,
    given as a dict, are few; no shuffle."""
    index = Index(TEMPLATES if templates is None else templates, share=share)
    kind = docs.schema[id_col].dataType.simpleString()
    fields = [("license", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("share", pa.float64())]

    def scanned(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, out, start, size = batch.column(1).to_pylist(), [], 0, 0
        for i, t in enumerate(texts):
            size += len(t or "")
            if size > TEXTS_AT_ONCE or i + 1 == len(texts):
                out += index.matches(texts[start : i + 1])
                start, size = i + 1, 0
        rows = [[dict(zip(("license", "first", "end", "share"), m, strict=True)) for m in ms] for ms in out]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.struct(fields)))], ["_id", "matches"])

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return map_batches(rows, scanned, f"_id {kind}, matches array<struct<license:string,first:bigint,end:bigint,share:double>>").withColumnRenamed("_id", id_col)

_CUT = "CASE WHEN len(ws) >= 3 THEN list_slice(ws, i, i + 2) ELSE ws END AS k"
_WORDS = "regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+') AS ws"
ORACLE_SQL = f"""
WITH tpl(name, txt) AS (VALUES {", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in TEMPLATES.items())}),
tw AS (SELECT name, {_WORDS.format("txt")} FROM tpl), dw AS (SELECT doc_id, {_WORDS.format("text")} FROM documents),
ts AS (SELECT DISTINCT name, {_CUT} FROM tw, unnest(generate_series(1, greatest(len(ws) - 2, 1))) AS t(i)),
tm AS (SELECT name, count(*) AS m, ceil(5 * count(*) / 4)::INT AS w FROM ts GROUP BY name),
ds AS (SELECT doc_id, i, {_CUT} FROM dw, unnest(generate_series(1, greatest(len(ws) - 2, 1))) AS t(i) WHERE len(ws) > 0),
hit AS (SELECT doc_id, name, i, ts.k FROM ds JOIN ts ON ds.k = ts.k),
win AS (SELECT a.doc_id, a.name, a.i, count(DISTINCT b.k) AS c, max(b.i) + 3 AS e, any_value(m) AS m FROM hit AS a JOIN tm ON tm.name = a.name
  JOIN hit AS b ON b.doc_id = a.doc_id AND b.name = a.name AND b.i >= a.i AND b.i < a.i + tm.w GROUP BY a.doc_id, a.name, a.i),
isl AS (SELECT doc_id, name, CASE WHEN i < max(e) OVER (PARTITION BY doc_id, name ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM win WHERE c >= 0.8 * m)
SELECT d.doc_id, coalesce(string_agg(DISTINCT name, ',' ORDER BY name), '') AS licenses, coalesce(sum(fresh), 0)::BIGINT AS n_matches FROM documents AS d LEFT JOIN isl ON isl.doc_id = d.doc_id GROUP BY d.doc_id
"""
