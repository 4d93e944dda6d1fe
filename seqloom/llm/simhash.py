"""SimHash fingerprints (operator 7), with DataFrame operations only.

A text's terms are its runs of `shingle` words (shorter at its end, so that no text with a word is without terms). Each
term's 128 hash bits vote with the term's length in code points as weight, once an occurrence; a fingerprint's bit is
set where the votes for 1 exceed half. Votes are counted two bits a sum: a 64-bit sum holds two lanes of 32 bits, which
hold 2**32 votes, and all of it stays within generated code.

``neighbours`` finds all pairs of fingerprints within a Hamming radius: 128 bits are cut into radius + 1 blocks, of
which one at least is equal in any such pair; a table for each block, led by that block, gives the candidates. Where very
many fingerprints share a block, their other bits are cut into radius + 1 blocks again, one of which must be equal too.

Defined results: a null text is empty; a text without words has the fingerprint of 32 zeros; equal texts have equal
fingerprints; rows with equal ids follow each other, ordered by a hash of their text; null ids come first; the only row of a table is
its own next; an empty table gives an empty table. Only the named columns are read.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, materialized, partitions, with_groups

SHINGLE = 3
BITS = 128
#: Ranges of ids at most; their borders are part of the plan.
MOST_RANGES = 1 << 14


def _terms(text: Column, shingle: int) -> Column:
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    words = F.when(F.size(words) > 0, words).otherwise(F.array(F.lit(None).cast("string")))
    return F.arrays_zip(*[(words if k == 0 else F.slice(words, k + 1, 1 << 30)).alias(f"w{k}") for k in range(shingle)])


def _votes(term: str, shingle: int) -> tuple[list[Column], Column]:
    """The hash's lanes, weighted, and the weight."""
    parts = [F.col(f"{term}.w{k}") for k in range(shingle)]
    first = F.xxhash64(*parts)
    weight = sum((F.coalesce(F.length(p), F.lit(0)) for p in parts), F.lit(0)).cast("long")
    lanes = [F.shiftright(h, i).bitwiseAND(F.lit(0x0000000100000001)) for h in (F.col("_h0"), F.col("_h1")) for i in range(32)]
    return [first, F.xxhash64(F.lit(0x5EED), first), weight], lanes


def _bits(sums: list[Column], total: Column) -> Column:
    """64 bits from 32 sums of two lanes."""
    out = F.lit(0).cast("long")
    for i, s in enumerate(sums):
        low, high = s.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(s, 32)
        out = out.bitwiseOR(F.when(2 * low > total, F.lit(1 << i)).otherwise(F.lit(0)))
        out = out.bitwiseOR(F.when(2 * high > total, F.lit((1 << (i + 32)) - (1 << 64) * (i == 31))).otherwise(F.lit(0)))
    return out


def fingerprints(rows: DataFrame, text_col: str, keep: list[str], shingle: int = SHINGLE) -> DataFrame:
    """keep (a key of the rows) and the fingerprint's halves _f0 and _f1. Rows that are already dealt by a column of
    `keep` aren't shuffled again."""
    (h0, h1, weight), lanes = _votes("_term", shingle)
    terms = rows.select(*keep, F.explode(_terms(F.coalesce(F.col(text_col), F.lit("")), shingle)).alias("_term"))
    hashed = terms.select(*keep, h0.alias("_h0"), h1.alias("_h1"), weight.alias("_weight"))
    sums = hashed.groupBy(*keep).agg(F.sum("_weight").alias("_total"), *[F.sum(v * F.col("_weight")).alias(f"_s{i}") for i, v in enumerate(lanes)])
    halves = [_bits([F.col(f"_s{i}") for i in range(32 * k, 32 * k + 32)], F.col("_total")) for k in (0, 1)]
    return sums.select(*keep, halves[0].alias("_f0"), halves[1].alias("_f1"))


def as_hex(f0: Column, f1: Column) -> Column:
    return F.concat(*[F.lpad(F.lower(F.hex(f)), 16, "0") for f in (f0, f1)])


def likeness(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """1 less the share of differing bits."""
    return 1 - sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(a, b, strict=True)), F.lit(0)) / float(BITS)


def _bucket(column: Column, splits: list) -> Column:
    """How many of the sorted splits are at most column, found in two steps; a null is below all."""
    if not splits:
        return F.lit(0)
    step = math.isqrt(len(splits)) + 1
    chunks = [splits[i : i + step] for i in range(0, len(splits), step)]
    counted = lambda array: F.size(F.filter(array, lambda x: x <= column))
    rough = counted(F.array(*[F.lit(c[0]) for c in chunks]))
    fine = counted(F.get(F.array(*[F.array(*map(F.lit, c)) for c in chunks]), rough - 1))
    return F.when(rough > 0, (rough - 1) * step + fine).otherwise(0).cast("int")


def with_next(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """rows in ranges of ids (_bucket, _row), each with the next row's text (_next). The first row of each range is also
    put, marked _late, behind the range before it, so that texts are shuffled once and no range needs another. Rows with
    equal ids follow each other by a hash of their text; an id that fills several ranges is cut by that hash."""
    n = min(4 * partitions(rows.sparkSession), MOST_RANGES)
    cuts = rows.agg(F.percentile_approx(id_col, [i / n for i in range(1, n)], 10 * n).alias("cuts"), F.min(id_col).alias("low"), F.count_if(F.col(id_col).isNull()).alias("nulls"), F.count("*").alias("n")).first()
    low = None if cuts["nulls"] else cuts["low"]
    splits = sorted(x for x in set(cuts["cuts"] or ()) if x != low)
    firsts = [low, *splits]
    times = Counter(cuts["cuts"] or ())
    # how many ranges each range's first id fills
    parts = [max(1, times[x] if x is not None else round(n * cuts["nulls"] / max(1, cuts["n"]))) for x in firsts]
    at = lambda values, i: F.get(F.array(*map(F.lit, values)), i)
    by_id, tie = _bucket(F.col(id_col), splits), F.xxhash64(text_col)
    if max(parts) == 1:
        bucket, ranges = by_id, len(splits) + 1
        is_first = F.col(id_col).eqNullSafe(at(firsts, bucket)) if low is not None else F.when(bucket == 0, F.col(id_col).isNull()).otherwise(F.col(id_col).eqNullSafe(at(firsts, bucket)))
        before = F.pmod(bucket - 1, F.lit(ranges)).cast("int")
    else:
        offsets = [0, *itertools.accumulate(parts)]
        share = (tie / F.lit(float(1 << 64)) + 0.5) * at(parts, by_id)
        own = F.col(id_col).eqNullSafe(at(firsts, by_id))
        bucket = at(offsets, by_id) + F.when(own, F.least(F.floor(share).cast("int"), at(parts, by_id) - 1)).otherwise(at(parts, by_id) - 1)
        found = rows.groupBy(bucket.alias("b")).agg(F.min(F.struct(F.col(id_col).alias("id"), tie.alias("t"))).alias("first")).orderBy("b").collect()
        there, ranges = {r["b"]: r["first"] for r in found}, offsets[-1]
        earlier, last = [], found[-1]["b"] if found else 0
        for k in range(ranges):
            earlier.append(last)
            last = k if k in there else last
        is_first = (tie == at([there[k]["t"] if k in there else None for k in range(ranges)], bucket)) & F.col(id_col).eqNullSafe(at([there[k]["id"] if k in there else None for k in range(ranges)], bucket))
        before = at(earlier, bucket)
    places = F.when(is_first, F.array(F.struct(bucket.alias("b"), F.lit(False).alias("late")), F.struct(before.alias("b"), F.lit(True).alias("late"))))
    places = places.otherwise(F.array(F.struct(bucket.alias("b"), F.lit(False).alias("late"))))
    dealt = rows.withColumn("_place", F.explode(places)).select("*", F.col("_place.b").alias("_bucket"), F.col("_place.late").alias("_late")).drop("_place")
    order = Window.partitionBy("_bucket").orderBy("_late", id_col, tie, text_col)
    return dealt.select("*", F.row_number().over(order).alias("_row"), F.lead(text_col).over(order).alias("_next"))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Fingerprints of each text and of the text whose last quarter is replaced by the next text's start, and the
    likeness of the first to the second and to the next text's. One shuffle of the texts; votes are summed where they are."""
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    rows = with_next(rows, "_id", "_text")
    n = F.length("_text")
    part = F.floor(n / 4).cast("int")
    edited = F.when(F.col("_late"), F.lit("")).otherwise(F.concat(F.substring(F.col("_text"), F.lit(1), n - part), F.substring(F.coalesce(F.col("_next"), F.lit("")), F.lit(1), part)))
    keys = ["_bucket", "_row", "_late", "_id", "_n", "_sha"]
    rows = rows.select("_bucket", "_row", "_late", "_id", n.cast("long").alias("_n"), "_text", edited.alias("_edited"))
    rows = rows.select("_bucket", "_row", "_late", "_id", "_n", F.sha2("_edited", 256).alias("_sha"), F.explode(F.array(F.struct(F.lit(0).alias("k"), F.col("_text").alias("t")), F.struct(F.lit(1).alias("k"), F.col("_edited").alias("t")))).alias("_v"))
    rows = rows.select(*keys, F.col("_v.k").alias("_k"), F.col("_v.t").alias("_t"))
    prints = fingerprints(rows, "_t", [*keys, "_k"], shingle)
    both = prints.groupBy(*keys).agg(*[F.max(F.when(F.col("_k") == k, F.col(f))).alias(f"{f}{k}") for k in (0, 1) for f in ("_f0", "_f1")])
    order = Window.partitionBy("_bucket").orderBy("_row")
    both = both.select("*", F.lead("_f00").over(order).alias("_g0"), F.lead("_f10").over(order).alias("_g1")).where(~F.col("_late"))
    own, other, following = (F.col("_f00"), F.col("_f10")), (F.col("_f01"), F.col("_f11")), (F.col("_g0"), F.col("_g1"))
    return both.select(F.col("_id").alias(id_col), F.col("_n").alias("n_chars"), F.col("_sha").alias("edited_sha256"), as_hex(*own).alias("fingerprint"), as_hex(*other).alias("edited_fingerprint"), likeness(own, other).alias("near_edited"), likeness(own, following).alias("near_next"))


def block_tables(f: DataFrame, radius: int, most: int, levels: int) -> DataFrame:
    """key and f: any two of f(f) within the radius share a key. A key that more than `most` fingerprints have is replaced by
    keys with one block of the remaining digits more, `levels` times."""
    def cut(rows: DataFrame, left: int) -> DataFrame:
        """key, rest, f to a row for each block of the rest, which has `left` digits."""
        digits = -(-left // (radius + 1))
        blocks = [F.struct(F.concat("key", F.lit(f"/{i}:"), F.substring("rest", 1 + i * digits, digits)).alias("key"), F.concat(F.substring("rest", 1, i * digits), F.substring("rest", 1 + (i + 1) * digits, left)).alias("rest")) for i in range(-(-left // digits))]
        return rows.select("f", F.explode(F.array(*blocks)).alias("t")).select("f", "t.key", "t.rest", F.length("t.rest").alias("left"))

    rows = materialized(cut(f.select("f", F.lit("").alias("key"), F.col("f").alias("rest")), 32), "blocks")
    out = None
    for _ in range(levels):
        hot = materialized(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > most).select("key"), "hot")
        if hot.isEmpty():
            break
        cold = rows.join(hot, "key", "left_anti").select("key", "f")
        out = cold if out is None else out.unionByName(cold)
        split = rows.join(hot, "key", "left_semi")
        lengths = [r[0] for r in split.select("left").distinct().collect()]
        parts = [cut(split.where(F.col("left") == n), n) for n in lengths if n > radius]
        rest = split.where(F.col("left") <= radius).select("f", "key", "rest", "left")
        for part in parts:
            rest = rest.unionByName(part)
        rows = materialized(rest, "blocks")
    last = rows.select("key", "f")
    return last if out is None else out.unionByName(last)


def neighbours(prints: DataFrame, fingerprint_col: str = "fingerprint", radius: int = 3, most: int = 1000, levels: int = 3) -> DataFrame:
    """All pairs a < b of different fingerprints (hex strings of 32) that differ in 1 to radius bits, with `distance`.
    Equal fingerprints count once, so copies add nothing; nulls have no neighbours."""
    f = prints.select(F.col(fingerprint_col).cast("string").alias("f")).where("f IS NOT NULL").distinct()
    tables = block_tables(f, radius, most, levels)
    long = lambda name, at: F.conv(F.substring(name, at, 8), 16, 10).cast("long")
    pairs = tables.withColumnRenamed("f", "a").join(tables.withColumnRenamed("f", "b"), "key").where("a < b")
    apart = sum((F.bit_count(long("a", at).bitwiseXOR(long("b", at))) for at in (1, 9, 17, 25)), F.lit(0))
    return pairs.withColumn("distance", apart).where(F.col("distance") <= radius).select("a", "b", "distance").distinct()


def near_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3, shingle: int = SHINGLE) -> DataFrame:
    """A row for each document: id_col, fingerprint, class_id (the smallest id with this fingerprint, null where none has an
    id), and n_near and nearest, the number of other fingerprints within the radius and the least distance (null: none).
    Copies are one fingerprint, so they meet nothing. A text's terms are summed in the task that reads it."""
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text")).withColumn("_row", F.monotonically_increasing_id())
    prints = fingerprints(rows, "_text", ["_id", "_row"], shingle).select("_id", as_hex(F.col("_f0"), F.col("_f1")).alias("fingerprint"))
    prints = materialized(prints, "prints")
    pairs = materialized(neighbours(prints, "fingerprint", radius), "near")
    ends = pairs.select(F.col("a").alias("fingerprint"), "distance").unionByName(pairs.select(F.col("b").alias("fingerprint"), "distance"))
    near = ends.groupBy("fingerprint").agg(F.count("*").alias("n_near"), F.min("distance").alias("nearest"))
    classes = prints.groupBy("fingerprint").agg(F.min("_id").alias("class_id")).join(near, "fingerprint", "left")
    out = with_groups(prints, materialized(classes, "classes"), "fingerprint", F.col("_id"))
    return out.select(F.col("_id").alias(id_col), "fingerprint", "class_id", F.coalesce("n_near", F.lit(0)).alias("n_near"), "nearest")
