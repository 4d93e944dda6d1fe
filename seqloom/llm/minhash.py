"""MinHash near-duplicates by an LSH forest (operator 8).

1. Each text's set of word shingles gets a digest and a signature of trees * depth minima. Texts with equal sets form a
   class with its smallest id as representative; only representatives go on.
2. Forest: each tree is an order of all representatives by their values in it. The orders are sorted in ranges, so a
   dense region is dealt over many tasks. A text's candidates are the neighbours with the longest common prefix. The
   depth that is asked for is that of the region: at first `least` values, and one more than the text shares with its
   `far`-th neighbour, so that a region of up to `far` texts is compared as a whole and a denser one at a greater
   depth; the next `reach` neighbours count from `least` on. A rough likeness from all values is asked for too.
3. Candidates form clusters. Within a cluster, links are decided on full sets between all members, not only candidates.
   A cluster of up to `block` members is one piece of work. A larger one is split in several random blockings. Where
   links so found leave it in parts, a join finds the links between the parts (`between_parts`): sets are taken as their
   differences from what most of the cluster has, and only sets that share one of their rarest differences meet. What a
   region has in common (a form, a passage) doesn't make its texts meet.

For a pair at the threshold t, each tree misses it at a chance of about 1 - t**least; with 12 trees, 3 values and
t = 0.85 all trees do at one in 100,000.

Defined results: a null or empty text has an empty set and is its own component; a null id takes no part in links and
is kept; rows with equal ids are one document,
linked with what any of their texts is linked with; an empty table gives an empty table. Only the named columns
are read.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, materialized, partitions, salts_of, with_groups
from .components import components

TREES, DEPTH, LEAST, REACH, FAR, BLOCK, BLOCKINGS = 12, 6, 3, 3, 8, 64, 3
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def shingles(text: str | None, width: int) -> np.ndarray:
    """The distinct shingles of the text, as sorted 64-bit hashes; of fewer words, the whole sequence as one."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    key = np.full(n, len(h) if len(h) < width else width, np.uint64)
    for k in range(min(width, len(h))):
        key = (key ^ h[k : k + n]) * _M1
        key ^= key >> np.uint64(29)
    return np.unique(key * _M2)


def multipliers(count: int) -> np.ndarray:
    return np.random.default_rng(20).integers(0, 1 << 63, count, np.uint64) * np.uint64(2) + np.uint64(1)


def signature(keys: np.ndarray, by: np.ndarray) -> np.ndarray:
    """The high half of the least product of each multiplier with the keys."""
    least = np.full(len(by), ~np.uint64(0))
    for start in range(0, len(keys), 2048):
        least = np.minimum(least, (keys[None, start : start + 2048] * by[:, None]).min(axis=1))
    return (least >> np.uint64(32)).astype(np.uint32)


def sketches(docs: DataFrame, id_col: str, text_col: str, width: int, trees: int, depth: int) -> DataFrame:
    """_id, n, digest of the set, values (big-endian, tree by tree) and their last four bits each."""
    by = multipliers(trees * depth)

    def sketch(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, digests, values, bits = [], [], [], []
        for text in batch.column(1).to_pylist():
            keys = shingles(text, width)
            n.append(len(keys))
            if not len(keys):
                digests.append(None), values.append(None), bits.append(None)
                continue
            v = signature(keys, by)
            digests.append(xxhash.xxh3_128_digest(keys.tobytes()))
            values.append(v.astype(">u4").tobytes())
            low = (v & 15).astype(np.uint8)
            bits.append((low[0::2] << 4 | low[1::2]).tobytes())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *(pa.array(x, pa.binary()) for x in (digests, values, bits))], ["_id", "n", "digest", "vals", "bits"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return map_batches(rows, sketch, f"_id {kind}, n long, digest binary, vals binary, bits binary")


def _fixed(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def prefixes(tree: np.ndarray, key: np.ndarray, apart: int) -> np.ndarray:
    """How many of their first values row i and row i + apart share; 0 in different trees."""
    words = key.view(np.uint32)
    same = (words[:-apart] == words[apart:]) & (tree[:-apart] == tree[apart:])[:, None]
    return np.logical_and.accumulate(same, axis=1).sum(axis=1)


def near(tree: np.ndarray, key: np.ndarray, bits: np.ndarray, apart: int, depth: np.ndarray | int, likeness: float) -> np.ndarray:
    """Rows i that are candidates with row i + apart: by a common prefix of the depth that the latter asks for."""
    at = np.flatnonzero(prefixes(tree, key, apart) >= (depth[apart:] if isinstance(depth, np.ndarray) else depth))
    x = bits[at] ^ bits[at + apart]
    equal = ((x & 0xF0) == 0).sum(axis=1) + ((x & 0x0F) == 0).sum(axis=1)
    return at[(equal / (2 * bits.shape[1]) - 1 / 16) / (15 / 16) >= likeness]


def depths(tree: np.ndarray, key: np.ndarray, least: int, far: int) -> np.ndarray:
    """The depth of each row's region: one more than the row shares with the one `far` before it, within least and all."""
    out = np.full(len(tree), least)
    if len(tree) > far:
        out[far:] = np.clip(prefixes(tree, key, far) + 1, least, key.shape[1] // 4)
    return out


def forest_candidates(reps: DataFrame, trees: int, depth: int, least: int, reach: int, far: int, likeness: float) -> DataFrame:
    """a, b: neighbours in some tree's order, without those that a range's other pairs connect already, so that a region of n
    texts gives fewer than n pairs a tree. Each range's first and last `reach` rows go to the driver, which compares
    them across ranges: their number is that of the ranges, whatever the input."""
    spark, kind = reps.sparkSession, reps.schema["_id"].dataType.simpleString()
    orders = reps.select("_id", "bits", F.posexplode(F.array(*[F.substring("vals", 4 * depth * t + 1, 4 * depth) for t in range(trees)])).alias("tree", "key"))
    order = ["tree", "key", "_id"]
    orders = orders.select("tree", "key", "_id", "bits").repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    half = trees * depth // 2

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        schema = pa.schema([("part", pa.int32()), ("at", pa.int64()), ("tree", pa.int32()), ("key", pa.binary()), ("bits", pa.binary()), ("a", ids_type), ("b", ids_type)])
        carry: pa.RecordBatch | None = None
        at, new, parts = 0, 0, Parts()

        def border(rows: pa.RecordBatch, first: int) -> pa.RecordBatch:
            n = rows.num_rows
            return pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array(range(first, first + n), pa.int64()), rows.column(0).cast(pa.int32()), rows.column(1), rows.column(3), rows.column(2), pa.nulls(n, ids_type)], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            if at < reach:
                yield border(batch.slice(0, reach - at), at)
            both = pa.Table.from_batches([carry, batch]).combine_chunks().to_batches()[0] if carry is not None and carry.num_rows else batch
            new = both.num_rows - batch.num_rows
            tree, key, bits = both.column(0).to_numpy(), _fixed(both.column(1), 4 * depth), _fixed(both.column(3), half)
            region = depths(tree, key, least, far)
            for apart in range(1, max(reach, far) + 1):
                if both.num_rows > apart:
                    i = near(tree, key, bits, apart, least if apart <= reach else region, likeness)
                    i = i[i + apart >= new]
                    ids = both.column(2)
                    i = i[[parts.join(a, b) for a, b in zip(ids.take(pa.array(i)).to_pylist(), ids.take(pa.array(i + apart)).to_pylist(), strict=True)]] if len(i) else i
                    n = len(i)
                    if n:
                        yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), both.column(2).take(pa.array(i)), both.column(2).take(pa.array(i + apart))], schema=schema)
            at += batch.num_rows
            carry = both.slice(max(0, both.num_rows - max(reach, far)))
        if carry is not None:
            # rows among the first `reach` are there already
            last = min(carry.num_rows, reach, max(0, at - reach))
            if last:
                yield border(carry.slice(carry.num_rows - last), at - last)

    from pyspark.sql.pandas.types import to_arrow_type

    ids_type = to_arrow_type(reps.schema["_id"].dataType)
    found = materialized(orders.mapInArrow(compare, f"part int, at long, tree int, key binary, bits binary, a {kind}, b {kind}"), "forest")
    edge = sorted(found.where("part IS NOT NULL").collect(), key=lambda r: (r["part"], r["at"]))
    across = []
    if edge:
        tree = np.array([r["tree"] for r in edge])
        key, bits = (np.frombuffer(b"".join(bytes(r[c]) for r in edge), np.uint8).reshape(len(edge), -1) for c in ("key", "bits"))
        for apart in range(1, min(reach, len(edge) - 1) + 1):
            across += [(edge[i]["a"], edge[i + apart]["a"]) for i in near(tree, key, bits, apart, least, likeness) if edge[i]["part"] != edge[i + apart]["part"]]
    pairs = found.where("part IS NULL").select("a", "b")
    if across:
        pairs = pairs.unionByName(spark.createDataFrame(across, f"a {kind}, b {kind}"))
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


class Parts:
    """Union-find over any ids; holds those that were joined."""

    def __init__(self):
        self.up: dict = {}

    def root(self, x):
        while (y := self.up.setdefault(x, x)) != x:
            self.up[x] = self.up[y]
            x = self.up[x]
        return x

    def join(self, a, b) -> bool:
        """Whether they were apart so far."""
        a, b = self.root(a), self.root(b)
        self.up[a] = b
        return a != b


class Groups:
    """Union-find over 0..n-1; the root is the smallest."""

    def __init__(self, n: int):
        self.up, self.count = list(range(n)), n

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = sorted((self.root(i), self.root(j)))
        if a != b:
            self.up[b] = a
            self.count -= 1


def link_sets(sets: list[np.ndarray], percent: int, *known: list) -> list[int]:
    """For each set, the smallest position that links reach from it: links are 100 * intersection >= percent * union,
    found between all sets. known: lists in which positions that are linked already hold the same value."""
    m = len(sets)
    groups = Groups(m)
    for labels in known:
        seen: dict = {}
        for i, k in enumerate(labels):
            if k is not None:
                groups.join(i, seen.setdefault(k, i))
    size = np.array([len(s) for s in sets])
    if m <= 16:
        for i in range(m):
            for j in range(i + 1, m):
                if size[i] and size[j] and groups.root(i) != groups.root(j) and 100 * min(size[i], size[j]) >= percent * max(size[i], size[j]):
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * both >= percent * (size[i] + size[j] - both):
                        groups.join(i, j)
        return [groups.root(i) for i in range(m)]
    term, doc = np.unique(np.concatenate(sets), return_inverse=True)[1], np.repeat(np.arange(m), size)
    uses = np.bincount(term)
    shared = uses[term] > 1
    term, doc = np.unique(term[shared], return_inverse=True)[1], doc[shared]
    order = np.argsort(term, kind="stable")
    by_term, starts = doc[order], np.concatenate(([0], np.cumsum(np.bincount(term)))) if len(term) else np.zeros(1, np.int64)
    ends = np.searchsorted(doc, np.arange(m + 1))
    for i in range(m):
        if groups.count == 1:
            break
        mine = term[ends[i] : ends[i + 1]]
        if not len(mine):
            continue
        both = np.bincount(np.concatenate([by_term[starts[t] : starts[t + 1]] for t in mine]), minlength=m)
        for j in np.flatnonzero((both > 0) & (100 * both >= percent * (size[i] + size - both))):
            groups.join(i, int(j))
    return [groups.root(i) for i in range(m)]


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[tuple]]]:
    """The runs of rows with equal first column; one run is held at a time."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[0] != key:
                if rows:
                    yield key, rows
                key, rows = row[0], []
            rows.append(row[1:])
    if rows:
        yield key, rows


def resolve(members: DataFrame, width: int, percent: int) -> DataFrame:
    """Of members(key, _id, known, _text): _id and root, the smallest id linked with it within its key. A key has few
    enough rows for one task; see `linked`."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind, ids_type = members.schema["_id"].dataType.simpleString(), to_arrow_type(members.schema["_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, roots = [], []
        for _, rows in _by_key(b.slice(s, 500) for b in batches for s in range(0, b.num_rows, 500)):
            rows.sort(key=lambda r: r[0])
            found = link_sets([shingles(r[2], width) for r in rows], percent, [r[0] for r in rows], [r[1] for r in rows])
            ids += [r[0] for r in rows]
            roots += [rows[k][0] for k in found]
            if len(ids) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(ids, ids_type), pa.array(roots, ids_type)], ["_id", "root"])
                ids, roots = [], []
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids, ids_type), pa.array(roots, ids_type)], ["_id", "root"])

    dealt = members.select("key", "_id", "known", "_text").repartition(partitions(members.sparkSession), "key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, f"_id {kind}, root {kind}").distinct()


def linked(clusters: DataFrame, texts: DataFrame, width: int, percent: int, block: int = BLOCK) -> DataFrame:
    """node and component, by links on full sets, of clusters(node, component) and texts(_id, _text)."""
    sizes = clusters.groupBy("component").agg(F.count("*").alias("size"))
    placed = clusters.join(sizes, "component").withColumnRenamed("node", "_id")
    # the cluster's blocks: one if it is small
    parts = F.ceil(F.col("size") / block).cast("int")
    ways = F.when(F.col("size") <= block, F.array(F.lit(0))).otherwise(F.array(*[F.pmod(F.xxhash64(F.lit(k), F.col("_id")), parts).cast("int") + 1 + k * (1 << 20) for k in range(BLOCKINGS)]))
    name = F.concat_ws("/", F.col("component").cast("string"), F.col("place").cast("string"))
    kind = clusters.schema["node"].dataType.simpleString()
    # dealt by id at every size: the members may be many
    held = materialized(placed.hint("merge").join(texts, "_id"), "members")
    first = materialized(resolve(held.select("_id", "component", F.explode(ways).alias("place"), "_text").select(name.alias("key"), "_id", F.lit(None).cast(kind).alias("known"), "_text"), width, percent), "resolved")
    large = held.where(F.col("size") > block)
    if large.select("_id").isEmpty():
        return first.select(F.col("_id").alias("node"), F.col("root").alias("component"))
    found = components(first.select(F.col("_id").alias("a"), F.col("root").alias("b")))
    # what the blockings leave apart
    known = large.select("_id", F.col("component").alias("cluster"), "_text").join(found.withColumnRenamed("node", "_id"), "_id", "left").select("_id", "cluster", F.coalesce("component", "_id").alias("known"), "_text")
    apart = known.groupBy("cluster", "known").agg(F.lit(1).alias("one")).groupBy("cluster").agg(F.count("*").alias("n")).where("n > 1").select("cluster")
    apart = materialized(apart, "apart")
    if apart.isEmpty():
        return _joined(first, found)
    links = between_parts(known.join(apart, "cluster"), width, percent)
    return _joined(first, components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links)))


def between_parts(members: DataFrame, width: int, percent: int) -> DataFrame:
    """Of members(_id, cluster, known, _text): a and b, parts (`known`) of one cluster that some link connects, or such
    that the parts so connected are those that all links connect.

    A cluster's base is the shingles that more than half of its sets have. Of a set of n shingles, what differs from the
    base are d shingles, and two sets differ as their differences do. With h = 100 + percent they are linked if they differ
    in (100 - percent) / h of n_x + n_y or less, so with g = h * d - (100 - percent) * n:
    - if g_x + g_y <= 0 they are linked, whatever they share. Then both are linked with the cluster's set of least g, its
      centre, so links with the centre stand for all of these;
    - else their differences share o = ceil((g_x + g_y) / 2h) shingles or more. In an order of all, the first one that they
      share has o or more from there on in both. The order is from rare to common, and shingles that differ in one set
      only meet nothing. Sets that meet so are confirmed on the whole differences."""
    kind, h, less = members.schema["_id"].dataType.simpleString(), 100 + percent, 100 - percent

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(t, width).view(np.int64) for t in batch.column(3).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([xxhash.xxh3_64_intdigest(x.tobytes()) >> 1 for x in sets], pa.int64()), pa.array([len(x) for x in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["_id", "cluster", "known", "text", "n", "set"])

    # rows of one id may have different texts: each has a set of its own
    sets = map_batches(members.select("_id", "cluster", "known", "_text"), cut, f"_id {kind}, cluster {kind}, known {kind}, text long, n long, set array<bigint>")
    sets = materialized(sets.where("n > 0").dropDuplicates(["_id", "text"]), "sets")
    counted = sets.select("cluster", F.explode("set").alias("term")).groupBy("cluster", "term").agg(F.count("*").alias("uses")).where("uses > 1")
    sizes = materialized(sets.groupBy("cluster").agg(F.count("*").alias("size")), "sizes")
    # at most twice as many as a set of the cluster has on average
    half = with_groups(counted, sizes, "cluster", F.col("term")).where("2 * uses > size").groupBy("cluster").agg(F.collect_list("term").alias("base"))
    bases = materialized(sizes.join(half, "cluster", "left").select("cluster", F.coalesce("base", F.array().cast("array<bigint>")).alias("base")), "bases")
    row = ["_id", "text", "cluster", "known", "n", "d", "g", "low"]
    differing = with_groups(sets, bases, "cluster", F.col("_id")).withColumn("diff", F.concat(F.array_except("set", "base"), F.array_except("base", "set")))
    d, least_n = F.size("diff").cast("long"), F.col("n") * percent / 100
    # the least g that a set linked with this one can have, by its size
    low = F.when(least_n >= F.size("base"), 2 * percent * least_n - h * F.size("base")).otherwise(-less * F.size("base"))
    differing = materialized(differing.select("_id", "text", "cluster", "known", "n", "diff", d.alias("d"), (h * d - less * F.col("n")).alias("g"), F.floor(low).alias("low")), "differing")
    centres = materialized(differing.groupBy("cluster").agg(F.min("g").alias("g_least"), F.min_by("known", F.struct("g", "_id", "text")).alias("centre")), "centres")
    near = with_groups(differing, centres, "cluster", F.col("_id")).withColumn("close", F.col("g") + F.col("g_least") <= 0)
    stars = near.where("close").select(F.col("known").alias("a"), F.col("centre").alias("b")).distinct()
    near = near.withColumn("known", F.when(F.col("close"), F.col("centre")).otherwise(F.col("known"))).withColumn("low", F.greatest("low", "g_least"))
    terms = near.select(*row, F.explode("diff").alias("term"))
    uses = terms.groupBy("cluster", "term").agg(F.count("*").alias("uses")).where("uses > 1")
    common = terms.join(uses, ["cluster", "term"]).groupBy(*row).agg(F.array_sort(F.collect_list(F.struct("uses", "term"))).alias("u"))
    common = materialized(common.select(*row, F.transform("u", lambda x: x["term"]).alias("common")), "common")
    # how many of the order's first shingles a set shows as the one of greater g, and as the one of lesser g
    shown = lambda g: F.col("d") - F.greatest(F.lit(1), F.ceil(g / (2 * h))) + 1
    firsts = common.withColumns({"alone": F.col("d") - F.size("common"), "greater": shown(F.col("g") + F.col("low")), "lesser": shown(2 * F.col("g"))}).withColumn("most", (F.greatest("greater", "lesser") - F.col("alone")).cast("int"))
    firsts = firsts.where("most > 0").select(*row, "greater", "lesser", "alone", F.posexplode(F.slice("common", F.lit(1), F.col("most"))).alias("at", "term")).withColumn("at", F.col("alone") + F.col("at"))
    names = ("_id", "text", "known", "n", "d", "g")
    side = lambda rows, s: rows.select("cluster", "term", (F.col("d") - F.col("at")).alias(f"behind_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in names])
    met = side(firsts.where("at < greater"), "x").join(side(firsts.where("at < lesser"), "y"), ["cluster", "term"])
    total = F.col("g_x") + F.col("g_y")
    met = met.where((F.col("known_x") != F.col("known_y")) & ((F.col("g_y") < F.col("g_x")) | ((F.col("g_y") == F.col("g_x")) & (F.col("_id_y") < F.col("_id_x")))))
    met = met.where((100 * F.least("n_x", "n_y") >= percent * F.greatest("n_x", "n_y")) & (total > 0) & (F.least("behind_x", "behind_y") >= F.ceil(total / (2 * h))))
    met = materialized(met.select(*[f"{c}_{s}" for s in "xy" for c in names]).distinct(), "met")
    full = lambda s: common.select(F.col("_id").alias(f"_id_{s}"), F.col("text").alias(f"text_{s}"), F.col("common").alias(f"common_{s}"))
    apart = F.col("d_x") + F.col("d_y") - 2 * F.size(F.array_intersect("common_x", "common_y"))
    linked = met.join(full("x"), ["_id_x", "text_x"]).join(full("y"), ["_id_y", "text_y"]).where(h * apart <= less * (F.col("n_x") + F.col("n_y")))
    return linked.select(F.col("known_x").alias("a"), F.col("known_y").alias("b")).distinct().unionByName(stars)


def _joined(first: DataFrame, found: DataFrame) -> DataFrame:
    nodes = first.select(F.col("_id").alias("node")).distinct()
    return nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, trees: int = TREES, depth: int = DEPTH, least: int = LEAST, reach: int = REACH, far: int = FAR, block: int = BLOCK) -> DataFrame:
    """id_col, n_shingles, component_id and kept of each row."""
    rows = materialized(sketches(docs, id_col, text_col, width, trees, depth), "sketches")
    reps = rows.where("n > 0 AND _id IS NOT NULL").groupBy("digest").agg(F.min("_id").alias("_id"), F.count("*").alias("copies"), F.first("vals").alias("vals"), F.first("bits").alias("bits"))
    reps = materialized(reps, "representatives")
    pairs = forest_candidates(reps, trees, depth, least, reach, far, percent / 100 - 0.15)
    clusters = components(pairs)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    found = linked(clusters, texts, width, percent, block)
    groups = reps.select("digest", "_id", "copies").join(found.withColumnRenamed("node", "_id"), "_id", "left").where("copies > 1 OR component < _id").select("digest", F.coalesce("component", "_id").alias("component"))
    salt = F.pmod(F.xxhash64("_id"), F.lit(salts_of(docs.sparkSession))).cast("int")
    at = rows.where("digest IS NOT NULL").select("digest", salt.alias("_salt")).distinct()
    spread = groups.join(at.groupBy("digest").agg(F.collect_list("_salt").alias("s")), "digest").select("digest", "component", F.explode("s").alias("_salt"))
    out = rows.select("_id", "n", "digest", salt.alias("_salt")).join(spread, ["digest", "_salt"], "left")
    component = F.when(F.col("_id").isNotNull(), F.coalesce("component", "_id"))
    return out.select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("_id").eqNullSafe(component).alias("kept"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) >= 3 THEN list_slice(ws, i, i + 2) ELSE ws END AS k FROM w, unnest(generate_series(1, greatest(len(ws) - 2, 1))) AS t(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s AS a JOIN s AS b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT a, b FROM c JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r(x, y) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a),
g AS (SELECT x AS doc_id, min(y) AS root FROM r GROUP BY x)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(root, w.doc_id) AS component_id, (w.doc_id = coalesce(root, w.doc_id)) AS kept
FROM w LEFT JOIN n ON w.doc_id = n.doc_id LEFT JOIN g ON w.doc_id = g.doc_id
"""


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each group of near-duplicates, that with the smallest id; rows without an id stay. Rows with equal ids
    are one document if their texts are equal but for the case of A-Z, and stay or go together if not. Of equal ones the
    row with the least digest of all its columns stays. Texts are dealt by id only where Spark doesn't know the ids that
    go to be few."""
    found = materialized(near_duplicates(docs, id_col, text_col, **options).select(F.col(id_col).alias("_id"), "kept").where("_id IS NOT NULL"), "found")
    removed = materialized(found.where("NOT kept").select("_id").distinct(), "removed")
    repeated = materialized(found.groupBy("_id").agg(F.count("*").alias("_n")).where("_n > 1").select("_id"), "repeated")
    rows = docs.select(F.col(id_col).alias("_id"), F.struct(*[F.col(c) for c in docs.columns]).alias("_row"))
    kept = rows.join(removed, "_id", "left_anti")
    if not repeated.isEmpty():
        again = kept.join(repeated, "_id", "left_semi")
        text = F.sha2(F.translate(F.coalesce(F.col("_row")[text_col].cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase), 256)
        once = again.groupBy("_id", text.alias("_text")).agg(F.min_by("_row", F.sha2(F.to_json("_row"), 256)).alias("_row"))
        kept = kept.join(repeated, "_id", "left_anti").unionByName(once.select("_id", "_row"))
    return kept.select("_row.*")
