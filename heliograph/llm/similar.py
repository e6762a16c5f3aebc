"""Components of similar texts: candidate blocks, then signature trees with exact verification.

1. Every text becomes a set of hashed word shingles; equal sets are one class.
2. Keys bring similar sets together. ``partition_keys`` is exact: by the size of a set, its
   shingles are dealt into more parts than a similar set can differ in, so two similar sets
   agree on a part. ``minhash_keys`` bands MinHashes for high recall. Tasks combine their own
   rows first, so a key that very many texts share has one row a task.
3. Texts that share keys form stars, and the stars' components are blocks: a link can only
   lie within a block, and a text is in one block. In a block of more than NODE_TEXTS texts each is
   first compared with the smallest that it shares a key with. The block is then dealt into nodes
   by size range, those that such a centre connects apart; pairs of nodes with compatible sizes
   that aren't connected already are the units of work.
4. In a unit, texts form signature trees whose nodes hold OR-combined bitmaps and size ranges.
   A dual traversal drops pairs of nodes whose largest possible overlap is too small or which
   are connected already, and verifies the pairs of texts that remain on whole sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heliograph.llm.components import connected_components
from heliograph.llm.packing import slices
from heliograph.llm.storage import drop_all, materialize

U = np.uint64
#: Texts in a node of the distributed upper level, and in a leaf of a tree.
NODE_TEXTS = 512
LEAF = 16
FAN = 8
#: Keys that a task holds before it combines them.
HELD_KEYS = 4_000_000
#: Parts beyond the smallest number, so that parts without any shingle do no harm.
SLACK = 2


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words (A-Z lowered, separated by ASCII white space) and each text's bounds."""
    import xxhash

    column = pc.fill_null(column.cast(pa.large_string()), "")
    column = column.take(pa.array(np.arange(len(column))))  # ascii_lower misreads slices of larger arrays
    split = pc.ascii_split_whitespace(pc.ascii_lower(column))
    bounds = np.asarray(split.offsets.to_numpy(), dtype=np.int64)
    bounds = bounds - bounds[0] if len(bounds) else np.zeros(1, dtype=np.int64)
    coded = split.flatten().dictionary_encode()
    index = coded.indices.to_numpy(zero_copy_only=False)
    own = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), dtype=U, count=len(coded.dictionary))
    real = np.fromiter((w != "" for w in coded.dictionary.to_pylist()), dtype=bool, count=len(coded.dictionary))
    if not len(index):
        return np.zeros(0, dtype=U), np.zeros(len(column) + 1, dtype=np.int64)
    kept = real[index]
    return own[index][kept], np.concatenate([[0], np.cumsum(kept)])[bounds]


def shingle_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after another, and each text's bounds.

    A text of fewer words has one shingle of them all; one without words has none.
    """
    return shingles_of(*word_hashes(column), size)


def shingles_of(words: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """``shingle_sets`` of texts given by the hashes of their words."""
    counts = np.diff(bounds)
    text = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(words)) - bounds[:-1][text]
    length = np.minimum(counts, size)[text]
    starts = np.flatnonzero(place + length <= counts[text])
    value = np.full(len(starts), 0x9E3779B97F4A7C15, dtype=U)
    for k in range(size):
        at = np.minimum(starts + k, max(len(words) - 1, 0))
        value = np.where(k < length[starts], mix(value + words[at]), value)
    order = np.lexsort((value, text[starts]))
    value, text = value[order], text[starts][order]
    first = np.ones(len(value), dtype=bool)
    first[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    value, text = value[first], text[first]
    return value, np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(counts)))])


def digests(values: np.ndarray, bounds: np.ndarray) -> tuple[list[int], list[int]]:
    import hashlib

    raw = [hashlib.blake2b(values[a:b].tobytes(), digest_size=16).digest() for a, b in zip(bounds[:-1], bounds[1:])]
    return [int.from_bytes(r[:8], "little", signed=True) for r in raw], [int.from_bytes(r[8:], "little", signed=True) for r in raw]


def size_bands(largest: int, num: int, den: int) -> np.ndarray:
    """Lower ends of size ranges such that similar sets lie in the same or in neighbouring ones."""
    ends = [1]
    while ends[-1] <= largest:
        ends.append(ends[-1] * den // num + 1)
    return np.array(ends, dtype=np.int64)


def partition_keys(values: np.ndarray, bounds: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, texts): two sets of Jaccard num/den or more have a key in common."""
    sizes = np.diff(bounds)
    if not len(values):
        return np.zeros(0, dtype=U), np.zeros(0, dtype=np.int64)
    ends = size_bands(int(sizes.max()) + 1, num, den)
    band = np.searchsorted(ends, sizes, side="right") - 1
    text = np.repeat(np.arange(len(sizes)), sizes)
    keys, owners = [], []
    for level in (band, band - 1):  # with its own range and, as the larger one, with the range below
        used = np.maximum(level, 0)
        differ = (ends[used + 1] - 1) * (den - num) // num  # most shingles that two sets met here can differ in
        parts = np.where(differ == 0, 1, differ + 1 + SLACK)
        live = (level >= 0) & (sizes > 0)
        take = live[text]
        v, t = values[take], text[take]
        if not len(v):
            continue
        part = ((v >> U(32)) * parts[t].astype(U)) >> U(32)
        new = np.ones(len(v), dtype=bool)
        new[1:] = (t[1:] != t[:-1]) | (part[1:] != part[:-1])
        at = np.flatnonzero(new)
        total = np.add.reduceat(mix(v), at)
        held = np.diff(np.append(at, len(v))).astype(U)
        tag = lambda t, part: mix(used[t].astype(U) * U(0x9E3779B1) + part * U(0x85EBCA77C2B2AE63))  # noqa: E731, B023
        keys.append(mix(total + tag(t[at], part[at]) + held))
        owners.append(t[at])
        filled = np.bincount(t[at], minlength=len(sizes))
        for i in np.flatnonzero(live & (parts - filled > SLACK)):  # agreeing on empty parts alone must count
            empty = np.setdiff1d(np.arange(parts[i]), part[at][t[at] == i].astype(np.int64)).astype(U)
            keys.append(mix(tag(np.full(len(empty), i), empty)))
            owners.append(np.full(len(empty), i))
    return np.concatenate(keys), np.concatenate(owners)


def minhash_keys(values: np.ndarray, bounds: np.ndarray, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, texts): a key for every band of ``rows`` MinHashes."""
    sizes = np.diff(bounds)
    full = np.flatnonzero(sizes > 0)
    if not len(full):
        return np.zeros(0, dtype=U), np.zeros(0, dtype=np.int64)
    starts = bounds[:-1][full]
    keys = []
    for band in range(bands):
        key = np.full(len(full), band + 1, dtype=U)
        for row in range(rows):
            seed = mix(np.array([band * rows + row + 1], dtype=U))[0]
            key = mix(key + np.minimum.reduceat(mix(values ^ seed), starts))
        keys.append(key)
    return np.concatenate(keys), np.tile(full, bands)


def _stars(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, the smallest id of each; other ids and the smallest id they share a key with)."""
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    first = np.ones(len(keys), dtype=bool)
    first[1:] = keys[1:] != keys[:-1]
    centre = ids[np.maximum.accumulate(np.where(first, np.arange(len(keys)), 0))] if len(keys) else ids
    apart = ~first & (ids != centre)
    pairs = np.unique(np.stack([ids[apart], centre[apart]]), axis=1) if apart.any() else np.zeros((2, 0), dtype=np.int64)
    return keys[first], ids[first], pairs[0], pairs[1]


def _summarise(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in (s for b in batches for s in slices(b)):
        values, bounds = shingle_sets(batch.column("text"), size)
        low, high = digests(values, bounds)
        columns = [batch.column("id"), pa.array(np.diff(bounds), pa.int64()), pa.array(low, pa.int64()), pa.array(high, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "d0", "d1"])


def held_keys(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[pa.Array, pa.Array, pa.Array]:
    """key, id and other of the (keys, ids) in ``held``, which is emptied."""
    keys, ids, others, centres = _stars(np.concatenate([k for k, _ in held]), np.concatenate([i for _, i in held]))
    held.clear()
    key = np.concatenate([keys, mix(others.astype(U))]).view(np.int64)
    other = pa.array(np.concatenate([np.zeros(len(ids), dtype=np.int64), centres]), mask=np.arange(len(key)) < len(ids))
    return pa.array(key), pa.array(np.concatenate([ids, others])), other


def _keyed(batches: Iterable[pa.RecordBatch], size: int, keys_of: Callable) -> Iterator[pa.RecordBatch]:
    """(key, id, other): a row for each key of the task, and stars of texts that met within it."""
    held, seen = [], set()
    flush = lambda: pa.RecordBatch.from_arrays([*held_keys(held)], names=["key", "id", "other"])
    for batch in (s for b in batches for s in slices(b)):
        values, bounds = shingle_sets(batch.column("text"), size)
        ids = batch.column("id").to_numpy(zero_copy_only=False).astype(np.int64)
        low, _ = digests(values, bounds)
        fresh = np.fromiter((d not in seen and not seen.add(d) for d in low), dtype=bool, count=len(low))  # equal sets have equal keys
        keys, owners = keys_of(values, bounds)
        take = fresh[owners]
        held.append((keys[take], ids[owners[take]]))
        if sum(len(k) for k, _ in held) > HELD_KEYS:
            yield flush()
            seen.clear()
    if held:
        yield flush()


def _meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) from the rows of whole keys: stars around the smallest id."""
    held = []
    for batch in batches:
        if batch.num_rows:
            other = batch.column("other")
            kept = np.asarray(pc.is_valid(other))
            ids = batch.column("id").to_numpy()
            if kept.any():
                yield pa.RecordBatch.from_arrays([pa.array(ids[kept]), pc.drop_null(other)], names=["a", "b"])
            held.append((batch.column("key").to_numpy()[~kept], ids[~kept]))
    if held:
        _, _, a, b = _stars(np.concatenate([k for k, _ in held]), np.concatenate([i for _, i in held]))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


class SignatureTree:
    """Texts in order of size under nodes with OR-combined bitmaps and size ranges."""

    def __init__(self, sets: list[np.ndarray], bits: int):
        self.order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), sets[i][:1].tolist()))
        self.sets = [sets[i] for i in self.order]
        self.sizes = np.array([len(s) for s in self.sets], dtype=np.int64)
        maps = np.zeros((len(sets), bits // 8), dtype=np.uint8)
        for row, s in enumerate(self.sets):
            at = (s & U(bits - 1)).astype(np.int64)
            np.bitwise_or.at(maps[row], at >> 3, (1 << (at & 7)).astype(np.uint8))
        self.maps = maps.view(U)
        self.excess = self.sizes - np.bitwise_count(self.maps).sum(axis=1, dtype=np.int64)  # shingles that share a bit with another
        # Levels from the leaves up: (bitmap, least size, greatest size, greatest excess, first text, end).
        step, self.levels = LEAF, []
        while True:
            level = []
            for lo in range(0, len(sets), step):
                hi = min(lo + step, len(sets))
                level.append((np.bitwise_or.reduce(self.maps[lo:hi], axis=0), self.sizes[lo], self.sizes[hi - 1], self.excess[lo:hi].max(), lo, hi))
            self.levels.append(level)
            if len(level) <= 1:
                break
            step *= FAN

    def children(self, level: int, number: int) -> range:
        return range(number * FAN, min((number + 1) * FAN, len(self.levels[level - 1])))


class Joined:
    """Union-find over the texts of one unit of work."""

    def __init__(self, n: int):
        self.parent = list(range(n))
        self.links: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def link(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
            self.links.append((i, j))


def traverse(left: SignatureTree, right: SignatureTree, joined: Joined, base: tuple[int, int], num: int, den: int) -> None:
    """Link every similar pair of a text of ``left`` and one of ``right`` that isn't connected yet."""
    same = left is right
    ids = [[base[s] + i for i in tree.order] for s, tree in enumerate((left, right))]

    def possible(a, b) -> bool:
        if a[2] * den < b[1] * num or b[2] * den < a[1] * num:
            return False
        # Sets of sizes x and y are similar if the overlap is at least num (x + y) / (num + den).
        return (num + den) * (int(np.bitwise_count(a[0] & b[0]).sum()) + min(a[3], b[3])) >= num * (a[1] + b[1])

    def connected(a, b) -> bool:
        root = joined.root(ids[0][a[4]])
        return all(joined.root(i) == root for i in ids[0][a[4] : a[5]]) and all(joined.root(i) == root for i in ids[1][b[4] : b[5]])

    stack = [(len(left.levels) - 1, 0, len(right.levels) - 1, 0)]
    while stack:
        la, na, lb, nb = stack.pop()
        a, b = left.levels[la][na], right.levels[lb][nb]
        if not possible(a, b) or connected(a, b):
            continue
        if la == 0 and lb == 0:
            _compare(left, right, a, b, ids, joined, num, den, same and na == nb)
        elif la >= lb:
            for child in left.children(la, na):
                if same and la == lb:  # both sides go down together, each pair once
                    stack += [(la - 1, child, lb - 1, o) for o in right.children(lb, nb) if (na, child) <= (nb, o)]
                else:
                    stack.append((la - 1, child, lb, nb))
        else:
            stack += [(la, na, lb - 1, o) for o in right.children(lb, nb)]


def _compare(left: SignatureTree, right: SignatureTree, a: tuple, b: tuple, ids: list, joined: Joined, num: int, den: int, own: bool) -> None:
    for i in range(a[4], a[5]):
        lo = i + 1 if own else b[4]
        if lo >= b[5]:
            continue
        n, sizes = left.sizes[i], right.sizes[lo : b[5]]
        overlap = np.bitwise_count(left.maps[i] & right.maps[lo : b[5]]).sum(axis=1, dtype=np.int64) + np.minimum(left.excess[i], right.excess[lo : b[5]])
        for j in np.flatnonzero((num + den) * overlap >= num * (n + sizes)) + lo:
            x, y = ids[0][i], ids[1][j]
            if joined.root(x) == joined.root(y):
                continue
            shared = len(np.intersect1d(left.sets[i], right.sets[j], assume_unique=True))
            if den * shared >= num * (n + right.sizes[j] - shared):
                joined.link(x, y)


def tree_bits(sets: list[np.ndarray]) -> int:
    largest = max((len(s) for s in sets), default=1)
    return int(min(max(1 << (2 * largest - 1).bit_length(), 1024), 1 << 16))


def link_unit(ids: list[int], sides: list[int], sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Links that connect the similar texts of one unit: within side 0, or between sides 1 and 2."""
    groups = [[k for k, s in enumerate(sides) if s == side] for side in ((0,) if 0 in sides else (1, 2))]
    if not all(groups):
        return []
    bits = tree_bits(sets)
    order = [k for g in groups for k in g]
    joined = Joined(len(order))
    trees = [SignatureTree([sets[k] for k in g], bits) for g in groups]
    traverse(trees[0], trees[-1], joined, (0, len(groups[0]) if len(groups) > 1 else 0), num, den)
    return [(ids[order[i]], ids[order[j]]) for i, j in joined.links]


def _verify(batches: Iterable[pa.RecordBatch], size: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Links from rows (unit, side, id, text) that come ordered by unit."""
    unit, ids, sides, sets, a, b = None, [], [], [], [], []

    def finish() -> None:
        if len(ids) > 1:
            for x, y in link_unit(ids, sides, sets, num, den):
                a.append(x)
                b.append(y)
        ids.clear(), sides.clear(), sets.clear()

    for batch in (s for full in batches for s in slices(full, 200)):
        values, bounds = shingle_sets(batch.column("text"), size)
        columns = (batch.column(c).to_pylist() for c in ("unit", "side", "id"))
        for row, (u, side, i) in enumerate(zip(*columns)):
            if u != unit:
                finish()
                unit = u
            ids.append(i)
            sides.append(side)
            sets.append(values[bounds[row] : bounds[row + 1]])
        if len(a) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
            a.clear(), b.clear()
    finish()
    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _spokes(members: DataFrame, stars: DataFrame) -> DataFrame:
    """(id, unit, side, centre): each member of a large block beside the smallest text that it shares a key with.

    A centre is in a unit of its own for every NODE_TEXTS of its members.
    """
    large = members.join(members.groupBy("block").agg(F.count(F.lit(1)).alias("texts")).filter(F.col("texts") > NODE_TEXTS), "block", "left_semi")
    nearest = stars.filter(F.col("a") > F.col("b")).groupBy("a").agg(F.min("b").alias("centre")).withColumnRenamed("a", "id")
    own = large.select("id").join(nearest, "id")
    counts = own.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / NODE_TEXTS).alias("parts"))
    unit = F.xxhash64("centre", "part").alias("unit")
    side1 = counts.select("centre", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")).select(F.col("centre").alias("id"), unit, F.lit(1).alias("side"), "centre")
    side2 = own.join(counts, "centre").withColumn("part", F.pmod(F.xxhash64("id"), "parts")).select("id", unit, F.lit(2).alias("side"), "centre")
    return side1.union(side2)


def _tied(links: DataFrame, spokes: DataFrame) -> DataFrame:
    """(id, tie): texts that are known to be connected through one centre, where that joins half a node or more."""
    near = links.select(F.col("a").alias("x"), F.col("b").alias("y")).union(links.select("b", "a"))
    own = spokes.filter("side = 2").join(near, (F.col("id") == F.col("x")) & (F.col("centre") == F.col("y")), "left_semi").select("id", F.col("centre").alias("tie"))
    large = own.groupBy("tie").agg(F.count(F.lit(1)).alias("texts")).filter(2 * F.col("texts") >= NODE_TEXTS).select("tie")
    mine = own.join(large, "tie").select("id", "tie")
    # A centre is tied to its own members, unless it is a member elsewhere.
    return mine.union(large.select(F.col("tie").alias("id"), "tie").join(mine, "id", "left_anti"))


def _units(members: DataFrame, num: int, den: int, tied: DataFrame | None = None) -> DataFrame:
    """(id, unit, side) from (id, n, block): nodes of blocks by size range, and pairs of nodes.

    Texts that are ``tied`` (id, tie) are nodes of their own, which don't meet within a tie: they are
    connected already. So near copies of one text, however many, cost no more than what is left.
    """
    band = F.floor(F.log(F.col("n")) / F.log(F.lit(den / num))).cast("int")  # similar sizes are one band apart, or two by rounding
    blocks = members.groupBy("block").agg(F.count(F.lit(1)).alias("texts"))
    sized = members.join(blocks, "block")
    small = sized.filter(F.col("texts") <= NODE_TEXTS).select("id", F.xxhash64("block").alias("unit"), F.lit(0).alias("side"))
    large = sized.filter(F.col("texts") > NODE_TEXTS).select("id", "block", band.alias("band"))
    large = large.join(tied, "id", "left") if tied is not None else large.withColumn("tie", F.lit(None).cast("long"))
    large = large.withColumns({"loose": F.col("tie").isNull(), "tie": F.coalesce("tie", F.lit(0).cast("long"))})
    kind = ("loose", "tie")
    bands = large.groupBy("block", "band", *kind).agg(F.ceil(F.count(F.lit(1)) / NODE_TEXTS).alias("nodes"))
    placed = large.join(bands, ["block", "band", *kind]).withColumn("salt", F.pmod(F.xxhash64("id"), "nodes"))
    nodes = bands.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nodes") - 1))).select("block", "band", F.struct(*kind, "salt").alias("node"))
    other = nodes.select("block", F.explode(F.sequence(F.col("band"), F.col("band") + 2)).alias("band"), F.col("band").alias("low"), F.col("node").alias("low_node"))
    connected = ~F.col("node.loose") & ~F.col("low_node.loose") & (F.col("node.tie") == F.col("low_node.tie"))
    pairs = nodes.join(other, ["block", "band"]).filter(((F.col("low") < F.col("band")) | (F.col("low_node") <= F.col("node"))) & ~connected)
    pairs = pairs.withColumn("unit", F.xxhash64("block", "low", "low_node", "band", "node"))
    own = (F.col("low") == F.col("band")) & (F.col("low_node") == F.col("node"))
    first = pairs.select("block", F.col("low").alias("band"), "low_node.*", "unit", F.when(own, 0).otherwise(1).alias("side"))
    second = pairs.filter(~own).select("block", "band", "node.*", "unit", F.lit(2).alias("side"))
    return small.union(placed.join(first.union(second), ["block", "band", *kind, "salt"]).select("id", "unit", "side"))


def similar_components(texts: DataFrame, size: int, num: int, den: int, keys_of: Callable) -> DataFrame:
    """(id, n, component) for every row of ``texts`` (id, text): set size and smallest linked id.

    Texts of equal sets are linked; an empty set links with nothing. A null id stays null, with
    its own set size, and is linked with nothing. Rows of one id must have one text.
    """
    texts = texts.select(F.col("id").cast("long").alias("id"), "text")
    summary = materialize(texts.mapInArrow(partial(_summarise, size=size), "id long, n long, d0 long, d1 long"), "set-summaries")
    keyed = texts.filter(F.col("id").isNotNull()).mapInArrow(partial(_keyed, size=size, keys_of=keys_of), "key long, id long, other long")
    wanted = lambda ids: texts.join(ids.hint("shuffle_hash"), "id", "left_semi").dropDuplicates(["id"])
    return components_of(summary, keyed, wanted, size, num, den)


def _links(units: DataFrame, texts_of: Callable[[DataFrame], DataFrame], size: int, num: int, den: int) -> DataFrame:
    """(a, b): links that connect the similar texts of every unit (id, unit, side)."""
    rows = texts_of(units.select("id").distinct()).join(units.select("id", "unit", "side"), "id").select("unit", "side", "id", "text")
    ordered = rows.repartition("unit").sortWithinPartitions("unit", "side", "id")
    return ordered.mapInArrow(partial(_verify, size=size, num=num, den=den), "a long, b long")


def components_of(summary: DataFrame, keyed: DataFrame, texts_of: Callable[[DataFrame], DataFrame], size: int, num: int, den: int) -> DataFrame:
    """``similar_components`` of texts given by ``summary`` (id, n, d0, d1) and ``keyed`` (key, id, other).

    ``texts_of`` gives (id, text), a row each, of the ids asked for.
    """
    known = summary.filter(F.col("id").isNotNull() & (F.col("n") > 0))
    least = materialize(known.groupBy("d0", "d1").agg(F.min("id").alias("first")), "set-firsts")  # written, so that the join with very large classes can be split
    first = materialize(known.join(least, ["d0", "d1"]).select("id", "first", "n").distinct(), "set-classes")

    stars = materialize(keyed.repartition("key").mapInArrow(_meet, "a long, b long").distinct(), "stars")
    named = stars.join(first.select(F.col("id").alias("a"), F.col("first").alias("fa")), "a").join(first.select(F.col("id").alias("b"), F.col("first").alias("fb")), "b")
    blocks = connected_components(named.select(F.col("fa").alias("a"), F.col("fb").alias("b")))

    members = materialize(blocks.withColumnRenamed("component", "block").join(first.filter(F.col("id") == F.col("first")).select("id", "n"), "id"), "block-members")
    held = materialize(texts_of(members.select("id")), "member-texts")  # fetched once for all that follows
    own_texts = lambda ids: held.join(ids, "id", "left_semi")
    pair = named.select(F.col("fa").alias("a"), F.col("fb").alias("b")).filter(F.col("a") != F.col("b"))
    spokes = materialize(_spokes(members, pair.union(pair.select("b", "a"))), "spokes")
    links, tied = [], None
    if spokes.take(1):
        links.append(materialize(_links(spokes, own_texts, size, num, den), "spoke-links"))
        tied = _tied(links[0], spokes)
    units = materialize(_units(members, num, den, tied), "units")
    links.append(_links(units, own_texts, size, num, den))
    found = materialize(connected_components(reduce(DataFrame.union, links)), "components")
    for done in (stars, members, held, spokes, units, *links[:-1]):
        drop_all(done)

    named = first.select("id", "first").join(found.withColumnRenamed("id", "first"), "first", "left").select("id", F.coalesce("component", "first").alias("component"))
    return summary.select("id", "n").join(named, "id", "left").select("id", "n", F.coalesce("component", "id").alias("component"))
