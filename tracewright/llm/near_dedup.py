"""MinHash near-deduplication with an LSH forest.

1.  Every text becomes its set of word shingles, a class key (equal sets have
    equal keys) and a signature of BINS minima.  From here on a class of equal
    sets is one node, so exact copies cost one row however many there are.
2.  The forest: tree ``t`` sorts all nodes by their signature read from bin
    ``t * STRIDE`` on, around the end.  In that order, neighbours with the
    longest common prefixes stand together.  Runs of neighbours that share FLOOR
    values are split at their shortest common prefix, each run by itself, until
    what is left is a few nodes, or at most REGION that share DEPTH values: so
    sparse regions stay shallow and dense ones get deep.
3.  Inside a region, nodes whose whole signatures agree nearly as often as
    linked sets must are joined.  Components of these joins are candidate
    groups.  Where more than REGION nodes share DEPTH values, splitting parts
    pairs that should meet; all of them are put in one candidate group, which
    the next step settles exactly.
4.  The full sets of a candidate group meet in one task, which finds the exact
    links that matter for connectivity: of any two exact components, all nodes
    of one have been held against all nodes of the group.  Groups too large
    for a task are dealt into parts that share hubs; nodes left outside the
    group's largest component then meet whatever shares one of their rarest
    shingles (a linked pair must share one), and those pairs are confirmed.
5.  Exact components give each document its component and whether it is kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .components import connected_components
from .kernels import NON_SPACE, Words, chain, mix, slices, utf8
from .staging import columns_of, fresh_name, named, small_batches, staged

BINS, STRIDE = 128, 8
TREES = BINS // STRIDE
#: Values of an order that are kept, and the common prefix below which neighbours are strangers.
ORDER, FLOOR = 24, 2
#: Nodes of a region, at most; and of one that need not share DEPTH values.
REGION, FEW = 512, 16
#: Common prefix of a region of more than FEW nodes, for similarities from 85 % on and below.
DEPTH = {True: 4, False: 3}
#: Rows of one run of neighbours that a task holds, at most; a longer run is cut where splitting cuts it anyway.
HELD = 1 << 16
#: Four standard deviations of the estimate that a signature gives.
MARGIN = 0.17
#: Shingles of a candidate group that meet in one task, at most; larger groups are dealt into parts.
PART_SHINGLES = 2_000_000
HUBS = 16
#: Nodes whose map to a group is broadcast to the scan of texts; above it the join is shuffled.
BROADCAST_ROWS = 1_000_000

_SEED = np.random.default_rng(20240101)
_PROBES = np.argsort(_SEED.random((BINS, BINS)), axis=1)
_EDGES = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - 7)


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words is one shingle."""
    words = Words(*utf8(column), NON_SPACE, lower=True)
    hashes = words.hash()
    runs = chain(hashes, width)
    for low, high in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if high - low >= width:
            yield np.unique(runs[low : high - width + 1])
        elif high > low:
            yield chain(hashes[low:high], high - low)
        else:
            yield np.zeros(0, np.uint64)


def class_key(shingles: np.ndarray) -> bytes:
    """128 bits over the set and its size."""
    with np.errstate(over="ignore"):
        a = mix(shingles + np.uint64(0x1234567)).sum(dtype=np.uint64) + np.uint64(len(shingles))
        b = np.bitwise_xor.reduce(mix(shingles * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x7654321)))
    return np.array([a, b], np.uint64).tobytes()


def signature(shingles: np.ndarray) -> np.ndarray:
    """BINS 16-bit minima by one permutation; an empty bin copies the first filled one of its own probe order."""
    at = np.searchsorted(shingles, _EDGES)
    filled = np.empty(BINS, bool)
    filled[:-1] = at[:-1] < at[1:]
    filled[-1] = at[-1] < len(shingles)
    value = (shingles[np.minimum(at, len(shingles) - 1)] & np.uint64(0xFFFF)).astype(np.uint16)
    empty = np.flatnonzero(~filled)
    if len(empty):
        probes = _PROBES[empty]
        value[empty] = value[probes[np.arange(len(empty)), filled[probes].argmax(axis=1)]]
    return value


def _signed(width: int, text: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in slices(batch.column(text)):
                part = batch.slice(low, high - low)
                sizes, keys, signs = [], [], []
                for shingles in shingle_sets(part.column(text), width):
                    sizes.append(len(shingles))
                    keys.append(class_key(shingles) if len(shingles) else None)
                    signs.append(signature(shingles).tobytes() if len(shingles) else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(signs, pa.binary())],
                    names=["row", "n_shingles", "key", "sign"],
                )

    return run


def grouped(key: str, run: Callable[[pa.Table], Iterator[pa.RecordBatch]]):
    """A mapInArrow function over rows sorted by ``key``: ``run`` gets whole groups, many at a time."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(batch.schema.get_field_index(key))
            last = keys[len(keys) - 1]
            changed = np.flatnonzero(~np.asarray(pc.equal(keys, last)))
            cut = int(changed[-1]) + 1 if len(changed) else 0
            if cut:
                yield from run(pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks())
                held = []
            elif held and held[-1].column(batch.schema.get_field_index(key))[held[-1].num_rows - 1] != last:
                yield from run(pa.Table.from_batches(held).combine_chunks())
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from run(pa.Table.from_batches(held).combine_chunks())

    return over


def bounds_of(keys) -> np.ndarray:
    """Positions where a sorted column's value changes, with both ends."""
    codes = keys.combine_chunks().dictionary_encode()
    codes = np.concatenate([c.indices.to_numpy() for c in codes.chunks]) if isinstance(codes, pa.ChunkedArray) else codes.indices.to_numpy()
    return np.concatenate([[0], np.flatnonzero(np.diff(codes)) + 1, [len(codes)]])


class Forest:
    """Union-find over a few nodes."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


def _region_joins(least: float):
    """Rows (region, node, sign) -> (u, v, hub): joins of nodes whose signatures agree in at least that part."""

    def run(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        nodes = rows.column("node").to_numpy()
        signs = np.frombuffer(b"".join(rows.column("sign").to_pylist()), np.uint16).reshape(-1, BINS)
        edges = bounds_of(rows.column("region"))
        u, v, hub = [], [], []
        for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            own = signs[low:high]
            m = high - low
            if m < 2:
                continue
            near = np.empty((m, m), np.float32)
            for a in range(0, m, 64):
                near[a : a + 64] = (own[a : a + 64, None, :] == own[None, :, :]).mean(axis=2)
            joined = near >= least
            heart = int(near.sum(axis=1).argmax())
            forest = Forest(m)
            for x, y in zip(*np.nonzero(np.triu(joined, 1)), strict=True) if m <= 32 else _spanning(joined):
                forest.join(int(x), int(y))
            for x in range(m):
                r = forest.root(x)
                if r != x:
                    u.append(nodes[low + x])
                    v.append(nodes[low + r])
                    hub.append(nodes[low + heart])
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (u, v, hub)], names=["u", "v", "hub"])

    return run


def _spanning(joined: np.ndarray) -> Iterator[tuple[int, int]]:
    """Edges that connect what ``joined`` connects, by breadth-first search."""
    fresh = np.ones(len(joined), bool)
    for start in range(len(joined)):
        if not fresh[start]:
            continue
        fresh[start] = False
        queue = [start]
        while queue:
            x = queue.pop()
            found = np.flatnonzero(joined[x] & fresh)
            fresh[found] = False
            for y in found.tolist():
                yield x, y
            queue.extend(found.tolist())


def common_prefixes(tree: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Length of the prefix that each row of sorted orders shares with the row before; -1 for the first and for another tree's."""
    out = np.full(len(tree), -1, np.int64)
    same = order[1:] == order[:-1]
    out[1:] = np.where(same.all(axis=1), order.shape[1], same.argmin(axis=1))
    out[1:][tree[1:] != tree[:-1]] = -1
    return out


def split_run(prefix: np.ndarray, depth: int, region: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Ranges of a run that become regions, and ranges too large for one though they share ``depth`` values.

    prefix: of each row with the row before (the first counts nothing).  A run
    is split wherever its shortest common prefix stands.
    """
    regions, dense, open_ = [], [], [(0, len(prefix))]
    while open_:
        low, high = open_.pop()
        if high - low < 2:
            continue
        shortest = int(prefix[low + 1 : high].min())
        if high - low <= min(FEW, region) or (high - low <= region and shortest >= depth):
            regions.append((low, high))
            continue
        if shortest >= depth and not any(a <= low and high <= b for a, b in dense[-1:]):
            dense.append((low, high))
        if shortest >= ORDER:  # alike in all that the order holds
            regions += [(a, min(a + region, high)) for a in range(low, high, region)]
            continue
        cuts = [low, *(np.flatnonzero(prefix[low + 1 : high] == shortest) + low + 1).tolist(), high]
        open_ += zip(cuts[:-1], cuts[1:], strict=True)
    return regions, dense


def _neighbours(depth: int, region: int, limit: int = HELD):
    """Rows (tree, order, node) in order -> (region, node, dense): regions, and the nodes of dense runs under a number below 0.

    A run of more than ``limit`` rows is not held whole.  Up to the last place
    of its shortest prefix so far it is done, as that is where it is split.
    Where even the shortest has ``depth``, the run is dense and bears one name
    in all its pieces; more than ``region`` rows stay, so that the rest is
    known as dense too.
    """

    def done(prefix: np.ndarray) -> int:
        """Rows at the beginning of one long run that no later row can meet."""
        shortest = int(prefix[1:].min())
        if shortest < depth:
            return int(np.flatnonzero(prefix[1:] == shortest)[-1]) + 1
        return len(prefix) - region - 1

    def taken(tree: np.ndarray, order: np.ndarray, node: np.ndarray, prefix: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        starts = np.flatnonzero(prefix < FLOOR)
        ends = np.append(starts[1:], len(prefix))
        for low, high in zip(starts.tolist(), ends.tolist(), strict=True):
            if high - low < 2:
                continue
            regions, dense = split_run(prefix[low:high], depth, region)
            for a, b in regions:
                yield np.full(b - a, node[low + a] * TREES + tree[low]), node[low + a : low + b], False
            for a, b in dense:
                shared = order[low + a, :depth].astype(np.uint64)
                name = chain(np.append(shared, np.uint64(tree[low])), depth + 1)[0] >> np.uint64(2)
                yield np.full(b - a, -1 - int(name)), node[low + a : low + b], True

    def batch_of(found: list) -> pa.RecordBatch:
        region_, node, flag = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in ([f[0] for f in found], [f[1] for f in found], [np.full(len(f[1]), f[2]) for f in found])]
        return pa.RecordBatch.from_arrays([pa.array(region_, pa.int64()), pa.array(node, pa.int64()), pa.array(flag.astype(bool), pa.bool_())], names=["region", "node", "dense"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros((0, ORDER), np.uint16), np.zeros(0, np.int64)]
        for batch in batches:
            if not batch.num_rows:
                continue
            order = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, ORDER)
            held = [np.concatenate(x) for x in zip(held, (batch.column(0).to_numpy().astype(np.int64), order, batch.column(2).to_numpy()), strict=True)]
            prefix = common_prefixes(held[0], held[1])
            last = int(np.flatnonzero(prefix < FLOOR)[-1])  # where the run begins that may go on
            while last or len(prefix) > max(limit, 2 * region + 1):
                last = last or done(prefix)
                yield batch_of(list(taken(*(x[:last] for x in held), prefix[:last])))
                held, prefix = [x[last:] for x in held], prefix[last:].copy()
                prefix[0], last = -1, 0
        if len(held[0]):
            yield batch_of(list(taken(*held, common_prefixes(held[0], held[1]))))

    return run


def neighbour_regions(nodes: DataFrame, depth: int, region: int, partitions: int) -> DataFrame:
    """(node, sign) -> (region, node, dense).

    Each tree's order is one range of a global sort, which no hot prefix makes
    uneven; where two partitions meet, a run is cut in that one tree.
    """
    ring = F.concat("sign", "sign")
    trees = nodes.select("node", ring.alias("ring"), F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    spread = trees.select("tree", F.expr(f"substring(ring, tree * {2 * STRIDE} + 1, {2 * ORDER})").alias("order"), "node")
    keys = ["tree", "order", "node"]
    return spread.repartitionByRange(partitions, *keys).sortWithinPartitions(*keys).mapInArrow(_neighbours(depth, region), "region bigint, node bigint, dense boolean")


def prefix_length(size, percent: int):
    """Elements of a set, rarest first, of which any set that is linked with it must have one."""
    return size - -(-percent * size // 100) + 1


def exact_joins(sets: list[np.ndarray], percent: int, ask: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """Links (100 * common >= percent * union) that connect all that links connect.

    A hub is held against all sets.  Then every set outside the largest
    component so far is held against all sets; a link with both ends inside it
    cannot connect anything more.  ``ask``: hold these sets against all instead.
    Only sets that share one of the rarest elements are compared.
    """
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    rows = np.repeat(np.arange(m), sizes)
    often = np.bincount(column, minlength=len(values))
    rarity = np.empty(len(values), np.int64)
    rarity[np.argsort(often, kind="stable")] = np.arange(len(values))
    first = np.concatenate([[0], np.cumsum(sizes)])
    by_rarity = np.lexsort((rarity[column], rows))  # within each set
    place = np.arange(len(rows)) - first[rows]
    kept = by_rarity[(place < prefix_length(sizes, percent)[rows]) & (often[column[by_rarity]] > 1)]
    word, owner = column[kept], rows[kept]
    own_at = np.searchsorted(owner, np.arange(m + 1))
    order = np.argsort(word, kind="stable")
    postings, start = owner[order], np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(values)))])
    whole = np.argsort(column, kind="stable")
    all_postings, all_start = rows[whole], np.concatenate([[0], np.cumsum(often)])
    forest, expanded = Forest(m), np.zeros(m, bool)

    def met(own: np.ndarray, lists: np.ndarray, begin: np.ndarray) -> np.ndarray:
        n = begin[own + 1] - begin[own]
        return lists[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[own], n)]

    def links(x: int) -> list[int]:
        expanded[x] = True
        near = np.unique(met(word[own_at[x] : own_at[x + 1]], postings, start))
        near = near[(near != x) & (100 * np.minimum(sizes[near], sizes[x]) >= percent * np.maximum(sizes[near], sizes[x]))]
        own = column[first[x] : first[x + 1]]
        if len(near) > 32:
            common = np.bincount(met(own, all_postings, all_start), minlength=m)[near]
        else:
            common = np.array([np.intersect1d(own, column[first[y] : first[y + 1]], assume_unique=True).size for y in near.tolist()], np.int64)
        return near[100 * common >= percent * (sizes[near] + sizes[x] - common)].tolist()

    if ask is not None:
        for x in np.flatnonzero(ask).tolist():
            for y in links(x):
                yield x, y
        return
    typical = np.bincount(rows, weights=often[column], minlength=m) / sizes
    queue = [int(typical.argmax())]
    while queue:
        for x in queue:
            for y in links(x):
                if forest.root(x) != forest.root(y):
                    forest.join(x, y)
                    yield x, y
        roots = np.array([forest.root(x) for x in range(m)])
        largest = np.bincount(roots).argmax()
        queue = np.flatnonzero(~expanded & (roots != largest)).tolist()[: max(1, m // 8)]


def _group_links(width: int, percent: int):
    """Rows (part, node, asks, text) -> exact links (u, v) of each part."""

    def run(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        edges = bounds_of(rows.column("part"))
        names, asks, text = rows.column("node").to_pylist(), rows.column("asks").to_pylist(), rows.column("text").combine_chunks()
        u, v = [], []
        for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            found: dict[int, tuple[np.ndarray, bool]] = {}
            own = text.slice(low, high - low)
            k = low
            for a, b in slices(own):
                for shingles in shingle_sets(own.slice(a, b - a), width):
                    found[names[k]] = (shingles, bool(asks[k]) or found.get(names[k], (0, False))[1])
                    k += 1
            if len(found) < 2:
                continue
            keys = sorted(found)
            ask = np.array([found[x][1] for x in keys])
            for x, y in exact_joins([found[x][0] for x in keys], percent, ask if ask.any() else None):
                u.append(keys[x])
                v.append(keys[y])
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return run


def _small(df: DataFrame) -> DataFrame:
    """A staged table, to be broadcast where it has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _links(texts: DataFrame, wanted: DataFrame, width: int, percent: int, partitions: int) -> DataFrame:
    """wanted (part, node, asks): read the texts again and link each part's sets."""
    joined = texts.join(_small(staged(wanted)), F.col("row") == F.col("node")).select("part", "node", "asks", "text")
    return joined.repartition(partitions, "part").sortWithinPartitions("part").mapInArrow(grouped("part", _group_links(width, percent)), "u bigint, v bigint")


def _shingle_rows(width: int):
    """Rows (component, node, n, exact, outside, text) -> the same with one shingle for each row instead of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in slices(batch.column(5)):
                part = batch.slice(low, high - low)
                sets = list(shingle_sets(part.column(5), width))
                at = pa.array(np.repeat(np.arange(len(sets)), [len(x) for x in sets]))
                values = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([*(part.column(k).take(at) for k in range(5)), pa.array(values, pa.int64())], names=["component", "node", "n", "exact", "outside", "s"])

    return run


def _rare_links(texts: DataFrame, many: DataFrame, links: DataFrame, width: int, percent: int, partitions: int, part_shingles: int) -> DataFrame:
    """Links of the nodes outside the largest exact component of each large group, by a join on their rarest shingles.

    The order of rarity puts shingles first that no other node, or no outside
    node, of the group has; they use up the prefix and join nothing.  At the
    first shingle that two linked sets share, what follows in both is still
    enough for a link, so pairs meet at no place further back.
    """
    exact = connected_components(links).withColumnRenamed("component", "exact")
    placed = staged(many.join(exact, "node", "left").select("component", "node", F.col("n_shingles").alias("n"), F.coalesce("exact", "node").alias("exact")))
    sizes = placed.groupBy("component", "exact").agg(F.count(F.lit(1)).alias("size"))
    main = staged(sizes.groupBy("component").agg(F.max(F.struct("size", "exact")).alias("top"), F.count(F.lit(1)).alias("parts")).where("parts > 1").select("component", F.col("top.exact").alias("main")))
    told = placed.join(_small(main), "component").select("component", "node", "n", "exact", (F.col("exact") != F.col("main")).alias("outside"))
    told = staged(told)
    rows = texts.join(_small(told), F.col("row") == F.col("node")).select("component", "node", "n", "exact", "outside", "text")
    entries = staged(rows.mapInArrow(_shingle_rows(width), "component bigint, node bigint, n bigint, exact bigint, outside boolean, s bigint"))
    often = entries.groupBy("component", "s").agg(F.count(F.lit(1)).alias("often"), F.bool_or("outside").alias("wanted"))
    useful = staged(often.where("wanted and often > 1").select("component", "s", "often"))
    by_node = Window.partitionBy("node")
    ranked = entries.join(useful, ["component", "s"]).withColumn("rank", F.row_number().over(by_node.orderBy("often", "s"))).withColumn("held", F.count(F.lit(1)).over(by_node))
    length = F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100) + 1
    place = F.col("n") - F.col("held") + F.col("rank")
    prefix = staged(ranked.where(place <= length).select("component", "node", "n", "exact", "outside", "s", (F.col("n") - place + 1).alias("left")))
    a, b = prefix.where("outside").alias("a"), prefix.alias("b")
    c = lambda x: F.col(x)
    near = (c("a.component") == c("b.component")) & (c("a.s") == c("b.s")) & (c("a.exact") != c("b.exact"))
    near = near & (100 * F.least("a.n", "b.n") >= percent * F.greatest("a.n", "b.n"))
    near = near & ((100 + percent) * F.least("a.left", "b.left") >= percent * (c("a.n") + c("b.n")))
    pairs = staged(a.join(b, near).select(c("a.node").alias("asker"), c("b.node").alias("other"), c("b.n").alias("n")).distinct())
    # an asker's others fill one part with other askers', or several of its own
    loads = staged(pairs.groupBy("asker").agg(F.sum("n").alias("load")))
    lots = max(1, -(-int(loads.agg(F.coalesce(F.sum("load"), F.lit(0))).first()[0]) // part_shingles))
    own = F.col("load") > part_shingles
    lot = F.when(own, F.xxhash64("asker", F.lit(1))).otherwise(F.pmod(F.xxhash64("asker"), F.lit(lots)))
    chunk = F.when(own, F.pmod(F.xxhash64("other"), F.ceil(F.col("load") / part_shingles))).otherwise(F.lit(0))
    dealt = pairs.join(loads, "asker").select(F.xxhash64(lot, chunk).alias("part"), "asker", "other")
    wanted = dealt.select("part", F.col("asker").alias("node"), F.lit(True).alias("asks")).unionByName(dealt.select("part", F.col("other").alias("node"), F.lit(False).alias("asks")))
    return _links(texts, wanted.distinct(), width, percent, partitions)


def _row_components(texts: DataFrame, width: int, percent: int, *, region: int = REGION, part_shingles: int = PART_SHINGLES, fallback: bool = True) -> DataFrame:
    """(row, text), staged and of distinct rows -> row, n_shingles, component (a row of it; null without words).

    ``fallback``: settle dense regions exactly; without it the forest alone proposes candidates.
    """
    spark = texts.sparkSession
    small_batches(spark)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("key", T.BinaryType()), T.StructField("sign", T.BinaryType())])
    signed = staged(texts.mapInArrow(_signed(width, 1), schema))
    # a class of equal sets is a node, named by its least row
    nodes = staged(
        signed.where("key is not null").groupBy("key").agg(F.min("row").alias("node"), F.min(F.struct("n_shingles", "sign")).alias("x")).select("key", "node", "x.*")
    )
    found = staged(neighbour_regions(nodes.select("node", "sign"), DEPTH[percent >= 85], region, partitions))
    signs = found.where("not dense").select("region", "node").join(nodes.select("node", "sign"), "node").select("region", "node", "sign")
    joins = staged(
        signs.repartition(partitions, "region").sortWithinPartitions("region").mapInArrow(grouped("region", _region_joins(percent / 100 - MARGIN)), "u bigint, v bigint, hub bigint")
    )
    edges = joins.select("u", "v")
    if fallback:
        edges = edges.unionByName(found.where("dense").select(F.col("node").alias("u"), F.col("region").alias("v")).distinct())
    groups = connected_components(edges)
    members = staged(groups.join(nodes.select("node", "n_shingles"), "node").select("component", "node", "n_shingles"))
    weights = members.groupBy("component").agg(F.sum("n_shingles").alias("weight"))
    large = staged(weights.where(F.col("weight") > part_shingles))
    any_large = bool(large.limit(1).count())
    part = lambda n: F.xxhash64("component", n.cast("int"))
    row = lambda df, k: df.select(part(k).alias("part"), "node", F.lit(False).alias("asks"))
    chosen = row(members, F.lit(0))
    if any_large:
        side = _small(large)
        many = staged(members.join(side, "component").withColumn("parts", F.ceil(F.col("weight") / part_shingles).cast("int")))
        votes = joins.groupBy("hub").agg(F.count(F.lit(1)).alias("votes")).withColumnRenamed("hub", "node")
        rank = F.row_number().over(Window.partitionBy("component").orderBy(F.col("votes").desc(), "node"))
        hubs = many.join(votes, "node").withColumn("r", rank).where(F.col("r") <= HUBS)
        every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
        shared = row(hubs.select("component", "node", every.alias("k")), F.col("k"))
        chosen = row(members.join(side, "component", "left_anti"), F.lit(0)).unionByName(row(many, F.pmod(F.xxhash64("node"), F.col("parts")))).unionByName(shared).distinct()
    links = staged(_links(texts, chosen, width, percent, partitions))
    if any_large:
        links = links.unionByName(staged(_rare_links(texts, many, links, width, percent, partitions, part_shingles)))
    exact = connected_components(links)
    classes = staged(nodes.select("key", "node").join(exact, "node", "left").select("key", F.coalesce("component", "node").alias("component")))
    return signed.select("row", "n_shingles", "key").join(classes, "key", "left").select("row", "n_shingles", "component")


def document_components(docs: DataFrame, *, id: str = "doc_id", text: str = "text", width: int = 3, percent: int = 85, **how) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row.

    Cases: null and empty texts have no shingles and are linked with nothing;
    a null id takes part but names no component: its component_id is null where
    no row of its component has an id, and it is kept only then; repeated rows
    are copies of each other and share a component; a very long text is a slice
    of its own, and one task's memory grows with it; an empty table gives no
    rows; other columns are ignored.  kept holds for all rows that bear the
    component's least id.
    """
    keyed = staged(docs.select(F.monotonically_increasing_id().alias("row"), named(id).alias("doc_id"), named(text).cast("string").alias("text")))
    linked = staged(_row_components(keyed.select("row", "text"), width, percent, **how).join(keyed.select("row", "doc_id"), "row"))
    # staged, so that a join with a hot component can be split
    least = staged(linked.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id")))
    named_ = linked.join(least, "component", "left")
    component = F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return named_.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, *, id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, that of the least id (null last); columns stay as they are.

    Rows are told apart by a number of their own, so repeated and null ids are
    no exception.  Cases: rows without words are linked with nothing and stay;
    of repeated rows one stays; a very long text is a slice of its own; an
    empty table gives no rows; columns of any name keep their values.
    """
    number = fresh_name(docs.columns, "_row")
    keyed = staged(docs.withColumn(number, F.monotonically_increasing_id()))
    texts = keyed.select(named(number).alias("row"), named(text).cast("string").alias("text"))
    groups = staged(_row_components(texts, width, percent).where("component is not null").select("row", "component"))
    owned = groups.join(keyed.select(named(number).alias("row"), named(id).alias("own")), "row")
    first = F.min(F.struct(F.col("own").isNull().alias("x"), "own", "row"))
    stays = staged(owned.groupBy("component").agg(first.alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("component", F.col("first.row").alias("stays")))
    goes = staged(groups.join(stays, "component").where(F.col("row") != F.col("stays")).select(F.col("row").alias(number)))
    return keyed.join(_small(goes), number, "left_anti").select(*columns_of(docs))
