"""Embedding near-duplicates by iterative quantisation and multi-index Hamming tables.

A bounded sample teaches rotations whose signs are balanced binary codes.  The
codes are cut into substrings, one table for each; two vectors meet in a table
where a substring is equal.  How many tables there must be follows from how
often a substring of a vector survives a turn by the threshold's angle, measured
on the sample.  Vectors that meet are compared in full.

Equal vectors are one node.  Nodes that meet in a small bucket become candidate
pairs, which the Hamming distance of the first code thins out before the
original vectors decide.  A bucket of more than SPARSE nodes is dealt into
blocks; pairs of blocks are compared in tasks that give away a count and one
edge for each node, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected_components
from .staging import named, small_batches, staged

#: The only sample: vectors that rotations, centres and the number of tables are fitted on, at most, and their numbers in all.
SAMPLE_ROWS, SAMPLE_VALUES = 20_000, 4_000_000
#: Axes that a rotation turns, at most; a code has as many bits.
AXES = 64
ROUNDS = 30
#: Chance at which a pair at the threshold may meet in no table, by the sample's measure.
MISS = 1e-7
#: Tables, where a shorter substring can keep their number so low.
TABLES = 64
#: Sampled vectors of a label from which it has a centre of its own.
CENTRED = 50
#: Nodes of a bucket up to which its pairs are candidates; rows of a block, and of a tile of the product, in larger ones.
SPARSE, BLOCK, TILE = 64, 8192, 1024


class Codes(NamedTuple):
    """What a sample teaches.  centres: by label, None for all others; axes: the leading directions; turns: a rotation of each code."""

    centres: dict
    axes: np.ndarray
    turns: np.ndarray
    width: int
    tables: int
    radius: int

    def bits(self, units: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """Rows of bits: one code after the other."""
        shifted = units - np.stack([self.centres.get(x, self.centres[None]) for x in labels.tolist()]) if len(units) else units
        return np.concatenate([shifted @ self.axes @ t > 0 for t in self.turns], axis=1)

    def substrings(self, bits: np.ndarray) -> np.ndarray:
        """A number for each row and table."""
        cut = bits[:, : self.tables * self.width].reshape(len(bits), self.tables, self.width)
        return cut @ (np.int64(1) << np.arange(self.width, dtype=np.int64))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1, whatever their scale; no row is zero."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def rotation(points: np.ndarray, seed: int) -> np.ndarray:
    """Iterative quantisation: the turn of ``points`` that brings them nearest to their own signs."""
    turn = np.linalg.qr(np.random.default_rng(seed).normal(size=(points.shape[1],) * 2))[0]
    for _ in range(ROUNDS):
        signs = np.where(points @ turn > 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(points.T @ signs)
        turn = left @ right
    return turn


def fit(vectors: np.ndarray, labels: np.ndarray, threshold: float, largest: int) -> Codes:
    """Codes for labels of up to ``largest`` nodes: substrings of about log2 of that, three bits less, and tables until MISS is met."""
    units = unit(vectors)
    centres: dict = {None: units.mean(axis=0)}
    for x, n in zip(*np.unique(labels, return_counts=True), strict=True):
        if n >= CENTRED:
            centres[x.item()] = units[labels == x].mean(axis=0)
    shifted = units - np.stack([centres.get(x, centres[None]) for x in labels.tolist()])
    values, directions = np.linalg.eigh(shifted.T @ shifted)
    axes = directions[:, np.argsort(-values)[:AXES]]
    points = shifted @ axes
    rng = np.random.default_rng(11)
    some = rng.permutation(len(units))[:4000]
    aside = rng.normal(size=(len(some), units.shape[1]))
    aside -= (aside * units[some]).sum(axis=1, keepdims=True) * units[some]
    size = np.linalg.norm(aside, axis=1, keepdims=True)
    aside = np.where(size > 1e-9, aside / np.maximum(size, 1e-9), 0)  # one dimension has no aside
    near = threshold * units[some] + np.sqrt(1 - threshold**2) * aside
    turns: list[np.ndarray] = []
    for width in range(max(8, int(np.ceil(np.log2(max(largest, 2)))) - 3), 3, -1):
        tables, miss = 0, 1.0
        while miss > MISS and (tables < TABLES or width == 4) and tables < 16 * TABLES:
            while len(turns) * axes.shape[1] < max((tables + 1) * width, 64):
                turns.append(rotation(points, len(turns)))
            codes = Codes(centres, axes, np.stack(turns), width, tables + 1, 0)
            same = [codes.substrings(codes.bits(x, labels[some]))[:, -1] for x in (units[some], near)]
            miss *= 1 - (same[0] == same[1]).mean()
            tables += 1
        if miss <= MISS:
            break
    codes = Codes(centres, axes, np.stack(turns), width, tables, 0)
    far = (codes.bits(units[some], labels[some])[:, :64] != codes.bits(near, labels[some])[:, :64]).sum(axis=1)
    return codes._replace(radius=int(np.ceil(far.mean() + 6 * far.std() + 1)))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of doubles, shorter ones filled with zeros, which change no cosine of two rows of one length."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.asarray(column.offsets)
    ends = ends - ends[0]
    out, size = np.zeros((len(column), width)), np.diff(ends)
    out[np.arange(width) < size[:, None]] = flat
    return out


def usable(vector: Column, label: Column) -> Column:
    """Whether a vector can link: it has a label, a number other than zero, and finite numbers only."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(label.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def vector_components(vectors: DataFrame, *, id: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row in.

    Two rows link where their labels are equal and their cosine, in double
    precision, is ``threshold`` or more.  n_links counts the other rows that a
    row links with; component_id is the least id that links reach, its own
    included; kept tells whether it is the row's own.

    Cases: a null label, a null or zero vector or one that holds a null, NaN or
    infinity links with nothing; so do vectors of other lengths; repeated rows
    and equal vectors link with each other; a null id takes part, is no
    component's id while another is, and is not kept; labels may be of any type;
    an empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    vec, lab = named(vector), named(label)
    good = usable(vec.cast("array<double>"), lab)
    rows = vectors.select(
        named(id).alias("vec_id"),
        *[F.when(good, F.xxhash64(F.lit(salt), lab.cast("string"), F.size(vec), vec)).alias(f"h{salt}") for salt in (1, 2)],
        F.when(good, lab.cast("string")).alias("label"), F.when(good, vec).alias("vec"),
    )
    nodes = rows.where("h1 IS NOT NULL").groupBy("h1", "h2").agg(F.any_value("label").alias("label"), F.any_value("vec").alias("vec"), F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    nodes = staged(nodes.select(F.monotonically_increasing_id().alias("node"), "*"))
    largest, width = nodes.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("w")).agg(F.max("n"), F.max("w")).first()
    if largest is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    codes = _fitted(nodes, width, threshold, largest)
    weights, edges = _links(nodes, codes, width, threshold)
    found = connected_components(edges)
    placed = nodes.select("node", "h1", "h2", "least", "copies").join(weights, "node", "left").join(found, "node", "left")
    placed = placed.select("h1", "h2", "least", (F.col("copies") - 1 + F.coalesce("weight", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component"))
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    placed = placed.where("n_links > 0").join(least, "component").select("h1", "h2", "n_links", "component_id")
    # a row without links needs no partner here, and null keys meet nothing
    out = rows.select("vec_id", "h1", "h2").join(placed, ["h1", "h2"], "left")
    component = F.when(F.col("n_links").isNotNull(), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def _fitted(nodes: DataFrame, width: int, threshold: float, largest: int) -> Codes:
    rows = max(200, min(SAMPLE_ROWS, SAMPLE_VALUES // width))
    sample = nodes.orderBy(F.xxhash64("h1"), "h2").limit(rows).select("label", "vec").toArrow()
    vec = sample["vec"].combine_chunks()
    return fit(_matrix(vec, width), np.array(sample["label"].to_pylist(), dtype=object).astype(str), threshold, largest)


def _entries(nodes: DataFrame, codes: Codes, width: int) -> DataFrame:
    """(key, node, code): a node's substring in each table, as a hash of label, length, table and substring; and its first 64 bits."""
    schema = "label string, size int, node long, code long, at array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, label, vec = batch.columns
            if not len(vec):
                continue
            bits = codes.bits(unit(_matrix(vec, width)), np.array(label.to_pylist(), dtype=object))
            at = codes.substrings(bits)
            code = np.packbits(bits[:, :64], axis=1).view(np.int64).ravel() if bits.shape[1] >= 64 else np.zeros(len(bits), np.int64)
            lists = pa.ListArray.from_arrays(np.arange(0, at.size + 1, codes.tables, dtype=np.int32), at.ravel())
            size = np.diff(np.asarray(vec.offsets)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([label, pa.array(size), node, pa.array(code), lists], names=["label", "size", "node", "code", "at"])

    coded = nodes.select("node", "label", "vec").mapInArrow(run, schema)
    each = coded.select("label", "size", "node", "code", F.posexplode("at").alias("table", "at"))
    return each.select(F.xxhash64("label", "size", "table", "at").alias("key"), "table", "node", "code")


def _links(nodes: DataFrame, codes: Codes, width: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(node, weight): rows of other nodes that a node links with; and edges (u, v) that join what is linked."""
    entries = staged(_entries(nodes, codes, width))
    large = staged(entries.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > SPARSE))
    few = entries.join(large, "key", "left_anti").select("key", "node", "code")
    apart = F.bit_count(F.col("a.code").bitwiseXOR(F.col("b.code")))
    met = few.alias("a").join(few.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.node") < F.col("b.node")) & (apart <= codes.radius))
    pairs = met.select(F.col("a.node").alias("u"), F.col("b.node").alias("v")).distinct()

    # nodes of large buckets, with their keys there by table; only these carry vectors from bucket to bucket
    crowded = entries.join(large, "key").select("key", "table", "node", "size")
    keys = staged(crowded.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("table", "key", "size"))).alias("dense")))

    side = lambda name: nodes.select(F.col("node").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in ("label", "vec", "copies")]).join(keys.select(F.col("node").alias(name), F.col("dense.key").alias(f"keys_{name}")), name, "left")
    both = pairs.join(side("u"), "u").join(side("v"), "v").where("label_u = label_v AND size(vec_u) = size(vec_v) AND NOT coalesce(arrays_overlap(keys_u, keys_v), false)")
    links = staged(both.select("u", "v", "copies_u", "copies_v", "vec_u", "vec_v").mapInArrow(_confirm(width, threshold), "u long, v long, copies_u long, copies_v long"))

    blocks = keys.join(nodes.select("node", "vec", "copies"), "node").select(
        "node", "vec", "copies", F.col("dense.key").alias("keys"), F.col("dense.table").alias("tables"), F.explode("dense").alias("own")
    )
    n = F.ceil(F.col("own.size") / BLOCK).cast("long")
    mine = F.pmod(F.xxhash64("node"), n)
    blocks = blocks.select("node", "vec", "copies", "keys", "tables", F.col("own.key").alias("key"), F.col("own.table").alias("table"), mine.alias("mine"), F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("other"))
    blocks = blocks.select("key", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "mine", "node", "vec", "copies", "table", "tables", "keys")
    counted = staged(blocks.groupBy("key", "low", "high").applyInArrow(_blocks(width, threshold), "node long, weight long, edge long"))

    weights = links.select(F.col("u").alias("node"), F.col("copies_v").alias("weight")).unionByName(links.select(F.col("v").alias("node"), F.col("copies_u").alias("weight"))).unionByName(counted.select("node", "weight"))
    edges = links.select("u", "v").unionByName(counted.where("edge IS NOT NULL").select(F.col("node").alias("u"), F.col("edge").alias("v")))
    return weights.groupBy("node").agg(F.sum("weight").alias("weight")).where("weight > 0"), edges


def _confirm(width: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (unit(_matrix(batch.column(i), width)) for i in (4, 5))
            held = pa.array((a * b).sum(axis=1) >= threshold)
            yield batch.select([0, 1, 2, 3]).filter(held)

    return run


def _blocks(width: int, threshold: float):
    """For two blocks of a bucket (or one with itself): each node's linked rows, and an edge to the least node that it hangs together with.

    A pair that meets in several large buckets is counted in the first by table.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        key, low, high = (table[c][0].as_py() for c in ("key", "low", "high"))
        node, mine, copies = (table[c].to_numpy() for c in ("node", "mine", "copies"))
        units = unit(_matrix(table["vec"].chunk(0), width))
        listed = [table[c].chunk(0) for c in ("keys", "tables")]
        keys, tables = (x.flatten().to_numpy() for x in listed)
        owner = np.repeat(np.arange(len(node)), np.diff(np.asarray(listed[0].offsets)))
        before = np.zeros((len(node), table["table"][0].as_py()), np.int64)  # large buckets in the tables before this one
        earlier = tables < before.shape[1]
        before[owner[earlier], tables[earlier]] = keys[earlier]
        weight = np.zeros(len(node), np.int64)
        left, right = (np.flatnonzero(mine == x) for x in (low, high))
        order = np.argsort(node, kind="stable")
        rank = np.empty(len(node), np.int64)
        rank[order] = np.arange(len(node))
        linked: list[tuple[np.ndarray, np.ndarray]] = []
        for i in range(0, len(left), TILE):
            for j in range(i if low == high else 0, len(right), TILE):
                x, y = left[i : i + TILE], right[j : j + TILE]
                hit = units[x] @ units[y].T >= threshold
                if low == high and i == j:
                    hit = np.triu(hit, 1)
                u, v = np.nonzero(hit)
                if not len(u):
                    continue
                u, v = x[u], y[v]
                linked.append(_forest(rank[u], rank[v]))
                first = ~_met_before(before, u, v)
                np.add.at(weight, u[first], copies[v[first]])
                np.add.at(weight, v[first], copies[u[first]])
        if linked:
            u, v = (np.concatenate(s) for s in zip(*linked, strict=True))
            edge = node[order[_least(len(node), u, v)[rank]]]
        else:
            edge = node
        edge = pa.array(edge, mask=edge == node)
        kept = pa.array((weight > 0) | (edge.is_valid().to_numpy(zero_copy_only=False)))
        return pa.table([pa.array(node), pa.array(weight), edge], names=["node", "weight", "edge"]).filter(kept)

    return run


def _met_before(before: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Whether two nodes share a large bucket of an earlier table."""
    out = np.zeros(len(u), bool)
    for keys in before.T:
        out |= (keys[u] == keys[v]) & (keys[u] != 0)
    return out


def _least(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least number that each of ``n`` hangs together with."""
    low = np.arange(n)
    while True:
        before = low.copy()
        for a, b in ((u, v), (v, u)):
            np.minimum.at(low, a, low[b])
        low = low[low]
        if (low == before).all():
            return low


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As few edges as there are nodes, which join what ``u`` and ``v`` join."""
    names, both = np.unique(np.concatenate([u, v]), return_inverse=True)
    low = _least(len(names), both[: len(u)], both[len(u) :])
    return names, names[low]
