"""Quality rules: text statistics, fixed rules, and an isolation forest over the statistics.

The forest splits at random; documents that few splits set apart are
anomalous.  All labelled rows take part, however many: one half of them grows
the forest, and the score above which a document is rejected is calibrated on
the other half: the highest that rejects as many low-quality rows as any at
which at most MAX_LOSS of the good rows are lost.  Each tree's cuts are drawn
between SUBSAMPLE rows out of the whole half, as the method wants; how many
rows its leaves hold is counted over all of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernels import NON_SPACE, Words, byte_class, chain, code_points, mix, row_sums, slices, utf8
from .staging import map_rows, named, small_batches, staged

TREES, SUBSAMPLE, SEED = 300, 64, 7
#: Part of the good labelled rows that the threshold may reject.
MAX_LOSS = 0.001

SYMBOL = byte_class(lambda v: chr(v) in "#*$%&|<>")
UPPER = byte_class(lambda v: 0x41 <= v <= 0x5A)
DIGIT = byte_class(lambda v: 0x30 <= v <= 0x39)
SHOUT = byte_class(lambda v: chr(v) in "!?")
NOT_BREAK = byte_class(lambda v: v != 0x0A)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct", "n_upper", "n_digits", "n_shouts")


def statistics(column: pa.Array) -> dict[str, np.ndarray]:
    """The counts of COUNTS for each text of a slice."""
    data, at = utf8(column)
    words = Words(data, at, NON_SPACE)
    rows, doc, hashes = len(at) - 1, words.doc, words.hash()
    salt = mix(np.arange(rows, dtype=np.uint64) + np.uint64(1))
    lines = Words(data, at, NOT_BREAK)
    worded = np.searchsorted(words.start, lines.end) > np.searchsorted(words.start, lines.start)
    line_doc, line_key = lines.doc[worded], (lines.hash() ^ salt[lines.doc])[worded]
    _, first = np.unique(line_key, return_index=True)
    windows = chain(hashes, 3)
    inside = doc[2:] == doc[: len(windows)] if len(windows) else np.zeros(0, bool)
    place = np.flatnonzero(inside)
    _, which, often = np.unique(windows[place] ^ salt[doc[place]], return_inverse=True, return_counts=True)
    again = place[often[which] > 1]
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[again + k] = True
    _, once = np.unique(hashes ^ salt[doc], return_index=True)
    per = lambda d: np.bincount(d, minlength=rows).astype(np.int64)
    return {
        "n_words": words.count.astype(np.int64),
        "word_chars": row_sums(NON_SPACE[data] & code_points(data), at),
        "n_symbols": row_sums(SYMBOL[data], at),
        "n_dup_lines": per(line_doc) - per(line_doc[first]),
        "n_repeat_words": per(doc[covered]),
        "n_distinct": per(doc[once]),
        "n_upper": row_sums(UPPER[data], at),
        "n_digits": row_sums(DIGIT[data], at),
        "n_shouts": row_sums(SHOUT[data], at),
    }


def base_failed(s: dict[str, np.ndarray]) -> np.ndarray:
    """The fixed rules: under 50 words, or over half of the words in repeated windows."""
    return (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


#: Names of what ``features`` gives.
FEATURES = ("f_length", "f_symbols", "f_repeats", "f_upper", "f_shouts", "f_signs")


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    """Rates of the statistics, which do not grow with a text's length."""
    words, chars = np.maximum(s["n_words"], 1), np.maximum(s["word_chars"], 1)
    return np.column_stack([
        s["word_chars"] / words, s["n_symbols"] / words, s["n_repeat_words"] / words,
        s["n_upper"] / chars, s["n_shouts"] / words, (s["n_symbols"] + s["n_shouts"]) / chars,
    ])


class IsolationForest:
    """Random trees as arrays: split feature (-1: leaf), split value, children, path length at a leaf.

    ``draws``: the rows of each tree, where these are drawn already.
    """

    def __init__(self, rows: np.ndarray | None = None, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = SEED, draws: list[np.ndarray] | None = None):
        rng = np.random.default_rng(seed)
        self.size = min(subsample, len(rows)) if draws is None else max(map(len, draws))
        self.depth = int(np.ceil(np.log2(max(2, self.size)))) + 2
        taken = (rows[rng.choice(len(rows), self.size, replace=False)] for _ in range(trees)) if draws is None else draws
        grown = [self._grow(t, rng) for t in taken]
        width = max(len(t) for t in grown)
        table = np.zeros((len(grown), width, 6))
        for i, t in enumerate(grown):
            table[i, : len(t)] = t
        self.feature, self.left, self.right = (table[:, :, k].astype(np.int32) for k in (0, 2, 3))
        self.value, self.path, self.deep = table[:, :, 1], table[:, :, 4], table[:, :, 5]

    def _grow(self, rows: np.ndarray, rng) -> np.ndarray:
        nodes: list[list[float]] = []

        def node(part: np.ndarray, depth: int) -> int:
            k = len(nodes)
            nodes.append([-1, 0, 0, 0, depth + _mean_path(len(part)), depth])
            low, high = part.min(axis=0), part.max(axis=0)
            open_ = np.flatnonzero(high > low)
            if depth < self.depth and len(part) > 1 and len(open_):
                f = int(rng.choice(open_))
                v = float(rng.uniform(low[f], high[f]))
                under = part[:, f] <= v
                left = node(part[under], depth + 1)
                right = node(part[~under], depth + 1)
                nodes[k] = [f, v, left, right, 0, depth]
            return k

        node(rows, 0)
        return np.array(nodes)

    def leaves(self, rows: np.ndarray) -> Iterator[np.ndarray]:
        """For each tree the leaves that the rows fall into."""
        every = np.arange(len(rows))
        for t in range(len(self.feature)):
            at = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                f = self.feature[t, at]
                if (f < 0).all():
                    break
                low = rows[every, np.maximum(f, 0)] <= self.value[t, at]
                at = np.where(f < 0, at, np.where(low, self.left[t, at], self.right[t, at]))
            yield at

    def weigh(self, held: np.ndarray) -> None:
        """Path lengths by the rows that each tree's leaves hold of a whole table, in proportion to a tree's own rows."""
        share = held * (self.size / np.maximum(held.sum(axis=1, keepdims=True), 1))
        self.path = np.where(self.feature < 0, self.deep + _mean_paths(share), 0.0)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """0 to 1; higher: fewer splits set the row apart."""
        total = np.zeros(len(rows))
        for t, at in enumerate(self.leaves(rows)):
            total += self.path[t, at]
        return 2.0 ** (-total / len(self.feature) / max(_mean_path(self.size), 1e-9))


def _mean_path(n: int) -> float:
    """Mean length of an unsuccessful search in a binary tree of n rows."""
    return 0.0 if n < 2 else 2.0 * (np.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


def _mean_paths(n: np.ndarray) -> np.ndarray:
    """The same for parts of rows, straight between 1 and 2."""
    m = np.maximum(n, 2.0)
    path = 2.0 * (np.log(m - 1) + 0.5772156649015329) - 2.0 * (m - 1) / m
    return path * np.clip(n - 1, 0, 1)


def calibrated(score: np.ndarray, good: np.ndarray, max_loss: float = MAX_LOSS) -> float:
    """The highest threshold that has as many bad rows above it as any with at most ``max_loss`` of the good rows above it.

    Between two scores the threshold stands in the middle.  Without good rows
    nothing is rejected.
    """
    kept = np.sort(score[good])
    if not len(kept):
        return np.inf
    floor = kept[len(kept) - 1 - int(max_loss * len(kept))]
    rejected = score[~good][score[~good] > floor]
    if not len(rejected):
        return float(floor)
    below = score[score < rejected.min()]
    return float((below.max() + rejected.min()) / 2) if len(below) else float(floor)


class Rules:
    """A forest and a threshold; without labelled rows all pass.

    ``fit_rules`` learns them from tables; of rows in memory, those at even
    places grow the forest, those at odd places set the threshold.
    """

    def __init__(self, rows: np.ndarray, good: np.ndarray):
        self.forest = IsolationForest(rows[::2]) if len(rows) else None
        told = slice(1, None, 2) if len(rows) > 1 else slice(None)
        self.threshold = calibrated(self.forest.score(rows[told]), good[told]) if len(rows) else np.inf

    def keeps(self, s: dict[str, np.ndarray]) -> np.ndarray:
        if self.forest is None or not len(s["n_words"]):
            return ~base_failed(s)
        return ~base_failed(s) & (self.forest.score(features(s)) <= self.threshold)


def counted(docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(d_id, the counts of COUNTS) for every row; the texts end here."""
    small_batches(docs.sparkSession)
    rows = docs.select(named(id).alias("d_id"), named(text).cast("string").alias("text"))
    schema = T.StructType([rows.schema["d_id"], *(T.StructField(c, T.LongType()) for c in COUNTS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in slices(batch.column(1)):
                s = statistics(batch.column(1).slice(low, high - low))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), *(pa.array(s[c]) for c in COUNTS)], names=["d_id", *COUNTS])

    return rows.mapInArrow(run, schema)


def _arrays(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    return {c: batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in COUNTS}


def _drawn(rows: DataFrame, n: int) -> list[np.ndarray]:
    """For each tree the SUBSAMPLE rows of all ``n`` that come first in the tree's own order, by a hash of row and tree."""
    share = min(1.0, 4 * SUBSAMPLE / n)  # so many are far more than a tree takes; the window takes the first
    bar = np.uint64(min(int(share * 2.0**64), 2**64 - 1))
    width = len(FEATURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = mix(np.arange(1, TREES + 1, dtype=np.uint64))
        for batch in batches:
            x, h = features(_arrays(batch)), batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for low in range(0, len(h), 10_000):  # of a batch, so that rows by trees stay small
                order = mix(h[low : low + 10_000, None] ^ trees[None, :])
                i, t = np.nonzero(order <= bar)
                yield pa.RecordBatch.from_arrays([pa.array(t.astype(np.int32)), pa.array(order[i, t].view(np.int64)), *(pa.array(x[low + i, k]) for k in range(width))], names=["tree", "at", *FEATURES])

    each = rows.select("h", *COUNTS).mapInArrow(run, "tree int, at bigint, " + ", ".join(f"{c} double" for c in FEATURES))
    first = each.withColumn("k", F.row_number().over(Window.partitionBy("tree").orderBy("at", *FEATURES))).where(F.col("k") <= SUBSAMPLE)
    found = first.toPandas().sort_values(["tree", "k"])  # TREES times SUBSAMPLE rows
    return [part[list(FEATURES)].to_numpy(float) for _, part in found.groupby("tree")]


def _held(rows: DataFrame, forest: IsolationForest) -> np.ndarray:
    """How many of all rows each leaf of each tree holds; a task gives one number for a leaf."""
    trees, width = forest.feature.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((trees, width), np.int64)
        for batch in batches:
            for t, at in enumerate(forest.leaves(features(_arrays(batch)))):
                n[t] += np.bincount(at, minlength=width)
        cell = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int64)), pa.array(n.ravel()[cell])], names=["cell", "n"])

    told = rows.select(*COUNTS).mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    held = np.zeros(trees * width, np.int64)
    held[told["cell"].to_numpy(np.int64)] = told["n"].to_numpy(np.int64)
    return held.reshape(trees, width)


def _threshold(rows: DataFrame, forest: IsolationForest, n_good: int, max_loss: float = MAX_LOSS) -> float:
    """``calibrated`` over a table (good, COUNTS): an order statistic of all its scores."""
    if not n_good:
        return np.inf

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(forest.score(features(_arrays(batch))))], names=["good", "score"])

    scored = staged(rows.select("good", *COUNTS).mapInArrow(run, "good boolean, score double"))
    lost = int(max_loss * n_good)
    floor = scored.where("good").orderBy(F.desc("score")).limit(lost + 1).agg(F.min("score")).first()[0]
    rejected = scored.where(~F.col("good") & (F.col("score") > floor)).agg(F.min("score")).first()[0]
    if rejected is None:
        return float(floor)
    below = scored.where(F.col("score") < rejected).agg(F.max("score")).first()[0]
    return float((below + rejected) / 2) if below is not None else float(floor)


def learn(counts: DataFrame, labels: DataFrame, *, id: str = "doc_id", label: str = "quality") -> Rules:
    """Rules from a table (d_id, COUNTS) and all its labelled rows; of equal ids the least label counts.

    Rows that the fixed rules reject are not learned from.  A hash of the id
    says which half a row is in; where one is empty all rows serve.  What comes
    to the driver are the rows of the trees' cuts and a number for each leaf.
    """
    told = labels.select(named(id).alias("l_id"), named(label).cast("int").alias("label")).where("l_id IS NOT NULL AND label IS NOT NULL").groupBy("l_id").agg(F.min("label").alias("label"))
    sound = (F.col("n_words") >= 50) & (100 * F.col("n_repeat_words") <= 50 * F.col("n_words"))
    known = counts.where(sound).join(told, F.col("d_id") == F.col("l_id"))
    known = staged(known.select(F.xxhash64(F.col("d_id").cast("string")).alias("h"), (F.col("label") == 1).alias("good"), *COUNTS))
    half = {r["half"]: r for r in known.groupBy(F.pmod("h", F.lit(2)).alias("half")).agg(F.count(F.lit(1)).alias("n"), F.count_if("good").alias("n_good")).collect()}
    rules = Rules(np.zeros((0, len(FEATURES))), np.zeros(0, bool))
    if not half:
        return rules
    both = len(half) == 2
    part = lambda k: known.where(F.pmod("h", F.lit(2)) == k) if both else known
    only = next(iter(half.values()))
    grow, set_apart = (half[0], half[1]) if both else (only, only)
    rules.forest = IsolationForest(draws=_drawn(part(0), grow["n"]))
    rules.forest.weigh(_held(part(0), rules.forest))
    rules.threshold = _threshold(part(1), rules.forest, set_apart["n_good"])
    return rules


def fit_rules(docs: DataFrame, labels: DataFrame, *, id: str = "doc_id", text: str = "text", label: str = "quality") -> Rules:
    """Fit on all labelled rows; their statistics are staged, their texts are not."""
    return learn(staged(counted(docs, id=id, text=text)), labels, id=id, label=label)


#: The columns that judging gives.
JUDGED = (*COUNTS[:5], "base_failed", "kept")


def apply_rules(docs: DataFrame, rules: Rules, *, text: str = "text", into: str = "rules") -> DataFrame:
    """The rows with a struct ``into`` of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept.

    All columns of the input stay as they are, so ``into`` must be none of them
    (``fresh_name`` finds one).  Cases: null and empty texts have no words and
    fail; a very long text is a slice of its own, and one task's memory grows
    with it; repeated rows are judged alike; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    kinds = [T.LongType()] * 5 + [T.BooleanType()] * 2
    told = T.StructType([T.StructField(n, k) for n, k in zip(JUDGED, kinds, strict=True)])
    k, last = docs.columns.index(text), f"c{len(docs.columns)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = [statistics(batch.column(k).slice(low, high - low)) for low, high in slices(batch.column(k))]
            s = {c: np.concatenate([p[c] for p in parts]) for c in COUNTS}  # the forest takes all rows of a batch at once
            found = pa.StructArray.from_arrays([*(pa.array(s[c]) for c in JUDGED[:5]), pa.array(base_failed(s)), pa.array(rules.keeps(s))], names=JUDGED)
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, last])

    return map_rows(docs, run, into, told)


def judge_documents(docs: DataFrame, labels: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the statistics, base_failed and kept for every document.

    Cases: as ``apply_rules``; a null id is judged like any other and is not
    learned from; without labelled rows the fixed rules alone decide; other
    columns are ignored.
    """
    counts = staged(counted(docs, id=id, text=text))
    rules = learn(counts, labels, id=id)
    schema = T.StructType([T.StructField("doc_id", counts.schema["d_id"].dataType), *(T.StructField(c, T.LongType()) for c in JUDGED[:5]), *(T.StructField(c, T.BooleanType()) for c in JUDGED[5:])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = _arrays(batch)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(s[c]) for c in JUDGED[:5]), pa.array(base_failed(s)), pa.array(rules.keeps(s))], names=["doc_id", *JUDGED])

    return counts.mapInArrow(run, schema)
