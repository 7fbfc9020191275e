"""Benchmark decontamination with an FM-index for each shard of training text.

A shard is a slice of an Arrow batch.  Its words are looked up in the
benchmark's vocabulary; a run of known words shorter than the shortest window
cannot hold an occurrence and is left out, which loses nothing.  The remaining
runs, as word symbols, get a suffix array, a Burrows-Wheeler transform, a
wavelet matrix for ranks and sampled suffix positions.  All windows of the
benchmark are then searched backwards at once, occurrences are located by
walking to sampled positions, and their word spans are merged per document.

Each document's result depends on its own text and the benchmark alone: there
is no shuffle, and a lost executor costs its own tasks.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernels import ALNUM, Words, slices, utf8
from .staging import map_rows, named, small_batches

WINDOW = 10
#: Text of a shard, in bytes.
SHARD_BYTES = 2 << 20
#: Benchmark text searched in one pass.  A larger benchmark is searched in
#: several passes over the rows, so what is sent to executors stays bounded.
PASS_BYTES = 8 << 20
SAMPLE_EVERY = 8


class Windows:
    """The distinct windows of a set of items, as rows of vocabulary symbols."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        texts = pa.array([t or "" for _, t in items], pa.large_string())
        words = Words(*utf8(texts), ALNUM, lower=True)
        self.vocabulary, symbols = np.unique(words.hash(), return_inverse=True)
        owners: dict[int, dict[tuple, set]] = defaultdict(lambda: defaultdict(set))
        for i, (name, _) in enumerate(items):
            own = symbols[words.first[i] : words.first[i + 1]]
            width = min(window, len(own))
            if width:
                for row in np.unique(np.lib.stride_tricks.sliding_window_view(own, width), axis=0):
                    owners[width][tuple(row.tolist())].add(name)
        self.by_width = [(k, np.array(list(rows), np.int64), list(rows.values())) for k, rows in sorted(owners.items())]
        self.shortest = min(owners, default=0)


class WaveletMatrix:
    """Ranks of symbols in a sequence, for arrays of symbols and positions at once."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.levels = []
        for bit in range(max(1, int(top).bit_length()) - 1, -1, -1):
            ones = (symbols >> bit) & 1
            rank = np.zeros(len(symbols) + 1, np.int64)
            np.cumsum(ones, out=rank[1:])
            zeros = len(symbols) - rank[-1]
            self.levels.append((bit, rank, zeros))
            symbols = np.concatenate([symbols[ones == 0], symbols[ones == 1]])

    def rank(self, symbol: np.ndarray, position: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        low = np.zeros_like(position)
        high = position
        for bit, rank, zeros in self.levels:
            one = ((symbol >> bit) & 1).astype(bool)
            below, above = rank[low], rank[high]
            low = np.where(one, zeros + below, low - below)
            high = np.where(one, zeros + above, high - above)
        return high - low


class FMIndex:
    """Runs of symbols (1 and above), each ended by a separator, ready for backward search."""

    def __init__(self, text: np.ndarray, run_start: np.ndarray):
        order = _suffix_array(text)
        self.n = len(text)
        self.bwt = text[order - 1]
        counts = np.bincount(text, minlength=int(text.max()) + 2)
        self.before = np.concatenate([[0], np.cumsum(counts)])
        self.ranks = WaveletMatrix(self.bwt, int(text.max()))
        sampled = (np.arange(self.n) % SAMPLE_EVERY == 0) | run_start
        self.sampled = sampled[order]
        self.sample_at = np.cumsum(self.sampled) - 1
        self.samples = order[self.sampled]

    def search(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of windows that occur, with their suffix ranges."""
        alive = np.arange(len(windows))
        low, high = np.zeros(len(windows), np.int64), np.full(len(windows), self.n, np.int64)
        for k in range(windows.shape[1] - 1, -1, -1):
            symbol = windows[alive, k]
            fits = symbol < len(self.before) - 1
            alive, low, high, symbol = alive[fits], low[fits], high[fits], symbol[fits]
            low = self.before[symbol] + self.ranks.rank(symbol, low)
            high = self.before[symbol] + self.ranks.rank(symbol, high)
            held = low < high
            alive, low, high = alive[held], low[held], high[held]
        return alive, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: walk back to a sampled position."""
        out = np.full(len(rows), -1, np.int64)
        open_, at, walked = np.arange(len(rows)), rows.copy(), 0
        while len(open_):
            found = self.sampled[at]
            out[open_[found]] = self.samples[self.sample_at[at[found]]] + walked
            open_, at = open_[~found], at[~found]
            symbol = self.bwt[at]
            at = self.before[symbol] + self.ranks.rank(symbol, at)
            walked += 1
        return out


def _suffix_array(text: np.ndarray) -> np.ndarray:
    """Prefix doubling.  Separators (0) count as distinct, so that order is settled within a run."""
    n = len(text)
    separators = np.flatnonzero(text == 0)
    rank = text.astype(np.int64) + len(separators)
    rank[separators] = np.arange(len(separators))
    step = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1
        key = rank * (n + len(separators) + int(text.max()) + 2) + after
        order = np.argsort(key, kind="stable")
        fresh = np.ones(n, bool)
        fresh[1:] = key[order[1:]] != key[order[:-1]]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh) - 1
        if fresh.all() or step >= n:
            return order
        step *= 2


def shard_occurrences(words: Words, windows: Windows) -> Iterator[tuple[np.ndarray, int, set]]:
    """(first words, width, owners) of each window with occurrences."""
    if not len(words) or not windows.shortest:
        return
    hashes = words.hash()
    symbol = np.minimum(np.searchsorted(windows.vocabulary, hashes), len(windows.vocabulary) - 1)
    known = windows.vocabulary[symbol] == hashes
    opens = np.ones(len(words), bool)
    opens[1:] = ~known[:-1]
    opens[words.first[:-1][words.count > 0]] = True
    starts = np.flatnonzero(known & opens)
    closes = np.ones(len(words), bool)
    closes[:-1] = ~known[1:] | opens[1:]
    lengths = np.flatnonzero(known & closes) - starts + 1
    long = lengths >= windows.shortest
    starts, lengths = starts[long], lengths[long]
    if not len(starts):
        return
    shift = np.cumsum(lengths + 1) - (lengths + 1)  # each run's place in the text
    size = int((lengths + 1).sum())
    word = np.arange(size) - np.repeat(shift, lengths + 1) + np.repeat(starts, lengths + 1)
    ends = shift + lengths
    word[ends] = -1
    text = np.where(word >= 0, symbol[word] + 1, 0)
    run_start = np.zeros(size, bool)
    run_start[shift] = True
    index = FMIndex(text, run_start)
    for width, rows, owners in windows.by_width:
        found, low, high = index.search(rows + 1)
        if not len(found):
            continue
        many = high - low
        suffixes = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
        places = np.split(word[index.locate(suffixes)], np.cumsum(many)[:-1])
        for which, at in zip(found.tolist(), places, strict=True):
            yield at, width, owners[which]


#: What marking a document gives; spans are its hit words, merged, 0-based, both ends included.
MARKS = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))),
    T.StructField("items", T.ArrayType(T.StringType())),
])


def mark_batches(windows: Windows, text: int, marks: int | None, into: str, cut: bool):
    """A mapInArrow function that fills the struct ``into`` (and cuts the spans from the text).

    text, marks: positions of the text and of an earlier pass's marks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in slices(batch.column(text), SHARD_BYTES):
                yield _mark(batch.slice(low, high - low), windows, text, marks, into, cut)

    return run


def _mark(batch: pa.RecordBatch, windows: Windows, text: int, marks: int | None, into: str, cut: bool) -> pa.RecordBatch:
    data, at = utf8(batch.column(text))
    words = Words(data, at, ALNUM, lower=True)
    n = len(words)
    edge = np.zeros(n + 1, np.int64)
    items: dict[int, set] = defaultdict(set)
    of = words.doc
    for places, width, owners in shard_occurrences(words, windows):
        np.add.at(edge, places, 1)
        np.add.at(edge, places + width, -1)
        for d in np.unique(of[places]).tolist():
            items[d] |= owners
    rows = batch.num_rows
    earlier: list = [()] * rows
    if marks is not None:  # of an earlier pass over other items
        for d, told in enumerate(batch.column(marks).to_pylist()):
            earlier[d] = told["items"]
            for s in told["spans"]:
                edge[words.first[d] + s["first"]] += 1
                edge[words.first[d] + s["last"] + 1] -= 1
    hit = np.cumsum(edge[:-1]) > 0
    opens = hit.copy()
    opens[1:] &= ~hit[:-1]
    heads = words.first[:-1][words.count > 0]
    opens[heads] = hit[heads]
    closes = hit.copy()
    closes[:-1] &= ~hit[1:]
    closes[words.first[1:][words.count > 0] - 1] = hit[words.first[1:][words.count > 0] - 1]
    first, last = np.flatnonzero(opens), np.flatnonzero(closes)
    owner = of[first]
    bounds = np.searchsorted(owner, np.arange(rows + 1))
    base = words.first[owner]
    spans = pa.ListArray.from_arrays(
        pa.array(bounds.astype(np.int32)),
        pa.StructArray.from_arrays([pa.array(first - base, pa.int64()), pa.array(last - base, pa.int64())], names=["first", "last"]),
    )
    found = pa.array([sorted(items.get(d, set()) | set(earlier[d])) for d in range(rows)], pa.list_(pa.string()))
    columns, names = list(batch.columns), list(batch.schema.names)
    if cut and len(first):
        gone = np.zeros(len(data) + 1, np.int32)
        np.add.at(gone, words.start[first], 1)
        np.add.at(gone, words.end[last], -1)
        keep = np.cumsum(gone[:-1]) == 0
        kept = np.concatenate([[0], np.cumsum(keep)])[at]
        valid = pa.array(batch.column(text).is_valid()).buffers()[1] if batch.column(text).null_count else None  # nulls stay null
        clean = pa.Array.from_buffers(pa.large_string(), rows, [valid, pa.py_buffer(kept.astype(np.int64)), pa.py_buffer(data[keep].tobytes())])
        columns[text] = clean.cast(batch.schema.field(text).type)
    told = pa.StructArray.from_arrays([pa.array(words.count, pa.int64()), spans, found], names=["n_words", "spans", "items"])
    if marks is None:
        columns.append(told)
        names.append(into)
    else:
        columns[marks] = told
    return pa.RecordBatch.from_arrays(columns, names=names)


def mark_benchmark(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    cut: bool = False,
    pass_bytes: int = PASS_BYTES,
    into: str = "marks",
) -> DataFrame:
    """The rows with a struct ``into``: n_words, spans (hit words as 0-based ``first`` to ``last``, merged) and items.

    With ``cut`` the bytes from the first to the last word of each span leave
    the text; spans then still count the words of the text as it was.  All
    other columns stay as they are, so ``into`` must be none of them.

    Cases: null and empty texts have no words, and a null stays null; a very
    long text is a shard of its own, and one task's memory grows with it; an
    item without words has no window; a null item id is the empty text;
    repeated items count once; repeated rows are marked alike; an empty
    benchmark marks nothing; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    items = benchmark.select(F.coalesce(named(item).cast("string"), F.lit("")).alias("item"), named(item_text).cast("string").alias("t")).where(F.col("t").isNotNull()).distinct()
    total = items.agg(F.coalesce(F.sum(F.octet_length("t") + 64), F.lit(0))).first()[0]
    passes = int(total // pass_bytes) + 1
    at, marks, last = docs.columns.index(text), len(docs.columns), f"c{len(docs.columns)}"
    out = None
    for k in range(passes):
        own = items if passes == 1 else items.where(F.pmod(F.xxhash64("item", "t"), F.lit(passes)) == k)
        run = mark_batches(Windows([(r["item"], r["t"]) for r in own.collect()], window), at, marks if k else None, last, cut and passes == 1)
        out = again(out, run) if k else map_rows(docs, run, into, MARKS)
    if cut and passes > 1:
        out = again(out, mark_batches(Windows([], window), at, marks, last, True))
    return out


def again(marked: DataFrame, run) -> DataFrame:
    """A further pass over marked rows, whose columns go by position meanwhile."""
    plain = marked.toDF(*[f"c{i}" for i in range(len(marked.columns))])
    return plain.mapInArrow(run, plain.schema).toDF(*marked.columns)


def hit_words(marks: str = "marks") -> Column:
    """Words inside the spans."""
    return F.aggregate(F.col(marks)["spans"], F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)


def contamination(docs: DataFrame, benchmark: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: n_words, n_hit (words inside occurrences), n_items, items_sha256, contaminated.

    Cases: as ``mark_benchmark``; null and repeated ids keep their rows; other
    columns are ignored.
    """
    marked = mark_benchmark(docs.select(named(id).alias("doc_id"), named(text).cast("string").alias("text")), benchmark)
    hit, items = hit_words(), F.col("marks.items")
    return marked.select(
        "doc_id", "marks.n_words", hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(items), ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
v AS (SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS g
      FROM (SELECT item_id, w, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
x AS (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS g
      FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM v) WHERE len(w) >= k)),
o AS (SELECT DISTINCT doc_id, item_id, x.k, i FROM x JOIN v ON x.k = v.k AND x.g = v.g),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM o) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM o) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN n USING (doc_id)
"""
