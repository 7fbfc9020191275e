"""Divergence of sources within a language, from one sort of terms.

Tasks emit, for each block of texts, how many documents of a source hold a term
and how often.  These rows are dealt by ranges of (lang, term, source,
document) and sorted so, lang and term as one string; a scan of each range closes one run after the other
and yields a term's document frequency and its counts by source.  A run that
touches the end of a range is left open, and the few such rows are added up
apart, so a frequent term is no one task's.  A second scan, with the terms'
shares known, yields partial sums for pairs of sources.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernels import LETTERS, slices, terms
from .staging import named, small_batches, staged

SCALE = 1_000_000_000
#: Text that is counted together, in bytes, and rows of counts that a task holds before it gives them away.
BLOCK_BYTES, HELD = 4 << 20, 400_000

#: Stands between lang and term in a key.  No term holds it, so a key's last one parts the two.
MARK = "\0"

_BLOCK = "key string, source string, doc long, df long, n long"
_RUN = "key string, source string, n long, df long, term_n long, lead boolean, open boolean"


def term_blocks(docs: DataFrame) -> DataFrame:
    """(key, source, doc, df, n) of (lang, source, text): counts within blocks of documents; ``doc`` is a block's first, ``key`` its lang and term."""
    names = ["key", "source", "doc", "df", "n"]

    def added(parts: list[pa.Table]) -> pa.Table:
        grouped = pa.concat_tables(parts).group_by(["key", "source"], use_threads=False)
        return grouped.aggregate([("doc", "min"), ("df", "sum"), ("n", "sum")]).select(["key", "source", "doc_min", "df_sum", "n_sum"]).rename_columns(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            ids, lang, source, column = batch.columns
            for low, high in slices(column, BLOCK_BYTES):
                distinct, row, code, count = terms(column.slice(low, high - low), LETTERS)
                own = pa.table([lang.slice(low, high - low), source.slice(low, high - low)], names=["lang", "source"])
                groups = own.group_by(["lang", "source"], use_threads=False).aggregate([])
                which = own.append_column("at", pa.array(np.arange(high - low))).join(groups.append_column("group", pa.array(np.arange(len(groups)))), ["lang", "source"], use_threads=False).sort_by("at")["group"].to_numpy()
                key = which[row] * max(len(distinct), 1) + code
                order = np.argsort(key, kind="stable")  # rows ascend within a key
                key, cut = key[order], np.flatnonzero(np.diff(key[order], prepend=-1))
                if not len(cut):
                    continue
                at, of = pa.array(key[cut] // max(len(distinct), 1)), pa.array(key[cut] % max(len(distinct), 1))
                first, docs_of, times = row[order][cut], np.diff(cut, append=len(key)), np.add.reduceat(count[order], cut)
                keys = pc.binary_join_element_wise(groups["lang"].combine_chunks().take(at), distinct.take(of), MARK)
                held.append(pa.table([keys, groups["source"].combine_chunks().take(at), ids.take(pa.array(first + low)), pa.array(docs_of), pa.array(times)], names=names))
                rows += len(cut)
                if rows >= HELD:
                    whole = added(held)
                    held, rows = [whole], len(whole)
                    if rows >= HELD // 2:
                        yield from whole.combine_chunks().to_batches(max_chunksize=50_000)
                        held, rows = [], 0
        if held:
            yield from added(held).combine_chunks().to_batches(max_chunksize=50_000)

    return docs.select(F.monotonically_increasing_id().alias("doc"), "lang", "source", "text").mapInArrow(run, _BLOCK)


def _changes(table: pa.Table, columns: list[str]) -> np.ndarray:
    """Where a row differs from the one before in any of the columns; the first row does."""
    out = np.ones(len(table), bool)
    if len(table) > 1:
        differs = np.zeros(len(table) - 1, bool)
        for c in columns:
            x = table[c].combine_chunks()
            differs |= pc.not_equal(x.slice(1), x.slice(0, len(x) - 1)).to_numpy(zero_copy_only=False)
        out[1:] = differs
    return out


def scan_runs(least: int):
    """A pass over rows sorted by (key, source, doc): one row for each run (key, source) of a term in ``least`` documents.

    A term whose rows reach an end of the range is ``open``: its other rows may
    be in the next range.  What is carried on is one term's runs.
    """

    def folded(table: pa.Table) -> pa.Table:
        cut = np.flatnonzero(_changes(table, ["key", "source"]))
        sums = [pa.array(np.add.reduceat(table[c].to_numpy(), cut)) for c in ("n", "df")]
        return pa.table([table[c].take(pa.array(cut)) for c in ("key", "source")] + sums, names=["key", "source", "n", "df"])

    def closed(runs: pa.Table, first_open: bool, last_open: bool) -> pa.RecordBatch | None:
        lead = _changes(runs, ["key"])
        term = np.cumsum(lead) - 1
        cut = np.flatnonzero(lead)
        df, n = (np.add.reduceat(runs[c].to_numpy(), cut)[term] for c in ("df", "n"))
        is_open = ((term == 0) & first_open) | ((term == term[-1]) & last_open)
        kept = np.flatnonzero(is_open | (df >= least))
        out = runs.append_column("term_n", pa.array(n)).append_column("lead", pa.array(lead)).append_column("open", pa.array(is_open)).take(pa.array(kept))
        return out.combine_chunks().to_batches()[0] if len(out) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried, first = None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch]).select(["key", "source", "n", "df"])
            runs = folded(table if carried is None else pa.concat_tables([carried, table]))
            last = np.flatnonzero(_changes(runs, ["key"]))[-1]
            carried = runs.slice(last)
            if last:
                out = closed(runs.slice(0, last), first, False)
                first = False
                if out is not None:
                    yield out
        if carried is not None:
            yield closed(carried, first, True)

    return run


def term_runs(docs: DataFrame, least: int) -> DataFrame:
    """(lang, term, source, n, term_n, lead) of every term in ``least`` documents of its language at least; ``lead`` marks one row of a term."""
    order = ["key", "source", "doc"]
    blocks = staged(term_blocks(docs))
    runs = staged(blocks.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(scan_runs(least), _RUN))
    term = Window.partitionBy("key")
    rest = runs.where("open").groupBy("key", "source").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    rest = rest.select(
        "key", "source", "n", F.sum("df").over(term).alias("df"), F.sum("n").over(term).alias("term_n"), (F.col("source") == F.min("source").over(term)).alias("lead")
    ).where(F.col("df") >= least)
    columns = ["key", "source", "n", "term_n", "lead"]
    both = runs.where("NOT open").select(*columns).unionByName(rest.select(*columns)).withColumn("term", F.substring_index("key", MARK, -1))
    return both.select(F.left("key", F.length("key") - F.length("term") - 1).alias("lang"), "term", *columns[1:])


def share(count: str, total: str) -> str:
    """1 + floor(10**9 count / total) for count <= total < 9 * 10**15, three digits at a time."""
    first = f"{count} div {total}"
    rest = f"({count} % {total})"
    out = f"1 + {SCALE} * ({first})"
    for power in (10**6, 10**3, 1):
        out += f" + {power} * (({rest} * 1000) div {total})"
        rest = f"(({rest} * 1000) % {total})"
    return out


def excess(p: str, q: str) -> str:
    return f"(({p}) - ({q})) * (({p}) - ({q})) div ({q})"


def scan_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A pass over rows sorted by (lang, term): for each ordered pair of sources that share terms, how much these change the pair's sum.

    Both absent stands for each term at first; a source's own terms are added
    for all its partners elsewhere.  So a shared term adds f(p, p') - f(p, z')
    - f(z, p') + f(z, z').
    """
    carried = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if carried is None else pa.concat_tables([carried, table])
        last = np.flatnonzero(_changes(table, ["lang", "term"]))[-1]
        carried = table.slice(last)
        yield from _pairs(table.slice(0, last))
    if carried is not None:
        yield from _pairs(carried)


def _pairs(table: pa.Table) -> Iterator[pa.RecordBatch]:
    if len(table) < 2:
        return
    run = np.cumsum(_changes(table, ["lang", "term"]))
    names = table.group_by(["lang", "source"], use_threads=False).aggregate([])
    at = table.select(["lang", "source"]).append_column("i", pa.array(np.arange(len(table)))).join(names.append_column("name", pa.array(np.arange(len(names)))), ["lang", "source"], use_threads=False).sort_by("i")["name"].to_numpy()
    p, z = (table[c].to_numpy() for c in ("p", "z"))
    f = lambda a, b: (a - b) * (a - b) // b
    keys, sums = [], []
    for d in range(1, int(np.bincount(run).max())):
        i = np.flatnonzero(run[d:] == run[:-d])
        for x, y in ((i, i + d), (i + d, i)):
            key, inverse = np.unique(at[x] * len(names) + at[y], return_inverse=True)
            total = np.zeros(len(key), np.int64)
            np.add.at(total, inverse, f(p[x], p[y]) - f(p[x], z[y]) - f(z[x], p[y]) + f(z[x], z[y]))
            keys.append(key)
            sums.append(total)
    if keys:
        key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(key), np.int64)
        np.add.at(total, inverse, np.concatenate(sums))
        a, b = pa.array(key // len(names)), pa.array(key % len(names))
        out = pa.table([names["lang"].take(a), names["source"].take(a), names["source"].take(b), pa.array(total)], names=["lang", "source", "item", "value"])
        yield from out.combine_chunks().to_batches()


def audit_sources(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", least: int = 3, top: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank): how far sources of a language are apart, and by which terms.

    A language keeps the V terms in ``least`` of its documents.  In a group of
    count c of N, a kept term has p = 1 + floor(10**9 (c + 1) / (N + V)).  Part
    ``pair``: for each other source of the language, the sum over kept terms of
    floor((p - q)**2 / q), q the other's p.  Part ``term``: the ``top`` terms
    of the source with p above the language's q, by the same value.  All in
    whole numbers of 64 bits, exact while N + V < 9 * 10**15.

    Cases: null text, lang and source are empty strings; a group without terms
    has count 0 everywhere; a language without kept terms has pairs of value 0;
    a language of one source has no pairs; repeated rows are documents of
    their own; ties go by the item's bytes; a very long text is one task's
    memory; an empty table gives no rows; other columns are ignored.
    """
    blank = lambda c: F.coalesce(named(c).cast("string"), F.lit(""))
    rows = docs.select(blank(lang).alias("lang"), blank(source).alias("source"), blank(text).alias("text"))
    small_batches(docs.sparkSession)
    runs = term_runs(rows, least)
    own = runs.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("held"), F.count_if("lead").alias("leads"))
    of_lang = Window.partitionBy("lang")
    known = rows.select("lang", "source").distinct().join(own, ["lang", "source"], "left").na.fill(0, ["n", "held", "leads"])
    groups = staged(
        known.select("lang", "source", "held", F.sum("leads").over(of_lang).alias("v"), F.col("n").alias("own_n"), F.sum("n").over(of_lang).alias("lang_n"))
        .selectExpr("lang", "source", "held", "v", "own_n + v AS own_total", "lang_n + v AS lang_total")
        .selectExpr("*", f"CASE WHEN v > 0 THEN {share('1', 'own_total')} END AS z")
    )
    placed = runs.join(groups, ["lang", "source"]).selectExpr(
        "lang", "term", "source", "z", f"{share('(n + 1)', 'own_total')} AS p", f"{share('(term_n + 1)', 'lang_total')} AS q"
    )
    placed = staged(placed)
    other = groups.select("lang", F.col("source").alias("item"), F.col("z").alias("z_item"), F.col("held").alias("held_item"))
    apart = F.col("source") != F.col("item")
    shared = placed.select("lang", "term", "source", "p", "z").repartition("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(scan_pairs, "lang string, source string, item string, value long")
    absent = groups.join(other, "lang").where(apart).selectExpr("lang", "source", "item", f"CASE WHEN v > 0 THEN (v - held - held_item) * ({excess('z', 'z_item')}) ELSE 0 END AS value")
    steps = placed.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("times"))
    alone = steps.join(other, "lang").where(apart)
    mine = alone.selectExpr("lang", "source", "item", f"times * ({excess('p', 'z_item')}) AS value")
    theirs = alone.selectExpr("lang", "item AS source", "source AS item", f"times * ({excess('z_item', 'p')}) AS value")
    pairs = shared.unionByName(absent).unionByName(mine).unionByName(theirs).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    columns = ["lang", "source", "part", "item", "value", "rank"]
    pairs = pairs.select("*", F.lit("pair").alias("part"), F.row_number().over(order).alias("rank")).select(*columns)
    above = placed.where("p > q").selectExpr("lang", "source", "'term' AS part", "term AS item", f"{excess('p', 'q')} AS value")
    return pairs.unionByName(above.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select(*columns))


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT row) AS df FROM w GROUP BY ALL),
k AS (SELECT lang, term, sum(n)::BIGINT AS n FROM c GROUP BY ALL HAVING sum(df) >= 3),
v AS (SELECT lang, count(*) AS v, sum(n)::BIGINT AS n FROM k GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
h AS (SELECT g.lang, g.source, coalesce(v.v, 0) AS v, coalesce((SELECT sum(c.n) FROM c JOIN k ON c.lang = k.lang AND c.term = k.term WHERE c.lang = g.lang AND c.source = g.source), 0)::BIGINT AS n FROM g LEFT JOIN v ON v.lang = g.lang),
p AS (SELECT h.lang, h.source, k.term, coalesce(c.n, 0) AS c, 1 + (1000000000 * (coalesce(c.n, 0) + 1)) // (h.n + h.v) AS p, 1 + (1000000000 * (k.n + 1)) // (v.n + v.v) AS q
      FROM h JOIN k ON k.lang = h.lang JOIN v ON v.lang = h.lang LEFT JOIN c ON c.lang = h.lang AND c.source = h.source AND c.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p)::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
      UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // q FROM p WHERE c > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM o)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= 200
"""
