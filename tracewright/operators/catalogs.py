"""Signature catalogs that are tables of rules.

Each rule's expression is looked at once for literals of which a match must
hold one.  A pass over the messages finds all rules' literals with one automaton,
so a message meets only the expressions that it may match, however many rules
there are; Spark's own engine then decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..sources.shared import written

#: Rules that workers hold in one pass, at most.  A longer catalog takes several passes over the messages.
RULES = 100_000
#: Messages that go to a worker at once.
BATCH_ROWS = 500
#: Characters of a literal that is worth looking for.
LITERAL = 3

_RULE = "array<struct<detector string, bucket string, priority int, nth int, pattern string>>"


def folded(text: str) -> str:
    """Lower case, a character for a character, so that whatever compares equal in any case is equal."""
    if text.isascii():
        return text.lower()
    return "".join(_fold(c) for c in text)


def _fold(c: str) -> str:
    upper = c.upper()
    lower = (upper if len(upper) == 1 else c).lower()
    return lower[0]


def required(pattern: str) -> frozenset[str] | None:
    """Folded literals of which every match of an expression holds one; None where no such set is seen.

    Only what is plain is taken: runs of characters and escaped signs that must
    stand in a match as they are.  Classes, counted and optional parts end a run;
    groups give their own literals if each alternative has one; what looks ahead or behind gives none.
    """
    found, at = _alternatives(pattern, 0)
    return found if at == len(pattern) else None


def _alternatives(p: str, i: int) -> tuple[frozenset[str] | None, int]:
    sets: list[frozenset[str] | None] = []
    while True:
        found, i = _sequence(p, i)
        sets.append(found)
        if i < len(p) and p[i] == "|":
            i += 1
        else:
            break
    return (None if any(s is None for s in sets) else frozenset().union(*sets)), i


def _sequence(p: str, i: int) -> tuple[frozenset[str] | None, int]:
    best: frozenset[str] | None = None
    run = ""

    def better(a: frozenset[str] | None, b: frozenset[str] | None) -> frozenset[str] | None:
        if a is None or b is None:
            return a or b
        return max(a, b, key=lambda s: (min(map(len, s)), -len(s)))

    def close() -> None:
        nonlocal best, run
        if len(run) >= LITERAL:
            best = better(best, frozenset([folded(run)]))
        run = ""

    while i < len(p) and p[i] not in "|)":
        start, c, group = i, p[i], None
        literal = None
        if c == "(":
            plain = not p.startswith("(?", i) or p.startswith("(?:", i)
            flags = _flags(p, i)
            if flags:
                if "x" in p[i:flags]:
                    return None, len(p) + 1  # comments and blanks mean something else
                i = flags
                close()
                continue
            i += 3 if p.startswith("(?:", i) else 1
            if not plain:
                i = _skip_group(p, i)
            else:
                group, i = _alternatives(p, i)
                if i >= len(p):
                    return None, len(p) + 1
                i += 1
        elif c == "[":
            i = _skip_class(p, i)
        elif c == "\\":
            if i + 1 < len(p) and not p[i + 1].isalnum():
                literal = p[i + 1]
                i += 2
            else:
                i += 2
                if p[i - 1 : i] in ("p", "P", "x", "u", "k", "c", "Q", "E", "0", "N"):
                    return None, len(p) + 1  # longer escapes
        elif c in ".^$":
            i += 1
        elif c in "*+?{":
            return None, len(p) + 1
        else:
            literal = c
            i += 1
        least, i = _quantifier(p, i)
        if i > len(p) or start == i:
            return None, len(p) + 1
        if literal is not None and least == (1, 1):
            run += literal
        else:
            if literal is not None and least[0] == 1:
                run += literal  # once at least; then the run ends
            close()
            if group is not None and least[0] >= 1:
                best = better(best, group)
    close()
    return best, i


def _flags(p: str, i: int) -> int:
    """Where a group of flags alone, as (?i), ends; 0 if it is none."""
    j = i + 2
    if not p.startswith("(?", i):
        return 0
    while j < len(p) and p[j] in "idmsuxU-":
        j += 1
    return j + 1 if j > i + 2 and j < len(p) and p[j] == ")" else 0


def _skip_group(p: str, i: int) -> int:
    """Past the bracket that closes a group whose inside does not matter."""
    depth = 1
    while i < len(p) and depth:
        if p[i] == "\\":
            i += 2
            continue
        if p[i] == "[":
            i = _skip_class(p, i)
            continue
        depth += {"(": 1, ")": -1}.get(p[i], 0)
        i += 1
    return i if not depth else len(p) + 1


def _skip_class(p: str, i: int) -> int:
    i += 2 if p.startswith("[^", i) else 1
    first = True
    while i < len(p) and (p[i] != "]" or first):
        first = False
        if p[i] == "[":
            i = _skip_class(p, i)
        else:
            i += 2 if p[i] == "\\" else 1
    return i + 1


def _quantifier(p: str, i: int) -> tuple[tuple[int, int], int]:
    """How often the part before may stand, at least and at most (2 for more), and where that ends."""
    if i < len(p) and p[i] in "*+?":
        least = {"*": (0, 2), "+": (1, 2), "?": (0, 1)}[p[i]]
        i += 1
    elif i < len(p) and p[i] == "{":
        end = p.find("}", i)
        if end < 0:
            return (0, 2), len(p) + 1
        low, _, high = p[i + 1 : end].partition(",")
        least = (min(int(low or 0), 1), 1 if p[i + 1 : end] == "1" else 2)
        i = end + 1
    else:
        return (1, 1), i
    if i < len(p) and p[i] in "?+":
        i += 1
    return least, i


_KINDS = {"detector": pa.string(), "bucket": pa.string(), "priority": pa.int32(), "nth": pa.int32(), "pattern": pa.string()}


@F.arrow_udf(T.ArrayType(T.StringType()))
def _literals(patterns: pa.Array) -> pa.Array:
    """``required`` of each expression, an empty list where it is None."""
    return pa.array([sorted(required(p) or ()) for p in patterns.to_pylist()], pa.list_(pa.string()))


def _candidates(part: pa.Table):
    """A vectorised function (text, role) -> the rules whose role it is and whose literals the text holds, by detector and priority.

    A worker holds the rules as Arrow arrays and one automaton of numbers, no objects for each rule.
    """

    @F.arrow_udf(_RULE)
    def candidates(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        import ahocorasick

        rules = part.combine_chunks()
        whole = lambda name: rules.column(name).chunk(0)
        roles_of, literals = whole("role").dictionary_encode(), whole("literals")
        role_no, role_code = {r: k for k, r in enumerate(roles_of.dictionary.to_pylist())}, roles_of.indices.to_numpy()
        owner = literals.value_parent_indices().to_numpy()
        always = np.setdiff1d(np.arange(len(rules)), owner)
        # rules of one literal stand together: first[k] to first[k + 1] of ``owned``
        coded = literals.flatten().dictionary_encode()
        code = coded.indices.to_numpy()
        owned = owner[np.argsort(code, kind="stable")]
        first = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(coded.dictionary)))])
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, literal in enumerate(coded.dictionary):
            automaton.add_word(literal.as_py(), k)
        if len(code):
            automaton.make_automaton()
        listed = pa.StructArray.from_arrays([whole(c) for c in _KINDS], names=list(_KINDS))
        none = np.zeros(0, np.int64)
        for texts, roles in batches:
            ends, chosen = [0], [none]
            for text, role in zip(texts.to_pylist(), roles.to_pylist(), strict=True):
                met = none
                if text is not None and role in role_no:
                    seen = {k for _, k in automaton.iter(folded(text))} if len(code) else ()
                    met = np.unique(np.concatenate([always, *(owned[first[k] : first[k + 1]] for k in seen)]))  # rules stand by detector and priority
                    met = met[role_code[met] == role_no[role]]
                chosen.append(met)
                ends.append(ends[-1] + len(met))
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), listed.take(pa.array(np.concatenate(chosen), pa.int64())))

    return candidates


def detect_by_table(messages: DataFrame, catalog: DataFrame, flags: str = "(?dU)") -> DataFrame:
    """As ``signatures.detect``, with the catalog as a table (detector, bucket, priority, pattern, role).

    Of a detector's rules that a message fits, the one of least priority gives
    the row, of equal ones the least pattern.  A catalog beyond RULES is taken in
    parts, one pass over the messages for each; the parts may cut a detector, whose
    rows then come from the first part that a message fits.  So what a worker holds
    is bounded, whatever the catalog.  Rules with a null pattern, role or detector
    fit nothing; an expression that is none is an error once a message meets it.
    """
    _small_batches(messages.sparkSession)
    columns, parts = messages.columns, _parts(catalog)
    part, more = next(parts, None), next(parts, None)
    if part is None:
        none = F.lit(None).cast("string")
        return messages.where(F.lit(False)).select(*columns, none.alias("detector"), none.alias("bucket"), none.alias("snippet"))
    if more is None:
        return _fitting(messages, part, flags)
    numbered = written(messages.withColumn("_message", F.monotonically_increasing_id()))
    found = None
    for k, each in enumerate(chain((part, more), parts)):
        told = _fitting(numbered, each, flags).withColumn("_part", F.lit(k))
        found = told if found is None else found.unionByName(told)
    first = found.withColumn("_first", F.min("_part").over(Window.partitionBy("_message", "detector"))).where("_part = _first")
    return first.select(*columns, "detector", "bucket", "snippet")


def _fitting(messages: DataFrame, part: pa.Table, flags: str) -> DataFrame:
    """One pass: the messages with the first rule of each detector in a part that they fit."""
    hits = F.filter(_candidates(part)(F.col("text"), F.col("role")), lambda r: F.regexp_like(F.col("text"), F.concat(F.lit(flags), r["pattern"])))
    rows = messages.withColumn("_hits", hits).where(F.size("_hits") > 0)
    first = F.filter("_hits", lambda r, i: (i == 0) | (F.element_at("_hits", F.greatest(i, F.lit(1)))["detector"] != r["detector"]))
    each = rows.select(*messages.columns, F.explode(first).alias("_hit"))
    return each.select(*messages.columns, F.col("_hit.detector").alias("detector"), F.col("_hit.bucket").alias("bucket"), X.snippet(F.col("text"), F.concat(F.lit(flags), F.col("_hit.pattern"))).alias("snippet"))


def _small_batches(spark: SparkSession) -> None:
    """A batch holds all rules that its messages may fit, so batches are of BATCH_ROWS messages at most."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = int(spark.conf.get(key))
    if rows <= 0 or rows > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def _parts(catalog: DataFrame) -> Iterator[pa.Table]:
    """The rules with their literals, RULES at a time: (detector, bucket, priority, nth, pattern, role, literals)."""
    rows = catalog.where("detector IS NOT NULL AND pattern IS NOT NULL AND role IS NOT NULL").select("detector", "bucket", F.col("priority").cast("int"), "pattern", "role", _literals("pattern").alias("literals")).orderBy("detector", "priority", "pattern")
    schema = pa.schema([*_KINDS.items(), ("role", pa.string()), ("literals", pa.list_(pa.string()))])
    each = (r.asDict() for r in rows.toLocalIterator())
    while part := list(islice(each, RULES)):
        yield pa.Table.from_pylist([r | {"nth": k} for k, r in enumerate(part)], schema)
