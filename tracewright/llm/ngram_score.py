"""Language-model scoring with a weighted backoff automaton of order three.

States are the root, the start of a text, every word and every pair of words
of the training texts.  For a state ``h`` of count c(h) and the state ``h'``
that is one word shorter, an arc ``h -w->`` for every ``hw`` seen in training
weighs

    log10(L(h) * c(h w) / c(h) + (1 - L(h)) * P(w | h')),

and a failure arc from ``h`` to ``h'`` weighs log10(1 - L(h)).  The root has an
arc for every word, P(w) = c(w) / (N + V), and one for all unseen words,
V / (N + V): one event for each of V tokens and one for the unseen, so every
state's probabilities sum to 1.  L(h) is fitted for each order and each power
of two of c(h): one less the part of the tokens after such states that
continue them in a way seen once.  A text is read once from left to right:
from the state it is in, failure arcs are followed until an arc bears the next
word, and that arc leads to the next state.

Counts cover all training texts and never meet in one place.  Each input
partition is packed into blocks of about BLOCK_BYTES of text.  A block asks
for its distinct words, then pairs, then triples, with its own counts, sorted
by hash and packed: FAN messages, one for each equal part of the hash space.
Counting nodes merge the messages of up to FAN askers and ask on for their
own range's FAN parts, until one node owns a range of the whole corpus; the
answers go back the same way.  So a block sends and gets FAN messages however
many blocks there are, a node holds about a block's worth, and there are
log(blocks) / log(FAN) levels.  Answers also tell whether any other block has
the n-gram; a longer one with a part that no other block has needs no asking.
With its answers a block builds the part of the automaton that it walks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import NON_SPACE, Words, mix, slices, utf8
from .staging import named, repeatable, small_batches

#: Text of a block, in bytes; one longer text is a block of its own.
BLOCK_BYTES = 8 << 20
#: Parts of the hash space in which an asker asks, and askers of a counting node; a power of two.
FAN_BITS = 7
#: Tokens of a text that one lane of the traversal walks; the next lane begins in the state that they lead to.
LANE = 256
#: Hashes of the end token and of the start state.
END, START = np.uint64(0xE0D0E0D0E0D0E0D1), np.uint64(0x57A2757A2757A275)
#: Bits of a pair's or triple's key that are kept: the lowest byte would be an eighth of what is sent.  Of 1e12 keys, 7e6 then meet another.
LONG = np.uint64(0xFFFFFFFFFFFFFF00)
LEVELS = 40
#: Counts, whether others ask too, and the level of the context's count.
KINDS = (np.uint64, np.uint8, np.uint8)

ASKED = "node bigint, child bigint, part int, packed binary, stats array<bigint>"
TOLD = "child bigint, part int, packed binary, totals array<bigint>"


class Tokens:
    """The tokens of a block: words and one end for each text; pairs and triples of them with what stands before."""

    def __init__(self, rows: pa.Table):
        text = rows.column("text").combine_chunks()
        if isinstance(text, pa.ChunkedArray):
            text = text.chunk(0) if text.num_chunks else pa.array([], pa.string())
        hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for low, high in slices(text):
            words = Words(*utf8(text.slice(low, high - low)), NON_SPACE, lower=True)
            at = np.arange(len(words)) + words.doc
            out = np.full(len(words) + high - low, END, np.uint64)
            out[at] = words.hash()
            hashes.append(out)
            counts.append(words.count + 1)
        self.hash, self.count = np.concatenate(hashes), np.concatenate(counts)
        self.first = np.concatenate([[0], np.cumsum(self.count)])
        self.train = np.repeat(np.asarray(rows.column("train").to_pylist(), bool), self.count)
        self.starts = np.zeros(len(self.hash), bool)
        self.starts[self.first[:-1]] = True
        self.words, self.word = np.unique(self.hash, return_inverse=True)
        self.word_count = self._own(self.word, len(self.words))

    def _own(self, which: np.ndarray, n: int, at: np.ndarray | None = None) -> np.ndarray:
        train = self.train if at is None else self.train[at]
        return np.bincount(which[train], minlength=n)

    def find_pairs(self) -> None:
        """pairs, pair (at each token), pair_at (a token of each), pair_count."""
        old = np.empty_like(self.hash)
        old[1:] = self.hash[:-1]
        old[self.starts] = START
        self.pairs, self.pair_at, self.pair = np.unique(mix(old * np.uint64(0x9FB21C651E98DF25) + self.hash) & LONG, return_index=True, return_inverse=True)
        self.pair_count = self._own(self.pair, len(self.pairs))

    def find_triples(self) -> None:
        """inner (tokens with a pair before them), triples, triple (at each of inner), triple_at (a token of each), triple_count."""
        self.inner = np.flatnonzero(~self.starts)
        keys = mix(self.pairs[self.pair[self.inner - 1]] * np.uint64(0xD6E8FEB86659FD93) + self.hash[self.inner]) & LONG
        self.triples, at, self.triple = np.unique(keys, return_index=True, return_inverse=True)
        self.triple_at = self.inner[at]
        self.triple_count = self._own(self.triple, len(self.triples), self.inner)

    def before(self, of_words: np.ndarray, at: np.ndarray) -> np.ndarray:
        """A value of the word before each token ``at``; the start has that of the end."""
        return np.where(self.starts[at], of_words[np.searchsorted(self.words, END)], of_words[self.word[at - 1]])


def pack(hashes: np.ndarray, *columns: np.ndarray) -> bytes:
    """Sorted hashes as differences, and columns, in byte planes, compressed."""
    steps = np.diff(hashes, prepend=np.uint64(0))
    return _planes(len(hashes), steps, *columns)


def _planes(n: int, *columns: np.ndarray) -> bytes:
    raw = b"".join(np.ascontiguousarray(x.view(np.uint8).reshape(n, x.itemsize).T).tobytes() for x in columns)
    return n.to_bytes(8, "little") + len(raw).to_bytes(8, "little") + (pa.compress(raw, "zstd", asbytes=True) if raw else b"")


def _columns(data: bytes, *kinds) -> list[np.ndarray]:
    n, size = int.from_bytes(data[:8], "little"), int.from_bytes(data[8:16], "little")
    raw = np.frombuffer(pa.decompress(data[16:], size, "zstd", asbytes=True) if size else b"", np.uint8)
    out, at = [], 0
    for kind in kinds:
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(raw[at : at + n * width].reshape(width, n).T).reshape(-1).view(kind))
        at += n * width
    return out


def unpack(data: bytes) -> list[np.ndarray]:
    steps, *rest = _columns(data, np.uint64, *KINDS)
    return [np.cumsum(steps, dtype=np.uint64), *rest]


# A counting node of level k >= 1 is (group, range): the askers whose group it is, and one of
# FAN ** k equal parts of the hash space; as a number, group * FAN ** k + range.


def _ask(child: int, group: int, level: int, owned: int, hashes: np.ndarray, columns: tuple, stats: list[int], bits: int) -> pa.Table:
    """Messages to the FAN nodes of ``level`` and ``group`` that share the range ``owned`` of the level below."""
    fan = 1 << bits
    first = owned << bits
    edges = np.array([(first + i) << (64 - bits * level) for i in range(fan)], np.uint64)
    at = np.concatenate([np.searchsorted(hashes, edges), [len(hashes)]])
    packed = [pack(hashes[a:b], *(c[a:b].astype(k) for c, k in zip(columns, KINDS, strict=True))) for a, b in zip(at[:-1], at[1:], strict=True)]
    node = (group << (bits * level)) + first
    return pa.table({
        "node": pa.array([node + i for i in range(fan)], pa.int64()), "child": pa.array([child] * fan, pa.int64()), "part": pa.array(range(fan), pa.int32()),
        "packed": pa.array(packed, pa.binary()), "stats": pa.array([stats] + [[]] * (fan - 1), pa.list_(pa.int64())),
    })


class Merged:
    """The messages to one node, merged: distinct hashes, summed counts, whether several askers have them, levels."""

    def __init__(self, rows: pa.Table):
        parts = [unpack(x) for x in rows.column("packed").to_pylist()]
        self.sizes = [len(p[0]) for p in parts]
        self.hashes, first, self.where, askers = np.unique(np.concatenate([p[0] for p in parts]), return_index=True, return_inverse=True, return_counts=True)
        sums = np.zeros(len(self.hashes), np.uint64)
        np.add.at(sums, self.where, np.concatenate([p[1] for p in parts]))
        shared = np.bincount(self.where, weights=np.concatenate([p[2] for p in parts]), minlength=len(self.hashes)) > 0
        self.counts, self.shared, self.levels = sums, shared | (askers > 1), np.concatenate([p[3] for p in parts])[first]
        told = [s for s in rows.column("stats").to_pylist() if s]
        self.stats = np.sum(told, axis=0).tolist() if told else []

    def answers(self, rows: pa.Table, values: np.ndarray, totals: list[int]) -> pa.Table:
        """Each asker's hashes answered in its own order."""
        ends = np.cumsum(self.sizes)
        packed = [_planes(n, values[self.where[e - n : e]]) for n, e in zip(self.sizes, ends.tolist(), strict=True)]
        return pa.table({"child": rows.column("child"), "part": rows.column("part"), "packed": pa.array(packed, pa.binary()), "totals": pa.array([totals] * rows.num_rows, pa.list_(pa.int64()))})


def _answered(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """An asker's values in its own order, and the totals over the parts."""
    packed = rows.column("packed").to_pylist()
    out = [_columns(packed[i], np.uint64)[0] for i in np.argsort(rows.column("part").to_numpy(), kind="stable").tolist()]
    return np.concatenate(out), np.array(rows.column("totals").to_pylist(), np.int64).sum(axis=0)


def corpus_counts(asked: DataFrame, levels: int, totals, bits: int = FAN_BITS) -> DataFrame:
    """Messages of askers -> their answers: counts over all askers, twice, plus 1 where another asker has the hash too.

    ``totals(counts, levels, stats)`` gives the sums of a top node's range.
    """
    fan_out = [asked]

    def merge(level: int):
        def run(rows: pa.Table) -> pa.Table:
            node, m = rows.column("node")[0].as_py(), Merged(rows)
            group, owned = node >> (bits * level), node & ((1 << (bits * level)) - 1)
            return _ask(node, group >> bits, level + 1, owned, m.hashes, (m.counts, m.shared, m.levels), m.stats, bits)

        return run

    def top(rows: pa.Table) -> pa.Table:
        m = Merged(rows)
        return m.answers(rows, m.counts * np.uint64(2) + m.shared, [int(x) for x in totals(m.counts, m.levels, m.stats)])

    def down(rows: pa.Table, told: pa.Table) -> pa.Table:
        values, sums = _answered(told)
        return Merged(rows).answers(rows, values, sums.tolist())

    for level in range(1, levels):
        fan_out.append(fan_out[-1].groupBy("node").applyInArrow(merge(level), ASKED))
    told = fan_out[-1].groupBy("node").applyInArrow(top, TOLD)
    for level in range(levels - 1, 0, -1):
        told = fan_out[level - 1].groupBy("node").cogroup(told.groupBy("child")).applyInArrow(down, TOLD)
    return told


def level_of(count: np.ndarray) -> np.ndarray:
    """The power of two of a count, 0 for none."""
    return np.minimum(np.ceil(np.log2(count + 1.0)), LEVELS - 1).astype(np.uint8)


def word_totals(counts, _, __) -> list[int]:
    return [counts.sum(), (counts > 0).sum()]


def _by_level(counts: np.ndarray, levels: np.ndarray) -> list[int]:
    """Tokens that continue a context in a way seen once, then all tokens, for each level of the context's count."""
    once = np.bincount(levels[counts == 1], minlength=LEVELS)
    return [*once.tolist(), *np.bincount(levels, weights=counts, minlength=LEVELS).astype(np.int64).tolist()]


def level_totals(counts, levels, stats) -> list[int]:
    own = _by_level(counts, levels)
    return [a + b for a, b in zip(own, stats, strict=True)] if stats else own


class Known:
    """A block's tokens and what it has been told so far: kinds 0 words, 1 pairs, 2 triples."""

    def __init__(self, rows: pa.Table, answers: pa.Table, order: int):
        self.block = rows.column("block")[0].as_py()
        self.rows = unpack_rows(rows.column("packed")[0].as_py())
        self.t = t = Tokens(self.rows)
        kind = np.asarray(answers.column("kind").to_numpy())
        of = lambda k: _answered(answers.filter(pa.array(kind == k)))
        told, (self.n, self.v) = of(0)
        self.word_count, self.word_shared = (told >> np.uint64(1)).astype(np.int64), (told & np.uint64(1)).astype(bool)
        t.find_pairs()
        self.pair_context = t.before(self.word_count, t.pair_at)
        self.pair_open = t.before(self.word_shared, t.pair_at) & self.word_shared[t.word[t.pair_at]]
        if order < 2:
            return
        self.pair_count, self.pair_shared, self.pair_stay = self._filled(of(1), self.pair_open, t.pair_count)
        t.find_triples()
        before = t.pair[t.triple_at - 1]
        self.triple_context = self.pair_count[before]
        self.triple_open = self.pair_shared[before] & self.pair_shared[t.pair[t.triple_at]]
        if order > 2:
            self.triple_count, _, self.triple_stay = self._filled(of(2), self.triple_open, t.triple_count)

    @staticmethod
    def _filled(answer: tuple, asked: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts and sharing of all n-grams, the asked ones as told and the others as counted here; L by level."""
        told, totals = answer
        counts, shared = own.astype(np.int64), np.zeros(len(own), bool)
        counts[asked], shared[asked] = (told >> np.uint64(1)).astype(np.int64), (told & np.uint64(1)).astype(bool)
        once, tokens = totals[:LEVELS], totals[LEVELS:]
        return counts, shared, np.clip(1.0 - once / np.maximum(tokens, 1), 0.0, 1.0 - 1e-6) * (tokens > 0)

    def asks(self, groups: int, bits: int = FAN_BITS) -> pa.Table:
        """Messages for the pairs or triples of which all parts are known elsewhere too; the others' statistics."""
        t = self.t
        if hasattr(self, "triple_open"):
            keys, own, context, is_open = t.triples, t.triple_count, self.triple_context, self.triple_open
        else:
            keys, own, context, is_open = t.pairs, t.pair_count, self.pair_context, self.pair_open
        levels = level_of(context)
        stats = _by_level(own[~is_open], levels[~is_open])
        return _ask(self.block, group_of(self.block, groups), 1, 0, keys[is_open], (own[is_open], np.zeros(int(is_open.sum())), levels[is_open]), stats, bits)


class Automaton:
    """The states and arcs that a block's texts walk.

    State 0 is the root, then come words, the start of a text, and pairs.
    ``arc`` holds state * width + word, sorted, with ``target`` and ``weight``;
    the root's arcs are arrays by word.
    """

    def __init__(self, k: Known):
        t = k.t
        end = int(np.searchsorted(t.words, END)) if len(t.words) else 0
        width = len(t.words)
        known = k.word_count > 0
        self.of_word = np.where(known, np.arange(width) + 1, 0)
        self.start = width + 1
        held = (k.pair_count > 0) & (t.word[t.pair_at] != end)
        self.of_pair = np.where(held, np.cumsum(held) + self.start, self.of_word[t.word[t.pair_at]])
        n = self.start + 1 + int(held.sum())
        root = np.where(known, k.word_count, max(int(k.v), 1)) / max(int(k.n + k.v), 1)
        with np.errstate(divide="ignore"):
            self.root_weight = np.log10(root)
        # words and the start fail to the root, pairs to their last word
        self.fail_to, self.fail_weight = np.zeros(n, np.int64), np.zeros(n)
        stay = np.zeros(self.start + 1)
        context = np.concatenate([[0], k.word_count, [k.word_count[end] if width else 0]])
        stay = np.where(context > 0, k.pair_stay[level_of(context)], 0.0)
        self.fail_weight[: self.start + 1] = np.log10(1.0 - stay)
        pair_stay = k.triple_stay[level_of(k.pair_count)]
        self.fail_to[self.of_pair[held]] = self.of_word[t.word[t.pair_at]][held]
        self.fail_weight[self.of_pair[held]] = np.log10(1.0 - pair_stay[held])
        # arcs of words and of the start
        at = t.pair_at
        source = np.where(t.starts[at], self.start, self.of_word[t.word[at - 1]])
        word = t.word[at]
        low = np.where(source > 0, stay[source], 0.0)
        second = low * k.pair_count / np.maximum(k.pair_context, 1) + (1.0 - low) * root[word]
        seen = k.pair_count > 0
        # arcs of pairs
        at3 = t.triple_at
        inner = t.pair[at3 - 1]
        low3 = pair_stay[inner] * (k.triple_context > 0)
        third = low3 * k.triple_count / np.maximum(k.triple_context, 1) + (1.0 - low3) * second[t.pair[at3]]
        seen3 = k.triple_count > 0
        self.width = width
        keys = np.concatenate([source[seen] * width + word[seen], self.of_pair[inner[seen3]] * width + t.word[at3[seen3]]])
        order = np.argsort(keys)
        self.arc = keys[order]
        self.target = np.concatenate([self.of_pair[seen], self.of_pair[t.pair[at3[seen3]]]])[order]
        self.weight = np.log10(np.concatenate([second[seen], third[seen3]]))[order]

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states and the log-probabilities of reading one word in each state."""
        score, state = np.zeros(len(state)), state.copy()
        out = np.empty_like(state)
        open_ = np.arange(len(state))
        while len(open_):
            at_root = state[open_] == 0
            done = open_[at_root]
            score[done] += self.root_weight[word[done]]
            out[done] = self.of_word[word[done]]
            open_ = open_[~at_root]
            if not len(open_) or not len(self.arc):
                state[open_] = 0
                continue
            key = state[open_] * self.width + word[open_]
            place = np.minimum(np.searchsorted(self.arc, key), len(self.arc) - 1)
            found = self.arc[place] == key
            hit, place = open_[found], place[found]
            score[hit] += self.weight[place]
            out[hit] = self.target[place]
            open_ = open_[~found]
            score[open_] += self.fail_weight[state[open_]]
            state[open_] = self.fail_to[state[open_]]
        return out, score

    def walk(self, t: Tokens, lane: int = LANE) -> np.ndarray:
        """The log-probability of each text, read from left to right; many texts, and parts of long ones, at a time."""
        lanes = -(-t.count // lane)
        text = np.repeat(np.arange(len(t.count)), lanes)
        part = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        begin = t.first[:-1][text] + part * lane
        length = np.minimum(lane, t.first[1:][text] - begin)
        order = np.argsort(-length, kind="stable")
        text, begin, length = text[order], begin[order], length[order]
        state = np.where(t.starts[begin], self.start, self.of_pair[t.pair[begin - 1]])
        score = np.zeros(len(text))
        for s in range(int(length.max()) if len(length) else 0):
            live = int(np.searchsorted(-length, -s, "left"))  # lanes of more than s tokens
            state, gained = self.step(state[:live], t.word[begin[:live] + s])
            score[:live] += gained
        return np.bincount(text, weights=score, minlength=len(t.count))


def group_of(block: int, groups: int) -> int:
    """The first level's group of a block."""
    return int(mix(np.array([block], np.uint64))[0] % np.uint64(groups))


def _packed_blocks(schema: pa.Schema, block_bytes: int):
    """Batches of (doc_id, train, text) -> (block, packed): rows of a partition in blocks, as compressed Arrow streams."""

    def packed(parts: list[pa.RecordBatch], number: int) -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 5))) as out:
            out.write_table(pa.Table.from_batches(parts, schema).combine_chunks())
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "packed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held, size = [], 0
        for batch in batches:
            for low, high in slices(batch.column(2), block_bytes):
                part = batch.slice(low, high - low)
                _, at = utf8(part.column(2))
                if held and size + int(at[-1]) > block_bytes:
                    yield packed(held, number)
                    held, size, number = [], 0, number + 1
                held.append(pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(part.columns, schema, strict=True)], schema=schema))
                size += int(at[-1])
        if held:
            yield packed(held, number)

    return run


def unpack_rows(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(data)).read_all()


def score_texts(docs: DataFrame, *, id: str = "doc_id", text: str = "text", folds: int = 5, held_out: int = 1, block_bytes: int = BLOCK_BYTES, bits: int = FAN_BITS, lane: int = LANE) -> DataFrame:
    """Score every text under a model of the texts outside the held-out fold.

    Returns doc_id, held_out (crc32 of the id's text modulo ``folds`` is
    ``held_out``), n_tokens, n_known, train_tokens, base_score, score.

    Cases: a null or empty text is its end token; a very long text is a block
    of its own, and one task's memory grows with it; a null id folds as the
    empty text; repeated rows count and score each, in whatever blocks they
    are; an empty table gives no rows; with no training text all tokens are
    unseen; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    fold = F.pmod(F.crc32(F.coalesce(named(id).cast("string"), F.lit("")).cast("binary")), F.lit(folds))
    rows = repeatable(docs.select(named(id).alias("doc_id"), (fold != held_out).alias("train"), F.coalesce(named(text).cast("string"), F.lit("")).alias("text")))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    fan = 1 << bits
    groups, levels = max(1, -(-int(total) // (block_bytes * fan))), 1
    while -(-groups // fan ** (levels - 1)) > 1:
        levels += 1
    kind = rows.schema["doc_id"].dataType.simpleString()
    from pyspark.sql.pandas.types import to_arrow_type

    schema = pa.schema([("doc_id", to_arrow_type(rows.schema["doc_id"].dataType)), ("train", pa.bool_()), ("text", pa.large_string())])
    blocks = rows.mapInArrow(_packed_blocks(schema, block_bytes), "block bigint, packed binary")

    def ask_words(r: pa.Table) -> pa.Table:
        block, t = r.column("block")[0].as_py(), Tokens(unpack_rows(r.column("packed")[0].as_py()))
        none = np.zeros(len(t.words))
        return _ask(block, group_of(block, groups), 1, 0, t.words, (t.word_count, none, none), [], bits)

    def ask_longer(order: int):
        return lambda r, a: Known(r, a, order).asks(groups, bits)

    def walked(r: pa.Table, a: pa.Table) -> pa.Table:
        k = Known(r, a, 3)
        t, c = k.t, k.word_count[k.t.word]
        score = Automaton(k).walk(t, lane)
        base = np.log10((c + 0.5) / (k.n + 0.5 * (k.v + 1)))
        sums = lambda x: np.add.reduceat(x, t.first[:-1]) if len(t.count) else x
        return pa.table({
            "doc_id": k.rows.column("doc_id"), "held_out": pa.array([not x for x in k.rows.column("train").to_pylist()], pa.bool_()),
            "n_tokens": pa.array(t.count, pa.int64()), "n_known": pa.array(sums((c > 0).astype(np.int64)), pa.int64()),
            "train_tokens": pa.array(np.full(len(t.count), k.n, np.int64)), "base_score": pa.array(sums(base)), "score": pa.array(score),
        })

    own = lambda: blocks.groupBy("block")
    answers = corpus_counts(own().applyInArrow(ask_words, ASKED), levels, word_totals, bits).withColumn("kind", F.lit(0))
    for order in (1, 2):
        asked = own().cogroup(answers.groupBy("child")).applyInArrow(ask_longer(order), ASKED)
        answers = answers.unionByName(corpus_counts(asked, levels, level_totals, bits).withColumn("kind", F.lit(order)))
    out = f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return own().cogroup(answers.groupBy("child")).applyInArrow(walked, out)
