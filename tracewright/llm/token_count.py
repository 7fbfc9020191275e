"""Token counts, with overlap resynchronisation for huge texts.

A text up to CHUNK characters is cut at stable boundaries; pieces that a worker
has met before are looked up, and the library encodes the rest, many at once.
A longer text is encoded in chunks that overlap, with offsets.  Two neighbouring encodings are spliced at a
stable boundary: a position where every split of the text, whatever stands
before, must begin a new piece.  Both encodings must have a token boundary
there and must agree from there to the last stable boundary of the overlap;
else the overlap is doubled, up to the rest of the text.

Which kinds of position are stable is not taken for granted: each kind in
BOUNDARIES is tried on the loaded tokenizer, and kinds that it does not keep
are not used.  Where none is left, as with a tokenizer that rewrites texts or
does not split them first, texts of any length are encoded whole.  ``pieces``
turns the lookup off: counts are the same, at the library's own speed.
"""

from __future__ import annotations

import os
import random
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import slices
from .staging import named, small_batches

#: Characters of a chunk, and of the overlap of two chunks at first.
CHUNK, OVERLAP = 1 << 15, 1 << 9
#: Text encoded in one call, in bytes.
CALL_BYTES = 1 << 18
#: Kinds of position that may be stable: after a visible character and before a space or line break; between a letter and a digit.
BOUNDARIES = (r"(?<=[!-~À-ÖØ-öø-ÿ])(?=[ \n])", r"(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")
#: Pieces that a worker remembers, about, and the length up to which it does.
PIECES, PIECE_CHARS = 600_000, 64
#: Texts on which each kind is tried, and what they are made of.
TRIALS = 400
TRIAL_PARTS = ("a", "Zed", "x1", "7", "2024", " ", "  ", "\n", "\n\n", " \n", "\t", ".", "!?", "'s", "don't", "-", "_", "(", "#", "é", "naïve", "日本", "🙂", "\u00a0")


def stable_boundaries(tokenizer) -> re.Pattern | None:
    """The kinds of BOUNDARIES at which the tokenizer, as a whole, encodes both sides as it does each alone.

    None where a text is rewritten, is not split first, or an added token takes
    its surroundings into account: what it strips, or whether it stands as a
    word, reaches over a boundary.  Each kind is tried on texts that hold the
    added tokens too.
    """
    if tokenizer.normalizer is not None or tokenizer.pre_tokenizer is None:
        return None
    added = list(tokenizer.get_added_tokens_decoder().values())
    if any(t.lstrip or t.rstrip or t.single_word for t in added):
        return None
    rng = random.Random(11)
    parts = [*TRIAL_PARTS, *(t.content for t in added[:8])]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(2, 30))) for _ in range(TRIALS)]
    ids = lambda t: tokenizer.encode(t, add_special_tokens=False).ids

    def kept(kind: str) -> bool:
        places = lambda t: [m.start() for m in re.finditer(kind, t) if 0 < m.start() < len(t)]
        return not any(places(t.content) for t in added) and all(ids(t) == ids(t[:p]) + ids(t[p:]) for t in texts for p in places(t))

    kinds = [k for k in BOUNDARIES if kept(k)]
    return re.compile("|".join(kinds)) if kinds else None


class Counter:
    """Counts tokens as the tokenizer of a file's content does, special strings included."""

    def __init__(self, content: str, chunk: int = CHUNK, overlap: int = OVERLAP, pieces: int = PIECES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.chunk, self.overlap = chunk, overlap
        self.stable = stable_boundaries(self.tokenizer)
        self.pieces = pieces
        self.cut = re.compile(BOUNDARIES[0]) if pieces and self.stable is not None and BOUNDARIES[0] in self.stable.pattern else None
        self.known: dict[str, int] = {}
        self.seen: set[str] = set()

    def count_all(self, texts: list[str]) -> list[int]:
        long = [self.stable is not None and len(t) > self.chunk for t in texts]
        short = [t for t, far in zip(texts, long, strict=True) if not far]
        counts = iter(self.count_pieces(short) if self.cut is not None else self._lengths(short))
        return [self.count_long(t) if far else next(counts) for t, far in zip(texts, long, strict=True)]

    def _lengths(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def count_pieces(self, texts: list[str]) -> list[int]:
        """Counts as sums over the pieces between stable boundaries.

        Known pieces are looked up.  New ones of a text are encoded together,
        in their order: between two of them is a stable boundary still.  A piece
        met again is encoded by itself once, and known from then on.
        """
        if len(self.known) + len(self.seen) > self.pieces:
            self.known.clear()
            self.seen.clear()
        totals, rest, again = [], [], []
        for t in texts:
            parts = self.cut.split(t)
            counts = list(map(self.known.get, parts))
            new = [p for p, c in zip(parts, counts, strict=True) if c is None]
            totals.append(sum(filter(None, counts)))
            again.append([p for p in new if p in self.seen])
            rest.append("".join([p for p in new if p not in self.seen]))
            self.seen.update([p for p in new if len(p) <= PIECE_CHARS])
        fresh = list(set(chain.from_iterable(again)))
        self.known.update(zip(fresh, self._lengths(fresh), strict=True))
        return [n + sum(map(self.known.__getitem__, a)) + r for n, a, r in zip(totals, again, self._lengths(rest), strict=True)]

    def _encode(self, text: str, start: int, end: int) -> tuple[list[int], list[int]]:
        """Ids of a part and the position in the text where each begins."""
        e = self.tokenizer.encode(text[start:end], add_special_tokens=False)
        return e.ids, [start + low for low, _ in e.offsets]

    def count_long(self, text: str) -> int:
        total, begin, n = 0, 0, len(text)
        end = min(n, begin + self.chunk)
        ids, at = self._encode(text, begin, end)
        while end < n:
            overlap = self.overlap
            while True:
                low = max(begin, end - overlap)
                next_end = min(n, max(end, low + self.chunk))
                next_ids, next_at = self._encode(text, low, next_end)
                p = self._boundary(text, low, end, ids, at, next_ids, next_at)
                if p is not None:
                    break
                if low == begin:  # no boundary at all: the rest so far is one piece
                    end = min(n, end + 2 * max(overlap, end - begin))
                    ids, at = self._encode(text, begin, end)
                    p = -1
                    break
                overlap *= 2
            if p >= 0:
                total += sum(1 for x in at if x < p)
                keep = [i for i, x in enumerate(next_at) if x >= p]
                ids, at = [next_ids[i] for i in keep], [next_at[i] for i in keep]
                begin, end = p, next_end
        return total + len(ids)

    def _boundary(self, text, low, end, ids, at, next_ids, next_at) -> int | None:
        """The first stable boundary in the overlap from which both encodings agree up to the last one."""
        stable = [m.start() for m in self.stable.finditer(text, low + 1, end)]
        stable = [p for p in stable if low < p < end]
        if len(stable) < 2:
            return None
        last = stable[-1]
        left, right = set(at), set(next_at)
        for p in stable[:-1]:
            if p in left and p in right and last in left and last in right:
                mine = [i for i, x in zip(ids, at, strict=True) if p <= x < last]
                theirs = [i for i, x in zip(next_ids, next_at, strict=True) if p <= x < last]
                if mine == theirs:
                    return p
        return None


class PieceCounter:
    """Counts tokens as a sentencepiece model's content does.  Its pieces may span any position, so texts are encoded whole."""

    def __init__(self, content: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=content)

    def count_all(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode(texts, num_threads=1)]


@lru_cache(maxsize=2)
def counter_of(content: str | bytes) -> Counter | PieceCounter:
    """A worker's counter; it outlives a task where workers are reused."""
    return Counter(content) if isinstance(content, str) else PieceCounter(content)


def count_tokens(docs: DataFrame, tokenizer_path: str, *, id: str = "doc_id", text: str = "text", limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every text.

    A ``.json`` file is one of the tokenizers library, a ``.model`` file one of
    sentencepiece.  The file is read on the driver and sent to the workers (1
    to 2 MB, whatever the data), so executors need no copy of it.

    Cases: null and empty texts have no bytes and no tokens; a very long text
    is spliced from chunks, in one task, or encoded whole where the tokenizer
    has no stable boundary; null ids keep their rows; repeated rows are counted
    alike; an empty table gives no rows; other columns are
    ignored.
    """
    small_batches(docs.sparkSession)
    with open(tokenizer_path, "rb") as f:
        content = f.read()
    if not tokenizer_path.endswith(".model"):
        content = content.decode()
    rows = docs.select(named(id).alias("doc_id"), F.coalesce(named(text).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(content)
        for batch in batches:
            for low, high in slices(batch.column(1), CALL_BYTES):
                part = batch.slice(low, high - low)
                texts = part.column(1).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(counter.count_all(texts), pa.int64())],
                    names=["doc_id", "n_bytes", "n_tokens"],
                )

    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint").withColumn("over_limit", F.col("n_tokens") > limit)
