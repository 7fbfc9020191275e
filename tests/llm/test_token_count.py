import random

import pytest

from tracewright.llm import token_count as C

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return lambda s: len(t.encode(s, add_special_tokens=False))


def texts():
    rng = random.Random(3)
    parts = ["word", " the", "  ", "\n", "\n\n", "don't", "42", "a1b2", "é", "日本語", "🙂", "<|endoftext|>", "...", "\t", "I'll", "x" * 50]
    for n in (1, 30, 300, 2000):
        yield "".join(rng.choice(parts) for _ in range(n))
        yield " ".join(rng.choice(parts) for _ in range(n))
    yield "a" * 5000
    yield "日本" * 3000
    yield " " * 3000
    yield "!" * 3000 + " end"
    yield "word " * 2000


@pytest.mark.parametrize("chunk,overlap", [(64, 8), (100, 60), (257, 16), (1000, 100)])
def test_spliced_counts_equal_the_library(library, chunk, overlap):
    with open(PATH, encoding="utf-8") as f:
        counter = C.Counter(f.read(), chunk, overlap)
    for t in texts():
        assert counter.count_all([t]) == [library(t)]


def test_odd_texts_equal_the_library(library):
    with open(PATH, encoding="utf-8") as f:
        content = f.read()
    counter, short, plain = C.Counter(content, 40, 8), C.Counter(content, pieces=50), C.Counter(content, pieces=0)
    assert short.cut is not None and plain.cut is None
    rng = random.Random(5)
    marks = ["a", "été", "naïve", "x×", "don't", "1", "22", "<|endoftext|>", ".", "!?", "—", "日本", "🙂", "\u00a0", "\u2003", "'s"]
    spaces = ["", " ", "  ", "\n", " \n", "\n\n ", "\t", "\r\n", "\u00a0", "\u2003"]
    for _ in range(300):
        t = "".join(rng.choice(marks) + rng.choice(spaces) for _ in range(rng.randint(0, 40)))
        for c in (counter, short, plain):
            assert c.count_all([t, t + " end", t]) == [library(t), library(t + " end"), library(t)]
    assert 0 < len(short.known) + len(short.seen) <= 50 + 200 and not plain.seen


def test_boundaries_are_tried_on_the_tokenizer():
    from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

    byte_level = Tokenizer.from_file(PATH)
    assert C.stable_boundaries(byte_level).pattern == "|".join(C.BOUNDARIES)
    other = Tokenizer(models.WordLevel({"a": 0}, unk_token="a"))
    assert C.stable_boundaries(other) is None  # not split at all
    other.pre_tokenizer = pre_tokenizers.Metaspace()
    assert C.stable_boundaries(other) is None or C.BOUNDARIES[1] not in C.stable_boundaries(other).pattern
    other.pre_tokenizer = pre_tokenizers.Punctuation("merged_with_next")
    assert C.stable_boundaries(other) is None
    byte_level.normalizer = normalizers.Lowercase()
    assert C.stable_boundaries(byte_level) is None


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_tokenizers_equal_their_library(spark, name):
    path = public_tokenizers.path(name)
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        count = lambda x: len(t.encode(x, add_special_tokens=False))
    else:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda x: len(m.encode(x))
    rows = list(enumerate(texts()))
    got = C.count_tokens(spark.createDataFrame(rows, "doc_id long, text string"), path).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in got} == {i: count(x) for i, x in rows}


def test_table(spark, library):
    rows = [(1, "hello world"), (2, None), (3, ""), (3, ""), (None, "é " * 40000), (5, "<|endoftext|> x")]
    got = C.count_tokens(spark.createDataFrame(rows, "doc_id long, text string"), PATH, limit=3).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(i, len((t or "").encode()), library(t or ""), library(t or "") > 3) for i, t in rows], key=str)
    assert C.count_tokens(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


@pytest.mark.parametrize("given", [{"rstrip": True}, {"lstrip": True}, {"single_word": True}, {"lstrip": True, "rstrip": True}, {}])
def test_added_tokens_that_look_at_their_surroundings(given):
    """Counts equal the library's whatever was met before, also twice and in long texts."""
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    tokenizer = tokenizers.Tokenizer.from_file(str(public.path("byte_bpe_50k.json")))
    tokenizer.add_tokens([tokenizers.AddedToken("<sep>", **given), tokenizers.AddedToken("qq", **given)])
    counter = C.Counter(tokenizer.to_str(), chunk=200, overlap=40)
    assert (counter.stable is None) == bool(given)
    rng = random.Random(1)
    parts = ["a", "<sep>", "qq", "qqa", " ", "\n", "b c", "12", "word", ".", "  "]
    texts = ["a<sep>\nb c<sep>\nb"] * 3 + ["".join(rng.choices(parts, k=rng.randint(1, 25))) for _ in range(300)] + ["".join(rng.choices(parts, k=900)) for _ in range(5)]
    want = [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]
    assert counter.count_all(texts) == want and counter.count_all(texts) == want


def test_clashing_columns(spark):
    public = pytest.importorskip("public_tokenizers")
    df = spark.createDataFrame([(1, "two words", 5, True)], "doc_id long, text string, n_tokens int, over_limit boolean")
    assert [tuple(r) for r in C.count_tokens(df, str(public.path("byte_bpe_50k.json"))).collect()][0][:2] == (1, 9)


def test_columns_that_clash(spark, library):
    rows = [(1, "some words", 5, "x"), (None, None, None, "y"), (2, "word " * 40_000, 7, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long, over_limit string").selectExpr("*", "1 as n_bytes", "2 as c0", "3 as c1")
    got = {r["doc_id"]: tuple(r)[1:] for r in C.count_tokens(df, PATH).collect()}
    want = {i: (len((t or "").encode()), library(t or ""), library(t or "") > 1024) for i, t, *_ in rows}
    assert got == want and want[2][2]
