"""Catalogs as tables, strings in texts, and citations by short names, each against a plain computation."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tracewright.functions import patterns as P
from tracewright.operators import catalogs as C
from tracewright.operators import integrity as I
from tracewright.operators import signatures as S
from tracewright.operators import containment
from tracewright.operators.containment import contains_join


@pytest.mark.parametrize(
    ("pattern", "literals"),
    [
        ("abc", {"abc"}), ("ab", None), ("(?i)ABC|def", {"abc", "def"}), ("abc|d", None), ("abcd?", {"abc"}), ("abc+d", {"abc"}), (r"a\.bc", {"a.bc"}), (r"\babc\b", {"abc"}), ("(?:one|two)x", {"one", "two"}),
        ("(?:one|two)?xyz", {"xyz"}), ("(?<!not )abc", {"abc"}), ("[abc]def", {"def"}), ("[]a]def", {"def"}), (r"\w+", None), ("abc{2}def", {"abc"}), ("abc{0,3}", None), (r"(?:abcd){2,}", {"abcd"}), ("((abc)|(xyz))+", {"abc", "xyz"}),
        ("a(bc", None), ("abc)", None), ("(?x)a b c", None), (r"\Qabc\E", None), (r"x\d{3}long word", {"long word"}), ("ÄÖÜ", {"äöü"}), ("", None), ("|abc", None), (r"foo\nbar", {"foo"}),
    ],
)
def test_required_literals(pattern, literals):
    assert C.required(pattern) == (None if literals is None else frozenset(literals))


def test_folding_keeps_lengths_and_joins_cases():
    assert all(len(C.folded(c)) == 1 for c in map(chr, range(0x3000)))
    assert C.folded("İSTANBUL ſS K") == "iSTANBUL ss k".lower()


def messages(spark, n=400, seed=2):
    rng = random.Random(seed)
    said = [p[0] for p in (("That was my mistake", 0), ("you never read it", 0), ("base control holds", 0), ("the claim was REFUTED", 0), ("not refuted", 0), ("we stopped retrying", 0), ("round 3 is the cap", 0), ("a probe would falsify it", 0), ("prism. not available", 0), ("LSP not available", 0), ("ordinary words", 0))]
    rows = [(str(i), rng.choice(["user", "assistant", "tool", None]), rng.choice([None, "", *[" ".join(rng.choices(said, k=rng.randint(1, 3)))] * 12])) for i in range(n)]
    return spark.createDataFrame(rows, "id string, role string, text string")


def test_a_table_of_rules_finds_what_the_list_does(spark):
    rules = P.FAILURE_SIGNATURES + P.SUCCESS_SIGNATURES
    rows = messages(spark)
    table = spark.createDataFrame(rules, "detector string, bucket string, priority int, pattern string, role string")
    got, want = (sorted(map(tuple, df.select("id", "detector", "bucket", "snippet").collect())) for df in (C.detect_by_table(rows, table), S.detect(rows, rules)))
    assert got == want and len(want) > 100


@pytest.mark.parametrize("size", [20_000, 700])
def test_thousands_of_rules_in_one_pass_or_several(spark, monkeypatch, size):
    monkeypatch.setattr(C, "RULES", size)
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 6))) for _ in range(3000)]
    rules = [(f"d{rng.randint(0, 900)}", rng.choice("xyz"), rng.randint(1, 3), rng.choice(["", "(?i)"]) + rng.choice([rf"\b{w}\b", w + "[0-9]?", f"{w}|{w[::-1]}q", rf"\s{w}"]), rng.choice(["user", "assistant"])) for w in rng.choices(words, k=5000)]
    rules += [(None, "x", 1, "a", "user"), ("d1", "x", 1, None, "user"), ("d2", "x", 1, "a", None)]
    texts = [(str(i), rng.choice(["user", "assistant"]), " ".join(w.upper() if rng.random() < 0.3 else w for w in rng.choices(words, k=6))) for i in range(40)] + [("n", "user", None)]
    rows = spark.createDataFrame(texts, "id string, role string, text string")
    table = spark.createDataFrame(rules, "detector string, bucket string, priority int, pattern string, role string")
    got = {(r["id"], r["detector"]): r["bucket"] for r in C.detect_by_table(rows, table).collect()}
    want = {}
    for i, role, text in texts:
        for d, bucket, priority, pattern, who in sorted((r for r in rules if None not in r), key=lambda r: (r[0], r[2], r[3])):
            if text is not None and who == role and (i, d) not in want and re.search(pattern, text):
                want[i, d] = bucket
    assert len(want) > 500 and got.keys() == want.keys()
    ties = {(d, p, x) for d, _, p, x, _ in rules if d}  # of equal rules either bucket may show
    assert sum(got[k] != want[k] for k in want) <= len(rules) - len(ties)


def test_empty_catalog(spark):
    table = spark.createDataFrame([], "detector string, bucket string, priority int, pattern string, role string")
    assert C.detect_by_table(messages(spark, 5), table).columns == ["id", "role", "text", "detector", "bucket", "snippet"]
    assert C.detect_by_table(messages(spark, 5), table).count() == 0


@pytest.mark.parametrize(("by", "few"), [((), 8), (("k",), 8), (("k",), 1000)])
def test_contains_join(spark, monkeypatch, by, few):
    monkeypatch.setattr(containment, "FEW", few)
    rng = random.Random(9)
    text = lambda n: "".join(rng.choices("ab cd\né𝒳", k=n))
    texts = [(rng.choice("xy"), i, rng.choice([None, "", text(rng.randint(1, 60))])) for i in range(80)]
    whole = [t for _, _, t in texts if t and len(t) > 12]
    parts = [(rng.choice("xyz"), f"p{i}", p) for i, p in enumerate([None, "", "a", "é", "ab", "zz", "d c", "𝒳", *[t[3 : rng.randint(4, len(t))] for t in whole], *[text(4) for _ in range(20)]])]
    a, b = spark.createDataFrame(texts, "k string, id long, t string"), spark.createDataFrame(parts, "k string, part string, p string")
    got = contains_join(a, b if by else b.drop("k"), "id", "t", "part", "p", by=by).collect()
    want = [((k,) if by else ()) + (i, n) for k, i, t in texts for j, n, p in parts if t and p and p in t and (not by or j == k)]
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 50
    assert contains_join(a, b.where("part = 'none'"), "id", "t", "part", "p", by=("k",)).count() == 0


def test_known_incidents_from_a_long_list(spark):
    rng = random.Random(4)
    incidents = [(rng.choice(["admission", "user_correction", "cap"]), f"{rng.randint(0, 400)}-{rng.choice('abc')}", rng.choice([None, "so it was", "and then"])) for _ in range(600)]
    known = [(f"l{i}", rng.choice(["adm", "user", "", "none"]), rng.choice(["", "-a", str(rng.randint(0, 999)), f"{rng.randint(0, 400)}-"]), rng.choice([None, None, "was$", "^and", "x"])) for i in range(3000)]
    got = dict(map(tuple, S.known_found(spark.createDataFrame(known, "label string, detector_prefix string, session_part string, snippet_pattern string"), spark.createDataFrame(incidents, "detector string, session string, snippet string")).collect()))
    for label, prefix, part, pattern in known:
        assert got[label] == any(d.startswith(prefix) and part in s and (pattern is None or (x is not None and re.search(pattern, x) is not None)) for d, s, x in incidents), label


def test_citations_by_short_id_and_elided_path(spark):
    files = ["/w/a/0123abcd-x.jsonl", "/w/b/0123abcd-y.jsonl", "/w/b/89abcdef.jsonl", "/w/src/one.rs", "/v/src/one.rs", "/w/src/two.rs", "fedcba98"]
    cites = [("c0", "89abcdef", "short id", "/w/b/89abcdef.jsonl"), ("c1", "0123abcd", "ambiguous", "0123abcd"), ("c2", "…/w/src/one.rs", "suffix", "/w/src/one.rs"), ("c3", ".../src/one.rs", "ambiguous", ".../src/one.rs"), ("c4", "…/two.rs", "suffix", "/w/src/two.rs"), ("c5", "/w/src/two.rs", "exact", "/w/src/two.rs"), ("c6", "…/three.rs", "none", "…/three.rs"), ("c7", "two.rs", "none", "two.rs"), ("c8", "fedcba98", "exact", "fedcba98")]
    df = spark.createDataFrame([(c, p, 1, "q") for c, p, _, _ in cites], "cite string, path string, line long, quote string")
    got = I.resolve_paths(df, spark.createDataFrame([(f,) for f in files], "path string"))
    assert got.columns == ["cite", "path", "line", "quote", "how"]
    assert sorted((r["cite"], r["how"], r["path"]) for r in got.collect()) == [(c, how, path) for c, _, how, path in cites]


@pytest.mark.parametrize("few", [0, 100])
def test_grades_against_all_lines(spark, monkeypatch, few):
    monkeypatch.setattr(containment, "FEW", few)
    rng = random.Random(6)
    words = ["Alpha", "beta", "gämma", "*delta*", "x", "eps-ilon", "“q”"]
    lines = [(f"f{k}", i, " ".join(rng.choices(words, k=rng.randint(0, 7)))) for k in range(4) for i in range(1, 60)]
    cites = []
    for i in range(200):
        path, at, line = rng.choice(lines)
        a = rng.randint(0, max(len(line) - 3, 0))
        cites.append((f"c{i}", rng.choice([path, path, path, "none"]), at + rng.choice([0, 0, 3, -4, 20]), rng.choice([line[a : a + rng.randint(1, 25)], line, line[:6] + " ... " + line[-7:], "absent words", "a … b", None])))
    key = lambda t: re.sub(r"\s+", " ", re.sub(r"[*_`]", "", t.replace("“", '"').replace("”", '"'))).strip().lower()
    want = {}
    for cite, path, at, quote in cites:
        own = [(n, key(t)) for p, n, t in lines if p == path]
        q = None if quote is None else key(quote)
        near = min(((abs(n - at), n) for n, t in own if q and q in t), default=None)
        parts = [x for x in re.split(r"\s*(?:\.\.\.|…)\s*", q or "") if x]
        spliced = len(parts) > 1 and all(any(x in t for _, t in own) for x in parts)
        if q == "":
            near = min(((abs(n - at), n) for n, t in own if abs(n - at) <= 5), default=None)
        grade = "NO-FILE" if not own else "NOT-FOUND" if near is None and not spliced else "SPLICE?" if near is None else "VALID" if near[0] == 0 else "DRIFT" if near[0] <= 5 else "ELSEWHERE"
        want[cite] = (grade, near[1] if near else None)
    got = {r["cite"]: (r["grade"], r["nearest"]) for r in I.grade_citations(spark.createDataFrame(cites, "cite string, path string, line long, quote string"), spark.createDataFrame(lines, "path string, line_no long, line string")).collect()}
    assert got == want and len({g for g, _ in want.values()}) == 6


def test_one_detector_of_many_rules_is_taken_in_parts(spark, monkeypatch):
    """A part holds RULES rules at most, also of one detector; the first rule by priority and pattern gives the row, once for each of equal messages."""
    monkeypatch.setattr(C, "RULES", 7)
    rules = [("d", f"b{k % 5}", 1 + k % 3, f"word{k:02d}", "user") for k in range(40)] + [("e", "x", 1, "word3[0-9]", "user")]
    table = spark.createDataFrame(rules, "detector string, bucket string, priority int, pattern string, role string")
    assert [len(p) for p in C._parts(table)] == [7, 7, 7, 7, 7, 6]
    texts = [("a", "word00 word39"), ("a", "word00 word39"), ("b", "word01 word02 word35"), ("c", "none"), ("d", None)]
    rows = spark.createDataFrame([(i, "user", t) for i, t in texts], "id string, role string, text string")
    got = sorted(tuple(r) for r in C.detect_by_table(rows, table).select("id", "detector", "bucket", "snippet").collect())
    assert [g[:3] for g in got] == [("a", "d", "b0"), ("a", "d", "b0"), ("a", "e", "x"), ("a", "e", "x"), ("b", "d", "b1"), ("b", "e", "x")]
