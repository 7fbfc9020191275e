import random
import re

from tracewright.llm import url_filter as U

URLS = [
    "http://a.example.com/en/7?x", "http://example.com/en/71", "http://x.com/en/", "http://xcom/en/", "https://EXAMPLE.net/de/8.html", "https://m.example.net/de/9", "http://net/de/", "http://b.org/es/#t",
    "http://b.org/ES/", "http://cheap-pills.example.org/fr/1", "http://x.org/cheap-pillss", "http://x.org/free/bets", "http://x.org/free", "http://x.org/freebets", "http://x.org/FREE?q=WIN", "no scheme cheap-pills",
    "", None, "://host", "a://b://c/d", "http://user@h:80/p?://q", "http://é.org/ü?adult-x", "http://x.org/a\nb", "http://x.org/win-win", "http://porn.example.com/en/7",
]


def brute(url, vocabulary=U.VOCABULARY):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    best = None
    for verdict, on, below in U.RULES:
        if (host == on or host.endswith("." + on)) and path.startswith(below) and (best is None or len(on + below) > len(best[0])):
            best = (on + below, verdict)
    low = re.sub("[A-Z]", lambda m: m[0].lower(), url or "")
    hit = [w for t, w in vocabulary if re.search(rf"(?<![a-z0-9]){re.escape(t)}(?![a-z0-9])", low)]
    soft = [w for w in hit if w < 1]
    own = "block" if len(hit) > len(soft) or (len(soft) >= U.SOFT_HITS and sum(soft) >= U.SOFT_WEIGHT - 1e-9) else "allow"
    strict, soft = len(hit) - len(soft), len(soft)
    return host, path, best and best[0], best[1] if best else own, strict, soft


def test_equals_brute_force(spark):
    rows = [(i, u, "h", 3) for i, u in enumerate(URLS)] + [(None, URLS[0], "h", 3)]
    got = U.filter_urls(spark.createDataFrame(rows, "page_id long, url string, host string, rule int")).collect()
    assert len(got) == len(rows)
    urls = {r[0]: r[1] for r in rows}
    for r in got:
        assert tuple(r)[1:] == brute(urls[r["page_id"]]), urls[r["page_id"]]


def test_a_vocabulary_from_a_table(spark):
    words = [("Tulip", 0.5), ("rose", 0.5), ("rose", 0.3), ("weed", 2.0), ("fern", 0.1), (None, 1.0), ("", 1.0), ("none", 0.0)]
    table = spark.createDataFrame(words, "term string, weight double")
    urls = ["http://a.org/tulip-rose", "http://a.org/tulip/fern", "http://a.org/tulips", "http://a.org/?WEED", "http://a.org/none", "http://a.org/" + "x/" * 50_000 + "rose+tulip"]
    got = U.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), vocabulary=table).collect()
    own = [("tulip", 0.5), ("rose", 0.5), ("weed", 2.0), ("fern", 0.1)]
    assert [tuple(r)[1:] for r in sorted(got)] == [brute(u, own) for u in urls]
    assert [r["verdict"] for r in sorted(got)] == ["block", "allow", "allow", "block", "allow", "block"]
    assert {r["verdict"] for r in U.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), vocabulary=()).collect()} == {"allow"}


def test_empty_table(spark):
    assert U.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_ten_thousand_terms_in_one_automaton_or_several(spark, monkeypatch):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcde1", k=rng.randint(2, 7)))
    words = {word(): rng.choice([1.0, 0.5, 0.25, 0.7]) for _ in range(40_000)}
    urls = [f"http://{word()}.{word()}.org/{word()}{rng.choice('-/.=x')}{word()}?{word()}" for _ in range(300)]
    table = spark.createDataFrame(list(words.items()), "term string, weight double")
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    assert len(words) > 10_000
    for size in (1_000_000, 3_000):
        monkeypatch.setattr(U, "MAX_TERMS", size)
        got = sorted(U.filter_urls(pages, vocabulary=table).collect())
        for r, url in zip(got, urls, strict=True):
            hit = [words[w] for w in set(re.findall("[a-z0-9]+", url)) if w in words]
            soft = [w for w in hit if w < 1]
            rejected = len(hit) > len(soft) or (len(soft) >= U.SOFT_HITS and sum(soft) >= U.SOFT_WEIGHT - 1e-9)
            assert (r["n_strict"], r["n_soft"]) == (len(hit) - len(soft), len(soft)) and r["verdict"] == ("block" if rejected else "allow")
    assert {r["verdict"] for r in got} == {"allow", "block"}


def test_learned_terms_tell_held_out_documents(spark):
    """Words of toxic documents become terms; on documents that they were not learnt from they find nearly all toxic ones and few others."""
    rng = random.Random(4)
    plain, bad = [f"w{i}" for i in range(200)], ["vile", "scorn", "Slur"]
    docs = []
    for i in range(1200):
        toxic = int(rng.random() < 0.2)
        words = rng.choices(plain, k=30) + (rng.sample(bad, 2) if toxic else rng.choices(bad, k=1) if rng.random() < 0.02 else [])
        docs.append((i, " ".join(words), toxic))
    docs += [(5000, None, 1), (5001, "vile", None), (None, "vile", 0)]
    taught = [d for d in docs if d[0] is None or d[0] % 3]
    rows = spark.createDataFrame(taught, "doc_id long, text string, toxic int")
    terms = dict(map(tuple, U.learned_terms(rows.drop("toxic"), rows.select("doc_id", "toxic")).collect()))
    assert set(terms) == {"vile", "scorn", "slur"}
    held = [d for d in docs if d[0] is not None and d[0] % 3 == 0 and d[2] is not None]
    hit = [any(w.lower() in terms for w in (d[1] or "").split()) for d in held]
    both = sum(h and d[2] for h, d in zip(hit, held, strict=True))
    assert both / sum(hit) > 0.85 and both / sum(d[2] for d in held) > 0.98
