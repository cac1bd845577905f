"""URL filter, top-k search and quality rules against brute force."""

import fnmatch
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from crossgrain.llm import quality_rules as R
from crossgrain.llm import topk as T
from crossgrain.llm import url_filter as U

URLS = [
    None, "", "no scheme", "://", "://com/en/", "http://com/en/", "http://COM/en/x?y", "http://evil.com/en/7", "https://a.Example.com/en/7", "http://xexample.com/en/7",
    "http://example.net/de/8", "http://m.example.net/de/9", "http://net/de", "http://net/de/", "http://a.org/es/#x", "http://org?x=/es/", "http://a.b/x.com/en/", "http://a#b://c.com/en/",
    "x://y://z.com/en/", "http://ÄÖ.com/en/é", "http://user@h.com:80/en/", "http://spam-farm.example.org/", "http://x.cheap-pills.example.com/de/", "http://cheap-pills/x",
    "http://h/a.exe", "http://h/a.exe?b", "http://h/b/wp-login.php", "http://h/wp-login.php", "http://h.net/de/" + "x" * 5000, "http://h/" + "y.exe" * 900, "\nhttp://h.com/en/\n", "HTTP://h.com/en/",
]


def brute_url(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        m = re.search(r"[/?#]", rest)
        host, rest = (rest[: m.start()], rest[m.start() :]) if m else (rest, "")
        path = re.split(r"[?#]", rest)[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
    best = None
    for verdict, rule in U.BASE_RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = verdict, rule
    if best:
        return host, path, best[1], best[0]
    for g in U.BLOCK_GLOBS:
        h, _, p = g.partition("/")
        if fnmatch.fnmatchcase(host, h) and fnmatch.fnmatchcase(path, "/" + p):
            return host, path, None, "block"
    return host, path, None, "allow"


def test_urls(spark, monkeypatch):
    monkeypatch.setattr(U, "BATCH_BYTES", 4000)
    r = random.Random(2)
    urls = URLS + ["http://" + "".join(r.choice(["com", "net", ".", "/en/", "/de/", "example", "7", "8", "?", "#", "casino-win.", "/"]) for _ in range(r.randint(1, 7))) for _ in range(400)]
    df = spark.createDataFrame([(k, u) for k, u in enumerate(urls)], "page_id long, url string").selectExpr("*", "1 AS host", "2 AS rule")
    got = df.select("page_id", U.judge(F.col("url")).alias("j")).select("page_id", "j.*").collect()
    assert len(got) == len(urls)
    for x in got:
        assert (x["host"], x["path"], x["rule"], x["verdict"]) == brute_url(urls[x["page_id"]]), urls[x["page_id"]]
    assert U.filter_urls(df).columns == df.columns and U.filter_urls(df.limit(0)).count() == 0


def test_many_globs_span_words():
    r = random.Random(4)
    globs = ["".join(r.choice("ab*?") for _ in range(r.randint(1, 9))) + "/" + "".join(r.choice("ab*?/") for _ in range(r.randint(0, 9))) for _ in range(60)]
    machine = U.Automaton([U.Rule.glob("block", g) for g in globs])
    assert machine.words > 4
    for _ in range(400):
        host, path = "".join(r.choice("ab") for _ in range(r.randint(0, 8))), "/" + "".join(r.choice("ab/") for _ in range(r.randint(0, 8)))
        k = machine.run([b"." + host.encode() + b"\xff" + path.encode()])[0]
        fit = [x for x in machine.rules if fnmatch.fnmatchcase(host, x.host[1:]) and fnmatch.fnmatchcase(path, x.path)]
        assert (machine.rules[k] if k >= 0 else None) == (fit[0] if fit else None)


def brute_top(rows, k=10):
    use = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            use.append((i, [math.floor(1024 * x) for x in v]))
    out = []
    for q, a in use:
        if q % 100 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in use if i != q)  # noqa: B905
            out += [(q, n, i, -s) for n, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("n,scale", [(1500, 1.0), (7, 1.0), (300, 1e5)])
def test_top_k(spark, monkeypatch, n, scale):
    monkeypatch.setattr(T, "ROWS", 200)
    monkeypatch.setattr(T, "QUERIES", 3)
    r = np.random.default_rng(7)
    v = np.round(r.normal(size=(n, 16)) * scale, 1).astype(np.float32)
    v[5 % n :: 9] = v[3 % n]  # ties
    rows = [(k, [float(x) for x in a]) for k, a in enumerate(v)]
    rows += [(100_000, None), (200_000, [float("nan")] * 16), (300_000, [None] * 16), (None, rows[0][1]), (400_000, []), (500_000, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS ids", "2 AS score", "3 AS v")
    got = T.top_k(df.repartition(3), F.col("vec_id") % 100 == 0).collect()
    assert sorted(tuple(x) for x in got) == brute_top(rows)


def test_no_vectors(spark):
    assert T.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0).count() == 0


def test_the_file_reads_few_vectors():
    r = np.random.default_rng(1)
    v = np.floor(r.normal(size=(4000, 32)) * 1024)
    file, read = T.ApproximationFile(v), []
    plain = T.exact_products
    try:
        T.exact_products = lambda a, q: (read.append(len(a)), plain(a, q))[1]
        centre, off = file.bounds(v[:1])
        at, score = file.top(v[0], np.arange(4000) == 0, centre[0], off[0], np.arange(4000), 10)
    finally:
        T.exact_products = plain
    want = v @ v[0]
    want[0] = -np.inf
    assert score.tolist() == sorted(want.tolist(), reverse=True)[:10] and sum(read) < 1500
    assert np.all(np.abs(centre[0] - v @ v[0]) <= off[0])


def brute_measure(text):
    t = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
    seen, covered = {}, set()
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            covered |= {i + k for i in at for k in range(8)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_measures(spark):
    r = random.Random(5)
    texts = [None, "", " \n\t", "one", "a b c d e f g h", "a b c d e f g h " * 2, "x " * 40, "l\nl\n\n \nl\n", "#*$%&|<> é😀\u00a0z\x85", "w\x0bv\x0cu", "long " * 9000]
    for _ in range(60):
        base = [r.choice("abcdefg") for _ in range(r.randint(1, 60))]
        texts.append(" ".join(base + base[: r.randint(0, 20)] + [r.choice("abc") for _ in range(r.randint(0, 30))] + base[3:17]))
    docs = spark.createDataFrame([(k, t, "en") for k, t in enumerate(texts)], "doc_id long, text string, lang string").selectExpr("*", "1 AS _w", "2 AS n_words", "3 AS stratum")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {x["doc_id"]: x for x in R.apply_rules(docs, labels).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        n, chars, symbols, dup, rep = want = brute_measure(t)
        x = got[k]
        assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"]) == want, t
        failed = n < 20 or 100 * rep > 30 * n
        assert x["base_failed"] == failed and x["kept"] == (not failed)
    assert R.apply_rules(docs.limit(0), labels).count() == 0


def test_bounds_and_cutoffs(spark):
    for bad, n, level in ((0, 100, 0.05), (3, 200, 0.01), (10, 50, 0.1)):
        p = R.upper_bound(bad, n, level)
        assert sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(bad + 1)) == pytest.approx(level, rel=1e-6)
    assert R.upper_bound(0, 0, 0.1) == 1.0 and R.upper_bound(5, 5, 0.1) == 1.0
    good = [(k, " ".join(f"word{(k * 7 + i) % 97}" for i in range(60)), "en") for k in range(3000)]
    junk = [(10_000 + k, " ".join(f"wo{i}***" for i in range(60)), "en") for k in range(50)]
    docs = spark.createDataFrame(good + junk, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(3000)] + [(10_000 + k, 0, 0) for k in range(25)], "doc_id long, quality int, toxic int")
    got = R.apply_rules(docs, labels).collect()
    assert all(x["kept"] == (x["doc_id"] < 10_000) for x in got)
    assert {x["failed_rule"] for x in got if x["doc_id"] >= 10_000} == {"symbol_share"}
    few = R.choose_cutoffs(R.measure(docs), labels.where("doc_id < 50"))
    assert few == {}  # too few to prove anything


def test_rules_of_a_stratum_share_one_bound(spark):
    """Two rules that would each reject under RISK of the good documents, but not together, are not both tightened."""
    def row(k, symbols, word):
        return (k, "en", 100, 100 * word, symbols, 1, 0, 0)

    schema = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"
    n = 4000
    rows = [row(k, 300 if k < 18 else 0, 15 if 18 <= k < 36 else 5) for k in range(n)]  # each in 0.45 % of the documents
    labels = spark.createDataFrame([(k, 1, 0) for k in range(n)], "doc_id long, quality int, toxic int")
    found = R.choose_cutoffs(spark.createDataFrame(rows, schema), labels)
    rejected = sum((r[4] / r[3] > found["en", "symbol_share"]) or (r[3] / 100 > found["en", "mean_word"]) for r in rows)
    assert R.upper_bound(rejected, n, R.ERROR / (len(R.STRATA) + 1)) <= R.RISK
    assert rejected < 36


def test_a_repeated_query_is_asked_once(spark):
    rows = [(100, [1.0, 0.0]), (100, [1.0, 0.0])] + [(k, [k / 20, 0.5]) for k in range(1, 16)] + [(3, [9.0, 0.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = T.top_k(vectors, F.col("vec_id") % 100 == 0).orderBy("rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == [(100, k + 1, v) for k, v in enumerate([3, *range(15, 6, -1)])]


def test_queries_in_groups_meet_streamed_blocks(spark, monkeypatch):
    monkeypatch.setattr(T, "GROUP", 4)
    monkeypatch.setattr(T, "ROWS", 50)
    monkeypatch.setattr(T, "QUERIES", 3)
    r = np.random.default_rng(4)
    v = np.round(r.normal(size=(2500, 8)), 1).astype(np.float32)
    v[7::5] = v[7]  # a common vector
    v[3] = 1e18  # products beyond bounds in single precision and beyond a long
    rows = [(k, [float(x) for x in a]) for k, a in enumerate(v)]
    out = T.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5), F.col("vec_id") % 100 == 0)
    assert "binary" not in out._jdf.queryExecution().optimizedPlan().toString()  # no row holds a block
    got = sorted(tuple(x) for x in out.collect())
    whole = np.array([[int(np.floor(float(x) * 1024)) for x in a] for a in v], dtype=object)
    want = []
    for q in range(0, 2500, 100):
        score = [max(-T.LONG, min(T.LONG, int(s))) for s in whole @ whole[q]]
        best = sorted((-s, k) for k, s in enumerate(score) if k != q)[:10]
        want += [(q, i, k, -s) for i, (s, k) in enumerate(best, 1)]
    assert got == sorted(want)


def test_all_rows_are_read_without_queries(spark):
    vectors = spark.range(1, 90).selectExpr("id AS vec_id", "array(1.0, 2.0) AS embedding")
    assert T.top_k(vectors, F.col("vec_id") % 100 == 0).count() == 0
