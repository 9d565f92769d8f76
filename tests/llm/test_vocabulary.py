"""Spelling variants, URL rules and whitening against brute force."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from fixtures import SF, documents, odd_documents, pairs
from pyspark.sql import functions as F

from ratertrail.llm import queries, spelling, url_rules, whitening

UPPER = {i: i + 32 for i in range(65, 91)}


def brute_counts(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(counts):
    near = {w: [v for v in counts if abs(len(v) - len(w)) < 2 and v != w and one_apart(v, w)] for w in counts}
    best = {w: min(vs, key=lambda v: (-counts[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in best.items() if counts[v] >= 10 * counts[w]}
    root = {}
    for w in counts:
        r = w
        while r in form:
            r = form[r]
        root[w] = r
    return {(w, form.get(w), root[w], n, len(near[w]), counts.get(form.get(w))) for w, n in counts.items()}


def slips(spark, n=400):
    """Texts of a few words with slips of all kinds, in chains of frequencies, with accents, repeats of letters and a shared half."""
    rnd = random.Random(8)
    stems = ["ofthandor", "andthere", "aaaaaaaa", "ciónción", "ÀÉÎõüÿß", "edoution" * 3, "mmmnnnmmm", "halfhalf"]
    words = []
    for s in stems:
        for k, times in enumerate((250, 20, 2)):
            for _ in range(1 if k == 0 else 6):
                w = s
                for _ in range(k):
                    p = rnd.randrange(len(w))
                    w = rnd.choice([w[:p] + w[p + 1 :], w[:p] + rnd.choice("abmnÿé") + w[p:], w[:p] + rnd.choice("abmnÿé") + w[p + 1 :]])
                words += [w] * times
    rnd.shuffle(words)
    texts = [" ".join(words[k::n]) for k in range(n)]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.mark.parametrize("source", ["odd", "small", "slips"])
@pytest.mark.parametrize("block", [8192, 7])
def test_spelling_variants(spark, monkeypatch, source, block):
    monkeypatch.setattr(spelling, "BLOCK", block)
    docs = {"odd": odd_documents, "small": documents, "slips": slips}[source](spark)
    if source == "small":
        docs = docs.limit(60) if block == 7 else docs
    given = pairs(docs.cache())
    docs.unpersist()
    docs = spark.createDataFrame(given, "doc_id long, text string")
    got = spelling.variants(docs)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = [tuple(r) for r in got.collect()]
    expected = brute_variants(brute_counts(given))
    assert len(rows) == len(expected) and set(rows) == expected
    if source == "slips":
        assert sum(r[1] is not None for r in rows) > 20 and any(r[1] not in (None, r[2]) for r in rows)


def test_spelling_without_words(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "short words only"), (4, "alonealone")], "doc_id long, text string")
    assert spelling.variants(docs).count() == 0 and spelling.variants(docs.limit(0)).count() == 0


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("EXAMPLE.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"), ("a.b.c.example.net", "", "block"),
         ("net", "/é🙂", "block"), ("net", "/é", "allow"), ("net", "/é", "block"), (None, "/", "block"), ("x", None, "block"), ("x", "/", None)]


def brute_verdict(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest)[0].translate(UPPER)
    path = re.match("[^/?#]*([^?#]*)", rest)[1]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in ((h.translate(UPPER), p, v) for h, p, v in RULES if None not in (h, p, v)) if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


ODD_URLS = [None, "", "no scheme", "http://", "http:///org/", "https://Example.ORG/es/x?y#z", "http://a.example.org/es", "http://notexample.org/es/1", "ftp://org", "http://org/", "http://www.x.org:80/en/1", "http://u@x.com/fr/",
            "x://y://example.org/es/", "http://.org/", "http://org./", "http://a.b.c.example.net", "http://z.a.b.c.example.net?q", "http://b.c.example.net/", "http://x.net/é🙂🙂", "http://x.net/éx", "http://x.net/e",
            "http://example.org/en/\n1", "http://exa\nmple.org/en/1", "http://" + "a." * 3000 + "com/de/" + "x" * 20000, "http://example.org/en/19#/es/", "http://example.org#/en/1"]


def test_url_rules(spark):
    rnd = random.Random(2)
    urls = ODD_URLS + ["://" + "".join(rnd.choice(["org", "com", ".", "/", "fr/", "de/", "/en/1", "example", "?", "#", "net"]) for _ in range(rnd.randint(1, 8))) for _ in range(500)]
    rows = [(k, u) for k, u in enumerate(urls)] + [(None, "http://x.org/"), (5, "http://x.org/"), (5, "http://x.org/")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    for c in ("host", "path", "rule", "verdict", "row", "key", "tail", "head", "prefix", "judged", "size", "judged_key", "labels"):
        pages = pages.withColumn(c, F.lit("mine"))
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string").withColumn("prefix", F.lit("mine"))
    got = url_rules.judge_urls(pages, rules)
    assert sorted(got.columns) == sorted(pages.columns)
    assert {r["host"] for r in got.select("host").distinct().collect()} == {"mine"}
    found = Counter((r["page_id"], *r["judged"]) for r in got.select("page_id", "judged").collect())
    assert found == Counter((k, *brute_verdict(u)) for k, u in rows)
    assert url_rules.judge_urls(pages.limit(0), rules).count() == 0
    assert {tuple(r["judged"])[2:] for r in url_rules.judge_urls(pages, rules.limit(0)).select("judged").collect()} == {(None, "allow")}


def test_url_query(spark):
    got = queries.op12_url_filters(spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/pages.parquet").count() and {"org/", "example.org/es/", "com/fr/", "com/de/"} <= {r["rule"] for r in got}


def brute_whitening(vectors, k=8):
    x = np.floor(1024 * np.array(vectors, float)) + 100000
    n, d = x.shape
    centred = x - x.mean(axis=0)
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    exact = [[int(c) for c in row] for row in x]
    sums = [sum(col) for col in zip(*exact)]
    return centred @ v[:, :k] / np.sqrt(e[:k]), e[:k] / e.sum(), [sum((n * c - s) ** 2 for c, s in zip(row, sums)) for row in exact]


def test_whitening(spark):
    given = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = {r["vec_id"]: r["embedding"] for r in given.collect()}
    w, share, deviation = brute_whitening(list(rows.values()))
    got = queries.op13_embedding_whitening(spark, SF).collect()
    assert len(got) == 8 * len(rows)
    table = {(r["vec_id"], r["component"]): r for r in got}
    signs = [None] * 8
    for at, v in enumerate(rows):
        for k in range(8):
            r = table[v, k + 1]
            signs[k] = signs[k] or np.sign(r["whitened"] * w[at, k])
            assert abs(r["whitened"] - signs[k] * w[at, k]) < 1e-9 and r["deviation"] == deviation[at] and r["n"] == len(rows)
            assert abs(r["explained"] / share[k] - 1) < 1e-9 and r["identity_error"] < 1e-9


def test_whitening_odd_rows(spark):
    rnd = random.Random(1)
    good = [[rnd.gauss(0, 1), rnd.gauss(0, 1), rnd.gauss(0, 1)] for _ in range(40)] + [[1e6, -1e6, 0.0]] * 3
    bad = [None, [], [1.0], [1.0, None, 2.0], [float("nan"), 1.0, 2.0], [float("inf"), 0.0, 0.0], [0.0, 0.0, -float("inf")], [1.0, 2.0, 3.0, 4.0]]
    rows = [(k, v) for k, v in enumerate(good)] + [(900 + k, v) for k, v in enumerate(bad)] + [(None, good[0]), (5, good[5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("component", F.lit("mine")).withColumn("place", F.lit(1)).withColumn("vector", F.lit("mine"))
    got = whitening.whiten(df).collect()
    kept = good + [good[0], good[5]]
    _, share, deviation = brute_whitening(kept, 3)
    assert Counter((r["vec_id"], r["component"], int(r["deviation"])) for r in got) == Counter((i, k, d) for i, d in zip([*range(len(good)), None, 5], deviation) for k in (1, 2, 3))
    assert max(r["identity_error"] for r in got) < 1e-6 and {(r["component"], round(r["explained"], 6)) for r in got} == {(k + 1, round(float(s), 6)) for k, s in enumerate(share)}
    assert whitening.whiten(df.limit(0)).columns == [*got[0].asDict()] and whitening.whiten(df.limit(0)).count() == 0
    assert whitening.whiten(df.filter("vec_id = 40")).count() == 0  # one vector has no spread
    flat = spark.createDataFrame([(k, [float(k % 5), 2.0 * (k % 5), 7.0]) for k in range(20)], "vec_id long, embedding array<float>")
    assert {r["component"] for r in whitening.whiten(flat).collect()} == {1}  # rank one


def test_whitening_of_large_values(spark):
    rows = [(k, [3e5 * k, -2e8 * k * k, 1.0 * (k % 3)]) for k in range(7)] + [(99, [1e30, -1e30, 0.0])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    steps = [[max(-whitening.LIMIT, min(whitening.LIMIT, int(1024 * c // 1))) for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*steps)]
    assert {(r["vec_id"], int(r["deviation"])) for r in got} == {(i, sum((8 * c - s) ** 2 for c, s in zip(v, sums))) for (i, _), v in zip(rows, steps)}


def leverrier(m):
    """The characteristic polynomial, constant first, by powers of the matrix; all divisions come out even."""
    d, m = len(m), np.array(m, object)
    work, coefficients = np.eye(d, dtype=int).astype(object), [1]
    for k in range(1, d + 1):
        work = m @ work
        coefficients.append(-sum(work[i, i] for i in range(d)) // k)
        work = work + coefficients[-1] * np.eye(d, dtype=int).astype(object)
    return coefficients[::-1]


def test_polynomial_and_roots():
    rnd = random.Random(4)
    for d in (1, 2, 3, 7, 12):
        b = [[rnd.randint(-9, 9) if rnd.random() < 0.6 else 0 for _ in range(d)] for _ in range(max(1, d - 2))]
        m = [[sum(r[i] * r[j] for r in b) for j in range(d)] for i in range(d)]
        p = whitening.characteristic_polynomial(m)
        assert p == leverrier(m)
        roots = [float(r) for r in whitening.largest_roots(p, d)]
        e = np.linalg.eigvalsh(np.array(m, float))[::-1]
        assert np.allclose(roots, e[: len(roots)]) and np.allclose(e[len(roots) :], 0, atol=1e-8)
    # Equal roots, whole and irrational ones, as often as they are roots.
    blocks = np.kron(np.eye(3, dtype=int), np.array([[2, 1], [1, 1]]))
    p = whitening.characteristic_polynomial([[int(c) for c in r] for r in blocks])
    assert np.allclose([float(r) for r in whitening.largest_roots(p, 4)], [2.618033988749895] * 3 + [0.3819660112501051])
    fit = whitening.fit_scatter(1, [0] * 6, [[int(c) for c in r] for r in blocks], 6)
    assert np.allclose(fit.components @ fit.components.T, np.eye(6)) and np.allclose(blocks @ fit.components.T, fit.components.T * fit.eigenvalues)
