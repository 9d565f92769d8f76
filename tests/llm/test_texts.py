"""Operators with Python in the tasks against brute force, other libraries or held-out labels, and the pipeline."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
import xxhash
from fixtures import ODD, SF, documents, odd_documents, pairs, with_tables
from pyspark.sql import functions as F

import corpus_pipeline
from ratertrail.llm import byte_bpe, decontaminate, license_scan, queries, simhash, token_counts, toxicity

RANK_FILE = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = byte_bpe.parse_ranks(byte_bpe.read_rank_file(RANK_FILE))
PATTERN = public_tokenizers.PATTERN
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def test_byte_bpe_matches_tiktoken(spark, tmp_path):
    other = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})
    odd = odd_documents(spark, 150)
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars").unionByName(documents(spark).limit(60))
    got = Counter(tuple(r) for r in queries.op3_byte_bpe(spark, with_tables(spark, tmp_path, documents=docs)).collect())
    want = Counter()
    for d, t in pairs(docs):
        ids = other.encode_ordinary(t or "")
        want[d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert got == want
    again = byte_bpe.decode_documents(byte_bpe.encode_documents(docs, RANK_FILE, PATTERN), RANK_FILE)
    assert Counter((r["doc_id"], bytes(r["decoded"])) for r in again.select("doc_id", "decoded").collect()) == Counter((d, (t or "").encode()) for d, t in pairs(docs))
    assert byte_bpe.encode_documents(odd.limit(0), RANK_FILE, PATTERN).count() == 0
    assert byte_bpe.encode_documents(odd, RANK_FILE, PATTERN).columns == odd.columns


def test_merge_replay_where_ranks_fall():
    # Joining b and c (rank 6) makes a pair of lower rank (5) in the same word.
    ranks = {bytes([b]): b + 100 for b in range(256)} | {b"abc": 5, b"bc": 6, b"aa": 7}
    table = byte_bpe.MergeTable(ranks)
    words = [b"abcabc", b"aaaaa", b"bcbc", b"", b"abc", b"xabcbcaab"]
    assert [np.frombuffer(x, "<u4").tolist() for x in table.replay(words)] == [table.one_word(w) if w not in ranks else [ranks[w]] for w in words]


def test_token_counts_match_brute_force(spark):
    costs = token_counts.zipf_costs(RANKS)

    def brute(w):
        best = [(0, 0)] + [(1 << 60, 0)] * len(w)
        for i in range(1, len(w) + 1):
            best[i] = min(((best[j][0] + c, best[j][1] + 1) for j in range(max(0, i - 130), i) if (c := costs.get(w[j:i])) is not None))
        return best[-1][1]

    find = regex.compile(PATTERN).findall
    docs = odd_documents(spark, 100)
    got = Counter((r["doc_id"], r["text"], r["n_tokens"]) for r in token_counts.count_tokens(docs, RANK_FILE, PATTERN).collect())
    assert got == Counter((d, t, sum(brute(m.encode()) for m in find(t or ""))) for d, t in pairs(docs))
    assert token_counts.count_tokens(docs.limit(0), RANK_FILE, PATTERN).count() == 0
    assert queries.op2_token_counts(spark, SF).count() == documents(spark).count()


def fold(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


@pytest.mark.parametrize("block_bytes", [100, decontaminate.BLOCK_BYTES])
def test_decontamination_matches_brute_force(spark, block_bytes):
    rnd = random.Random(8)
    items = [" ".join(rnd.choice("abcde") + str(rnd.randint(0, 3)) for _ in range(rnd.choice([1, 3, 9, 10, 11, 40]))) for _ in range(12)] + ["...", "", None, "a0 a0 a0 a0 a0 a0 a0 a0 a0 a0 a0"]
    items.append(items[5])
    bench = spark.createDataFrame(list(enumerate(items)) + [(None, "a b c")], "item_id long, text string")
    words = " ".join(i or "" for i in items).split()
    texts = []
    for _ in range(60):
        out = [rnd.choice(words) for _ in range(rnd.randint(0, 30))]
        w = (items[rnd.randint(3, 11)] or "").split()
        a = rnd.randint(0, len(w))
        texts.append(" ".join(out + w[a : a + rnd.randint(5, 40)] + out[:3]).upper() + rnd.choice(["", "!", " a0, a0-a0 a0 a0 a0 a0 a0 a0 a0 a0 a0 a0 a0"]))
    docs = spark.createDataFrame(list(enumerate(texts)) + [(999, None), (5, texts[5])], "doc_id long, text string").withColumn("overlap", F.lit(1))
    windows = defaultdict(set)
    for i, t in enumerate(items):
        w = fold(t)
        for k in range(len(w) - min(10, len(w)) + 1 if w else 0):
            windows[tuple(w[k : k + min(10, len(w))])].add(str(i))
    want = Counter()
    for d, t in pairs(docs):
        w, hit, found = fold(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        want[d, len(w), len(hit), ",".join(sorted(found))] += 1
    out = decontaminate.find_overlaps(docs, bench, block_bytes=block_bytes).select("doc_id", "overlap.*").collect()
    assert Counter((r["doc_id"], r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), ",".join(r["items"])) for r in out) == want
    clean = decontaminate.remove_contaminated(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(n for k, n in want.items() if not k[2])
    assert decontaminate.remove_contaminated(docs, bench.limit(0)).count() == docs.count() and decontaminate.find_overlaps(docs.limit(0), bench).count() == 0


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    s = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, within=2):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= within:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(len(fps))]


def test_simhash_matches_brute_force(spark, tmp_path):
    docs = odd_documents(spark, 40).filter("doc_id is not null").dropDuplicates(["doc_id"]).select("doc_id", "text", "lang", "source", "n_chars")
    docs = docs.unionByName(documents(spark).withColumn("doc_id", F.col("doc_id") + 10_000))
    rows = sorted(pairs(docs))
    fps = [brute_fingerprint(t) for _, t in rows]
    least = brute_components(fps)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op7_simhash(spark, with_tables(spark, tmp_path, documents=docs)).collect()}
    assert got == {d: (format(f, "016x"), rows[c][0]) for (d, _), f, c in zip(rows, fps, least)}


def test_anchor_links_lose_none(spark):
    rnd, fps = random.Random(4), [0, (1 << 64) - 1, 1 << 63]
    for _ in range(40):  # clouds of points around centres, some of them words of the code
        centre = rnd.choice([rnd.getrandbits(64), fps[rnd.randrange(len(fps))], 0])
        for _ in range(rnd.randint(1, 9)):
            f = centre
            for b in rnd.sample(range(64), rnd.randint(0, 4)):
                f ^= 1 << b
            fps.append(f)
    fps = sorted(set(fps), key=lambda f: f - (1 << 64) if f >> 63 else f)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    links = simhash.links(df).collect()
    assert all(((r["a"] ^ r["b"]) & (1 << 64) - 1).bit_count() <= 2 for r in links)
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(df)).collect()}
    assert [roots.get(f, f) for f in signed] == [signed[c] for c in brute_components(fps)]


def test_simhash_keeps_one_of_each(spark):
    docs = odd_documents(spark, 10)
    kept = simhash.keep_first_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids)) and set(ids) == {r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert simhash.keep_first_of_each(docs.limit(0)).count() == 0


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = queries.op8_toxicity(spark, sf).join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in got)
    held = [(r["predicted"], r["toxic"]) for r in got if r["held_out"]]
    n = Counter(held)
    assert n[1, 1] >= 0.85 * (n[1, 1] + n[0, 1]) and n[1, 0] <= 0.03 * (n[1, 0] + n[0, 0])
    assert docs.count() == queries.op8_toxicity(spark, SF).count() * docs.count() // documents(spark).count()


def test_toxicity_gradients_match_differences():
    net = toxicity.Network(["ab", "cd"], 3)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    words, ids, mask, y = ["", "ab", "cd", "xyz"], np.array([[1, 2, 3, 1], [3, 2, 0, 0]]), np.array([[1, 1, 1, 1], [1, 1, 0, 0]], bool), np.array([1.0, 0.0])

    def loss():
        p = toxicity._sigmoid(net.logits(net.embed(words)[0].astype(np.float64) @ net.p["in"] + net.p["in_b"], ids, mask))
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    for name, g in net.gradients(words, ids, mask, y).items():
        flat, g = net.p[name].reshape(-1), np.asarray(g).reshape(-1)
        for i in np.argsort(-abs(g))[:3]:
            was = flat[i]
            flat[i] = was + 1e-3
            up = loss()
            flat[i] = was - 1e-3
            down = loss()
            flat[i] = was
            assert abs((up - down) / 2e-3 - g[i]) <= 2e-2 * abs(g[i]) + 3e-5


def test_toxicity_windows_and_odd_rows(spark):
    for n in (0, 1, 39, 40, 41, 72, 73, 1000):
        starts = toxicity.windows_of(n)
        assert {i for s in starts for i in range(s, min(n, s + toxicity.WINDOW))} == set(range(n))
    texts = ["you idiot fool", "nice day sir"] * 12
    net = toxicity.train(texts, [1, 0] * 12, epochs=3)
    docs = odd_documents(spark)
    got = toxicity.score(docs, net).select("text", "score").collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    one = toxicity.Scorer(net)
    assert all(abs(float(one.scores([r["text"]])[0]) - r["score"]) < 1e-5 for r in got)
    assert toxicity.train([], []) == 0.0 and toxicity.train(["a"], [1]) == 1.0
    assert toxicity.score(docs.limit(0), net).count() == 0 and toxicity.score(docs, 0.0).agg(F.max("score")).first()[0] == 0


def test_license_scan(spark):
    names = dict(license_scan.TEMPLATES)
    for name, text in names.items():
        assert license_scan.scan_block(text, tuple(sorted(names.items())))[0] == name
        assert license_scan.scan_block("x " * 30 + text.upper() + " thanks", tuple(sorted(names.items())))[0] == name
    for text in ("Licensed under CC BY-XX 9.9.", "your license expired", "Licensed under the Apache License, Version 7.0.", "licence"):
        assert license_scan.scan_block(text, tuple(sorted(names.items())))[0] is None
    docs = odd_documents(spark)
    got = license_scan.scan_licenses(docs)
    assert set(got.columns) == set(docs.columns) - {"blocks"} and got.count() == docs.count()
    row = got.filter(F.col("text").startswith("Licensed under CC")).first()["licenses"]
    assert [(x["line"], x["license"]) for x in row] == [(0, "CC-BY-NC-4.0"), (1, "MIT"), (2, None)]
    assert license_scan.scan_licenses(docs.limit(0)).count() == 0
    # Every planted line of the tables is found, and nothing else.
    lines = Counter()
    for _, t in pairs(documents(spark)):
        lines.update(n for n, x in names.items() for y in t.split("\n") if y.endswith(x))
    found = Counter()
    for r in license_scan.scan_licenses(documents(spark)).select("licenses").collect():
        found.update(x["license"] for x in r["licenses"])
    assert {k: n for k, n in found.items() if k} == lines


def test_pipeline_stages(spark, tmp_path):
    docs = documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        docs.write.parquet(str(tmp_path / name))
        before = spark.read.parquet(str(tmp_path / name))
        docs = stage(spark, before, SF)
        if name == "byte_bpe":
            assert docs.columns == [*before.columns, "token_ids"] and docs.count() == before.count()
            continue
        assert docs.columns == before.columns
        kept, given = dict(pairs(docs)), dict(pairs(before))
        assert set(kept) <= set(given) and len(kept) > 0.5 * len(given)
        if name == "near_duplicates":
            ids = sorted(given)
            roots = brute_components([brute_fingerprint(given[i]) for i in ids])
            assert set(kept) == {ids[r] for r in roots}
        if name == "decontamination":
            items = [fold(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            grams = {tuple(w[k : k + 10]) for w in items for k in range(len(w) - 9)}
            assert set(kept) == {d for d, t in given.items() if not any(tuple(fold(t)[k : k + 10]) in grams for k in range(len(fold(t)) - 9))}
        if name == "personal_data":
            assert set(kept) == set(given) and not any("@mail" in t for t in kept.values()) and any("[EMAIL]" in t for t in kept.values())
            assert all(kept[d] == t for d, t in given.items() if not re.search("[0-9]", t))
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_odd_rows_pass_the_pipeline(spark, tmp_path):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(ODD)] + [(None, None, None, None, None), (3, ODD[3], "en", "s", 2)], "doc_id long, text string, lang string, source string, n_chars long")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        sf = with_tables(spark, _new(tmp_path / f"sf{k}"), documents=docs)
        assert stage(spark, docs, sf).count() <= docs.count() and stage(spark, docs.limit(0), sf).count() == 0


def _new(path):
    path.mkdir()
    return path
