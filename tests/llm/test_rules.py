"""Operators in DataFrame functions against brute force: quality rules, sharding, personal data, chat format."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from fixtures import SF, documents, odd_documents, pairs, with_tables
from pyspark.sql import functions as F

from ratertrail.llm import chat_format, pii, quality, queries, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rules(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    seen, at = set(), defaultdict(list)
    dup = sum(1 for x in lines if x in seen or seen.add(x))
    for i in range(len(words) - 2):
        at[tuple(words[i : i + 3])].append(i)
    hit = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit)


@pytest.mark.parametrize("source", ["odd", "small"])
def test_quality_rules(spark, source):
    docs = odd_documents(spark) if source == "odd" else documents(spark)
    got = Counter(tuple(r) for r in quality.rule_counts(docs).select("doc_id", "rules.*").collect())
    assert got == Counter((d, *rules(t)) for d, t in pairs(docs))


def test_quality_likelihood(spark):
    docs, labels = documents(spark), spark.read.parquet(f"{SF}/labels.parquet")
    trusted = {r[0] for r in labels.filter("quality = 1").select("doc_id").collect()}
    grams = {r["doc_id"]: r["b"] for r in docs.select("doc_id", quality.ngram_buckets(quality.token_hashes(F.col("text"))).alias("b")).collect()}
    every, good = Counter(), Counter()
    for d, b in grams.items():
        every.update(b)
        if d in trusted:
            good.update(b)
    n, m = sum(every.values()) + quality.BUCKETS, sum(good.values()) + quality.BUCKETS
    weight = {b: round(math.log((good[b] + 1) / m / ((every[b] + 1) / n)) * quality.UNITS) for b in every}
    for r in quality.score_corpus(docs, labels).select("doc_id", "quality.*").collect():
        b = grams[r["doc_id"]]
        assert r["n_grams"] == len(b) and abs(r["llr"] - sum(weight[x] for x in b) / max(1, len(b))) <= 2
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert r["kept"] == (not r["base_failed"] and r["llr"] >= quality.THRESHOLD)


def test_quality_grams_are_tokens_and_pairs(spark):
    row = spark.createDataFrame([("The cat!! THE cat",), ("",), (None,)], "text string").select(F.size(quality.ngram_buckets(quality.token_hashes(F.col("text")))).alias("n"), F.size(F.array_distinct(quality.ngram_buckets(quality.token_hashes(F.col("text"))))).alias("d")).collect()
    assert [tuple(r) for r in row] == [(9, 6), (0, 0), (0, 0)]


def test_quality_odd_rows_and_empty_tables(spark):
    docs, labels = odd_documents(spark), spark.createDataFrame([(1, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int")
    assert quality.score_corpus(docs, labels).count() == docs.count()
    assert quality.score_corpus(docs.limit(0), labels).count() == 0
    assert {r["llr"] for r in quality.score_corpus(docs, labels.limit(0)).select("quality.llr").collect()} == {0}


@pytest.mark.parametrize("least", [1, 7])
def test_sharding(spark, least):
    docs = odd_documents(spark)
    out = sharding.shuffled_shards(docs, least=least, bucket_bytes=4000).cache()
    rows = out.collect()
    assert Counter((r["doc_id"], r["text"], r["row"]) for r in rows) == Counter((d, t, "mine") for d, t in pairs(docs))
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert set(by) == set(range(16)) and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    again = sharding.shuffled_shards(docs.repartition(5), least=least, bucket_bytes=4000)
    key = lambda df: sorted((str(r["doc_id"]), str(r["text"]), r["shard"], r["slot"]) for r in df.collect())
    assert key(again) == key(out)
    assert key(sharding.shuffled_shards(docs, least=least, bucket_bytes=4000, seed=5)) != key(out)
    assert sharding.shuffled_shards(docs.limit(0)).count() == 0 and sharding.shuffled_shards(docs.limit(1)).count() == 1


def test_sharding_query_and_files(spark, tmp_path):
    rows = queries.op5_sharding(spark, SF).collect()
    texts = dict(pairs(documents(spark)))
    assert len(rows) == len(texts)
    for r in rows:
        assert r["size"] == len(texts[r["doc_id"]].encode()) + 1 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode())
    # A permutation worth the name: ids neither rise nor fall along it.
    order = [r["doc_id"] for r in sorted(rows, key=lambda r: (r["shard"], r["slot"]))]
    assert 0.35 < sum(a < b for a, b in zip(order, order[1:])) / len(order) < 0.65
    sharding.write_shards(sharding.shuffled_shards(documents(spark)), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(texts) and back.select("shard").distinct().count() == 16


def base_spans(text):
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, "email", m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 12 <= len(d) <= 19 and (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0:
            out.append((m.start(), 2, "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, "phone", m.end()))
    return sorted(out)


def named(spans):
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)


def test_personal_data_base(spark, tmp_path):
    odd = odd_documents(spark, 200)
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars").unionByName(documents(spark).withColumn("doc_id", F.col("doc_id") + 10_000))
    sf = with_tables(spark, tmp_path, documents=docs)
    got = queries.op9_pii(spark, sf).collect()
    want = Counter()
    for d, t in pairs(docs):
        spans = base_spans(t)
        n = Counter(s[2] for s in spans)
        want[d, n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(named(spans).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in got) == want
    for r in got:
        assert len([x for x in r["spans"].split(",") if x and not x.startswith("id:")]) == r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"]
    assert pii.find_spans(odd).count() == odd.count() and pii.find_spans(odd.limit(0)).count() == 0


def test_personal_data_bootstraps_and_masks(spark):
    known = [f"please reach customer account 4{i:02d}" for i in range(0)]
    rows = [f"her contact is {m} today" for m in ("a1@x.org", "b2@y.org", "c3@z.org", "d4@w.org")]
    rows += ["his contact is Q77-PLM-2210 today", "the year was 1999-2001b or so", "chapter 12", *known, None, "no digits", "contact is a1@x.org today a1@x.org"]
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(rows)], "doc_id long, text string, n_chars long")
    spans = {r["doc_id"]: r["s"] for r in pii.find_spans(docs).select("doc_id", pii.written(F.col("spans")).alias("s")).collect()}
    assert spans[4] == "id:15:27" and spans[5] == spans[6] == spans[7] == spans[8] == "" and spans[9] == "email:11:19,email:26:34"
    out = {r["doc_id"]: (r["text"], r["n_chars"]) for r in pii.mask(docs).collect()}
    assert out[4] == ("his contact is [ID] today", 25) and out[9][0] == "contact is [EMAIL] today [EMAIL]" and out[7] == (None, 5) and out[8] == ("no digits", 5)


def test_masking_matches_brute_force(spark):
    docs = odd_documents(spark, 150).filter("doc_id is not null").dropDuplicates(["doc_id"])
    spans = {r["doc_id"]: r["s"] for r in pii.find_spans(docs, into="s").select("doc_id", "s").collect()}
    got = dict(pairs(pii.mask(docs)))
    for d, t in pairs(docs):
        if t is None:
            assert got[d] is None
            continue
        kept = []
        for s in spans[d]:
            if kept and s["start"] < kept[-1][1]:
                kept[-1][1] = max(kept[-1][1], s["end"])
            else:
                kept.append([s["start"], s["end"], s["kind"]])
        for a, b, k in reversed(kept):
            t = t[:a] + f"[{k.upper()}]" + t[b:]
        assert got[d] == t


def test_chat_format(spark, tmp_path):
    tricky = ["<|end|>\n", "\\", "<\\|", "a<", "|b", "<|turn|>user<|text|>", None, "", "x" * 9000, "\\### Assistant: </turn> ok", "🙂<|"]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(tricky)]
    rows += [(2, 0, "system", "be <|good|>"), *[(2, i, "assistant" if i % 2 else "user", f"turn {i} " + "w" * (i * 37 % 900)) for i in range(1, 80)]]
    rows += [(3, None, None, None), (3, 1, "assistant", "dup"), (3, 1, "assistant", "dup"), (None, 0, "assistant", "no id"), (4, 0, "we|rd<|", "r")]
    convs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for n, table in enumerate([convs, spark.read.parquet(f"{SF}/conversations.parquet"), convs.limit(0)]):
        (folder := tmp_path / str(n)).mkdir()
        got = {r["conv_id"]: r for r in queries.op10_chat_format(spark, with_tables(spark, folder, conversations=table)).collect()}
        want = defaultdict(list)
        for r in [*table.collect(), (-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]:
            want[r[0]].append((r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        assert set(got) == set(want)
        for c, turns in want.items():
            turns.sort()
            told = "".join(f"{r}\n{t}\n" for *_, r, t in turns)
            learnt = "".join(t for *_, r, t in turns if r == "assistant")
            g = got[c]
            assert (g["n_turns"], g["turns_sha256"]) == (len(turns), hashlib.sha256(told.encode()).hexdigest())
            assert (g["loss_chars"], g["loss_sha256"]) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    out = chat_format.windows(convs.filter("conv_id = 2")).orderBy("window").collect()
    assert len(out) > 3 and all("be <\\|good\\|>" not in r["formatted"] and r["formatted"].startswith("<|turn|>system<|text|>be <\\|good|>") for r in out)
    assert all(r["n_repeated"] >= 1 for r in out[1:]) and any(r["n_repeated"] > 1 for r in out[1:])
    assert sum(r["n_turns"] - r["n_repeated"] for r in out) == 80


@pytest.mark.parametrize("budget, history", [(1024, 192), (200, 60), (60, 50)])
def test_windows_keep_their_budget(spark, budget, history):
    """No window is over it unless it holds one turn beside the system turn; history stays within its limit and is what came just before."""
    rnd = random.Random(budget)
    rows = []
    for c in range(12):
        system = c % 3 == 0
        for i in range(rnd.choice([1, 5, 60])):
            n = rnd.choice([0, 10, 99 * 4, rnd.randrange(1200), 9000 if rnd.random() < 0.1 else 3])
            rows.append((c, i, "system" if system and i == 0 else ("user", "assistant")[i % 2], f"{i} " + "t" * (1200 if c == 6 and i == 0 else n)))
    # The system turn of 304 tokens beside turns of 99 of the verdict's example.
    rows += [(99, 0, "system", "s" * 1200)] + [(99, i, ("user", "assistant")[i % 2], "u" * 380) for i in range(1, 40)]
    convs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    tokens = {(c, i): -(-len(t) // 4) + chat_format.MARKS for c, i, _, t in rows}
    order = defaultdict(list)
    for c, i, *_ in rows:
        order[c].append(i)
    seen = defaultdict(list)
    numbered = convs.withColumn("text", F.concat_ws("", F.col("turn"), F.lit(":"), "text"))
    size = lambda c, i: -(-len(f"{i}:" + next(t for a, b, _, t in rows if (a, b) == (c, i))) // 4) + chat_format.MARKS
    sizes = {at: size(*at) for at in tokens}
    for r in chat_format.windows(numbered, budget, history).orderBy("conv_id", "window").collect():
        c = r["conv_id"]
        turns = [int(x.split("<|text|>")[1].split(":")[0]) for x in r["formatted"].split("<|turn|>")[1:]]
        old, new = turns[: r["n_repeated"]], turns[r["n_repeated"] :]
        has_system = any(a == c and role == "system" for a, _, role, _ in rows)
        past = [i for i in old if not (has_system and i == 0)]
        assert sum(sizes[c, i] for i in past) <= history and past == order[c][new[0] - len(past) : new[0]]
        assert not has_system or turns[0] == 0
        total = sum(sizes[c, i] for i in turns)
        assert total <= budget or (len(new) == 1 and not past), (c, turns, total)
        seen[c] += new
    assert seen == order


def test_chat_format_starts_no_python_worker(spark):
    plan = queries.op10_chat_format(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ExistingRDD" not in plan


def test_repeated_rows_scatter(spark, monkeypatch):
    """Rows that are all alike fill all buckets about equally, and none is lost."""
    docs = spark.range(60_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same text").alias("text")).unionByName(spark.range(3000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text")))
    sizes = []
    monkeypatch.setattr(sharding, "_offsets", lambda counts, own=sharding._offsets: sizes.extend(r["n"] for r in counts.collect()) or own(counts))
    out = sharding.shuffled_shards(docs)
    per = out.groupBy("shard").agg(F.count("*").alias("n"), F.count_distinct("slot").alias("slots"), F.max("slot").alias("last"), F.count_if(F.col("doc_id").isNull()).alias("alike")).collect()
    assert sum(r["n"] for r in per) == 63_000 and max(r["n"] for r in per) - min(r["n"] for r in per) <= 1 and all(r["slots"] == r["n"] == r["last"] + 1 for r in per)
    assert len(sizes) == 64 and max(sizes) < 1.3 * 63_000 / 64 and all(3400 < r["alike"] < 4000 for r in per)
    assert out.filter("doc_id is not null").select("doc_id", "text").distinct().count() == 3000
