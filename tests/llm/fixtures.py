"""Small tables with the odd cases, and readers of the driver's smallest tables."""

import os
import random

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "\n\n", "\t\x0b a", "A b C d e f g h i j k l m", "don't  won't 'S 'll  x", "　x  y zażółć 🙂🙂 w", "aaaa" * 300, " " * 40, "x " * 600, "same line\nsame line\nother\n\nsame line",
    "one two three one two three four one two three", "##$$ &&& <|end|> |", "mail a.b@c.d and a@b.c%d@e.f, x@y, @z.q", "ip 1.2.3.4.5 256.1.1.1 0001.002.3.4 9.9.9.9.9.9.9.9",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112, 12 34", "call +1 (414) 555-7134. or +49 30 1234567 +12 34", "😀 4111111111111111 é@x.y é+1 (414) 555-7134", "1 " * 400, "idiot " * 30,
    "0 " + "9" * 3000, "Licensed under CC BY-NC 4.0.\nReleased under the MIT License.\nno license here at all, none", "a b  c\x1fd \x85e",
]


def odd_documents(spark, n_random=60, clash=True):
    """Odd texts, repeated rows, a null key, random texts, and columns whose names operators use themselves."""
    rnd = random.Random(3)
    texts = ODD + ["".join(rnd.choice(["ab", " ", " ", "\n", "é", "1", "a", "the ", ".", "@x.y ", "+1 22 ", "🙂", "\\", "|", "<"]) for _ in range(rnd.randint(0, 120))) for _ in range(n_random)]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, "null key 7@x.y", None, None, None), (901, rows[5][1], "en", "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    if clash:
        for c in ("row", "doc", "spans", "shard", "slot", "bucket", "rules", "quality", "blocks", "licenses", "overlap", "score", "toxicity", "token_ids", "fingerprint", "words", "lines", "entry", "kept_key", "trusted_id", "pii_spans", "pii_spans_kept", "key"):
            df = df.withColumn(c, F.lit("mine"))
    return df


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def pairs(df):
    """(doc_id, text) of all rows."""
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def with_tables(spark, folder, **tables):
    """A folder that looks like the driver's, with some tables of our own and the others linked."""
    for name in ("documents", "benchmark", "labels", "conversations"):
        target = os.path.join(folder, f"{name}.parquet")
        if name in tables:
            tables[name].write.parquet(target)
        else:
            os.symlink(f"{SF}/{name}.parquet", target)
    return str(folder)
