"""One query per operator over the whole of its table, with SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratertrail.llm import byte_bpe, chat_format, decontaminate, license_scan, pii, quality, sharding, simhash, spelling, token_counts, toxicity, url_rules, whitening
from ratertrail.queries.registry import query

RANK_FILE = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_license_scan")
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses of every document, by its candidate blocks."""
    found = license_scan.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    named = F.filter("licenses", lambda x: x["license"].isNotNull())
    return found.select(
        "doc_id",
        F.size("licenses").cast("long").alias("n_blocks"),
        F.size(named).cast("long").alias("n_confirmed"),
        F.array_join(F.sort_array(F.array_distinct(F.transform(named, lambda x: x["license"]))), ",").alias("licenses"),
        F.array_join(F.transform("licenses", lambda x: F.concat_ws(":", x["line"], x["leader"], x["differing"])), ",").alias("blocks"),
    )


@query("op2_token_counts")
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token counts of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.count_tokens(docs, RANK_FILE, PATTERN)
    return counted.select("doc_id", F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"), "n_tokens")


@query("op3_byte_bpe")
def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every document, and what they decode to."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = docs.select("doc_id", byte_bpe.round_trip(F.col("text"), RANK_FILE, PATTERN).alias("trip")).select("doc_id", "trip.*")
    return out.select(
        "doc_id",
        F.floor(F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op4_quality_rules")
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules and likelihood ratio of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.score_corpus(docs, table(spark, sf_dir, "labels")).select("doc_id", "quality.*")


@query("op5_sharding")
def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document."""
    out = sharding.shuffled_shards(table(spark, sf_dir, "documents"))
    text = F.coalesce("text", F.lit(""))
    return out.select(
        "doc_id",
        sharding.row_bytes(F.col("text")).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op6_decontamination")
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside windows of benchmark items, and the items."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_overlaps(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "overlap.*")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


@query("op7_simhash")
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fingerprint")).alias("fingerprint"), "component_id")


@query("op8_toxicity")
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from labels that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = toxicity.train(*toxicity.training_sample(docs, table(spark, sf_dir, "labels"), ~toxicity.held_out(F.col("doc_id"))))
    scored = toxicity.score(docs, net)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


@query("op9_pii")
def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    found = pii.find_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != pii.FOUND)
    return found.select("doc_id", *[count(k) for k in pii.KINDS], F.sha2(pii.written(base), 256).alias("base_sha256"), pii.written(F.col("spans")).alias("spans"))


@query("op10_chat_format")
def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations, and of one that holds control strings, read back from their windows."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    # Conversation -7 is made from values, so that no Python worker starts for it.
    more = spark.sql("select * from values (-7, 0, 'user'), (-7, 1, 'assistant') as v(conv_id, turn, role)").withColumn("text", F.lit(r"\### Assistant: </turn> ok"))
    more = more.select(*[F.col(f.name).cast(f.dataType) for f in given.schema])
    return chat_format.digests(chat_format.windows(given.unionByName(more)))


@query("op11_spelling_variants")
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of all documents with its near words, its form and the end of its forms."""
    return spelling.variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: The rules that pages are judged by.
URL_RULES = "values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')"


@query(
    "op12_url_filters",
    f"""
    with rules(r_host, r_path, r_verdict) as ({URL_RULES}),
    cut as (
        select page_id, row_number() over () as row, case when instr(url, '://') > 0 then substring(url, instr(url, '://') + 3) else '' end as rest
        from pages
    ),
    parts as (
        select page_id, row, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
               regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
        from cut
    ),
    best as (
        select row, max_by(r_host || r_path, length(r_host || r_path)) as rule, max_by(r_verdict, length(r_host || r_path)) as verdict
        from parts join rules on (host = r_host or ends_with(host, '.' || r_host)) and starts_with(path, r_path)
        group by row
    )
    select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from parts left join best using (row)
    """,
)
def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule and the verdict of every page's URL."""
    rules = spark.sql(f"select * from ({URL_RULES}) as rules(host, path, verdict)")
    judged = url_rules.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return judged.select("page_id", "judged.*")


@query("op13_embedding_whitening")
def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened coordinates of every embedding."""
    white = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return white.withColumn("deviation", F.expr("try_cast(deviation as long)"))
