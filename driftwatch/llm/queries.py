"""The queries ``opN_<name>``: every operator over its whole tables, with the digest columns that its contract asks for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwatch.llm import bloom_lm, chat, checking_sql, decontaminate, jaccard_join, kneser_ney, line_dedup, packing, perplexity_rules, phrases, sharding, spelling, toxicity, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {"op3_chat_format": checking_sql.OP3, "op10_line_dedup": checking_sql.OP10}


def _query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@_query
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens in sequences of at most 2048."""
    pieces = packing.pack(table(spark, sf_dir, "documents"), vocabulary())
    return pieces.select(
        F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"),
        F.col("example_tokens").alias("doc_tokens"), "sequence_id", "offset", "loss_tokens",
    )


@_query
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of equal row counts."""
    text = F.coalesce("text", F.lit(""))
    dealt = sharding.external_shuffle(table(spark, sf_dir, "documents"), 8)
    return dealt.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as one JSON record: a prompt with its response, a system line with its conversation, or messages."""
    said = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-7).cast("long"), "id", F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(said))
    turns = rows.unionAll(more).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    roles = F.transform("t", lambda t: t["role"])
    rest = F.slice("t", F.lit(2), F.size("t"))
    plain = lambda r: F.forall(r, lambda t: F.coalesce(t["role"].isin("user", "assistant"), F.lit(False)))
    text = lambda k: F.coalesce(F.get("t", F.lit(k))["text"], F.lit(""))
    pair = F.to_json(F.struct(text(0).alias("prompt"), text(1).alias("response")))
    shared = lambda t: F.struct(F.when(t["role"] == "user", "human").otherwise("gpt").alias("from"), F.coalesce(t["text"], F.lit("")).alias("value"))
    system = F.to_json(F.struct(text(0).alias("system"), F.transform(rest, shared).alias("conversations")))
    messages = F.to_json(F.struct(F.transform("t", lambda t: F.struct(t["role"].alias("role"), F.coalesce(t["text"], F.lit("")).alias("content"))).alias("messages")))
    return turns.select(
        "conv_id",
        F.when(roles == F.array(F.lit("user"), F.lit("assistant")), pair)
        .when((F.get(roles, F.lit(0)) == "system") & (F.size("t") > 1) & plain(rest), system).otherwise(messages).alias("record"),
    )


@_query
def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted, and what is read back from the result."""
    made = chat.format_chat(chat.canonical_turns(_records(spark, sf_dir)))
    turns = chat.read_turns(F.col("formatted"))
    loss = chat.read_loss(F.col("formatted"), F.col("loss_spans"))
    said = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return made.select("conv_id", "layout", "formatted", turns.alias("read"), loss.alias("loss")).select(
        "conv_id", F.size("read").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "layout",
    )


@_query
def op4_phrase_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return phrases.fingerprint_edits(table(spark, sf_dir, "documents"))


@_query
def op5_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's probability under the model learned from folds other than 1."""
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 1
    return bloom_lm.score_documents(table(spark, sf_dir, "documents"), held_out)


@_query
def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component and number of links of every document."""
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


@_query
def op7_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of every document, and whether it stays below its language's threshold."""
    return kneser_ney.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; the model learns from the labels outside fold 0."""
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@_query
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with that item."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("row_key")


@_query
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that five documents or more hold, but for the last holder."""
    kept = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def _slip(doc_id: Column, word: Column) -> Column:
    """A word that loses one code point where 31 divides the checksum of ``<doc_id>:<word>``."""
    h = F.crc32(F.concat(doc_id.cast("string"), F.lit(":"), word))
    at = F.pmod(h, F.length(word)).cast("int")
    shorter = F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))
    return F.when(h % 31 == 0, shorter).otherwise(word)


@_query
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of seven letters or more that stands twice or more, its near words, form and root."""
    words = spelling.count_words(table(spark, sf_dir, "documents"), alter=_slip, removes=1)
    return spelling.variants(words).select("word", "form", "root", "n", "n_near", "form_n")


@_query
def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable vector on up to 32 whitened principal components."""
    rows = whitening.usable(table(spark, sf_dir, "embeddings"))
    return whitening.whitened_rows(rows).withColumnRenamed("id", "vec_id")


@_query
def op13_perplexity_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule measures of every document, and whether its perplexity lies in the band of its language."""
    judged = perplexity_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", *perplexity_rules.MEASURES, "base_failed", "kept", "n_signs", "log10_p", "low", "high")
