"""One query per operator over its whole table: `opN_<name> -> f(spark, folder)`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lurewatch.llm import align, bpe, brown, decontaminate, hardneg, langid, mih, minhash, oracle, pii, quality, simhash, tokenfile, toxicity
from lurewatch.llm.common import documents, remainder, scratch
from lurewatch.session import shared_folder

Query = Callable[[SparkSession, str], DataFrame]
REGISTERED: dict[str, Query] = {}


def query(function: Query) -> Query:
    REGISTERED[function.__name__] = function
    return function


def joined_ids(ids: Column) -> Column:
    return F.array_join(ids.cast("array<string>"), ",")


@query
def op1_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text")
    found = decontaminate.find_benchmark(docs, documents(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.col("item_ids").cast("array<string>")), ","), 256).alias("items_sha256"),
        "contaminated",
    )


@query
def op2_nearest(spark: SparkSession, folder: str) -> DataFrame:
    return mih.nearest(documents(spark, folder, "embeddings").select("vec_id", "embedding"))


@query
def op3_brown(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text")
    held_out = remainder("doc_id", 7) == 2
    found = brown.score(docs, ~held_out)
    columns = ("doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
    return found.select("doc_id", held_out.alias("held_out"), *columns[1:])


@query
def op4_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text", "lang")
    model = langid.train(langid.training_rows(docs))
    found = langid.add_language(docs.select("doc_id", "text"), model)
    held_out = (remainder("doc_id", 3) == 1).alias("held_out")
    return found.select("doc_id", held_out, "lang_pred", "score", langid.rejected(model).alias("rejected"), "cross_entropy")


@query
def op5_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text")
    found = bpe.add_tokens(docs, bpe.public_path("byte_bpe_multi_50k.tiktoken"))
    return found.select(
        "doc_id", F.size("token_ids").cast("bigint").alias("n_tokens"),
        F.sha2(joined_ids(F.col("token_ids")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


@query
def op6_pii(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.add_personal_data(documents(spark, folder).select("doc_id", "text"))
    base = [k.name for k in pii.KINDS if k.base]

    def of(kind: str) -> Column:
        return F.size(F.filter("pii", lambda s: s.kind == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id", *[of(k) for k in base],
        F.sha2(spans_text(F.filter("pii", lambda s: s.kind.isin(base))), 256).alias("base_sha256"),
        spans_text(F.col("pii")).alias("spans"),
    )


@query
def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text")
    held_out = remainder("doc_id", 4) == 2
    lexicon = toxicity.learn(docs, documents(spark, folder, "labels"), "toxic", ~held_out)
    found = toxicity.add_score(docs, lexicon)
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text")
    held_out = remainder("doc_id", 5) == 0
    model = quality.train(docs, documents(spark, folder, "labels"), "quality", ~held_out)
    found = quality.add_score(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op9_token_output(spark: SparkSession, folder: str) -> DataFrame:
    target = shared_folder(spark, "token-ids")
    tokenfile.write_tokens(documents(spark, folder), bpe.public_path("byte_bpe_50k.json"), target)
    found = tokenfile.read_tokens(spark, target)
    return found.select("doc_id", "start", F.size("token_ids").cast("bigint").alias("n_tokens"), "ids_crc32")


@query
def op10_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, folder))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op11_align(spark: SparkSession, folder: str) -> DataFrame:
    paths = bpe.public_path("byte_bpe_50k.json"), bpe.public_path("piece_bpe_32k.model")
    aligned = align.align(documents(spark, folder).select("doc_id", "text"), *paths, written=True)
    digest = aligned.select(
        "doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"),
        F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256"), "pairs", "pair_links",
    )
    counted = align.add_link_counts(scratch(digest, "aligned"), align.pair_ids(*paths))
    return counted.drop("pairs", "pair_links")


@query
def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label")
    vectors = documents(spark, folder, "embeddings").select("vec_id", label, "embedding")
    return hardneg.hard_negatives(vectors, F.col("vec_id") % 100 == 0)


@query
def op13_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, folder))


def queries() -> dict[str, Query]:
    """In the order of the operators' numbers."""
    return dict(sorted(REGISTERED.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    return dict(oracle.SQL)
