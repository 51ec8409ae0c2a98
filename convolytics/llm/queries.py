"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convolytics.llm import ann, chat, decontam, html_text, jaccard, langid, mixing, phrases, piece_bpe, repair, token_count, toxicity, warc
from convolytics.llm.common import scratch, table
from convolytics.llm.oracles import ORACLE_SQL as ORACLE_SQL


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers  # only where it is needed: the other queries do without

    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return token_count.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents", "doc_id", "text", "lang")).select("doc_id", "held_out", "lang_pred", "score")


def chat_log(rows: DataFrame) -> DataFrame:
    """An event log that folds into the rows (conv_id, turn, role, text): each is a message with a reference of its own,
    whose text comes as two deltas; by turn also after a draft that is edited or regenerated."""
    half = F.floor(F.length("text") / 2).cast("int")
    first, second = F.substring("text", F.lit(1), half), F.substring("text", half + 1, F.length("text"))

    def log(*events: tuple[str, Column]) -> Column:
        return F.array(*[F.struct(F.lit(i).alias("i"), F.lit(kind).alias("kind"), text.cast("string").alias("text")) for i, (kind, text) in enumerate(events)])

    none, draft, way = F.lit(None), F.lit("draft"), F.pmod(F.col("conv_id") + F.col("turn"), F.lit(3))
    plain = log(("message", none), ("delta", first), ("delta", second))
    edited, again = log(("message", draft), ("edit", first), ("delta", second)), log(("message", draft), ("regenerate", none), ("delta", first), ("delta", second))
    events = F.when(F.col("turn").isNull(), log(("message", F.col("text")))).when(way == 1, edited).when(way == 2, again).otherwise(plain)
    rows = rows.withColumn("ref", F.monotonically_increasing_id().cast("string")).select("conv_id", "turn", "ref", "role", F.explode(events).alias("e"))
    return rows.select("conv_id", (F.col("turn").cast("long") * 4 + F.col("e.i")).alias("seq"), "e.kind", "ref", "role", "e.text")


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string"))
    return chat.read_back(chat.format_chats(chat_log(rows)), ordered=True)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return toxicity.score(docs, table(spark, sf_dir, "labels", "doc_id", "toxic")).select("doc_id", "held_out", "score", "predicted")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages", "page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers  # only where it is needed: the other queries do without

    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return piece_bpe.round_trip(docs, public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return ann.knn(vectors, vectors.where("vec_id % 100 = 0")).select("query_id", "rank", "vec_id", "score")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    found = decontam.decontaminate(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    warc.write(table(spark, sf_dir, "pages", "page_id", "url", "html"), path)
    return warc.read(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "n_shingles", "component_id")


def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.report_damaged(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_language_id, op3_chat_formatting, op4_toxicity, op5_html_extraction, op6_sentencepiece, op7_nearest_neighbours,
        op8_decontamination, op9_warc, op10_jaccard_join, op11_phrase_mining, op12_conversation_repair, op13_source_mixing,
    )
}
