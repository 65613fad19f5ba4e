"""The registered queries opN_<name>: thin, over whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table, work_folder


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


def op2_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op3_rotation_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dups import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op5_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    from .resharding import rewritten

    out = rewritten(table(spark, sf_dir, "documents"), f"{work_folder(spark)}/op5-{uuid.uuid4().hex}")
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op6_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .piece_codec import encode_documents

    out = encode_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    out = pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


def op10_rans_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    from .rans import read_ids, write_ids

    path = f"{work_folder(spark)}/op10-{uuid.uuid4().hex}"
    write_ids(table(spark, sf_dir, "documents"), path, tokenizer_path("word_bpe_49k.json"))
    return read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import held_out, identify, train

    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~F.coalesce(held_out(), F.lit(False))), "text", "lang")
    out = identify(docs, model)
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .chat import format_conversations, read_conversations

    vocabulary, pattern = tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    out = read_conversations(format_conversations(turns, vocabulary, pattern), vocabulary, pattern)
    each = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(each, "").cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op9_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tiff import digests, read_media, store_texts

    stored = store_texts(table(spark, sf_dir, "documents"))
    return digests(read_media(stored, largest=F.col("n_bytes") + 64))  # as large as what was stored


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import LOWER, UPPER, manifest

    docs = table(spark, sf_dir, "documents")
    lowered = {"text": F.translate("text", UPPER, LOWER)}
    out = manifest(docs, claimed=lowered, doubted=F.crc32(docs["doc_id"].cast("string").cast("binary")) % 3 == 0)
    return out.drop("path")


def op12_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .grouping import pack_best_fit

    out = pack_best_fit(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return out.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op13_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lexical import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict:
    found = (op1_hyperminhash, op2_suffix_repeats, op3_rotation_codes, op4_language, op5_resharding, op6_piece_bpe, op7_chat, op8_packing, op9_tiff, op10_rans_ids, op11_merkle, op12_grouping, op13_threshold)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    from . import twins

    return {"op11_merkle": twins.merkle(), "op13_threshold": twins.ranked()}
