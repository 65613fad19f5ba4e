"""The corpus pipeline: language ID, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and read
again as the next stage's docs. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnfold import ship
from tarnfold.llm.language import identify, train
from tarnfold.llm.minhash import near_duplicates
from tarnfold.llm.packing import pack_documents
from tarnfold.llm.queries import tokenizer_path
from tarnfold.llm.shared import discard, table, written
from tarnfold.llm.suffix_dedup import remove_repeats

#: A document goes if its language is undetermined or the winner's score is below this.
LEAST_SCORE = 0.2


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose text is recognised as a language; fills a null ``lang`` with it.

    A null text, one without letters and one below ``LEAST_SCORE`` go. Where no document has a ``lang`` to learn from, nothing can be rejected
    and all documents stay. Null and repeated keys and repeated rows are rows like any other. Texts of any
    length count as a whole. An empty table stays empty; further columns stay, those of the names lang_pred and score too.
    """
    ship(spark)
    model = train(docs, "text", "lang")
    if model is None:
        return docs
    packed = docs.select("text", F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    kept = identify(packed, model, keep=True).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return kept.select(*[(F.coalesce(F.col("row.lang"), "lang_pred") if c == "lang" else F.col("row").getField(c)).alias(c) for c in docs.columns])


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest doc_id of each group of near-duplicates (5 words, 0.8), once.

    Documents without words are alike nobody and stay, as do those of a null doc_id; of rows that repeat doc_id and text one
    stays. An empty table stays empty; all columns stay. Several texts of one doc_id stay or go together.
    """
    ship(spark)
    groups = near_duplicates(docs).where("kept and doc_id is not null").select("doc_id").distinct()
    kept = docs.join(groups, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.unionByName(docs.where("doc_id is null")).select(docs.columns)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 200 bytes and more that occur elsewhere; drops documents of which nothing is left.

    Cuts fall between bytes; a character that a cut would split goes whole, so texts stay valid. Every occurrence is
    cut, and equal rows are occurrences of each other. Null and shorter texts and null keys stay as they are; an empty table stays
    empty; all columns stay, and ``n_chars`` follows a text that was cut.
    """
    ship(spark)
    packed = docs.select("text", F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    out = remove_repeats(packed, key="text", keep=True)
    cut = F.col("n_removed") > 0
    changed = {"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("long")}
    columns = [(F.when(cut, changed[c]).otherwise(F.col("row").getField(c)) if c in changed else F.col("row").getField(c)).alias(c) for c in docs.columns]
    return out.where(~cut | (F.octet_length("kept_text") > 0)).select(*columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences' pieces, as op8_packing returns them.

    A null or empty text is its end id alone; null and repeated keys and repeated rows are documents of their own; an
    empty table gives no pieces; further columns are ignored.
    """
    ship(spark)
    out = pack_documents(docs, tokenizer_path("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


STAGES = [("language", language), ("near_duplicate", near_duplicate), ("repeats", repeats), ("packing", packing)]

#: SQL cannot express the stages (a trained model, connected components, a tokenizer).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each stage's table goes when the next one is written, the last one's with the session."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
