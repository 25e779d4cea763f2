"""From documents to packed training sequences: language, exact and near duplicates, mixture, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm import exact_dedup, language_id, mixing, near_dedup, packing
from evidentia.llm._tables import materialise, quoted, small, table

#: Below this posterior probability no language is accepted.
SURE = 0.5
#: So many standard deviations below the likelihood that is usual in its language, a text isn't in that language.
DEVIATIONS = 6
#: Share of the tokens that the mixture draws, and the power that tempers natural shares to targets.
FRACTION, POWER = 0.5, 0.5


def _carried(docs: DataFrame, but: str | None = None) -> dict:
    """The columns of docs under numbers, as names of columns may hold anything."""
    return {f"carried_{k}": F.col(quoted(c)) for k, c in enumerate(docs.columns) if c != but}


def _as_documents(found: DataFrame, docs: DataFrame, but: str | None = None) -> DataFrame:
    return found.select(*[F.col(c if c == but else f"carried_{k}").alias(c) for k, c in enumerate(docs.columns)])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model learned from the labels; no text, no letters, no clear language,
    or less likely n-grams than labelled texts of that language have: out. Without any labelled row nothing can be
    learned, and all documents that have a letter stay."""
    apart = language_id.held_out(F.col("doc_id"))
    model = language_id.fit(docs.where(~apart))
    expected = language_id.expectations(docs.where(apart), model)
    if not model.langs:
        return docs.where(F.regexp_like("text", F.lit(r"\p{L}")))
    found = language_id.identify(docs, model, with_text=True, **_carried(docs, but="text"))
    clear = (F.col("lang_pred") != "und") & (F.col("score") >= SURE)
    return _as_documents(found.where(clear & language_id.plausible(expected, DEVIATIONS)), docs, but="text")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of identical texts, that of the largest id; null texts count as empty."""
    return _as_documents(exact_dedup.exact_duplicates(docs, **_carried(docs)).where("kept"), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates: shingles of five words, similarity 0.8
    or more. Documents without words have no duplicates; rows that share an id and are not of the smallest go together.
    Rows without an id can't be told from each other here, so they always stay."""
    found = near_dedup.near_duplicates(docs, shingle=5, threshold=0.8)
    gone, seen = materialise(found.where("not kept").select("doc_id"))
    return docs.join(small(gone, seen["rows"], 8), "doc_id", "left_anti").select(*[quoted(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that sources, languages and topics come near their target shares. Null columns are a value
    of their own; rows that share an id are drawn or left together."""
    return _as_documents(mixing.mix(docs, fraction=FRACTION, power=POWER, **_carried(docs)).where("kept"), docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences; every row is a document of its own, without text it is the end token alone."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Language scores, near duplicates and tokens have no SQL; the tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs, _ = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
