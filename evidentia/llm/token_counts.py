"""Token counts of texts through a cache of digests: what was counted once is never encoded again."""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Callable, Iterator
from importlib.metadata import version
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as T
from ._tables import materialise, shared_dir, small

#: Bytes of text that a task encodes in one call.
CALL = 1 << 22
CACHE = "digest binary, n_tokens long"
#: Library that reads a vocabulary file, by the file's ending.
LIBRARIES = {".json": "tokenizers", ".model": "sentencepiece"}

_loaded: dict[str, Callable[[list[str]], list[int]]] = {}


def normalised(text: Column) -> Column:
    """What is digested and encoded: null is empty, and nothing else may change, as every byte can change a count."""
    return F.coalesce(text.cast("string"), F.lit(""))


def _library(path: str) -> str:
    ending = Path(path).suffix
    if ending not in LIBRARIES:
        raise ValueError(f"a vocabulary ends in one of {sorted(LIBRARIES)}: {path}")
    return LIBRARIES[ending]


def tokenizer_version(path: str) -> str:
    """Digest of all that counts depend on besides the text: the vocabulary file and the library with its release."""
    found = hashlib.sha256(f"{_library(path)} {version(_library(path))}\n".encode())
    found.update(Path(path).read_bytes())
    return found.hexdigest()


def counter(path: str) -> Callable[[list[str]], list[int]]:
    """Counts tokens of texts, without tokens at their begin or end; loaded once in a worker."""
    if path not in _loaded:
        if _library(path) == "tokenizers":
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            _loaded[path] = lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]
        else:
            from sentencepiece import SentencePieceProcessor

            pieces = SentencePieceProcessor(model_file=path)
            _loaded[path] = lambda texts: [len(x) for x in pieces.encode(texts, num_threads=1)]
    return _loaded[path]


def _encoding(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # rows that repeat an id may bring one text more than once
            first = np.sort(np.unique(np.array(batch.column("digest").to_pylist(), dtype=object).astype("S32"), return_index=True)[1])
            rows = batch.take(pa.array(first))
            size = pa.compute.binary_length(rows.column("text")).to_numpy(zero_copy_only=False)
            for i, j in T.slices(np.concatenate([[0], np.cumsum(size)]), CALL):
                counts = counter(path)(rows.column("text").slice(i, j - i).to_pylist())
                yield pa.RecordBatch.from_arrays([rows.column("digest").slice(i, j - i), pa.array(counts, pa.int64())], names=["digest", "n_tokens"])

    return run


def _stored(spark: SparkSession, folder: str) -> DataFrame:
    """The cache of one tokenizer version: one row a digest, also where two runs have added the same text."""
    return spark.read.schema(CACHE).parquet(folder).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512, cache: str | None = None) -> DataFrame:
    """Tokens of every whole text, as the vocabulary's library counts them by default, without begin and end tokens.

    Digest cache: the cache is a folder of Parquet files for each tokenizer version, of rows (digest, n_tokens)
    that are only ever added. Texts become digests once; digests are counted and joined to the cache. Texts that
    neither the cache holds nor an earlier row shows are encoded, each once, and added; then all rows take their
    count from the cache. Texts never move while the digests that must be skipped (stored, or shown by several
    rows) are few enough to broadcast, which is counted first; beyond that they are joined in a shuffle.
    A run that fails leaves whole rows or none, and a later run goes on from there.

    tokenizer is the path of a vocabulary (.json: tokenizers, .model: sentencepiece) on every machine. cache is
    a folder in a store that all executors reach; without one, the run has a new cache in the shared folder.
    docs needs doc_id (long) and text; other columns are ignored. Null texts count as empty and have no
    tokens; ids may be null or repeat, each row is counted. An empty table gives no rows.
    Returns one row per row of docs: doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than limit tokens).
    """
    spark = docs.sparkSession
    folder = f"{(cache or f'{shared_dir(spark)}/token-counts-{uuid.uuid4().hex}').rstrip('/')}/tokenizer={tokenizer_version(tokenizer)}"
    spark.createDataFrame([], CACHE).write.mode("append").parquet(folder)
    body = normalised(F.col("text"))
    digest = F.unhex(F.sha2(body.cast("binary"), 256))
    rows, _ = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(body).cast("long").alias("n_bytes"), digest.alias("digest")))
    texts = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("times"), F.min("doc_id").alias("first"))
    stored = _stored(spark, folder).select("digest", F.lit(True).alias("is_stored"))
    skip = texts.join(stored, "digest", "left").where("is_stored or times > 1")
    skip, seen = materialise(skip.select("digest", "first", F.coalesce("is_stored", F.lit(False)).alias("is_stored"), F.lit(True).alias("listed")))
    asked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body.alias("text"), digest.alias("digest"))
    asked = asked.join(small(skip, seen["rows"], 64), "digest", "left")
    misses = asked.where("listed is null or (not is_stored and doc_id <=> first)").select("digest", "text")
    misses.mapInArrow(_encoding(tokenizer), CACHE).write.mode("append").parquet(folder)
    counts, _ = materialise(texts.select("digest").join(_stored(spark, folder), "digest"))
    return rows.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
