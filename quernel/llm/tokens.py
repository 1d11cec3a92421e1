"""Encoding of a whole corpus with the ranks of a public tokenizer."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.llm.bpe import Transducer, transducer
from quernel.session import ship, spread

#: File of ranks; a parameter of every operator. It need not be on the workers: the driver's goes there.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


#: Bytes of a vocabulary file that are broadcast; larger ones raise.
LARGEST = 64 << 20


def _vocabulary(spark: SparkSession, path: str) -> Callable[[], Transducer]:
    """How a worker gets its transducer: from its own file at the path, or else from the driver's, which is broadcast."""
    if not os.path.exists(path):
        return lambda: transducer(path)
    if os.path.getsize(path) > LARGEST:
        raise ValueError(f"{path} is larger than {LARGEST} bytes")
    sent = spark.sparkContext.broadcast(Path(path).read_bytes())
    return lambda: transducer(path, lambda: sent.value)


def encode_corpus(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """``key`` and ``ids`` (the token ids, ARRAY<INT>) of every row, one narrow pass without a shuffle.

    A null and an empty text have an empty list. Texts are encoded whole,
    however long; repeated rows and null keys come out as they are. Other
    columns are ignored, also one named ``ids``.
    """
    ship(df.sparkSession)
    held = _vocabulary(df.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = held().encode
        for batch in batches:
            lists = [np.array(encode(t), "int32") if t else np.empty(0, "int32") for t in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, lists)])
            flat = np.concatenate(lists) if lists else np.empty(0, "int32")
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["_key", "ids"])

    kind = df.schema[key].dataType.simpleString()
    return spread(df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))).mapInArrow(run, f"_key {kind}, ids array<int>").withColumnRenamed("_key", key)


def with_token_counts(df: DataFrame, text: str, vocabulary: str = VOCABULARY, name: str = "n_tokens") -> DataFrame:
    """``df`` without ``text`` and with its size in tokens (0 for null and empty texts); a column called ``name`` is replaced."""
    ship(df.sparkSession)
    held = _vocabulary(df.sparkSession, vocabulary)
    kept = df.drop(text, name) if name != text else df.drop(text)
    at = len(kept.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = held().encode
        for batch in batches:
            sizes = pa.array([len(encode(t)) if t else 0 for t in batch.column(at).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], sizes], [*batch.schema.names[:at], name])

    schema = kept.withColumn(name, F.lit(0).cast("long")).schema
    return spread(df.select(*kept.columns, F.col(text).alias("_text"))).mapInArrow(run, schema)


def decode_corpus(df: DataFrame, key: str, ids: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """``key`` and ``text`` of every row of ids, by the incremental state machine; null ids give an empty text."""
    ship(df.sparkSession)
    held = _vocabulary(df.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = held().decode
        for batch in batches:
            texts = pa.array(["".join(decode(x or ())) for x in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], ["_key", "text"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("_key"), F.col(ids).alias("_ids")).mapInArrow(run, f"_key {kind}, text string").withColumnRenamed("_key", key)
