"""8 Token counts: a digest cache.

The digest of a text and the digest of the tokenizer file make a key. Keys are joined to the stored counts;
only the distinct texts without a stored count are encoded, and their counts are appended to the store, in
the shared folder. Encoding runs on Arrow batches: a text is cut before every run of blanks, where no merge of a
sentence-piece BPE vocabulary can reach across (checked against the vocabulary when it is loaded), and the
counts of pieces are kept in a bounded table, so frequent words are encoded once per worker.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelens.llm.common import blank, byte_length, shared_dir, table

MODEL = "piece_bpe_32k.model"
#: Entries of the table of piece counts; it is emptied when full, which costs time but changes no count.
TABLE_SIZE = 400_000
BATCH_BYTES = 8_000_000
STORE_SCHEMA = "text_digest string, tokenizer_digest string, n_tokens long"


def tokenizer_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


class PieceCounts(dict):
    """Tokens of a piece: a run of blanks and what follows it up to the next blank."""

    def __init__(self, encode: Callable[[str], list]):
        self.encode = encode

    def __missing__(self, piece: str) -> int:
        if len(self) >= TABLE_SIZE:
            self.clear()
        # the encoder puts the first blank there itself, but not before an empty text
        n = len(self.encode(piece[1:])) if len(piece) > 1 else 1
        if len(piece) < 64:
            self[piece] = n
        return n


def sentencepiece_counter(path: str) -> Callable[[str], int]:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    mark = "▁"
    cuttable = all(mark not in model.id_to_piece(i).lstrip(mark) for i in range(model.get_piece_size()))
    cuttable = cuttable and len(model.encode(" a  b")) == len(model.encode(" a")) + len(model.encode(" b"))
    counts, pieces = PieceCounts(lambda s: model.encode(s, num_threads=1)), re.compile(" +[^ ]*").findall

    def count(text: str) -> int:
        if not text:
            return 0
        if not cuttable or mark in text or "\0" in text:
            return len(model.encode(text, num_threads=1))
        return sum(map(counts.__getitem__, pieces(" " + text)))

    return count


def tokenizers_counter(path: str) -> Callable[[str], int]:
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda text: len(model.encode(text, add_special_tokens=False).ids)


def counter(path: str) -> Callable[[str], int]:
    return sentencepiece_counter(path) if path.endswith(".model") else tokenizers_counter(path)


def _encoder(path: str):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        count = counter(path)
        for batch in batches:
            digests, texts = batch.column(0), batch.column(1)
            yield pa.RecordBatch.from_arrays([digests, pa.array([count(t.as_py()) for t in texts], pa.int64())], names=["text_digest", "n_tokens"])

    return run


class CountStore:
    """An append-only Parquet folder of counts. Two jobs that append the same key at once leave equal rows."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], STORE_SCHEMA)
        return self.spark.read.schema(STORE_SCHEMA).parquet(self.path).dropDuplicates(["text_digest", "tokenizer_digest"])

    def append(self, counts: DataFrame) -> None:
        counts.write.mode("append").parquet(self.path)


def count_tokens(docs: DataFrame, store: CountStore | None = None, path: str | None = None, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs``.

    Null text counts as empty: 0 bytes, 0 tokens. Repeated rows and repeated or null doc_ids stay. Without a
    ``store``, a new one in the shared folder is used for this call alone.
    """
    spark = docs.sparkSession
    path = path or tokenizer_path()
    version = tokenizer_digest(path)
    store = store or CountStore(spark, f"{shared_dir(spark)}/tracelens/counts-{uuid.uuid4().hex}")
    keyed = docs.select("doc_id", blank("text").alias("text")).withColumn("text_digest", F.sha2("text", 256))
    small = keyed.select("doc_id", "text_digest", byte_length("text").alias("n_bytes"))
    known = store.read().filter(F.col("tokenizer_digest") == version).select("text_digest", "n_tokens")
    # one doc_id for each text without a count; equal texts meet here as (digest, id), never as texts
    misses = small.groupBy("text_digest").agg(F.min("doc_id").alias("_id")).join(known, "text_digest", "left_anti")
    chosen = keyed.join(misses.withColumnRenamed("text_digest", "_digest"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_digest") == F.col("_digest")), "left_semi")
    encoded = chosen.select("text_digest", "text").mapInArrow(_encoder(path), "text_digest string, n_tokens long")
    # rows that repeat a doc_id with its text are encoded each, and stored once
    encoded = encoded.dropDuplicates(["text_digest"])
    store.append(encoded.select("text_digest", F.lit(version).alias("tokenizer_digest"), "n_tokens"))
    counts = store.read().filter(F.col("tokenizer_digest") == version).select("text_digest", "n_tokens")
    return small.join(counts, "text_digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
