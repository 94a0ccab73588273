"""Token counts of flat, unindexed token files: a vectorised separator scan and a prefix scan over blocks.

A token file is a sequence of ids of fixed width; documents follow each other, each ended by a separator id, and no index says
where. The file is read in blocks that know nothing of documents. Every block finds its separators at once; sums and the
place of the last separator are then carried over the blocks by a prefix scan in two levels (inside groups of blocks, then over
the groups' totals), so a file may have any number of blocks.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from llm.session import ready, stored

#: The public byte-level vocabulary, its splitting pattern, and the id that is free for document ends.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END_OF_DOCUMENT = 50256

#: Tokens of a block that is written, and blocks of a group of the prefix scan.
BLOCK_TOKENS = 1 << 18
GROUP_BLOCKS = 1024


def write_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, separator: int = END_OF_DOCUMENT) -> DataFrame:
    """(file, block, ids, keys): flat token streams, one file per partition of ``docs``, as 16-bit ids in blocks.

    Each text is tokenised whole and ended by the separator; special strings in a text are ordinary text; null texts have no tokens.
    Rows with ``ids`` null are not part of the files: they name the keys of a stretch of documents in file order (``block`` is the
    number of the first). The vocabulary is read where the job is declared and sent to the tasks.
    """
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in _lines(docs.sparkSession, vocabulary))}
    shipped = docs.sparkSession.sparkContext.broadcast(ranks)
    schema = T.StructType([T.StructField("file", T.IntegerType()), T.StructField("block", T.LongType()), T.StructField("ids", T.BinaryType()),
                           T.StructField("keys", T.ArrayType(docs.schema[key].dataType))])
    kind = pa.list_(pa.int64())

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken
        encoding = tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=shipped.value, special_tokens={})
        file, block, done, parts, waiting = TaskContext.get().partitionId(), 0, 0, [], 0
        end = np.array([separator], np.uint16)
        key_kind = kind

        def blocks(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal parts, waiting, block
            while waiting >= BLOCK_TOKENS or last and waiting:
                stream = np.concatenate(parts)
                parts, waiting = [stream[BLOCK_TOKENS:]], max(0, waiting - BLOCK_TOKENS)
                yield rows(block, stream[:BLOCK_TOKENS].tobytes(), None)
                block += 1

        def rows(number: int, ids: bytes | None, keys: pa.Array | None) -> pa.RecordBatch:
            named = pa.nulls(1, key_kind) if keys is None else pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)
            return pa.RecordBatch.from_arrays([pa.array([file], pa.int32()), pa.array([number], pa.int64()), pa.array([ids], pa.binary()), named], ["file", "block", "ids", "keys"])

        for batch in batches:
            key_kind = pa.list_(batch.column(0).type)
            if batch.num_rows:
                yield rows(done, None, batch.column(0))
                done += batch.num_rows
            for value in batch.column(1):
                ids = np.array(encoding.encode_ordinary(value.as_py() or ""), np.uint16)
                parts += [ids, end]
                waiting += len(ids) + 1
                if waiting >= BLOCK_TOKENS:
                    yield from blocks(False)
        yield from blocks(True)

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(tokens, schema)


def _lines(spark: SparkSession, path: str) -> list[bytes]:
    """The lines of a vocabulary file: read by Spark where the path has a scheme, else from the driver's disk."""
    if "://" in path:
        return [r.value.encode() for r in spark.read.text(path).collect()]
    with open(path, "rb") as f:
        return f.read().splitlines()


def blocks_of_files(spark: SparkSession, path: str, block_bytes: int = 2 * BLOCK_TOKENS) -> DataFrame:
    """(file, block, ids) of raw binary token files; ``block_bytes`` is a multiple of the id width."""
    files = spark.read.format("binaryFile").load(path)
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.col("length") - 1), F.lit(block_bytes).cast("long"))
    return files.where("length > 0").select(F.col("path").alias("file"), "content", F.posexplode(starts).alias("block", "start")) \
        .select("file", F.col("block").cast("long").alias("block"), F.substring("content", (F.col("start") + 1).cast("int"), F.lit(block_bytes)).alias("ids"))


def count_tokens(blocks: DataFrame, separator: int = END_OF_DOCUMENT, dtype: str = "<u2", group: int = GROUP_BLOCKS) -> DataFrame:
    """(file, document, start, n_tokens): every document of flat token files, numbered from 0 in file order.

    ``blocks`` has file, block (ascending in a file, gaps allowed) and ids, raw ids of type ``dtype``; a document may lie in any number of blocks. The
    separator is not counted. Two separators in a row enclose a document of 0 tokens; tokens after the last separator are a
    document too. Null and empty blocks have no tokens; an empty table gives an empty result. Other columns are not used.
    """
    file_type = blocks.schema["file"].dataType
    schema = T.StructType([T.StructField("file", file_type), T.StructField("block", T.LongType()), T.StructField("n", T.LongType()), T.StructField("ends", T.ArrayType(T.LongType()))])

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids = np.frombuffer(batch.column(2)[row].as_py() or b"", dtype)
                at = np.flatnonzero(ids == separator)
                found = pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, 1), batch.column(1).slice(row, 1), pa.array([len(ids)], pa.int64()), found], ["file", "block", "n", "ends"])

    # one short row per block from here on
    found = blocks.select("file", F.col("block").cast("long").alias("block"), "ids").mapInArrow(ends, schema) \
        .withColumn("group", F.floor(F.col("block") / group)).withColumn("k", F.size("ends").cast("long"))
    before = Window.partitionBy("file", "group").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    inside = found.withColumn("start", F.coalesce(F.sum("n").over(before), zero)).withColumn("number", F.coalesce(F.sum("k").over(before), zero)) \
        .withColumn("stop", F.when(F.col("k") > 0, F.col("start") + F.element_at("ends", -1))) \
        .withColumn("last", F.max("stop").over(before))
    totals = inside.groupBy("file", "group").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.max("stop").alias("stop"))
    groups = Window.partitionBy("file").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.withColumn("group_start", F.coalesce(F.sum("n").over(groups), zero)).withColumn("group_number", F.coalesce(F.sum("k").over(groups), zero)) \
        .withColumn("group_last", F.max(F.col("group_start") + F.col("stop")).over(groups))
    whole = inside.join(carried.select("file", "group", "group_start", "group_number", "group_last"), ["file", "group"])
    start = F.col("group_start") + F.col("start")
    previous = F.coalesce(F.col("group_start") + F.col("last"), F.col("group_last"), F.lit(-1).cast("long"))
    cuts = F.concat(F.array(previous), F.transform("ends", lambda e: e + start))
    closed = whole.withColumn("cuts", cuts).select("file", "group_number", "number", F.col("cuts").alias("cuts"), F.posexplode("ends").alias("i", "end")) \
        .select("file", (F.col("group_number") + F.col("number") + F.col("i")).alias("document"), (F.get("cuts", F.col("i")) + 1).alias("start"),
                (F.get("cuts", F.col("i") + 1) - F.get("cuts", F.col("i")) - 1).alias("n_tokens"))
    tails = carried.groupBy("file").agg(F.sum("n").alias("n"), F.sum("k").alias("document"), F.max(F.col("group_start") + F.col("stop")).alias("stop")) \
        .withColumn("start", F.coalesce(F.col("stop") + 1, zero)).where("n > start") \
        .select("file", "document", "start", (F.col("n") - F.col("start")).alias("n_tokens"))
    return closed.unionByName(tails)


def document_tokens(written: DataFrame, separator: int = END_OF_DOCUMENT) -> DataFrame:
    """(key, n_tokens) of the documents of ``write_tokens``: the scan counts, the names only label its documents."""
    counts = count_tokens(written.where("ids IS NOT NULL"), separator)
    names = written.where("ids IS NULL").select("file", "block", F.posexplode("keys").alias("i", "key")) \
        .select("file", (F.col("block") + F.col("i")).alias("document"), "key")
    return names.join(counts, ["file", "document"]).select("key", "n_tokens")


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, n_tokens) of every row: texts become flat token files in the shared folder, which are then scanned.

    Null and empty texts have 0 tokens; null keys and repeated rows stay; an empty table gives an empty result. Other columns are not used.
    """
    ready(docs.sparkSession)
    return document_tokens(stored(write_tokens(docs, key, text, vocabulary))).withColumnRenamed("key", key)
