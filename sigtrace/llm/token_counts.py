"""Token counts of documents in flat token files: a separator scan by blocks, stitched by a prefix scan.

A token file is nothing but ids, little-endian and of one width, each document followed by an end-of-document id. No
index, header or document list goes with it: where documents begin and end follows from the scan alone.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, lean, written
from .tokens import encoder, vocabulary

#: Ids in a block; a block is what one step of the scan looks at.
BLOCK_IDS = 1 << 16
#: End-of-document id of word_bpe_49k, which no ordinary text yields.
END_ID = 49407
#: Blocks whose prefixes are summed in one window; longer files are summed in two levels.
GROUP_BLOCKS = 1024
#: Bytes of token files that a task of the scan reads, about.
TASK_BYTES = 32 << 20


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path as Spark writes it (a local path, file:, hdfs:, s3: and the like) and the path inside."""
    if path.startswith("/"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def write_flat(docs: DataFrame, where: str, path: str | None = None, end_id: int = END_ID, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Writes docs as token files of 16-bit ids into the folder where, one for each task that has rows.

    Returns file_id, ordinal, doc_id and, on ordinal 0, the file's name: which document was written as which of a file.
    The scan never sees that table; it only gives names to what the scan has counted, and says which files count: a task
    that is run again writes another file, and the one that its lost attempt left is in no row. Null and empty texts are an
    end id alone, texts of any length go whole, repeated rows and null ids are rows like any other; an empty table writes no
    file. Other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    path = path or vocabulary()
    folder = where.rstrip("/")
    system, inner = store(folder)
    system.create_dir(inner, recursive=True)

    def write(batches):
        enc, number = encoder(path, plain_specials=True), TaskContext.get().partitionId()
        if enc.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("the vocabulary has more ids than 16 bits tell apart")
        system, inner = store(folder)
        name, end, out, ordinal = f"{number:06d}-{uuid.uuid4().hex}.ids", np.array([end_id], "<u2").tobytes(), None, 0
        try:
            for b in batches:
                if out is None and b.num_rows:
                    out = system.open_output_stream(f"{inner}/{name}", buffer_size=1 << 20)
                for text in b.column("text"):
                    out.write(enc.ids(text.as_py()).astype("<u2").tobytes() + end)
                n = b.num_rows
                names = [name if ordinal + i == 0 else None for i in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array([number] * n, pa.int32()), pa.array(range(ordinal, ordinal + n), pa.int64()), b.column("doc_id"), pa.array(names, pa.string())], names=["file_id", "ordinal", "doc_id", "file"])
                ordinal += n
        finally:
            if out is not None:
                out.close()

    return written(rows.mapInArrow(lean(write), "file_id int, ordinal long, doc_id long, file string"), "names")


def flat_files(spark: SparkSession, where: str, names: DataFrame | None = None) -> DataFrame:
    """file_id, path, length of the token files in a folder, of any size; only the listing is read.

    With names, the result of write_flat, only files that it lists, under its numbers; else a file's number is a hash of
    its path.
    """
    listed = spark.read.format("binaryFile").load(where).select("path", "length")
    if names is None:
        return listed.select(F.xxhash64("path").alias("file_id"), "path", "length")
    known = names.where("file is not null").select("file_id", F.col("file").alias("__file"))
    return listed.join(known, F.substring_index("path", "/", -1) == F.col("__file")).select("file_id", "path", "length")


def count_tokens(files: DataFrame, end_id: int = END_ID, block_ids: int = BLOCK_IDS, width: int = 2, task_bytes: int = TASK_BYTES) -> DataFrame:
    """files(file_id, path, length) -> one row per document: file_id, ordinal, start, n_tokens, ended.

    Files are read by ranges of blocks, so a file may have any size and is spread over tasks. The scan of a block finds all
    its separators in one vector comparison; running maxima and sums over the blocks of a file, in groups of bounded
    length and then over the groups, say where the document that is open at a block's start began and how many ended
    before. Ids after a file's last separator make a row with ended false; bytes after a file's last whole id are left
    out. An empty file or table has no row; adjacent separators are documents of no tokens.
    """
    spark = files.sparkSession
    bounded_batches(spark)
    kind, step = f"<u{width}", block_ids * width
    per_range = max(1, (8 << 20) // step)
    total = files.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, min(-(-total // task_bytes), 1 << 20), min(spark.sparkContext.defaultParallelism, -(-total // step)))
    ranges = files.where(F.col("length") >= width).select("file_id", "path", F.floor(F.col("length") / width).alias("ids"))
    ranges = ranges.withColumn("block", F.explode(F.expr(f"transform(sequence(0L, (ids - 1) div {block_ids * per_range}L), k -> k * {per_range}L)")))
    ranges = ranges.repartition(int(tasks), "file_id", "block")
    schema = T.StructType([T.StructField("file_id", files.schema["file_id"].dataType), T.StructField("block", T.LongType()), T.StructField("n_ids", T.LongType()), T.StructField("ends", T.ArrayType(T.LongType()))])

    def scan(batches):
        for b in batches:
            for row in b.to_pylist():
                system, inner = store(row["path"])
                with system.open_input_file(inner) as f:
                    for k in range(row["block"], row["block"] + per_range):
                        at = k * block_ids
                        n = min(block_ids, row["ids"] - at)
                        if n <= 0:
                            break
                        ids = np.frombuffer(f.read_at(n * width, at * width), kind)
                        ends = np.flatnonzero(ids == end_id) + at
                        yield pa.RecordBatch.from_arrays([pa.array([row["file_id"]], b.schema.field("file_id").type), pa.array([k], pa.int64()), pa.array([n], pa.int64()), pa.array([ends], pa.list_(pa.int64()))], names=[f.name for f in schema])

    found = written(ranges.mapInArrow(lean(scan), schema), "ends")
    found = found.withColumn("n", F.size("ends")).withColumn("last", F.when(F.size("ends") > 0, F.element_at("ends", -1)))
    found = found.withColumn("grp", F.floor(F.col("block") / GROUP_BLOCKS))
    groups = found.groupBy("file_id", "grp").agg(F.max("last").alias("g_last"), F.sum("n").alias("g_n"), F.max("block").alias("g_block"))
    over = Window.partitionBy("file_id").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("file_id", "grp", F.max("g_last").over(over).alias("b_last"), F.sum("g_n").over(over).alias("b_n"), F.max("g_block").over(Window.partitionBy("file_id")).alias("f_block"))
    inner = Window.partitionBy("file_id", "grp").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    here = found.withColumn("p_last", F.max("last").over(inner)).withColumn("p_n", F.sum("n").over(inner)).join(groups, ["file_id", "grp"])
    prior = F.coalesce("p_last", "b_last", F.lit(-1).cast("long"))
    here = here.withColumn("before", prior).withColumn("ended_before", F.coalesce("p_n", F.lit(0)) + F.coalesce("b_n", F.lit(0)))
    stop = F.col("block") * block_ids + F.col("n_ids")
    tail = (F.col("block") == F.col("f_block")) & (F.coalesce("last", "before") + 1 < stop)
    ends = F.concat("ends", F.when(tail, F.array(stop)).otherwise(F.expr("cast(array() as array<bigint>)")))
    here = here.withColumn("all_ends", ends)
    each = here.where(F.size("all_ends") > 0).select("file_id", "before", "ended_before", "all_ends", "n", F.posexplode("all_ends").alias("i", "stop"))
    start = F.when(F.col("i") == 0, F.col("before")).otherwise(F.get("all_ends", F.col("i") - 1)) + 1
    ordinal = (F.col("ended_before") + F.col("i")).cast("long")
    return each.select("file_id", ordinal.alias("ordinal"), start.alias("start"), (F.col("stop") - start).alias("n_tokens"), (F.col("i") < F.col("n")).alias("ended"))
