"""Problem 7: mixing sources to target shares of the total size in tokens.

Each document of a source is expected ``target / size of the source`` times, at most ``max_repeat``
times. The expected copies are summed up along the source (a prefix sum), one random offset is added
for the source, and a document is emitted once for each integer boundary its step crosses: systematic
sampling, whose share is right to within one document, with at most ``max_repeat`` copies of each.
"""

from __future__ import annotations

import base64
import os

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window as W, functions as F

from foliant.llm.common import joined_with_small, map_batches, texts
from foliant.sources.tables import checkpointed

#: A public tokenizer's vocabulary; the path is a parameter everywhere.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the public byte-level BPE pattern of words.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Documents of a block of a source in the prefix sum, on average; a source is never summed up in one task.
BLOCK_SIZE = 50_000

_encoders: dict = {}
_sent: dict[str, set[str]] = {}


def encoder(path: str):
    """The tokenizer of a file of ranks, read once in each Python worker."""
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def token_sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", tokenizer: str = TOKENIZER) -> DataFrame:
    """``(id, source, tokens)``: the size of every document in tokens; null text has none."""

    spark = docs.sparkSession
    if tokenizer not in _sent.setdefault(spark.sparkContext.applicationId, set()):
        spark.sparkContext.addFile(tokenizer)  # executors need not have the file
        _sent[spark.sparkContext.applicationId].add(tokenizer)
    name = os.path.basename(tokenizer)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        enc = encoder(SparkFiles.get(name))
        n = [len(enc.encode_ordinary(t)) for t in texts(b, "text")]
        return pa.RecordBatch.from_arrays([b.column("id"), b.column("source"), pa.array(n, pa.int64())], ["id", "source", "tokens"])

    d = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"))
    return map_batches(d, run, "id bigint, source string, tokens bigint")


def plan_of(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """``(source, target_share, max_repeat, docs, have_tokens, target_tokens, expected_copies, at_cap)``.

    A row for each source of ``targets``. A source without documents has ``expected_copies`` 0 and is
    at its cap; a null share counts as 0, a null ``max_repeat`` as 1. Documents of sources without a
    target count in the total size but are not emitted.
    """
    by = sizes.groupBy("source").agg(F.count("*").alias("docs"), F.sum("tokens").alias("have_tokens"))
    total = by.agg(F.coalesce(F.sum("have_tokens"), F.lit(0)).alias("all_tokens"))
    t = targets.select(
        F.col("source").cast("string").alias("source"), F.coalesce(F.col("target_share").cast("double"), F.lit(0.0)).alias("target_share"), F.coalesce(F.col("max_repeat").cast("int"), F.lit(1)).alias("max_repeat")
    ).dropDuplicates(["source"])
    need = F.col("target_share") * F.col("all_tokens")
    return (
        t.join(by, "source", "left")
        .join(F.broadcast(total))  # one row
        .select(
            "source", "target_share", "max_repeat", F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("have_tokens", F.lit(0)).alias("have_tokens"), need.alias("target_tokens"),
        )
        .withColumn("wanted", F.when(F.col("have_tokens") > 0, F.col("target_tokens") / F.col("have_tokens")))
        .withColumn("expected_copies", F.coalesce(F.least("wanted", F.col("max_repeat").cast("double")), F.lit(0.0)))
        .withColumn("at_cap", F.when(F.col("target_tokens") <= 0, F.lit(False)).otherwise(F.coalesce(F.col("wanted") > F.col("max_repeat"), F.lit(True))))
        .drop("wanted")
    )


def systematic(rows: DataFrame, seed: int = 7, blocks: int = 4096) -> DataFrame:
    """``rows (id, source, tokens, expected_copies)`` with ``copies``: the integer boundaries each row crosses.

    The prefix sum is taken in two steps, over the sums of the blocks of a source (``blocks`` rows at
    most) and within each block, so that a hot source is spread over all tasks. Order and offset depend
    on the ids and ``seed`` only; rows of the same id follow each other.
    """
    r = rows.withColumn("block", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(blocks)).cast("int"))
    sums = r.groupBy("source", "block").agg(F.sum("expected_copies").alias("s"))
    before = W.partitionBy("source").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("source", "block", F.coalesce(F.sum("s").over(before), F.lit(0.0)).alias("base"))
    inside = W.partitionBy("source", "block").orderBy("id", "tokens").rowsBetween(W.unboundedPreceding, 0)
    offset = F.pmod(F.xxhash64("source", F.lit(seed)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    at = F.round(F.col("base") + F.sum("expected_copies").over(inside) + offset, 7)
    r = r.join(sums, ["source", "block"]).withColumn("at", at)
    step = W.partitionBy("source", "block").orderBy("id", "tokens")
    last = F.coalesce(F.lag("at").over(step), F.round(F.col("base") + offset, 7))
    return r.withColumn("copies", (F.floor("at") - F.floor(last)).cast("int")).drop("block", "base", "at")


def mixed(docs: DataFrame, targets: DataFrame, seed: int = 7, tokenizer: str = TOKENIZER, blocks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The selection ``(doc_id, source, copies, tokens)`` and the report of the shares reached.

    Tokens are counted once, into the checkpoint folder; texts are not shuffled. An empty table of
    documents gives an empty selection and a report in which every source is short.
    """
    sizes = checkpointed(token_sizes(docs, tokenizer=tokenizer))
    plan = checkpointed(plan_of(sizes, targets))
    blocks = blocks or max(64, -(-sizes.count() // BLOCK_SIZE))
    rows = joined_with_small(sizes, plan.select("source", "expected_copies"), "source")
    chosen = systematic(rows, seed, blocks).filter("copies > 0").select(F.col("id").alias("doc_id"), "source", "copies", "tokens")
    got = chosen.groupBy("source").agg(F.sum("copies").alias("copies"), F.sum(F.col("tokens") * F.col("copies")).alias("reached_tokens"))
    total = got.agg(F.sum("reached_tokens").alias("mix_tokens"))
    report = (
        plan.join(got, "source", "left")
        .join(F.broadcast(total))  # one row
        .select(
            "source", "target_share", "max_repeat", "docs", "have_tokens", "target_tokens", "expected_copies", F.coalesce("copies", F.lit(0)).alias("copies"), F.coalesce("reached_tokens", F.lit(0)).alias("reached_tokens"),
            F.coalesce(F.col("reached_tokens") / F.col("mix_tokens"), F.lit(0.0)).alias("reached_share"), (F.col("at_cap") & (F.coalesce("reached_tokens", F.lit(0)) < F.col("target_tokens"))).alias("short"),
        )
    )
    return chosen, report
