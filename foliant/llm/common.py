"""What the text operators share: batches of texts in Arrow, hashing, small vocabularies."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from foliant.sources.ship import ship


#: Characters of text that are worked on at once; a longer text is worked on alone.
CHARS = 16_000_000


def slices(batch: pa.RecordBatch, chars: int) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch of at most ``chars`` characters in the column ``text``, or of one row."""
    if "text" not in batch.schema.names:
        yield batch
        return
    n = np.cumsum(np.asarray(pc.fill_null(pc.utf8_length(batch.column("text")), 0), dtype=np.int64))
    at = 0
    while at < batch.num_rows:
        before = n[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(n, before + chars, side="right")))
        yield batch.slice(at, to - at)
        at = to


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, chars: int = CHARS) -> DataFrame:
    """Rows of ``fn`` over each Arrow batch, cut to ``chars`` characters; ``fn`` sees only the columns of ``df``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, chars):
                if b.num_rows and (out := fn(b)) is not None and out.num_rows:
                    yield out

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def copies_marked(rows: DataFrame, share: float = 1e-4) -> DataFrame:
    """``rows (tab, id, idx, text, ...)`` with ``copy``: a further copy of a text that makes up at least ``share`` of them.

    For counting only. There are at most 1 / share such texts, so they are sent to every task; what is
    shuffled is a hash of each text. A row delivered twice is no copy; nor are null and empty texts.
    """
    rows = rows.withColumn("_text", F.xxhash64("text")).withColumn("_row", F.xxhash64("tab", "id", "idx"))
    total = rows.agg(F.count("*").alias("all"))
    copies = rows.filter("length(text) > 0").groupBy("_text").agg(F.count("*").alias("_n"), F.min("_row").alias("_first")).filter("_n >= 2")
    hot = copies.join(F.broadcast(total), F.col("_n") >= share * F.col("all")).select("_text", "_first")  # one row
    return rows.join(F.broadcast(hot), "_text", "left").withColumn("copy", F.coalesce(F.col("_row") != F.col("_first"), F.lit(False))).drop("_text", "_row", "_first")


def without_copies(rows: DataFrame) -> DataFrame:
    """The rows that :func:`copies_marked` does not mark."""
    return copies_marked(rows).filter("not copy").drop("copy")


def texts(batch: pa.RecordBatch, column: str) -> list[str]:
    """The strings of a column; null counts as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that neighbouring hashes spread over all bits."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    return h ^ (h >> np.uint64(27))


def codepoints(strings: list[str], gap: str = "\n") -> tuple[np.ndarray, np.ndarray]:
    """All code points of the strings, each followed by ``gap``, and the offset at which each starts."""
    n = np.fromiter((len(s) + len(gap) for s in strings), dtype=np.int64, count=len(strings))
    cps = np.frombuffer((gap.join(strings) + gap).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return cps, np.concatenate([[0], np.cumsum(n)])


#: Rows of a small side that are sent to every task; a longer one is joined by parts.
SMALL = 2_000


def joined_with_small(big: DataFrame, small: DataFrame, key: str, salt: int = 16) -> DataFrame:
    """``big`` joined with a side that has a row for each key: sent to every task if it has up to ``SMALL`` rows,
    which are counted; else each key is spread over ``salt`` parts, so that a hot key is not one task.
    """
    if small.limit(SMALL + 1).count() <= SMALL:
        return big.join(F.broadcast(small), key)
    parts = F.explode(F.sequence(F.lit(0), F.lit(salt - 1))).alias("_part")
    spread = big.withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(salt)).cast("int"))
    return spread.join(small.withColumn("_part", parts), [key, "_part"]).drop("_part")
