"""Documents packed into compressed blocks, and hash tables that are dealt between the blocks and shared buckets.

An operator that has to look up every word or phrase of every document in figures of the whole corpus would shuffle one
row for each.  Here a block of documents sums up its own keys first and sends each distinct key once, in one blob for
each bucket of the key space; a bucket, which sees a key from all blocks, answers each block with a blob in the same
order.  A key that stands in a third of all documents so takes one entry a block, wherever it is hot.

Rows sent are blocks times buckets, which would grow with the square of the input.  Beyond ``FAN`` buckets relays stand
between: see ``exchange``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelight.functions.shipping import ship
from sievelight.llm.common import checkpoint

BLOCK_BYTES = 16 << 20
#: Up to so many buckets a block sends to each by itself.
FAN = 1024


def squeeze(raw: bytes, level: int = 3) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(raw)


def expand(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


def put(values: np.ndarray, delta: bool = False) -> bytes:
    """Compressed bytes of an array: the bytes of each weight together, of the differences if ``delta``."""
    if delta and len(values):
        values = np.diff(values, prepend=values.dtype.type(0))
    return squeeze(np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.dtype.itemsize).T).tobytes(), 1)


def get(blob: bytes, dtype: type, delta: bool = False) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    raw = np.frombuffer(expand(blob), np.uint8).reshape(size, -1).T
    values = np.ascontiguousarray(raw).reshape(-1).view(dtype)
    return np.cumsum(values, dtype=dtype) if delta else values


def pack(docs: DataFrame, carried: Sequence[str] = ("doc_id",), block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of documents, checkpointed: (block, an array of each carried column, sizes, blob).

    A block ends once it holds ``block_bytes`` of text or its partition ends, so it is as large as that and one text.  A
    null text counts as empty.  The checkpoint fixes which documents are in which block for all later passes.
    """
    ship(docs.sparkSession)
    types = {c: docs.schema[c].dataType.simpleString() for c in carried}
    schema = f"block long, {', '.join(f'{c} array<{t}>' for c, t in types.items())}, sizes array<int>, blob binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, total = TaskContext.get().partitionId() << 32, [], 0
        values: list[list] = [[] for _ in carried]

        def block() -> pa.RecordBatch:
            columns = [pa.array([v]) for v in values]
            sizes = pa.array([[len(x) for x in held]], pa.list_(pa.int32()))
            return pa.RecordBatch.from_arrays([pa.array([at]), *columns, sizes, pa.array([squeeze(b"".join(held))])], ["block", *carried, "sizes", "blob"])

        for batch in batches:
            own = [batch.column(c).to_pylist() for c in carried]
            for i, text in enumerate(batch.column("text")):
                raw = (text.as_py() or "").encode()
                held.append(raw)
                total += len(raw)
                for v, o in zip(values, own):
                    v.append(o[i])
                if total >= block_bytes:
                    yield block()
                    at, held, total, values = at + 1, [], 0, [[] for _ in carried]
        if held:
            yield block()

    return checkpoint(docs.select(*carried, "text").mapInArrow(run, schema))


def texts(sizes: Sequence[int], blob: bytes) -> list[bytes]:
    raw, ends = expand(blob), np.cumsum(sizes).tolist()
    return [raw[e - s : e] for s, e in zip(sizes, ends)]


class Vocabulary(dict):
    """Numbers the words that it is asked for, from 0."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def bucket_count(n_blocks: int, entries: int, least: int = 128, bucket_entries: int = 4_000_000) -> int:
    """So many buckets (a power of two) that one holds about ``bucket_entries`` keys if each block has ``entries``."""
    return 1 << max(least.bit_length() - 1, (n_blocks * entries // bucket_entries).bit_length())


def cuts(sorted_keys: np.ndarray, n: int) -> list[int]:
    """Where buckets begin in sorted unsigned 64-bit keys that are dealt to ``n`` buckets by their leading bits."""
    edges = (np.arange(1, n, dtype=np.uint64) << np.uint64(64 - (n.bit_length() - 1))).astype(np.uint64)
    return [0, *np.searchsorted(sorted_keys, edges).tolist(), len(sorted_keys)]


def first_level(n_buckets: int, fan: int = FAN) -> int:
    """How many buckets blocks send to: all, or with relays about the square root of all (a power of two)."""
    return n_buckets if n_buckets <= fan else 1 << (n_buckets.bit_length() // 2)


def exchange(
    sent: DataFrame, n_blocks: int, n_buckets: int, fan: int, answer: Callable, merge: Callable, hand_back: Callable, key: str, reply: str, kinds: Sequence[str] = ()
) -> DataFrame:
    """What the buckets answer the blocks: rows of the schema ``reply`` for the rows of ``key`` that blocks ``sent``.

    Both schemas have bucket, block and blob, and the columns ``kinds``, which part keys of different meaning.  Buckets
    under 0 are what a block left for itself: it comes back as it is.

    Up to ``fan`` buckets ``answer(rows of a bucket)`` does it.  Beyond, blocks send to ``first_level`` buckets only.  For
    each of these and each group of blocks a relay sums up what they sent (``merge``), each distinct key once, and deals
    it to the ``n_buckets`` buckets as if it were a block; ``hand_back(what blocks sent, answers to the relay)`` turns
    the answers to the relay into answers to its blocks.  A group is four blocks for each bucket of the first level, so a
    relay holds about as much as a bucket, and rows grow with the input times the square root of the buckets: at 1 TB
    of text (62,500 blocks, 16,384 buckets) 10 million, not a billion.
    """
    level, columns = first_level(n_buckets, fan), [x.split()[0] for x in reply.split(", ")]
    if level == n_buckets:
        return sent.groupBy(*kinds, "bucket").applyInArrow(answer, reply)
    sent = checkpoint(sent)
    shift = n_buckets.bit_length() - level.bit_length()
    shared = sent.where("bucket >= 0").withColumn("relay", F.pmod(F.xxhash64("block"), F.lit(-(-n_blocks // (4 * level)))).cast("long"))
    merged = shared.groupBy(*kinds, "bucket", "relay").applyInArrow(merge, key)
    answers = merged.groupBy(*kinds, "bucket").applyInArrow(answer, reply).withColumn("to", F.shiftright("bucket", shift))
    back = shared.groupBy(*kinds, "bucket", "relay").cogroup(answers.groupBy(*kinds, "to", "block")).applyInArrow(hand_back, reply)
    return back.unionByName(sent.where("bucket < 0").select(*columns))


def by_block(blocks: DataFrame, answers: DataFrame, run, schema: str) -> DataFrame:
    """``run(block table of one row, answers of that block)`` for each block."""
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)


def count(blocks: DataFrame) -> int:
    return blocks.select(F.count(F.lit(1))).first()[0]
