"""Harmonic packing of token ids into sequences of a fixed capacity.

Documents are tokenised where they are read and cut, without padding, into pieces
of reciprocal lengths: whole sequences first, then the largest ``capacity // k`` that fits
the rest, and so on. A class holds pieces of one length, and a bin of the class takes exactly ``capacity //
length`` of them, so a worker fills its bins alone and no row is shuffled. The few pieces that
don't fill a bin (less than one bin a class and task) are laid end to end for every ``FAN_IN`` tasks
and cut at the capacity; the last rest is cut at powers of two, which need no padding.

Defined results for odd input: a null or empty text is one id, the end of document;
repeated rows are packed once each; an empty table gives no pieces; other columns aren't read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srclens.llm.common import written

CAPACITY = 1024
END_ID = 0
#: Tasks whose left-over pieces are packed together: at most FAN_IN * 64 * CAPACITY ids.
FAN_IN = 64
#: Chunks of text whose ids a Python worker keeps, and the longest that is kept.
CACHED_CHUNKS = 600_000
LONGEST_CHUNK = 64

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_SCHEMA = pa.schema([(x.split()[0], pa.int64()) for x in PIECES.split(", ")])


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def default_ranks() -> str:
    """The same vocabulary as ranks, which another library encodes some times faster."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def rank_encoding(path: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Ids of a text as little-endian 32-bit bytes, equal to encoding it at once with the tokenizer.

    A byte-level vocabulary never joins a non-space character with the space
    after it, so a text may be cut before such spaces; the ids of a
    chunk are kept, and new chunks are encoded by ``ranks`` if given. Texts with spaces after other white
    space are encoded whole, those with a special token by the tokenizer, which knows it.
    """

    def __init__(self, path: str, ranks: str | None = None) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.ranks = rank_encoding(ranks) if ranks else None
        self.cache: dict[str, bytes | None] = {}

    def _exact(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _whole(self, text: str) -> bytes:
        return np.array(self.ranks.encode_ordinary(text), "<u4").tobytes() if self.ranks else self._exact(text)

    def _chunk(self, chunk: str) -> bytes | None:
        """The ids of a chunk after a space; None if the chunk can't be cut off at its end."""
        ids = None if not chunk or chunk[-1].isspace() else self._whole(" " + chunk)
        if len(chunk) <= LONGEST_CHUNK:
            self.cache[chunk] = ids
        return ids

    def __call__(self, text: str) -> bytes:
        if any(x in text for x in self.special):
            return self._exact(text)
        first, *chunks = text.split(" ")
        if not chunks:
            return self._whole(text)
        if not first or first[-1].isspace():
            return self._whole(text)
        cache = self.cache
        if len(cache) > CACHED_CHUNKS:
            cache.clear()
        try:
            ids = [cache[c] for c in chunks]
        except KeyError:
            ids = [cache[c] if c in cache else self._chunk(c) for c in chunks]
        if None in ids:
            return self._whole(text)
        return self._whole(first) + b"".join(ids)


def cuts(length: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of the pieces of a document, each a reciprocal ``capacity // k``."""
    whole, rest = divmod(length, capacity)
    out = [capacity] * whole
    while rest:
        out.append(capacity // (capacity // (rest + 1) + 1))
        rest -= out[-1]
    return out


def _first_pass(path: str, ranks: str | None, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = Encoder(path, ranks), TaskContext.get().partitionId()
        end = np.array([END_ID], "<u4").tobytes()
        waiting: dict[int, list[tuple]] = defaultdict(list)
        sequence = task << 32
        done: list[tuple] = []

        def batch_of(rows: list[tuple], ids: list[bytes | None]) -> pa.RecordBatch:
            columns = [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 7
            return pa.RecordBatch.from_arrays(
                [*columns, pa.array([task] * len(rows), pa.int64()), pa.array(ids, pa.binary())], [*_SCHEMA.names, "task", "ids"]
            )

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = encode(text or "") + end
                n, start = len(ids) // 4, 0
                for length in cuts(n, capacity):
                    piece = ids[4 * start : 4 * (start + length)]
                    bin_ = waiting[length]
                    bin_.append((doc_id, start, length, zlib.crc32(piece), n, piece))
                    start += length
                    if len(bin_) == capacity // length:
                        done += [(*x[:5], sequence, i * length) for i, x in enumerate(bin_)]
                        sequence += 1
                        bin_.clear()
            if done:
                yield batch_of(done, [None] * len(done))
                done = []
        rest = [x for _, pieces in sorted(waiting.items(), reverse=True) for x in pieces]
        if rest:
            yield batch_of([(*x[:5], None, None) for x in rest], [x[5] for x in rest])

    return run


def _second_pass(capacity: int):
    def run(key, table):
        rows = sorted(
            zip(*[table.column(c).to_pylist() for c in ("length", "doc_id", "start", "doc_tokens", "ids")], strict=True),
            key=lambda x: (-x[0], x[1] is None, x[1] or 0, x[2], x[4]),
        )
        total = sum(x[0] for x in rows)
        sizes = [capacity] * (total // capacity)
        sizes += [1 << b for b in range(capacity.bit_length() - 1, -1, -1) if (total % capacity) >> b & 1]
        sequence, used, out = (1 << 62) + (key[0].as_py() << 32), 0, []
        free = iter(sizes)
        room = next(free, 0)
        for length, doc_id, start, doc_tokens, ids in rows:
            at = 0
            while at < length:
                if used == room:
                    sequence, used, room = sequence + 1, 0, next(free)
                n = min(length - at, room - used)
                out.append((doc_id, start + at, n, zlib.crc32(ids[4 * at : 4 * (at + n)]), doc_tokens, sequence, used))
                at, used = at + n, used + n
        return pa.table([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], schema=_SCHEMA)

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, fan_in: int = FAN_IN) -> DataFrame:
    """One row a piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    ``capacity`` is a power of two. ``tokenizer`` is a tokenizer file; without one the public byte-level
    vocabulary is used, together with its ranks.
    """
    path, ranks = (tokenizer, None) if tokenizer else (default_tokenizer(), default_ranks())
    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _first_pass(path, ranks, capacity), PIECES + ", task long, ids binary"
    )
    pieces = written(pieces, "pieces")
    rest = pieces.where(F.col("sequence_id").isNull()).groupBy((F.col("task") / fan_in).cast("long").alias("group"))
    rest = rest.applyInArrow(_second_pass(capacity), PIECES)
    return pieces.where(F.col("sequence_id").isNotNull()).select(*_SCHEMA.names).unionByName(rest)
