"""Cross-tokenizer alignment by inverted bitmaps of id pairs.

A text is encoded by a byte-level vocabulary (A, by its ranks) and by a piece model (B). Byte offsets where tokens of both end cut it into groups, and the
two tokens that end there are a link of their id pair. Links are inverted: documents are dealt to blocks of at most ``SLOTS`` where they
are read, and every pair of a block has a compressed bitmap of the block's documents that hold it, kept as multiplicity planes: plane k has the
documents whose number of links has bit k. A pair's whole bitmap is the OR of its containers, block by block as in any compressed bitmap, so its document count is the sum of the
containers' popcounts, and its link count that of ``2^k`` times the popcounts of plane k: sums that are formed before the shuffle. The scores of pairs go back
along the postings: a block gets its pairs' scores, and its bitmaps deal them to its documents.

Texts are cut before spaces that follow a character other than white space, where tokens of both kinds end (a piece model with other pieces is refused); chunks that were seen keep their alignment.

Defined results for odd input: null and empty texts, and texts whose tokens don't give back a space and the text (those with U+2581), have no tokens, zeros and an
empty digest; a null doc_id stays null; repeated rows are documents of their own, whose links count each time; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srclens.llm.common import Scratch, written
from srclens.llm.packing import default_ranks, rank_encoding

#: Documents of a block at most, and links after which a block ends.
SLOTS = 4096
BLOCK_LINKS = 1 << 21
#: Chunks whose alignment a Python worker keeps (twice as many at most), and the longest that is kept.
CACHED_CHUNKS = 250_000
LONGEST_CHUNK = 48
_CUT = re.compile(r"(?<=\S)(?= )")
_SPACED = re.compile(r"^ |\s ")
_BITMAP = SLOTS // 8


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Aligner:
    """Numbers of tokens, groups as text and links as pair codes ``a * n_b + b`` of texts."""

    def __init__(self, ranks: str, pieces: str) -> None:
        import sentencepiece

        encoding = rank_encoding(ranks)
        self.encode_a = encoding.encode_ordinary
        known = dict(zip(encoding._mergeable_ranks.values(), encoding._mergeable_ranks, strict=True))
        self.size_a = [len(known.get(i, b"")) for i in range(max(known) + 1)]
        model = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.encode_b = model.encode
        self.last_space = self.encode_b("a ")[len(self.encode_b("a")) :]
        self.n_b = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(self.n_b)]
        if any(re.search("[^▁]▁", x) for x in names):
            raise ValueError(f"pieces of {pieces} go on after a space")
        self.bytes_b = [bytes([int(x[3:5], 16)]) if model.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
        self.size_b = list(map(len, self.bytes_b))
        self.shown = list(map(str, range(max(len(self.size_a), self.n_b))))
        self.cache: dict[str, tuple[int, int, str, bytes] | tuple] = {}
        self.older: dict[str, tuple[int, int, str, bytes] | tuple] = {}

    def chunk(self, chunk: str) -> tuple[int, int, str, bytes] | tuple:
        """The alignment of a space and ``chunk``; empty if B's tokens have other bytes. A's always have the text's."""
        a, b = self.encode_a(" " + chunk), self.encode_b(chunk) if chunk else self.last_space
        found: tuple = ()
        if b"".join([self.bytes_b[x] for x in b]) == (" " + chunk).encode():
            shown, size_a, size_b = self.shown, self.size_a, self.size_b
            groups, codes, i, j = [], array("q"), 0, 0
            at_b, k = size_b[b[0]], 0
            at_a = 0
            for h, x in enumerate(a):
                at_a += size_a[x]
                while at_b < at_a:
                    k += 1
                    at_b += size_b[b[k]]
                if at_b == at_a:
                    y = b[k]
                    if i == h and j == k:
                        groups.append(f"{shown[x]}|{shown[y]}")
                    else:
                        groups.append(f"{','.join([shown[z] for z in a[i : h + 1]])}|{','.join([shown[z] for z in b[j : k + 1]])}")
                    codes.append(x * self.n_b + y)
                    i, j = h + 1, k + 1
            found = len(a), len(b), ";".join(groups), codes.tobytes()
        if len(chunk) <= LONGEST_CHUNK:
            self._keep(chunk, found)
        return found

    def _keep(self, chunk: str, found: tuple) -> None:
        if len(self.cache) >= CACHED_CHUNKS:
            self.cache, self.older = {}, self.cache
        self.cache[chunk] = found

    def _missed(self, chunk: str) -> tuple:
        """What isn't at hand: seen in the same text, kept before the cache was renewed, or new."""
        found = self.cache.get(chunk)
        if found is None:
            found = self.older.get(chunk)
            if found is None:
                return self.chunk(chunk)
            self._keep(chunk, found)
        return found

    def __call__(self, text: str | None) -> tuple[int, int, str, np.ndarray]:
        """``n_a, n_b``, the groups' digest and the pair codes of all links."""
        none = 0, 0, "", np.zeros(0, np.int64)
        if not text:
            return none
        # Chunks without their leading space; where no space follows white space each one is a chunk's.
        plain = not _SPACED.search(text)
        chunks = text.split(" ") if plain else [c[1:] for c in _CUT.split(" " + text)]
        get = self.cache.get
        found = [get(c) for c in chunks]
        if None in found:
            found = [self._missed(c) if x is None else x for c, x in zip(chunks, found, strict=True)]
        if () in found:
            return none
        a, b, groups, codes = zip(*found, strict=True)
        return sum(a), sum(b), hashlib.sha256(";".join(groups).encode()).hexdigest(), np.frombuffer(b"".join(codes), "<i8")


def packed(slots: np.ndarray, times: np.ndarray) -> bytes:
    """The multiplicity planes of a pair in a block: its slots, ascending, and the links in each.

    A plane is its popcount and then its slots or, where that is shorter, its bits.
    """
    planes = int(times.max()).bit_length()
    out = [bytes([planes])]
    for k in range(planes):
        on = slots[(times >> k & 1).astype(bool)] if planes > 1 else slots
        out.append(len(on).to_bytes(2, "little"))
        if 2 * len(on) <= _BITMAP:
            out.append(on.astype("<u2").tobytes())
        else:
            bits = np.zeros(SLOTS, np.uint8)
            bits[on] = 1
            out.append(np.packbits(bits, bitorder="little").tobytes())
    return b"".join(out)


def planes_of(data: bytes) -> list[np.ndarray]:
    """The slots of each plane."""
    out, at = [], 1
    for _ in range(data[0]):
        n = int.from_bytes(data[at : at + 2], "little")
        at += 2
        if 2 * n <= _BITMAP:
            out.append(np.frombuffer(data, "<u2", n, at))
            at += 2 * n
        else:
            out.append(np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, _BITMAP, at), bitorder="little")))
            at += _BITMAP
    return out


def popcounts(data: bytes) -> tuple[int, int]:
    """Documents (of the planes' OR) and links (of the planes by their weight) of a container."""
    planes = planes_of(data)
    documents = len(np.unique(np.concatenate(planes))) if len(planes) > 1 else len(planes[0])
    return documents, sum(len(x) << k for k, x in enumerate(planes))


_DOC = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_INDEX = f"block long, slot int, {_DOC}, pair long, pair_docs long, pair_links long, planes binary"
_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(x.split()[0], _TYPES[x.split()[1]]) for x in ddl.split(", ")])


def _postings(block: int, codes: list[np.ndarray]) -> pa.RecordBatch:
    """The inverted rows of a block, whose documents in order have these pair codes."""
    slots = np.repeat(np.arange(len(codes)), [len(x) for x in codes])
    keys, times = np.unique(np.concatenate(codes) * SLOTS + slots, return_counts=True)
    pairs, slots = keys // SLOTS, keys % SLOTS
    starts = np.flatnonzero(np.diff(pairs, prepend=-1))
    ends = np.append(starts, len(pairs))[1:]
    planes = [packed(slots[i:j], times[i:j]) for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]
    links = np.add.reduceat(times, starts) if len(starts) else starts
    given = {"block": np.full(len(starts), block), "pair": pairs[starts], "pair_docs": ends - starts, "pair_links": links, "planes": planes}
    return _filled(given, len(starts))


def _filled(given: dict, n: int) -> pa.RecordBatch:
    schema = _schema(_INDEX)
    return pa.RecordBatch.from_arrays([pa.array(given[f.name], f.type) if f.name in given else pa.nulls(n, f.type) for f in schema], schema=schema)


def _indexer(ranks: str, pieces: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, block = Aligner(ranks, pieces), TaskContext.get().partitionId() << 32
        docs: list[tuple] = []
        codes: list[np.ndarray] = []
        n_links = 0

        def flush() -> Iterator[pa.RecordBatch]:
            columns = list(zip(*docs, strict=True))
            names = [x.split()[0] for x in _DOC.split(", ")]
            given = dict(zip(names, columns, strict=True)) | {"block": [block] * len(docs), "slot": range(len(docs))}
            yield _filled(given, len(docs))
            yield _postings(block, codes)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                n_a, n_b, digest, found = aligner(text)
                docs.append((doc_id, n_a, n_b, len(found), len(found), digest))
                codes.append(found)
                n_links += len(found)
                if len(docs) == SLOTS or n_links >= BLOCK_LINKS:
                    yield from flush()
                    docs.clear()
                    codes.clear()
                    block, n_links = block + 1, 0
        if docs:
            yield from flush()

    return run


def pair_index(docs: DataFrame, ranks: str | None = None, pieces: str | None = None) -> DataFrame:
    """The rows of all blocks: documents (with a ``slot``) and pairs (with ``pair = a * n_b + b`` and ``planes``)."""
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return some.mapInArrow(_indexer(ranks or default_ranks(), pieces or default_pieces()), _INDEX)


def pair_counts(index: DataFrame, n_b: int) -> DataFrame:
    """``pair, a, b, n_docs, n_links`` of every pair: popcounts summed over the containers of its bitmap."""
    counts = index.where("pair is not null").groupBy("pair").agg(F.sum("pair_docs").alias("n_docs"), F.sum("pair_links").alias("n_links"))
    return counts.select("pair", F.floor(F.col("pair") / n_b).alias("a"), (F.col("pair") % n_b).alias("b"), "n_docs", "n_links")


def _dealt(key, docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """A block's documents with the scores that its pairs' bitmaps deal to them."""
    total, best = np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int64)
    count, is_best = pairs.column("count").to_numpy(), pairs.column("best").to_numpy().astype(bool)
    slots: list[np.ndarray] = []
    row: list[int] = []
    weight: list[int] = []
    for i, data in enumerate(pairs.column("planes").to_pylist()):
        for k, on in enumerate(planes_of(data)):
            slots.append(on)
            row.append(i)
            weight.append(1 << k)
    if slots:
        lengths = [len(x) for x in slots]
        at, row_at, times = np.concatenate(slots), np.repeat(row, lengths), np.repeat(weight, lengths)
        np.add.at(total, at, times * count[row_at])
        np.add.at(best, at, times * is_best[row_at])
    place = docs.column("slot").to_numpy()
    names = [x.split()[0] for x in _DOC.split(", ")]
    return pa.table([docs.column(n) for n in names[:-1]] + [pa.array(best[place]), pa.array(total[place]), docs.column(names[-1])], schema=_schema(_SCORES))


_SCORES = _DOC.replace("n_links long", "n_links long, n_best long, count_sum long")


def alignment_scores(docs: DataFrame, ranks: str | None = None, pieces: str | None = None) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every document.

    Only pairs with their bitmaps, counts and scores are shuffled. The table of each B id's highest count has a row for every id of the model at most.
    """
    import sentencepiece

    n_b = sentencepiece.SentencePieceProcessor(model_file=pieces or default_pieces()).get_piece_size()
    with Scratch(docs.sparkSession) as scratch:
        index = scratch.written(pair_index(docs, ranks, pieces), "pair-index")
        counts = scratch.written(pair_counts(index, n_b).select("pair", "b", F.col("n_links").alias("count")), "pair-counts")
        highest = counts.groupBy("b").agg(F.max("count").alias("most"))
        scored = counts.join(F.broadcast(highest), "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
        returned = index.where("pair is not null").select("block", "pair", "planes").join(scored, "pair").select(F.col("block").alias("of"), "count", "best", "planes")
        placed = index.where("slot is not null").select("block", "slot", *[x.split()[0] for x in _DOC.split(", ")])
        return written(placed.groupBy("block").cogroup(returned.groupBy("of")).applyInArrow(_dealt, _SCORES), "alignment")
