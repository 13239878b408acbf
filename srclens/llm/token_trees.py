"""Token counts that follow edits: a stored segment tree of pre-token counts for every document.

A text is cut before spaces that follow a non-space character, where a byte-level vocabulary always
begins a pre-token; each chunk is one or a few pre-tokens. About ``LEAF``
chunks make a leaf, and every node above holds the sums of characters and tokens of ``FAN`` nodes below. :func:`with_trees` stores
these sums as a column beside the text. :func:`apply_edits` reads them back: a batch of edits finds its
leaves by descending the tree, encodes the chunks that it touches and one more on either side
(the context in which a boundary can move), as they were and as they are, and updates the sums on the paths to the root. Nothing else of the text is encoded again, and
the root's sum equals encoding the new text as a whole. A leaf that has grown beyond ``2 * LEAF`` chunks is split, which renews the sums above
(numbers only).

Defined results for odd input: a null text is empty and has 0 tokens; edits outside the text are cut to it;
overlapping edits are merged in order; null edits are none; repeated rows give repeated results; other columns are carried along by :func:`with_trees` and
:func:`apply_edits`, whose new columns replace those of their names; an empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from srclens.llm.common import written

LEAF = 64
FAN = 16
CACHED_CHUNKS = 600_000
LONGEST_CHUNK = 64
_CUT = re.compile(r"(?<=\S)(?= )")


class Counter:
    """Token counts of chunks by a tokenizer file or a file of ranks, with a bounded cache. Special tokens in texts are ordinary text."""

    def __init__(self, path: str) -> None:
        if path.endswith(".tiktoken"):
            from srclens.llm.packing import rank_encoding

            self.tokenizer = None
            self.ids = rank_encoding(path).encode_ordinary
        else:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(path)
            self.tokenizer.encode_special_tokens = True
            self.ids = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        self.cache: dict[str, int] = {}

    def one(self, chunk: str) -> int:
        n = self.cache.get(chunk)
        if n is None:
            n = len(self.ids(chunk))
            if len(chunk) <= LONGEST_CHUNK:
                if len(self.cache) >= CACHED_CHUNKS:
                    self.cache.clear()
                self.cache[chunk] = n
        return n


#: White space of the tokenizer's pattern followed by a space: only there may a space not begin a chunk.
_SPACES = [c + " " for c in " \t\n\x0b\f\r"]
_WIDE_SPACES = [chr(c) + " " for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


def chunks_of(text: str) -> list[str]:
    """The text's chunks; together they are the text."""
    if not text:
        return []
    if any(s in text for s in _SPACES) or (not text.isascii() and any(s in text for s in _WIDE_SPACES)):
        return _CUT.split(text)
    first, *rest = text.split(" ")
    out = [" " + x for x in rest]
    if first:
        out.insert(0, first)
    return out


class TokenTree:
    """A text and its sums of characters and tokens, level by level from the leaves up to one root."""

    def __init__(self, text: str, counter: Counter, levels: list[list[int]] | None = None) -> None:
        self.text, self.counter = text, counter
        self.encoded = 0
        #: The leaf found last and where its chunks start and end, as edits come in order; None after a change.
        self.near: tuple[int, list[int]] | None = None
        if levels is None:
            self._build(self._leaves(chunks_of(text)))
        else:
            self.levels = [np.array(x, np.int64).reshape(-1, 2) for x in levels]

    def _counts(self, chunks: list[str]) -> list[int]:
        counts = list(map(self.counter.cache.get, chunks))
        if None in counts:
            counts = [self.counter.one(c) if n is None else n for c, n in zip(chunks, counts, strict=True)]
        self.encoded += len(chunks)
        return counts

    def _leaves(self, chunks: list[str]) -> np.ndarray:
        """Characters and tokens of leaves of LEAF chunks."""
        if not chunks:
            return np.zeros((1, 2), np.int64)
        counts = self._counts(chunks)
        at = np.arange(0, len(chunks), LEAF)
        lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
        return np.stack([np.add.reduceat(lengths, at), np.add.reduceat(np.array(counts, np.int64), at)], axis=1)

    def _build(self, leaves: np.ndarray) -> None:
        self.levels = [leaves]
        while len(self.levels[-1]) > 1:
            below = self.levels[-1]
            self.levels.append(np.add.reduceat(below, np.arange(0, len(below), FAN), axis=0))

    @property
    def n_tokens(self) -> int:
        return int(self.levels[-1][0, 1])

    @property
    def n_chars(self) -> int:
        return int(self.levels[-1][0, 0])

    def stored(self) -> list[list[int]]:
        return [x.ravel().tolist() for x in self.levels]

    def find(self, offset: int) -> tuple[int, int, int]:
        """The leaf that holds the character at ``offset``, or the last one with any, and where it starts and ends."""
        node, start = 0, 0
        offset = min(offset, self.n_chars - 1)
        for level in reversed(self.levels[:-1]):
            below = level[node * FAN : (node + 1) * FAN, 0]
            ends = start + np.cumsum(below)
            k = min(int(np.searchsorted(ends, offset, "right")), len(below) - 1)
            start = int(ends[k] - below[k])
            node = node * FAN + k
        return node, start, start + int(self.levels[0][node, 0])

    def _leaf(self, offset: int) -> tuple[int, list[int]]:
        """The leaf of the character at ``offset`` and the bounds of its chunks."""
        if self.near is None or not self.near[1][0] <= offset < self.near[1][-1]:
            leaf, start, end = self.find(offset)
            self.near = leaf, list(accumulate(map(len, chunks_of(self.text[start:end])), initial=start))
        return self.near

    def _chunk(self, offset: int) -> tuple[int, int]:
        """Where the chunk of the character at ``offset`` starts and ends."""
        bounds = self._leaf(offset)[1]
        k = min(bisect_right(bounds, offset) - 1, len(bounds) - 2)
        return bounds[k], bounds[k + 1]

    def _taken(self, low: int, high: int, changes: dict[int, list[int]]) -> int:
        """Takes the characters and tokens between two chunk bounds from their leaves; returns the first leaf.

        A leaf that goes as a whole takes its stored sums along; only parts of leaves are encoded.
        """
        if low >= high:
            return self._leaf(low)[0] if self.text else 0
        leaf, bounds = self._leaf(low)
        first, start, end = leaf, bounds[0], bounds[-1]
        while True:
            upto = min(high, end)
            if low == start and upto == end:
                tokens = int(self.levels[0][leaf, 1])
            else:
                tokens = sum(self._counts(chunks_of(self.text[low:upto])))
            change = changes.setdefault(leaf, [0, 0])
            change[0] -= upto - low
            change[1] -= tokens
            if upto == high:
                return first
            low = start = end
            while start == end:  # leaves without characters are passed over
                leaf += 1
                end += int(self.levels[0][leaf, 0])

    def apply(self, edits: list[tuple[int, int, str]]) -> int:
        """Replace the character ranges ``[start, end)`` of the present text; returns the chunks encoded again."""
        size = self.n_chars
        regions: list[list] = []  # first and last character of the chunks to encode, and the edits between
        reach = 0
        for start, end, new in sorted(edits, key=lambda x: (x[0], x[1])):
            start = min(max(start, reach, 0), size)
            end = min(max(end, start), size)
            reach = end
            low, high = 0, size
            if size:
                last = size - 1
                low = self._chunk(min(start, last))[0]
                low = self._chunk(low - 1)[0] if low else 0
                high = self._chunk(min(max(end - 1, start), last))[1]
                high = self._chunk(high)[1] if high < size else size
            if regions and low < regions[-1][1]:
                regions[-1][1] = max(high, regions[-1][1])
                regions[-1][2].append((start, end, new))
            else:
                regions.append([low, high, [(start, end, new)]])
        before = self.encoded
        changes: dict[int, list[int]] = {}  # characters and tokens that leaves gain
        grown: dict[int, int] = {}  # chunks put into leaves
        parts, at = [], 0
        for low, high, inside in regions:
            first = self._taken(low, high, changes)
            made, start = [], low
            for a, b, new in inside:
                made += [self.text[start:a], new]
                start = b
            made = "".join([*made, self.text[start:high]])
            parts += [self.text[at:low], made]
            at = high
            chunks = chunks_of(made)
            change = changes.setdefault(first, [0, 0])
            change[0] += len(made)
            change[1] += sum(self._counts(chunks))
            grown[first] = grown.get(first, 0) + len(chunks)
        self.text = "".join([*parts, self.text[at:]])
        self.near = None
        for leaf, change in changes.items():
            self.levels[0][leaf] += change
        large = sorted(x for x, n in grown.items() if n > LEAF)
        if large:
            self._split(large)
        else:
            nodes = set(changes)
            for below, level in zip(self.levels, self.levels[1:], strict=False):
                nodes = {x // FAN for x in nodes}
                for x in nodes:
                    level[x] = below[x * FAN : (x + 1) * FAN].sum(axis=0)
        return self.encoded - before

    def _split(self, large: list[int]) -> None:
        """Leaves of more than ``2 * LEAF`` chunks become several; the sums above are renewed."""
        leaves = self.levels[0]
        starts = np.concatenate([[0], np.cumsum(leaves[:, 0])])
        out, at = [], 0
        for x in large:
            chunks = chunks_of(self.text[int(starts[x]) : int(starts[x + 1])])
            if len(chunks) > 2 * LEAF:
                out += [leaves[at:x], self._leaves(chunks)]
                at = x + 1
        leaves = np.concatenate([*out, leaves[at:]])
        filled = leaves[leaves[:, 0] > 0]
        self._build(filled if len(filled) else leaves[:1])


#: Cleaning edits of the registered query: symbol runs go, addresses and long numbers become short marks.
CLEANING = re.compile(r"[#*$%&|<>]{3,}|(?<!\S)[^\s@]+@[^\s@]+|[0-9]{12,}")


def cleaning_edits(text: str) -> list[tuple[int, int, str]]:
    """Edits of a text: what CLEANING finds, and the removal of the word in the middle."""
    marks = {"#": "", "@": "<mail>", "0": "<number>"}
    edits = []
    for m in CLEANING.finditer(text):
        found = m[0]
        kind = "@" if "@" in found else "0" if found.isdigit() else "#"
        edits.append((m.start(), m.end(), marks[kind]))
    start = text.find(" ", len(text) // 2)
    if start >= 0:
        end = text.find(" ", start + 1)
        edits.append((start, end if end >= 0 else len(text), ""))
    return edits


def edited(text: str, edits: list[tuple[int, int, str]]) -> str:
    """The text after edits, as TokenTree.apply has them."""
    out, at = [], 0
    for start, end, new in sorted(edits, key=lambda x: (x[0], x[1])):
        start = min(max(start, at), len(text))
        out += [text[at:start], new]
        at = min(max(end, start), len(text))
    return "".join([*out, text[at:]])


_TREE = "array<array<bigint>>"
_ARROW_TREE = pa.list_(pa.list_(pa.int64()))


def _path(tokenizer: str | None) -> str:
    from srclens.llm.packing import default_ranks

    return tokenizer or default_ranks()


def _appended(df: DataFrame, new: dict[str, str], each, path: str) -> DataFrame:
    """``df`` with the columns ``new`` of ``each(counter, batch)``, which replace columns of their names."""
    kept = [f for f in df.schema.fields if f.name not in new]
    schema = T.StructType([*kept, *T._parse_datatype_string(", ".join(f"{n} {t}" for n, t in new.items())).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        for batch in batches:
            found = each(counter, batch)
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], *found], [*[f.name for f in kept], *new])

    return df.mapInArrow(run, schema)


def with_trees(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """``docs`` with ``tree`` (levels from the leaves up, characters and tokens in turn), ``n_tokens`` and ``n_chunks`` of ``text``."""

    def each(counter: Counter, batch: pa.RecordBatch) -> list[pa.Array]:
        trees = [TokenTree(x or "", counter) for x in batch.column("text").to_pylist()]
        return [pa.array([t.stored() for t in trees], _ARROW_TREE), *[pa.array(x, pa.int64()) for x in ([t.n_tokens for t in trees], [t.encoded for t in trees])]]

    return _appended(docs, {"tree": _TREE, "n_tokens": "bigint", "n_chunks": "bigint"}, each, _path(tokenizer))


def apply_edits(stored: DataFrame, edits_of=None, tokenizer: str | None = None) -> DataFrame:
    """``stored`` (``text``, ``tree``) after its edits: new ``text``, ``tree``, ``n_tokens``, and ``n_edits``, ``n_reencoded`` (chunks).

    Edits are the column ``edits array<struct<start, end, new>>``, or what ``edits_of(text)`` gives.
    """

    def each(counter: Counter, batch: pa.RecordBatch) -> list[pa.Array]:
        texts, trees = batch.column("text").to_pylist(), batch.column("tree").to_pylist()
        given = None if edits_of else batch.column("edits").to_pylist()
        rows = []
        for i, (text, levels) in enumerate(zip(texts, trees, strict=True)):
            tree = TokenTree(text or "", counter, levels)
            edits = edits_of(text or "") if edits_of else [(e["start"], e["end"], e["new"] or "") for e in given[i] or []]
            again = tree.apply(edits)
            rows.append((text if text is None and not edits else tree.text, tree.stored(), tree.n_tokens, len(edits), again))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        return [pa.array(columns[0], pa.string()), pa.array(columns[1], _ARROW_TREE), *[pa.array(x, pa.int64()) for x in columns[2:]]]

    new = {"text": "string", "tree": _TREE, "n_tokens": "bigint", "n_edits": "bigint", "n_reencoded": "bigint"}
    return _appended(stored, new, each, _path(tokenizer))


def edit_counts(docs: DataFrame, edits_of=cleaning_edits, tokenizer: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, n_tokens_edited, n_chunks, n_edits, n_reencoded`` of every row: trees are stored, read back and edited."""
    stored = written(with_trees(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), tokenizer), "token-trees")
    edited_ = apply_edits(stored.withColumn("n_before", F.col("n_tokens")), edits_of, tokenizer)
    return edited_.select("doc_id", F.col("n_before").alias("n_tokens"), F.col("n_tokens").alias("n_tokens_edited"), "n_chunks", "n_edits", "n_reencoded")
