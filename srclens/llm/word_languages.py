"""Language identification by a linear-chain conditional random field over words.

Every word of a text has a language; the field scores it by the word's affixes, letter n-grams and entries in a lexicon (hashed features, a weight a
language), and by a learned transition from the language of the word before. Forward-backward gives each word's
probabilities, so that code-switched text is labelled word by word; the text's language is the one with the largest sum of them, and the score its share.

The model is fitted on a bounded sample of labelled rows: at most ``FIT_ROWS`` different texts, shared evenly by the ``LANGUAGES`` most frequent languages
(at least ``FIT_LEAST`` each), those of up to ``FIT_CHARS`` characters first, by hash of the text. Half of it gives the lexicon, the other half the weights: its texts are cut to spans of
about ``SPAN`` words, which are laid end to end in random order, so that the transitions are those of code-switched text.

Long texts are cut to pieces of ``PIECE`` words. Transfer matrices carry the messages across pieces, so that all pieces of many texts take their steps together and
the result is that of the whole text.

Defined results for odd input: words are runs of letters in lower case, cut after 32; a null text, or one without a letter, is ``und`` with score 0, as every text is
if nothing was learned; ties go to the first language by code point; a null or repeated doc_id is as any other; rows without a language aren't learned from; an
empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "und"
FIT_ROWS, FIT_LEAST, FIT_CHARS, LANGUAGES = 2000, 8, 20_000, 256
LEXICON = 50_000
BUCKETS = 1 << 16
SPAN = 40
PIECE = 64
STEPS = 40
#: Words whose scores a Python worker keeps, and words that are labelled together.
CACHED_WORDS = 200_000
GROUP_WORDS = 400_000
_WORD = re.compile(r"[^\W\d_]{1,32}")


def words_of(text: str | None) -> list[str]:
    """The words of a text; none if it has no letter."""
    found = _WORD.findall((text or "").lower())
    if found and not any(map(str.isalpha, found)):  # numerals and the like are no letters
        found = [w for w in found if any(c.isalpha() for c in w)]
    return found


def features(word: str, lexicon: dict[str, str]) -> list[int]:
    """Hashed features: affixes of 1 to 4 letters, n-grams of 2 and 3 with the word's ends, and the lexicon's entry."""
    n, inner = len(word), f"^{word}$"
    names = ["bias", "lex=" + lexicon.get(word, "")]
    names += ["pre=" + word[:k] for k in range(1, min(n, 4) + 1)] + ["suf=" + word[-k:] for k in range(1, min(n, 4) + 1)]
    names += [inner[i : i + k] for k in (2, 3) for i in range(n + 3 - k)]
    return [zlib.crc32(x.encode()) % BUCKETS for x in names]


@dataclass
class Model:
    languages: list[str]
    lexicon: dict[str, str] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS, 0), np.float32))
    transitions: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    start: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def emissions(self, words: list[str]) -> np.ndarray:
        """The factor of each word and language, at most 1."""
        found = [features(w, self.lexicon) for w in words]
        return _factors(_summed(self.weights, *_rows(found)))


def _rows(found: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    flat = np.fromiter((x for row in found for x in row), np.int64)
    return flat, np.cumsum([0, *map(len, found[:-1])])


def _summed(weights: np.ndarray, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(weights[flat], starts, axis=0).astype(float)


def _factors(scores: np.ndarray) -> np.ndarray:
    return np.exp(np.maximum(scores - scores.max(axis=-1, keepdims=True), -60))


def _scaled(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=-1, keepdims=True)


def marginals(ids: np.ndarray, lengths: np.ndarray, factors: np.ndarray, transitions: np.ndarray, start: np.ndarray, piece: int = PIECE) -> np.ndarray:
    """The probabilities of every word's languages; ``ids`` are the texts' words one after another, rows of ``factors``.

    ``transitions`` and ``start`` are factors as well. Texts have a word at least.
    """
    n_pieces = -(-lengths // piece)
    text = np.repeat(np.arange(len(lengths)), n_pieces)
    first_piece = np.cumsum(n_pieces) - n_pieces
    index = np.arange(len(text)) - first_piece[text]
    begin = (np.cumsum(lengths) - lengths)[text] + index * piece
    size = np.minimum(lengths[text] - index * piece, piece)
    k = len(start)
    before = np.broadcast_to(start, (len(text), k)).copy()  # forward messages into pieces
    after = np.ones((len(text), k))  # backward messages out of them
    if (n_pieces > 1).any():
        many = np.flatnonzero(n_pieces[text] > 1)
        many = many[np.argsort(-size[many], kind="stable")]
        lead = np.where((index[many] == 0)[:, None, None], np.eye(k), transitions)
        moved = lead * factors[ids[begin[many]]][:, None, :]
        for t in range(1, piece):
            on = int(np.searchsorted(-size[many], -t))  # pieces longer than t stand first
            if not on:
                break
            step = (moved[:on] @ transitions) * factors[ids[begin[many[:on]] + t]][:, None, :]
            moved[:on] = step / step.max(axis=(1, 2), keepdims=True)
        transfer = np.empty((len(text), k, k))
        transfer[many] = moved
        most = int(n_pieces.max())
        longest = np.argsort(-n_pieces, kind="stable")
        for i in range(1, most):
            at = first_piece[longest[: int(np.searchsorted(-n_pieces[longest], -i))]] + i
            before[at] = _scaled(np.einsum("nk,nkl->nl", before[at - 1], transfer[at - 1]))
        for i in range(most - 1, 0, -1):
            at = first_piece[longest[: int(np.searchsorted(-n_pieces[longest], -i))]] + i
            after[at - 1] = _scaled(np.einsum("nkl,nl->nk", transfer[at], after[at]))
    order = np.argsort(-size, kind="stable")
    begin, size, first = begin[order], size[order], (index == 0)[order]
    before, after = before[order], after[order]
    on = [int(np.searchsorted(-size, -t)) for t in range(piece)]
    alpha = np.empty((len(ids), k))
    now = _scaled(np.where(first[:, None], before, before @ transitions) * factors[ids[begin]])
    alpha[begin] = now
    for t in range(1, piece):
        if not on[t]:
            break
        at = begin[: on[t]] + t
        now = _scaled((now[: on[t]] @ transitions) * factors[ids[at]])
        alpha[at] = now
    beta = after
    for t in range(piece - 1, -1, -1):
        at = begin[: on[t]] + t
        alpha[at] = _scaled(alpha[at] * beta[: on[t]])
        if t:
            beta[: on[t]] = _scaled((beta[: on[t]] * factors[ids[at]]) @ transitions.T)
    return alpha


def _stream(texts: list[tuple[int, list[str]]], seed: int = 1) -> tuple[list[str], np.ndarray]:
    """Spans of all texts in random order, and the language of each word."""
    r = np.random.default_rng(seed)
    spans = []
    for language, words in texts:
        at = 0
        while at < len(words):
            n = int(r.geometric(1 / SPAN))
            spans.append((language, words[at : at + n]))
            at += n
    words: list[str] = []
    labels: list[int] = []
    for i in r.permutation(len(spans)).tolist():
        words += spans[i][1]
        labels += [spans[i][0]] * len(spans[i][1])
    return words, np.array(labels, np.int64)


def lexicon_of(texts: list[tuple[int, list[str]]], languages: list[str], most: int = LEXICON) -> dict[str, str]:
    """The language that a word mostly stands in, with one of three grades of certainty, for the most frequent words."""
    counts = [Counter() for _ in languages]
    for language, words in texts:
        counts[language].update(words)
    total = sum(counts, Counter())
    out = {}
    for word, n in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:most]:
        if n < 2:
            break
        best = max(range(len(languages)), key=lambda k: (counts[k][word], -k))
        share = counts[best][word] / (n + 1)
        out[word] = f"{languages[best]}={1 + (share > 0.6) + (share > 0.9)}"
    return out


def trained(texts: list[tuple[str, str]], steps: int = STEPS) -> Model:
    """The model of ``(language, text)`` rows by maximum likelihood with a small penalty, Adam over all of them."""
    split = [(lang, words) for lang, words in ((lang, words_of(t)) for lang, t in texts) if words]
    languages = sorted({lang for lang, _ in split})
    number = {x: i for i, x in enumerate(languages)}
    rows = [(number[lang], words) for lang, words in split]
    seen: Counter = Counter()
    halves: tuple[list, list] = ([], [])
    for lang, words in rows:  # in turn, so that either half has every language with two texts
        halves[seen[lang] % 2].append((lang, words))
        seen[lang] += 1
    model = Model(languages, lexicon_of(halves[1], languages))
    words, labels = _stream(halves[0])
    k, n = len(languages), len(words)
    if k < 2:
        return Model(languages, model.lexicon, np.zeros((BUCKETS, k), np.float32), np.ones((k, k)), np.ones(k))
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(vocabulary.__getitem__, words), np.int64, n)
    flat, starts = _rows([features(w, model.lexicon) for w in vocabulary])
    of_feature = np.repeat(np.arange(len(vocabulary)), np.diff([*starts, len(flat)]))
    piece = 32
    lengths = np.full(-(-n // piece), piece)
    lengths[-1] = n - piece * (len(lengths) - 1)
    heads = np.cumsum(lengths) - lengths
    inside = np.ones(n, bool)
    inside[heads] = False
    later = np.flatnonzero(inside)
    # Numbers of what the stream has: languages of words, of sequence heads, and of neighbours.
    seen_words = np.stack([np.bincount(ids[labels == j], minlength=len(vocabulary)) for j in range(k)], axis=1)
    seen_heads = np.bincount(labels[heads], minlength=k)
    seen_pairs = np.bincount(labels[later - 1] * k + labels[later], minlength=k * k).reshape(k, k)
    params = [np.zeros((BUCKETS, k)), np.zeros((k, k)), np.zeros(k)]
    first = [np.zeros_like(p) for p in params]
    second = [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        factors = _factors(_summed(params[0], flat, starts))
        moves, begins = np.exp(params[1] - params[1].max()), np.exp(params[2] - params[2].max())
        p = marginals(ids, lengths, factors, moves, begins, piece)
        # Neighbours' joint probabilities, from the forward messages that the marginals imply.
        joint = _joint(p, ids, later, factors, moves, begins, lengths, piece)
        words_gain = seen_words - np.stack([np.bincount(ids, p[:, j], len(vocabulary)) for j in range(k)], axis=1)
        gain = np.stack([np.bincount(flat, words_gain[of_feature, j], BUCKETS) for j in range(k)], axis=1)
        slopes = [gain, seen_pairs - joint, seen_heads - p[heads].sum(axis=0)]
        for j, slope in enumerate(slopes):
            slope = slope / n - 1e-7 * params[j]
            first[j] = 0.9 * first[j] + 0.1 * slope
            second[j] = 0.99 * second[j] + 0.01 * slope**2
            rate = 0.2 * (1 - 0.5 * step / steps)
            params[j] = params[j] + rate * (first[j] / (1 - 0.9**step)) / (np.sqrt(second[j] / (1 - 0.99**step)) + 1e-8)
    return Model(languages, model.lexicon, params[0].astype(np.float32), np.exp(params[1] - params[1].max()), np.exp(params[2] - params[2].max()))


def _joint(p, ids, later, factors, moves, begins, lengths, piece) -> np.ndarray:
    """The expected numbers of language pairs of neighbours: p(next | word before) follows from the backward messages."""
    k = len(begins)
    size = lengths
    begin = np.cumsum(size) - size
    on = [int((size > t).sum()) for t in range(piece)]
    beta = np.ones((len(size), k))
    total = np.zeros((k, k))
    for t in range(piece - 1, 0, -1):
        at = begin[: on[t]] + t
        onward = factors[ids[at]] * beta[: on[t]]
        rest = onward @ moves.T  # of every language of the word before
        total += ((p[at - 1] / rest).T @ onward) * moves
        beta[: on[t]] = _scaled(rest)
    return total


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS, steps: int = STEPS) -> Model:
    """The model of a bounded sample of ``text, lang`` rows."""
    some = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    some = some.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = some.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    if not counts:
        return Model([])
    quota = max(fit_rows // len(counts), FIT_LEAST)
    # A share of each language that holds a few times its quota, so that little is sorted.
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, 4 * quota / r["count"])) for r in counts], "lang string, share double")
    low, high = F.xxhash64("text"), F.hash("text")
    drawn = some.join(F.broadcast(shares), "lang").withColumn("_low", low)
    drawn = drawn.where((F.pmod(F.col("_low"), F.lit(1 << 30)) < F.col("share") * (1 << 30)))
    drawn = drawn.groupBy("lang", "_low", high.alias("_high")).agg(F.min("text").alias("text"))  # copies are one text
    by = Window.partitionBy("lang").orderBy(F.length("text") > FIT_CHARS, "_low", "_high", "text")
    drawn = drawn.withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= quota).orderBy("lang", "_n").select("lang", "text")
    return trained([(r["lang"], r["text"]) for r in drawn.collect()], steps)


class Labeller:
    """Word labels of texts by a model, with a bounded cache of words."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.rows: dict[str, int] = {}
        self.factors = np.empty((1024, len(model.languages)))

    def _ids(self, texts: list[list[str]]) -> np.ndarray:
        if len(self.rows) > CACHED_WORDS:
            self.rows.clear()
        rows = self.rows
        new = [w for w in dict.fromkeys(w for words in texts for w in words) if w not in rows]
        if new:
            at = len(rows)
            rows.update(zip(new, range(at, at + len(new)), strict=True))
            if len(rows) > len(self.factors):
                grown = np.empty((2 * len(rows), self.factors.shape[1]))
                grown[:at] = self.factors[:at]
                self.factors = grown
            for i in range(0, len(new), 20_000):
                some = new[i : i + 20_000]
                self.factors[at + i : at + i + len(some)] = self.model.emissions(some)
        return np.fromiter((rows[w] for words in texts for w in words), np.int64)

    def __call__(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Probabilities of the languages of every word of each text, none of which is empty."""
        if not texts:
            return []
        lengths = np.array([len(x) for x in texts])
        found = marginals(self._ids(texts), lengths, self.factors, self.model.transitions, self.model.start)
        return np.split(found, np.cumsum(lengths)[:-1])


LABELLED = "lang_pred string, score double, n_words long, n_switches long"


def languages(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score, n_words, n_switches`` of every row; a switch is a word in another language than the word before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(model)
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            at = 0
            while at < len(ids):
                begin, group, n = at, [], 0
                while at < len(ids) and n < GROUP_WORDS:
                    group.append(words_of(texts[at].as_py()) if model.languages else [])
                    n += len(group[-1])
                    at += 1
                found = iter(labeller([w for w in group if w]))
                out = []
                for words in group:
                    if not words:
                        out.append((UNKNOWN, 0.0, 0, 0))
                        continue
                    p = next(found)
                    mean, labels = p.mean(axis=0), p.argmax(axis=1)
                    best = int(mean.argmax())
                    out.append((model.languages[best], min(float(mean[best]), 1.0), len(words), int(np.count_nonzero(np.diff(labels)))))
                lang, score, n_words, switches = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(begin, at - begin), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(n_words, pa.int64()), pa.array(switches, pa.int64())],
                    ["doc_id", "lang_pred", "score", "n_words", "n_switches"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, {LABELLED}")


def word_labels(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, words, langs``: the words of every text and the language of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(model)
        names = np.array(model.languages, object)
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = words_of(text) if model.languages else []
                langs = names[labeller([words])[0].argmax(axis=1)].tolist() if words else []
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc_id], pa.int64()), pa.array([words], pa.list_(pa.string())), pa.array([langs], pa.list_(pa.string()))], ["doc_id", "words", "langs"]
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, words array<string>, langs array<string>")
