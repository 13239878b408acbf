"""Cross-tokenizer alignment, word languages and whitening against brute force, held-out accuracy and closed forms."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from srclens.llm import alignment, queries, whitening, word_languages

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string"


# Alignment -------------------------------------------------------------------------------------------------------------------------


def byte_letters():
    """The byte that each letter of a byte-level vocabulary stands for."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def aligned(texts):
    """Rows of the contract by whole texts, other libraries and sets."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a_model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters = byte_letters()
    rows, links, counts = [], [], Counter()
    for text in texts:
        a = a_model.encode(" " + (text or ""), add_special_tokens=False).ids
        b = b_model.encode(text or "")
        bytes_a = [bytes(letters[c] for c in a_model.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(b_model.id_to_piece(i)[3:5], 16)]) if b_model.is_byte(i) else b_model.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            rows.append((0, 0, 0, 0, ""))
            links.append([])
            continue
        ends_a, ends_b = ({e: i for i, e in enumerate(itertools.accumulate(map(len, x)))} for x in (bytes_a, bytes_b))
        groups, own, i, j = [], [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            h, k = ends_a[end], ends_b[end]
            groups.append(",".join(map(str, a[i : h + 1])) + "|" + ",".join(map(str, b[j : k + 1])))
            own.append((a[h], b[k]))
            i, j = h + 1, k + 1
        counts.update(own)
        rows.append((len(a), len(b), len(groups), len(own), hashlib.sha256(";".join(groups).encode()).hexdigest()))
        links.append(own)
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return [(*r[:4], sum(counts[x] == most[x[1]] for x in own), sum(counts[x] for x in own), r[4]) for r, own in zip(rows, links, strict=True)]


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_alignment_of_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in queries.op11_pair_bitmaps(spark, SF).collect()}
    assert got == {d["doc_id"]: w for d, w in zip(docs, aligned([d["text"] for d in docs]), strict=True)}


def test_alignment_of_odd_rows(spark):
    r = random.Random(3)
    texts = [None, "", " ", "  ", "\n", "a", "a", "a ▁ b", "<|endoftext|> <s> <unk>", "x" * 5000, "é́ ＡＢ 漢字 🙂", "\x00\x01", "tab\t and \r\n line  two", "a  b", "  c"]
    texts += ["".join(r.choice([" ", "  ", "\n", "the", "ing", "é", "1", ".", "漢", "'s", "\t"]) for _ in range(r.randrange(40))) for _ in range(60)]
    rows = [(None if i == 5 else i // 2, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, DOC).withColumn("pair", F.lit("clash")).withColumn("block", F.lit(1))
    got = sorted((str(x["doc_id"]), *[x[c] for c in COLUMNS]) for x in alignment.alignment_scores(docs.repartition(3)).collect())
    assert got == sorted((str(d), *w) for (d, _), w in zip(rows, aligned(texts), strict=True))
    assert alignment.alignment_scores(spark.createDataFrame([], DOC)).count() == 0


def test_blocks_and_bitmaps(spark, monkeypatch):
    r = random.Random(1)
    for _ in range(200):
        slots = np.array(sorted(r.sample(range(alignment.SLOTS), r.choice([1, 2, 50, 300, 3000]))))
        times = np.array([r.choice([1, 1, 1, 2, 3, 9]) for _ in slots])
        data = alignment.packed(slots, times)
        back = np.zeros(alignment.SLOTS, int)
        for k, on in enumerate(alignment.planes_of(data)):
            back[on] += 1 << k
        assert (back[slots] == times).all() and back.sum() == times.sum()
        assert alignment.popcounts(data) == (len(slots), times.sum())
    docs = spark.createDataFrame([(i, "the cat sat on the mat " * (i % 5)) for i in range(50)], DOC)
    whole = sorted(alignment.alignment_scores(docs).collect())
    index = alignment.pair_index(docs.coalesce(1)).where("pair is not null").collect()
    assert all(alignment.popcounts(bytes(x["planes"])) == (x["pair_docs"], x["pair_links"]) for x in index)
    counts = {(x["a"], x["b"]): (x["n_docs"], x["n_links"]) for x in alignment.pair_counts(alignment.pair_index(docs), 32000).collect()}
    assert max(n for _, n in counts.values()) == 2 * sum(i % 5 for i in range(50)) and max(d for d, _ in counts.values()) == 40
    monkeypatch.setattr(alignment, "BLOCK_LINKS", 10)  # many blocks
    assert sorted(alignment.alignment_scores(docs).collect()) == whole


# Word languages --------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("piece", [1, 2, 3, 64])
@pytest.mark.parametrize("k", [1, 2, 3])
def test_marginals_against_all_labellings(k, piece):
    r = np.random.default_rng(k)
    factors, moves, start = r.random((7, k)), r.random((k, k)), r.random(k)
    lengths = np.array([1, 3, 6, 2, 5])
    ids = r.integers(0, 7, lengths.sum())
    got, at = word_languages.marginals(ids, lengths, factors, moves, start, piece), 0
    for n in lengths:
        x, want, total = ids[at : at + n], np.zeros((n, k)), 0.0
        for y in itertools.product(range(k), repeat=int(n)):
            weight = start[y[0]] * factors[x[0], y[0]] * math.prod(moves[y[t - 1], y[t]] * factors[x[t], y[t]] for t in range(1, n))
            total += weight
            want[range(n), y] += weight
        assert np.abs(want / total - got[at : at + n]).max() < 1e-12
        at += n


def test_languages_of_held_out_documents(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = queries.op12_word_languages(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(truth) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r["held_out"]]
    right = sum(r["lang_pred"] == truth[r["doc_id"]] for r in held)
    print(f"held-out accuracy: {right} of {len(held)}")
    assert right >= 0.98 * len(held) and all(0 <= r["score"] <= 1 for r in rows)


def test_words_of_code_switched_text(spark):
    """Halves of held-out documents of two languages: the words' labels follow the switch."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null and n_chars between 200 and 4000")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = word_languages.fit(docs.where(~held))
    by = defaultdict(list)
    for x in docs.where(held).orderBy("doc_id").collect():
        by[x["lang"]].append(word_languages.words_of(x["text"]))
    rows, truth = [], []
    for a, b in itertools.permutations(sorted(by), 2):
        for x, y in list(zip(by[a], by[b], strict=False))[:5]:
            rows.append((len(rows), " ".join(x[:60] + y[:60])))
            truth.append([a] * len(x[:60]) + [b] * len(y[:60]))
    got = {x["doc_id"]: x["langs"] for x in word_languages.word_labels(spark.createDataFrame(rows, DOC), model).collect()}
    right = sum(p == t for i, ts in enumerate(truth) for p, t in zip(got[i], ts, strict=True))
    total = sum(map(len, truth))
    print(f"words of switched text: {right / total:.4f} of {total}")
    assert right > 0.95 * total
    switched = word_languages.languages(spark.createDataFrame(rows, DOC), model).agg(F.avg("n_switches")).first()[0]
    assert 0.9 < switched < 3


def test_languages_of_odd_rows(spark):
    train = spark.createDataFrame([("de", "der Hund und die Katze"), ("en", "the dog and the cat"), (None, "x y"), ("fr", None), ("fr", "12")], "lang string, text string")
    model = word_languages.fit(train.unionByName(train))
    assert model.languages == ["de", "en"]
    texts = [None, "", "12 ²³ _", "The dog", "the dog", "der Hund " * 30_000, "a" * 100_000, "漢字", "und und"]
    rows = [(None if i == 3 else 7, t) for i, t in enumerate(texts)]
    got = word_languages.languages(spark.createDataFrame(rows, DOC).withColumn("score", F.lit("clash")), model).collect()
    found = [(x["lang_pred"], x["n_words"]) for x in sorted(got, key=lambda x: (x["n_words"], x["lang_pred"]))]
    assert found[:3] == [("und", 0)] * 3 and ("de", 60_000) in found and found.count(("en", 2)) == 2 and len(got) == len(texts)
    nothing = word_languages.fit(spark.createDataFrame([], "lang string, text string"))
    assert [x["lang_pred"] for x in word_languages.languages(spark.createDataFrame([(1, "a b")], DOC), nothing).collect()] == ["und"]
    alone = word_languages.fit(spark.createDataFrame([("xx", "a b")], "lang string, text string"))
    assert [(x["lang_pred"], x["score"]) for x in word_languages.languages(spark.createDataFrame([(1, "c")], DOC), alone).collect()] == [("xx", 1.0)]
    assert word_languages.languages(spark.createDataFrame([], DOC), model).count() == 0


# Whitening -------------------------------------------------------------------------------------------------------------------------


def symmetric(r, values):
    q = np.linalg.qr(r.standard_normal((len(values), len(values))))[0]
    v = (q * np.array(values)) @ q.T
    return (v + v.T) / 2


@pytest.mark.parametrize("n", [1, 2, 5, 20, 64])
def test_slices_against_a_full_decomposition(n):
    r = np.random.default_rng(n)
    cases = [symmetric(r, r.random(n)), np.eye(n) * 3, symmetric(r, np.repeat(r.random(n), 3)[:n]), symmetric(r, np.where(np.arange(n) < n // 2, r.random(n), 0)), np.zeros((n, n)), symmetric(r, 1 + 1e-9 * r.random(n))]
    for v in cases:
        want = np.linalg.eigvalsh(v)[::-1]
        found = whitening.Slices(v).leading(32)
        values, vectors = np.array([e for e, _ in found]), np.array([y for _, y in found]).reshape(-1, n)
        scale = max(abs(want).max(), 1e-300)
        assert len(found) == min(32, int((want > 1e-12 * scale).sum())) if want.any() else not found
        assert np.abs(values - want[: len(found)]).max(initial=0) < 1e-13 * n * scale
        assert np.abs(v @ vectors.T - vectors.T * values).max(initial=0) < 1e-13 * n * scale
        assert np.abs(vectors @ vectors.T - np.eye(len(found))).max(initial=0) < 1e-5


def test_inertia():
    r = np.random.default_rng(0)
    for n in range(1, 12):
        for _ in range(20):
            values = r.integers(-2, 3, n).astype(float)
            got = whitening.ldl_inertia(symmetric(r, values) if values.any() else np.zeros((n, n)))
            assert got[0] >= (values > 0).sum() and got[1] >= (values < 0).sum() and sum(got) == n
            if (values != 0).all():
                assert got == ((values > 0).sum(), (values < 0).sum(), 0)
    assert whitening.ldl_inertia(np.array([[0.0, 1], [1, 0]])) == (1, 1, 0)


def test_whitening_of_the_table(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in r["embedding"]] for r in rows])
    n, sums = len(x), x.sum(axis=0)
    d = x - sums / n
    v = d.T @ d / n
    want = np.linalg.eigvalsh(v)[::-1]
    got = defaultdict(dict)
    for r in queries.op13_spectrum_slicing(spark, SF).collect():
        got[r["vec_id"]][r["component"]] = r
    assert set(got) == {r["vec_id"] for r in rows} and all(sorted(c) == list(range(1, 33)) for c in got.values())
    white = np.array([[got[r["vec_id"]][k]["whitened"] for k in range(1, 33)] for r in rows])
    for r, xs in zip(rows, x.tolist(), strict=True):
        for k, found in got[r["vec_id"]].items():
            assert found["n"] == n and found["deviation"] == sum((n * c - s) ** 2 for c, s in zip(xs, sums.tolist(), strict=True))
            assert math.isclose(found["explained"], want[k - 1] / np.trace(v), rel_tol=1e-9)
    assert np.abs(white.T @ white / n - np.eye(32)).max() < 1e-9
    back = white * np.sqrt(want[:32])  # projections on unit vectors: their products are those of V's leading part
    e, y = np.linalg.eigh(v)
    assert np.abs(np.abs(d @ y[:, ::-1][:, :32]) - np.abs(back)).max() < 1e-6
    assert next(iter(got.values()))[1]["identity_error"] < 1e-9


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [3.0, -1.0]), (None, [0.5, 0.25]), (3, None), (4, []), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0, 2.0, 3.0]), (9, [1e30, 1.0]), (10, [0.0, 0.0])]
    for kind in ("float", "double"):
        table = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").withColumn("n", F.lit("clash")).repartition(3)
        got = whitening.whiten(table).collect()
        assert sorted((str(r["vec_id"]), r["component"]) for r in got) == sorted((str(i), k) for i in (1, 1, 2, None, 10) for k in (1, 2)) and {r["n"] for r in got} == {5}
        assert all(r["identity_error"] < 1e-9 for r in got)
    same = spark.createDataFrame([(i, [float(i), 1.0, float(i)]) for i in range(5)], "vec_id long, embedding array<float>")
    assert {r["component"] for r in whitening.whiten(same).collect()} == {1}  # one dimension varies
    for few in ([], [(1, [1.0])], [(1, None)], [(i, [2.0, 2.0]) for i in range(4)]):
        assert whitening.whiten(spark.createDataFrame(few, "vec_id long, embedding array<float>")).count() == 0
