"""Quality rules, surrogates, line templates and mixing against plain Python."""

import random
import re
from collections import Counter, defaultdict
from pathlib import Path

import xxhash
from pyspark.sql import functions as F

from srclens.llm import line_templates, mixing, pii_surrogates, quality_llr
from srclens.llm.common import shared_dir, written

WS = " \t\n\x0b\f\r"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, source=None):
    return spark.createDataFrame([(i, t, "en", source[i] if source else "s", len(t or "")) for i, t in enumerate(texts)], DOC)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def base(text):
    w = words(text)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return (len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def h64(data, seed=42):
    v = xxhash.xxh64(data, seed=seed).intdigest()
    return v - (1 << 64) if v >> 63 else v


def test_quality_equals_brute_force(spark):
    import math

    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(40)] + ["a#b", "$$$", "é", " x"]
    texts = [None, "", "one", "a b c", "a b c a b c", "x\nx\n\n \nx"] + ["".join(r.choice(vocabulary) + r.choice([" ", "  ", "\n", "\t"]) for _ in range(r.randrange(1, 160))) for _ in range(40)]
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(6, 40)] + [(7, None, None)], "doc_id long, quality int, toxic int")
    got = {x["doc_id"]: x for x in quality_llr.score_documents(docs, labels, n_buckets=256, threshold=-0.1).collect()}
    trusted = {i for i in range(6, 40) if i % 3 > 0}

    def grams(text):
        hs = [h64(w.encode()) for w in words(text)]
        return [h % 256 for h in hs] + [h64(b.to_bytes(8, "little", signed=True), h64(a.to_bytes(8, "little", signed=True)) % (1 << 64)) % 256 for a, b in zip(hs, hs[1:])]

    raw, target = Counter(), Counter()
    for i, t in enumerate(texts):
        raw.update(grams(t))
        if i in trusted:
            target.update(grams(t))
    n, m = sum(raw.values()), sum(target.values())
    weight = [round((math.log((target[b] + 1) / (m + 256)) - math.log((raw[b] + 1) / (n + 256))) * 1e6) for b in range(256)]
    for i, t in enumerate(texts):
        x = got[i]
        assert tuple(x["_base"]) == base(t), (i, t)
        g = grams(t)
        score = sum(weight[b] for b in g) / (len(g) * 1e6) if g else None
        assert (score is None and x["_llr"] is None) or abs(score - x["_llr"]) < 2e-6
        b = base(t)
        failed = b[0] < 50 or 100 * b[4] > 50 * b[0]
        assert x["_failed"] == failed and x["_kept"] == (not failed and (score or 0) >= -0.1)


def test_repeated_windows_in_long_texts(spark, monkeypatch):
    """Few upper bits make different windows meet, as they do in texts of many million words."""
    r = random.Random(17)
    texts = [" ".join(f"w{r.randrange(30)}" for _ in range(r.randrange(3, 400))) for _ in range(20)] + ["a b c " * 20_000]
    docs = docs_of(spark, texts)
    for bits in (26, 55, 6):
        monkeypatch.setattr(quality_llr, "POSITION_BITS", bits)
        got = {x["doc_id"]: tuple(x["_base"]) for x in quality_llr.base_features(docs).collect()}
        assert all(got[i] == base(t) for i, t in enumerate(texts)), bits


def test_quality_without_labels_or_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    long_text = " ".join(f"w{i}" for i in range(60))
    kept = quality_llr.keep_good(docs_of(spark, [long_text, None, "", long_text]).withColumn("_kept", F.lit("clash")), labels)
    assert [r["doc_id"] for r in kept.orderBy("doc_id").collect()] == [0, 3] and kept.columns[-1] == "_kept"
    assert quality_llr.keep_good(docs_of(spark, []), labels).count() == 0


def test_quality_parts_both_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    judged = written(quality_llr.score_documents(docs.select("doc_id", "text"), labels).select("doc_id", "_failed", "_kept"), "judged")
    judged = judged.where("not _failed").join(labels, "doc_id").groupBy("quality")
    kept = {r["quality"]: (r["n"], r["kept"]) for r in judged.agg(F.count("*").alias("n"), F.sum(F.col("_kept").cast("int")).alias("kept")).collect()}
    assert kept[0][0] >= 200 and kept[0][1] <= 0.05 * kept[0][0], kept
    assert kept[1][1] >= 0.98 * kept[1][0], kept


def test_quality_threshold_lies_between():
    assert quality_llr.best_cut([(-300, 0, 5), (-101, 0, 1), (-50, 2, 0), (3, 9, 0)]) == -0.075
    assert quality_llr.best_cut([(-300, 0, 50), (-200, 1, 0), (-100, 0, 1), (0, 90, 0)]) == -0.0495
    assert quality_llr.best_cut([(5, 3, 0)]) is quality_llr.best_cut([(5, 0, 3)]) is quality_llr.best_cut([]) is None


def test_surrogates(spark):
    text = "Mail Bob.X@mail.org or bob.x@mail.org, call +1 (564) 555-4526 or +1 564 555 4526. Mr. John Smith and Mrs. Anna Smith-Jones met Herr MÜLLER."
    more = 'token = "6df57b16f87eabefefcab67b433efd90636bb6bd" card 4111 1111 1111 1111 and 4111111111111111 at 217.94.102.185, DE89 3704 0044 0532 0130 00'
    docs = docs_of(spark, [text, more, None, "", "господин Иван Петров", "plain text 12 of 2020-01-02", text]).withColumn("n_entities", F.lit("clash"))
    got = {r["doc_id"]: r for r in pii_surrogates.replace_pii(docs, "k1").collect()}
    a, b = got[0]["text"], got[1]["text"]
    for private in ("Bob.X", "mail.org, ", "555-4526", "564 555", "John", "Smith", "Anna", "Jones", "LLER", "6df57b16", "4111 1111", "41111111", "217.94", "3704"):
        assert private not in a + b
    mails = re.findall(r"\S+@\S+\.org", a)
    assert mails[0].rstrip(",").lower() == mails[1].rstrip(",")  # coreference
    phone = re.search(r"\+1 \((\d{3})\) (\d{3})-(\d{4}) or \+1 (\d{3}) (\d{3}) (\d{4})", a)
    assert phone.groups()[:3] == phone.groups()[3:]
    names = re.search(r"Mr\. (\w+) (\w+) and Mrs\. (\w+) (\w+)-(\w+) met Herr (\w+)\.", a)
    assert names and names[2] == names[4] and names[6].isupper() and names[1].endswith("rus") and names[3].endswith("ria")
    card = re.search(r"card ([\d ]{19}) and (\d{16})", b)
    digits = card[1].replace(" ", "")
    assert digits == card[2] and digits[0] == "4"
    assert sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0
    assert re.search(r'token = "[0-9a-f]{40}"', b) and re.search(r"DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d", b)
    assert got[2]["text"] is None and got[2]["n_entities"] == 0 and got[3]["text"] == ""
    assert re.fullmatch(r"господин [а-я]+рус [а-я]+", got[4]["text"].lower()) and "Иван" not in got[4]["text"]
    assert got[5]["text"] == "plain text 12 of 2020-01-02" and got[6]["text"] == a
    other = {r["doc_id"]: r["text"] for r in pii_surrogates.replace_pii(docs, key="another").collect()}
    assert other[0] != a


def test_surrogates_stay_distinct(spark, monkeypatch):
    # Redraws collide again and again: what met an original keeps its first draw, which nobody else has.
    monkeypatch.setattr(pii_surrogates, "MAX_ATTEMPTS", 3)
    monkeypatch.setattr(pii_surrogates, "draw", lambda kind, canon, role, attempt, key: F.reverse(canon) if attempt == 0 else F.lit("x9"))
    parts = spark.createDataFrame([("secret", f"e{i}e" if i < 9 else f"e{i}", "") for i in range(30)], "kind string, canon string, role string")
    table = {r["canon"]: r["surrogate"] for r in pii_surrogates.surrogate_table(parts, "k").collect()}
    assert len(table) == 30 == len(set(table.values())) and sum(v == "x9" for v in table.values()) == 1 and table["e12"] == "21e"


def test_names_grow_until_they_are_distinct(spark, monkeypatch):
    monkeypatch.setitem(pii_surrogates.SCRIPTS, "latin", ("", ["ba", "be"]))
    parts = spark.createDataFrame([("name", f"n{chr(97 + i)}", "family") for i in range(26)] + [("name", "bababa", "family")], "kind string, canon string, role string")
    found = [r["surrogate"] for r in pii_surrogates.surrogate_table(parts, "k1").collect()]
    assert len(set(found)) == 27 and "bababa" not in found and all(re.fullmatch("(ba|be)+", x) for x in found)


def mod97(iban):
    digits = "".join(str(int(c, 36)) for c in iban[4:] + iban[:4])
    return int(digits) % 97


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10


def test_formats_are_permuted_one_to_one(spark):
    """Every kind over many entities: injective, valid stays valid, class by class, never the original."""
    r = random.Random(21)
    number = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    card = lambda: next(x for x in (f"4{number(15)}" for _ in range(200)) if luhn(x) == 0)
    iban = lambda: (lambda b: f"DE{98 - mod97('DE00' + b):02d}{b}")(number(18))
    rows = {("card", card()) for _ in range(80)} | {("card", number(16)) for _ in range(80)} | {("iban", iban()) for _ in range(80)} | {("iban", "GB" + number(2) + "ABCD" + number(14)) for _ in range(40)}
    rows |= {("ssn", f"{a:03d}{g:02d}{n:04d}") for a in (0, 1, 665, 666, 667, 899, 900) for g in (0, 1, 99) for n in (0, 1, 9999)}
    rows |= {("ip", f"{a}.{r.randrange(256)}.{r.randrange(256)}.{r.randrange(256)}") for a in (0, 1, 10, 223, 224, 255) for _ in range(20)}
    rows |= {("phone", number(10)) for _ in range(150)} | {("phone", "+49" + number(9)) for _ in range(60)} | {("phone", number(7)) for _ in range(40)}
    rows |= {("secret", "".join(r.choice("0123456789abcdef") for _ in range(32))) for _ in range(60)} | {("secret", "AKIA" + number(3) + "XYZ" + number(9)) for _ in range(30)} | {("secret", "")}
    rows |= {("email", f"{x}{i}@{d}.{t}") for i in range(9) for x in ("a", "bo.b", "c_d") for d in ("mail", "a.b-c") for t in ("org", "com")}
    table = spark.createDataFrame([(k, c, "") for k, c in rows], "kind string, canon string, role string").repartition(4)
    first = table.select("kind", "canon", pii_surrogates.draw(F.col("kind"), F.col("canon"), F.col("role"), 0, "key").alias("s")).collect()
    assert len({(x["kind"], x["s"]) for x in first}) == len(rows)  # a permutation without any table
    got = {(x["kind"], x["canon"]): x["surrogate"] for x in pii_surrogates.surrogate_table(table, "k1").collect()}
    assert set(got) == rows and len({(k[0], s) for k, s in got.items()}) == len(rows)
    crowded = 0
    for (kind, canon), s in got.items():
        crowded += (kind, s) in rows
        shape = lambda x: re.sub("[0-9]", "0", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", x)))
        if kind == "ip":
            assert 1 <= int(s.split(".")[0]) <= 223 if 1 <= int(canon.split(".")[0]) <= 223 else s.split(".")[0] == canon.split(".")[0]
            assert all(0 <= int(o) <= 255 for o in s.split("."))
        elif not re.fullmatch("[0-9a-f]{32}", canon):
            assert shape(s) == shape(canon), (canon, s)
        else:
            assert re.fullmatch("[0-9a-f]{32}", s)
        if kind == "card":
            assert luhn(s) == luhn(canon) if luhn(canon) == 0 else luhn(s) != 0
            assert s[0] == canon[0]
        if kind == "iban":
            assert s[:2] == canon[:2] and (mod97(s) == 1) == (mod97(canon) == 1)
        if kind == "ssn":
            valid = lambda x: x[:3] not in ("000", "666") and x[:3] < "900" and x[3:5] != "00" and x[5:] != "0000"
            assert valid(s) == valid(canon)
        if kind == "phone" and len(canon) == 10:
            assert (s[0] > "1", s[3] > "1") == (canon[0] > "1", canon[3] > "1")
        if canon.startswith(("+49", "AKIA")):
            assert s[:3] == canon[:3]
        if kind == "email":
            assert s.rsplit(".", 1)[1] == canon.rsplit(".", 1)[1]
    assert crowded <= 1  # only the empty secret has no other value
    domains = {}
    for (kind, canon), s in got.items():
        if kind == "email":
            assert domains.setdefault(canon.split("@")[1], s.split("@")[1]) == s.split("@")[1]


def test_coreference(spark):
    texts = [
        "Mr. John Smith came. Dr. John Smith left, and John Smith slept. Later Smith and JOHN woke; Smithers and Johnny did not.",
        "Dr. John Smith wrote.", "Mrs. Alex Stone and Dr. Alex Stone.", "Mr. Alex Stone.", "Dr. Pat Reed met Pat.", "Smith without a title stays.",
        "Call +1 (564) 555-4526, (564) 555-4526, 1 564 555 4526 no, or +49 30 1234567.", "السيد محمد علي", "王小明先生说王小明好。", "SSN 123-45-6789 and 10.1.2.3.",
    ]
    got = {r["doc_id"]: r["text"] for r in pii_surrogates.replace_pii(docs_of(spark, texts), "k1").collect()}
    m = re.fullmatch(r"Mr\. (\w+) (\w+) came\. Dr\. (\w+) (\w+) left, and (\w+) (\w+) slept\. Later (\w+) and JOHN woke; Smithers and Johnny did not\.", got[0])
    assert m and m[1] == m[3] == m[5] and m[2] == m[4] == m[6] == m[7] and m[1].endswith("rus") and "John Smith" not in got[0]
    assert got[1] == f"Dr. {m[1]} {m[2]} wrote."  # the corpus knows the gender
    a = re.fullmatch(r"Mrs\. (\w+ria) (\w+) and Dr\. (\w+) (\w+)\.", got[2])
    assert a and a[1] == a[3] and a[2] == a[4]
    assert re.fullmatch(rf"Mr\. \w+rus {a[2]}\.", got[3])
    p = re.fullmatch(r"Dr\. (\w+ren) (\w+) met (\w+)\.", got[4])
    assert p and p[1] == p[3] and got[5] == texts[5]
    n = re.fullmatch(r"Call \+1 \((\d{3})\) (\d{3}-\d{4}), \((\d{3})\) (\d{3}-\d{4}), 1 (\d{3}) (\d{3}) (\d{4}) no, or \+49 \d\d \d{7}\.", got[6])
    assert n and (n[1], n[2]) == (n[3], n[4]) and n[1] != "564"
    assert re.fullmatch(r"السيد [\u0621-\u064A]+ [\u0621-\u064A]+", got[7]) and "محمد" not in got[7]
    h = re.fullmatch(r"(.+)先生说(.+)好。", got[8])
    assert h and h[1] == h[2] and len(h[1]) == 3 and h[1].endswith("伟") and h[1] != "王小明"


def test_surrogates_of_odd_tables(spark):
    assert pii_surrogates.replace_pii(docs_of(spark, []), "k1").count() == 0
    long = "word " * 200_000 + "bob@mail.org " + "x" * 300_000
    same = spark.createDataFrame([(1, "a@b.com"), (1, "a@b.com"), (1, "c@b.com"), (None, "a@b.com"), (None, None), (2, long)], "doc_id long, text string")
    got = pii_surrogates.replace_pii(same, "k1").collect()
    assert len(got) == 6 and len({r["text"] for r in got}) == 4
    big = next(r["text"] for r in got if r["doc_id"] == 2)
    assert len(big) == len(long) and "bob@mail.org" not in big
    one = [r["text"] for r in got if r["n_entities"] and len(r["text"]) < 9]
    assert len(one) == 4 and len(set(one)) == 2 and not {"a@b.com", "c@b.com"} & set(one)


def test_no_original_stays_on_disk(spark):
    folder = Path(shared_dir(spark).removeprefix("file:"))
    before = set(folder.iterdir()) if folder.exists() else set()
    out = pii_surrogates.replace_pii(docs_of(spark, ["Mr. John Smith, bob@mail.org", "x"]), "k1").collect()
    new = set(folder.iterdir()) - before
    kept = [str(r) for d in new if d.name.startswith("replacements") for r in spark.read.parquet(str(d)).collect()]
    assert len(out) == 2 and kept and not any(x in y for x in ("John", "Smith", "bob@mail") for y in kept)
    assert {d.name.rsplit("-", 1)[0] for d in new} == {"replacements"}


def templates(texts, min_docs, depth=3, min_tokens=5, min_constant=0.7):
    """(doc, line) that go, by the definition."""
    lines = []
    for d, t in enumerate(texts):
        for k, raw in enumerate((t or "").split("\n")):
            tokens = ["<*>" if re.search("[0-9]", w) else w for w in words(raw)]
            if len(tokens) >= min_tokens:
                lines.append((d, k, tokens))
    leaf = lambda tokens: (len(tokens), *tokens[:depth])
    n, docs = Counter(leaf(x[2]) for x in lines), defaultdict(set)
    for d, _, tokens in lines:
        docs[leaf(tokens)].add(texts[d] and (d, texts[d]))
    votes = Counter((leaf(tokens), i, w) for _, _, tokens in lines for i, w in enumerate(tokens))
    found = defaultdict(list)
    for d, k, tokens in lines:
        key = leaf(tokens)
        if n[key] < min_docs or len(docs[key]) < 2:
            continue
        constant = [votes[key, i, w] >= min_docs for i, w in enumerate(tokens)]
        if sum(constant) >= min_constant * len(tokens):
            found["t", key, tuple(w if c else None for w, c in zip(tokens, constant))].append((d, k))
        else:
            found["own", key, tuple(tokens)].append((d, k))
    return {x for xs in found.values() if len({d for d, _ in xs}) >= min_docs for x in xs if x != min(xs)}


def test_line_templates_equal_brute_force(spark):
    r = random.Random(7)
    heads = ["user logged in from", "error in the module", "thanks for reading this"]
    texts = [None, "", "\n\n"]
    for _ in range(60):
        body = []
        for _ in range(r.randrange(1, 7)):
            if r.random() < 0.6:
                body.append(f"{r.choice(heads)} {r.choice(['alpha', 'beta', 'gamma', str(r.randrange(999))])} at site {r.choice(['x', 'y'])} today".replace(" ", r.choice([" ", "  ", "\t"])))
            else:
                body.append(" ".join(f"w{r.choice('abcdefgh')}" for _ in range(r.randrange(0, 9))))
        texts.append("\n".join(body))
    for min_docs in (2, 4, 8):
        gone = templates(texts, min_docs)
        assert gone
        got = {x["doc_id"]: x for x in line_templates.drop_repeated_lines(docs_of(spark, texts).withColumn("n_lines", F.lit("clash")), min_docs=min_docs).collect()}
        for d, t in enumerate(texts):
            want = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in gone)
            assert got[d]["text"] == want, (min_docs, d)
            assert got[d]["n_dropped"] == len([x for x in gone if x[0] == d])


def test_line_dedup_stage(spark):
    shared = " ".join(f"word{c}" for c in "abcdefghij")
    texts = [f"{shared}\n{'abcd'[i]}own {'abcd'[i]}text stands here alone {'x' * (400 if i else 0)}" for i in range(4)] + [shared] * 9
    out = line_templates.without_repeated_lines(docs_of(spark, texts), min_docs=3)
    kept = {r["doc_id"]: r for r in out.collect()}
    assert shared in kept[0]["text"] and all(shared not in kept[i]["text"] for i in (1, 2, 3))
    assert set(kept) == {0, 1, 2, 3} and all(r["n_chars"] == len(r["text"]) for r in kept.values() if r["doc_id"])
    assert line_templates.without_repeated_lines(docs_of(spark, [])).count() == 0


def test_line_dedup_keeps_what_is_left(spark):
    shared = " ".join(f"word{c}" for c in "abcdefghij") * 20
    texts = [shared] + [f"{shared}\nown words {'xyz'[i]}" for i in range(3)] + [f"{shared}\n \n\t", shared]
    kept = {r["doc_id"]: r["text"] for r in line_templates.without_repeated_lines(docs_of(spark, texts), min_docs=3).collect()}
    assert kept == {0: shared, 1: "own words x", 2: "own words y", 3: "own words z"}


def test_short_and_long_lines(spark):
    long = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    texts = [f"All rights reserved.\nPage {i}\n\n{'abcdefghi'[i]}own line" for i in range(9)] + [f"{long} 7\nx", f"y\n{long} 8", f"{long[:-1]} 9"]
    out = line_templates.drop_repeated_lines(docs_of(spark, texts), **line_templates.WHOLE_LINES)
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[0]["text"] == texts[0] and all(got[i]["text"] == f"Page {i}\n\n{'abcdefghi'[i]}own line" for i in range(1, 9))
    assert got[9]["text"] == texts[9] and got[10]["text"] == "y" and got[11]["text"] == texts[11] and got[10]["n_templates"] == 1
    # A long line that goes as a template as well counts once.
    many = line_templates.drop_repeated_lines(docs_of(spark, [f"{long} {i}\nown" for i in range(9)]), short_docs=None, long_docs=2).collect()
    assert sorted((r["n_dropped"], r["n_templates"]) for r in many) == [(0, 0)] + [(1, 1)] * 8


def fill(sizes):
    """Targets by resharing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, capped = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(capped.values())
        level = left / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if level * weight[s] > 2 * sizes[s]]
        if not over:
            return {s: capped.get(s, level * weight[s]) for s in order}
        capped |= {s: 2.0 * sizes[s] for s in over}


def test_mixing(spark):
    r = random.Random(11)
    names = ["b", "a", None, "é", "zz", "empty"]
    source = [r.choice(names[:5]) if i > 200 else "a" for i in range(500)] + ["empty"] * 3
    texts = [" ".join("w" for _ in range(r.randrange(0, 30))) for _ in range(500)] + [None, "", " "]
    docs = docs_of(spark, texts, source).withColumn("size", F.lit("clash"))
    got = mixing.mix(docs, n_shards=8).select("doc.doc_id", "doc.source", "size", "source_size", "target", "taken", "draws").collect()
    assert len(got) == 503
    sizes, taken = Counter(), Counter()
    for x in got:
        assert x["size"] == len(words(texts[x["doc_id"]])) and 0 <= x["taken"] <= 2 * x["size"] and sum(d["words"] for d in x["draws"]) == x["taken"]
        sizes[x["source"]] += x["size"]
        taken[x["source"]] += x["taken"]
    want = fill(sizes)
    for x in got:
        assert x["source_size"] == sizes[x["source"]] and abs(x["target"] - want[x["source"]]) < 1e-6
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    again = mixing.mix(docs.repartition(7), n_shards=8).select("doc.doc_id", "taken", "draws").collect()
    assert {(x["doc_id"], x["taken"], str(x["draws"])) for x in again} == {(x["doc_id"], x["taken"], str(x["draws"])) for x in got}
    mixed = mixing.mixed_documents(docs, n_shards=8)
    assert mixed.columns == docs.columns and mixed.rdd.getNumPartitions() == 8
    rows = mixed.collect()
    assert sum(len(words(x["text"])) for x in rows) == sum(taken.values())
    assert all(texts[x["doc_id"]].startswith(x["text"]) and x["n_chars"] == len(x["text"]) for x in rows)
    assert mixing.mixed_documents(docs_of(spark, [])).count() == 0


def test_mixing_of_repeated_rows(spark, monkeypatch):
    """Equal rows, null ids and very long texts: blocks and cuts still add up."""
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 40)
    same = [(None, "a b c", "x")] * 30 + [(7, "a\n b  c d", "x")] * 30 + [(8, "w " * 50_000, "y"), (9, None, None)]
    docs = spark.createDataFrame(same, "doc_id long, text string, source string")
    got = mixing.mix(docs, n_shards=4).select("doc.doc_id", "doc.source", "size", "target", "taken", "draws").collect()
    assert len(got) == len(same) and all(sum(d["words"] for d in x["draws"]) == x["taken"] <= 2 * x["size"] for x in got)
    for s in ("x", "y"):
        rows = [x for x in got if x["source"] == s]
        assert rows[0]["target"] - 31 <= sum(x["taken"] for x in rows) <= rows[0]["target"]
    assert {d["shard"] for x in got for d in x["draws"]} == {0, 1, 2, 3}


def test_water_level_of_many_sources(spark):
    r = random.Random(13)
    sizes = {f"s{i:04d}": r.choice([0, 1, 5, 70, 3000]) for i in range(300)}
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long").repartition(5)
    got = {x["source"]: x for x in mixing.source_targets(rows).collect()}
    want = fill(sizes)
    assert all(abs(got[s]["target"] - want[s]) < 1e-6 for s in sizes) and [got[s]["rank"] for s in sorted(sizes)] == list(range(300))


def test_splitting_tree_is_exact(spark):
    quotas = spark.createDataFrame([(0, [100, 0, 37, 4000, 1])], "group long, quotas array<long>")
    leaves = mixing.splitting_tree(quotas, 16, 3).orderBy("shard").collect()
    assert [sum(x) for x in zip(*[r["quotas"] for r in leaves])] == [100, 0, 37, 4000, 1]
    assert {sum(r["quotas"]) for r in leaves} <= {258, 259}
    groups = spark.createDataFrame([(0, [100, 0, 37]), (1, [4000, 1]), (2, [5])], "group long, quotas array<long>")
    leaves = mixing.splitting_tree(groups, 64, 3).collect()
    by_group = {g: [sum(x) for x in zip(*[r["quotas"] for r in leaves if r["group"] == g])] for g in range(3)}
    assert by_group == {0: [100, 0, 37], 1: [4000, 1], 2: [5]}
    per_shard = Counter()
    for r in leaves:
        per_shard[r["shard"]] += sum(r["quotas"])
    assert len(per_shard) == 64 and set(per_shard.values()) <= {64, 65}


def test_hypergeometric_follows_its_distribution(spark):
    from math import comb

    total, good, sample = 30, 12, 10
    us = [(i + 0.5) / 2000 for i in range(2000)]
    c = [F.lit(float(x)) for x in (total, good, sample)]
    drawn = Counter(r[0] for r in spark.createDataFrame([(u,) for u in us], "u double").select(mixing.hypergeometric(*c, F.col("u"))).collect())
    for k in range(11):
        p = comb(good, k) * comb(total - good, sample - k) / comb(total, sample)
        assert abs(drawn[k] / 2000 - p) < 0.002
