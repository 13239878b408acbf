"""PII surrogates: detected entities receive keyed, type-consistent replacements.

Entities are e-mail and IP addresses, phone, card and social security numbers, IBANs, secrets, and names after or
before a title, with all later and earlier mentions of such a name's words in the same document.

Everything but names is permuted inside the space of its own format by a keyed Feistel network: letters stay
letters, digits digits, punctuation and letter case stay in place; a country code, the first digit of a card, a top-level domain and the prefix of a
secret stay; check digits follow (cards, IBANs), valid numbers stay valid (social security, North American phones,
addresses). As a permutation gives different entities different surrogates, distinctness needs no table of what was given away.
A name's words become names of syllables of their script; a given name has the ending of its gender, which is that of its
title, else of another mention in the document, else the more frequent one in the corpus. Equal canonical forms get equal
surrogates everywhere (coreference): case, punctuation and a phone's country code ``1`` don't count.

Collision checks: over all different entities of the corpus no two share a surrogate, and none equals an
entity that occurs. What collides draws again under another key; names grow by a syllable with every second attempt, so there is
always room. Other formats may be so full that ``MAX_ATTEMPTS`` draws collide with entities of the corpus; these
keep the first draw, which is distinct from all others by construction (redraws never take a first draw's value).

The key is the caller's secret and has no default: surrogates are permutations, so whoever has it and this code can compute the originals back.

All of it is DataFrame expressions. The entities found are written to the shared folder while they are matched and deleted before the
result is returned; what stays until the session's end are replacements by row hash. Defined results for odd input: a null text stays null with 0
entities; repeated rows give repeated results; entities are replaced from left to right where patterns overlap; other columns are carried
along; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srclens.llm.common import Scratch, written

MAX_ATTEMPTS = 12
ROUNDS = 6

MALE_TITLES = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "господин", "κύριος")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "госпожа", "κυρία")
NEUTRAL_TITLES = ("Dr", "Prof")
#: Titles before names in scripts without letter case.
MALE_CASELESS, FEMALE_CASELESS, NEUTRAL_CASELESS = ("السيد", "מר", "श्री"), ("السيدة", "גברת", "श्रीमती"), ("الدكتور", "डॉ")
#: Titles after names.
MALE_SUFFIXES, FEMALE_SUFFIXES, NEUTRAL_SUFFIXES = ("先生",), ("女士", "小姐", "太太"), ("博士", "教授", "さん", "様", "씨")

_CASED = "|".join(MALE_TITLES + FEMALE_TITLES + NEUTRAL_TITLES)
_CASELESS = "|".join(MALE_CASELESS + FEMALE_CASELESS + NEUTRAL_CASELESS)
_SUFFIX = "|".join(MALE_SUFFIXES + FEMALE_SUFFIXES + NEUTRAL_SUFFIXES)
_NO_WORD_BEFORE, _NO_WORD_AFTER = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
_UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}가-힣]"

#: Each pattern starts where a run of its characters starts and runs without backtracking, so the scan is linear.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![0-9.])(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9+-])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])",
    "phone": r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-]?[0-9]{4}(?![0-9])|(?<![0-9A-Za-z])\+[0-9](?:[ .-]?[0-9]){8,14}(?![0-9])",
    "secret": r"(?<![A-Za-z0-9])(?:(?<=[=:] ?[\"'])[A-Za-z0-9_+/=-]{16,}(?=[\"'])|(?:AKIA|ghp_|sk-|xox[abp]-)[A-Za-z0-9_-]{12,}|[0-9a-f]{32,}+)(?![A-Za-z0-9])",
    "name": _NO_WORD_BEFORE + rf"(?:(?:{_CASED})\.? \p{{Lu}}\p{{L}}++(?:[ -]\p{{Lu}}\p{{L}}++){{0,2}}|(?:{_CASELESS})\.? [\p{{Lo}}\p{{M}}]{{2,}}+(?: [\p{{Lo}}\p{{M}}]{{2,}}+)?"
    rf"|{_UNSPACED}{{2,4}}? ?(?:{_SUFFIX}))",
}
ENTITY = "|".join(f"(?:{p})" for p in PATTERNS.values())
_PREFIX_AT = rf"^((?:{_CASED}|{_CASELESS})\.? )"
_SUFFIX_AT = rf"({_UNSPACED}{{2,4}}?)( ?(?:{_SUFFIX}))$"

#: Country codes of phone numbers: one digit, the two-digit ones, else three.
COUNTRY_CODE = r"^\+(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
SECRET_PREFIX = "^(AKIA|ghp_|sk-|xox[abp]-)"

#: Parts of synthetic names by script: consonants and vowels that make syllables, or signs that stand alone.
SCRIPTS: dict[str, tuple[str, list[str]]] = {
    "cyrillic": (r"\p{IsCyrillic}", [c + v for c in "бвгдзклмнпрстфх" for v in "аеиоу"]),
    "greek": (r"\p{IsGreek}", [c + v for c in "βγδζθκλμνπρστφχ" for v in "αειοω"]),
    "arabic": (r"\p{IsArabic}", list("بتجحدرزسشصطعفقكلمنهوي")),
    "hebrew": (r"\p{IsHebrew}", list("בגדהזחטילמנסעפצקרשת")),
    "devanagari": (r"\p{IsDevanagari}", [c + v for c in "कगचजतदनपबमयरलवसह" for v in ("", "ा", "ि", "ु", "े", "ो")]),
    "hangul": (r"\p{IsHangul}", [chr(0xAC00 + 28 * k) for k in range(0, 399, 3)]),
    "hiragana": (r"\p{IsHiragana}", list("あいうえおかきくけこさしすせそたちつてとなにぬねのはひふへほまみむめもやゆよらりるれろわ")),
    "katakana": (r"\p{IsKatakana}", list("アイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワ")),
    "han": (r"\p{IsHan}", [chr(0x4E00 + 131 * k) for k in range(150)]),
    "latin": ("", [c + v for c in "bdfgklmnprstvwz" for v in "aeiou"]),
}
#: Endings of a given name by gender.
ENDINGS = {
    "latin": {"male": "rus", "female": "ria", "neutral": "ren"}, "cyrillic": {"male": "рус", "female": "рия", "neutral": "рен"},
    "greek": {"male": "ρος", "female": "ρια", "neutral": "ρεν"}, "arabic": {"male": "ان", "female": "ة", "neutral": "ي"},
    "hebrew": {"male": "ן", "female": "ה", "neutral": "י"}, "devanagari": {"male": "श", "female": "ती", "neutral": "न"},
    "hangul": {"male": "준", "female": "희", "neutral": "현"}, "hiragana": {"male": "お", "female": "こ", "neutral": "み"},
    "katakana": {"male": "オ", "female": "コ", "neutral": "ミ"}, "han": {"male": "伟", "female": "芳", "neutral": "文"},
}
#: Syllables of a name's word at the first attempt; the other scripts keep the word's length.
N_SYLLABLES = {"latin": 3, "cyrillic": 3, "greek": 3, "arabic": 4, "hebrew": 4, "devanagari": 3}


# What an entity is ---------------------------------------------------------------------------------------------------------------


def kind_of(entity: Column, names: Column) -> Column:
    """The first pattern that matches the whole entity; ``names`` are the words of the document's titled names."""
    out = F.lit("name")
    for kind in reversed([k for k in PATTERNS if k not in ("name", "secret")]):
        out = F.when(entity.rlike(f"^(?:{PATTERNS[kind]})$"), F.lit(kind)).otherwise(out)
    titled = entity.rlike(f"^(?:{PATTERNS['name']})$")
    # A secret is found by what stands around it, which the entity alone doesn't have.
    return F.when(titled | F.array_contains(names, entity), F.lit("name")).when(
        ~F.contains(entity, F.lit(" ")) & ~out.isin("email", "ip", "ssn", "card", "phone", "iban"), F.lit("secret")
    ).otherwise(out)


def bare_name(entity: Column) -> Column:
    """A name without its title."""
    return F.regexp_replace(F.regexp_replace(entity, _PREFIX_AT, ""), _SUFFIX_AT, "$1")


def gender_of(entity: Column) -> Column:
    """What the title of a name says."""
    title = F.regexp_replace(F.trim(F.concat(F.regexp_extract(entity, _PREFIX_AT, 1), F.regexp_extract(entity, _SUFFIX_AT, 2))), r"\.$", "")
    male, female = MALE_TITLES + MALE_CASELESS + MALE_SUFFIXES, FEMALE_TITLES + FEMALE_CASELESS + FEMALE_SUFFIXES
    return F.when(title.isin(*male), "male").when(title.isin(*female), "female")


def has_given(entity: Column) -> Column:
    """The first of several words is a given name; a name with a title after it is one as a whole."""
    return F.contains(bare_name(entity), F.lit(" ")) | entity.rlike(_SUFFIX_AT)


def titled_names(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)), lambda e: e.rlike(f"^(?:{PATTERNS['name']})$"))


def name_words(titled: Column) -> Column:
    """The words of two letters or more of titled names."""
    words = F.flatten(F.transform(titled, lambda e: F.split(bare_name(e), "[ -]")))
    return F.filter(F.array_distinct(words), lambda w: F.length(w) >= 2)


def pattern_with(words: Column) -> Column:
    """The pattern of entities in a document with these name words. Words are letters, so nothing is to be quoted."""
    unspaced = F.filter(words, lambda w: w.rlike(_UNSPACED))
    spaced = F.filter(words, lambda w: ~w.rlike(_UNSPACED))
    return F.concat(
        F.lit(ENTITY),
        F.when(F.size(spaced) > 0, F.concat(F.lit(f"|{_NO_WORD_BEFORE}(?:"), F.array_join(spaced, "|"), F.lit(f"){_NO_WORD_AFTER}"))).otherwise(""),
        F.when(F.size(unspaced) > 0, F.concat(F.lit("|"), F.array_join(unspaced, "|"))).otherwise(""),
    )


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def canonical(kind: Column, part: Column) -> Column:
    digits = _digits(part)
    plus = F.concat(F.lit("+"), digits)
    # Ten digits, with or without +1 or 1 before, are a North American number; others keep their country code.
    american = F.when(part.startswith("+"), plus.rlike(r"^\+1[0-9]{10}$")).otherwise(digits.rlike("^1?[0-9]{10}$"))
    phone = F.when(american, F.substring(digits, -10, 10)).when(part.startswith("+"), plus).otherwise(digits)
    octets = F.array_join(F.transform(F.split(part, r"\."), lambda x: x.cast("int").cast("string")), ".")
    return (
        F.when(kind.isin("card", "ssn"), digits)
        .when(kind == "phone", phone)
        .when(kind.isin("email", "name"), F.lower(part))
        .when(kind == "iban", F.regexp_replace(part, " ", ""))
        .when(kind == "ip", octets)
        .otherwise(part)
    )


# Keyed permutations ---------------------------------------------------------------------------------------------------------------


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


_DIGIT, _HEX = "0123456789", "0123456789abcdef"
_CLASSES = (("a", "z", "abcdefghijklmnopqrstuvwxyz"), ("A", "Z", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("0", "9", _DIGIT))


def _moved(c: Column, alphabet: str, by: Column) -> Column:
    at = F.instr(F.lit(alphabet), c) - 1
    return F.substring(F.lit(alphabet), (F.pmod(at + by, F.lit(len(alphabet))) + 1).cast("int"), F.lit(1))


def by_class(c: Column, by: Column) -> Column:
    """A letter or digit moved inside its alphabet; all else stays."""
    out = c
    for low, high, alphabet in reversed(_CLASSES):
        out = F.when(c.between(low, high), _moved(c, alphabet, by)).otherwise(out)
    return out


def as_hex(c: Column, by: Column) -> Column:
    return _moved(c, _HEX, by)


def _noise(seed: Column, i: Column) -> Column:
    return F.pmod(F.xxhash64(seed, i), F.lit(1 << 32))


def permuted(text: Column, secret: Column, move: Callable[[Column, Column], Column] = by_class) -> Column:
    """A keyed permutation of the texts of one format: Feistel rounds that move every character inside its alphabet."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    half = lambda x: F.floor(F.size(x) / 2).cast("int")
    step = lambda a, r: F.struct(
        a["b"].alias("a"),
        _bound(
            F.sha2(F.concat_ws("|", secret, r.cast("string"), F.array_join(a["b"], "")), 256),
            lambda seed: F.transform(a["a"], lambda c, i: move(c, _noise(seed, i))),
        ).alias("b"),
    )
    rounds = F.sequence(F.lit(1), F.lit(ROUNDS))
    out = _bound(
        chars,
        lambda x: F.aggregate(
            rounds,
            F.struct(F.slice(x, F.lit(1), half(x)).alias("a"), F.slice(x, half(x) + 1, F.size(x)).alias("b")),
            step,
            lambda a: F.array_join(F.concat(a["a"], a["b"]), ""),
        ),
    )
    return F.coalesce(out, text)


def permuted_pair(a: Column, b: Column, n_a: Column, n_b: Column, secret: Column) -> Column:
    """A keyed permutation of the pairs of numbers below ``n_a`` and ``n_b``: a struct ``a, b``."""
    long = lambda x: x.cast("long")
    noise = lambda r, x: F.pmod(F.conv(F.substring(F.sha2(F.concat_ws("|", secret, r.cast("string"), x.cast("string")), 256), 1, 12), 16, 10).cast("long"), F.lit(1 << 46))
    step = lambda s, r: F.struct(
        F.when(r % 2 == 0, F.pmod(s["a"] + noise(r, s["b"]), long(n_a))).otherwise(s["a"]).alias("a"),
        F.when(r % 2 == 1, F.pmod(s["b"] + noise(r, s["a"]), long(n_b))).otherwise(s["b"]).alias("b"),
    )
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(long(a).alias("a"), long(b).alias("b")), step)


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of digits; a valid number's is a multiple of 10."""
    return F.aggregate(
        F.transform(
            F.reverse(F.filter(F.split(digits, ""), lambda c: c != "")),
            lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
                F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)
            ),
        ),
        F.lit(0),
        lambda a, x: a + x,
    )


def iban_check(country: Column, account: Column) -> Column:
    """The number of the two check digits of a valid IBAN."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    rest = F.aggregate(
        F.filter(F.split(F.concat(account, country, F.lit("00")), ""), lambda c: c != ""),
        F.lit(0),
        lambda a, c: F.when(c.between("0", "9"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.instr(F.lit(letters), c) + 9) % 97),
    )
    return 98 - rest


def _card(canon: Column, secret: Column) -> Column:
    """The first digit stays, the last keeps its distance from the check digit, which is 0 for a valid number."""
    n = F.length(canon)
    check = lambda front: F.pmod(10 - luhn_sum(F.concat(front, F.lit("0"))), F.lit(10))
    old = F.substring(canon, F.lit(1), n - 1)
    off = F.substring(canon, -1, 1).cast("int") - check(old)
    new = F.concat(F.substring(canon, 1, 1), permuted(F.substring(canon, F.lit(2), n - 2), secret))
    return _bound(new, lambda x: F.concat(x, F.pmod(check(x) + off, F.lit(10)).cast("string")))


def _iban(canon: Column, secret: Column) -> Column:
    """A valid number stays valid; other check digits stay too, but never become valid."""
    country, digits, account = F.substring(canon, 1, 2), F.substring(canon, 3, 2).cast("int"), F.substring(canon, 5, 60)
    old = iban_check(country, account)

    def whole(new: Column) -> Column:
        valid = iban_check(country, new)
        check = F.when(digits == old, valid).when(digits == valid, old).otherwise(digits)
        return F.concat(country, F.lpad(check.cast("string"), 2, "0"), new)

    return _bound(permuted(account, F.concat_ws("|", secret, country)), whole)


def _ssn(canon: Column, secret: Column) -> Column:
    """Valid numbers (area 001 to 899 but 666, group and serial not 0) stay valid; others keep what makes them invalid."""
    area, group, serial = F.substring(canon, 1, 3).cast("int"), F.substring(canon, 4, 2).cast("int"), F.substring(canon, 6, 4).cast("int")
    index = F.when(area > 666, area - 2).otherwise(area - 1)
    n_b = F.when(group == 0, 10_000).when(serial == 0, 99).otherwise(99 * 9999)
    b = F.when(group == 0, serial).when(serial == 0, group - 1).otherwise((group - 1) * 9999 + serial - 1)
    pair = permuted_pair(index, b, F.lit(898), n_b, secret)

    def written_out(x: Column) -> Column:
        new_area = F.when(x["a"] >= 665, x["a"] + 2).otherwise(x["a"] + 1)
        new_group = F.when(group == 0, 0).when(serial == 0, x["b"] + 1).otherwise(F.floor(x["b"] / 9999) + 1)
        new_serial = F.when(group == 0, x["b"]).when(serial == 0, 0).otherwise(x["b"] % 9999 + 1)
        padded = lambda v, n: F.lpad(v.cast("string"), n, "0")
        return F.concat(padded(new_area, 3), padded(new_group, 2), padded(new_serial, 4))

    bad_area = (area == 0) | (area == 666) | (area >= 900)
    kept = F.concat(F.substring(canon, 1, 3), permuted(F.substring(canon, 4, 6), F.concat_ws("|", secret, F.substring(canon, 1, 3))))
    return F.when(bad_area, kept).otherwise(_bound(pair, written_out))


def _ip(canon: Column, secret: Column) -> Column:
    """Unicast addresses stay unicast; other first octets stay."""
    octet = lambda i: F.get(F.split(canon, r"\."), F.lit(i)).cast("int")
    unicast = octet(0).between(1, 223)
    a = F.when(unicast, (octet(0) - 1) * 256 + octet(1)).otherwise(octet(1))
    pair = permuted_pair(
        a, octet(2) * 256 + octet(3), F.when(unicast, 223 * 256).otherwise(256), F.lit(65536),
        F.when(unicast, secret).otherwise(F.concat_ws("|", secret, octet(0).cast("string"))),
    )
    first = lambda x: F.when(unicast, F.floor(x["a"] / 256) + 1).otherwise(octet(0))
    text = lambda v: v.cast("long").cast("string")
    return _bound(pair, lambda x: F.concat_ws(".", text(first(x)), text(x["a"] % 256), text(F.floor(x["b"] / 256)), text(x["b"] % 256)))


def _email(canon: Column, secret: Column) -> Column:
    """Equal domains get equal domains; the top-level domain stays."""
    local, domain = F.regexp_extract(canon, "^([^@]+)@", 1), F.regexp_extract(canon, r"@(.*)\.[^.]+$", 1)
    return F.concat(
        permuted(local, F.concat_ws("|", secret, F.lit("local"), F.regexp_extract(canon, "@(.*)$", 1))), F.lit("@"),
        permuted(domain, F.concat_ws("|", secret, F.lit("domain"), F.regexp_extract(canon, r"(\.[^.]+)$", 1))), F.regexp_extract(canon, r"(\.[^.]+)$", 1),
    )


def _secret(canon: Column, secret: Column) -> Column:
    """The issuer's prefix stays; hexadecimal stays so, and nothing else becomes so (a permutation walked on until it doesn't)."""
    hexadecimal = lambda x: x.rlike("^[0-9a-f]+$")
    prefix = F.regexp_extract(canon, SECRET_PREFIX, 1)
    rest = F.regexp_replace(canon, SECRET_PREFIX, "")
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(4)), permuted(rest, secret), lambda a, _: F.when((prefix == "") & hexadecimal(a), permuted(a, secret)).otherwise(a)
    )
    return F.when(hexadecimal(canon), permuted(canon, secret, as_hex)).otherwise(F.concat(prefix, walked))


def _phone(canon: Column, secret: Column) -> Column:
    """The country code stays; area and exchange codes of a North American number keep their kind of first digit."""
    code = F.regexp_extract(canon, COUNTRY_CODE, 0)
    american = F.length(canon) == 10

    def move(c: Column, by: Column) -> Column:  # the first digit of either code is written as a letter of two or eight
        return F.when(c.between("a", "b"), _moved(c, "ab", by)).when(c.between("c", "j"), _moved(c, "cdefghij", by)).otherwise(by_class(c, by))

    lettered = lambda at: F.translate(F.substring(canon, at, 1), _DIGIT, "abcdefghij")
    back = lambda x, at: F.translate(F.substring(x, at, 1), "abcdefghij", _DIGIT)
    masked = F.concat(lettered(1), F.substring(canon, 2, 2), lettered(4), F.substring(canon, 5, 6))
    new = _bound(permuted(masked, secret, move), lambda x: F.concat(back(x, 1), F.substring(x, 2, 2), back(x, 4), F.substring(x, 5, 6)))
    other = F.concat(code, permuted(F.regexp_replace(canon, COUNTRY_CODE, ""), F.concat_ws("|", secret, code)))
    return F.when(american & ~canon.startswith("+"), new).otherwise(other)


def _name(canon: Column, role: Column, attempt: int, secret: Column) -> Column:
    """A word of syllables of its script; ``role`` is the gender of a given name, or family."""

    def in_script(script: str) -> Column:
        units = F.array(*[F.lit(x) for x in SCRIPTS[script][1]])
        base = F.lit(N_SYLLABLES[script]) if script in N_SYLLABLES else F.greatest(F.length(canon) - (role != "family").cast("int"), F.lit(1))
        count = F.least(base + attempt // 2, F.lit(31))
        pick = lambda digest, i: F.get(units, F.pmod(F.conv(F.substring(digest, i * 4 + 1, F.lit(4)), 16, 10).cast("int"), F.lit(len(SCRIPTS[script][1]))))
        stem = _bound(F.sha2(secret, 512), lambda digest: F.array_join(F.transform(F.sequence(F.lit(0), count - 1), lambda i: pick(digest, i)), ""))
        ending = F.lit("")
        for gender, e in ENDINGS[script].items():
            ending = F.when(role == gender, F.lit(e)).otherwise(ending)
        return F.concat(stem, ending)

    out = in_script("latin")
    for script in reversed([s for s in SCRIPTS if s != "latin"]):
        out = F.when(canon.rlike(SCRIPTS[script][0]), in_script(script)).otherwise(out)
    return out


def draw(kind: Column, canon: Column, role: Column, attempt: int, key: str) -> Column:
    """The surrogate of a canonical form at an attempt."""
    secret = F.concat_ws("|", F.lit(key), kind, F.lit(str(attempt)))
    return (
        F.when(kind == "name", _name(canon, role, attempt, F.concat_ws("|", secret, canon, role)))
        .when(kind == "card", _card(canon, secret))
        .when(kind == "phone", _phone(canon, secret))
        .when(kind == "ip", _ip(canon, secret))
        .when(kind == "email", _email(canon, secret))
        .when(kind == "iban", _iban(canon, secret))
        .when(kind == "ssn", _ssn(canon, secret))
        .otherwise(_secret(canon, secret))
    )


def poured(kind: Column, part: Column, surrogate: Column) -> Column:
    """The surrogate in the written form of ``part``: separators for numbers, letter case for words."""
    chars = F.filter(F.split(part, ""), lambda c: c != "")
    digits = _digits(surrogate)
    # What the canonical form of a phone number lacks, the code 1, stands before it.
    phone = F.concat(F.substring(_digits(part), F.lit(1), F.greatest(F.length(_digits(part)) - F.length(digits), F.lit(0))), digits)

    def numbered(signs: Column) -> Column:
        return F.aggregate(
            chars,
            F.struct(F.lit("").alias("out"), F.lit(0).alias("n")),
            lambda a, c: F.when(
                c.rlike("[0-9A-Z]"),
                F.struct(F.concat(a["out"], F.substring(signs, a["n"] + 1, F.lit(1))).alias("out"), (a["n"] + 1).alias("n")),
            ).otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["n"].alias("n"))),
        )["out"]

    cased = (
        F.when((F.length(part) > 1) & (part == F.upper(part)), F.upper(surrogate))
        .when(F.substring(part, 1, 1) == F.upper(F.substring(part, 1, 1)), F.concat(F.upper(F.substring(surrogate, 1, 1)), F.substring(surrogate, 2, 1000)))
        .otherwise(surrogate)
    )
    placed = F.array_join(F.zip_with(chars, F.filter(F.split(surrogate, ""), lambda c: c != ""), lambda c, s: F.when(c.between("A", "Z"), F.upper(s)).otherwise(s)), "")
    return (
        F.when(kind == "phone", numbered(phone)).when(kind.isin("card", "ssn", "iban"), numbered(surrogate)).when(kind == "name", cased)
        .when(kind == "email", placed).otherwise(surrogate)
    )


# Tables ---------------------------------------------------------------------------------------------------------------------------

_IDS = ["kind", "canon", "role"]


def surrogate_table(entities: DataFrame, key: str, keeper: Scratch | None = None) -> DataFrame:
    """``kind, canon, role, surrogate`` of the different ``kind, canon, role`` rows, without collisions; ``keeper`` deletes it in the end."""
    keeper = keeper or Scratch(entities.sparkSession)
    with Scratch(entities.sparkSession) as scratch:
        ids = [F.col(c) for c in _IDS]
        first = scratch.written(entities.select(*_IDS).distinct().withColumn("surrogate", draw(*ids, 0, key)), "first-draws")
        originals = first.select("kind", F.col("canon").alias("surrogate"))
        # Nobody redraws the first draw of a permutation, so that it stays free for its entity.
        reserved = first.where("kind != 'name'").select("kind", "surrogate")
        done: DataFrame | None = None
        drawn, attempt = first, 0
        while True:
            taken = originals if done is None else originals.unionByName(reserved).unionByName(done.select("kind", "surrogate"))
            winner = drawn.groupBy("kind", "surrogate").agg(F.min(F.struct("canon", "role")).alias("w"))
            winner = winner.join(taken, ["kind", "surrogate"], "left_anti").select("kind", "surrogate", "w.canon", "w.role", F.lit(True).alias("won"))
            tried = scratch.written(drawn.join(winner, [*_IDS, "surrogate"], "left"), "draws")
            won, rest = tried.where("won").select(*_IDS, "surrogate"), tried.where("won is null").select(*_IDS)
            done = won if done is None else done.unionByName(won)
            attempt += 1
            if attempt > MAX_ATTEMPTS:
                done = done.unionByName(first.join(rest.where("kind != 'name'"), _IDS, "left_semi").select(*_IDS, "surrogate"))
                rest = rest.where("kind = 'name'")
            if rest.isEmpty():
                return keeper.written(done, "surrogate-table")
            drawn = scratch.written(rest.withColumn("surrogate", draw(*ids, attempt, key)), "redraws")


_ROW = ["row", "check"]


def _row() -> list[Column]:
    """Two hashes that tell rows apart: rows equal in doc_id and text are one."""
    return [F.xxhash64("doc_id", "text").alias("row"), F.xxhash64("text", "doc_id").alias("check")]


def found_entities(docs: DataFrame) -> DataFrame:
    """``row, check, entities, names, givens`` of the rows with entities: all mentions in order, the words of names, and given names with genders."""
    entities = F.regexp_extract_all("text", F.lit(ENTITY), F.lit(0))
    found = docs.select(*_row(), "text", entities.alias("found")).where(F.size("found") > 0)
    titled = F.filter("found", lambda e: e.rlike(f"^(?:{PATTERNS['name']})$"))
    found = found.withColumn("titled", titled).withColumn("names", name_words(F.col("titled")))
    again = F.when(F.size("names") > 0, F.regexp_extract_all("text", pattern_with(F.col("names")), F.lit(0))).otherwise(F.col("found"))
    givens = F.transform(
        F.filter("titled", has_given),
        lambda e: F.struct(F.lower(F.get(F.split(bare_name(e), "[ -]"), F.lit(0))).alias("word"), gender_of(e).alias("gender")),
    )
    return found.select(*_ROW, again.alias("entities"), "names", givens.alias("givens"))


def entity_parts(found: DataFrame) -> DataFrame:
    """``row, check, pos, entity, kind, k, part, canon, given, gender`` of every replaced part; the gender is what the document says."""
    each = found.groupBy(*_ROW).agg(*[F.first(c).alias(c) for c in ("entities", "names", "givens")])
    each = each.select(*_ROW, "names", "givens", F.posexplode("entities").alias("pos", "entity"))
    each = each.withColumn("kind", kind_of(F.col("entity"), F.col("names")))
    parts = F.when(F.col("kind") == "name", F.split(bare_name(F.col("entity")), "[ -]")).otherwise(F.array("entity"))
    each = each.select(*_ROW, "pos", "entity", "kind", "givens", F.posexplode(parts).alias("k", "part"))
    each = each.withColumn("canon", canonical(F.col("kind"), F.col("part")))
    same = F.filter("givens", lambda g: g["word"] == F.col("canon"))
    each = each.withColumn("same", F.when(F.col("kind") == "name", same))
    said = F.filter("same", lambda g: g["gender"].isNotNull())
    own = F.when(has_given(F.col("entity")) & (F.col("k") == 0), gender_of(F.col("entity")))
    return each.select(
        *_ROW, "pos", "entity", "kind", "k", "part", "canon", F.coalesce(F.size("same") > 0, F.lit(False)).alias("given"),
        F.coalesce(own, F.get(said, F.lit(0))["gender"]).alias("gender"),
    )


def with_roles(parts: DataFrame) -> DataFrame:
    """``parts`` with ``role``: empty but for names; a given name of unknown gender has the more frequent one of the corpus."""
    male, female = (F.count_if(F.col("gender") == g) for g in ("male", "female"))
    usual = parts.where("given and gender is not null").groupBy("canon").agg(
        F.when(male > female, "male").when(female > male, "female").otherwise("neutral").alias("usual")
    )
    unknown = F.col("given") & F.col("gender").isNull()
    open_ = parts.where(unknown).join(usual, "canon", "left").withColumn("role", F.coalesce("usual", F.lit("neutral")))
    role = F.when(F.col("kind") != "name", "").when(F.col("given"), F.col("gender")).otherwise("family")
    return parts.where(~unknown).withColumn("role", role).unionByName(open_.drop("usual"))


def replacements(docs: DataFrame, key: str) -> DataFrame:
    """``found_row, found_check, new array<struct<pos, text, kind>>``: what stands for each entity of a row. No original is kept."""
    with Scratch(docs.sparkSession) as scratch:
        found = scratch.written(found_entities(docs), "found-entities")
        parts = scratch.written(with_roles(entity_parts(found)), "entity-parts")
        table = surrogate_table(parts, key, scratch)
        named = parts.join(table, _IDS).select(*_ROW, "pos", "entity", "kind", "k", poured(F.col("kind"), F.col("part"), F.col("surrogate")).alias("new"))
        joined = F.transform(F.sort_array(F.collect_list(F.struct("k", "new"))), lambda x: x["new"])
        by_entity = named.groupBy(*_ROW, "pos", "entity", "kind").agg(joined.alias("new"))
        # A name is its title, then its parts with the gaps between them, or a title after them.
        gaps = F.regexp_extract_all(bare_name(F.col("entity")), F.lit("[ -]"), F.lit(0))
        by_entity = by_entity.withColumn("gaps", gaps)
        name = F.concat(
            F.regexp_extract("entity", _PREFIX_AT, 1),
            F.array_join(F.transform("new", lambda x, i: F.concat(x, F.coalesce(F.get("gaps", i), F.lit("")))), ""),
            F.regexp_extract("entity", _SUFFIX_AT, 2),
        )
        by_entity = by_entity.withColumn("text", F.when(F.col("kind") == "name", name).otherwise(F.get("new", F.lit(0))))
        by_row = by_entity.groupBy(F.col("row").alias("found_row"), F.col("check").alias("found_check")).agg(
            F.sort_array(F.collect_list(F.struct("pos", "text", "kind"))).alias("new")
        )
        return written(by_row, "replacements")


def with_surrogates(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` held in the struct ``doc``, with the new ``text`` and ``kinds``, the kinds of the entities in text order."""
    new = replacements(docs.select("doc_id", "text"), key)
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("text").alias("old"), *_row())
    out = held.join(new.hint("merge"), (F.col("row") == F.col("found_row")) & (F.col("check") == F.col("found_check")), "left")
    # The pattern of a document follows from its text, so that no name has to be stored.
    out = out.withColumn("names", F.when(F.col("new").isNotNull(), name_words(titled_names(F.col("old")))))
    pattern = F.when(F.size("names") > 0, pattern_with(F.col("names"))).otherwise(F.lit(ENTITY))
    out = out.withColumn("between", F.when(F.col("new").isNotNull(), F.split("old", pattern)))
    text = F.array_join(
        F.transform("between", lambda s, i: F.concat(s, F.coalesce(F.get("new", i)["text"], F.lit("")))), ""
    )
    return out.select(
        "doc",
        F.when(F.col("new").isNull(), F.col("old")).otherwise(text).alias("text"),
        F.coalesce(F.transform("new", lambda x: x["kind"]), F.array().cast("array<string>")).alias("kinds"),
    )


def replace_pii(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with surrogates in ``text``, plus ``n_entities``."""
    old = [F.col(f"doc.`{c}`").alias(c) for c in docs.columns if c not in ("text", "n_entities")]
    return with_surrogates(docs, key).select(*old, "text", F.size("kinds").cast("long").alias("n_entities"))
