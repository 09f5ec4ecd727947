"""Surrogates for personal data (operator 5).

Detected entities get keyed replacements of the same type and format. Numbers,
addresses and secrets go through a keyed permutation of all strings of their own
shape, so two different ones never share a surrogate; letters of any script are
replaced by letters of their script and case; card numbers keep a valid check
digit, IP addresses valid octets. Names after a title, and known given names before
a family name, become other names of the same gender and script, with as many parts
joined by hyphens: listed ones at first, then names built of syllables, which don't
run out. No entity becomes itself. A collision check over the distinct entities of the
whole corpus moves every entity but one that share a surrogate (but for letter case),
and every one whose surrogate is another entity of the corpus, to their next choice
until there is none. Equal entities have equal surrogates
everywhere: a given name whose title tells no gender takes the gender that the
corpus gives it, and later mentions of a name follow its first.

The key comes from the setting spark.filamenta.surrogates.key. Whoever knows it can
reverse the permutations, so there is no default: without the setting each call
draws a key that is kept nowhere, and surrogates can't be matched between calls.
"""

from __future__ import annotations

import hashlib
import re
import secrets
import string
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, free_names, keep, quoted, small_batches

KEY_SETTING = "spark.filamenta.surrogates.key"
#: What the registered query and the pipeline use without the setting, so that their runs agree. Whoever reads this can reverse it: set a key of your own for data that matter.
REGISTERED_KEY = "filamenta-registered"
#: Rounds of the collision check, each of which moves all entities that share a surrogate; an error beyond.
ROUNDS = 100
#: Entities that had to move to a later choice and are sent to every task; beyond so many they are joined to their documents instead.
SENT = 100_000
#: Choices of one length; so many later ones have a character more, and so on.
STRETCH = 8

_DIGIT, _LOWER, _UPPER, _HEX = string.digits, string.ascii_lowercase, string.ascii_uppercase, "0123456789abcdef"
_ALPHABETS = ("абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЁЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ")
# Frequent given and family names, by gender and script.
GIVEN = {
    ("f", "latin"): "Alice Anna Bella Carla Clara Diana Elena Emma Eva Flora Grace Helen Ida Irene Julia Laura Lena Lucia Maria Nina Nora Olga Paula Rosa Sara Sofia Vera Zoe".split(),
    ("m", "latin"): "Adam Albert Bruno Carl Daniel David Edgar Emil Felix Frank George Hugo Ivan Jack Jonas Karl Leo Louis Mark Martin Max Oscar Paul Peter Robert Simon Thomas Victor".split(),
    ("f", "cyrillic"): "Анна Вера Галина Дарья Елена Ирина Мария Нина Ольга Софья Татьяна Юлия".split(),
    ("m", "cyrillic"): "Андрей Борис Виктор Глеб Денис Иван Лев Михаил Никита Олег Павел Сергей".split(),
    ("f", "greek"): "Άννα Ελένη Ειρήνη Κατερίνα Μαρία Σοφία".split(),
    ("m", "greek"): "Γιάννης Γιώργος Δημήτρης Κώστας Νίκος Πέτρος".split(),
}
FAMILY = {
    "latin": "Abbott Baker Becker Bernard Blanco Carter Castro Costa Dubois Fischer Fuchs Garcia Girard Haas Harris Keller Lambert Lopez Meyer Moreau Navarro Ortega Parker Perez Richter Romero Sanders Schmidt Turner Vogel Walker Weber Wolf Young".split(),
    "cyrillic": "Белов Волков Громов Егоров Жуков Зайцев Козлов Лебедев Морозов Новиков Орлов Попов".split(),
    "greek": "Αλεξίου Γεωργίου Δημητρίου Ιωάννου Νικολάου Παππάς".split(),
}
# Consonants and vowels of each script's syllables, and endings of women's, men's and family names.
SYLLABLES = {
    "latin": ("bcdfghjklmnprstvwz", "aeiou", {"f": ["a", "ia", "ina"], "m": ["o", "us", "an"], "family": ["er", "an", "el", "ov", "is", "en"]}),
    "cyrillic": ("бвгджзклмнпрстфхчш", "аеиоу", {"f": ["а", "ия", "ина"], "m": ["ан", "ий", "ор"], "family": ["ко", "ук", "ак", "ич", "дзе", "ян"]}),
    "greek": ("βγδζθκλμνπρστφχ", "αεηιο", {"f": ["α", "η", "ια"], "m": ["ος", "ης", "ας"], "family": ["ου", "ης", "ας", "ιδης"]}),
}
_TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Herr": "m", "Frau": "f", "Señor": "m", "Señora": "f", "Sr": "m", "Sra": "f", "Monsieur": "m", "Madame": "f", "Mme": "f", "Dr": "", "Prof": "", "Господин": "m", "Госпожа": "f", "Κύριος": "m", "Κυρία": "f"}
_CAP = r"(?:[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ'’-]++|[А-ЯЁ][а-яё-]++|[Α-ΩΆΈ-Ώ][α-ωά-ώ]++)"
_FOUND = re.compile(
    r"(?P<email>(?<![\w.%+-])[\w.%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+)"
    r"|(?P<key>(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9]))"
    r"|(?i:(?<![a-z])(?:password|passwd|pwd|secret|token|api[_-]?key)\s*+[=:]\s*+[\"']?)(?P<secret>[^\s\"',;]{6,})"
    r"|(?P<ip>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d))"
    r"|(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))"
    r"|(?P<phone>(?<![\w+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]\d{3,5}(?!\d)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-]))"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<card>(?<![\d.-])\d(?:[ -]?\d){12,18}(?!\d))"
    r"|(?P<name>(?<!\w)(?P<title>" + "|".join(_TITLES) + r")\b\.?\s(?P<first>" + _CAP + r")(?:\s(?P<last>" + _CAP + r"))?)"
    r"|(?P<person>(?<!\w)(?P<known>" + "|".join(n for names in GIVEN.values() for n in names) + r")\s(?P<family>" + _CAP + r")(?!\w))"
)
_HINT = re.compile(r"[@\d]|[=:]|(?<!\w)(?:" + "|".join([*_TITLES, *(n for names in GIVEN.values() for n in names)]) + r")\b")
_GENDER = {n: g for (g, _), names in GIVEN.items() for n in names}


def key_of(spark: SparkSession, otherwise: str | None = None) -> bytes:
    """The key of the session's setting, else that of `otherwise`, else one for this call alone."""
    key = spark.conf.get(KEY_SETTING, None) or otherwise
    return hashlib.blake2b(key.encode(), digest_size=32).digest() if key else secrets.token_bytes(32)


def luhn(digits: str) -> int:
    """The check digit that makes digits + it valid."""
    total = sum(sum(divmod(int(c) * (2 - k % 2), 10)) for k, c in enumerate(reversed(digits)))
    return -total % 10


def permuted(key: bytes, tweak: str, number: int, size: int) -> int:
    """A keyed permutation of 0 .. size - 1: a balanced Feistel network over the next even number of bits, walked until it is inside."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    width = (half + 7) // 8
    x = number
    while True:
        a, b = x >> half, x & mask
        for turn in range(6):
            h = hashlib.blake2b(b.to_bytes(width, "big"), key=key, person=hashlib.blake2b(f"{tweak}/{turn}/{size}".encode(), digest_size=16).digest(), digest_size=min(64, width + 4)).digest()
            a, b = b, (a ^ int.from_bytes(h, "big")) & mask
        x = a << half | b
        if x < size:
            return x


def reshaped(key: bytes, kind: str, value: str, classes: list[str], attempt: int = 0) -> str:
    """value with every character whose class isn't empty permuted jointly inside its class, by another permutation for each shape and attempt."""
    out, chunk = list(value), 60
    shape = "".join(c if classes[k] == "" else f"<{classes[k]}>" if not classes[k].isascii() else "U" if classes[k] == _UPPER else str(len(classes[k])) for k, c in enumerate(value))
    places = [k for k, c in enumerate(classes) if c]
    for a in range(0, len(places), chunk):
        part = places[a : a + chunk]
        number, size = 0, 1
        for k in part:
            number = number * len(classes[k]) + classes[k].index(value[k])
            size *= len(classes[k])
        context = shape if a == 0 else f"{value[: part[0]]}/{shape}"
        number = permuted(key, f"{kind}:{context}:{a}" + (f":{attempt}" if attempt else ""), number, size)
        for k in reversed(part):
            number, r = divmod(number, len(classes[k]))
            out[k] = classes[k][r]
    return "".join(out)


@lru_cache(maxsize=1 << 16)
def _class(c: str) -> str:
    """The characters among which one is permuted: ASCII digits or letters of its case; beyond ASCII, those of its alphabet, or the letters or digits of its category in its 128 code points."""
    if c.isascii():
        return _DIGIT if c in _DIGIT else _LOWER if c in _LOWER else _UPPER if c in _UPPER else ""
    for letters in _ALPHABETS:
        if c in letters:
            return letters
    kind = unicodedata.category(c)
    if kind[0] not in "LN":
        return ""
    first = ord(c) & ~127
    return "".join(x for x in map(chr, range(first, first + 128)) if unicodedata.category(x) == kind)


def script_of(word: str) -> str:
    return "cyrillic" if "Ѐ" <= word[0] <= "ӿ" else "greek" if "Ͱ" <= word[0] <= "Ͽ" else "latin"


def _is_name(kind: str) -> bool:
    return kind.startswith(("given", "family"))


def _known_as(kind: str, value: str) -> str:
    """The value under which an entity is the same everywhere: names don't depend on letter case."""
    return value.lower() if _is_name(kind) else value


def _name(kind: str, part: str, place: int, attempt: int, key: bytes) -> str:
    """A name for one part of a name: a listed one first, then one built of syllables of the script with an ending of the gender, longer from choice to choice."""
    script = script_of(part)
    genders = [kind[6:]] if kind in ("given:f", "given:m") else ["f", "m"]
    h = int.from_bytes(hashlib.blake2b(f"{kind}:{part.lower()}:{place}:{attempt}".encode(), key=key, digest_size=32).digest(), "big")
    if attempt == 0:
        names = FAMILY[script] if kind == "family" else [n for g in genders for n in GIVEN[g, script]]
        names = [n for n in names if n.lower() != part.lower()]
        return names[h % len(names)]
    consonants, vowels, ends = SYLLABLES[script]
    out = ""
    for _ in range(1 + (attempt + 1) // 2):  # an even chance in 100, in 10,000, ... of a first choice taken
        h, c = divmod(h, len(consonants))
        h, v = divmod(h, len(vowels))
        out += consonants[c] + vowels[v]
    own = ends["family" if kind == "family" else genders[h % len(genders)]]
    h, c = divmod(h // 2, len(consonants))
    return (out + consonants[c] + own[h % len(own)]).capitalize()


def surrogate(kind: str, value: str, attempt: int, key: bytes) -> str:
    """The attempt-th choice for an entity, never itself (but for letter case); kinds given:f, given:m, given: and family are names.

    Emails, phones and secrets may have few or no characters to permute, so their choices from the STRETCH-th on are longer.
    """
    out = _choice(kind, value, attempt, key)
    while out.lower() == value.lower():
        attempt += STRETCH
        out = _choice(kind, value, attempt, key)
    return out


def _choice(kind: str, value: str, attempt: int, key: bytes) -> str:
    if _is_name(kind):
        return "-".join(_name(kind, part, k, attempt, key) if part else "" for k, part in enumerate(value.split("-")))
    if kind == "ip":
        number = 0
        for part in value.split("."):
            number = number << 8 | int(part)
        number = permuted(key, f"ip:{attempt}" if attempt else "ip", number, 1 << 32)
        return ".".join(str(number >> s & 255) for s in (24, 16, 8, 0))
    classes = [_class(c) for c in value]
    digits = [k for k, c in enumerate(value) if c in _DIGIT]
    if kind == "email":
        dot = value.rindex(".")
        classes[dot:] = [""] * (len(value) - dot)
    elif kind == "key":
        classes = [""] * 4 + [_DIGIT + _UPPER] * (len(value) - 4)
    elif kind == "secret" and all(c in _HEX for c in value):
        classes = [_HEX] * len(value)
    elif kind == "iban":
        classes[:4] = ["", "", _DIGIT, _DIGIT]
    elif kind == "phone":
        if value.startswith("+"):
            for k in range(1, re.match(r"\+\d{1,3}", value).end()):
                classes[k] = ""
            digits = [k for k in digits if classes[k]]
        if digits and value[digits[0]] in "23456789":
            classes[digits[0]] = "23456789"
    elif kind == "card":
        classes[digits[0]] = classes[digits[-1]] = ""
        out = reshaped(key, kind, value, classes, attempt)
        check = luhn("".join(out[k] for k in digits[:-1]))
        return out[: digits[-1]] + str(check) + out[digits[-1] + 1 :]
    out = reshaped(key, kind, value, classes, attempt)
    if attempt < STRETCH or kind not in ("email", "phone", "secret"):
        return out
    extra, letters = "", _DIGIT if kind == "phone" else _LOWER
    for k in range(attempt // STRETCH):
        extra += letters[int.from_bytes(hashlib.blake2b(f"{kind}:{value}:{attempt}:{k}".encode(), key=key, digest_size=8).digest(), "big") % len(letters)]
    return extra + out if kind == "email" else out + extra


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) of the entities of a text, from left to right and without overlap.

    Names of a text that stand after a title or as a whole are found again where they
    stand alone. A given name's gender is its title's, else that of the same name
    elsewhere in the text, else that of the list of names.
    """
    if not _HINT.search(text):
        return []
    out, given, families = [], {}, set()

    def person(first: tuple[int, int] | None, name: str | None, last: tuple[int, int], family: str, gender: str) -> None:
        if first is not None:
            out.append((*first, f"given:{gender}" if gender else "given", name))
            given[name] = given.get(name) or gender
        out.append((*last, "family", family))
        families.add(family)

    for m in _FOUND.finditer(text):
        if m["name"] is not None:
            alone = m["last"] is None
            person(None if alone else m.span("first"), m["first"], m.span("first" if alone else "last"), m["first" if alone else "last"], _TITLES[m["title"]])
        elif m["person"] is not None:
            person(m.span("known"), m["known"], m.span("family"), m["family"], "")
        elif m.lastgroup == "card":
            digits = re.sub(r"\D", "", m["card"])
            out.append((*m.span(), "card" if luhn(digits[:-1]) == int(digits[-1]) else "number", m[0]))
        else:
            out.append((*m.span(m.lastgroup), m.lastgroup, m[m.lastgroup]))
    names = families | set(given)
    if names:
        taken, k = sorted((a, b) for a, b, _, _ in out), 0
        for m in re.finditer(r"(?<!\w)(?:" + "|".join(map(re.escape, sorted(names, key=len, reverse=True))) + r")(?!\w)", text):
            while k < len(taken) and taken[k][1] <= m.start():
                k += 1
            if k == len(taken) or m.end() <= taken[k][0]:
                out.append((*m.span(), "family" if m[0] in families else "given", m[0]))
        out.sort()
    return [(a, b, f"given:{given[v] or _GENDER.get(v, '')}" if kind == "given" else kind, v) for a, b, kind, v in out]


def replaced(text: str, moved: dict[str, tuple[str, int]], key: bytes) -> tuple[str, int]:
    """The text with surrogates and their number; moved: kind and attempt of entities ("kind value") that aren't at the first choice of their own kind."""
    found = entities(text)
    if not found:
        return text, 0
    out, at = [], 0
    for a, b, kind, value in found:
        kind, attempt = moved.get(f"{kind} {_known_as(kind, value)}", (kind, 0))
        out += [text[at:a], surrogate(kind, value, attempt, key)]
        at = b
    return "".join(out) + text[at:], len(found)


_ENTITY = "kind string, value string"


def _distinct_entities(docs: DataFrame) -> DataFrame:
    def found(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = {(k, _known_as(k, v)) for t in part["text"] for _, _, k, v in entities(t)}
            yield pd.DataFrame(sorted(rows), columns=["kind", "value"])

    return docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInPandas(found, _ENTITY).distinct()


def told_apart(found: DataFrame) -> DataFrame:
    """(value, as_kind): given names without a gender that the corpus has with one gender elsewhere."""
    gendered = found.where("kind in ('given:f', 'given:m')").groupBy("value").agg(F.count("*").alias("n"), F.max("kind").alias("as_kind")).where("n = 1")
    return found.where("kind = 'given:'").join(gendered, "value").select("value", "as_kind")


def collision_free(found: DataFrame, key: bytes, rounds: int = ROUNDS) -> DataFrame:
    """(kind, value, attempt, surrogate) of distinct entities, no two with one surrogate, and none with a surrogate that is itself a value of the corpus, whatever the letter case."""

    @F.pandas_udf("string")
    def choice(kind: pd.Series, value: pd.Series, attempt: pd.Series) -> pd.Series:
        return pd.Series([surrogate(k, v, a, key).lower() for k, v, a in zip(kind, value, attempt)], dtype=object)

    real = keep(found.select(F.lower("value").alias("surrogate")).distinct(), "values")
    now = keep(found.withColumn("attempt", F.lit(0)).withColumn("surrogate", choice("kind", "value", "attempt")), "surrogates")
    for _ in range(rounds):
        taken = now.join(real, "surrogate", "left_semi").select("kind", "value")
        owner = now.groupBy("surrogate").agg(F.min(F.struct("attempt", "kind", "value")).alias("owner"), F.count("*").alias("n")).where("n > 1").select("surrogate", "owner")
        losing = now.join(owner, "surrogate").where("owner.kind <> kind or owner.value <> value").select("kind", "value").union(taken).distinct()
        losing = losing.join(now.select("kind", "value", "attempt"), ["kind", "value"]).select("kind", "value", (F.col("attempt") + 1).alias("attempt"))
        losing = keep(losing.withColumn("surrogate", choice("kind", "value", "attempt")), "surrogates")
        if losing.isEmpty():
            discard(real, losing)
            return now
        before, now = now, keep(now.join(losing, ["kind", "value"], "left_anti").unionByName(losing), "surrogates")
        discard(before, losing)
    raise RuntimeError(f"entities still share surrogates after {rounds} rounds")


def replace_personal_data(docs: DataFrame, key: bytes | None = None, sent: int = SENT, count: str = "n_replaced") -> DataFrame:
    """docs with all its columns, text rewritten, and the number of replaced entities (long) in the column that count names.

    key: of the permutations and hashes; by default key_of() the session. A null text
    stays null (n_replaced 0), texts without entities stay as they are, n_chars, where
    docs has it, is counted anew. Repeated rows are rewritten alike; an empty table
    gives an empty result. A column of docs with the name that count has is overwritten.
    """
    small_batches(docs.sparkSession)
    key = key or key_of(docs.sparkSession)
    found = keep(_distinct_entities(docs), "entities")
    alias = told_apart(found)
    assigned = collision_free(found.join(alias.select("value", F.lit("given:").alias("kind")), ["kind", "value"], "left_anti"), key)
    named = lambda kind: F.concat_ws(" ", kind, "value").alias("entity")
    moved = assigned.where("attempt > 0").select(named("kind"), "kind", "attempt")
    led = alias.join(assigned, (alias["value"] == assigned["value"]) & (alias["as_kind"] == assigned["kind"])).select(F.concat_ws(" ", F.lit("given:"), alias["value"]).alias("entity"), "kind", "attempt")
    moved = keep(moved.unionByName(led), "moved")
    names = docs.columns
    new, row, moves = free_names(docs, "new", "row", "moves")

    if moved.limit(sent + 1).count() <= sent:
        sent_all = {r["entity"]: (r["kind"], r["attempt"]) for r in moved.collect()}

        @F.pandas_udf("text string, n_replaced long")
        def rewrite(text: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([(None, 0) if t is None else replaced(t, sent_all, key) for t in text], columns=["text", "n_replaced"])

        out = docs.withColumn(new, rewrite("text"))
    else:

        @F.pandas_udf("array<string>")
        def of_text(text: pd.Series) -> pd.Series:
            return text.map(lambda t: sorted({f"{k} {_known_as(k, v)}" for _, _, k, v in entities(t or "")}))

        @F.pandas_udf("text string, n_replaced long")
        def rewrite_by(text: pd.Series, moves: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([(None, 0) if t is None else replaced(t, {e["entity"]: (e["kind"], e["attempt"]) for e in (m if m is not None else [])}, key) for t, m in zip(text, moves)], columns=["text", "n_replaced"])

        rows = docs.withColumn(row, F.monotonically_increasing_id())
        of_row = rows.select(row, F.explode(of_text("text")).alias("entity")).join(moved, "entity").groupBy(row).agg(F.collect_list(F.struct("entity", "kind", "attempt")).alias(moves))  # the entities of one document
        out = rows.join(of_row, row, "left").withColumn(new, rewrite_by("text", moves))
    text = F.col(f"{new}.text")
    fresh = {"text": text} | ({"n_chars": F.coalesce(F.length(text).cast("long"), F.lit(0).cast("long"))} if "n_chars" in names else {})
    return out.select(*[fresh[c].alias(c) if c in fresh else F.col(q) for c, q in zip(names, quoted(*names)) if c != count], F.col(f"{new}.n_replaced").alias(count))
