"""Operator 2: personal data replaced by keyed surrogates of the same type and format.

Detected: e-mail addresses, telephone numbers, payment card, bank account (IBAN) and social security numbers,
IPv4 and IPv6 addresses, secrets after words like ``token`` or ``password``, and names after a title or a phrase like
``name is``; further mentions of a name's words in the same text count too, whether or not a title stands before them.

An entity's canonical form (case and separators folded) and a secret key determine its surrogate, so
the same number gets the same surrogate in every document.  Names are replaced word by word: each word has one
surrogate in the whole corpus, whatever the title and whatever the words beside it, so ``Dr. John Smith``, ``Mr. Smith``
and ``John Smith`` stay the same person.  A word's gender is what most titles before it say, over all documents: of a
first name, and in scripts whose family names are inflected of these as well.  Surrogates keep the format: digits stay digits,
letters stay letters of their script and case, separators and lengths stay; card numbers and IBANs keep valid check
digits, parts of addresses stay in range.

Collisions are checked over the whole corpus and all types: a surrogate that another entity has too, or
that is itself an entity of the corpus, is drawn again for all but one.  Entities that needed another draw or have a
gender are sent to tasks if they are at most ``BROADCAST`` rows; beyond that they are joined to the documents.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hot_join, table, text_of, written

BROADCAST = 100_000
#: Draws within the format; later ones append characters (addresses and IBANs: draw freely), which ends the collisions.
DRAWS = 30
#: Key of queries that name none; deployments pass their own secret.
DEFAULT_KEY = "change me"

IP = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\d]|\.\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
#: National numbers begin with a zero; local ones are three and four digits with a hyphen.
PHONE = r"(?:(?<![\w.,:/-])0\d{2,4}[ /-]\d{3,8}(?:[ -]\d{2,4}){0,2}(?![\w/-]|[.,:]\d)|(?<![\w.,:/-])0\d{9,10}(?![\w/-]|[.,:]\d)|(?<![\w.,:/-])[2-9]\d{2}-\d{4}(?![\w/-]|[.,:]\d)|(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]\d{2,4}){1,4}(?!\d)|(?<![\w+])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])|(?<!\w)\+\d{8,15}(?!\d))"
CARD = r"(?<!\d)(?:\d{13,19}|\d{4}(?:[ -]\d{4}){2,3}(?:[ -]\d{1,4})?)(?!\d)"
#: Where a number can begin: only there the patterns are tried.
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
IPV6 = re.compile(r"(?<![\w:.])[0-9A-Fa-f:]*:[0-9A-Fa-f:]*(?![\w:.])")
BEGIN = re.compile(r"[+(]|\d+")
NUMBERS = re.compile(rf"(?P<ip>{IP})|(?P<ssn>{SSN})|(?P<phone>{PHONE})|(?P<card>{CARD})")
LOCAL_PART = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_.%+-")
HOST = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+")
SECRET = re.compile(r"[=:]\s*[\"']?([A-Za-z0-9_+/.-]*[A-Za-z0-9_+/-])")
SECRET_NAME = re.compile(r"(?:token|password|passwd|pwd|secret|api[_ -]?key|access[_ -]?key)[\"']?\s*$", re.I)
#: Titles and the gender they tell.
TITLES = {
    "Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Herr": "m", "Herrn": "m", "Frau": "f", "Señor": "m", "Señora": "f", "Señorita": "f", "Monsieur": "m", "Madame": "f",
    "Mademoiselle": "f", "Sr": "m", "Sra": "f", "Mme": "f", "Dr": "n", "Prof": "n", "Господин": "m", "Госпожа": "f", "Κύριος": "m", "Κυρία": "f"}
#: Phrases before a name that tell no gender.
CUES = ("name is", "Name:", "Name ist", "heiße", "llamo", "nombre es", "Nombre:", "appelle", "Nom:", "зовут", "λένε")
INTRODUCED = {**TITLES, **dict.fromkeys(CUES, "n")}
WORD = r"(?:[^\W\d_a-z]['\u2019])?[^\W\d_a-z][^\W\d_]+"
NAME = re.compile(rf"\.?[ ]({WORD}(?:[ -]{WORD}){{0,2}})")
MARKS = " '\u2019-"
BETWEEN = re.compile(rf"[{MARKS}]")
#: Syllables of made-up names: consonants, vowels, endings by gender.
SCRIPTS = {
    "LATIN": ("bcdfglmnprstv", "aeiou", {"m": ("o", "us", "en"), "f": ("a", "ia", "ina"), "n": ("e", "is", "or")}),
    "CYRILLIC": ("бвгдзклмнпрст", "аеиоу", {"m": ("ов", "ин", "ан"), "f": ("ова", "ина", "ана"), "n": ("ко", "енко", "ых")}),
    "GREEK": ("βγδκλμνπρστ", "αειου", {"m": ("ος", "ης", "ας"), "f": ("α", "η", "ου"), "n": ("ι", "ο", "ιδι")}),
}


def _names(text: str) -> list[tuple[int, int, str]]:
    """(start, end, gender of the title) of names; further mentions have gender n."""
    found, said = [], set()
    for title, gender in INTRODUCED.items():
        at = text.find(title)
        while at >= 0:
            m = NAME.match(text, at + len(title))
            if m and not (at and text[at - 1].isalnum()) and BETWEEN.split(m[1])[0] not in TITLES:
                if gender == "n":  # as in Frau Dr.
                    before = text[max(0, at - 16) : at].rstrip(" .").rpartition(" ")[2]
                    gender_here = TITLES.get(before, "n")
                else:
                    gender_here = gender
                found.append((m.start(1), m.end(1), gender_here))
                # as written, and in capitals or not: an ordinary word in small letters is none
                said.update(x for w in BETWEEN.split(m[1]) if len(w) > 1 for x in (w, w.upper(), w.capitalize()))
            at = text.find(title, at + len(title))
    if said:
        one = "|".join(map(re.escape, sorted(said, key=lambda w: (-len(w), w))))
        found += [(m.start(), m.end(), "n") for m in re.finditer(rf"(?<!\w)(?:[^\W\d_a-z]['\u2019])?(?:{one})(?:[ -](?:{one}))*(?!\w)", text)]
    return found


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, end, type) of the entities of a text, in order and without overlaps; a name's type has its title's gender."""
    found = []
    at = text.find("@")
    while at >= 0:
        left = at
        while left and text[left - 1] in LOCAL_PART:
            left -= 1
        right = HOST.match(text, at + 1)
        if left < at and text[at - 1] != "." and right:
            found.append((left, right.end(), "email"))
        at = text.find("@", at + 1)
    if "=" in text or ":" in text:
        for m in SECRET.finditer(text):
            if len(m[1]) >= 6 and SECRET_NAME.search(text, max(0, m.start() - 24), m.start()):
                found.append((m.start(1), m.end(1), "secret"))
        if text.count(":") > 1:
            found += [(m.start(), m.end(), "ipv6") for m in IPV6.finditer(text) if _is_ipv6(m[0])]
    found += [(m.start(), m.end(), "iban") for m in IBAN.finditer(text) if _mod97(m[0].replace(" ", "")) == 1]
    begin = BEGIN.search(text)
    while begin:
        m = NUMBERS.match(text, begin.start())
        if m:
            found.append((m.start(), m.end(), m.lastgroup))
        begin = BEGIN.search(text, m.end() if m else begin.end())
    found += [(a, b, f"name_{gender}") for a, b, gender in _names(text)]
    rank = {"email": 0, "secret": 1, "iban": 2, "ipv6": 2}
    out, end = [], 0
    for a, b, kind in sorted(found, key=lambda x: (x[0], rank.get(x[2], 3), -x[1], x[2])):
        if a >= end:
            out.append((a, b, kind))
            end = b
    return out


def _is_ipv6(value: str) -> bool:
    groups = [g for g in value.split(":") if g]
    # short forms are addresses if a digit is in them: a::b may be program text
    if not groups or (len(groups) < 3 and not any(c.isdigit() for c in value)):
        return False
    try:
        ipaddress.IPv6Address(value)
    except ValueError:
        return False
    return True


def _mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def canonical(kind: str, value: str) -> str:
    """One form for all writings of an entity."""
    if kind in ("phone", "card", "ssn"):
        return "".join(c for c in value if c.isdigit())
    if kind == "iban":
        return value.replace(" ", "").upper()
    if kind == "ipv6":
        return ipaddress.IPv6Address(value).compressed
    return unicodedata.normalize("NFC", value).casefold() if kind == "name" else value.casefold()


def parts(kind: str, value: str) -> list[tuple[str, str, str]]:
    """(kind, canonical form, gender that the title tells) of what gets a surrogate of its own: a name's words, else the entity."""
    if not kind.startswith("name"):
        return [(kind, canonical(kind, value), "n")]
    words, gender = BETWEEN.split(value), kind[-1]
    return [("name", canonical("name", w), gender if (len(words) > 1 and i == 0) or _script(w) != "LATIN" else "n") for i, w in enumerate(words)]


class Draw:
    """Numbers from a keyed hash."""

    def __init__(self, key: str, kind: str, name: str, attempt: int) -> None:
        self.seed, self.count, self.bytes = hmac.new(key.encode(), f"{kind}\0{name}\0{attempt}".encode("utf-8", "surrogatepass"), hashlib.sha256).digest(), 0, b""

    def below(self, n: int) -> int:
        if len(self.bytes) < 4:
            self.bytes += hashlib.sha256(self.seed + self.count.to_bytes(4, "big")).digest()
            self.count += 1
        x, self.bytes = int.from_bytes(self.bytes[:4], "big"), self.bytes[4:]
        return x % n


def _luhn(digits: str) -> int:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10


def _script(word: str) -> str:
    name = unicodedata.name(next((c for c in word if c.isalpha()), "a"), "LATIN").split(" ")[0]
    return name if name in SCRIPTS else "LATIN"


def _name(draw: Draw, word: str, gender: str) -> str:
    consonants, vowels, ends = SCRIPTS[_script(word)]
    syllables = max(1, (len(word) - 2) // 2)
    body = "".join(consonants[draw.below(len(consonants))] + vowels[draw.below(len(vowels))] for _ in range(syllables))
    return body + consonants[draw.below(len(consonants))] + ends[gender][draw.below(3)]


def draw_canonical(key: str, kind: str, name: str, attempt: int, gender: str = "n") -> str:
    """The canonical surrogate of a canonical entity."""
    draw = Draw(key, kind, name, attempt)
    if kind in ("phone", "card", "ssn"):
        keep = 1 if kind == "phone" and len(name) > 10 else 0  # country code
        out = name[:keep] + "".join(str(draw.below(10)) for _ in name[keep:])
        if kind == "card" and _luhn(name) == 0:
            out = out[:-1] + next(d for d in "0123456789" if _luhn(out[:-1] + d) == 0)
        more = "0123456789"
    elif kind == "ip":
        if attempt >= 2 * DRAWS:  # the range of IPv4 is crowded: the documentation range of IPv6 never is
            return ipaddress.IPv6Address((0x20010DB8 << 96) | sum(draw.below(1 << 32) << 32 * k for k in range(3))).compressed
        out = []
        for p in name.split("."):
            lo, hi = {1: (0, 10), 2: (10, 100)}.get(len(p), (100, 256)) if attempt < DRAWS else (0, 256)
            out.append(str(lo + draw.below(hi - lo)))
        return ".".join(out)
    elif kind == "ipv6":
        if attempt >= DRAWS:
            return ipaddress.IPv6Address(sum(draw.below(1 << 32) << 32 * k for k in range(4))).compressed
        groups = [f"{1 + draw.below(16 ** len(g) - 1):x}" if g else g for g in name.split(":")]
        return ipaddress.IPv6Address(":".join(groups)).compressed
    elif kind == "iban":
        body = "".join(str(draw.below(10)) if c.isdigit() else chr(65 + draw.below(26)) for c in name[4:])
        body += "".join(str(draw.below(10)) for _ in range(max(0, attempt - DRAWS)))
        return f"{name[:2]}{98 - _mod97(name[:2] + '00' + body):02d}{body}"
    elif kind == "name":
        out, more = _name(draw, name, gender), "aeiou"
    else:
        user, at, host = name.rpartition("@")
        labels = host.split(".")
        fixed = "." + ".".join(labels[-2 if labels[-2:-1] in (["co"], ["com"], ["example"]) and len(labels) > 2 else -1 :]) if at else ""
        free = name[: len(name) - len(fixed)] if at and len(labels) > 1 else name
        alphabet = "abcdef" if kind == "secret" and re.fullmatch(r"[0-9a-f]+", name) else "abcdefghijklmnopqrstuvwxyz"
        out = "".join(str(draw.below(10)) if c.isdigit() else alphabet[draw.below(len(alphabet))] if c.isalpha() else c for c in free)
        out, more = out + name[len(free) :], alphabet
    if attempt >= DRAWS:
        extra = "".join(more[draw.below(len(more))] for _ in range(1 + attempt - DRAWS))
        head, at, host = out.partition("@")
        out = f"{head}{extra}{at}{host}"
    return out


def dress(kind: str, original: str, surrogate: str) -> str:
    """The canonical surrogate in the writing of the original: separators and case."""
    if kind in ("phone", "card", "ssn", "iban"):
        own = iter(surrogate)
        out = "".join(next(own, "") if c.isalnum() and (kind == "iban" or c.isdigit()) else c for c in original)
        return out + "".join(own)
    if kind == "name":
        return surrogate.upper() if original.isupper() else surrogate.capitalize()
    if kind == "ipv6" and "::" not in original:
        whole = ipaddress.IPv6Address(surrogate).exploded.split(":")
        surrogate = ":".join(f"{int(g, 16):x}".zfill(len(o)) for g, o in zip(whole, original.split(":"), strict=True))
    if kind in ("email", "secret") and len(surrogate) == len(original):
        return "".join(s.upper() if o.isupper() else s for s, o in zip(surrogate, original, strict=True))
    return surrogate.upper() if original.isupper() else surrogate


def replace(text: str, key: str, special: dict) -> tuple[str, int]:
    """The text with surrogates, and how many entities; ``special`` has (draw, gender) of (kind, name) that collided or have a gender."""
    out, at, spans = [], 0, find(text)
    for a, b, kind in spans:
        out.append(text[at:a])
        value = text[a:b]
        words = BETWEEN.split(value) if kind.startswith("name") else [value]
        marks = [c for c in value if c in MARKS] if len(words) > 1 else []
        for (own, name, _), word, mark in zip(parts(kind, value), words, [*marks, ""], strict=True):
            attempt, gender = special.get((own, name), (0, "n"))
            out.append(dress(own, word, draw_canonical(key, own, name, attempt, gender)) + mark)
        at = b
    return ("".join([*out, text[at:]]) if spans else text), len(spans)


def entities(docs: DataFrame) -> DataFrame:
    """Distinct (kind, name) over all texts, with the gender that most titles tell."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen: Counter = Counter()
            for t in b["text"]:
                seen.update(p for x, y, kind in find(t) for p in parts(kind, t[x:y]))
            both = sorted({(kind, name) for kind, name, _ in seen})
            yield pd.DataFrame([(k, n, seen[k, n, "m"], seen[k, n, "f"]) for k, n in both], columns=["kind", "name", "m", "f"])

    rows = docs.select(text_of().alias("text")).mapInPandas(run, "kind string, name string, m long, f long")
    told = rows.groupBy("kind", "name").agg(F.sum("m").alias("m"), F.sum("f").alias("f"))
    return told.select("kind", "name", F.when(F.col("m") > F.col("f"), "m").when(F.col("f") > F.col("m"), "f").otherwise("n").alias("gender"))


def collisions(known: DataFrame, key: str) -> DataFrame:
    """kind, name, gender, attempt of entities whose first draw doesn't stand, or that have a gender."""

    @F.pandas_udf("string")
    def drawn(kind: pd.Series, name: pd.Series, attempt: pd.Series, gender: pd.Series) -> pd.Series:
        return pd.Series([draw_canonical(key, k, n, int(a), g) for k, n, a, g in zip(kind, name, attempt, gender, strict=True)], dtype=object)

    def with_surrogate(df: DataFrame) -> DataFrame:
        return df.withColumn("surrogate", drawn("kind", "name", "attempt", "gender"))

    columns = ["kind", "name", "gender", "attempt", "surrogate"]
    current = written(with_surrogate(known.withColumn("attempt", F.lit(0))).select(columns), "surrogates")
    while True:  # later draws come from ranges that grow, so this ends
        # all but the smallest entity of a surrogate draw again, as does one that is an entity itself
        first = current.groupBy("surrogate").agg(F.min(F.struct("attempt", "kind", "name")).alias("first"))
        itself = known.select(F.col("name").alias("surrogate"), F.lit(True).alias("taken")).distinct()
        marked = current.join(first, "surrogate").join(itself, "surrogate", "left")
        again = (F.col("first.name") != F.col("name")) | (F.col("first.kind") != F.col("kind")) | F.col("taken").isNotNull()
        marked = written(marked.select("kind", "name", "gender", F.when(again, F.col("attempt") + 1).otherwise(F.col("attempt")).alias("attempt"), "surrogate", again.alias("again")), "surrogates-marked")
        if marked.where("again").isEmpty():
            break
        redone = with_surrogate(marked.where("again").drop("surrogate"))
        current = written(marked.where("not again").select(columns).unionByName(redone.select(columns)), "surrogates")
    return current.where("attempt > 0 or gender <> 'n'").select("kind", "name", "gender", "attempt")


def pseudonymize(docs: DataFrame, key: str = DEFAULT_KEY, broadcast: int = BROADCAST) -> DataFrame:
    """``docs`` with surrogates in ``text``, plus n_replaced.

    Every row stays, with all its columns; null text stays null with n_replaced 0; texts
    without entities, empty ones too, come back as they were; repeated rows get the same surrogates; an empty table
    stays empty.  A column n_replaced that ``docs`` already has is replaced; other names don't clash.
    """
    found = written(entities(docs), "entities")
    special = written(collisions(found, key), "redrawn")
    schema = "text string, n int"
    docs = docs.drop("n_replaced")
    if special.count() <= broadcast:
        shared = docs.sparkSession.sparkContext.broadcast({(r["kind"], r["name"]): (r["attempt"], r["gender"]) for r in special.toLocalIterator()})

        def few(text: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([replace(t, key, shared.value) if t is not None else (None, 0) for t in text], columns=["text", "n"])

        done = docs.withColumn("__surrogates", F.pandas_udf(few, schema)("text"))
    else:

        def named(text: pd.Series) -> pd.Series:
            each = ({p[:2] for x, y, k in find(t or "") for p in parts(k, t[x:y])} for t in text)
            return pd.Series([[{"kind": k, "name": n} for k, n in sorted(own)] for own in each], dtype=object)

        def many(text: pd.Series, own: pd.Series) -> pd.DataFrame:
            rows = zip(text, own, strict=True)
            return pd.DataFrame([replace(t, key, {(r["kind"], r["name"]): (r["attempt"], r["gender"]) for r in o} if o is not None else {}) if t is not None else (None, 0) for t, o in rows], columns=["text", "n"])

        # a text's own entities, by a digest of the text; hot texts count once
        at = docs.withColumn("__at", F.md5("text"))
        texts = written(at.where("text is not null").groupBy("__at").agg(F.first("text").alias("text"), F.count("*").alias("__rows")), "texts")
        each = texts.select("__at", F.explode(F.pandas_udf(named, "array<struct<kind:string,name:string>>")("text")).alias("e")).select("__at", "e.*")
        each = written(each, "mentions")
        wanted = written(each.groupBy("kind", "name").agg(F.count("*").alias("__rows")).join(special, ["kind", "name"]), "wanted")
        own = hot_join(each, wanted, ["kind", "name"], "__rows").groupBy("__at").agg(F.collect_list(F.struct("kind", "name", "attempt", "gender")).alias("__own"))
        own = written(texts.select("__at", "__rows").join(own, "__at", "left"), "own")
        joined = hot_join(at.where("text is not null"), own, ["__at"], "__rows").unionByName(at.where("text is null"), allowMissingColumns=True)
        done = joined.withColumn("__surrogates", F.pandas_udf(many, schema)("text", "__own"))
    columns = [F.col("__surrogates.text").alias("text") if c == "text" else F.col(c) for c in docs.columns]
    return done.select(*columns, F.col("__surrogates.n").alias("n_replaced"))


def op2_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"))
