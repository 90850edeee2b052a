"""Personal data: detection and keyed, type-consistent surrogates.

Numbers, addresses and secrets get surrogates by a keyed permutation of the
strings of their own format (a Feistel network over the symbols of each
character class), so two of one format can't meet.  Given names are permuted
within their gender and script; family names are built from syllables of the
script.  Over the whole corpus the distinct entities are then checked: where
two share a surrogate, or a surrogate is itself an entity of the corpus, the
later ones are drawn again until none are left.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import textkit as tk
from .common import Workspace, map_rows, pieces

#: Redrawn entities that are broadcast; more of them are joined with the texts that name them.
MAX_REDRAWN = 200_000
#: Texts that a task holds as Python strings at a time; a batch holds eight times as many.
TEXTS = 256
DEFAULT_KEY = "change-me"

# Titles by gender, given names by gender and script, syllables by script, mail providers.
TITLES = {
    "m": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Don"],
    "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Doña"],
    "n": ["Dr", "Prof", "Professor", "Doctor"],
}
GIVEN = {
    ("latin", "m"): "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Hans Peter Klaus Jürgen Stefan Pierre Jean Luc Antoine François José Carlos Miguel Pablo Javier Diego".split(),
    ("latin", "f"): "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Emily Laura Anna Ursula Monika Petra Sabine Marie Claire Sophie Camille Élodie María Carmen Lucía Isabel Elena Sofía".split(),
    ("cyrillic", "m"): "Иван Пётр Сергей Дмитрий Алексей Андрей Николай Михаил".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана".split(),
    ("greek", "m"): "Γιώργος Δημήτρης Νίκος Κώστας Γιάννης".split(),
    ("greek", "f"): "Μαρία Ελένη Κατερίνα Σοφία Αγγελική".split(),
}
SYLLABLES = {
    "latin": "ba be bo da de do fa fe fo ga go ka ke ko la le lo ma me mo na ne no pa pe po ra re ro sa se so ta te to va ve vo".split(),
    "cyrillic": "ба бе бо да де до ка ке ко ла ле ло ма ме мо на не но ра ре ро са се со та те то ва ве во".split(),
    "greek": "βα βε βο δα δε δο κα κε κο λα λε λο μα με μο να νε νο ρα ρε ρο σα σε σο τα τε το".split(),
}
PROVIDERS = {"gmail.com", "yahoo.com", "outlook.com", "hotmail.com", "icloud.com", "example.com", "example.org", "example.net"}

_GENDER = {name: (script, gender) for (script, gender), names in GIVEN.items() for name in names}
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_EMAIL = re.compile(r"(?<![\w.+%-])[\w](?:[\w.+%-]{0,62}[\w])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![A-Za-z0-9-])")
_IPV4 = re.compile(rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)")
_IPV6 = re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])")
_CARD = re.compile(r"(?<![\d-])(?:\d{4}[ -]?){3}\d{1,7}(?![\d-])|(?<![\d-])3\d{3}[ -]?\d{6}[ -]?\d{5}(?![\d-])")
_SSN = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
_PHONE = re.compile(r"(?<![\w+.-])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|\d{3}[ .-]\d{3}[ .-]\d{4})(?![\w-]|\.\d)")
_SECRET = re.compile(r"(?i)(?<![A-Za-z0-9])(?:api[_-]?key|access[_-]?key|secret[_-]?key|token|secret|password|passwd|pwd|bearer)(?:\s*[=:]\s*[\"']?|\s+)([A-Za-z0-9+/_-]{16,}={0,2}|(?<=[=:\"'])[^\s\"']{6,})")
_KEYS = re.compile(r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,})(?![A-Za-z0-9])")
_TITLE = re.compile(r"(?<!\w)(" + "|".join(t for ts in TITLES.values() for t in ts) + r")(\.? )([^\W\d_a-z][\w'’-]+(?: [^\W\d_a-z][\w'’-]+){0,2})")
_TITLE_GENDER = {t: g for g, ts in TITLES.items() for t in ts}
_NAME = re.compile(r"(?<!\w)(" + "|".join(_GENDER) + r") ([^\W\d_a-z][\w'’-]+)")
_TITLE_HINT = re.compile("|".join(sorted({f"{t}[. ]" for ts in TITLES.values() for t in ts})))
_SECRET_WORDS = ("token", "secret", "key", "passw", "pwd", "bearer", "akia", "gh", "sk-")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _iban_check(country: str, body: str) -> str:
    number = int("".join(str(int(c, 36)) for c in body + country + "00"))
    return f"{98 - number % 97:02d}"


def _script(word: str) -> str:
    c = ord(word[0])
    return "cyrillic" if 0x400 <= c < 0x530 else "greek" if 0x370 <= c < 0x400 else "latin"


def find(text: str, numbers: bool = True) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, entity) without overlaps, in text order.

    entity is the normal form that all spellings of it share: digits of
    numbers, lower-cased addresses.  numbers says whether the text has digits
    or ``@`` at all.
    """
    hits: list[tuple[int, int, str, str]] = []

    def add(a: int, b: int, kind: str, entity: str) -> None:
        if all(b <= x or a >= y for x, y, _, _ in hits):
            hits.append((a, b, kind, entity))

    if numbers:
        if "@" in text:
            for m in _EMAIL.finditer(text):
                add(m.start(), m.end(), "email", m[0].lower())
        low = text.lower()
        if any(w in low for w in _SECRET_WORDS):
            for m in _KEYS.finditer(text):
                add(m.start(), m.end(), "secret", m[0])
            for m in _SECRET.finditer(text):
                if any(c.isdigit() for c in m[1]):
                    add(m.start(1), m.end(1), "secret", m[1])
        for m in _IBAN.finditer(text):
            plain = m[0].replace(" ", "")
            if 15 <= len(plain) <= 34 and _iban_check(plain[:2], plain[4:]) == plain[2:4]:
                add(m.start(), m.end(), "iban", plain)
        for m in _CARD.finditer(text):
            plain = re.sub(r"\D", "", m[0])
            if 13 <= len(plain) <= 19 and len(set(plain)) > 1 and _luhn(plain):
                add(m.start(), m.end(), "card", plain)
        for m in _SSN.finditer(text):
            if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000":
                add(m.start(), m.end(), "ssn", m[0].replace("-", ""))
        for m in _IPV4.finditer(text):
            add(m.start(), m.end(), "ipv4", m[0])
        if ":" in text:
            for m in _IPV6.finditer(text):
                add(m.start(), m.end(), "ipv6", "".join(x.zfill(4) for x in m[0].lower().split(":")))
        for m in _PHONE.finditer(text):
            plain = ("+" if m[0][0] == "+" else "") + re.sub(r"\D", "", m[0])
            if 8 <= len(plain.lstrip("+")) <= 15:
                add(m.start(), m.end(), "phone", plain)
    if _TITLE_HINT.search(text):
        for m in _TITLE.finditer(text):
            _names(m.start(3), m[3], add)
    if any(name in text for name in _GENDER):
        for m in _NAME.finditer(text):
            _names(m.start(1), m[0], add)
    for name in sorted({(kind, entity) for _, _, kind, entity in hits if kind.startswith(("family_", "given_"))}, key=lambda x: (-len(x[1]), x)):  # other mentions, by one word
        for m in re.finditer(rf"(?<!\w){re.escape(name[1])}(?!\w)", text):
            add(m.start(), m.end(), *name)
    return sorted(hits)


def _names(start: int, words: str, add) -> None:
    """Each word of a name is an entity, so that a later mention by one word keeps its surrogate."""
    at = start
    for word in words.split(" "):
        bare = re.sub(r"['’]s$", "", word)
        if bare in _GENDER:
            script, gender = _GENDER[bare]
            add(at, at + len(bare), f"given_{gender}_{script}", bare)
        else:
            add(at, at + len(bare), f"family_{_script(bare)}", bare)
        at += len(word) + 1


class Keyed:
    """Surrogates under a secret key; attempt > 0 draws again, width adds syllables to family names."""

    def __init__(self, key: str, width: int = 4):
        self.key, self.width = hashlib.sha256(key.encode()).digest(), width
        self._cached = lru_cache(maxsize=50_000)(self._draw)

    def __reduce__(self):
        new = Keyed.__new__(Keyed)
        return _restore, (self.key, self.width)

    def number(self, *parts: object) -> int:
        return int.from_bytes(hashlib.blake2b("\x1f".join(map(str, parts)).encode(), key=self.key, digest_size=16).digest(), "big")

    def permuted(self, digits: list[int], base: int, *tweak: object) -> list[int]:
        """A keyed permutation of the strings of this length over ``base`` symbols; of one symbol, a shift."""
        n = len(digits)
        if not n:
            return []
        if n == 1:
            return [(digits[0] + self.number("one", base, *tweak)) % base]
        half = n // 2
        left, right = digits[:half], digits[half:]
        value = lambda xs: sum(x * base**i for i, x in enumerate(reversed(xs)))
        symbols = lambda v, m: [v // base ** (m - 1 - i) % base for i in range(m)]
        a, b = value(left), value(right)
        for r in range(8):
            if r % 2:
                b = (b + self.number(r, n, base, a, *tweak)) % base ** (n - half)
            else:
                a = (a + self.number(r, n, base, b, *tweak)) % base**half
        return symbols(a, half) + symbols(b, n - half)

    def by_class(self, text: str, *tweak: object) -> str:
        """Digits stay digits, and letters letters of their case and alphabet; others stay."""
        out = list(text)
        hexadecimal = re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", text) is not None and len(text) >= 16
        classes = ["0123456789abcdef" if text == text.lower() else "0123456789ABCDEF"] if hexadecimal else ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]
        shape = re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"\d", "0", text)))
        for symbols in classes:
            at = [i for i, c in enumerate(out) if c in symbols]
            for i, x in zip(at, self.permuted([symbols.index(out[i]) for i in at], len(symbols), shape if not hexadecimal else "", symbols, *tweak), strict=True):
                out[i] = symbols[x]
        return "".join(out)

    def surrogate(self, kind: str, entity: str, attempt: int = 0) -> str:
        """The normal form of the entity's surrogate."""
        return self._cached(kind, entity, attempt)

    def _draw(self, kind: str, entity: str, attempt: int) -> str:
        for again in range(64):  # none keeps its own form
            out = self._once(kind, entity, (attempt, again))
            if out != entity:
                return out
        return out

    def _once(self, kind: str, entity: str, attempt: tuple[int, int]) -> str:
        if kind == "email":
            local, _, domain = entity.partition("@")
            kept = next((p for p in PROVIDERS if domain == p or domain.endswith("." + p)), None)
            tail = kept or domain[domain.rindex(".") + 1 :]
            head = domain[: len(domain) - len(tail)]
            mixed = self.by_class(f"{local}@{head}", kind, tail, attempt)
            # Labels must not begin or end with what a label may not; letters and digits only trade places in kind.
            return mixed + tail
        if kind == "card":
            body = entity[0] + "".join(map(str, self.permuted([int(c) for c in entity[1:-1]], 10, kind, entity[0], attempt)))
            return next(body + str(d) for d in range(10) if _luhn(body + str(d)))
        if kind == "ipv4":
            value = [int(x) for x in entity.split(".")]
            return ".".join(map(str, self.permuted(value, 256, kind, attempt)))
        if kind == "phone":
            keep = 0
            if entity[0] == "+":
                keep = len(entity) - 10 if len(entity) > 11 else 2
            return entity[:keep] + "".join(map(str, self.permuted([int(c) for c in entity[keep:]], 10, kind, entity[:keep], attempt)))
        if kind == "ssn":
            for again in range(64):
                x = "".join(map(str, self.permuted([int(c) for c in entity], 10, kind, attempt, again)))
                if x[:3] not in ("000", "666") and x[0] != "9" and x[3:5] != "00" and x[5:] != "0000":
                    return x
            return x
        if kind == "iban":
            body = self.by_class(entity[4:], kind, entity[:2], attempt)
            return entity[:2] + _iban_check(entity[:2], body) + body
        if kind == "ipv6":
            return "".join("0123456789abcdef"[x] for x in self.permuted([int(c, 16) for c in entity], 16, kind, attempt))
        if kind.startswith("given_"):
            _, gender, script = kind.split("_")
            order = sorted(GIVEN[script, gender], key=lambda x: self.number("order", kind, x))
            return order[(order.index(entity) + 1) % len(order)]
        if kind.startswith("family_"):
            syllables = SYLLABLES[kind.split("_")[1]]
            n, out = self.number(kind, entity.lower(), attempt), ""
            for _ in range(self.width):
                n, x = divmod(n, len(syllables))
                out += syllables[x]
            return out.capitalize() if not entity.isupper() else out.upper()
        return self.by_class(entity, kind, attempt)

    def written(self, kind: str, said: str, new: str) -> str:
        """The surrogate in the format of the mention."""
        if kind in ("card", "ssn", "phone", "iban"):
            symbols = iter(new.lstrip("+"))
            return "".join(next(symbols) if c.isalnum() else c for c in said)
        if kind == "email":
            return "".join(x.upper() if c.isupper() else x for c, x in zip(said, new, strict=True))
        if kind == "ipv6":
            upper = said != said.lower()
            text = ":".join(new[i : i + 4] for i in range(0, 32, 4))
            return text.upper() if upper else text
        return new


def _restore(key: bytes, width: int) -> Keyed:
    out = Keyed("", width)
    out.key = key
    return out


def _found(column: pa.Array) -> Iterator[tuple[str | None, list[tuple[int, int, str, str]]]]:
    """Texts with their entities; one look at the bytes tells which texts can have numbers or addresses."""
    values = column.to_pylist()
    for c in tk.chunks(column):
        telling = ((c.data >= 48) & (c.data <= 57)) | (c.data == 64)
        count = np.concatenate([[0], np.cumsum(telling)])
        some = count[c.offsets[1:]] > count[c.offsets[:-1]]
        for k in range(c.last - c.first):
            value = values[c.first + k]
            yield value, find(value, bool(some[k])) if value else []


def _format(kind: str, entity: str) -> str:
    """Entities of one format can stand for each other: same classes of characters, and the parts that surrogates keep."""
    kept = {"card": entity[:1], "iban": entity[:2], "email": entity[entity.find("@") :], "phone": entity[: len(entity) - 10 if len(entity) > 11 else 2] if entity[:1] == "+" else ""}.get(kind, "")
    if kind in ("ipv4", "ipv6"):
        return kind
    return "\x1f".join([kind, kept, "".join("0" if c.isdigit() else "a" if c.islower() else "A" if c.isupper() else c for c in entity)])


_ENTITIES = "kind string, entity string, attempt int, surrogate string"
#: Draws before what is left trades places.
DRAWS = 20


def _rotated(left: DataFrame, known: DataFrame, keyed: Keyed) -> DataFrame:
    """(kind, entity, attempt, surrogate): the surrogate of each entity of left is the next one of its format in keyed order.

    The others' surrogates are no entities, so all stay distinct.  One that is
    alone trades places with the first other entity of its format; with none
    such it becomes a mark of its kind and its keyed number.
    """

    def formats(batches):
        for batch in batches:
            kinds, entities = (batch.column(i).to_pylist() for i in range(2))
            pairs = list(zip(kinds, entities, strict=True))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([_format(*x) for x in pairs], pa.string()), pa.array([f"{keyed.number('rotate', *x):064x}"[-32:] for x in pairs], pa.string())], names=["kind", "entity", "format", "place"])

    shaped = lambda df: df.select("kind", "entity").mapInArrow(formats, "kind string, entity string, format string, place string")
    left = shaped(left)
    sizes = left.groupBy("format").agg(F.count("*").alias("n"), F.first("entity").alias("alone"))
    lone = sizes.filter("n = 1").select("format", "alone")
    partners = shaped(known).join(lone, "format").filter("entity <> alone").groupBy("format").agg(F.min(F.struct("place", "kind", "entity")).alias("x"))
    both = left.unionByName(partners.select("x.kind", "x.entity", "format", "x.place"))
    by = Window.partitionBy("format")
    ordered = both.withColumn("next", F.lead("entity").over(by.orderBy("place", "entity"))).withColumn("first", F.first("entity").over(by.orderBy("place", "entity"))).withColumn("size", F.count("*").over(by))
    mark = F.concat(F.lit("["), "kind", F.lit("-"), F.substring("place", 25, 8), F.lit("]"))
    return ordered.select("kind", "entity", F.lit(0).alias("attempt"), F.when(F.col("size") == 1, mark).otherwise(F.coalesce("next", "first")).alias("surrogate"))


def redrawn(docs: DataFrame, keyed: Keyed, work: Workspace, text: str = "text") -> tuple[DataFrame, Keyed]:
    """(kind, entity, attempt, surrogate) of entities whose first draw would not be distinct: the draw that is, or the surrogate itself; and the key with the width it took.

    Family names get more syllables only if some are left after ``DRAWS`` draws.
    """

    def distinct(batches):
        for batch in batches:
            seen = {(kind, entity) for piece in pieces([batch], TEXTS) for _, hits in _found(piece.column(0)) for _, _, kind, entity in hits}
            pairs = sorted(seen)
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.string()) for i in (0, 1)], names=["kind", "entity"])

    names = docs.select(F.col(text).cast("string")).mapInArrow(distinct, "kind string, entity string")
    known = work.save(names.groupBy("kind", "entity").agg(F.lit(0).alias("attempt")), "entities")
    while True:
        def draw(batches, keyed=keyed):
            for batch in batches:
                kinds, entities, attempts = (batch.column(i).to_pylist() for i in range(3))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([keyed.surrogate(*x) for x in zip(kinds, entities, attempts, strict=True)], pa.string())], names=["kind", "entity", "attempt", "surrogate"])

        step, now = 0, known
        while True:
            drawn = work.save(now.mapInArrow(draw, _ENTITIES), f"drawn{keyed.width}_{step}")
            # The least entity keeps a shared surrogate, unless the surrogate is an entity itself; given names only trade places.
            first = drawn.groupBy("kind", "surrogate").agg(F.min("entity").alias("first"), F.count("*").alias("n"))
            shared = first.filter("n > 1").drop("n")
            clash = drawn.join(shared, ["kind", "surrogate"]).filter("entity <> first").select("kind", "entity")
            real = drawn.filter(~F.col("kind").startswith("given_")).join(known.select("kind", F.col("entity").alias("surrogate")), ["kind", "surrogate"], "left_semi").select("kind", "entity")
            bad = work.save(clash.unionAll(real).distinct(), f"bad{keyed.width}_{step}")
            if bad.isEmpty() or step >= DRAWS:
                break
            marked = bad.withColumn("up", F.lit(1))
            now = drawn.drop("surrogate").join(marked, ["kind", "entity"], "left").select("kind", "entity", (F.col("attempt") + F.coalesce("up", F.lit(0))).alias("attempt"))
            step += 1
        if bad.filter(F.col("kind").startswith("family_")).isEmpty():
            break
        keyed = _restore(keyed.key, keyed.width + 1)
    again = drawn.filter("attempt > 0").select("kind", "entity", "attempt", F.lit(None).cast("string").alias("surrogate"))
    if not bad.isEmpty():
        turned = work.save(_rotated(bad, known, keyed), "rotated")
        again = again.join(turned.select("kind", "entity"), ["kind", "entity"], "left_anti").unionByName(turned)
    changes = work.save(again, "changes")
    work.drop(*(work.saved - {"changes"}))
    return changes, keyed


def replace(docs: DataFrame, key: str = DEFAULT_KEY, text: str = "text", most: int = MAX_REDRAWN) -> DataFrame:
    """docs with surrogates in ``text`` and the counts n_entities and kinds.

    An entity has one surrogate wherever it occurs, in any spelling; two
    entities never share one.  kinds maps each kind to its mentions.  Null and
    empty texts stay as they are with no entities.  Rows are neither moved nor
    dropped; columns named n_entities or kinds are replaced.  Up to ``most``
    entities that were drawn again are broadcast; beyond, texts are joined with
    their own, and the result is the same.
    """
    work = Workspace(docs.sparkSession, "pii")
    changes, keyed = redrawn(docs, Keyed(key), work, text)
    fields = [(text, T.StringType()), ("n_entities", T.LongType()), ("kinds", T.MapType(T.StringType(), T.LongType()))]

    def rewritten(column, redraws):
        """redraws: for each text what is drawn again of its entities."""
        texts, counts, kinds = [], [], []
        for (value, hits), redraw in zip(_found(column), redraws, strict=False):
            if hits:
                pieces, done, tally = [], 0, {}
                for a, b, kind, entity in hits:
                    own, said = redraw.get((kind, entity), 0), value[a:b]
                    new = own if isinstance(own, str) else keyed.surrogate(kind, entity, own)
                    mark = isinstance(own, str) and own.startswith("[")
                    pieces += [value[done:a], new if mark else keyed.written(kind, said, new)]
                    done = b
                    tally[kind] = tally.get(kind, 0) + 1
                texts.append("".join([*pieces, value[done:]]))
                kinds.append(sorted(tally.items()))
            else:
                texts.append(value)
                kinds.append([])
            counts.append(len(hits))
        return [pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(kinds, pa.map_(pa.string(), pa.int64()))]

    if changes.count() <= most:
        shared = docs.sparkSession.sparkContext.broadcast({(r.kind, r.entity): r.attempt if r.surrogate is None else r.surrogate for r in changes.collect()})
        return map_rows(docs, [text], fields, lambda: lambda column: rewritten(column, repeat(shared.value)), TEXTS)

    # Too many to send everywhere: each text meets those of its own entities.
    rows = work.save(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")

    def mentions(batches):
        for batch in pieces(batches, TEXTS):
            ids, found = [], []
            for row, (_, hits) in zip(batch.column(0).to_pylist(), _found(batch.column(1)), strict=True):
                own = sorted({(kind, entity) for _, _, kind, entity in hits})
                ids += [row] * len(own)
                found += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *[pa.array([p[i] for p in found], pa.string()) for i in (0, 1)]], names=["__row", "kind", "entity"])

    named = rows.select("__row", F.col(text).cast("string")).mapInArrow(mentions, "__row long, kind string, entity string")
    own = named.join(changes, ["kind", "entity"]).groupBy("__row").agg(F.collect_list(F.struct("kind", "entity", "attempt", "surrogate")).alias("__changes"))
    joined = rows.join(own, "__row", "left").drop("__row")

    def make():
        def step(column, drawn):
            return rewritten(column, ({(r["kind"], r["entity"]): r["attempt"] if r["surrogate"] is None else r["surrogate"] for r in x or ()} for x in drawn.to_pylist()))

        return step

    return map_rows(joined, [text, "__changes"], fields, make, TEXTS).drop("__changes")


def op2(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return replace(docs).select("doc_id", "n_entities", F.to_json("kinds").alias("kinds"), "text")
