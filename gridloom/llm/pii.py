"""Personal data and secrets: detected entities give way to keyed surrogates of the same type and format.

Every surrogate comes from a keyed permutation of all values that share the entity's type and shape, so two different
entities never get one surrogate and one entity gets the same surrogate wherever it occurs, without a table of entities
and without a shuffle. No surrogate is its own original. surrogate_collisions() looks a corpus over and reports; it is a
table of its own that nothing waits for, because the permutations leave nothing to find.
"""

from __future__ import annotations

import hmac
import ipaddress
import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import lean, small_batches, table

#: Key of the registered query; a real run passes its own.
KEY = b"gridloom demonstration key"
#: Characters of a value that are permuted together. A longer value goes in parts, each under what stands before it.
PART = 48
_VOWELS = "aeiou"


@cache
def _alphabet(c: str, sounds: bool = False) -> str:
    """The letters or digits that may stand for a lower-case letter or digit: those of its script, case and block of 256
    code points, ASCII apart from the rest; with sounds, ASCII vowels and consonants apart. Empty for other characters."""
    if c.isdecimal():
        return "".join(chr(ord(c) - unicodedata.decimal(c) + k) for k in range(10))
    kind = unicodedata.category(c)
    if kind not in ("Ll", "Lo") or (kind == "Ll" and not _cased(c)):
        return ""
    if c.isascii():
        letters = "abcdefghijklmnopqrstuvwxyz"
        return "".join(x for x in letters if (x in _VOWELS) == (c in _VOWELS)) if sounds else letters
    script, low = unicodedata.name(c, "?").split()[0], ord(c) & ~0xFF
    block = (chr(k) for k in range(low, low + 256) if k > 0x7F)
    return "".join(x for x in block if unicodedata.category(x) == kind and unicodedata.name(x, "").split()[:1] == [script] and (kind == "Lo" or _cased(x)))


def _cased(c: str) -> bool:
    """Whether a lower-case letter has one upper-case letter, and that none but this."""
    return len(c.upper()) == 1 and c.upper() != c and c.upper().lower() == c


#: Given names by gender and script; a listed name is replaced by another of its list.
_GIVEN = {
    ("f", "latin"): "Alice Anna Barbara Camille Carmen Claire Elena Emma Eva Helen Ines Isabel Julia Karen Laura Linda Lucia Maria Marie Martha Nina Patricia Sarah Sophie".split(),
    ("m", "latin"): "Adam Andrew Carlos Charles Daniel David Edward Felix George Hans Henri James John Jorge Karl Luis Martin Michael Paul Peter Robert Thomas Victor William".split(),
    ("f", "cyrillic"): "Анна Вера Галина Дарья Елена Ирина Мария Нина Ольга Светлана Татьяна Юлия".split(),
    ("m", "cyrillic"): "Алексей Андрей Борис Виктор Дмитрий Иван Михаил Николай Олег Павел Сергей Юрий".split(),
    ("f", "greek"): "Αγγελική Ελένη Ιωάννα Κατερίνα Μαρία Σοφία".split(),
    ("m", "greek"): "Ανδρέας Γιώργος Δημήτρης Κώστας Νίκος Πέτρος".split(),
}
_SURNAMES = {
    "latin": "Anderson Baker Brown Carter Clark Davis Evans Fernandez Fischer Garcia Harris Johnson Jones Klein Lopez Martinez Miller Moore Moreau Meyer Rossi Schmidt Smith Taylor Walker Weber Wilson Wright".split(),
    "cyrillic": "Васильев Волков Зайцев Иванов Козлов Лебедев Морозов Новиков Павлов Петров Смирнов Соколов".split(),
}
_GIVEN_NAMES = {name for names in _GIVEN.values() for name in names}
_LIST_OF = {name: names for names in (*_GIVEN.values(), *_SURNAMES.values()) for name in names}
_TITLES = {
    "m": "Mr Mister Sir Herr Monsieur Señor Signor г-н Господин κύριος Κύριος".split(),
    "f": "Mrs Ms Miss Madam Frau Madame Mme Mlle Señora Señorita Sra Srta Signora г-жа Госпожа κυρία Κυρία".split(),
    "": "Dr Prof".split(),
}


class Permutation:
    """Keyed permutations of 0 .. size-1 without fixed points, one for each (size, tweak): a secret order, one step on."""

    def __init__(self, key: bytes):
        self.key = blake2b(key, digest_size=32).digest()

    def _round(self, tweak: bytes, k: int, value: int, bits: int) -> int:
        size = (bits + 7) // 8
        out = b"".join(blake2b(value.to_bytes(size, "big") + bytes([k, i]) + tweak, key=self.key, digest_size=64).digest() for i in range(-(-size // 64)))
        return int.from_bytes(out[:size], "big") & ((1 << bits) - 1)

    def _shuffled(self, value: int, size: int, tweak: bytes, back: bool) -> int:
        """A Feistel network over the next power of two, walked until the value is below size; back is its inverse."""
        half = ((size - 1).bit_length() + 1) // 2
        mask = (1 << half) - 1
        while True:
            left, right = value >> half, value & mask
            for k in range(7, -1, -1) if back else range(8):
                left, right = (right ^ self._round(tweak, k, left, half), left) if back else (right, left ^ self._round(tweak, k, right, half))
            value = left << half | right
            if value < size:
                return value

    def __call__(self, value: int, size: int, tweak: bytes, valid: Callable[[int], bool] = lambda _: True) -> int:
        """The image of value. With `valid`, a permutation of the valid values; a value that is valid alone is its own."""
        if size < 2:
            return value
        at = self._shuffled(value, size, tweak, back=True)
        while True:
            at = (at + 1) % size
            image = self._shuffled(at, size, tweak, back=False)
            if image == value or valid(image):
                return image


def _mixed(values: list[int], sizes: list[int]) -> tuple[int, int]:
    n, total = 0, 1
    for v, s in zip(values, sizes, strict=True):
        n, total = n * s + v, total * s
    return n, total


def _unmixed(n: int, sizes: list[int]) -> list[int]:
    out = []
    for s in reversed(sizes):
        n, v = divmod(n, s)
        out.append(v)
    return out[::-1]


def luhn(digits: str) -> bool:
    return sum(int(c) if k % 2 == 0 else (int(c) * 2 - 1) % 9 + 1 if c != "0" else 0 for k, c in enumerate(reversed(digits))) % 10 == 0


def iban(text: str) -> bool:
    moved = text[4:] + text[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


@dataclass(frozen=True)
class Entity:
    start: int
    end: int
    kind: str
    gender: str = ""


#: Vowel signs and other marks, which belong to the letter before them but aren't word characters, for a character class.
_MARKS = "".join(chr(k) for k in range(0x300, 0x10000) if unicodedata.category(chr(k)) in ("Mn", "Mc"))
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_NUMBERS = re.compile(r"[+(\d]")  # where a number may begin; the patterns below decide
_AT_NUMBER = [
    ("ip", re.compile(rf"{_OCTET}(?:\.{_OCTET}){{3}}(?![\w]|\.\d)")),
    ("ssn", re.compile(r"\d{3}-\d{2}-\d{4}(?![\w-])")),
    ("phone", re.compile(r"\+\d{1,3}(?:[ .\-|]{0,3}\(\d{1,4}\))?(?:[ .\-]?\d{2,4}){2,5}(?![\w])|\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?![\w])|\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])")),
    ("card", re.compile(r"\d(?:[ -]?\d){12,18}(?![\w-])")),
]
_EMAIL_LOCAL, _EMAIL_DOMAIN = re.compile(r"[\w.+%'-]{1,64}\Z"), re.compile(r"[^\W_](?:[\w-]*[^\W_])?(?:\.[^\W_](?:[\w-]*[^\W_])?)+")
_IBAN = re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30}\b")
_KEYWORDED = re.compile(r"(?:token|secret|passw(?:or)?d|passwd|api[ _-]?key|access[ _-]?key|credential|bearer|private[ _-]?key)['\"]?\W{0,4}?[:=]\W{0,6}?([\w\-/+=.~]{8,})", re.I)
_PREFIXED = re.compile(r"\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9_-]{20,}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,})")
_LONG_HEX = re.compile(r"\b(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})\b")
_PEM = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----(.+?)-----END", re.S)
_NAME_WORD = rf"[^\W\d_a-zà-ÿα-ωа-я](?:[^\W\d_]|[{_MARKS}])+(?:[-'’](?:[^\W\d_]|[{_MARKS}])+)*"
_TITLE = f"(?:{'|'.join(t for ts in _TITLES.values() for t in ts)})"
_NAMED = re.compile(rf"\b({_TITLE})\.?[  ]((?!{_TITLE}\b){_NAME_WORD}(?:[  ](?!{_TITLE}\b){_NAME_WORD}){{0,2}})")
_LISTED = re.compile(rf"\b({'|'.join(sorted(_GIVEN_NAMES, key=len, reverse=True))})((?:[  ]{_NAME_WORD}){{1,2}})(?!\w)")
_WORD = re.compile(rf"(?<!\w){_NAME_WORD}(?!\w)")
_GENDER_OF = {name: gender for (gender, _), names in _GIVEN.items() for name in names}
_IPV6 = re.compile(r"(?<![\w:.])(?=[0-9A-Fa-f]{0,4}:)[0-9A-Fa-f:]{2,45}(?![\w:]|\.\d)")
_GENDER = {t: g for g, ts in _TITLES.items() for t in ts}


def _is_ipv6(text: str) -> bool:
    """An address that ipaddress accepts, with a digit; what begins with :: also needs a second group, or to be ::1, since
    programs write ::2 and ::add for other things."""
    try:
        return bool(ipaddress.IPv6Address(text)) and any(c.isdigit() for c in text) and (not text.startswith("::") or text == "::1" or text.count(":") > 2)
    except ValueError:
        return False


def _secret(text: str) -> bool:
    """Whether a find has a letter or digit that others can stand for; lines to fill in and rules have none."""
    return any(len(_alphabet(x)) > 1 for c in text if len(x := c.lower()) == 1)


def detect(text: str) -> list[Entity]:
    """Entities of a text, in order, none overlapping another; of overlapping finds the earlier kind in this list stays:
    e-mail addresses, IBANs, private keys and secrets, IP addresses of both versions, national numbers, telephone and card
    numbers, names after a title or after a listed given name, and all mentions of the same names in the text."""
    found: list[Entity] = []
    at = text.find("@")
    while at >= 0:
        local, domain = _EMAIL_LOCAL.search(text, max(0, at - 64), at), _EMAIL_DOMAIN.match(text, at + 1)
        if local and domain:
            found.append(Entity(local.start(), domain.end(), "email"))
        at = text.find("@", at + 1)
    digits = [m.start() for m in _NUMBERS.finditer(text)]
    if digits:
        found += [Entity(m.start(), m.end(), "iban") for m in _IBAN.finditer(text) if iban(m[0].replace(" ", ""))]
    if "-----BEGIN" in text:
        found += [Entity(*m.span(1), "secret") for m in _PEM.finditer(text) if _secret(m[1])]
    if "=" in text or ":" in text:
        found += [Entity(*m.span(1), "secret") for m in _KEYWORDED.finditer(text) if (re.search(r"\d", m[1]) or len(m[1]) >= 20) and _secret(m[1])]
    if digits or "AKIA" in text or "-" in text or "_" in text:  # no other prefixed secret is without these
        found += [Entity(*m.span(), "secret") for m in _PREFIXED.finditer(text)]
    if digits:
        found += [Entity(*m.span(), "secret") for m in _LONG_HEX.finditer(text) if re.search("[a-fA-F]", m[0]) and re.search(r"\d", m[0])]
    end = 0
    for at in digits:
        before = text[at - 1] if at else " "
        if at < end or before.isalnum() or before == "_" or (before == "." and at > 1 and text[at - 2].isdigit()):
            continue
        for kind, pattern in _AT_NUMBER:
            if m := pattern.match(text, at):
                found.append(Entity(at, m.end(), kind))
                end = m.end()
                break
    if "::" in text or text.count(":") > 6:
        found += [Entity(*m.span(), "ipv6") for m in _IPV6.finditer(text) if _is_ipv6(m[0])]
    names: dict[str, str] = {}
    for m in _LISTED.finditer(text):
        for w in re.finditer(_NAME_WORD, m[0]):
            found.append(Entity(m.start() + w.start(), m.start() + w.end(), "name", _GENDER_OF[m[1]]))
            names.setdefault(w[0], _GENDER_OF[m[1]])
    for m in _NAMED.finditer(text):
        gender = _GENDER[m[1]]
        for w in re.finditer(_NAME_WORD, m[2]):
            found.append(Entity(m.start(2) + w.start(), m.start(2) + w.end(), "name", gender))
            names.setdefault(w[0], gender)
    if names:
        for w in _WORD.finditer(text):
            if w[0] in names:
                found.append(Entity(*w.span(), "name", names[w[0]]))
            elif re.search("[-'’]", w[0]):
                found += [Entity(w.start() + part.start(), w.start() + part.end(), "name", names[part[0]]) for part in re.finditer("[^-'’]+", w[0]) if part[0] in names]
    out: list[Entity] = []
    taken = bytearray(len(text))
    for e in found:  # in the order of the kinds
        if not any(taken[e.start : e.end]):
            taken[e.start : e.end] = b"\1" * (e.end - e.start)
            out.append(e)
    return sorted(out, key=lambda e: e.start)


class Surrogates:
    """Surrogates under one key."""

    def __init__(self, key: bytes):
        self.permute = Permutation(key)

    def _letters(self, text: str, kind: str, keep: Callable[[int, str], bool] = lambda i, c: False, taken: Callable[[str], bool] = lambda s: False, sounds: bool = False) -> str:
        """Letters and digits replaced within their alphabets, PART of them at a time; case and everything else stay."""
        low = [x if len(x := c.lower()) == 1 else c for c in text]
        sets = [_alphabet(c, sounds) for c in low]
        places = [i for i, c in enumerate(low) if len(sets[i]) > 1 and not keep(i, c)]
        chosen, out = set(places), list(text)
        shape = "".join(chr(0x100 + ord(sets[i][0])) if i in chosen else c for i, c in enumerate(low))
        tweak = blake2b(f"{kind}|{shape}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
        for k in range(0, len(places), PART):
            part = places[k : k + PART]
            sizes = [len(sets[i]) for i in part]
            n, size = _mixed([sets[i].index(low[i]) for i in part], sizes)

            def built(n: int, part=part, sizes=sizes) -> list[str]:
                new = (sets[i][v] for i, v in zip(part, _unmixed(n, sizes), strict=True))
                return [c.upper() if text[i] != low[i] else c for i, c in zip(part, new, strict=True)]

            def free(m: int, part=part, built=built) -> bool:
                whole = list(text)
                for i, c in zip(part, built(m), strict=True):
                    whole[i] = c
                return not taken("".join(whole))

            for i, c in zip(part, built(self.permute(n, size, tweak, free if len(places) <= PART else lambda _: True)), strict=True):
                out[i] = c
            tweak = blake2b("".join(low[i] for i in part).encode(), key=tweak, digest_size=16).digest()
        return "".join(out)

    def _digits(self, digits: str, kind: str, valid: Callable[[str], bool] = lambda s: True, first: bool = True) -> str:
        """A number of the same length; a leading zero stays one, and with first=False the first digit stays."""
        fixed = digits[:1] if digits[:1] == "0" or not first else ""
        rest = digits[len(fixed) :]
        low = 0 if fixed else 10 ** (len(rest) - 1)
        size = 10 ** len(rest) - low
        tweak = f"{kind}|{len(digits)}|{fixed}|{valid(digits)}".encode()
        want = valid(digits)
        build = lambda n: fixed + str(n + low).zfill(len(rest))
        return build(self.permute(int(rest or 0) - low, size, tweak, lambda n: valid(build(n)) == want)) if rest else digits

    def of(self, value: str, kind: str, gender: str = "") -> str:
        if kind == "email":
            local, _, domain = value.rpartition("@")
            host, dot, top = domain.rpartition(".")
            return f"{self._letters(local, 'local')}@{self._letters(host, 'host')}{dot}{top}"
        if kind == "ip":
            return self._address(value)
        if kind == "ipv6":  # the first group tells the kind of address and stays
            first = value.index(":")
            digits = [i for i in range(first, len(value)) if value[i] in "0123456789abcdefABCDEF"]
            n = self.permute(int("".join(value[i] for i in digits) or "0", 16), 16 ** len(digits), f"ipv6|{''.join(c if c == ':' else 'x' for c in value)}|{value[:first]}".encode())
            new = dict(zip(digits, format(n, "x").zfill(len(digits)), strict=True)) if digits else {}
            return "".join((new[i].upper() if any(c in "ABCDEF" for c in value) else new[i]) if i in new else c for i, c in enumerate(value))
        if kind == "iban":
            bare = value.replace(" ", "")
            body = self._letters(bare[4:], "iban" + bare[:2])
            check = 98 - int("".join(str(int(c, 36)) for c in body + bare[:2] + "00")) % 97
            new = iter(f"{bare[:2]}{check:02d}{body}")
            return "".join(c if c == " " else next(new) for c in value)
        if kind in ("phone", "ssn", "card"):
            code = m[0] if kind == "phone" and (m := re.match(r"\+\d{1,3}(?!\d)|\+1(?=\d{10}\b)", value)) else ""
            rest = value[len(code) :]
            digits = re.sub(r"\D", "", rest)
            new = iter(self._digits(digits, kind, luhn, first=False) if kind == "card" else self._digits(digits, kind))
            return code + "".join(next(new) if c.isdigit() else c for c in rest)
        if kind == "name":
            return self._name(value, gender)
        if re.fullmatch("[0-9a-f]+|[0-9A-F]+", value) and not value.isdigit():
            hexed = lambda n: format(n, "X" if value.isupper() else "x").zfill(len(value))
            return hexed(self.permute(int(value, 16), 16 ** len(value), b"hex%d" % len(value), lambda n: not hexed(n).isdigit()))
        prefix = len(m[0]) if (m := re.match("AKIA|gh[pousr]_|xox[abprs]-|sk-|eyJ", value)) else 0
        hexadecimal = lambda t: bool(re.fullmatch("[0-9a-f]+|[0-9A-F]+", t)) and not t.isdigit()
        return self._letters(value, "secret", keep=lambda i, c: i < prefix, taken=hexadecimal)

    def _address(self, value: str) -> str:
        address = int(ipaddress.IPv4Address(value))
        for network, host_bits in ((0x0A << 24, 24), (0xC0A8 << 16, 16), (0xAC1 << 20, 20), (0x7F << 24, 24)):
            if address >> host_bits == network >> host_bits:
                low = address & ((1 << host_bits) - 1)
                return str(ipaddress.IPv4Address(network | self.permute(low, 1 << host_bits, b"ip%d" % network)))
        public = lambda n: n >> 24 not in (10, 127) and n >> 16 != 0xC0A8 and n >> 20 != 0xAC1 and (n >> 24 < 224) == (address >> 24 < 224) and (n >> 24 == 0) == (address >> 24 == 0)
        return str(ipaddress.IPv4Address(self.permute(address, 1 << 32, b"ip", public)))

    def _name(self, value: str, gender: str) -> str:
        low = value.lower()
        style = str.upper if value.isupper() else str
        listed = value if value in _LIST_OF else low.capitalize()
        if listed in _LIST_OF:
            names = _LIST_OF[listed]
            return style(names[self.permute(names.index(listed), len(names), repr(names[:2]).encode())])
        taken = lambda s: s.lower().capitalize() in _LIST_OF
        # the last letter stays, as it often tells the gender of a name, unless the name has no other letter to change
        new = self._letters(value, "name", keep=lambda i, c: i == len(low) - 1, taken=taken, sounds=True)
        return new if new != value else self._letters(value, "name", taken=taken)


def replace(text: str, surrogates: Surrogates) -> tuple[str, list[Entity]]:
    found = detect(text)
    out, at = [], 0
    for e in found:
        out += text[at : e.start], surrogates.of(text[e.start : e.end], e.kind, e.gender)
        at = e.end
    return "".join(out) + text[at:], found


def pseudonymise(docs: DataFrame, key: bytes = KEY, text_col: str = "text") -> DataFrame:
    """docs with surrogates in text_col, and n_entities and kinds (such as 'email:2,ip:1', sorted) beside its columns.

    A null text stays null with 0 entities; empty texts stay empty. Whole texts are searched, one pass, no shuffle. No text
    stops the job: what has no letter or digit to change, such as a line to fill in, is no entity.
    Repeated rows are changed alike. Columns of docs named n_entities or kinds give way to the new ones.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.drop("n_entities", "kinds")
    place = rows.columns.index(text_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        surrogates = Surrogates(key)
        for b in batches:
            texts, counts, kinds = [], [], []
            for t in b.column(place).to_pylist():
                new, found = replace(t, surrogates) if t else (t, [])
                tally: dict[str, int] = {}
                for e in found:
                    tally[e.kind] = tally.get(e.kind, 0) + 1
                texts.append(new)
                counts.append(len(found))
                kinds.append(",".join(f"{k}:{n}" for k, n in sorted(tally.items())))
            columns = [*b.columns[:place], pa.array(texts, pa.string()), *b.columns[place + 1 :]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(kinds, pa.string())], [*b.schema.names, "n_entities", "kinds"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(lean(scan), f"{schema}, n_entities long, kinds string")


def entities(docs: DataFrame, key: bytes = KEY, text_col: str = "text") -> DataFrame:
    """(kind, value, surrogate) of every entity that occurs; values as written."""
    small_batches(docs.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        surrogates = Surrogates(key)
        for b in batches:
            rows = {(e.kind, v, surrogates.of(v, e.kind, e.gender)) for t in b.column(0).to_pylist() if t for e in detect(t) for v in [t[e.start : e.end]]}
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(3)], ["kind", "value", "surrogate"])

    return docs.select(text_col).mapInArrow(lean(scan), "kind string, value string, surrogate string")


def surrogate_collisions(docs: DataFrame, key: bytes = KEY, text_col: str = "text") -> DataFrame:
    """(kind, surrogate) that stand for more than one value, case aside, or for themselves: a report to run beside
    pseudonymise(). The permutations leave none; one of a single value that nothing else shares the shape of would show."""
    found = entities(docs, key, text_col).groupBy("kind", "surrogate").agg(F.min(F.lower("value")).alias("a"), F.max(F.lower("value")).alias("b"))
    return found.where(F.expr("a <> b") | (F.col("a") == F.lower("surrogate"))).select("kind", "surrogate")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op5_pii": op5_pii}
SQL: dict[str, str] = {}
