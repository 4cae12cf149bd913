"""PII: keyed surrogates that keep type, format, script and gender.

Every entity is rewritten by a keyed bijection on the values of its own format. A
Feistel network over the integers below the format's size puts them on one ring, and
a value goes to the next on the ring that is of its class (a valid checksum stays
valid, a public address public). So equal entities get equal surrogates anywhere
(coreference), different ones differ, and none stays as it is unless it is alone in
its class. Names go word by word, wherever a word stands, so that mentions of one
person keep their common words; words keep script, case and, where tables say so, the pattern of vowels.
Names are found after a title, or from a listed given name on, and again, whole or by a word, anywhere in the same text.
Listed given names go to listed ones of their gender; another given name after a
title that states a gender gets a listed one of that gender before its own surrogate,
with a hyphen, so that it is linked to mentions without gender. Texts are rewritten and stored once; a
distributed check over the stored entities confirms that no two values share a surrogate, and
texts are rewritten under another tweak of the key if any do.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import ipaddress
import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stage, unused

GIVEN = {
    ("f", "latin"): "Alice Amelia Astrid Beatriz Carla Chloe Clara Diana Elena Elise Emma Frieda Greta Hanna Helena Ines Irene Julia Karin Laura Lena Lucia Maria Marta Nadia Nina Olivia Paula Rosa Sara Silvia Sofia Tanja Ursula Vera".split(),
    ("m", "latin"): "Adrian Albert Andres Anton Bruno Carlos David Diego Emil Erik Felix Georg Hugo Ivan Jakob Jean Jonas Karl Leo Louis Lukas Marc Martin Mateo Nico Oscar Pablo Paul Peter Robert Simon Thomas Victor Walter Yann".split(),
    ("f", "cyrillic"): "Анна Вера Дарья Елена Ирина Мария Нина Ольга Полина Софья".split(),
    ("m", "cyrillic"): "Антон Борис Виктор Денис Егор Иван Кирилл Олег Павел Роман".split(),
}
GENDER = {n: g for (g, _), names in GIVEN.items() for n in names}
TITLES = {
    "f": "Mrs Ms Miss Madam Lady Frau Fräulein Mme Madame Mlle Mademoiselle Sra Srta Señora Señorita Doctora Professorin Г-жа".split(),
    "m": "Mr Mister Sir Lord Herr Herrn Monsieur Sr Señor Г-н".split(),
    "": "Dr Prof Doctor Professor Doktor Docteur Professeur Profesor Reverend Rev Captain Capt Lieutenant Sergeant Sgt Colonel Judge".split(),
}
#: As written and in capitals.
TITLE_GENDER = {w: g for g, ts in TITLES.items() for t in ts for w in (t, t.upper())}
#: Sets of letters that stand for each other, lower case: vowels and consonants of each script.
LETTERS = ["aeiou", "bcdfghjklmnpqrstvwxyz", "áéíóúàèìòùâêîôûäëïöü", "çñß", "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρστφχψ"]
CLASS = {c: k for k, s in enumerate(LETTERS) for c in s}
NAME = r"(?:[^\W\d_]{2,}|[^\W\d_](?=['’-][^\W\d_]))(?:-[^\W\d_]+|['’](?!s\b)[^\W\d_]+)*"
TITLE = re.compile(r"\b(" + "|".join(sorted(TITLE_GENDER, key=len, reverse=True)) + r")(?:\.\s{0,2}|\s{1,2})")
#: A word of a name, an initial or a letter alone; what may stand between two.
PART, GAP, TOKEN = re.compile(rf"{NAME}|[^\W\d_]\.|[^\W\d_](?=[  ])"), re.compile("[  ]{1,2}"), re.compile(rf"{NAME}|[^\W\d_]")
#: Chinese names: fixed values, the most frequent family names and the titles that follow a name; after another title a name has up to three characters.
FAMILIES, HAN_TITLES = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何林高梁郑罗宋谢唐韩曹许邓冯", {"先生": "m", "女士": "f", "小姐": "f", "教授": "", "博士": "", "医生": ""}
HAN = re.compile("[\u4e00-\u9fff]{1,3}")
HAN_TITLED = re.compile(f"(?P<v>[{FAMILIES}][\u4e00-\u9fff]{{0,2}}?)(?P<title>{'|'.join(HAN_TITLES)})")
#: A capitalised word; if it is a listed given name and a further one follows, they are a name without a title.
LISTED = re.compile(r"[A-ZА-Я][^\W\d_]+(?=[ \u00a0-])")
#: Small words inside names; they stay as they are.
PARTICLES = frozenset("von van vom zu zur zum der den dem de del della di da do dos das du la le les el al bin ibn ben ter ten te y e und".split())
JOINED = re.compile(r"(?:[dl]['’]|(?:al|el|ben|bin)-)(?=[^\W\d_])(?![a-zà-ÿ])")
PATTERNS = [
    ("email", re.compile(r"@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}")),  # from the sign on; the part before is read backwards
    ("secret", re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![0-9A-Za-z])")),
    ("secret", re.compile(r"(?<![0-9A-Za-z])(?:AKIA[0-9A-Z]{16}|AIza[0-9A-Za-z_-]{35}|gh[oprsu]_[0-9A-Za-z]{36}|xox[abprs]-[0-9A-Za-z-]{10,}|eyJ[0-9A-Za-z_-]{8,}\.eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,})(?![0-9A-Za-z])")),
    ("iban", re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])")),
    ("card", re.compile(r"(?<![\d.])\d{4}([ -])\d{4}\1\d{4}\1\d{4}\1\d{3}(?!\d)")),  # 16 digits as they are, other lengths by their checksum
    ("card", re.compile(r"(?<![\d.])\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}(?!\d)")),
    ("card", re.compile(r"(?<![\w.])(?:3[47]\d\d[ -]?\d{6}[ -]?\d{5}|3[0689]\d\d[ -]?\d{6}[ -]?\d{4}|[456]\d{12}|[3-6]\d{16,18})(?![\w]|\.\d)")),
    ("ssn", re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])")),
    ("ip", re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\d]|\.\d)")),
    ("ip", re.compile(r":[0-9A-Fa-f]{0,4}:")),  # from the first two colons on, read both ways
    ("phone", re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)")),
    ("phone", re.compile(r"(?<![\w+.,/-])(?:1[ .-])?[2-9]\d\d([ .-])\d{3}\1\d{4}(?![\w/-]|[.,]\d)")),
    ("phone", re.compile(r"(?<![\w+.,/-])0(?:\d[ /-]\d{7,8}|\d{2,4}[ /-]\d{5,8}|\d{1,4}[ -]\d{3,4}[ -]\d{3,4}|\d{2,4}[ /-]\d{2,4}(?:[ -]\d\d){2,3}|\d([ .-])\d\d(?:\1\d\d){3})(?![\w/-]|[.,]\d)")),
    # numbers that only the word before them tells; the value is the group
    ("phone", re.compile(r"(?i:\b(?:phone|tel|telephone|call|mobile|cell|fax|telefon|handy|téléphone|teléfono)\b)\.?(?: (?:no|number|nr)\.?)?(?::? ?| at | on )(?P<v>\d{8,11})(?![\w-]|[.,]\d)")),
    ("birth", re.compile(r"(?i:\b(?:born(?: on)?|dob|date of birth|birth ?date|geboren am|geb|geburtsdatum|née? le|nacid[oa] el)\b)[.:]?:? ?(?P<v>\d{4}([./-])\d\d?\2\d\d?|\d\d?([./-])\d\d?\3\d{4})(?!\d)")),
    ("passport", re.compile(r"(?i:\b(?:passport|reisepass|passeport|pasaporte)\b)(?i: (?:no|number|nr|n°)\.?)?[.:]?:? ?(?P<v>[A-Z]{0,2}\d{6,9})(?!\w)")),
    ("name", TITLE),  # from the title on; the words after it are read one by one
    ("name", HAN_TITLED),
    ("name", LISTED),
]
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Address ranges that stand apart, as first address and size.
NETS = [(0, 1 << 24), (10 << 24, 1 << 24), (127 << 24, 1 << 24), (172 << 24 | 16 << 16, 1 << 20), (192 << 24 | 168 << 16, 1 << 16), (224 << 24, 1 << 29)]
ROUNDS, TRIES = 8, 4
#: Longer values are rewritten in pieces of so many letters, so that no number grows with the text.
PIECE = 64


def _drawn(right: int, turn: int, half: int, key: bytes, tweak: bytes) -> int:
    """Keyed random bits, as many as half."""
    n = (half + 7) // 8
    seed = hashlib.blake2b(right.to_bytes(n, "big") + bytes([turn]) + tweak, key=key, digest_size=64)
    return int.from_bytes(seed.digest()[:n] if n <= 64 else hashlib.shake_256(seed.digest()).digest(n), "big") & (1 << half) - 1


def fpe(x: int, size: int, key: bytes, tweak: bytes, back: bool = False) -> int:
    """A keyed bijection on the x below size, or its inverse."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    while True:
        left, right = x >> half, x & (1 << half) - 1
        for turn in reversed(range(ROUNDS)) if back else range(ROUNDS):
            left, right = (right ^ _drawn(left, turn, half, key, tweak), left) if back else (right, left ^ _drawn(right, turn, half, key, tweak))
        x = left << half | right
        if x < size:
            return x


def move(x: int, size: int, key: bytes, tweak: bytes, same: Callable[[int], bool] | None = None) -> int:
    """A keyed bijection on the x below size (of the same class) that leaves no value, unless alone, as it is."""
    if size < 2:
        return x
    at = fpe(x, size, key, tweak)
    while True:
        at = (at + 1) % size
        y = fpe(at, size, key, tweak, back=True)
        if y == x or same is None or same(y):
            return y


def digits(text: str, keep: int, key: bytes, tweak: bytes, same: Callable[[str], bool] | None = None) -> str:
    """Rewrites the digits after the first keep; all else stays."""
    at = [i for i, c in enumerate(text) if "0" <= c <= "9"][keep:]

    def put(x: int) -> str:
        out = list(text)
        for i, c in zip(at, str(x).zfill(len(at)), strict=True):
            out[i] = c
        return "".join(out)

    shape = re.sub(r"[0-9]", "9", text) + text[: at[0] if at else 0]
    x = int("".join(text[i] for i in at) or "0")
    return put(move(x, 10 ** len(at), key, tweak + shape.encode(), same and (lambda v: same(put(v))))) if at else text


@functools.lru_cache(1 << 16)
def family(c: str) -> str:
    """Letters of a script without table that stand for each other: those of the same category among the 64 code points around; empty if c is alone."""
    kind, base = unicodedata.category(c), ord(c) & ~63
    own = [x for x in map(chr, range(base, base + 64)) if unicodedata.category(x) == kind and x.lower() not in CLASS] if kind[0] == "L" else []
    return "".join(own) if c in own and len(own) > 1 else ""


def letters(text: str, key: bytes, tweak: bytes, same: Callable[[str], bool] | None = None) -> str:
    """Rewrites letters by letters of their kind (script, case, vowel or not) and digits by digits; long texts by pieces, without a class."""
    if len(text) > PIECE:
        return "".join(letters(text[i : i + PIECE], key, tweak + f"{i}\0".encode()) for i in range(0, len(text), PIECE))
    value, size, shape, mark = 0, 1, [], []
    for c in text:
        low, k = c.islower(), CLASS.get(c.lower())
        if "0" <= c <= "9":
            kind, m = "0123456789", "\0d"
        elif k is not None and (low or c.lower().upper() == c):
            kind, m = LETTERS[k] if low else [u for x in LETTERS[k] if len(u := x.upper()) == 1], f"\0{k}{low:d}"
        elif c > "\x7f" and (kind := family(c)):
            m = f"\0f{kind[0]}"
        else:
            kind, m = None, c
        shape.append(kind)
        mark.append(m)
        if kind:
            value, size = value * len(kind) + kind.index(c), size * len(kind)

    def put(x: int) -> str:
        out = []
        for c, kind in zip(reversed(text), reversed(shape), strict=True):
            if kind:
                x, k = divmod(x, len(kind))
                c = kind[k]
            out.append(c)
        return "".join(reversed(out))

    return put(move(value, size, key, tweak + "".join(mark).encode("utf-8", "surrogatepass"), same and (lambda x: same(put(x)))))


def luhn(text: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(re.sub(r"\D", "", text))):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban(text: str) -> bool:
    t = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in t[4:] + t[:4])) % 97 == 1


def net(x: int) -> tuple[int, int] | None:
    return next((n for n in NETS if n[0] <= x < n[0] + n[1]), None)


def listed(name: str) -> bool:
    """Whether a name is one of the known given names, as written or in capitals."""
    return name in GENDER or (name == name.upper() and name.title() in GENDER)


def given(name: str, key: bytes, tweak: bytes) -> str:
    """Another given name of the gender and script of a listed one."""
    own = name.title()
    gender, script = next(k for k, names in GIVEN.items() if own in names)
    names = GIVEN[gender, script]
    new = names[move(names.index(own), len(names), key, tweak + f"{gender}{script}".encode())]
    return new.upper() if name == name.upper() else new


def leading(word: str) -> int:
    """How many pieces before the last of a hyphenated word are listed given names, from the first on."""
    pieces = word.split("-")
    return next((k for k, p in enumerate(pieces[:-1]) if not listed(p)), len(pieces) - 1)


def namesake(word: str, gender: str, key: bytes, tweak: bytes) -> str | None:
    """A listed given name of that gender in the word's script and case; none for scripts without a list."""
    script = "cyrillic" if "\u0400" <= word[0] <= "\u04ff" else "latin" if word[0] < "\u0250" else ""
    if not (names := GIVEN.get((gender, script))):
        return None
    seed = hashlib.blake2b(tweak + b"n" + word.encode("utf-8", "surrogatepass"), key=key, digest_size=8)
    new = names[int.from_bytes(seed.digest(), "big") % len(names)]
    return new.upper() if word == word.upper() else new


def named(word: str, gender: str, key: bytes, tweak: bytes) -> str:
    """A word of a name, gender being that of its title if the word stands as a given name.

    With one listed name before it a surrogate is that of a given name with its title's gender, with more that of a
    word that itself begins with listed names, and gets one more; so no two words share a surrogate.
    """
    if listed(word):
        return given(word, key, tweak)
    k = leading(word)
    if k:
        *first, last = word.split("-", k)
        gender = GENDER[first[0].title()]
        rest = [*(given(p, key, tweak) for p in first), named(last, "", key, tweak)]
    else:
        rest = [letters(word, key, tweak + b"s", lambda s: not listed(s) and not leading(s))]
    before_it = namesake(word, gender, key, tweak) if gender else None
    return "-".join([before_it, *rest] if before_it else rest)


def surrogate(kind: str, text: str, key: bytes, nonce: int = 0) -> str:
    tweak = f"{kind}\0{nonce}\0".encode()
    if kind == "email":
        local, _, domain = text.partition("@")
        host, dot, top = domain.rpartition(".")
        return letters(local + "@" + host, key, tweak) + dot + top
    if kind == "secret" and (head := re.match(r"AKIA|AIza|gh[oprsu]_|xox[abprs]-|eyJ", text)):
        parts = text.split(".") if head[0] == "eyJ" else [text]  # the first two of a web token's parts begin alike
        heads = [head[0] if k < 2 else "" for k in range(len(parts))]
        return ".".join(h + letters(p[len(h) :], key, tweak + h.encode() + b"%d" % k) for k, (h, p) in enumerate(zip(heads, parts, strict=True)))
    if kind == "secret":
        low = text.lower() == text  # capitals: at least one letter, so that the two kinds share no value
        write = lambda x: (f"{x:x}" if low else f"{x:X}").zfill(len(text))
        return write(move(int(text, 16), 16 ** len(text), key, tweak + f"{len(text)}{low}".encode(), None if low else lambda x: not write(x).isdigit()))
    if kind == "card":
        valid = luhn(text)
        keep = {14: 3, 15: 2}.get(sum(c.isdigit() for c in text), 1)  # as many as say whose card it is
        return digits(text, keep, key, tweak, lambda s: luhn(s) == valid)
    if kind == "iban":
        head = text[:2] if (valid := check_iban(text) == text) else text[:4]
        body = letters(text[4:], key, tweak + head.encode(), None if valid else lambda b: check_iban(text[:4] + b) != text[:4] + b)
        return check_iban(text[:4] + body) if valid else text[:4] + body
    if kind == "ip" and ":" in text:  # the first 16 bits say what kind of address it is; they stay
        x = int(ipaddress.IPv6Address(text))
        high, low = x >> 112, x & (1 << 112) - 1
        spoken = lambda v: address(ipaddress.IPv6Address(high << 112 | v).compressed)
        return ipaddress.IPv6Address(high << 112 | move(low, 1 << 112, key, tweak + b"6" + high.to_bytes(2, "big"), spoken)).compressed
    if kind == "ip":
        a, b, c, d = map(int, text.split("."))
        x = a << 24 | b << 16 | c << 8 | d
        if own := net(x):
            y = own[0] + move(x - own[0], own[1], key, tweak + str(own[0]).encode())
        else:
            y = move(x, 1 << 32, key, tweak, lambda v: net(v) is None)
        return ".".join(str(y >> s & 255) for s in (24, 16, 8, 0))
    if kind == "phone":
        lead = re.match(r"\+\d{1,3}(?=\D)", text)
        if lead or "(" in text or text[0] == "+":
            return digits(text, len(lead[0]) - 1 if lead else 0, key, tweak)
        keep = int(text[0] in "01")  # national: the trunk digit stays, an area code does not begin with one
        area = re.compile(r"\D*[01]")
        return digits(text, keep, key, tweak, None if text[0] == "0" else lambda s: not area.match(s[keep:]))
    if kind == "name":
        gender, _, name = text.rpartition("\0")
        words = [m for m in TOKEN.finditer(name) if m[0] not in PARTICLES]
        out, at = [], 0
        for m in words:
            own = gender.lower() if m is words[0] and (len(words) > 1 or gender.isupper()) else ""  # alone it is a surname, unless known as a given name
            out += [name[at : m.start()], named(m[0], own, key, tweak) if len(m[0]) > 1 else letters(m[0], key, tweak + b"i")]
            at = m.end()
        return "".join([*out, name[at:]])
    if kind == "passport":
        return letters(text, key, tweak)
    if kind == "birth":  # a date stays one
        there = a_date(text)
        return digits(text, 0, key, tweak, lambda s: a_date(s) == there)
    return digits(text, 0, key, tweak)


def a_date(text: str) -> bool:
    """Whether numbers are a date of the years 1900 to 2029, in either order of day and month."""
    a, b, c = (int(x) for x in re.split(r"[./-]", text))
    year, rest = (a, (b, c)) if a > 31 else (c, (a, b))
    return 1900 <= year < 2030 and 1 <= min(rest) <= 12 and 1 <= max(rest) <= 31


def check_iban(text: str) -> str:
    """The same account with the check digits that make it valid."""
    t = text.replace(" ", "")
    rest = int("".join(str(int(c, 36)) for c in t[4:] + t[:2] + "00")) % 97
    return text[:2] + f"{98 - rest:02d}" + text[4:]


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) of the entities, left to right; of overlapping ones the earlier kind of PATTERNS stays.

    A name's value carries the gender its title states, in capitals if the name is a given name alone.
    """
    out = _titled(text)
    return _again(text, out) if any(kind == "name" for _, _, kind, _ in out) else out


def _again(text: str, found: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """Adds the words of the names found wherever else they stand in the text, each with the gender under which it was a given name."""
    known: dict[str, str] = {}
    for _, _, kind, value in found:
        if kind == "name":
            gender, _, name = value.rpartition("\0")
            words = [w for w in TOKEN.findall(name) if w not in PARTICLES]
            for k, w in enumerate(words):
                if len(w) > 1:
                    known[w] = known.get(w) or (gender if k == 0 and len(words) > 1 else "")
    out, at = [], 0
    for m in TOKEN.finditer(text):
        if m[0] in known:
            while at < len(found) and found[at][1] <= m.start():
                at += 1
            if at == len(found) or m.end() <= found[at][0]:
                out.append((m.start(), m.end(), "name", f"{known[m[0]].upper()}\0{m[0]}"))
    return sorted(found + out) if out else found


def _titled(text: str) -> list[tuple[int, int, str, str]]:
    """The entities that their own form or a title shows."""
    digit, out, starts = any_digit(text) is not None, [], []
    for kind, pattern in PATTERNS:
        if kind == "email" and "@" not in text or kind not in ("email", "name", "secret") and not digit:
            continue
        if pattern.pattern[0] == ":" and "::" not in text and text.count(":") < 7:
            continue
        for m in pattern.finditer(text):
            if kind == "name":
                if not (found := after(text, m) if pattern is TITLE else (m.start("v"), m.end("v"), HAN_TITLES[m["title"]]) if pattern is HAN_TITLED else untitled(text, m)):
                    continue
                start, end, gender = found
                value = f"{gender}\0{text[start:end]}"
            elif m[0][0] == ":":
                start, end = around(text, m.start())
                if not address(text[start:end]):
                    continue
                value = ipaddress.IPv6Address(text[start:end]).compressed
            else:
                start, end = m.span("v") if "v" in pattern.groupindex else (before(text, m.start()) if kind == "email" else m.start(), m.end())
                if kind == "email" and start == m.start():
                    continue
                value = text[start:end]
                if kind == "card" and sum(c.isdigit() for c in value) != 16 and not luhn(value):
                    continue
            k = bisect.bisect(starts, start)  # out holds no overlaps, so its neighbours in order decide
            if (k == 0 or out[k - 1][1] <= start) and (k == len(out) or end <= out[k][0]):
                out.insert(k, (start, end, kind, value))
                starts.insert(k, start)
    return out


def after(text: str, title: re.Match) -> tuple[int, int, str] | None:
    """(start, end, gender) of the name after a title and those that follow it: capitalised words, initials, and particles between them."""
    gender, last, at = TITLE_GENDER[title[1]], title, title.end()
    while (m := TITLE.match(text, at)) is not None:
        gender, last, at = gender or TITLE_GENDER[m[1]], m, m.end()
    start, end = words_of(text, at)
    if end > start:
        return start, end, gender
    return None if last is title else (last.start(1), last.end(1), gender)  # a name that is written like a title


def untitled(text: str, given: re.Match) -> tuple[int, int, str] | None:
    """The same for a listed given name without a title, if another word of a name follows."""
    start = given.start()
    if not listed(given[0]) or (start and (text[start - 1].isalnum() or text[start - 1] in "_-")):
        return None
    start, end = words_of(text, start)
    rest = text[given.end() : end]
    return (start, end, "") if any(len(w) > 1 and w not in PARTICLES for w in TOKEN.findall(rest)) else None


def words_of(text: str, at: int) -> tuple[int, int]:
    """Where the words of a name that begin at a place lie; empty if there are none. Of words in capitals two belong to it at most, as a whole text may be in capitals."""
    start = end = at
    if (m := HAN.match(text, at)) is not None:
        return m.span()
    loud = 0
    while (m := PART.match(text, at)) is not None:
        word = m[0]
        loud += len(word) > 2 and word.isupper()
        if loud > 2:
            break
        if (word[0].isupper() or JOINED.match(word)) and (len(word) > 1 or end == start) and not (end > start and TITLE.match(text, at)):
            start, end = start if end > start else m.start(), m.end()
        elif word not in PARTICLES:
            break
        gap = GAP.match(text, m.end())
        if gap is None and word[-1] != ".":
            break
        at = gap.end() if gap else m.end()
    return start, end


HEX = frozenset("0123456789abcdefABCDEF:.")


def around(text: str, at: int) -> tuple[int, int]:
    """Where what may be an address of colons and hexadecimal digits begins and ends, at most as long as one can be; empty inside a word."""
    start = end = at
    while start and text[start - 1] in HEX and at - start < 40:
        start -= 1
    while end < len(text) and text[end] in HEX and end - at < 48:
        end += 1
    joined = start and (text[start - 1].isalnum() or text[start - 1] == "_") or end < len(text) and (text[end].isalnum() or text[end] == "_")
    while end > start and (text[end - 1] == "." or text[end - 1] == ":" and text[end - 2 : end] != "::"):
        end -= 1
    return (at, at) if joined else (start, end)


def address(text: str) -> bool:
    """Whether a text is an IPv6 address that is not taken for code or times: eight groups, or a first group of three digits or more."""
    try:
        ipaddress.IPv6Address(text)
    except ValueError:
        return False
    return any_digit(text) is not None and ("::" not in text or text.find(":") > 2)


def before(text: str, at: int) -> int:
    """Where the local part of an address begins whose sign is at at; at if there is none."""
    start = at
    while start and text[start - 1] in LOCAL:
        start -= 1
    while start < at and text[start] in "._%+-":
        start += 1
    return start


any_digit = re.compile(r"[0-9]").search


def replace(text: str, key: bytes, nonce: int = 0) -> tuple[str, list[tuple[int, int, str, str, str]]]:
    """The text with surrogates, and (start, end, kind, value, surrogate) of each."""
    out, at, found = [], 0, []
    for start, end, kind, value in find(text):
        new = cached(kind, value, key, nonce)
        out += [text[at:start], new]
        at = end
        found.append((start, end, kind, value, new))
    return "".join([*out, text[at:]]), found


@functools.lru_cache(20_000)
def cached(kind: str, value: str, key: bytes, nonce: int) -> str:
    return surrogate(kind, value, key, nonce)


def entities(docs: DataFrame, key: bytes, nonce: int = 0) -> DataFrame:
    """(doc_id, kind, start, end, value, surrogate) of every entity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, k, s, e, v, cached(k, v, key, nonce)) for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True) for s, e, k, v in find(t.as_py() or "")]
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], ["doc_id", "kind", "start", "end", "value", "surrogate"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, kind string, start int, end int, value string, surrogate string")


def mark(kind: str, value: str, key: bytes) -> int:
    """A keyed hash that stands for a value where values are compared, so that none is stored."""
    bare = value.rpartition("\0")[2]
    return int.from_bytes(hashlib.blake2b(f"{kind}\0{bare}".encode("utf-8", "surrogatepass"), key=key, digest_size=8).digest(), "big", signed=True)


MARKS = pa.list_(pa.struct([("kind", pa.string()), ("mark", pa.int64()), ("surrogate", pa.string())]))
MARKS_SQL = "array<struct<kind:string,mark:bigint,surrogate:string>>"


def marks(found: list[tuple[int, int, str, str, str]], key: bytes) -> list[dict]:
    return [{"kind": k, "mark": mark(k, v, key), "surrogate": n} for k, v, n in {(k, v, n) for _, _, k, v, n in found}]


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches of so many rows at most, so that few texts are held as they were and as they become."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


def settled(make: Callable[[int], DataFrame], column: str) -> DataFrame:
    """What make(tweak) gives for the least tweak under which no two values of a kind share a surrogate, stored.

    column holds the marks of each row's entities. The bijections give that for the first tweak, this confirms it.
    """
    for nonce in range(TRIES):
        out = stage(make(nonce), "surrogates")
        pairs = out.select(F.explode(column).alias("m")).groupBy("m.kind", "m.surrogate").agg(F.min("m.mark").alias("low"), F.max("m.mark").alias("high"))
        if pairs.where("low <> high").isEmpty():
            return out.drop(column)
    raise RuntimeError(f"surrogates collide under {TRIES} tweaks")


def pseudonymise(docs: DataFrame, key: bytes) -> DataFrame:
    """The rows with all their columns, entities of text replaced. Null and empty texts and those without entities stay as they are; so do repeated rows and null ids."""
    where, name = docs.columns.index("text"), unused(docs.columns, "_marks")
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T._parse_datatype_string(MARKS_SQL))])

    def make(nonce: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in sliced(batches):
                both = [(None, []) if t is None else replace(t, key, nonce) for t in (x.as_py() for x in b.column(where))]
                new = pa.array([t for t, _ in both], b.schema.field(where).type)
                yield pa.RecordBatch.from_arrays([*(new if k == where else c for k, c in enumerate(b.columns)), pa.array([marks(f, key) for _, f in both], MARKS)], names=[*b.schema.names, name])

        return docs.mapInArrow(run, schema)

    return settled(make, name)


def digest(docs: DataFrame, key: bytes) -> DataFrame:
    """(doc_id, n_entities, text_sha256, entities, text): whole rewritten texts, their digests, and their entities by kind. A null text counts as empty."""
    pair = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("surrogate", pa.string())]))

    def make(nonce: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in sliced(batches):
                both = [replace(t.as_py() or "", key, nonce) for t in b.column(1)]
                arrays = [b.column(0), pa.array([len(f) for _, f in both], pa.int64()), pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t, _ in both], pa.string()), pa.array([[{"kind": k, "start": s, "surrogate": n} for s, _, k, _, n in f] for _, f in both], pair), pa.array([t for t, _ in both], pa.string()), pa.array([marks(f, key) for _, f in both], MARKS)]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_entities", "text_sha256", "entities", "text", "marks"])

        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, n_entities long, text_sha256 string, entities array<struct<kind:string,start:int,surrogate:string>>, text string, marks {MARKS_SQL}")

    return settled(make, "marks")
