"""Personal data replaced by keyed surrogates of the same type and format.

Detected: e-mail addresses, phone numbers, IPv4 addresses, payment card numbers
(Luhn), IBANs (mod 97), US social security numbers, credentials (access keys, and
values given to names like password or token), and names of persons (an honorific,
or a known given name, before a capitalised word).

A surrogate is a keyed permutation of the entity's canonical form, within the forms
of the same shape: digits stay digits, letters stay letters, check digits are right
again, private addresses stay private, names keep gender and script. So the same
entity has the same surrogate in every document and spelling (coreference; a family name
the same one beside any given name or title), and two entities of one shape cannot share
one. What a permutation cannot exclude is checked
over the whole corpus: two entities with one surrogate, a surrogate that is an
entity of the corpus, a surrogate that is the entity itself. Such entities get the
permutation of the next attempt, until the check finds nothing; after some attempts
the form may grow, so that small spaces do not run out: secrets, addresses and names
become longer, a private network address may move to another private range.

Documents need no join for that: a surrogate is computed where the entity stands.
Only rows with an entity that needed another attempt are joined with its attempts.

Cases: null and empty texts stay as they are, texts without entities are unchanged
to the byte, whatever their length; null or repeated ids keep one row each; all
other columns are carried; an empty table gives an empty table. ``docs`` must give
the same rows in the same order when read again, as a stored table does.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paneledger.llm.keyed import marked
from paneledger.llm.text import batches_of, free_names
from paneledger.workspace import keep

MOST_ATTEMPTS, GROWS_AFTER = 24, 8
# Entities that are tried again are looked for by a broadcast of their hashes up to so
# many, else by shuffle; a task keeps so many surrogates that it has made.
BROADCAST_HASHES = 400_000
CACHED_SURROGATES = 50_000
# Most characters that are permuted as one number; of longer texts so many at once.
TOGETHER, BLOCK = 340, 256

# Given names by script and gender, honorifics by gender.
GIVEN = {
    ("latin", "m"): "James John Robert Michael William David Thomas Daniel Peter Paul Hans Klaus Stefan Pierre Jacques Luis Carlos Miguel Pablo Andrés".split(),
    ("latin", "f"): "Mary Patricia Jennifer Linda Elizabeth Susan Sarah Anna Maria Laura Emma Julia Sophie Claire Carmen Lucía Elena Ingrid Petra Sabine".split(),
    ("cyrillic", "m"): "Иван Дмитрий Сергей Алексей Михаил Николай Андрей Павел".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана".split(),
}
HONORIFICS = {
    "m": "Mr. Mr Herr Herrn Señor Sr. Monsieur господин".split(),
    "f": "Mrs. Mrs Ms. Ms Miss Frau Señora Sra. Madame Mme госпожа".split(),
    "": "Dr. Dr Prof. Prof".split(),
}
_GIVEN_GENDER = {name: gender for (_, gender), names in GIVEN.items() for name in names}
_HONORIFIC_GENDER = {word: gender for gender, words in HONORIFICS.items() for word in words}
_WORD = r"[A-ZÀ-ÖØ-ÞА-ЯЁ][a-zß-öø-ÿа-яё]+(?:-[A-ZÀ-ÖØ-ÞА-ЯЁ][a-zß-öø-ÿа-яё]+)?"
_TITLE = "|".join(re.escape(word) for word in sorted(_HONORIFIC_GENDER, key=len, reverse=True))
_FIRST = "|".join(sorted(_GIVEN_GENDER, key=len, reverse=True))
_DIGIT = re.compile(r"[0-9]")
_HONORED = re.compile(rf"(?<!\w)(?:{_TITLE}) (?P<name>{_WORD}(?: {_WORD})?)(?!\w)")
_NAMED = re.compile(rf"(?<!\w)(?P<name>(?:{_FIRST}) {_WORD})(?!\w)")
_EMAIL = re.compile(r"(?<![\w.+-])[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![\w@-])")
_CARD = re.compile(r"(?<![\w.+-])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![\w-])")
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
_PHONE = re.compile(r"(?<![\w.])(?:\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?!\w)")
_LOCAL = re.compile(r"(?<![\w.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?!\w)")
_IP = re.compile(r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\w|\.[0-9])")
_SSN = re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")
_ACCESS = re.compile(r"(?<!\w)(?:AKIA|ASIA)[A-Z0-9]{16}(?!\w)")
_SECRET = re.compile(
    r"(?i)(?<![a-z])(?:password|passwd|pwd|secret|token|api[_-]?key)[\"']?\s*[=:]\s*(?P<quote>[\"']?)(?P<value>[A-Za-z0-9+/_.~!@#$%^&*-]{4,}[A-Za-z0-9+/_~=-])(?P=quote)")
_ASSIGNED = re.compile(r"(?i)(?:passw|pwd|secret|token|key)[a-z]*[\"']?\s*[=:]")
# Where an entity may begin, or lie: patterns that start with what is rare, so that a
# text is run through quickly; only there the patterns above are tried.
_NUMERIC = re.compile(r"[0-9+(][0-9+(). -]{6,}")
_COUNTRY = re.compile(r"[A-Z]{2}[0-9]{2}")
_TITLED = re.compile(rf"(?:{_TITLE}) ")
_CALLED = re.compile(rf"(?:{_FIRST}) ")
_KEYWORDS = ("passw", "pwd", "secret", "token", "key")
# What stands between the groups of a kind that is written in groups.
_BETWEEN = {"iban": " ", "phone": " .-"}
# Most digits of a phone number after these calling codes; else 15 with the code.
_NATIONAL = {code: most for most, codes in ((8, "45 47"), (9, "31 32 33 34 41 46 48 61 351 380 420"), (10, "1 7 44 52 81 90 91"), (11, "39 49 55 86")) for code in codes.split()}


def luhn(digits: str) -> int:
    """The check digit that belongs after ``digits``."""
    total = 0
    for at, digit in enumerate(reversed(digits)):
        value = int(digit) * (2 if at % 2 == 0 else 1)
        total += value - 9 if value > 9 else value
    return -total % 10


def iban_check(country: str, account: str) -> str:
    number = int("".join(str(int(c, 36)) for c in account + country + "00"))
    return f"{98 - number % 97:02d}"


def _canonical(kind: str, found: str) -> str | None:
    """The form that all spellings of one entity share; None if it is none."""
    if kind == "email":
        return found.lower()
    if kind == "name":
        return found
    plain = re.sub(r"[ ().+-]", "", found) if kind in ("card", "phone", "ssn") else found
    if kind == "card":
        return plain if 13 <= len(plain) <= 19 and len(set(plain)) > 1 and luhn(plain[:-1]) == int(plain[-1]) else None
    if kind == "phone":
        return plain[-10:] if 8 <= len(plain) <= 15 else None
    if kind == "ip":
        return found if all(int(part) < 256 for part in found.split(".")) else None
    if kind == "iban":
        plain = found.replace(" ", "")
        return plain if 15 <= len(plain) <= 34 and iban_check(plain[:2], plain[4:]) == plain[2:4] else None
    return plain


def _most_digits(phone: str) -> int:
    """How many digits a phone number that starts like this has at most."""
    if not phone.startswith("+"):
        return 10
    plain = re.sub(r"[^0-9]", "", phone)
    return next((n + _NATIONAL[plain[:n]] for n in (1, 2, 3) if plain[:n] in _NATIONAL), 15)


def _stops(kind: str, text: str, start: int, end: int) -> list[int]:
    """Where an entity that starts here may end, the best first. Groups may run on into
    digits that follow, so each end of a group is one; for a phone number first those
    that its calling code allows and that leave an address or number after it whole."""
    stops = [end, *(at for at in range(end - 1, start, -1) if text[at] in _BETWEEN.get(kind, "") and text[at - 1] not in " .-(+")]
    if kind != "phone" or len(stops) == 1:
        return stops
    most = _most_digits(text[start:end])
    inner = [match.start() for pattern in (_IP, _LOCAL) for match in pattern.finditer(text, start + 1, end + 15)]

    def worse(stop: int) -> tuple[bool, bool]:
        return sum(c in _SETS[0] for c in text[start:stop]) > most, any(at < stop for at in inner)

    return sorted(stops, key=worse)


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """``(start, end, kind, canonical)`` in order, without overlaps; where two kinds
    overlap the one named first below counts."""
    found: list[tuple[int, int, str, str]] = []
    starts: list[int] = []  # of what is found, in order, and where each ends
    ends: list[int] = []

    def add(kind: str, matches: Callable[[int], re.Match | None], pattern: re.Pattern, group: str | int = 0) -> None:
        """``matches`` gives the first match of the pattern from a place on."""
        at = 0
        while match := matches(at):
            start, end = match.span(group)
            at = match.start() + 1
            for stop in _stops(kind, text, start, end):
                if stop < end and not pattern.fullmatch(text, start, stop):
                    continue
                canonical = _canonical(kind, text[start:stop])
                place = bisect.bisect_left(starts, stop)  # what begins before the stop must end before the start
                if canonical is not None and (not place or ends[place - 1] <= start):
                    starts.insert(place, start)
                    ends.insert(place, stop)
                    found.append((start, stop, kind, canonical))
                    at = max(at, stop)
                    break

    if ("=" in text or ":" in text) and any(map(text.casefold().__contains__, _KEYWORDS)) and _ASSIGNED.search(text):
        add("secret", lambda at: _SECRET.search(text, at), _SECRET, "value")
    if "AKIA" in text or "ASIA" in text:
        add("access", lambda at: _ACCESS.search(text, at), _ACCESS)
    if "@" in text:
        add("email", lambda at: _address(text, at), _EMAIL)
    if _DIGIT.search(text):
        if begins := [match.start() for match in _COUNTRY.finditer(text)]:
            add("iban", _Begins(text, _IBAN, begins), _IBAN)
        if spans := [match.span() for match in _NUMERIC.finditer(text)]:
            for kind, pattern in (("card", _CARD), ("ssn", _SSN), ("phone", _PHONE), ("ip", _IP)):
                add(kind, _Inside(text, pattern, spans), pattern)
    for hint, pattern in ((_TITLED, _HONORED), (_CALLED, _NAMED)):
        if begins := [match.start() for match in hint.finditer(text)]:
            add("name", _Begins(text, pattern, begins), pattern, "name")
    return sorted(found)


def _address(text: str, at: int) -> re.Match | None:
    """The first address from here on: no more than 64 characters before the first @."""
    place = text.find("@", at)
    return _EMAIL.search(text, max(at, place - 64)) if place >= 0 else None


class _Begins:
    """The first match from a place on, of a pattern that matches at some of the given
    places only. Places are asked for in order."""

    def __init__(self, text: str, pattern: re.Pattern, places: list[int]) -> None:
        self.text, self.pattern, self.places, self.next = text, pattern, places, 0

    def __call__(self, at: int) -> re.Match | None:
        while self.next < len(self.places):
            if self.places[self.next] >= at and (match := self.pattern.match(self.text, self.places[self.next])):
                return match
            self.next += 1
        return None


class _Inside:
    """The first match from a place on, of a pattern whose matches lie inside the given
    spans only; it looks one character beyond them. Places are asked for in order."""

    def __init__(self, text: str, pattern: re.Pattern, spans: list[tuple[int, int]]) -> None:
        self.text, self.pattern, self.spans, self.next = text, pattern, spans, 0

    def __call__(self, at: int) -> re.Match | None:
        while self.next < len(self.spans):
            start, end = self.spans[self.next]
            if match := self.pattern.search(self.text, max(at, start), end + 1):
                return match
            self.next += 1
        return None


def _side(size: int) -> int:
    """A number whose square is at least ``size``: from the root as a float, which is too
    low by astronomic steps where the size is large, else the next whole root."""
    side = int(size ** 0.5) + 1 if size.bit_length() < 1024 else 0  # no float is larger
    return side if side * side >= size else math.isqrt(size - 1) + 1


def _stretched(number: hashlib.blake2b, most: int) -> bytes:
    """The digest, made as long as ``most`` if that is longer: else the first characters
    of a long value would stay as they are."""
    data = number.digest()
    while 8 * len(data) < most.bit_length():
        number.update(data[-32:])
        data += number.digest()
    return data


class Surrogates:
    """Surrogates under one secret key."""

    def __init__(self, key: bytes) -> None:
        self.key = key

    def _number(self, *parts: object) -> int:
        data = "\x1f".join(map(str, parts)).encode()
        return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=32).digest(), "big")

    def permuted(self, value: int, size: int, *tweak: object) -> int:
        """A keyed permutation of 0 ... size - 1: eight Feistel rounds over two digits
        of a mixed base, walked on until inside."""
        if size < 2:
            return value
        side = _side(size)
        narrow = side.bit_length() <= 256
        keyed = hashlib.blake2b("\x1f".join([*map(str, tweak), str(size), ""]).encode(), key=self.key, digest_size=32)
        while True:
            left, right = divmod(value, side)
            for turn in range(8):
                number = keyed.copy()
                number.update(b"%d\x1f%d" % (turn, right))
                data = number.digest() if narrow else _stretched(number, side)
                left, right = right, (left + int.from_bytes(data, "big")) % side
            value = left * side + right
            if value < size:
                return value

    def shaped(self, text: str, alphabets: Callable[[str], str | None], *tweak: object) -> str:
        """Permute all characters that have an alphabet, together, within the shape; those of
        a long text in blocks, each under what the blocks before have become."""
        if len(text) > TOGETHER and sum(alphabets(c) is not None for c in text) > TOGETHER:
            out, before = [], self._number("blocks", *tweak, len(text))
            for first in range(0, len(text), BLOCK):
                out.append(self.shaped(text[first:first + BLOCK], alphabets, *tweak, before))
                before = self._number(before, out[-1])
            return "".join(out)
        sets = [alphabets(c) for c in text]
        value, size = 0, 1
        for c, alphabet in zip(text, sets):
            if alphabet:
                value, size = value * len(alphabet) + alphabet.index(c), size * len(alphabet)
        shape = "".join(alphabet[0] if alphabet else c for c, alphabet in zip(text, sets))
        value = self.permuted(value, size, *tweak, shape)
        out = list(text)
        for at in range(len(text) - 1, -1, -1):
            if alphabet := sets[at]:
                value, digit = divmod(value, len(alphabet))
                out[at] = alphabet[digit]
        return "".join(out)

    def of(self, kind: str, canonical: str, attempt: int = 0) -> str:
        """The canonical form of the surrogate."""
        return getattr(self, f"_{kind}")(canonical, f"{kind}:{attempt}", max(0, attempt - GROWS_AFTER))

    def _card(self, value: str, tweak: str, grow: int) -> str:
        body = value[0] + self.shaped(value[1:-1], _digits, tweak, value[0])
        return body + str(luhn(body))

    def _phone(self, value: str, tweak: str, grow: int) -> str:
        return value[0] + self.shaped(value[1:], _digits, tweak, value[0])

    def _ssn(self, value: str, tweak: str, grow: int) -> str:
        return self.shaped(value, _digits, tweak)

    def _ip(self, value: str, tweak: str, grow: int) -> str:
        a, b, c, d = map(int, value.split("."))
        if grow and any(first <= (a << 24 | b << 16 | c << 8 | d) < first + size for first, size in _PRIVATE):
            return self._private(a << 24 | b << 16 | c << 8 | d, tweak)
        fixed = 1 if a in (0, 10, 127) or a > 223 else 2 if (a, b) == (192, 168) or (a == 172 and 16 <= b < 32) else 0
        number, size = (a << 24 | b << 16 | c << 8 | d), 1 << 32 - 8 * fixed
        head = number - number % size
        while True:  # public addresses are walked on until public again
            number = head + self.permuted(number % size, size, tweak, head)
            a, b = number >> 24, number >> 16 & 255
            if fixed or not (a in (0, 10, 127) or a > 223 or (a, b) == (192, 168) or (a == 172 and 16 <= b < 32)):
                return ".".join(str(number >> shift & 255) for shift in (24, 16, 8, 0))

    def _private(self, number: int, tweak: str) -> str:
        """Where the addresses of one private range run out, one of any private range."""
        before = 0
        for first, size in _PRIVATE:
            if first <= number < first + size:
                at = self.permuted(before + number - first, sum(size for _, size in _PRIVATE), tweak, "private")
            before += size
        for first, size in _PRIVATE:
            if at < size:
                return ".".join(str(first + at >> shift & 255) for shift in (24, 16, 8, 0))
            at -= size
        raise AssertionError("not private")

    def _iban(self, value: str, tweak: str, grow: int) -> str:
        account = self.shaped(value[4:], _classes, tweak, value[:2])
        return value[:2] + iban_check(value[:2], account) + account

    def _email(self, value: str, tweak: str, grow: int) -> str:
        address, _, top = value.rpartition(".")
        return self.shaped(address + "x" * grow if grow else address, _classes, tweak) + "." + top

    def _access(self, value: str, tweak: str, grow: int) -> str:
        return value[:4] + self.shaped(value[4:], lambda c: _ALNUM, tweak)

    def _secret(self, value: str, tweak: str, grow: int) -> str:
        longer = value + "0" * grow
        if re.fullmatch("[0-9a-f]+", longer) and re.search("[a-f]", longer):
            return self.shaped(longer, lambda c: _HEX, tweak)
        return self.shaped(longer, _classes, tweak)

    def _given(self, name: str, names: list[str], script: str) -> int:
        """The place of the given name that stands for ``name``: known ones change places
        under the key, so that two never share one."""
        if name in names:
            return self.permuted(list(names).index(name), len(names), "given", script)
        return self._number("given", name) % len(names)

    def _name(self, value: str, tweak: str, grow: int) -> str:
        """A given name of the same gender and script, the family name permuted letter
        class by letter class; ``value`` starts with its gender."""
        gender, _, rest = value.partition("|")
        *given, family = rest.split(" ")
        script = "cyrillic" if re.search("[А-Яа-яЁё]", rest) else "latin"
        names = GIVEN[script, gender or "mf"[self._number("name", rest, "gender") % 2]]
        attempt = int(tweak.partition(":")[2])
        out = [names[self._given(name, names, script) + attempt - len(names)] if attempt < len(names)
               else names[self._number(tweak, name) % len(names)] for name in given]
        # The family name has a key of its own, the same beside any given name or title;
        # another attempt changes the given name first, as long as there are any.
        turn = f"family:{attempt // len(names) if given else attempt}"
        grow = max(0, attempt - len(names)) if given else grow
        end = len(family) - 3 if script == "cyrillic" and len(family) > 4 else len(family)  # endings show gender
        body = family[:end].lower() + ("ona" if script == "latin" else "ова")[:3] * grow
        new = self.shaped(body, _letters, turn, script) + family[end:]
        cased = "".join(n.upper() if o.isupper() else n for o, n in zip(family[:end], new)) + new[min(end, len(new)):]
        return gender + "|" + " ".join([*out, cased])


# The private ranges of IPv4: first address, and how many.
_PRIVATE = ((10 << 24, 1 << 24), (172 << 24 | 16 << 16, 1 << 20), (192 << 24 | 168 << 16, 1 << 16))
_ALNUM = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_HEX = "0123456789abcdef"
_SETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTERS = ("aeiou", "bcdfghjklmnpqrstvwxyz", "áéíóúàèìòùâêîôûäëïöü", "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ")


# The alphabet of a character, if it has one.
_classes: Callable[[str], str | None] = {c: letters for letters in _SETS for c in letters}.get
_digits: Callable[[str], str | None] = dict.fromkeys(_SETS[0], _SETS[0]).get
_letters: Callable[[str], str | None] = {c: letters for letters in _LETTERS for c in letters}.get


def gendered(text: str, start: int, name: str) -> str:
    """A name with its gender before it, from its first name or from the honorific."""
    first = name.split(" ")[0]
    before = text[max(0, start - 12):start].rstrip().rsplit(None, 1)
    gender = _HONORIFIC_GENDER.get(before[-1] if before else "", "") or _GIVEN_GENDER.get(first, "")
    return f"{gender}|{name}"


def rendered(kind: str, found: str, surrogate: str) -> str:
    """The canonical surrogate in the spelling of the entity it stands for."""
    if kind == "name":
        return surrogate.partition("|")[2]
    if kind == "email":
        same = len(found) == len(surrogate)
        return "".join(n.upper() if o.isupper() else n for o, n in zip(found, surrogate)) if same else surrogate
    if kind in ("card", "phone", "ssn", "iban"):
        plain = [at for at, c in enumerate(found) if c.isalnum()]
        out = list(found)
        for at, c in zip(plain[-len(surrogate):], surrogate):
            out[at] = c
        return "".join(out)
    return surrogate


def detected(text: str) -> list[tuple[int, int, str, str]]:
    return [(start, end, kind, gendered(text, start, value) if kind == "name" else value) for start, end, kind, value in entities(text)]


def _found(docs: DataFrame, text: str) -> DataFrame:
    """``(row_key, kind, value)``: the entities of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(key, *one) for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if value
                    for one in sorted({(kind, canonical) for _, _, kind, canonical in detected(value)})]
            columns = list(zip(*rows)) if rows else [()] * 3
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())], ["row_key", "kind", "value"])

    rows = docs.select(F.monotonically_increasing_id().alias("row_key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "row_key long, kind string, value string")


def _surrogates(values: DataFrame, key: bytes) -> DataFrame:
    """``values`` (kind, value, attempt) with their surrogates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Surrogates(key)
        for batch in batches:
            made = [make.of(*row) for row in zip(*(column.to_pylist() for column in batch.columns))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], ["kind", "value", "attempt", "surrogate"])

    return values.select("kind", "value", "attempt").mapInArrow(run, "kind string, value string, attempt int, surrogate string")


def _among(rows: DataFrame, others: DataFrame, n: int, key: list[str], how: str = "left_semi") -> DataFrame:
    """The rows whose key is (or is not) among the ``n`` rows of ``others``."""
    others = others.select(key)
    return rows.join(F.broadcast(others) if n <= BROADCAST_HASHES else others, key, how)


def _clashes(made: DataFrame, n: int, taken: DataFrame) -> DataFrame:
    """``(kind, value)`` of the ``n`` entities ``made`` whose surrogate is taken, or is that of
    a smaller value of them.

    Whole tables meet as hashes only; strings are compared of those few whose hash is
    not alone."""
    hashed = F.xxhash64("kind", "surrogate").alias("hash")
    new, near = made.select("*", hashed), taken.select("kind", "surrogate", hashed)
    if n <= BROADCAST_HASHES:
        near = _among(near, new, n, ["hash"])
    else:
        both = new.select("hash", F.lit(1).alias("n"), F.lit(0).alias("used")).unionByName(near.select("hash", F.lit(0).alias("n"), F.lit(1).alias("used")))
        met = keep(both.groupBy("hash").agg(F.sum("n").alias("n"), F.max("used").alias("used")).where("n > 1 OR n = 1 AND used = 1").select("hash"), "hashes")
        n_met = met.count()
        new, near = _among(new, met, n_met, ["hash"]), _among(near, met, n_met, ["hash"])
    new = new.select("kind", "surrogate", "value")
    both = new.unionByName(near.select("kind", "surrogate", F.lit(None).cast("string").alias("value")))
    lost = both.groupBy("kind", "surrogate").agg(F.min("value").alias("first"), F.count("value").alias("n"), (F.count("*") > F.count("value")).alias("used"))
    return new.join(lost.where("n > 1 OR n = 1 AND used").drop("n"), ["kind", "surrogate"]).where("used OR value <> first").select("kind", "value")


def attempts(values: DataFrame, key: bytes) -> DataFrame:
    """``(kind, value, attempt)`` of the distinct ``values`` whose first surrogate was
    taken, is an entity of the corpus, or is the entity itself.

    A round looks at the entities that clashed in the round before, no others: what has
    kept its surrogate once keeps it."""
    made = keep(_surrogates(values.withColumn("attempt", F.lit(0)), key), "surrogates")
    real, n = made.select("kind", F.col("value").alias("surrogate")), made.count()
    settled: list[DataFrame] = []  # at the first attempt, and at later ones
    for round_ in range(MOST_ATTEMPTS):
        taken = real
        for rows in settled:
            taken = taken.unionByName(rows.select("kind", "surrogate"))
        clash = keep(_clashes(made, n, taken), "clashes")
        n_clash = clash.count()
        if not n_clash:
            later = made if round_ else made.where("false")
            for rows in settled[1:]:
                later = later.unionByName(rows)
            return later.select("kind", "value", "attempt")
        rest = _among(made, clash, n_clash, ["kind", "value"], "left_anti")
        if len(settled) > 1:
            rest = settled.pop().unionByName(rest)
        settled.append(keep(rest, "settled"))
        made, n = keep(_surrogates(clash.withColumn("attempt", F.lit(round_ + 1)), key), "surrogates"), n_clash
    raise RuntimeError("surrogates still clash; use another key")


def replaced(docs: DataFrame, key: bytes, text: str = "text", count: str | None = None) -> DataFrame:
    """``docs`` with every entity in ``text`` replaced, and their number per row as
    ``count`` if a name is given."""
    batches_of(docs.sparkSession)
    found = keep(_found(docs, text), "entities")
    other = attempts(found.select("kind", "value").distinct(), key)
    columns = docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + (f", `{count}` long" if count else "")
    at = columns.index(text)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Surrogates(key)
        made: dict[tuple[str, str, int], str] = {}

        def surrogate_of(*entity: str | int) -> str:
            if entity not in made:
                if len(made) >= CACHED_SURROGATES:
                    made.clear()
                made[entity] = make.of(*entity)
            return made[entity]

        for batch in batches:
            tried = batch.column(len(columns)).to_pylist() if batch.num_columns > len(columns) else [None] * batch.num_rows
            texts, counts = [], []
            for value, own in zip(batch.column(at).to_pylist(), tried):
                parts, end, spans = [], 0, detected(value) if value else []
                own = {(x["kind"], x["value"]): x["attempt"] for x in own or ()}
                for start, stop, kind, canonical in spans:
                    surrogate = surrogate_of(kind, canonical, own.get((kind, canonical), 0))
                    parts += value[end:start], rendered(kind, value[start:stop], surrogate)
                    end = stop
                texts.append("".join([*parts, value[end:]]) if spans else value)
                counts.append(len(spans))
            out = list(batch.columns[:len(columns)])
            out[at] = pa.array(texts, pa.string())
            names = list(columns)
            if count:
                out.append(pa.array(counts, pa.int64()))
                names.append(count)
            yield pa.RecordBatch.from_arrays(out, names)

    if other.isEmpty():
        return docs.mapInArrow(rewrite, schema)
    own, tried, maybe = free_names(columns, "row_key", "tried", "maybe")
    per_row = keep(found.join(other, ["kind", "value"]).groupBy(F.col("row_key").alias(own)).agg(
        F.collect_list(F.struct("kind", "value", "attempt")).alias(tried)), "attempts")
    rows = marked(docs.withColumn(own, F.monotonically_increasing_id()), per_row, own, maybe)
    given = [F.col(f"`{c}`") for c in columns]
    plain = rows.where(f"NOT {maybe}").select(given).mapInArrow(rewrite, schema)
    joined = rows.where(maybe).join(per_row, own, "left").select(*given, tried).mapInArrow(rewrite, schema)
    return plain.unionByName(joined)
