"""Replacement of personal data by keyed, type-consistent surrogates.

A surrogate is the image of the entity under a keyed bijection on the entities
of its type and shape, so equal entities get equal surrogates in every
document and on every machine (coreference), and distinct ones get distinct
surrogates (no collisions), without a table that grows with the corpus. The
order of an alternating Feistel network over mixed-radix numbers (each
character is a digit in the alphabet of its class and script, so lengths,
punctuation, letter case and scripts stay) puts all strings of a shape on one
cycle; the image is the next string of the same kind on it: of valid check
digits, of the same address range, outside the lists of names. A step along a
cycle is a bijection without fixed points, so nothing stands for itself.

Collision check: each new image is walked back, and must lead to its entity;
besides, entities and surrogates of a document are counted against each other
(``n_collisions``), and ``collisions`` does so for a whole corpus.

Names are found by a title or an introducing phrase before them, or by a
listed given name, in any script with letter case. They keep gender and
script: listed given names and surnames are permuted within their list, other
names are rewritten vowel by vowel and consonant by consonant and never land
on a listed one. A name that nothing announces, of no listed given name, is
not found, nor are names in scripts without case.
"""


from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = b"surrogate key of the test tables"
ROUNDS = 8
#: Characters that one network rewrites at once.
LONGEST = 128
RESULT = "doc_id bigint, text string, n_entities int, kinds string, n_collisions int"

GIVEN = {
    ("f", "latin"): "anna maria laura julia sofia clara emma lucia elena carmen isabel camille chloe juliette manon helene claire sophie katharina greta ingrid monika ursula mary emily sarah jessica hannah olivia margaret".split(),
    ("m", "latin"): "peter paul thomas martin daniel lukas jonas felix stefan juergen hans wolfgang pierre jean louis antoine mathieu nicolas jose carlos miguel javier pablo diego john james robert william michael david".split(),
    ("f", "cyrillic"): "анна мария елена ольга наталья татьяна ирина светлана екатерина юлия дарья полина".split(),
    ("m", "cyrillic"): "иван алексей дмитрий сергей андрей михаил николай павел владимир юрий олег борис".split(),
}
FAMILY = {
    "latin": "smith johnson brown taylor wilson walker mueller schmidt schneider fischer weber wagner becker hoffmann keller bauer martin bernard dubois durand moreau laurent lefebvre garcia fernandez lopez martinez sanchez perez gomez".split(),
    "cyrillic": "иванов петров сидоров смирнов кузнецов попов васильев соколов михайлов новиков федоров морозов".split(),
}
TITLES = {"mr": "m", "herr": "m", "monsieur": "m", "sr": "m", "señor": "m", "don": "m", "pan": "m", "signor": "m", "mrs": "f", "ms": "f", "miss": "f", "frau": "f", "madame": "f", "mme": "f", "mlle": "f", "sra": "f", "señora": "f", "doña": "f", "pani": "f", "signora": "f", "dr": "", "prof": "", "г-н": "m", "г-жа": "f", "κος": "m", "κύριος": "m", "κυρία": "f", "δρ": ""}
#: Phrases behind which a name of two words stands.
INTRODUCED = ("my name is", "i am called", "signed by", "written by", "contact person:", "ich heiße", "mein name ist", "je m'appelle", "mon nom est", "me llamo", "mi nombre es", "mi chiamo", "nazywam się", "меня зовут", "με λένε")


def _letters(upper: bool) -> str:
    """Ranges of a regular expression's class: letters of scripts with case, up to Armenian."""
    codes = [c for c in range(0x41, 0x588) if chr(c).isalpha() and (chr(c).isupper() if upper else chr(c).islower())] + list(range(0x1E00 + (not upper), 0x1F00, 2))
    out, start = "", codes[0]
    for at, after in zip(codes, [*codes[1:], 0]):
        if after != at + 1:
            out += chr(start) if start == at else f"{chr(start)}-{chr(at)}"
            start = after
    return out


_up, _low = _letters(True), _letters(False)
_name = rf"[{_up}](?:['’][{_up}])?[{_low}]+(?:[-'’][{_up}][{_low}]+)?"
_titles = "|".join(re.escape(t) for t in sorted({t[0].upper() + t[1:] for t in TITLES} | {t for t in TITLES if ord(t[0]) > 0x24F}, key=len, reverse=True))
_given = "|".join(re.escape(n[0].upper() + n[1:]) for names in GIVEN.values() for n in names)
_phrases = "|".join(f"[{p[0]}{p[0].upper()}]" + re.escape(p[1:]).replace("\\ ", " ") for p in INTRODUCED)
_hex = "[0-9a-fA-F]{1,4}"
#: In order: where several match at a place the first counts. No pattern walks over a character more than a few times.
PATTERNS = [
    ("email", r"(?<![\w.+-])[\w.+-]*[^\W_]@(?:[^\W_](?:[\w-]*[^\W_])?\.)+[^\W\d_]{2,24}"),
    ("ipv6", rf"(?<![\w:])(?:(?:{_hex}:){{7}}{_hex}|(?=[0-9a-fA-F:]*\d)(?:{_hex}(?::{_hex}){{0,5}})?::(?:{_hex}(?::{_hex}){{0,5}}))(?![\w:])"),
    ("ipv4", r"(?<![\w.])(?<!ersion )(?<!elease )(?<!uild )(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)"),
    ("iban", r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"),
    ("secret", r"(?<![0-9A-Za-z])(?=[0-9a-fA-F]*\d)(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![0-9A-Za-z])|(?<!\w)(?:AKIA|ASIA)[A-Z0-9]{16}(?!\w)|(?<!\w)(?:sk|pk|ghp|xox[abp])[-_][A-Za-z0-9_-]{16,}"),
    ("card", r"(?<![\w.-])\d{4}([ -]?)\d{4}\1\d{4}\1\d{1,7}(?!\w|-\d)"),
    ("ssn", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?!\w|-\d)"),
    ("phone", r"(?<![\w.])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\w)|(?<![\w.])\(\d{3}\) ?\d{3}[-. ]\d{4}(?!\w)|(?<![\w.-])\d{3}[-.]\d{3}[-.]\d{4}(?!\w|-\d)"),
    ("person", rf"(?<!\w)(?:{_titles})\.? {_name}(?: {_name})?(?!\w)|(?<!\w)(?:{_given}) {_name}(?!\w)|(?:(?<=\W)|^)(?:{_phrases}) (?P<introduced>{_name} {_name})(?!\w)"),
]
_ALL = "|".join(f"(?P<{kind}>{p})" if kind != "card" else f"(?P<card>{p.replace(chr(92) + '1', '(?P=sep)').replace('([ -]?)', '(?P<sep>[ -]?)', 1)})" for kind, p in PATTERNS)
#: Rows without such a character sequence hold no entity, one for what each pattern cannot do without: digits (of any script, as in the patterns), an at sign, prefixes of keys, hex between colons, titles, listed names, introducing phrases.
_MAY_HOLD = rf"[\p{{Nd}}@]|(?:AKIA|ASIA)[A-Z]|(?:sk|pk|ghp|xox[abp])[-_]|[a-fA-F]:[a-fA-F]{{1,4}}:|(?:{_titles})\.? |(?:{_given}) |(?:{_phrases}) "

_VOWELS = {"latin": "aeiou", "cyrillic": "аеиоуыэюя"}
_ALPHABETS = {
    "digit": "0123456789", "hex": "0123456789abcdef", "latin": "abcdefghijklmnopqrstuvwxyz", "latin_marked": "àáâãäåçèéêëìíîïñòóôõöùúûüý",
    "greek": "αβγδεζηθικλμνξοπρστυφχψω", "cyrillic": "абвгдежзийклмнопрстуфхцчшщъыьэюя",
    "latin_vowel": "aeiou", "latin_consonant": "bcdfghjklmnpqrstvwxyz", "cyrillic_vowel": "аеиоуыэюя", "cyrillic_consonant": "бвгджзйклмнпрстфхцчшщъь",
}


def _class_of(c: str, named: bool = False) -> str | None:
    """The alphabet of a lowered character, or None if it stays."""
    if named:
        for script, vowels in _VOWELS.items():
            if c in _ALPHABETS[script]:
                return f"{script}_vowel" if c in vowels else f"{script}_consonant"
    for kind in ("digit", "latin", "latin_marked", "greek", "cyrillic"):
        if c in _ALPHABETS[kind]:
            return kind
    return None


class Surrogates:
    """The keyed bijections; ``of(kind, entity)`` is the surrogate."""

    def __init__(self, key: bytes = KEY) -> None:
        self.key = hashlib.blake2b(key, digest_size=32).digest()
        self.lists: dict[tuple[str, ...], dict[str, str]] = {}
        for where, names in [*GIVEN.items(), *(((s,), n) for s, n in FAMILY.items())]:
            order = sorted(names, key=lambda n: self._hash(str((where, n)).encode(), 16))
            self.lists[tuple(where)] = dict(zip(order, order[1:] + order[:1]))  # one cycle: no name keeps itself
        self.listed = {"given": {n for names in GIVEN.values() for n in names}, "family": {n for names in FAMILY.values() for n in names}}
        self.known: dict[tuple[str, str], str] = {}

    def _hash(self, data: bytes, size: int) -> int:
        if size > 64:
            return int.from_bytes(hashlib.shake_256(self.key + data).digest(size), "big")
        return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=size).digest(), "big")

    def _network(self, a: int, b: int, m: int, n: int, tweak: bytes, sign: int = 1) -> tuple[int, int]:
        size = max(16, (max(m, n).bit_length() + 7) // 8 + 8)
        for r in range(ROUNDS) if sign > 0 else reversed(range(ROUNDS)):
            if r % 2:
                b = (b + sign * self._hash(b"%s|%d|%x" % (tweak, r, a), size)) % n
            else:
                a = (a + sign * self._hash(b"%s|%d|%x" % (tweak, r, b), size)) % m
        return a, b

    def _neighbour(self, a: int, b: int, m: int, n: int, tweak: bytes, ok: Callable[[int, int], bool], step: int = 1) -> tuple[int, int]:
        """The next (or last) value that is ``ok`` on the cycle on which the network puts all (a, b)."""
        x, y = self._network(a, b, m, n, tweak)
        at = x * n + y
        while True:
            at = (at + step) % (m * n)
            found = self._network(*divmod(at, n), m, n, tweak, -1)
            if ok(*found):
                return found

    def _image(self, a: int, b: int, m: int, n: int, tweak: bytes, ok: Callable[[int, int], bool]) -> tuple[int, int]:
        found = self._neighbour(a, b, m, n, tweak, ok)
        if self._neighbour(*found, m, n, tweak, ok, -1) != (a, b):
            raise ArithmeticError("two entities with one surrogate")
        return found

    def text(self, s: str, tweak: str, named: bool = False, alphabet: str | None = None, ok: Callable[[str], bool] | None = None) -> str:
        """The image of a lowered string among those of its shape for which ``ok`` is as for it; itself only if it is alone."""
        classes = [alphabet if alphabet and c in _ALPHABETS[alphabet] else None if alphabet else _class_of(c, named) for c in s]
        at = [i for i, k in enumerate(classes) if k]
        if not at:
            return s
        if len(at) > LONGEST:  # piece by piece, each under what came before it: still a bijection, in linear time
            out, seen = [], 0
            for i in range(0, len(s), LONGEST):
                piece = s[i : i + LONGEST]
                out.append(self.text(piece, f"{tweak}|{len(at)}|{seen}", named, alphabet))
                seen = self._hash(b"%x|%s" % (seen, piece.encode()), 16)
            return "".join(out)
        shape = f"{tweak}|{','.join(k or s[i] for i, k in enumerate(classes))}".encode()
        half = (len(at) + 1) // 2
        value, base = [0, 0], [1, 1]
        for j, i in enumerate(at):
            letters = _ALPHABETS[classes[i]]
            value[j >= half] = value[j >= half] * len(letters) + letters.index(s[i])
            base[j >= half] *= len(letters)

        def written(*value: int) -> str:
            out, value = list(s), list(value)
            for j in range(len(at) - 1, -1, -1):
                letters = _ALPHABETS[classes[at[j]]]
                value[j >= half], digit = divmod(value[j >= half], len(letters))
                out[at[j]] = letters[digit]
            return "".join(out)

        want = ok(s) if ok else None
        return written(*self._image(*value, *base, shape, lambda *v: ok is None or ok(written(*v)) == want))

    def of(self, kind: str, entity: str) -> str:
        """The surrogate: computed for the entity's canonical form, then given its punctuation and case."""
        low = entity.lower()
        lowered = low if len(low) == len(entity) else entity
        found = self.known.get((kind, entity if kind == "person" else lowered))
        if found is None:
            found = getattr(self, f"_{kind}")(entity if kind == "person" else lowered)
            if len(self.known) >= 1 << 16:
                self.known.clear()
            self.known[kind, entity if kind == "person" else lowered] = found
        if kind == "person" or len(found) != len(entity):
            return found
        return "".join(c.upper() if e.isupper() else c for c, e in zip(found, entity))

    def _email(self, s: str) -> str:
        local, _, domain = s.rpartition("@")
        host, _, top = domain.rpartition(".")
        keep = ".example" if host.endswith(".example") else ""  # reserved for examples: stays reserved
        body = host[: len(host) - len(keep)] if keep else "" if host == "example" else host
        rest = host[len(body) :]
        image = self.text(f"{local}@{body}", f"email|{rest}.{top}")
        return f"{image}{rest}.{top}"

    def _ipv4(self, s: str) -> str:
        value = int.from_bytes(bytes(int(x) for x in s.split(".")), "big")
        scope = _scope(value)
        a, b = self._image(value >> 16, value & 0xFFFF, 1 << 16, 1 << 16, b"ipv4", lambda a, b: _scope(a << 16 | b) == scope)
        return ".".join(map(str, (a << 16 | b).to_bytes(4, "big")))

    def _ipv6(self, s: str) -> str:
        """Groups keep their lengths without leading zeros, and zero groups stay, so short and long forms of an address agree."""
        left, gap, right = s.partition("::")
        groups = [left.split(":") if left else [], right.split(":") if right else []]
        full = [*groups[0], *["0"] * (8 - len(groups[0]) - len(groups[1])), *groups[1]] if gap else groups[0]
        bare = [g.lstrip("0") for g in full]
        body = ":".join(bare)
        image = iter([g for g in self.text(body, "ipv6", alphabet="hex", ok=lambda x: not any(g.startswith("0") for g in x.split(":"))).split(":") if g])
        put = lambda g: g if not g.strip("0") else "0" * (len(g) - len(g.lstrip("0"))) + next(image)
        out = [":".join(put(g) for g in part) for part in groups]
        return out[0] + gap + out[1]

    def _digits(self, s: str, tweak: str, ok: Callable[[str], bool] | None = None, head: int = 0) -> str:
        """Bijection on the digits behind the first ``head``, which stay; separators are put back."""
        bare = re.sub(r"\D", "", s)
        image = iter(bare[:head] + self.text(bare[head:], f"{tweak}|{bare[:head]}", ok=ok))
        return "".join(next(image) if c.isdigit() else c for c in s)

    def _card(self, s: str) -> str:
        bare = re.sub(r"\D", "", s)
        body = self.text(bare[:-1], "card")
        image = iter(body + next(d for d in "0123456789" if luhn(body + d)))
        return "".join(next(image) if c.isdigit() else c for c in s)

    def _ssn(self, s: str) -> str:
        return self._digits(s, "ssn", ok=lambda d: d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000")

    def _phone(self, s: str) -> str:
        country = re.match(r"\+(1(?=\D|\d{10}$)|\d{1,3})", s)
        head = len(country[1]) if country else 0
        bare = re.sub(r"\D", "", s)
        if len(bare) - head < 4:
            head = 0
        ok = lambda d: d[0] not in "01"
        if len(bare) - head == 10 and bare[:head] in ("", "1"):  # one number with and without its country
            image = iter(bare[:head] + self.text(bare[head:], "phone|ten digits", ok=ok))
            return "".join(next(image) if c.isdigit() else c for c in s)
        return self._digits(s, "phone", ok=ok, head=head)

    def _iban(self, s: str) -> str:
        bare = s.replace(" ", "")
        valid = iban_ok(bare)
        body = self.text(bare[4:], f"iban|{bare[:2]}")
        if valid:
            checks = next(f"{n:02d}" for n in range(2, 99) if iban_ok(f"{bare[:2]}{n:02d}{body}"))
            bare = bare[:2] + checks + body
        else:
            bare = bare[:2] + self.text(bare[2:], f"iban-unchecked|{bare[:2]}", ok=lambda x: iban_ok(bare[:2] + x))
        image = iter(bare)
        return "".join(" " if c == " " else next(image) for c in s)

    def _secret(self, s: str) -> str:
        if re.fullmatch("[0-9a-f]+", s):
            return self.text(s, "secret", alphabet="hex")
        head = re.match(r"(?:akia|asia|[a-z]+[-_])", s)
        return s[: head.end()] + self.text(s[head.end() :], f"secret|{head[0]}") if head else self.text(s, "secret")

    def _person(self, s: str) -> str:
        words = s.split(" ")
        gender, kept = "", []
        if words[0].rstrip(".").lower() in TITLES:
            gender, kept = TITLES[words[0].rstrip(".").lower()], words[:1]
            words = words[1:]
        given, family = (words[:-1], words[-1:]) if len(words) > 1 else ([], words)
        if len(words) == 1 and words[0].lower() in self.listed["given"] - self.listed["family"]:
            given, family = words, []
        out = [self._name(w, "given", gender) for w in given] + [self._name(w, "family", "") for w in family]
        return " ".join(kept + out)

    def _name(self, word: str, part: str, gender: str) -> str:
        low = word.lower()
        if part == "given":
            options = [k for k in GIVEN if low in self.lists[k]]
            options = [k for k in options if not gender or k[0] == gender] or options
            image = self.lists[options[0]][low] if options else None
        else:
            image = next((self.lists[s,][low] for s in FAMILY if low in self.lists[s,]), None)
        if image is None:  # a marked letter moves among marked ones, others keep being vowels or consonants
            image = self.text(low, part, named=True, ok=lambda x: x in self.listed[part])
        same = len(image) == len(word)
        return "".join(c.upper() if word[i].isupper() else c for i, c in enumerate(image)) if same else image[:1].upper() + image[1:]


def _scope(ip: int) -> int:
    """0 public, 1 private, 2 other reserved addresses."""
    a, b = ip >> 24, ip >> 16 & 255
    if a == 10 or (a, b) == (192, 168) or (a == 172 and 16 <= b < 32):
        return 1
    return 2 if a in (0, 127) or a >= 224 or (a, b) == (169, 254) else 0


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def iban_ok(bare: str) -> bool:
    return int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1


def find(text: str, pattern: re.Pattern | None = None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of each entity, in order, without overlaps; numbers of cards must have the right check digit."""
    found = []
    for m in (pattern or re.compile(_ALL)).finditer(text):
        kind = m.lastgroup if m.lastgroup not in ("sep", "introduced") else {"sep": "card", "introduced": "person"}[m.lastgroup]
        if kind == "card" and not luhn(re.sub(r"\D", "", m[0])):
            continue
        found.append((kind, m.start("introduced") if m["introduced"] else m.start(), m.end()))
    return found


def replace(text: str, surrogates: Surrogates, pattern: re.Pattern | None = None) -> tuple[str, list[tuple[str, str, str]]]:
    """The text with surrogates, and (kind, entity, surrogate) of each."""
    out, at, made = [], 0, []
    for kind, a, b in find(text, pattern):
        image = surrogates.of(kind, text[a:b])
        out += [text[at:a], image]
        made.append((kind, text[a:b], image))
        at = b
    return "".join(out) + text[at:], made


def canonical(kind: str, entity: str) -> str:
    """What all ways to write an entity share: lower case, digits without separators, phones without +1."""
    s = unicodedata.normalize("NFC", entity.lower())
    if kind == "phone":
        bare = re.sub(r"\D", "", s)
        return bare[1:] if len(bare) == 11 and s.startswith("+1") else bare
    if kind == "ipv6":
        left, gap, right = s.partition("::")
        a, b = (x.split(":") if x else [] for x in (left, right))
        return ":".join(g.lstrip("0") for g in ([*a, *["0"] * (8 - len(a) - len(b)), *b] if gap else a))
    return re.sub(r"\D", "", s) if kind in ("card", "ssn") else s.replace(" ", "") if kind == "iban" else s


def _collisions(made: list[tuple[str, str, str]]) -> int:
    """Entities of a document that share a surrogate, and such as have several."""
    pairs = {(k, canonical(k, a), canonical(k, b)) for k, a, b in made}
    return 2 * len(pairs) - len({(k, a) for k, a, _ in pairs}) - len({(k, b) for k, _, b in pairs})


def pseudonymize(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """(doc_id, text, n_entities, kinds, n_collisions) of every row, in which entities are replaced.

    ``kinds``: the kinds found, sorted, joined by commas. ``n_collisions``:
    0, or how many of the row's entities lost distinctness or coreference. A
    null text stays null; a text without entities stays as it is, byte for
    byte. Rows are rewritten one by one, whole, so repeated rows give equal
    results and null ids make no difference; other columns are not read. A
    map: nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        surrogates, pattern = Surrogates(key), re.compile(_ALL)
        for batch in batches:
            texts = batch.column(1)
            may = np.flatnonzero(pc.fill_null(pc.match_substring_regex(texts, _MAY_HOLD), False).to_numpy(zero_copy_only=False))
            count, clash, kinds, changed, where = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int32), np.full(batch.num_rows, "", object), [], np.zeros(batch.num_rows, bool)
            for i, text in zip(may.tolist(), texts.take(pa.array(may)).to_pylist()):
                new, made = replace(text, surrogates, pattern)
                if made:
                    count[i], clash[i], kinds[i], where[i] = len(made), _collisions(made), ",".join(sorted({k for k, _, _ in made})), True
                    changed.append(new)
            out = pc.replace_with_mask(texts, pa.array(where), pa.array(changed, texts.type)) if changed else texts
            yield pa.RecordBatch.from_arrays([batch.column(0), out, pa.array(count), pa.array(kinds, pa.string()), pa.array(clash)], names=["doc_id", "text", "n_entities", "kinds", "n_collisions"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, RESULT)


def entities(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """Distinct (kind, entity, surrogate) in canonical form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        surrogates, pattern = Surrogates(key), re.compile(_ALL)
        for batch in batches:
            found = {(k, canonical(k, a), canonical(k, b)) for text in batch.column(0).to_pylist() if text for k, a, b in replace(text, surrogates, pattern)[1]}
            cols = list(zip(*sorted(found))) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["kind", "entity", "surrogate"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "kind string, entity string, surrogate string").distinct()


def collisions(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """Surrogates that stand for several entities, or entities with several surrogates: none, if all is well."""
    pairs = entities(docs, key)
    shared = pairs.groupBy("kind", F.col("surrogate").alias("value")).agg(F.countDistinct("entity").alias("n"))
    split = pairs.groupBy("kind", F.col("entity").alias("value")).agg(F.countDistinct("surrogate").alias("n"))
    return shared.unionByName(split).where("n > 1")


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymize(spark.read.parquet(f"{sf_dir}/documents.parquet"))
