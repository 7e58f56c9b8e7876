"""Personal data: detected entities get keyed surrogates of the same type and format.

A surrogate depends on a secret key, the kind, the normal form of the entity and an attempt
number, so each occurrence of an entity gets the same one in every document. A distributed
check over all distinct entities raises the attempt of those that would share a surrogate
or hit a real entity, until all are distinct.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.session import cut

# Titles by gender, and given names and name syllables by script.
TITLES = {
    "m": ["Mr", "Mister", "Herr", "Señor", "Sr", "Monsieur", "господин", "κύριος"],
    "f": ["Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "госпожа", "κυρία"],
    "x": ["Dr", "Prof"],
}
GIVEN = {
    "m": "James John Robert Michael William David Richard Thomas Charles Daniel Peter Hans Karl Jean Pierre Louis Juan José Carlos Luis Иван Пётр Николай Γιώργος Νίκος".split(),
    "f": "Mary Patricia Jennifer Linda Elizabeth Susan Jessica Sarah Karen Anna Maria Marie Julia Claire Sophie Carmen Lucía Elena Анна Мария Ольга Μαρία Ελένη".split(),
}
SYLLABLES = {
    "LATIN": "ba be bi bo da de di do fa fe ga ge ka ke ki ko la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se si so ta te ti to va ve vi vo za ze".split(),
    "CYRILLIC": "ба бе би бо да де ди до ка ке ки ко ла ле ли ло ма ме ми мо на не ни но па пе ра ре ри ро са се си со та те ти то ва ве ви во за зе".split(),
    "GREEK": "βα βε βι βο δα δε δι δο κα κε κι κο λα λε λι λο μα με μι μο να νε νι νο πα πε ρα ρε ρι ρο σα σε σι σο τα τε τι το".split(),
}
ENDINGS = {"LATIN": {"m": "n", "f": "a", "x": "r"}, "CYRILLIC": {"m": "н", "f": "а", "x": "р"}, "GREEK": {"m": "ς", "f": "α", "x": "ρ"}}

_TITLE_GENDER = {t.lower(): g for g, ts in TITLES.items() for t in ts}
_GIVEN_GENDER = {n.lower(): g for g, ns in GIVEN.items() for n in ns}
_TITLE = "|".join(sorted((re.escape(t) for ts in TITLES.values() for t in ts), key=len, reverse=True))
_NAME = r"[^\W\d_a-zа-яα-ω][^\W\d_]+"
_GIVEN = "|".join(sorted((re.escape(n) for ns in GIVEN.values() for n in ns), key=len, reverse=True))
PATTERNS = [
    ("secret", re.compile(r"\b(?:token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key)\b[\"']?\s*[:=]\s*[\"']?([A-Za-z0-9+/_\-]{12,}={0,2})", re.I)),
    ("email", re.compile(r"[\w.%+\-]{1,64}@[\w\-]+(?:\.[\w\-]+)+")),
    ("iban", re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")),
    ("ssn", re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])")),
    ("ip", re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)")),
    ("phone", re.compile(r"(?:\+\d{1,3}[ .\-]?)?\(\d{2,4}\)[ .\-]?\d{3,4}[ .\-]?\d{3,4}(?!\d)|\+\d{1,3}(?:[ .\-]?\d{2,4}){2,5}(?!\d)")),
    ("card", re.compile(r"(?<![\d.])\d(?:[ \-]?\d){12,18}(?!\d)")),
    ("phone", re.compile(r"(?<![\d.\-])\d{3}[ .\-]\d{3}[ .\-]\d{4}(?![\d\-])")),
    ("person", re.compile(rf"\b(?:(?:{_TITLE})\.? (?:{_NAME})(?: {_NAME})?|(?:{_GIVEN}) {_NAME})")),
]
_TRIGGER = re.compile(r"[0-9@]")
_SECRET_WORD = re.compile("token|secret|passw|key", re.I)
_TITLE_WORDS = [t + end for ts in TITLES.values() for t in ts for end in (" ", ". ")] + [n + " " for ns in GIVEN.values() for n in ns]
# Entities whose attempt isn't 0 are broadcast up to this many; beyond, they are joined.
BROADCAST_ROWS = 200_000


def _name_parts(found: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the names in a titled or given name; the title stays."""
    words = [(m.group().rstrip("."), m.start(), m.end()) for m in re.finditer(r"\S+", found)]
    gender = "x"
    if words[0][0].lower() in _TITLE_GENDER:
        gender = _TITLE_GENDER[words[0][0].lower()]
        words = words[1:]
    given = _GIVEN_GENDER.get(words[0][0].lower())
    if len(words) == 1 and given is None:
        return [("family", words[0][1], words[0][2])]
    first = f"given_{given or gender}"
    return [(first, words[0][1], words[0][2]), *[("family", s, e) for _, s, e in words[1:]]]


def find_entities(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) in order; earlier patterns win where two overlap."""
    if not text:
        return []
    numbers = _TRIGGER.search(text) is not None
    names = any(t in text for t in _TITLE_WORDS)
    if not numbers and not names and not (("=" in text or ":" in text) and _SECRET_WORD.search(text)):
        return []
    found: list[tuple[int, int, str]] = []
    taken = bytearray(len(text))
    for kind, pattern in PATTERNS:
        if (kind == "email" and "@" not in text) or (kind == "person" and not names) or (kind not in ("email", "person", "secret") and not numbers):
            continue
        for m in pattern.finditer(text):
            start, end = m.span(1) if m.re.groups else m.span()
            if any(taken[start:end]):
                continue
            taken[start:end] = b"\1" * (end - start)
            if kind == "person":
                found += [(start + s, start + e, k) for k, s, e in _name_parts(m.group())]
            else:
                found.append((start, end, kind))
    return sorted(found)


def normal_form(kind: str, value: str) -> str:
    """What makes two spellings one entity."""
    if kind in ("phone", "card", "ssn"):
        return re.sub(r"\D", "", value)
    if kind == "iban":
        return value.replace(" ", "")
    if kind == "ip":
        return ".".join(str(int(x)) for x in value.split("."))
    return unicodedata.normalize("NFC", value).lower()


class _Draw:
    """An endless stream of numbers from a key and a message."""

    def __init__(self, key: bytes, message: str):
        self.key, self.message, self.block, self.pool = key, message.encode("utf-8", "surrogatepass"), 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 4:
            self.pool += hmac.new(self.key, self.message + b"\0" + str(self.block).encode(), hashlib.sha256).digest()
            self.block += 1
        value, self.pool = int.from_bytes(self.pool[:4], "big"), self.pool[4:]
        return value % n


def script_of(value: str) -> str:
    first = next((c for c in value if c.isalpha()), "a")
    name = unicodedata.name(first, "LATIN")
    return next((s for s in SYLLABLES if name.startswith(s)), "LATIN")


def _luhn(digits: str) -> int:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _like(draw: _Draw, value: str) -> str:
    """A string with the same kinds of characters in the same places."""
    hexadecimal = re.fullmatch(r"[0-9a-f]+", value) and re.search(r"\d", value)
    out = []
    for c in value:
        if hexadecimal:
            out.append("0123456789abcdef"[draw.below(16)])
        elif c.isdigit():
            out.append(str(draw.below(10)))
        elif c.isalpha():
            syllables = SYLLABLES[script_of(c)]
            small = "abcdefghijklmnopqrstuvwxyz" if c.isascii() else "".join(sorted(set("".join(syllables))))
            x = small[draw.below(len(small))]
            out.append(x.upper() if c.isupper() else x)
        else:
            out.append(c)
    return "".join(out)


def surrogate_form(key: bytes, kind: str, normal: str, attempt: int = 0) -> str:
    """Normal form of an entity's surrogate. Later attempts draw from larger spaces where a
    format leaves room for longer values."""
    draw = _Draw(key, f"{kind}\0{normal}\0{attempt}")
    more = attempt // 4
    if kind == "card":
        body = str(1 + draw.below(9)) + "".join(str(draw.below(10)) for _ in normal[2:])
        valid = _luhn(normal[:-1]) == int(normal[-1])
        check = _luhn(body)
        return body + str(check if valid else (check + 1 + draw.below(9)) % 10)
    if kind == "phone":
        keep = 1 if len(normal) >= 11 else 0
        return normal[:keep] + str(2 + draw.below(8)) + "".join(str(draw.below(10)) for _ in normal[keep + 1 :])
    if kind == "ssn":
        # Areas from 900 are never given out.
        return ("9" if attempt < 16 else str(draw.below(10))) + "".join(str(draw.below(10)) for _ in range(8))
    if kind == "ip":
        # The reserved block first; it holds 2**28 addresses.
        top = 240 + draw.below(16) if attempt < 16 else 1 + draw.below(255)
        return ".".join(str(x) for x in (top, *(draw.below(256) for _ in range(3))))
    if kind == "iban":
        body = "".join(str(draw.below(10)) if c.isdigit() else chr(65 + draw.below(26)) for c in normal[4:])
        number = "".join(str(int(c, 36)) for c in body + normal[:2] + "00")
        return f"{normal[:2]}{98 - int(number) % 97:02d}{body}"
    if kind == "email":
        local, _, domain = normal.partition("@")
        host = _Draw(key, f"domain\0{domain}")
        label = "".join(SYLLABLES["LATIN"][host.below(len(SYLLABLES["LATIN"]))] for _ in range(3))
        extra = "".join(str(draw.below(10)) for _ in range(4 * more))
        return f"{_like(draw, local)}{extra}@{label}.example.{('com', 'net', 'org')[host.below(3)]}"
    if kind == "family" or kind.startswith("given"):
        script = script_of(normal)
        gender = kind[-1] if kind.startswith("given") else None
        syllables = SYLLABLES[script]
        name = "".join(syllables[draw.below(len(syllables))] for _ in range(3 + more))
        return name + (ENDINGS[script][gender] if gender else "")
    return _like(draw, normal) + "".join(str(draw.below(10)) for _ in range(8 * more))


def dress(kind: str, original: str, form: str) -> str:
    """A surrogate's normal form with the punctuation and letter case of the original."""
    if kind in ("phone", "card", "ssn", "iban"):
        chars = iter(form)
        return "".join(next(chars) if c.isalnum() else c for c in original)
    if kind == "ip":
        return form
    if original.isupper():
        return form.upper()
    if kind == "family" or kind.startswith("given"):
        return form[:1].upper() + form[1:]
    if len(form) == len(original) and kind == "secret":
        return "".join(a.upper() if b.isupper() else a for a, b in zip(form, original, strict=True))
    return form


def replace_entities(text: str | None, key: bytes, attempts: dict[tuple[str, str], int]) -> tuple[str | None, list[str]]:
    """The text with surrogates in place of its entities, and the kinds that were replaced."""
    spans = find_entities(text)
    if not spans:
        return text, []
    out, at = [], 0
    for start, end, kind in spans:
        value = text[start:end]
        normal = normal_form(kind, value)
        out += [text[at:start], dress(kind, value, surrogate_form(key, kind, normal, attempts.get((kind, normal), 0)))]
        at = end
    return "".join([*out, text[at:]]), [k for _, _, k in spans]


def distinct_entities(docs: DataFrame, text: str = "text") -> DataFrame:
    """(kind, normal) of all entities; each batch sends one of its repeats."""

    def run(batches):
        for b in batches:
            found = {(k, normal_form(k, t[s:e])) for t in b.column(0).to_pylist() for s, e, k in find_entities(t)}
            rows = sorted(found)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], names=["kind", "normal"])

    return docs.select(text).mapInArrow(run, "kind string, normal string").distinct()


def settle(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, normal, attempt, form) with distinct forms within a kind, none a real entity.

    Each round redraws the losers: of entities with one form the one settled first, then the
    smallest, keeps it. All groups are combined before the shuffle and all steps are joins on
    (kind, form), so a round costs a few passes over the entities; expected losers fall fast.
    """
    schema = "kind string, normal string, attempt int, form string"

    def draw(batches):
        for b in batches:
            kinds, normals, attempts = (b.column(i).to_pylist() for i in range(3))
            forms = [surrogate_form(key, k, n, a) for k, n, a in zip(kinds, normals, attempts, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(forms, pa.string())], names=["kind", "normal", "attempt", "form"])

    state = cut(entities.select("kind", "normal", F.lit(0).alias("attempt")).mapInArrow(draw, schema))
    while True:
        best = state.groupBy("kind", "form").agg(F.min(F.struct("attempt", "normal")).alias("best"), F.count("*").alias("n"))
        shared = best.where("n > 1").select("kind", "form", F.col("best.normal").alias("winner"))
        real = state.select("kind", F.col("normal").alias("form"), F.lit(True).alias("real"))
        marked = state.join(shared, ["kind", "form"], "left").join(real, ["kind", "form"], "left")
        loses = F.coalesce(F.col("real"), F.lit(False)) | (F.col("winner").isNotNull() & (F.col("winner") != F.col("normal")))
        marked = cut(marked.select("kind", "normal", "attempt", "form", loses.alias("loses")))
        if not marked.where("loses").take(1):
            return marked.drop("loses")
        again = marked.where("loses").select("kind", "normal", (F.col("attempt") + 1).alias("attempt")).mapInArrow(draw, schema)
        state = cut(marked.where("not loses").drop("loses").unionByName(again))


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text", added: bool = True, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` with surrogates in its texts; ``added`` adds pii_kinds, the kinds replaced in order.

    Texts are rewritten where they lie, without a shuffle, given the attempts above 0 as a
    broadcast of checked size; when there are more, each text is joined with its own. Null
    and empty texts stay as they are, repeated rows get equal texts, an empty table stays
    empty. Other columns pass through; an input column pii_kinds is replaced.
    """
    settled = settle(distinct_entities(docs, text), key)
    odd = settled.where("attempt > 0").select("kind", "normal", "attempt")
    head = odd.take(broadcast_rows + 1)
    columns = [c for c in docs.columns if c != "pii_kinds"]
    df = docs.select(*[F.col(f"`{c}`") for c in columns])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", pii_kinds array<string>"
    place = columns.index(text)

    def rewritten(b, attempts_of):
        texts, kinds = [], []
        for i, t in enumerate(b.column(place).to_pylist()):
            new, found = replace_entities(t, key, attempts_of(i))
            texts.append(new)
            kinds.append(found)
        arrays = list(b.columns[: len(columns)])
        arrays[place] = pa.array(texts, pa.string())
        return pa.RecordBatch.from_arrays([*arrays, pa.array(kinds, pa.list_(pa.string()))], names=[*columns, "pii_kinds"])

    if len(head) <= broadcast_rows:
        shared = docs.sparkSession.sparkContext.broadcast({(r.kind, r.normal): r.attempt for r in head})
        out = df.mapInArrow(lambda batches: (rewritten(b, lambda _: shared.value) for b in batches), fields)
    else:
        hashed = df.select(F.xxhash64(text, F.lit(1)).alias("_x"), F.xxhash64(F.lit(2), text).alias("_y"), F.col(text).alias("_text"))

        def entities(batches):
            for b in batches:
                rows = sorted({(x, y, k, normal_form(k, t[s:e])) for x, y, t in zip(*[c.to_pylist() for c in b.columns], strict=True) for s, e, k in find_entities(t)})
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64() if i < 2 else pa.string()) for i in range(4)], names=["_x", "_y", "kind", "normal"])

        found = hashed.mapInArrow(entities, "_x bigint, _y bigint, kind string, normal string").distinct()
        mine = found.join(odd, ["kind", "normal"]).groupBy("_x", "_y").agg(F.collect_list(F.struct("kind", "normal", "attempt")).alias("_odd"))
        keyed = df.withColumns({"_x": F.xxhash64(text, F.lit(1)), "_y": F.xxhash64(F.lit(2), text)}).join(mine, ["_x", "_y"], "left").select(*columns, "_odd")

        def own(batches):
            for b in batches:
                odds = b.column(len(columns)).to_pylist()
                yield rewritten(b, lambda i, odds=odds: {(o["kind"], o["normal"]): o["attempt"] for o in odds[i] or []})

        out = keyed.mapInArrow(own, fields)
    return out if added else out.drop("pii_kinds")
