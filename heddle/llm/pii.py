"""Personal data and secrets: keyed, type-consistent surrogates with checked distinctness.

Detection is by format (mail addresses, IPv4, card and account numbers, phone numbers, social security numbers, IBANs, assigned secrets,
titled person names). An entity has a canonical form (case, spaces and punctuation removed), so that its spellings corefer: its surrogate is
a keyed function of type and canonical form, laid over each occurrence's own format: digits stay digits, letters stay letters of the same
case and of their script where one is known (else Latin), card numbers keep a valid check digit where the original had one, names keep the gender of their title.

Distinctness: all canonical forms of the corpus are gathered, without texts, in a distributed distinct. Surrogates that two entities
share, or that equal some real entity, are drawn again with the next attempt number for all but the smallest of the entities, until none is left.
Names grow with each attempt, everything else from the third draw on by a letter or digit a draw (addresses move on to larger ranges), so that short formats, all of whose values the
corpus may hold, do not run out. Who keeps a surrogate is a map-side combined minimum, so no task gathers the entities of one. Only entities
with an attempt over 0 need to travel to the rewriting stage: as a broadcast while few, else joined to the rows that hold them.

Defined cases. Null text stays null. Empty text and text without entities stay as they are. Rows are independent of their ids, so null or
repeated ids and any extra columns pass through. A column named like ``count_col`` is replaced by the count, when one is asked for.
"""

from __future__ import annotations

import hashlib
import hmac
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize

BROADCAST_ROWS = 200_000

#: Given and family names for surrogates, by gender and script.
NAMES = {
    ("m", "latin"): ["Adrian", "Bruno", "Carl", "Dario", "Emil", "Felix", "Gregor", "Hugo", "Ivan", "Jonas", "Karel", "Leon", "Marco", "Nils", "Oscar", "Pavel"],
    ("f", "latin"): ["Alma", "Bianca", "Clara", "Daria", "Elena", "Freya", "Greta", "Hanna", "Iris", "Julia", "Klara", "Laura", "Marta", "Nina", "Olga", "Paula"],
    ("m", "cyrillic"): ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Игорь", "Кирилл"],
    ("f", "cyrillic"): ["Алина", "Вера", "Галина", "Дарья", "Елена", "Ирина", "Лидия", "Нина"],
    ("family", "latin"): ["Albers", "Brandt", "Castel", "Duarte", "Ekholm", "Farago", "Gomes", "Hartog", "Ibsen", "Jansky", "Keller", "Lindner", "Moreau", "Novak", "Olsen", "Prieto"],
    ("family", "cyrillic"): ["Белов", "Громов", "Зимин", "Котов", "Лебедев", "Морозов", "Орлов", "Соколов"],
}
NAMES |= {
    ("m", "greek"): ["Αλεξανδρος", "Γιαννης", "Κωστας", "Νικος", "Πετρος", "Σπυρος"],
    ("f", "greek"): ["Αννα", "Ελενη", "Ιωαννα", "Μαρια", "Νικη", "Σοφια"],
    ("family", "greek"): ["Αντωνιου", "Βασιλειου", "Γεωργιου", "Δημου", "Λαμπρου", "Παυλου"],
}
NAMES |= {("n", script): NAMES["m", script] + NAMES["f", script] for script in ("latin", "cyrillic", "greek")}
#: Letters of the syllables that family names get.
SYLLABLES = {"latin": ("bdfghklmnprstvwz", "aeio"), "cyrillic": ("бвгдзклмнпрстфхч", "аеио"), "greek": ("βγδζκλμνπρστφχ", "αειο")}
MALE = {"mr", "herr", "señor", "sr", "monsieur", "г-н"}
FEMALE = {"mrs", "ms", "miss", "frau", "señora", "sra", "mme", "madame", "г-жа"}

MAIL = re.compile(r"(?<![\w.+%-])[\w.+%-]+@[\w-]+(?:\.[\w-]+)*\.(?:[A-Za-z]{2,}|[^\W\d_]{2,})")
IP = re.compile(r"(?<![\d.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?!\.?\d)")
PHONE = re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\w.+-])\d{3}[ .-]\d{3}[ .-]\d{4}(?![\d.-]*\d)")
CARD = re.compile(r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w]|[.-]\d)")
SSN = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")
IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
SECRET = re.compile(r"(?i)(?<!\w)(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)\s*[=:]\s*[\"']?([A-Za-z0-9_/+-]{12,})")
#: A letter with its marks, and a word of letters with apostrophes and hyphens inside.
_L = "[^\\W\\d_][\u0300-\u036f]*"
_NAME = rf"(?:{_L})+(?:['’-](?:{_L})+)*"
PERSON = re.compile(rf"(?<!\w)(Mr|Mrs|Ms|Miss|Herr|Frau|Señora|Señor|Sra|Sr|Monsieur|Madame|Mme|Dr|Prof|г-н|г-жа)\.?[ \u00a0]+({_NAME}(?: {_NAME})?)")
_DIGIT = re.compile(r"\d")
_PLAIN = re.compile(r"[^0-9A-Za-zÀ-ɏ]")
#: Scripts by their letters, in order of code points: where a letter lies, and the letters that stand for it.
SCRIPTS = [
    ("latin", 0x00AA, 0x024F, "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþ"), ("greek", 0x0370, 0x03FF, "αβγδεζηθικλμνξοπρστυφχψω"), ("cyrillic", 0x0400, 0x052F, "абвгдежзийклмнопрстуфхцчшщъыьэюя"), ("armenian", 0x0531, 0x0586, range(0x0561, 0x0586)),
    ("hebrew", 0x05D0, 0x05EA, range(0x05D0, 0x05EB)), ("arabic", 0x0620, 0x06D3, range(0x0628, 0x063B)), ("devanagari", 0x0904, 0x097F, range(0x0915, 0x0929)), ("bengali", 0x0985, 0x09B9, range(0x0995, 0x09A9)), ("tamil", 0x0B83, 0x0BB9, "கஙசஞடணதநனபமயரறலளழவ"),
    ("thai", 0x0E01, 0x0E30, range(0x0E01, 0x0E2F)), ("georgian", 0x10D0, 0x10FF, range(0x10D0, 0x10F1)), ("latin", 0x1E00, 0x1EFF, "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþ"), ("greek", 0x1F00, 0x1FFF, "αβγδεζηθικλμνξοπρστυφχψω"),
    ("kana", 0x3041, 0x30FA, range(0x304B, 0x3060)), ("han", 0x3400, 0x9FFF, range(0x4E00, 0x9FA6)), ("hangul", 0xAC00, 0xD7A3, range(0xAC00, 0xD7A4)),
]


def script_of(c: str) -> tuple[str, str | range] | None:
    """The script of a letter beyond a-z, with the letters that stand for it."""
    p = ord(c)
    return next(((name, letters) for name, low, high, letters in SCRIPTS if low <= p <= high), None)


def low(text: str) -> str:
    """Lower case, letter for letter."""
    new = text.lower()
    return new if len(new) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return total % 10 == 0


def find(text: str) -> list[tuple[int, int, str, str]]:
    """Entities of a text as ``(start, end, type, canonical form)``, in order, without overlaps; earlier types win."""
    out: list[tuple[int, int, str, str]] = []

    def add(found: list[tuple[int, int, str, str]]) -> None:
        """Merges finds of one type, which come in order, where nothing earlier lies."""
        nonlocal out
        free, i = [], 0
        for x in found:
            while i < len(out) and out[i][1] <= x[0]:
                i += 1
            if i == len(out) or x[1] <= out[i][0]:
                free.append(x)
        out = sorted(out + free) if free else out

    if "=" in text or ":" in text:
        add([(*m.span(1), "secret", m[1].lower()) for m in SECRET.finditer(text) if _DIGIT.search(m[1])])
    if "@" in text:
        add([(*m.span(), "mail", low(m[0])) for m in MAIL.finditer(text)])
    if _DIGIT.search(text):
        for kind, pattern in (("ip", IP), ("iban", IBAN), ("ssn", SSN), ("card", CARD), ("phone", PHONE)):
            add([(*m.span(), kind, m[0] if kind == "ip" else _PLAIN.sub("", m[0]).upper()) for m in pattern.finditer(text)])
    people = []
    for m in PERSON.finditer(text):
        words = m[2].split(" ")
        named = [w[0].isupper() and any(c.islower() for c in w) for w in words]
        if not named[0]:
            continue
        name = m[2] if all(named) else words[0]
        gender = "m" if m[1].lower() in MALE else "f" if m[1].lower() in FEMALE else "n"
        found = {(script_of(c) or ("latin",))[0] for c in name if c.isalpha()}
        script = next((x for x in ("cyrillic", "greek") if x in found), "latin")
        people.append((m.start(2), m.start(2) + len(name), f"person-{gender}-{script}", low(name)))
    add(people)
    return out


class Stream:
    """Keyed pseudo-random numbers for one entity and attempt."""

    def __init__(self, key: bytes, kind: str, canon: str, attempt: int):
        self.seed = hmac.new(key, f"{kind}\0{canon}\0{attempt}".encode(), hashlib.sha256).digest()
        self.pool, self.turn = int.from_bytes(self.seed, "big"), 0

    def below(self, n: int) -> int:
        if self.pool < 1 << 40:
            self.turn += 1
            self.pool = int.from_bytes(hashlib.sha256(self.seed + self.turn.to_bytes(4, "big")).digest(), "big")
        self.pool, r = divmod(self.pool, n)
        return r


def _letter(c: str, s: Stream, hexa: bool) -> str:
    """Another letter for a letter, in lower case; marks of other kinds stay."""
    if "a" <= c <= "z":
        return "abcdef"[s.below(6)] if hexa else chr(97 + s.below(26))
    if not c.isalnum():
        return c
    if c.isdigit():
        return str(s.below(10))
    letters = (script_of(c) or ("", ""))[1]
    if not letters:
        return chr(97 + s.below(26))
    new = letters[s.below(len(letters))]
    return chr(new) if isinstance(new, int) else new


#: Draws of a format's own length before it grows.
SAME_LENGTH = 2


def surrogate(key: bytes, kind: str, canon: str, attempt: int = 0) -> str:
    """The canonical form of the replacement: same type, length (but for late attempts) and character classes, or a name of the same gender and script."""
    s = Stream(key, kind, canon, attempt)
    more = max(0, attempt + 1 - SAME_LENGTH)
    if kind.startswith("person"):
        _, gender, script = kind.split("-")
        names, family = NAMES[gender, script], NAMES["family", script]
        words = canon.split(" ")
        new = ([names[s.below(len(names))]] if len(words) > 1 else []) + [family[s.below(len(family))]]
        first, second = SYLLABLES[script]
        for _ in range(attempt + (1 if len(words) > 1 else 2)):  # each attempt has a syllable more, so there is no end of names
            new[-1] += first[s.below(len(first))] + second[s.below(len(second))]
        return " ".join(new).lower()
    if kind == "ip":
        lead = 10 if attempt == 0 else 240 + s.below(15) if attempt < 3 else 1 + s.below(254)
        return ".".join([str(lead), *(str(s.below(256)) for _ in range(3))])
    if kind == "mail":
        local, _, domain = canon.partition("@")
        name = "".join(str(s.below(10)) if c.isdigit() else _letter(c, s, False) for c in local) + "".join(chr(97 + s.below(26)) for _ in range(more))
        host, dot, last = domain.rpartition(".")
        return name + "@" + "".join(str(s.below(10)) if c.isdigit() else _letter(c, s, False) for c in host) + dot + last
    hexa = kind == "secret" and re.fullmatch(r"[0-9a-f]+", canon) is not None
    out = [str(s.below(10)) if c.isdigit() else _letter(c.lower(), s, hexa) for c in canon] + [str(s.below(10)) for _ in range(more)]
    if kind == "phone":
        lead = max(0, len(canon) - 10)  # the country part stays
        out[:lead] = canon[:lead]
    if kind == "iban":
        out[:2] = canon[:2].lower()
    if kind == "card" and luhn(canon):
        out[-1] = next(d for d in "0123456789" if luhn("".join(out[:-1]) + d))
    if kind == "ssn":
        out[0] = "9"
    if kind in ("card", "iban", "ssn", "phone"):
        return "".join(out).upper()
    return "".join(out)


def lay_over(kind: str, original: str, canon: str) -> str:
    """The replacement in the format of an occurrence: its case, spaces and punctuation."""
    if kind.startswith("person"):
        return " ".join(w[:1].upper() + w[1:] for w in canon.split(" "))
    if kind == "ip":
        return canon
    if kind == "mail":
        old, new = original.partition("@"), canon.partition("@")
        return "@".join(_cased(a, b, every=True) for a, b in ((old[0], new[0]), (old[2], new[2])))
    return _cased(original, canon, every=kind == "secret")


def _cased(original: str, canon: str, every: bool) -> str:
    """``canon`` over an occurrence: all of its characters, or letters and digits only; what is longer follows."""
    it, out = iter(canon), []
    for c in original:
        if every or _PLAIN.match(c) is None:
            n = next(it, "")
            big = n.upper() if c.isupper() else n
            out.append(big if len(big) == len(n) else n)
        else:
            out.append(c)
    return "".join([*out, *it])


def rewrite(text: str, key: bytes, attempts: dict[tuple[str, str], int]) -> tuple[str, int]:
    found = find(text)
    if not found:
        return text, 0
    out, at = [], 0
    for a, b, kind, canon in found:
        new = surrogate(key, kind, canon, attempts.get((kind, canon), 0))
        out += [text[at:a], lay_over(kind, text[a:b], new)]
        at = b
    return "".join([*out, text[at:]]), len(found)


def entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Distinct ``(kind, canon)`` of the whole corpus."""

    def run(batches):
        for batch in batches:
            found = {(k, c) for t in batch.column(0).to_pylist() if t for _, _, k, c in find(t)}
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.string())], ["kind", "canon"])

    return docs.select(F.col(text_col).alias("t")).mapInArrow(run, "kind string, canon string").distinct()


def attempts_needed(known: DataFrame, key: bytes) -> DataFrame:
    """``(kind, canon, attempt)`` of the entities whose surrogate is not attempt 0, so that surrogates are distinct and no real entity."""

    def draw(batches):
        for batch in batches:
            k, c, n = (batch.column(i).to_pylist() for i in range(3))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([surrogate(key, *x) for x in zip(k, c, n)], pa.string())], ["kind", "canon", "attempt", "new"])

    schema = "kind string, canon string, attempt int, new string"
    real = known.select(F.col("kind").alias("rk"), F.col("canon").alias("rc"))
    drawn = materialize(known.select("kind", "canon", F.lit(0).alias("attempt")).mapInArrow(draw, schema), "surrogates")
    while True:
        # An entity drawn earlier keeps its surrogate before one that was drawn again; then the smaller form goes first.
        first = drawn.groupBy(F.split("kind", "-")[0].alias("type"), "new").agg(F.min(F.struct("attempt", "canon", "kind")).alias("v"))
        keepers = first.join(real, (first["type"] == F.split("rk", "-")[0]) & (first["new"] == real["rc"]), "left_anti").select("v.kind", "v.canon")
        taken = drawn.select("kind", "canon").join(keepers, ["kind", "canon"], "left_anti")
        taken = materialize(taken, "taken")
        if taken.isEmpty():
            break
        again = drawn.join(taken, ["kind", "canon"]).select("kind", "canon", (F.col("attempt") + 1).alias("attempt")).mapInArrow(draw, schema)
        drawn = materialize(drawn.join(taken, ["kind", "canon"], "left_anti").unionByName(again), "surrogates")
    return drawn.where("attempt > 0").select("kind", "canon", "attempt")


def anonymise(docs: DataFrame, key: bytes, text_col: str = "text", count_col: str | None = None, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` with rewritten texts and, where ``count_col`` names one, a last column with the number of entities; other columns as they are."""
    spark = docs.sparkSession
    known = materialize(entities(docs, text_col), "entities")
    moved = materialize(attempts_needed(known, key), "attempts")
    n = moved.count()
    if count_col is not None:
        docs = docs.drop(count_col)
    names = docs.columns
    spot = names.index(text_col)
    schema = T.StructType([*docs.schema.fields, *([T.StructField(count_col, T.LongType())] if count_col is not None else [])])

    def rewritten(cols: list, new: list[tuple[str | None, int]]) -> pa.RecordBatch:
        cols[spot] = pa.array([x[0] for x in new], cols[spot].type)
        counts = [] if count_col is None else [pa.array([x[1] for x in new], pa.int64())]
        return pa.RecordBatch.from_arrays([*cols, *counts], [f.name for f in schema])

    if n <= broadcast_rows:
        table = spark.sparkContext.broadcast({(r[0], r[1]): r[2] for r in moved.collect()} if n else {})

        def run(batches):
            for batch in batches:
                new = [(None, 0) if t is None else rewrite(t, key, table.value) for t in batch.column(spot).to_pylist()]
                yield rewritten(list(batch.columns), new)

        return docs.mapInArrow(run, schema)
    # Too many to broadcast: each text gets the attempts of its own entities by a join on the text's hash.

    def holders(batches):
        for batch in batches:
            rows = [(k, c, h) for h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if t for k, c in {x[2:] for x in find(t)}]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["kind", "canon", "h"])

    held = docs.select(F.xxhash64(text_col).alias("h"), F.col(text_col).alias("t")).mapInArrow(holders, "kind string, canon string, h long").distinct()
    own = held.join(moved, ["kind", "canon"]).groupBy(F.col("h").alias("__hd_h")).agg(F.collect_list(F.struct("kind", "canon", "attempt")).alias("__hd_moved"))
    wide = docs.join(own, F.xxhash64(docs[text_col]) == own["__hd_h"], "left").select(*(docs[c] for c in names), "__hd_moved")

    def run_own(batches):
        for batch in batches:
            moved_of = batch.column(len(names)).to_pylist()
            new = [(None, 0) if t is None else rewrite(t, key, {(x["kind"], x["canon"]): x["attempt"] for x in m or []}) for t, m in zip(batch.column(spot).to_pylist(), moved_of)]
            yield rewritten(list(batch.columns[:-1]), new)

    return wide.mapInArrow(run_own, schema)
