"""Personal data: every detected entity is replaced by a surrogate of its own kind.

A surrogate is a keyed function of the entity's normal form, so that all mentions of an entity, in any document,
get the same one, and it keeps kind and form: digits stay digits, letters letters of the same script, separators
where they were, card numbers keep a valid check digit, first names their gender and script. Two entities that
would get the same surrogate, or one that would get the name of another entity of the corpus, are given new ones
until all are different.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewise.llm.common import (
    back_to_names,
    carried,
    carried_names,
    carried_schema,
    claim_worker,
    rows_of,
    small,
    with_carried,
)
from tablewise.llm.names import FAMILY_NAMES, FIRST_NAMES, SYLLABLES, TITLES
from tablewise.sources.staging import stage

#: Kinds of entities and their forms, in the order in which they are looked for. The group "value" is what is replaced.
PATTERNS = (
    ("email", r"(?P<value>[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})"),
    ("access_key", r"(?<![A-Za-z0-9])(?:AKIA|ASIA)(?P<value>[0-9A-Z]{16})(?![A-Za-z0-9])"),
    ("access_key", r"(?<![A-Za-z0-9])(?:ghp_|sk-)(?P<value>[A-Za-z0-9]{20,})"),
    ("secret", r"(?i:password|passwd|pwd|secret|token|api[_-]?key)[\"']?\s{0,2}[=:]\s{0,2}[\"']?"
     r"(?P<value>(?=[_+/-]*[A-Za-z0-9])[A-Za-z0-9_+/-]{8,})"),       # a line to fill in is no secret
    ("iban", r"(?<![A-Za-z0-9])(?P<value>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])"),
    ("ip", r"(?<![\d.])(?P<value>(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d))(?![\d]|\.\d)"),
    ("ip", r"(?<![\w:.])(?P<value>(?=[A-Fa-f:]*[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}"
           r"|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,5}))(?![\w:])"),
    ("social", r"(?<![\d-])(?P<value>\d{3}-\d{2}-\d{4})(?![\d-])"),
    ("card", r"(?<![\d.+-])(?P<value>\d{4}([ -]?)\d{4}\2\d{4}\2\d{1,7}|\d{4}([ -])\d{6}\3\d{5})(?![\d-])"),
    ("phone", r"(?<![\w.+])(?P<value>\+\d{1,3}[ .-]?(?:\(\d{1,5}\)[ .-]?)?\d{2,5}(?:[ .-]?\d{2,5}){1,4}"
              r"|\(\d{2,5}\)[ .-]?\d{3,4}[ .-]?\d{3,4}|\d{3}([ .-])\d{3}\2\d{4}|0\d{2,4}[ /-]\d{3,4}[ ]?\d{3,5})(?![\w-])"),
)
_COMPILED = tuple((kind, re.compile(p)) for kind, p in PATTERNS)
_CLUE = re.compile(r"[0-9@]|[Pp]assw|[Ss]ecret|[Tt]oken|TOKEN|SECRET|PASSW|[Kk][Ee][Yy]|pwd")
_FAMILY = r"[^\W\d_][^\W\d_]+(?:[-'][^\W\d_]+)*"
_AFTER_FIRST = re.compile(rf"(?: [^\W\d_]\.)? (?P<value>{_FAMILY})")
_AFTER_TITLE = re.compile(rf"\.? (?P<value>{_FAMILY})")
_NAME_WORD = re.compile(_FAMILY)

MENTIONS = "doc_id bigint, kind string, form string"


@dataclass(frozen=True)
class Mention:
    start: int
    end: int
    kind: str       # of PATTERNS, or first:<gender>:<script>, family:<script>
    form: str       # normal form: what all mentions of the entity have in common


def script_of(word: str) -> str:
    first = word[0]
    return "cyrillic" if "Ѐ" <= first <= "ӿ" else "greek" if "Ͱ" <= first <= "Ͽ" else "latin"


def normal_form(kind: str, value: str) -> str:
    if kind in ("card", "phone", "social"):
        return "".join(filter(str.isdigit, value))
    if kind == "iban":
        return value.replace(" ", "")
    return value.lower() if kind in ("email", "ip") else value


@functools.lru_cache(maxsize=1)
def _gazetteer():
    """An automaton of first names and titles, as written and in capitals."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for (gender, script), names in FIRST_NAMES.items():
        for name in names:
            for form in (name, name.upper()):
                found.add_word(form, (len(form), f"first:{gender}:{script}"))
    for title in TITLES:
        found.add_word(title, (len(title), "title"))
    found.make_automaton()
    return found


def _people(text: str) -> list[Mention]:
    """First names with a family name behind them, family names behind a title, and single mentions of either
    elsewhere in the text."""
    known: dict[str, str] = {}
    for last, (length, kind) in _gazetteer().iter(text):
        start, end = last + 1 - length, last + 1
        if (start and (text[start - 1].isalnum() or text[start - 1] in "_-'")) or (end < len(text) and text[end].isalnum()):
            continue
        behind = (_AFTER_TITLE if kind == "title" else _AFTER_FIRST).match(text, end)
        if not behind or not behind["value"][0].isupper() or behind["value"] in TITLES:
            continue
        first = next((k for k in _first_kinds(behind["value"])), None)
        if kind != "title":
            known.setdefault(text[start:end].casefold(), kind)
            if first is None:
                known.setdefault(behind["value"].casefold(), f"family:{script_of(behind['value'])}")
        elif first is None:
            known.setdefault(behind["value"].casefold(), f"family:{script_of(behind['value'])}")
    if not known:
        return []
    return [Mention(m.start(), m.end(), known[m[0].casefold()], m[0].casefold())
            for m in _NAME_WORD.finditer(text) if m[0][0].isupper() and m[0].casefold() in known]


def _first_kinds(word: str) -> list[str]:
    return [kind for kind, names in _first_names().items() if word.casefold() in names]


@functools.lru_cache(maxsize=1)
def _first_names() -> dict[str, dict[str, int]]:
    return {f"first:{g}:{s}": {n.casefold(): i for i, n in enumerate(names)} for (g, s), names in FIRST_NAMES.items()}


def mentions(text: str) -> list[Mention]:
    """All entities of a text from left to right; where two overlap, the kind that is looked for first."""
    found: list[Mention] = []
    if _CLUE.search(text):
        for kind, pattern in _COMPILED:
            for m in pattern.finditer(text):
                start, end = m.span("value")
                if kind == "phone" and len(normal_form(kind, m["value"])) < 8:
                    continue
                if all(end <= f.start or start >= f.end for f in found):
                    found.append(Mention(start, end, kind, normal_form(kind, m["value"])))
    for person in _people(text):
        if all(person.end <= f.start or person.start >= f.end for f in found):
            found.append(person)
    return sorted(found, key=lambda m: m.start)


class Stream:
    """Numbers that depend on a key, a kind, a form and an attempt."""

    def __init__(self, key: bytes, *parts: str):
        self.seed = blake2b("\0".join(parts).encode("utf-8", "surrogatepass"), key=key, digest_size=32).digest()
        self.block, self.left = 0, b""

    def below(self, n: int) -> int:
        if len(self.left) < 4:
            self.left += blake2b(self.block.to_bytes(8, "little"), key=self.seed, digest_size=64).digest()
            self.block += 1
        value, self.left = int.from_bytes(self.left[:4], "little"), self.left[4:]
        return value % n


LOWER, UPPER, DIGITS, HEX = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"


def _same_classes(text: str, stream: Stream) -> str:
    """Each digit or ASCII letter replaced by one of its class; hexadecimal text stays hexadecimal."""
    if len(text) >= 8 and all(c in HEX for c in text) and not text.isdigit():
        return "".join(HEX[stream.below(16)] for _ in text)
    classes = ((DIGITS, DIGITS), (LOWER, LOWER), (UPPER, UPPER))
    return "".join(next((new[stream.below(len(new))] for own, new in classes if c in own), c) for c in text)


def check_digit(digits: str) -> str:
    """The digit that makes a card number valid."""
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = 2 * d if i % 2 == 0 else d
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _octet(octet: str, stream: Stream) -> str:
    low, high = {1: (1, 9), 2: (10, 99), 3: (100, 254)}[len(octet)]
    return str(low + stream.below(high - low + 1))


#: From this attempt on, surrogates leave their shape, because too few may have it: the octets of an address have any
#: length, and whatever else is made of letters and digits gets more of them, up to so many.
WIDER, MORE_LETTERS = 4, 12


def _more(attempt: int) -> int:
    return min(2 * (attempt - WIDER + 1), MORE_LETTERS) if attempt >= WIDER else 0


def iban_check(form: str) -> str:
    """The two check digits that make an account number valid."""
    return f"{98 - int(''.join(str(int(c, 36)) for c in form[4:] + form[:2] + '00')) % 97:02d}"


def _address(form: str, stream: Stream, wide: bool) -> str:
    if ":" in form:
        return re.sub("[0-9a-f]+", lambda m: "".join(HEX[1 + stream.below(15)] for _ in range(4 if wide else len(m[0]))), form)
    if wide:
        return ".".join(str(1 + stream.below(254)) for _ in form.split("."))
    return ".".join(_octet(o, stream) for o in form.split("."))


def surrogate(key: bytes, kind: str, form: str, attempt: int = 0) -> str:
    """The normal form of the replacement."""
    stream = Stream(key, kind, form, str(attempt))
    if kind.startswith("first:"):
        _, gender, script = kind.split(":")
        names = FIRST_NAMES[gender, script]
        # a keyed rotation of the list: different names get different ones, none its own
        turn = 1 + Stream(key, kind).below(len(names) - 1)
        return names[(_first_names()[kind][form] + turn) % len(names)].casefold()
    if kind.startswith("family:"):
        script = kind.split(":")[1]
        name = FAMILY_NAMES[script][stream.below(len(FAMILY_NAMES[script]))]
        for _ in range(1 + min(attempt, 6)):
            name += SYLLABLES[script][stream.below(len(SYLLABLES[script]))]
        return name.casefold()
    if kind == "email":
        local, _, domain = form.rpartition("@")
        labels = domain.split(".")
        kept = 2 if len(labels) > 2 and labels[-2] == "example" else 1
        new = [_same_classes(label, Stream(key, "domain", ".".join(labels[i:]))) for i, label in enumerate(labels[:-kept])]
        new_local = _same_classes(local, stream) + "".join(LOWER[stream.below(26)] for _ in range(_more(attempt)))
        return f"{new_local}@{'.'.join(new + labels[-kept:])}"
    if kind == "ip":
        return _address(form, stream, attempt >= WIDER)
    more = "".join(DIGITS[stream.below(10)] for _ in range(_more(attempt)))
    if kind == "phone":
        kept = 1 if form[0] == "0" else max(0, len(form) - 10)      # the country, or the 0 of a national number
        return form[:kept] + str(2 + stream.below(8)) + _same_classes(form[kept + 1:], stream) + more
    if kind == "card":
        body = form[0] + "".join(DIGITS[stream.below(10)] for _ in form[1:-1]) + more
        valid = check_digit(form[:-1]) == form[-1]
        return body + (check_digit(body) if valid else DIGITS[stream.below(10)])
    if kind == "social":
        return str(1 + stream.below(8)) + "".join(DIGITS[stream.below(10)] for _ in form[1:]) + more
    if kind == "iban":
        body = "".join(_one(c, stream) for c in form[4:]) + more
        valid = iban_check(form) == form[2:4]
        return form[:2] + (iban_check(form[:4] + body) if valid else "".join(_one(c, stream) for c in form[2:4])) + body
    return _same_classes(form, stream) + more


def _one(c: str, stream: Stream) -> str:
    return DIGITS[stream.below(10)] if c in DIGITS else UPPER[stream.below(26)]


def rendered(kind: str, value: str, new: str) -> str:
    """The replacement's normal form in the shape of a mention: its separators, its capitals."""
    if kind.startswith(("first:", "family:")):
        return new.upper() if value.isupper() and len(value) > 1 else new[0].upper() + new[1:]
    if kind in ("card", "phone", "social"):
        digits = iter(new)
        return "".join(next(digits) if c.isdigit() else c for c in value) + "".join(digits)
    if kind == "iban":
        rest = iter(new)
        return "".join(c if c == " " else next(rest) for c in value) + "".join(rest)
    if kind == "ip" and value.isupper():
        return new.upper()
    if kind == "email":
        parts = zip(value.rpartition("@"), new.rpartition("@"))
        return "".join("".join(n.upper() if v.isupper() else n for v, n in zip(old, part)) + part[len(old):]
                       for old, part in parts)
    return new


def replace_entities(text: str, key: bytes, others: dict[tuple[str, str], str] | None = None) -> tuple[str, int]:
    """(text with surrogates, number of mentions); ``others`` has the entities that need another than the first."""
    out, at, n = [], 0, 0
    for m in mentions(text):
        new = (others or {}).get((m.kind, m.form)) or surrogate(key, m.kind, m.form)
        out += [text[at:m.start], rendered(m.kind, text[m.start:m.end], new)]
        at, n = m.end, n + 1
    return "".join(out) + text[at:], n


def _mentions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    claim_worker("pii")
    for rows in rows_of(batches):
        out = [(d, *x) for d, t in zip(rows.column("doc_id").to_pylist(), rows.column("text").to_pylist())
               for x in sorted({(m.kind, m.form) for m in mentions(t)})]
        d, kind, form = zip(*out) if out else ((), (), ())
        yield pa.record_batch([pa.array(d, pa.int64()), pa.array(kind, pa.string()), pa.array(form, pa.string())],
                              names=["doc_id", "kind", "form"])


def _surrogates(batches: Iterator[pa.RecordBatch], key: bytes) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        kind, form, attempt = (rows.column(c).to_pylist() for c in ("kind", "form", "attempt"))
        new = [surrogate(key, k, f, a) for k, f, a in zip(kind, form, attempt)]
        yield pa.record_batch([*rows.select(["kind", "form", "attempt"]).columns, pa.array(new, pa.string())],
                              names=["kind", "form", "attempt", "new"])


def choose_surrogates(found: DataFrame, key: bytes) -> DataFrame:
    """(kind, form, attempt, new): a surrogate of its own for every distinct entity (kind, form).

    In each round the entities whose surrogate another one has too, or that is an entity of the corpus, try
    again, but for the least of those that share one. First names are turned within their list and never collide; all
    others leave their shape after some attempts, so that the rounds end also where a shape is used up."""
    schema = "kind string, form string, attempt int, new string"
    make = partial(_surrogates, key=key)
    now = stage(found.select("kind", "form").distinct().withColumn("attempt", F.lit(0)).mapInArrow(make, schema),
                "surrogates")
    while True:
        open_kinds = now.where(~F.col("kind").startswith("first:"))
        shared = open_kinds.groupBy("kind", "new").agg(
            F.count(F.lit(1)).alias("n"), F.min(F.struct("attempt", "form"))["form"].alias("keeps")).where("n > 1")
        real = open_kinds.select("kind", F.col("form").alias("new"), F.lit(True).alias("real"))
        again = open_kinds.join(shared, ["kind", "new"], "left").join(real, ["kind", "new"], "left").where(
            "real or form <> keeps").select("kind", "form", (F.col("attempt") + 1).alias("attempt"))
        again = stage(again.distinct(), "surrogates-again")
        if again.isEmpty():
            return now
        kept = now.join(again, ["kind", "form"], "left_anti")
        now = stage(kept.union(again.mapInArrow(make, schema)), "surrogates")


def _replace(batches: Iterator[pa.RecordBatch], key: bytes) -> Iterator[pa.RecordBatch]:
    claim_worker("pii")
    for rows in rows_of(batches):
        texts, counts = [], []
        for text, others in zip(rows.column("text").to_pylist(), rows.column("others").to_pylist()):
            new, n = (None, 0) if text is None else replace_entities(
                text, key, {(o["kind"], o["form"]): o["new"] for o in others or ()})
            texts.append(new)
            counts.append(n)
        yield pa.record_batch([rows.column("doc_id"), pa.array(texts, pa.string()), pa.array(counts, pa.int64()),
                               *carried(rows)], names=["doc_id", "text", "n_entities", *carried_names(rows)])


def replace_pii(df: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text", carry: list[str] = ()
                ) -> DataFrame:
    """(doc_id, text, n_entities, *carry): every text with its entities replaced.

    The distinct entities of the corpus are gathered in Spark and checked for collisions; surrogates that needed no
    second attempt are computed where the text is, so that only the others are joined to their documents. Texts do not
    move while those documents are few enough to broadcast; beyond that the join shuffles. ``carry`` names columns
    that come along unchanged; those called like a result column are refused.

    Defined results: a missing text stays missing, with no entities; a text without entities comes back as it is;
    repeated rows are replaced alike; the same key gives the same surrogates as long as the corpus has the same
    entities; an empty table gives no rows.
    """
    docs = with_carried(df, carry, ["doc_id", "text", "n_entities"], F.col(id_col).alias("doc_id"),
                        F.col(text_col).cast("string").alias("text"))
    found = stage(docs.where("text is not null").select("doc_id", "text").mapInArrow(_mentions, MENTIONS), "mentions")
    chosen = choose_surrogates(found, key)
    exceptions = found.join(chosen.where("attempt > 0").select("kind", "form", "new"), ["kind", "form"])
    lists = stage(exceptions.groupBy("doc_id").agg(
        F.collect_set(F.struct("kind", "form", "new")).alias("others")), "surrogates-by-document")
    joined = docs.join(small(lists).withColumnRenamed("doc_id", "of"), F.col("doc_id").eqNullSafe(F.col("of")), "left")
    replaced = joined.drop("of").mapInArrow(partial(_replace, key=key), carried_schema(
        "doc_id bigint, text string, n_entities bigint", docs))
    return back_to_names(replaced, carry)
