"""Personal data by anchors: an automaton finds cues, local parsers find where the data begins and ends.

One Aho-Corasick automaton reads a text once. Its cues are at-signs, plus-signs, digits, schemes and
words that announce an identifier. At each cue a parser reads left and right from there, by fixed
rules and without going back: mail addresses around an at-sign, network addresses and card numbers
from a run of digits, phone numbers from a plus-sign, and the added kinds below. What a parser has
read is not read again for the same kind.

Base kinds, each as the leftmost matches that do not overlap, matches that fail their test dropped:
`email`, `ip` (four parts of at most 255), `card` (12 to 19 digits, Luhn), `phone` (9 to 15 digits).
Added kinds: `account` (an IBAN that passes its check digits; nine digits as 3-2-4 after a cue for a
social security number), `login` (name and password before the at-sign of a URL), `contact` (what
follows `mailto:` or `tel:`), `ip6` (an address in brackets after a scheme).

Null text counts as empty and has no spans; places are code points, the end is exclusive. Rows that
repeat are read each for itself. Only `doc_id` and `text` are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache
from string import ascii_letters, digits

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionlake.llm.common import fresh, id_and_text, quoted, slices, small_batches

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "account", "login", "contact", "ip6")

#: Words that announce an identifier, lower case, and the parser for it.
CUES = {
    "iban": "account", "ssn": "security", "social security": "security",
    "mailto:": "contact", "tel:": "contact", "://": "scheme",
}
#: Characters between a word that announces and what it announces.
REACH = 24

#: Characters of the part before an at-sign.
LOCAL = f"{ascii_letters}{digits}._%+-"

_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]+")
_PART = re.compile(r"\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])*")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
_SECURITY = re.compile(r"(?<![0-9])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])")
_LOGIN = re.compile(r"[^\s/?#@:\[\]]+:[^\s/?#@]+@")
_SIX = re.compile(r"\[([0-9A-Fa-f:.]*)\]")
_CONTACT = {
    "mailto:": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]*[A-Za-z0-9]"),
    "tel:": re.compile(r"\+?[0-9][0-9().-]*[0-9]"),
}

Span = tuple[str, int, int]


@cache
def cues():
    import ahocorasick

    auto = ahocorasick.Automaton()
    for one in "@+0123456789":
        auto.add_word(one, one if one in "@+" else "0")
    for word in CUES:
        for form in {word, word.upper(), word.title(), word.capitalize()}:
            auto.add_word(form, word)
    auto.make_automaton()
    return auto


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if k % 2 == 0 else (2 * n if n < 5 else 2 * n - 9)
    return total % 10 == 0


def iban_holds(text: str) -> bool:
    plain = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


class Reader:
    """The parsers at work on one text; `done` has how far each kind has read."""

    def __init__(self, text: str) -> None:
        self.text, self.spans = text, []
        self.done = dict.fromkeys(("email", "ip", "card", "phone", "account", "security", "login", "contact", "ip6"), 0)

    def add(self, kind: str, start: int, end: int) -> None:
        self.spans.append((kind, start, end))

    def email(self, at: int) -> None:
        host = _HOST.match(self.text, at + 1)
        if not host:
            return
        # The local part does not reach into the match before; most are short.
        free, size = self.done["email"], 64
        while True:
            begin = max(free, at - size)
            low = begin + len(self.text[begin:at].rstrip(LOCAL))
            if low > begin or begin == free:
                break
            size *= 4
        if low < at:
            self.add("email", low, host.end())
            self.done["email"] = host.end()

    def digits(self, at: int) -> None:
        text = self.text
        if at >= self.done["card"]:
            run = _CARD.match(text, at)
            plain = run.group().replace(" ", "").replace("-", "") if run.end() - at > 11 else ""
            if 12 <= len(plain) <= 19 and luhn(plain):
                self.add("card", at, run.end())
            self.done["card"] = run.end()
        if at >= self.done["ip"]:
            end, parts = at, []
            first = _DIGITS.match(text, at)
            end = first.end()
            parts.append(first.group())
            while len(parts) < 4 and (more := _PART.match(text, end)):
                parts.append(more.group(1))
                end = more.end()
            if len(parts) == 4:
                if all(len(p) <= 3 and int(p or 0) <= 255 for p in (q.lstrip("0") for q in parts)):
                    self.add("ip", at, end)
                self.done["ip"] = end
            else:
                self.done["ip"] = first.end()

    def phone(self, at: int) -> None:
        run = _PHONE.match(self.text, at)
        if not run or at < self.done["phone"]:
            return
        found = run.group().rstrip(" ().-")
        # One character of the class must stand between the first digit and the last.
        if len(found) < 4:
            return
        if 9 <= sum(c.isdigit() for c in found) <= 15:
            self.add("phone", at, at + len(found))
        self.done["phone"] = at + len(found)

    def after(self, word: str, at: int) -> None:
        """What a word announces, that ends at `at`."""
        text = self.text
        if CUES[word] == "account" and at >= self.done["account"]:
            found = _IBAN.search(text, at, at + REACH + 42)
            if found and found.start() <= at + REACH:
                end = found.end()
                while end - found.start() >= 15:  # the words after may look like more of it
                    if text[end - 1] != " " and iban_holds(text[found.start() : end]):
                        self.add("account", found.start(), end)
                        self.done["account"] = end
                        break
                    end -= 1
        elif CUES[word] == "security" and at >= self.done["security"]:
            found = _SECURITY.search(text, at, at + REACH + 11)
            if found:
                self.add("account", *found.span())
                self.done["security"] = found.end()
        elif CUES[word] == "scheme":
            if at >= self.done["login"] and (found := _LOGIN.match(text, at)):
                self.add("login", at, found.end() - 1)
                self.done["login"] = found.end()
            # One pass over what may stand in brackets; a colon must come before the first dot.
            if (six := _SIX.match(text, at)) and ":" in six[1].partition(".")[0]:
                self.add("ip6", *six.span())
        elif CUES[word] == "contact" and at >= self.done["contact"]:
            if found := _CONTACT[word].match(text, at):
                self.add("contact", *found.span())
                self.done["contact"] = found.end()


def find(text: str) -> list[Span]:
    """All spans of a text, by start and then by kind as listed."""
    reader = Reader(text)
    for end, cue in cues().iter(text):
        if cue == "0":
            reader.digits(end)
        elif cue == "@":
            reader.email(end)
        elif cue == "+":
            reader.phone(end)
        else:
            reader.after(cue, end + 1)
    return sorted(set(reader.spans), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def report(docs: DataFrame) -> DataFrame:
    """Per document: how many spans of each base kind, a digest of those, and all spans."""
    docs = id_and_text(docs)
    counts = [f"n_{kind}" for kind in BASE]
    schema = T.StructType(
        [
            docs.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in counts),
            T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [find(t) for t in batch.column("text").to_pylist()]
            base = [[s for s in spans if s[0] in BASE] for spans in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    *(pa.array([sum(s[0] == kind for s in spans) for spans in base], pa.int64()) for kind in BASE),
                    pa.array([hashlib.sha256(written(s).encode()).hexdigest() for s in base], pa.string()),
                    pa.array([written(s) for s in found], pa.string()),
                ],
                schema.names,
            )

    return docs.mapInArrow(run, schema)


def masked_text(text: str) -> str:
    """The text with each span, or run of spans that overlap, as the kind of its first in brackets."""
    out, at = [], 0
    for kind, start, end in find(text):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def masked(docs: DataFrame) -> DataFrame:
    """The documents with their personal data masked; null text stays null. `n_chars`, where there
    is one, follows the text."""
    text = fresh(small_batches(docs), "masked")

    @F.arrow_udf("string")
    def mask(texts: pa.Array) -> pa.Array:
        return pa.array([masked_text(t.as_py()) if t.is_valid else None for t in texts], pa.string())

    marked = docs.withColumn(text, mask(F.col("text")))
    changed = {"text": F.col(text)}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        same = F.col(text).eqNullSafe(F.col("text"))
        changed["n_chars"] = F.when(same, F.col("n_chars")).otherwise(F.length(text).cast(kind))
    return marked.select(*[changed.get(c, quoted(c)).alias(c) for c in docs.columns])
