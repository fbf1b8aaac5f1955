"""Secret scans of whole texts.

Method: an Aho-Corasick automaton finds all keywords of a text in one pass; an
anchored regular expression runs only where a keyword hit; tokens of formats
with an embedded checksum count only if the checksum is right. Hex runs have no
keyword: their prefilter is the run of 16 characters itself.

Kinds, in the order ties are listed: assign, access, hex, then those the
checksum confirms: forge (five prefixes of source-forge tokens) and registry
(package-registry tokens), both with 30 random characters and a CRC-32 in six
base-62 digits, and card (payment card numbers of 13 to 19 digits with a valid
Luhn digit behind the word card or cc).

Defined results: a null or empty text has no spans; spans are code points,
end exclusive; within a kind they don't overlap, leftmost first; repeated rows
stay repeated; ids may be null; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import per_process, pick

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "forge", "registry", "card")

# Keywords and patterns of the kinds.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
FORGE_PREFIXES = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")
REGISTRY_PREFIXES = ("npm_",)
CARD_WORDS = ("card", "cc")
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
CHECKED = r"(?:gh[pousr]|npm)_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])"
CARD = r"(?:card|cc)[^0-9\n]{0,16}([0-9](?:[ -]?[0-9]){12,18})(?![0-9])"
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62_crc(body: str) -> str:
    """CRC-32 of a token's random part in six base-62 digits."""
    value, digits = zlib.crc32(body.encode()), []
    for _ in range(6):
        value, digit = divmod(value, 62)
        digits.append(BASE62[digit])
    return "".join(reversed(digits))


def luhn_valid(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        doubled = d * 2 if i % 2 else d
        total += doubled - 9 if doubled > 9 else doubled
    return total % 10 == 0


class Scanner:
    """The automaton and the anchored patterns."""

    def __init__(self):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        kinds: dict[str, str] = {w: "assign" for w in ASSIGN_WORDS}
        kinds |= {"akia": "access"} | dict.fromkeys(FORGE_PREFIXES, "forge")
        kinds |= dict.fromkeys(REGISTRY_PREFIXES, "registry") | dict.fromkeys(CARD_WORDS, "card")
        for word, kind in kinds.items():
            self.automaton.add_word(word, (len(word), kind))
        self.automaton.make_automaton()
        self.assign = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
        self.access, self.hex = re.compile(ACCESS), re.compile(HEX)
        self.checked, self.card = re.compile(CHECKED), re.compile(CARD, re.IGNORECASE | re.ASCII)

    def matches(self, text: str) -> Iterator[tuple[str, int, int, bool]]:
        """(kind, start, end, holds) of every match the leftmost search takes, failing ones too."""
        lowered = text if text.isascii() and text.islower() else text.encode().lower().decode()
        hits = sorted((end + 1 - size, kind) for end, (size, kind) in self.automaton.iter(lowered))
        taken = dict.fromkeys(KINDS, 0)
        for start, kind in hits:
            if start < taken[kind]:
                continue
            if kind == "assign":
                m = self.assign.match(text, start)
                holds = m and len(m[2]) >= 12
            elif kind == "access":
                m = self.access.match(text, start)
                holds = m and m.end() - m.start() >= 18
            elif kind == "card":
                m = self.card.match(text, start)
                holds = m and luhn_valid(re.sub("[ -]", "", m[1]))
            else:
                m = self.checked.match(text, start)
                holds = m and base62_crc(m[1]) == m[2]
            if m:
                taken[kind] = m.end()
                yield kind, start, m.end(), bool(holds)
        for m in self.hex.finditer(text):
            yield "hex", m.start(), m.end(), True

    def spans(self, text: str | None) -> list[tuple[str, int, int]]:
        found = [(kind, start, end) for kind, start, end, holds in self.matches(text or "") if holds]
        return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): spans as an array of (kind, start, end) by start, then kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = per_process("secrets", 0, Scanner)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            found = [[{"kind": k, "start": a, "end": b} for k, a, b in scanner.spans(text)]
                     for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["doc_id", "spans"])

    rows = pick(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:int,end:int>>")


def span_digests(scanned: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of what `scan_secrets` found."""

    def text(column):
        return F.array_join(F.transform(column, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def only(*kinds):
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    return scanned.select(
        "doc_id", *(F.size(only(k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(text(only(*BASE_KINDS)), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
