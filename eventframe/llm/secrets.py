"""Secret scan: Aho-Corasick keywords, regular expressions anchored at the hits, checksum validation.

One automaton finds all keywords in a text with ASCII letters lowered (which keeps every position). Each
hit starts one anchored expression; nothing else of the text is matched. Long hexadecimal runs have no
keyword and are found by their length alone. Kinds with a checksum inside count only if it holds: GitHub
and npm tokens (CRC-32 in base 62), card numbers (Luhn), IBANs (remainder 97), JSON web tokens (their header
is base64 of JSON naming an algorithm).

Spans of a kind don't overlap, the leftmost holds. A match that fails a length or checksum rule is dropped,
and the search of its kind goes on after it, but for kinds with a checksum just after its keyword.

Time is linear in the text. Hits of one kind inside one run of letters (``card``) or of token characters (``jwt``)
look at the same place, the run's end, so each run is followed once; all else that an expression reads is bounded.
A token's header has at most 4,096 characters (``HEADER``).

Defined cases: null and empty texts have no spans; very long texts are scanned whole; a null identifier is kept; repeated rows are scanned each;
an empty table gives no rows; extra columns don't matter.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventframe.llm.common import by_batches, table

#: In the order in which spans with the same start are listed. The first three are the base kinds.
KINDS = ("assign", "access", "hex", "github", "npm", "card", "iban", "jwt")
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_HEX = re.compile(r"[0-9a-f]{24,}")
#: Characters of a web token's header, which is decoded anew for each hit.
HEADER = 4096


def _crc62(value: str) -> bool:
    """The last six of 36 letters are the CRC-32 of the others in base 62."""
    crc, digits = zlib.crc32(value[:30].encode()), ""
    for _ in range(6):
        crc, d = divmod(crc, 62)
        digits = _BASE62[d] + digits
    return digits == value[30:]


def _luhn(value: str) -> bool:
    digits = [int(c) for c in reversed(value) if c.isdigit()]
    return 13 <= len(digits) <= 19 and sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0


def _iban(value: str) -> bool:
    value = value.replace(" ", "")
    return 15 <= len(value) <= 34 and int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def _jwt(head: str) -> bool:
    if not 11 <= len(head) <= HEADER or not head.startswith("eyJ"):
        return False
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (binascii.Error, ValueError, TypeError, RecursionError):
        return False


#: kind: keywords, expression anchored at the keyword or its run's end, group of the span, check of the match.
_RULES = {
    "assign": (("password", "passwd", "secret", "token", "apikey", "api_key"), _ASSIGN, 0, None),
    "access": (("akia",), re.compile(r"AKIA[A-Z0-9]+"), 0, None),
    "github": (("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), re.compile(r"gh[pousr]_([A-Za-z0-9]{36})(?![A-Za-z0-9])"), 0, lambda m: _crc62(m[1])),
    "npm": (("npm_",), re.compile(r"npm_([A-Za-z0-9]{36})(?![A-Za-z0-9])"), 0, lambda m: _crc62(m[1])),
    "card": (("card", "visa", "amex"), re.compile(r"[^0-9\n]{0,20}+(\d(?:[ -]?\d){12,18})(?!\d)"), 1, lambda m: _luhn(m[1])),
    "iban": (("iban",), re.compile(r"(?i:iban)[^0-9A-Za-z\n]{0,4}([A-Z]{2}\d\d(?: ?[A-Z0-9]{1,4}+){3,8})(?![A-Za-z0-9])"), 1, lambda m: _iban(m[1])),
    "jwt": (("eyj",), re.compile(r"\.eyJ[\w-]++\.[\w-]+", re.A), 0, None),
}
#: Kinds whose expression starts at the end of the run that the keyword stands in.
_RUNS = {"card": re.compile(r"[A-Za-z]+"), "jwt": re.compile(r"[\w-]+", re.A)}


def automaton() -> ahocorasick.Automaton:
    """All keywords; the value is (kind, length)."""
    out = ahocorasick.Automaton()
    for kind, (words, *_) in _RULES.items():
        for w in words:
            out.add_word(w, (kind, len(w)))
    out.make_automaton()
    return out


def find(text: str | None, words: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` by start, then kind; positions are code points, the end exclusive."""
    if not text:
        return []
    out = [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    out += _near_hits(text, words)
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def _near_hits(text: str, words: ahocorasick.Automaton) -> Iterator[tuple[str, int, int]]:
    low = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    free = dict.fromkeys(_RULES, 0)  # where the next match of a kind may start
    runs = {kind: (0, None) for kind in _RUNS}  # where the run ends, and the match there
    for last, (kind, size) in words.iter(low):
        start = last + 1 - size
        if start < free[kind]:
            continue
        _, rule, group, valid = _RULES[kind]
        if kind in runs:
            if start >= runs[kind][0]:
                end = _RUNS[kind].match(text, start).end()
                runs[kind] = end, rule.match(text, end)
            m = runs[kind][1]
        else:
            m = rule.match(text, start)
        if not m:
            continue
        if kind == "assign" or kind == "access":
            free[kind] = m.end()
            if len(m[2]) < 6 if kind == "assign" else len(m[0]) < 20:
                continue
        elif not (_jwt(text[start:min(m.start(), start + HEADER + 1)]) if kind == "jwt" else valid(m)):
            continue
        free[kind] = m.end()
        yield kind, start if kind == "jwt" else m.start(group), m.end(group)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, spans)`` per row; ``spans`` is an array of ``(kind, start, end)``."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(span))])
    words: list[ahocorasick.Automaton] = []

    def run(ids, texts):
        if not words:
            words.append(automaton())
        found = [[dict(zip(("kind", "start", "end"), s)) for s in find(t.as_py(), words[0])] for t in texts]
        return {"doc_id": ids, "spans": pa.array(found, schema.field("spans").type)}

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(by_batches(run, schema, "doc_id", "text"), "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with its spans and the digest of the base ones."""
    found = scan(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    listed = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS[:3]))
    return found.select("doc_id", *map(count, KINDS[:3]), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
