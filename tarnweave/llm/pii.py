"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, digits, plus signs before digits, schemes and identifier
cues. Deterministic parsers then expand each anchor to both sides and validate what they find. Parsers are linear in
the text: a run of characters is expanded once.

Base kinds follow these patterns, leftmost and non-overlapping within a kind; matches that fail the check are dropped:
email ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``; ip ``[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)`` with parts
up to 255; card ``[0-9]([ -]?[0-9])+`` of 16 to 19 digits that pass Luhn's check; phone ``\\+[0-9][ ().0-9-]+[0-9]`` of
8 to 15 digits. Anchors add the kinds url, iban (modulo 97), account (a cue, a separator and a value) and key.

Defined results: null and empty texts have no spans; offsets are code points, ends exclusive; rows are neither merged
nor dropped; texts are searched whole; only the id and text columns are read.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from tarnweave.llm.bpe import slices
from tarnweave.llm.worker import release

KINDS = ("email", "ip", "card", "phone", "url", "iban", "account", "key")
BASE = KINDS[:4]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_dotted = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_grouped = re.compile(r"[0-9](?:[ -]?[0-9])+")
_dialled = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_url = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+(?::[0-9]+)?(?:[/?#][^\s<>\"'`{}|\\^]*)?")
_iban = re.compile(r"[ :=#]{0,3}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Z0-9])")
_value = re.compile(r"[ \t]*[:=#][ \t]*[\"']?([A-Za-z0-9][A-Za-z0-9._@/+-]{3,})")
_key = re.compile(r"[A-Z0-9]{16}(?![A-Za-z0-9])")
SCHEMES = ("http://", "https://", "ftp://")
CUES = ("account", "acct", "password", "passwd", "pwd", "ssn", "user", "username", "login", "api_key", "apikey", "secret", "token", "passport", "customer id", "konto", "compte", "cuenta")


@lru_cache(maxsize=1)
def _anchors() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for d in "0123456789":
        a.add_word(d, ("digit", 1))
        a.add_word("+" + d, ("phone", 2))
    a.add_word("@", ("email", 1))
    for s in SCHEMES:
        a.add_word(s, ("url", len(s)))
    for c in CUES:
        for form in {c, c.upper(), c.capitalize()}:
            a.add_word(form, ("account", len(c)))
    a.add_word("IBAN", ("iban", 4))
    for k in ("AKIA", "ASIA"):
        a.add_word(k, ("key", 4))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def find_pii(text: str | None) -> dict[str, list[tuple[int, int]]]:
    """Spans (start, end) of each kind, by start."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if not text:
        return found
    after_email = after_ip = after_card = 0
    alnum = lambda i: 0 <= i < len(text) and (text[i].isalnum() or text[i] == "_")
    for end, (kind, size) in _anchors().iter(text):
        start = end + 1 - size
        if kind == "digit":
            if start >= after_ip:
                m = _dotted.match(text, start)
                at, parts = start, m[0].split(".")
                after_ip = m.end()
                for k in range(0, len(parts) - 3, 4):
                    four = parts[k : k + 4]
                    stop = at + sum(map(len, four)) + 3
                    if all(map(_small, four)):
                        found["ip"].append((at, stop))
                    at = stop + 1
            if start >= after_card:
                m = _grouped.match(text, start)
                after_card = m.end() if m else start + 1
                if m and m.end() - m.start() >= 16:
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 16 <= len(digits) <= 19 and luhn(digits):
                        found["card"].append(m.span())
        elif kind == "email":
            left = start
            while left > after_email and text[left - 1] in _LOCAL:
                left -= 1
            if left < start and (m := _domain.match(text, start + 1)):
                found["email"].append((left, m.end()))
                after_email = m.end()
        elif kind == "phone":
            if m := _dialled.match(text, start):
                if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                    found["phone"].append(m.span())
        elif kind == "url":
            if not alnum(start - 1) and (m := _url.match(text, end + 1)):
                stop = end + 1 + len(m[0].rstrip(".,;:!?)]"))
                found["url"].append((start, stop))
        elif kind == "iban":
            if not alnum(start - 1) and (m := _iban.match(text, end + 1)):
                code = m[1].replace(" ", "")
                if len(code) <= 34 and int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1:
                    found["iban"].append(m.span(1))
        elif kind == "account":
            if not alnum(start - 1) and (m := _value.match(text, end + 1)):
                value = m[1].rstrip("._@/+-")
                if len(value) >= 4 and any(c.isdigit() for c in value):
                    found["account"].append((m.start(1), m.start(1) + len(value)))
        elif not alnum(start - 1) and (m := _key.match(text, end + 1)):
            found["key"].append((start, m.end()))
    for kind in KINDS[4:]:  # cues may lie within one another
        found[kind] = sorted(set(found[kind]))
    return found


def written(found: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join([f"{k}:{a}:{b}" for k in kinds for a, b in found[k]])


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's (id, n_<base kind>..., base, spans); spans as ``kind:start:end``, by kind, then start.

    A map over partitions: no shuffle, two columns read.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        release()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                found = [find_pii(t) for t in texts[a:b]]
                counts = [pa.array([len(f[k]) for f in found], pa.int64()) for k in BASE]
                both = [pa.array([written(f, ks) for f in found], pa.string()) for ks in (BASE, KINDS)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *counts, *both], names=["id", *(f"n_{k}" for k in BASE), "base", "spans"])

    schema = f"id {kind}, {', '.join(f'n_{k} long' for k in BASE)}, base string, spans string"
    return docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, schema)


def redact(text: str | None, mark: str = "[{}]") -> str | None:
    """``text`` with every span replaced by its kind; of overlapping spans the one that starts first, then the longer."""
    if not text:
        return text
    spans = sorted((a, -b, k) for k, found in find_pii(text).items() for a, b in found)
    out, at = [], 0
    for a, b, k in spans:
        if a >= at:
            out += [text[at:a], mark.format(k)]
            at = -b
    return "".join([*out, text[at:]])
