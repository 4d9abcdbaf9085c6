"""Secret scan: Aho-Corasick prefilter, anchored patterns near hits, checksums.

One automaton over the text finds keywords (every letter-case form of the
assignment names, key prefixes) and all four-digit lower-case hex words; a hex run
long enough to matter holds one at its very start. Patterns are matched only where
the automaton hit. Token formats that carry a checksum are reported only if it holds:

* ``github``, ``npm``: six base-62 digits at the end are the CRC-32 of the 30
  characters before them;
* ``xprv``: an extended private key in base-58 whose last four bytes are the start
  of the double SHA-256 of the rest.

Defined results: a null text is empty and has no span; positions are code points,
ends exclusive; kinds may overlap, spans of one kind never do; repeated rows are
scanned each.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwatch.llm.common import annotate, doc_columns, field, fresh, text_strings

# Names, patterns and alphabets of the formats.
KINDS = ("assign", "access", "hex", "github", "npm", "xprv")
BASE_KINDS = 3
NAMES = ("password", "passwd", "secret", "token", "api_key", "apikey")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
CHECKED = {"github": (("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"),
           "npm": (("npm_",), r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"),
           "xprv": (("xprv", "tprv"), r"([xt]prv[1-9A-HJ-NP-Za-km-z]{107})(?![1-9A-HJ-NP-Za-km-z])()")}
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
MASK = "[SECRET]"


def crc_base62(body: str) -> str:
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = BASE62[d] + out
    return out


def base58_holds(key: str) -> bool:
    n = 0
    for c in key:
        n = n * 58 + BASE58.index(c)
    if n.bit_length() > 82 * 8:
        return False
    raw = n.to_bytes(82, "big")
    return hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


def build_scanner():
    """The scan function text -> [(start, kind number, end)] sorted by start, then kind."""
    import ahocorasick

    auto = ahocorasick.Automaton(ahocorasick.STORE_ANY)
    digits = "0123456789abcdef"
    for gram in itertools.product(digits, repeat=4):
        auto.add_word("".join(gram), (2, 4))
    for name in NAMES:
        for form in itertools.product(*({c.lower(), c.upper()} for c in name)):
            auto.add_word("".join(form), (0, len(name)))
    auto.add_word("AKIA", (1, 4))
    for k, (heads, _) in enumerate(CHECKED.values(), BASE_KINDS):
        for head in heads:
            auto.add_word(head, (k, len(head)))
    auto.make_automaton()
    assign, access, run = re.compile(ASSIGN, re.A).match, re.compile(ACCESS).match, re.compile(HEX).match
    checked = [re.compile(p).match for _, p in CHECKED.values()]

    def scan(text: str) -> list[tuple[int, int, int]]:
        spans, hits, hex_end = [], [], 0
        for end, (kind, size) in auto.iter(text):
            start = end - size + 1
            if kind != 2:
                hits.append((start, kind))
            elif start >= hex_end:  # else inside the run seen last
                hex_end = run(text, start).end()
                if hex_end - start >= MIN_HEX:
                    spans.append((start, 2, hex_end))
        if hits:
            hits.sort()
            reached = [0] * len(KINDS)
            for start, kind in hits:
                if start < reached[kind]:
                    continue
                if kind == 0:
                    m = assign(text, start)
                    good = m and m.end(2) - m.start(2) >= MIN_ASSIGN
                elif kind == 1:
                    m = access(text, start)
                    good = m.end() - start >= MIN_ACCESS if m else False
                else:
                    m = checked[kind - BASE_KINDS](text, start)
                    good = m and (base58_holds(m[1]) if KINDS[kind] == "xprv" else crc_base62(m[1]) == m[2])
                if m:
                    reached[kind] = m.end()
                if good:
                    spans.append((start, kind, m.end()))
            spans.sort()
        return spans

    return scan


def write_spans(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def mask(text: str, spans) -> str:
    """The text with each stretch of overlapping spans replaced by one mark."""
    out, at = [], 0
    for s, _, e in spans:
        if s >= at:
            out += [text[at:s], MASK]
        at = max(at, e)
    return "".join(out) + text[at:]


def scan(docs: DataFrame, masked: bool = False) -> DataFrame:
    """One row per document: counts of the base kinds, their digest, all spans and,
    if asked, the text with all spans masked."""
    fields = [field(f"n_{k}", "bigint") for k in KINDS[:BASE_KINDS]] + [field("base_sha256", "string"), field("spans", "string")] + [field("masked_text", "string")] * masked

    def work():
        scanner = build_scanner()

        def on_batch(batch: pa.RecordBatch):
            rows = []
            for text in text_strings(batch, "text"):
                spans = scanner(text)
                base = [x for x in spans if x[1] < BASE_KINDS]
                count = [0] * BASE_KINDS
                for x in base:
                    count[x[1]] += 1
                rows.append((*count, hashlib.sha256(write_spans(base).encode()).hexdigest(), write_spans(spans), *([mask(text, spans)] * masked)))
            return list(zip(*rows, strict=True))

        return on_batch

    return annotate(doc_columns(docs), "text", fields, work).drop("text")


def mask_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with every secret in ``text`` masked and ``n_chars`` (if there is
    one) counted anew where the text changed; same rows and columns."""
    new = fresh("masked", docs.columns)

    def work():
        scanner = build_scanner()

        def on_batch(batch: pa.RecordBatch):
            out = []
            for text in batch.column("text").to_pylist():
                spans = scanner(text) if text else []
                out.append(mask(text, spans) if spans else None)
            return [out]

        return on_batch

    done = annotate(docs, "text", [field("masked", "string")], work, [new])
    changed = F.col(new).isNotNull()
    swap = {"text": F.when(changed, F.col(new)).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        swap["n_chars"] = F.when(changed, F.length(new).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return done.select(*[swap[c].alias(c) if c in swap else F.col(c) for c in docs.columns])
