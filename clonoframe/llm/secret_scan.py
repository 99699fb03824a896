"""Secret scans: fixed rules, and sliding-window Shannon entropy for each character class.

Base rules (kinds ``assign``, ``access``, ``hex``) are leftmost non-overlapping matches of each kind. The
method adds kind ``entropy``: candidates are maximal runs of base64-like characters; over each run a window slides,
whose character counts, and with them the sum of c*log2(c), are updated by one character in and one
out. Once a window is at or above its class's threshold, the whole candidate is a span. Allow-listed candidates (identifiers
of known form, rules) give no entropy span. Allow-listed pieces (placeholders, alphabets) cut a candidate into parts
that are judged and masked each for itself. Base spans always stay.

Offsets are code points, ends exclusive. Null texts count as empty and have no spans.
"""

from __future__ import annotations

import hashlib
import re
from math import log2

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

KINDS = ("assign", "access", "hex", "entropy")
# The base rules.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KEYS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
#: (class, its characters, window, bits a character at least). A candidate is secret-like if any class holds one of its windows
#: whole at or above its threshold.
CLASSES = (
    ("hex", frozenset("0123456789abcdefABCDEF"), 20, 3.0),
    ("base64", frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"), 24, 4.0),
    ("lower", frozenset("abcdefghijklmnopqrstuvwxyz0123456789"), 20, 3.35),
    ("upper", frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 20, 3.35),
    ("short", frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"), 20, 3.65),
    ("letters", frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"), 20, 4.1),
)
#: Classes for candidates that are too short for a window of class base64.
SHORT, LONG = frozenset({"short", "letters"}), 24
#: Classes whose spans need a letter and a digit: long words aren't secrets.
MIXED = frozenset({"lower", "upper", "short"})
_WHOLE = {name: re.compile(f"[{re.escape(''.join(sorted(chars)))}]{{{window}}}") for name, chars, window, _ in CLASSES}
_LETTER, _DIGIT = re.compile("[A-Za-z]"), re.compile("[0-9]")
#: Words joined as in paths and identifiers: words in one case or capitalised, a few digits after them, short numbers.
_WORD = r"(?:[A-Z]?[a-z]{2,18}(?:[A-Z][a-z]{2,18})*|[a-z]|[A-Z]{1,12})[0-9]{0,3}|[0-9]{1,4}"
ALLOW = (
    re.compile(rf"[-=_+/]*(?:{_WORD})(?:[-=_+/]+(?:{_WORD}))*[-=_+/]*"),  # paths and identifiers
    re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"),  # UUID
    re.compile(r"[-=_+/]+"),  # rules of tables and headings
)


def _begun(first: str, rest: str) -> str:
    """A pattern of ``first`` and as much of ``rest`` as follows in order."""
    tail = ""
    for c in reversed(rest):
        tail = f"(?:{c}{tail})?"
    return first + tail


PIECE = re.compile("|".join((
    "EXAMPLE|example|PLACEHOLDER|placeholder|your[-_]",
    _begun("abcdefghijklm", "nopqrstuvwxyz"), _begun("ABCDEFGHIJKLM", "NOPQRSTUVWXYZ"),
    _begun("0123456789ab", "cdefghijklmnopqrstuvwxyz"), _begun("0123456789AB", "CDEFGHIJKLMNOPQRSTUVWXYZ"),
)))
_CLOGC = [0.0] + [c * log2(c) for c in range(1, 4096)]


def entropy_windows(run: str, chars: frozenset, window: int, bits: float) -> list[tuple[int, int]]:
    """Merged spans of the windows of one class whose entropy is at least ``bits``."""
    counts: dict[str, int] = {}
    total, inside, spans = 0.0, 0, []
    most = window * (log2(window) - bits) + 1e-9
    for i, c in enumerate(run):
        k = counts.get(c, 0)
        counts[c] = k + 1
        total += _CLOGC[k + 1] - _CLOGC[k]
        inside += c in chars
        if i >= window:
            out = run[i - window]
            k = counts[out]
            counts[out] = k - 1
            total += _CLOGC[k - 1] - _CLOGC[k]
            inside -= out in chars
        if i >= window - 1 and inside == window and total <= most:
            a, b = i - window + 1, i + 1
            if spans and a <= spans[-1][1]:
                spans[-1] = (spans[-1][0], b)
            else:
                spans.append((a, b))
    return spans


def secret_like(run: str) -> bool:
    """Whether any window of any class in ``run`` is at or above its threshold."""
    for name, chars, window, bits in CLASSES:
        if name in SHORT and len(run) >= LONG or not _WHOLE[name].search(run):
            continue
        for a, b in entropy_windows(run, chars, window, bits):
            if name not in MIXED or _LETTER.search(run, a, b) and _DIGIT.search(run, a, b):
                return True
    return False


def entropy_spans(text: str, allow=ALLOW) -> list[tuple[int, int]]:
    """The candidates, or their parts between allow-listed pieces, that hold a secret, each as a whole."""
    found = []
    for m in CANDIDATE.finditer(text):
        run = m[0]
        if any(a.fullmatch(run) for a in allow):
            continue
        cuts = [0, *(x for p in PIECE.finditer(run) for x in p.span()), len(run)]
        found += [(m.start() + a, m.start() + b) for a, b in zip(cuts[::2], cuts[1::2], strict=True) if secret_like(run[a:b])]
    return found


def scan(text: str | None, allow=ALLOW) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all spans of a whole text, by start, then kind as listed."""
    if not text:
        return []
    spans: list[tuple[int, int, str]] = []
    low = text.encode("utf-8", "surrogatepass").lower()
    if any(k in low for k in KEYS):
        spans += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    spans += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    spans += [(a, b, "entropy") for a, b in entropy_spans(text, allow)]
    spans.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    return spans


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row for each document: counts of the base kinds, the digest of the base spans, all spans."""

    def row(doc_id, text):
        spans = scan(text)
        base = [s for s in spans if s[2] != "entropy"]
        n = {k: sum(s[2] == k for s in spans) for k in KINDS}
        digest = hashlib.sha256(joined(base).encode()).hexdigest()
        return doc_id, n["assign"], n["access"], n["hex"], digest, joined(spans), n["entropy"]

    return map_rows(
        docs, ["doc_id", "text"], row,
        "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_entropy long",
    )


def redact_text(text: str | None, mark: str = "[SECRET]") -> str | None:
    """The text with each run of overlapping spans replaced by ``mark``; null stays null."""
    if not text:
        return text
    out, at = [], 0
    for a, b, _ in scan(text):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:] if out else text


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mark``; all rows and columns stay, no shuffle."""
    from collections.abc import Iterator

    import pyarrow as pa

    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in it:
            parts = [pa.array([redact_text(t, mark) for t in col.slice(k, 256).to_pylist()], pa.string()) for k in range(0, len(col), 256)]
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    # Annotations are strings in this module; the UDF's kind is read from real types.
    run.__annotations__ = {"it": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.withColumn(text, F.arrow_udf(run, "string")(F.col(text)))
