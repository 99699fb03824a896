"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are split before the library sees them, at boundaries that are safe for patterns of runs of one kind
(letters, digits, other signs, white space) with an optional space in front, as PATTERN is: between any other character and white
space, and between a letter and a punctuation mark or a combining mark. No match covers such a
pair of characters, and no look-ahead looks past it from the left, so encoding the pieces
one after another gives the ids of the whole text. A text without any such boundary is one match
and goes to the library as one piece. White space is the exception, as the library's pattern engine steps back over each of its characters and has a bound: in texts longer
than a piece, runs of ``RUN`` or more are taken out by the pattern's own rule. All of a run at the end of the text is one match, elsewhere all but its last character, which goes with what follows; such a
match is encoded as bytes, without the pattern. Decoding joins raw bytes, so pieces that end inside a character do no harm.

Ids are gathered in flat 32-bit buffers, a few hundred texts at a time, never as lists of Python numbers for a whole batch.

Null texts count as empty; an empty text has no ids and decodes to no bytes.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StructField, StructType

from .common import free_name, map_rows

#: Target length, in characters, of the pieces of a long text.
PIECE = 65536
#: Letters of scripts whose code charts are settled, and marks that may follow them without white space.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02af\u0391-\u03a1\u03a3-\u03ce\u0400-\u0481\u048a-\u052f\u05d0-\u05ea\u0620-\u064a\u0904-\u0939\u0e01-\u0e30\u0e32\u0e33\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
_MARKS = "!-&(-/:-@\\[-`{-~\u00ab\u00bb\u0301\u060c\u061b\u061f\u064b-\u0652\u0964\u0965\u0e31\u0e34-\u0e3a\u2013\u2014\u2018-\u201e\u2026\u3001\u3002\u3008-\u3011\uff01\uff08\uff09\uff0c\uff1a\uff1b\uff1f"
_SAFE = re.compile(rf"(?<=\S)(?=[ \t\n\r])|(?<=[{_LETTERS}])(?=[{_MARKS}])")
#: White space as the pattern's engine has it, and the length of a run that is matched by rule.
_SPACES = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
RUN = 4096
#: Texts whose ids or bytes are gathered before they go into a flat buffer.
_SLICE = 256


@lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str) -> tiktoken.Encoding:
    """The encoding of a rank file, built once in each Python worker."""
    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) }
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def split_safely(text: str, piece: int = PIECE) -> list[str]:
    """Cut a text into pieces of about ``piece`` characters, only at safe boundaries."""
    out, start = [], 0
    while len(text) - start > piece:
        found = _SAFE.search(text, start + piece)
        if not found:
            break
        out.append(text[start : found.start()])
        start = found.start()
    out.append(text[start:])
    return out


def ids_of(text: str | None, enc: tiktoken.Encoding, piece: int = PIECE, run: int = RUN) -> np.ndarray:
    """Ids of a whole text as 32-bit numbers; strings of special tokens are ordinary text."""
    if not text:
        return np.zeros(0, np.uint32)
    if len(text) <= piece:
        return enc.encode_to_numpy(text, disallowed_special=())
    parts, at = [], 0

    def plain(end: int) -> None:
        parts.extend(enc.encode_to_numpy(p, disallowed_special=()) for p in split_safely(text[at:end], piece) if p)

    for m in _SPACES.finditer(text):
        if m.end() - m.start() >= run:
            plain(m.start())
            at = m.end() if m.end() == len(text) else m.end() - 1
            parts.append(np.array(enc._encode_single_piece(text[m.start() : at]), np.uint32))
    plain(len(text))
    return np.concatenate(parts)


def encode_text(text: str | None, enc: tiktoken.Encoding, piece: int = PIECE) -> list[int]:
    """Ids of a whole text as a list."""
    return ids_of(text, enc, piece).tolist()


def _gather(values: pa.Array, f: Callable[[object], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and the flat results of ``f`` over a column, without a list of a whole batch's Python values."""
    lengths, parts = [0], []
    for start in range(0, len(values), _SLICE):
        got = [f(x) for x in values.slice(start, _SLICE).to_pylist()]
        lengths += [len(x) for x in got]
        parts.append(np.concatenate(got))
    ends = np.cumsum(lengths, dtype=np.int64)
    if ends[-1] > np.iinfo(np.int32).max:
        raise ValueError("one Arrow batch has more than 2**31 ids; lower spark.sql.execution.arrow.maxRecordsPerBatch")
    return ends.astype(np.int32), np.concatenate(parts) if parts else np.zeros(0)


def encode(docs: DataFrame, rank_file: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with a column ``out`` of token ids (array<int>); no shuffle.

    Clashing column names get underscores in front of ours. Every row stays, in any state.
    """

    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = encoding(rank_file, pattern)
        for col in it:
            offsets, ids = _gather(col, lambda t: ids_of(t, enc))
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))

    return _append(docs, text, run, "array<int>", out)


def decode(rows: DataFrame, rank_file: str, pattern: str, ids: str = "ids", out: str = "bytes") -> DataFrame:
    """``rows`` with a binary column ``out``: the raw bytes that the ids stand for (null ids: none)."""

    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = encoding(rank_file, pattern)
        for col in it:
            offsets, raw = _gather(col, lambda x: np.frombuffer(enc.decode_bytes(x) if x else b"", np.uint8))
            yield pa.BinaryArray.from_buffers(pa.binary(), len(col), [None, pa.py_buffer(offsets), pa.py_buffer(raw.astype(np.uint8))])

    return _append(rows, ids, run, "binary", out)


def round_trip(docs: DataFrame, rank_file: str, pattern: str, text: str = "text", keep: bool = True) -> DataFrame:
    """``docs`` with columns ``ids`` (array<int>) and ``round_trip``: whether the decoded ids are the text's bytes. Without ``keep`` the text goes.

    Both come from one pass, a few hundred texts at a time, so a task holds one incoming batch of texts and few ids. Clashing column names get underscores in front of ours.
    """
    others = [c for c in docs.columns if keep or c != text]
    names = [free_name(n, docs.columns) for n in ("ids", "round_trip")]
    place = [docs.columns.index(c) for c in others]
    at = docs.columns.index(text)
    kept = docs.select(*[F.col(f"`{c}`") for c in others]).schema
    out = StructType([*kept.fields, StructField(names[0], ArrayType(IntegerType())), StructField(names[1], BooleanType())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for batch in it:
            for start in range(0, batch.num_rows, _SLICE):
                part = batch.slice(start, _SLICE)
                same: list[bool] = []

                def one(t, same=same):
                    ids = ids_of(t, enc)
                    same.append(enc.decode_bytes(ids.tolist()) == (t or "").encode("utf-8", "surrogatepass"))
                    return ids

                offsets, ids = _gather(part.column(at), one)
                got = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32))), pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in place), *got], names=out.names)

    return docs.mapInArrow(run, out)


def _append(df: DataFrame, column: str, run, kind: str, out: str) -> DataFrame:
    """A column from an Arrow-batched Python function, beside all others."""
    # Annotations are strings in this module; the UDF's kind is read from real types.
    run.__annotations__ = {"it": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return df.withColumn(free_name(out, df.columns), F.arrow_udf(run, kind)(F.col(column)))


def digests(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text: encode, then decode the ids."""

    def row(doc_id, text, enc):
        ids = ids_of(text, enc)
        back = enc.decode_bytes(ids.tolist())
        return doc_id, len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(back).hexdigest()

    return map_rows(
        docs, ["doc_id", "text"], row, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
        lambda: (encoding(rank_file, pattern),),
    )
