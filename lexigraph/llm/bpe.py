"""Byte-level BPE over pre-tokens, with caches that live as long as a worker process."""

from __future__ import annotations

import base64
import re
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import SparkSession

from lexigraph.llm.textops import Texts

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_exact = regex.compile(PATTERN).findall
# the same pattern for texts of nothing but printable ASCII, tab, line ends and Latin-1 letters, where these classes agree
_latin = re.compile(r"[\t\n\r\x20-\x7eÀ-ÖØ-öø-ÿ]*").fullmatch
_fast = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+").findall


def pretokens(text: str) -> list[str]:
    return _fast(text) if _latin(text) else _exact(text)


LETTER, NUMBER, SPACE = 1, 2, 3


@cache
def classes() -> np.ndarray:
    """The pattern's class of each code point: a letter, a number, white space or (0) anything else."""
    table = np.zeros(0x110000, dtype=np.uint8)
    for lo, hi in ((0, 0xD800), (0xE000, 0x110000)):
        every = "".join(map(chr, range(lo, hi)))
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            for m in regex.finditer(pattern, every):
                table[lo + m.start() : lo + m.end()] = kind
    return table


def pretoken_offsets(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(byte offsets of the pre-tokens of texts, which tile them; for each text the number of pre-tokens before it), both with the end.

    The pattern without a regular expression: runs of one class, of which a run
    of white space gives up its last character and, if that is a blank, lends
    it to the run behind; and the contractions, that begin at a lone quote.
    """
    raw = texts.data.tobytes()
    codes = np.frombuffer(raw.decode().encode("utf-32-le"), dtype="<u4")
    n = len(codes)
    width = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
    place = np.append(0, np.cumsum(width))
    kind = classes()[codes]
    edge = np.zeros(n + 4, dtype=bool)
    edge[np.searchsorted(place, texts.offsets)] = True
    edge[n:] = True
    run = np.append(edge[:n], True)
    run[1:n] |= kind[1:] != kind[:-1]
    start = run.copy()
    behind = np.flatnonzero(run[1:n] & ~edge[1:n] & (kind[:-1] == SPACE)) + 1
    start[behind - 1] = True
    start[behind[codes[behind - 1] == 32]] = False
    code = np.append(codes, np.zeros(3, dtype=codes.dtype))
    quote = np.flatnonzero((codes == 39) & start[:n] & ~edge[1 : n + 1])
    quote = quote[kind[quote + 1] == LETTER]
    a, b = code[quote + 1], np.where(edge[quote + 2], 0, code[quote + 2])
    one = np.isin(a, [ord(c) for c in "stmd"])
    two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
    start[quote[one | two] + 1] = False
    start[np.concatenate([quote[one] + 2, quote[two] + 3])] = True
    at = place[np.flatnonzero(start[:n])]
    return np.append(at, len(raw)), np.searchsorted(at, texts.offsets)


def pretoken_codes(texts: Texts) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(the different pre-tokens, the place of each pre-token among them, for each text the number before it)."""
    offsets, first = pretoken_offsets(texts)
    column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(texts.data.tobytes())])
    coded = column.dictionary_encode()
    _, ends, data = coded.dictionary.buffers()
    ends, blob = np.frombuffer(ends, dtype=np.int64)[: len(coded.dictionary) + 1].tolist(), data.to_pybytes() if data else b""
    return [blob[a:b] for a, b in zip(ends, ends[1:])], coded.indices.to_numpy().astype(np.int64), first


def read_ranks(spark: SparkSession, path: str):
    """The vocabulary file, read once by the driver and broadcast; its size is that of a vocabulary."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def parse(blob: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, blob.splitlines())}


_encodings: dict[int, object] = {}


def encoding(blob: bytes):
    """The encoder of this vocabulary, built once in each worker process."""
    import tiktoken

    key = hash(blob)
    if key not in _encodings:
        _encodings[key] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=parse(blob), special_tokens={})
    return _encodings[key]
