"""Byte-level BPE of whole texts by tree concatenation.

A long text is cut in halves down to leaves, the leaves are encoded on their
own, and each join is mended: a window around it is encoded anew and grows until
both sides agree with it exactly. Two kinds of agreement are exact:

* the window reaches, on either side, a place where the splitting pattern must
  cut whatever lies further away (the end of a run of one class of characters);
* within one unbroken run the window's first token is the left side's token at
  that place and its last token the right side's. Every pair of neighbours in
  the joined ids then stands in some valid encoding, which makes the whole valid.
"""

import json
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbside.llm.common import small_batches, texts

VOCABULARY = "byte_bpe_50k.json"
#: Texts up to this many characters are leaves.
LEAF_CHARS = 1 << 14
#: Characters on either side of a join in the first window.
WINDOW_CHARS = 48

# The splitting pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Places where that pattern cuts, however the text goes on.
CUT = regex.compile(
    r"(?<=\S)(?=\s)|(?<=\p{L})(?=\P{L})|(?<=\p{N})(?=\P{N})|(?<=[^\s\p{L}\p{N}'])(?=[\p{L}\p{N}])"
)
UNBROKEN = regex.compile(r"\p{L}+|\p{N}+")


def letter_of_byte() -> dict[int, str]:
    """Byte-level vocabularies write a byte as the character of its number if
    that is printable, else as the next free one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class TreeBpe:
    """Encodes and decodes as the vocabulary file at ``path`` says."""

    def __init__(self, path: str, leaf_chars: int = LEAF_CHARS):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = {letter: b for b, letter in letter_of_byte().items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {
            bytes(byte[c] for c in token): number
            for token, number in spec["model"]["vocab"].items()
            if number not in self.special.values()
        }
        self.core = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        names = sorted(map(regex.escape, self.special), key=len, reverse=True)
        self.specials = regex.compile("(" + "|".join(names) + ")")
        self.leaf_chars = leaf_chars

    def encode(self, text: str) -> list[int]:
        if not any(name in text for name in self.special):
            return self._tree(text)
        ids: list[int] = []
        for part in self.specials.split(text):
            ids.extend([self.special[part]] if part in self.special else self._tree(part))
        return ids

    def decode(self, ids: list[int]) -> str:
        return self.core.decode(ids, errors="replace")

    def _tree(self, text: str) -> list[int]:
        if len(text) <= self.leaf_chars:
            return self.core.encode_ordinary(text)
        middle = len(text) // 2
        left, right = text[:middle], text[middle:]
        return self._join(left, self._tree(left), right, self._tree(right))

    def _join(self, left: str, a: list[int], right: str, b: list[int]) -> list[int]:
        size = WINDOW_CHARS
        while True:
            tail, head = left[-size:], right[:size]
            places = [m.start() for m in CUT.finditer(tail)]
            begin = places[-1] if places else 0 if len(tail) == len(left) else None
            m = CUT.search(head)
            end = m.start() if m else len(head) if len(head) == len(right) else None
            if begin is not None and end is not None:
                old_a = self.core.encode_ordinary(tail[begin:])
                old_b = self.core.encode_ordinary(head[:end])
                if a[len(a) - len(old_a) :] == old_a and b[: len(old_b)] == old_b:
                    fresh = self.core.encode_ordinary(tail[begin:] + head[:end])
                    return a[: len(a) - len(old_a)] + fresh + b[len(old_b) :]
            elif UNBROKEN.fullmatch(tail + head):
                joined = self._join_run(a, b, size)
                if joined is not None:
                    return joined
            size *= 2

    def _continues(self, token: int) -> bool:
        return self.core.decode_single_token_bytes(token)[0] & 0xC0 == 0x80

    def _join_run(self, a: list[int], b: list[int], size: int) -> list[int] | None:
        """The join within one run of letters or of digits, of which ``size``
        characters on either side are known; None if the sides disagree."""
        i, j = len(a) - max(2, size // 16), max(2, size // 16)
        while i > 0 and self._continues(a[i]):
            i -= 1
        while j < len(b) and self._continues(b[j]):
            j += 1
        if i <= 0 or j >= len(b):
            return None
        before = self.core.decode_bytes(a[i:]).decode()
        after = self.core.decode_bytes(b[:j]).decode()
        if len(before) > size or len(after) > size:
            return None
        fresh = self.core.encode_ordinary(before + after)
        if fresh[0] == a[i] and fresh[-1] == b[j - 1]:
            return a[:i] + fresh + b[j:]
        return None


@lru_cache(maxsize=4)
def coder(path: str) -> TreeBpe:
    """One coder for each worker and vocabulary."""
    return TreeBpe(path)


def _sha256(data: bytes) -> str:
    import hashlib

    return hashlib.sha256(data).hexdigest()


def ids_of(path: str | None = None):
    """Column function: text to its token ids, null as the empty text."""

    @F.arrow_udf("array<int>")
    def encoded(text: pa.Array) -> pa.Array:
        bpe = coder(path or public_tokenizers.path(VOCABULARY))
        parts = [np.array(bpe.encode(t), dtype=np.int32) for t in texts(text)]
        ends = np.cumsum([0] + [len(p) for p in parts]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.array([], np.int32)))

    return encoded


def digests_of(path: str | None = None):
    """Column function: text to the number and digest of its ids and the
    digest of the text that they decode to."""
    kind = "struct<n_tokens: bigint, ids_sha256: string, decoded_sha256: string>"

    @F.arrow_udf(kind)
    def round_trip(text: pa.Array) -> pa.Array:
        bpe = coder(path or public_tokenizers.path(VOCABULARY))
        counts, coded, decoded = [], [], []
        for t in texts(text):
            ids = bpe.encode(t)
            counts.append(len(ids))
            coded.append(_sha256(np.array(ids, dtype="<u4").tobytes()))
            decoded.append(_sha256(bpe.decode(ids).encode()))
        return pa.StructArray.from_arrays(
            [pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())],
            names=["n_tokens", "ids_sha256", "decoded_sha256"],
        )

    return round_trip


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and ids (array<int>) of each row. Null and empty texts
    have no ids; a text may be of any length; repeated rows give a row each."""
    small_batches(docs.sparkSession)
    coded = docs.select("doc_id", ids_of(path)("text").alias("ids"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


def round_trips(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row: encoded,
    decoded again, digested. Cases as in ``encode_documents``."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", digests_of(path)("text").alias("r")).select("doc_id", "r.*")
