"""Token ids of whole texts by a public byte-level BPE vocabulary file."""

from __future__ import annotations

import json
import re
import zlib
from array import array
from functools import lru_cache

#: The id after each document.
END = 1
#: How a file's pre-tokenizer `ByteLevel` with `use_regex` cuts a text into words before merging (a fixed value).
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_path(name: str = "byte_bpe_50k.json") -> str:
    """Where a public vocabulary file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_of_char() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others, in order, from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _pattern(spec: dict) -> str | None:
    """The file's word pattern, where the file is a plain byte-level BPE; None for every other kind."""
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = spec.get("normalizer") is None and not model.get("dropout") and not model.get("byte_fallback") and not model.get("end_of_word_suffix") and not model.get("ignore_merges")
    flags = any(t[f] for t in spec["added_tokens"] for f in ("single_word", "lstrip", "rstrip"))
    if plain and not flags and model["type"] == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
        return BYTE_LEVEL
    return None


@lru_cache(maxsize=2)
def encoder(path: str):
    """A function from a text to its ids without added special tokens, one for each worker and file.

    The ids are those of `tokenizers` with the file as it is: strings of the file's added tokens get their
    own ids, and what lies between them is encoded on its own. For byte-level files, whose merges stand in
    the order of the ids, `tiktoken` gives the same ids several times faster; other files go to `tokenizers`.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pattern = _pattern(spec)
    if pattern is None:
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        return lambda text: whole.encode(text, add_special_tokens=False).ids
    import tiktoken

    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    to_byte = byte_of_char()
    ranks = {bytes(to_byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
    plain = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    if not added:
        return plain
    marks = re.compile("(" + "|".join(re.escape(c) for c in sorted(added, key=len, reverse=True)) + ")")

    def encode(text: str) -> list[int]:
        parts = marks.split(text)
        if len(parts) == 1:
            return plain(text)
        return [i for k, p in enumerate(parts) for i in ([added[p]] if k % 2 else plain(p))]

    return encode


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit numbers."""
    a = array("I", ids)
    if a.itemsize != 4:
        raise RuntimeError("unsigned int has 4 bytes on all platforms Spark runs on")
    import sys

    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()


def crc(ids: bytes) -> int:
    """Unsigned crc32 of packed ids."""
    return zlib.crc32(ids)
