"""Whole texts to ids for tokenizer files of the byte-level kind.

Where a file says just what the rank encoder does (byte-level pieces, merges in id order, nothing else),
ids come from that encoder, which is several times faster; otherwise from the tokenizers library itself.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Callable
from functools import lru_cache

import regex
import tiktoken

#: Fixed: the pattern of the byte-level pre-tokenizer.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte: printable ones for themselves, the rest from 256 upwards."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


def token_bytes(token: str, alphabet: dict[str, int]) -> bytes:
    return bytes(map(alphabet.__getitem__, token))


def _plain_ranks(spec: dict) -> dict[bytes, int] | None:
    """Ranks by token bytes, if the file is of the plain kind."""
    model, pre = spec["model"], spec["pre_tokenizer"] or {}
    if spec["normalizer"] or spec["post_processor"] or model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        return None
    if any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return None
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
        return None
    added = {t["content"] for t in spec["added_tokens"]}
    vocab = {k: v for k, v in model["vocab"].items() if k not in added}
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    if sorted(vocab.values()) != list(range(len(vocab))) or len(vocab) != 256 + len(merges) or any(vocab.get(a + b) != 256 + k for k, (a, b) in enumerate(merges)):
        return None
    alphabet = byte_alphabet()
    return {token_bytes(k, alphabet): v for k, v in vocab.items()}


@lru_cache(maxsize=4)
def text_encoder(data: bytes) -> Callable[[str], bytes]:
    """From the bytes of a tokenizer file: text to ids as little-endian unsigned 32-bit integers, special strings
    inside the text as the library handles them by default, no special token added."""
    spec = json.loads(data)
    ranks = _plain_ranks(spec)
    if ranks is None:
        from tokenizers import Tokenizer

        whole = Tokenizer.from_str(data.decode())
        return lambda text: array("I", whole.encode(text, add_special_tokens=False).ids).tobytes()
    encode = tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    special = {t["content"]: array("I", [t["id"]]).tobytes() for t in spec["added_tokens"]}
    if not special:
        return lambda text: array("I", encode(text)).tobytes()
    cut = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")")

    def ids(text: str) -> bytes:
        if not any(s in text for s in special):
            return array("I", encode(text)).tobytes()
        return b"".join(special[part] if k % 2 else array("I", encode(part)).tobytes() for k, part in enumerate(cut.split(text)))

    return ids


def read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()
