"""Ids of a byte-level BPE tokenizer file.

Ids of such vocabularies rise with the order of their merges, so the lowest id that
two neighbours make is the next merge: a rank encoder gives the same ids as the
file's own library, several times as fast (tests compare the two over the whole
vocabulary and whole tables).
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers

#: Characters of a text that are encoded together; a longer one is cut between words.
PIECE_CHARS = 1_000_000
#: A blank between two characters that are no white space: a pre-token starts there.
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")


def byte_characters() -> dict[str, int]:
    """The printable characters that stand for bytes in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(c): b for c, b in zip([*shown, *range(256, 256 + len(hidden))], [*shown, *hidden], strict=True)}


def between_words(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """``text`` cut before blanks between words, in pieces of about ``size`` characters."""
    start = 0
    while len(text) - start > size and (cut := _BETWEEN.search(text, start + size)):
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


class ByteBpe:
    """Encoder of a tokenizer file; ``special`` strings inside texts get ids of their own, or are ordinary text."""

    def __init__(self, path: str, special: bool):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        byte_of = byte_characters()
        ranks = {bytes(byte_of[c] for c in token): k for token, k in spec["model"]["vocab"].items() if token not in added}
        if spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"] or any(ranks[bytes([b])] > 255 for b in range(256)):
            raise ValueError(f"{path} is no plain byte-level vocabulary")
        self.encode = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.bytes_of: list[bytes] = [b""] * (max([*ranks.values(), *added.values()]) + 1)
        for token, k in [*ranks.items(), *((t.encode(), k) for t, k in added.items())]:
            self.bytes_of[k] = token
        self.added = added
        self.splitter = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if special and added else None

    def ids(self, text: str) -> np.ndarray:
        found: list[np.ndarray] = []
        for k, part in enumerate(self.splitter.split(text) if self.splitter else [text]):
            if k % 2:
                found.append(np.array([self.added[part]], np.uint32))
            else:
                found += [np.array(self.encode(p), np.uint32) for p in between_words(part)]
        return found[0] if len(found) == 1 else np.concatenate(found)


_loaded: dict[tuple[str, bool], ByteBpe] = {}


def byte_bpe(path: str, special: bool) -> ByteBpe:
    """The encoder, loaded once in a Python worker."""
    if (path, special) not in _loaded:
        _loaded[path, special] = ByteBpe(path, special)
    return _loaded[path, special]
