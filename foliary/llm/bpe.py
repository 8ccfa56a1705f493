"""Token ids of a published tokenizer, a slice of texts at a time.

Byte-level BPE tokenizers cut a text into pieces by a pattern before they merge, and a single space between two
characters that are not white space always begins a piece. So texts are cut at those spaces, each distinct part is
encoded once per worker, and a text's ids are put together from its parts'. Parts are merged by tiktoken with the ranks
of the same vocabulary file where its merges stand in the order of their ids; ids are those of the tokenizers library
(tests compare them). Any other tokenizer, and a text with other white space around a space, is encoded as a whole.
"""

from __future__ import annotations

import json
from array import array

import numpy as np
import tiktoken
from tokenizers import Tokenizer

#: Parts a worker remembers.
REMEMBERED = 600_000
# fixed value: the pattern of byte-level pre-tokenizers
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_OPEN: dict[str, Encoder] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _bytes_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _ranks(kind: dict) -> dict[bytes, int] | None:
    """Ranks of a byte-level vocabulary, or None if merging by rank could differ from its list of merges."""
    pre, model = kind.get("pre_tokenizer") or {}, kind.get("model") or {}
    plain = not kind.get("normalizer") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space", True) and pre.get("use_regex", True)
    if not plain or model.get("type") != "BPE":
        return None
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    ids = [model["vocab"].get("".join(p), -1) for p in pairs]
    if ids != sorted(ids) or any(x < 256 for x in ids) or model.get("ignore_merges"):
        return None
    back, special = _bytes_of(), {t["content"] for t in kind.get("added_tokens", ())}
    return {bytes(back[c] for c in t): i for t, i in model["vocab"].items() if t not in special}


class Encoder:
    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            ranks = _ranks(json.load(f))
        self.parts = ranks and tiktoken.Encoding("parts", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.array([*map(len, sorted(ranks, key=ranks.get))]) if ranks else None
        self.known: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers; null is empty."""
        return [self._text(t) if t else b"" for t in texts]

    def _text(self, text: str) -> bytes:
        if not self.parts:
            return self._whole(text)
        head, *rest = text.split(" ")
        known = self.known.__getitem__
        try:
            tail = b"".join(map(known, rest))
        except KeyError:
            if not self._learn(rest):
                return self._whole(text)
            tail = b"".join(map(known, rest))
        if rest and (not head or head[-1].isspace()):
            return self._whole(text)
        return array("I", self.parts.encode_ordinary(head)).tobytes() + tail

    def _learn(self, rest: list[str]) -> bool:
        """Remembers the new ones of parts that followed a space; False if one has other white space around that space."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = [p for p in rest if p not in self.known]
        if any(not p or p[0].isspace() or p[-1].isspace() for p in new):
            return False
        new = list(dict.fromkeys(new))
        ids = np.array(self.parts.encode_ordinary(" " + " ".join(new)), "<u4")
        ends = np.cumsum([len(p.encode()) + 1 for p in new])
        cut = np.searchsorted(np.cumsum(self.lengths[ids]), ends) + 1
        data, at = ids.tobytes(), 0
        for p, x in zip(new, (cut * 4).tolist(), strict=True):
            self.known[p] = data[at:x]
            at = x
        return True


def encoder(path: str) -> Encoder:
    """The worker's own encoder for a vocabulary file."""
    if path not in _OPEN:
        _OPEN[path] = Encoder(path)
    return _OPEN[path]
