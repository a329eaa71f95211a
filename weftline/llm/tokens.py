"""Token ids of a public vocabulary, with a bounded cache of word pieces."""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np

#: A text in which a blank stands next to a blank, or at an end, isn't cut at its spaces.
ODD = re.compile(r" \s|\s |^\s|\s$").search
SPECIAL = "<|endoftext|>"


class Ids:
    """encode(texts): for each text the ids of byte_bpe_50k as little-endian 32-bit bytes, as tokenizers gives them without special tokens added.

    A single space between two other characters always begins a piece of its own, so texts are cut there and the ids of
    equal chunks are looked up; chunks that are new are encoded together, a token that begins with a space being a chunk's
    first. Texts of another form are encoded whole; texts that hold the special token's string go to tokenizers itself."""

    def __init__(self, most: int = 600_000) -> None:
        import public_tokenizers as P
        import tiktoken

        with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("byte_bpe_50k", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.begins = np.zeros(max(ranks.values()) + 1, bool)
        self.begins[[i for b, i in ranks.items() if b[:1] == b" "]] = True
        self.known: dict[str, bytes] = {}
        self.most, self.whole = most, None

    def _whole(self, text: str) -> bytes:
        if SPECIAL in text:
            if self.whole is None:
                import public_tokenizers as P
                from tokenizers import Tokenizer

                self.whole = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()

    def _learn(self, chunks: list[str]) -> None:
        if len(self.known) + len(chunks) > self.most:
            self.known.clear()
        ids = np.array(self.fast.encode_ordinary(" " + " ".join(chunks)), "<u4")
        at = np.append(np.flatnonzero(self.begins[ids]), len(ids))
        raw, cuts = ids.tobytes(), (4 * at).tolist()
        self.known.update(zip(chunks, [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], strict=True))

    def encode(self, texts: list[str | None], step: int = 400) -> list[bytes]:
        out: list[bytes] = []
        for k in range(0, len(texts), step):
            part = [t or "" for t in texts[k : k + step]]
            cut = [None if " " not in t or ODD(t) or SPECIAL in t else t.split(" ") for t in part]
            new = {w for c in cut if c for w in c[1:]} - self.known.keys()
            if len(new) > self.most // 2:  # one huge text: no gain
                out += [self._whole(t) for t in part]
                continue
            if new or len(self.known) > self.most:
                if len(self.known) + len(new) > self.most:
                    self.known.clear()
                    new = {w for c in cut if c for w in c[1:]}
                self._learn(list(new))
            get = self.known.__getitem__
            out += [self._whole(t) if c is None else self._whole(c[0]) + b"".join(map(get, c[1:])) for t, c in zip(part, cut, strict=True)]
        return out


@lru_cache(1)
def ids() -> Ids:
    """This worker's encoder."""
    return Ids()
