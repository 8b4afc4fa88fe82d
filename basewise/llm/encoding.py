"""Exact byte-level BPE ids of whole texts, with a memo of pieces.

The tokenizer's own pre-tokenizer always cuts before a space that no other space touches, and before and
after a newline that no white space of any kind touches. So the ids of a text without two spaces in a row and without white
space beside a newline are the ids of its pieces, one after another. Each distinct piece is encoded by the tokenizers library once
per worker process, and texts are assembled from the memo, which is bounded in bytes. All other texts, and
texts with a string that the tokenizer holds for a token of its own, go to the library whole.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterable

import numpy as np

from .common import kept

#: Bytes that a worker's memo may hold, about; longer pieces than LONGEST are not kept at all.
MEMO_BYTES = 200_000_000
LONGEST = 64
#: What an entry takes besides its characters and ids.
ENTRY = 180
#: A newline with white space of any kind on either side.
BESIDE_NEWLINE = re.compile(r"\n(?:\s|(?<=\s\n))")
#: Marks that make a pre-token of their own behind letters.
MARKS = ".,;:!?%$#&*|()-"
#: How byte-level vocabularies spell the bytes that are no printable Latin-1 characters.
BYTES = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255))}
#: How so many ids become bytes.
PACKERS = [struct.Struct(f"<{n}I").pack for n in range(40)]
#: Appended to each document.
END_ID = 2


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: Strings that are ids of their own wherever they stand.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Pieces in use, and those of before: of two generations, the older goes when the younger is full.
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0
        self.tails: dict[str, bytes] = {}
        self.newline = struct.pack("<I", self.tokenizer.token_to_id("Ċ"))

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def tail(self, marks: str) -> bytes:
        if len(marks) > 8:  # marks in endless variety are not kept
            return self.whole([marks])[0]
        if marks not in self.tails:
            if len(self.tails) > 100_000:
                self.tails.clear()
            self.tails[marks] = self.whole([marks])[0]
        return self.tails[marks]

    def learn(self, pieces: set[str]) -> dict[str, bytes]:
        """The ids of " " + piece (of pieces that begin with a newline: their own ids), by piece; those of short pieces are kept."""
        if self.held > MEMO_BYTES // 2:
            self.older, self.memo, self.held = self.memo, {}, 0
        memo, older = self.memo, self.older
        fresh = pieces.difference(memo)
        tokenize, odd, found = self.tokenizer.model.tokenize, [], {}

        def letters(word: str, space: bool) -> bytes:
            spelt = word if word.isascii() else word.encode().decode("latin-1").translate(BYTES)
            own = [t.id for t in tokenize("Ġ" + spelt if space else spelt)]
            return PACKERS[len(own)](*own) if len(own) < len(PACKERS) else np.array(own, "<u4").tobytes()

        for p in fresh:
            if (ids := older.get(p)) is not None:
                found[p] = ids
                continue
            if p.isalpha():  # letters are one pre-token, with the space before them
                if p not in found:
                    found[p] = letters(p, True)
                continue
            head = p[:1] == "\n"
            core = p[1:] if head else p
            word = core.rstrip(MARKS)
            if not word.isalpha():
                odd.append(p)
                continue
            # the marks behind are another pre-token
            cut = len(core) - len(word)
            base = p[:-cut] if cut else p
            ids = memo.get(base) or found.get(base) or older.get(base)
            if ids is None:
                ids = found[base] = self.newline + letters(word, False) if head else letters(word, True)
            if cut:
                found[p] = ids + self.tail(core[-cut:])
        own = [p[1:] if p[:1] == "\n" else " " + p for p in odd]
        for p, ids in zip(odd, self.whole(own), strict=True):
            found[p] = self.newline + ids if p[:1] == "\n" else ids
        memo.update(found)
        self.held += sum(map(len, found)) + sum(map(len, found.values())) + ENTRY * len(found)
        for p in [p for p in found if len(p) > LONGEST]:
            del memo[p]
            self.held -= len(p) + len(found[p]) + ENTRY
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers, without an end id."""
        out: list[bytes] = [b""] * len(texts)
        split, odd = [], []
        for i, t in enumerate(texts):
            if "  " in t or BESIDE_NEWLINE.search(t) or any(a in t for a in self.added):
                odd.append(i)
            elif t:
                split.append((i, f"\n{t}".replace("\n", " \n").split(" ")))
        for i, ids in zip(odd, self.whole([texts[i] for i in odd]), strict=True):
            out[i] = ids
        pieces: set[str] = set()
        for _, p in split:
            del p[0]
            pieces.update(p)
        fresh, memo = self.learn(pieces), self.memo
        known = memo.__getitem__
        for i, p in split:
            try:
                ids = b"".join(map(known, p))
            except KeyError:  # a long piece, which the memo does not keep
                ids = b"".join([memo.get(x) or fresh[x] for x in p])
            out[i] = ids[4:]  # without the newline that was put in front
        return out


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    return kept(f"encoder {path}", lambda: Encoder(path))


def encoded(path: str, texts: Iterable[str | None], chars: int = 4_000_000) -> Iterable[bytes]:
    """Ids of each text (null: empty) with the end id, some million characters at a time."""
    end = np.array([END_ID], dtype="<u4").tobytes()
    enc, group, size = encoder(path), [], 0
    for t in texts:
        group.append(t or "")
        size += len(group[-1])
        if size >= chars or len(group) >= 1000:
            yield from (x + end for x in enc.encode(group))
            group, size = [], 0
    if group:
        yield from (x + end for x in enc.encode(group))
