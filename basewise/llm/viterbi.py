"""Token counts under a unigram vocabulary, by a count-only Viterbi pass.

An Aho-Corasick automaton lists all vocabulary pieces that end at each character of a word; dynamic
programming keeps, per position, the best score, the piece count on that best path and whether it
ends in an unknown character. No path is stored. The rules are those of the tokenizers library's
Unigram model behind its Metaspace pre-tokenizer: a candidate replaces another only with a larger
score, longer pieces come first, a character without a piece of its own is unknown at the smallest
score less 10, and unknowns in a row count as one piece.

Words are counted once per worker and memoised: pieces never cross the space before a word.

Defined cases: null and empty texts have 0 pieces and score 0. Repeated rows are counted each.
Other columns of the input pass through ``count_tokens`` unless they are named n_pieces or score.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, kept, named
from .encoding import vocabulary_path

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Words that a worker remembers, and characters of the longest of them.
MEMO, LONGEST = 500_000, 64

def load_pieces(path: str) -> list[tuple[str, float]]:
    """(piece, score) of the ordinary pieces of a sentencepiece model file, in the order of their ids."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = (i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)))
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in ids]


class Counter(dict):
    """word -> complex(pieces, score), computed where missing."""

    def __init__(self, pieces: list[tuple[str, float]]) -> None:
        import ahocorasick

        super().__init__()
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        # the unknown entry itself has score 0
        self.unknown = min([0.0, *(s for _, s in pieces)]) - UNKNOWN_PENALTY

    def __missing__(self, word: str) -> complex:
        value = self.count(SPACE + word)
        if len(word) <= LONGEST:
            if len(self) >= MEMO:
                self.clear()
            self[word] = value
        return value

    def count(self, text: str) -> complex:
        n = len(text)
        ending: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, match in self.automaton.iter(text):
            ending[end].append(match)
        best, pieces, odd = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for end in range(1, n + 1):
            top, single = None, False
            for length, score in sorted(ending[end - 1], reverse=True):  # longest first: earliest start
                single |= length == 1
                value = best[end - length] + score
                if top is None or value > top:
                    top, best[end], pieces[end], odd[end] = value, value, pieces[end - length] + 1, False
            if not single:
                value = best[end - 1] + self.unknown
                if top is None or value > top:
                    best[end], pieces[end], odd[end] = value, pieces[end - 1] + (not odd[end - 1]), True
        return complex(pieces[n], best[n])

    def document(self, text: str | None) -> complex:
        """Pieces and score of a whole text."""
        if not text:
            return 0j
        parts = text.replace(SPACE, " ").split(" ")
        return sum(map(self.__getitem__, parts if parts[0] else parts[1:]), 0j)


def counter(path: str) -> Counter:
    return kept(f"counter {path}", lambda: Counter(load_pieces(path)))


def count_tokens(docs: DataFrame, path: str | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with n_pieces and score of each row's best segmentation."""
    path = path or vocabulary_path("piece_bpe_32k.model")
    others = [named(c) for c in docs.columns if c not in (text_col, "n_pieces", "score")]

    @F.pandas_udf("n_pieces long, score double")
    def count(texts: pd.Series) -> pd.DataFrame:
        of = counter(path).document
        found = [of(t) for t in texts]
        return pd.DataFrame({"n_pieces": [int(x.real) for x in found], "score": [x.imag for x in found]})

    counts = free("counts", docs)
    rows = docs.select(*others, count(F.coalesce(named(text_col).cast("string"), F.lit(""))).alias(counts))
    return rows.select(*others, named(counts)["n_pieces"].alias("n_pieces"), named(counts)["score"].alias("score"))
