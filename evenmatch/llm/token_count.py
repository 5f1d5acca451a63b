"""Token counts under a unigram vocabulary, without building the tokens.

The text (each space written as ``\\u2581``, one more in front) is cut before every run of that mark
that follows another character. No piece of the vocabulary reaches over such a place, so the best
segmentation of the text is that of its parts, and parts repeat: each distinct part is worked out
once per task, within a bounded cache.

Per part an Aho-Corasick automaton lists all vocabulary matches, and dynamic programming carries the
best score and the number of pieces to each position. Ties follow the tokenizer: among equal scores
the piece that starts first stays; a character that no one-character piece covers may also be read
as unknown, at a fixed penalty; neighbouring unknowns are one token, or their bytes if the
vocabulary has all bytes.

A null text counts zero tokens like an empty one.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, functions as F

MARK = "▁"
UNKNOWN_PENALTY = 10.0
CACHE = 1 << 18  # distinct parts held in a task
LONGEST = 64  # characters of parts that are held
_NONE = float("-inf")
_PART = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def pieces(path: str) -> tuple[list[tuple[str, float]], int]:
    """``(piece, score)`` of a vocabulary file and the place of the unknown piece."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())], model.unk_id()


class Counter:
    """Counts the tokens of texts under one vocabulary."""

    def __init__(self, vocabulary: list[tuple[str, float]], unknown: int):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for i, (piece, score) in enumerate(vocabulary):
            if piece and piece not in self.automaton:
                self.automaton.add_word(piece, (len(piece), score))
            if MARK in piece.lstrip(MARK):
                raise ValueError(f"piece {piece!r} reaches over a cut")
        self.automaton.make_automaton()
        self.bytes = all(f"<0x{b:02X}>" in self.automaton for b in range(256))
        self.unknown = min(score for _, score in vocabulary) - UNKNOWN_PENALTY
        self.cached = lru_cache(CACHE)(self.part)

    def part(self, text: str) -> int:
        """Tokens of one part."""
        size = len(text)
        best, count, lone = [0.0] * (size + 1), [0] * (size + 1), [False] * (size + 1)
        top, take, single, at = _NONE, 0, False, 0  # the best way to reach position at + 1 so far

        def close(to: int) -> None:
            """Settle the positions up to ``to``, each after all its matches."""
            nonlocal top, take, single, at
            while at < to:
                if not single and best[at] + self.unknown > top:
                    top, lone[at + 1] = best[at] + self.unknown, True
                    if self.bytes:
                        take = count[at] + len(text[at].encode("utf-8", "replace"))
                    else:
                        take = count[at] + (0 if lone[at] else 1)
                at += 1
                best[at], count[at] = top, take
                top, single = _NONE, False

        # matches with one end come longest first, that is by their start
        for last, (length, score) in self.automaton.iter(text):
            if at < last:
                close(last)
            start = last + 1 - length
            value = best[start] + score
            if value > top:
                top, take = value, count[start] + 1
            if length == 1:
                single = True
        close(size)
        return count[size]

    def text(self, text: str | None) -> int:
        """Tokens of a text."""
        if not text:
            return 0
        total = 0
        for part in _PART.findall(MARK + text.replace(" ", MARK)):
            total += self.cached(part) if len(part) <= LONGEST else self.part(part)
        return total


_COUNTERS: dict[str, Counter] = {}


def token_counts(docs: DataFrame, vocabulary: str, text_col: str = "text", ship: bool = True) -> DataFrame:
    """``docs`` plus ``n_tokens``; ``vocabulary`` is a path on the driver, sent to the executors."""
    context = docs.sparkSession.sparkContext
    if ship:
        context.addFile(vocabulary)
    name = vocabulary.rsplit("/", 1)[-1]

    def counts(series):
        if name not in _COUNTERS:
            _COUNTERS[name] = Counter(*pieces(SparkFiles.get(name) if ship else vocabulary))
        counter = _COUNTERS[name]
        for texts in series:
            yield pd.Series([counter.text(t) for t in texts], dtype="int64")

    from collections.abc import Iterator

    counts.__annotations__ = {"series": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.withColumn("n_tokens", F.pandas_udf(counts, "long")(F.col(text_col).cast("string")))
