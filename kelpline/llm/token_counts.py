"""Token counts of whole texts by a two-tier lookup of pre-token lengths, without a pre-token shuffle.

A text is cut where no token of the vocabulary can cross: before a run of spaces, and around
newlines. Its token count is then the sum of its pre-tokens' counts. First tier: a table of frequent
pre-tokens and their counts, broadcast to all tasks; its number of entries and the length of each
are bounded by parameters, so its size is too. Second tier: a bounded cache in each worker, filled
by encoding what the table misses. The table changes only the speed, never a count.

Frequent pre-tokens are found over all texts: each task keeps a Misra-Gries summary of fixed size,
and only the summaries, not the pre-tokens, are merged.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpline.llm.common import Recent

#: A pre-token, in a text with a space put before it.
PIECES = re.compile("[ ▁]*[^ ▁\n]+|[ ▁]+")
#: Longer pre-tokens are in neither tier; they are encoded each time.
LONGEST = 48


class Encoder:
    """Counts of single pre-tokens, from the library."""

    def __init__(self, model: bytes) -> None:
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        if any("\n" in p or "▁" in p.lstrip("▁") for p in pieces) or self.library.encode("a  b", out_type=str) != ["▁a", "▁", "▁b"]:
            raise ValueError("tokens of this vocabulary cross spaces or newlines")

    def count(self, piece: str) -> int:
        if piece[0] in " ▁":
            return len(self.library.encode(piece[1:])) if len(piece) > 1 else 1
        return len(self.library.encode("\n" + piece)) - 2  # after a newline no space is put before


class Lookup:
    """Both tiers: the table first, then a bounded cache of what it misses."""

    def __init__(self, first: dict[str, int], encoder: Encoder, most: int = 200_000) -> None:
        missed = Recent(encoder.count, most, LONGEST)
        self.tiers = _Table(first, missed)

    def count(self, text: str) -> int:
        return text.count("\n") + sum(map(self.tiers.__getitem__, PIECES.findall(" " + text))) if text else 0


class _Table(dict):
    """The first tier; what it lacks is asked of the second and not put into the first."""

    def __init__(self, first: dict[str, int], second: Recent) -> None:
        super().__init__(first)
        self.second = second

    def __missing__(self, piece: str) -> int:
        return self.second[piece]


def frequent_pieces(docs: DataFrame, text_col: str = "text", table: int = 16_384, summary: int = 4_096) -> dict[str, int]:
    """About the ``table`` most frequent pre-tokens of all texts, with lower bounds of their counts.

    Each task sends at most ``summary`` pre-tokens, and the driver gets at most ``table``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}

        def take_in(seen: Counter) -> dict[str, int]:
            for piece, n in held.items():
                seen[piece] += n
            ranked = seen.most_common(summary + 1)
            least = ranked[-1][1] if len(ranked) > summary else 0
            return {p: n - least for p, n in ranked if n > least}

        for batch in batches:
            seen, size = Counter(), 0
            for text in batch.column(0):
                if text := text.as_py():
                    seen.update(PIECES.findall(" " + text))
                    size += len(text)
                    if size > 2_000_000:
                        held, seen, size = take_in(seen), Counter(), 0
            held = take_in(seen)
        short = [(p, n) for p, n in held.items() if len(p) <= LONGEST]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in short], pa.string()), pa.array([n for _, n in short], pa.int64())], ["piece", "n"])

    summaries = docs.select(F.col(text_col)).mapInArrow(run, "piece string, n long")
    ranked = summaries.groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(table)
    return {r["piece"]: r["n"] for r in ranked.collect()}


def counter(docs: DataFrame, model: bytes, text_col: str = "text", table: int = 16_384) -> Column:
    """A long column expression for ``docs``: the tokens of the whole text.

    Null and empty texts have 0 tokens. No begin, end or other special token is counted; their
    strings inside a text are ordinary text, as the library has it by default. Texts of any length are
    read whole. Works row by row, so
    repeated rows, ties and other columns don't matter.
    """
    encoder = Encoder(model)
    first = {p: encoder.count(p) for p in frequent_pieces(docs, text_col, table)}
    held = docs.sparkSession.sparkContext.broadcast((model, first))

    @F.arrow_udf("long")
    def n_tokens(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lookup = _lookup(held)
        for text in texts:
            yield pa.array([lookup.count(x.as_py() or "") for x in text], pa.int64())

    return n_tokens(F.col(text_col))


_LOADED: list = []


def _lookup(held) -> Lookup:
    """The lookup of a worker, made once for a broadcast, whose value is kept beside it so that no other is taken for it."""
    if not _LOADED or _LOADED[0] is not held.value:
        _LOADED[:] = [held.value, Lookup(held.value[1], Encoder(held.value[0]))]
    return _LOADED[1]
