"""Cross-tokenizer alignment of whole texts by connected components of overlapping tokens.

Two tokenizers cut the same bytes. Their tokens are the two sides of a graph with an edge wherever an
A and a B token share a byte; union-find over these edges gives its components, which are the minimal
groups: both sides end together at the end of a group and nowhere inside. The members of a component
are then expanded to links, the token pairs that end at one byte, and these are counted over the
corpus.

A text, with a space put before it, is cut before every run of spaces and newlines that follows another
character, unless that is white space too: no token of either side crosses such a place. Both sides
have a token end there, so no component crosses a cut, and the alignment of a text is that of its
pieces one after another. A worker keeps the alignments of pieces in a bounded cache; the pieces of a
batch of texts that it lacks are put one after another and aligned at once.

Pairs are counted with partial sums. Counts come back to documents from a broadcast table of the most
frequent pairs, bounded by a parameter, and for all other pairs by a shuffled join.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from tokenizers import Tokenizer

from kelpline.llm.bpe import WHITE, byte_letters
from kelpline.llm.common import arrow_rows, stage_table

#: Other white space, or what the piece vocabulary writes for a space, before a run of spaces and newlines; a text isn't cut there.
JOINED = re.compile(f"[{WHITE.replace(' ', '')}▁](?=[ \n])")
BLANK = frozenset(c for c in map(chr, range(0x3001)) if re.match(f"[{WHITE}▁]", c))
#: Longer pieces aren't kept in the cache.
LONGEST = 48
#: A pair is ``a * SIDE + b``; two counts are ``a * BOTH + b``.
SIDE, BOTH = 1 << 20, 1 << 40


class Tokenizers:
    """Ids of both sides and the bytes that each id spells. ``source`` is the tokenizer JSON of A, ``model`` the piece model of B."""

    def __init__(self, source: bytes, model: bytes) -> None:
        self.a = Tokenizer.from_str(source.decode())
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        letters, spec = byte_letters(), json.loads(source)
        added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.a_bytes = {i: bytes(letters[c] for c in t) for t, i in spec["model"]["vocab"].items() if t not in added}
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [(i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        self.b_bytes = {i: bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in pieces}
        self.newline = self.b.encode("\n")
        if any("\n" in p or "▁" in p.lstrip("▁") for _, p in pieces) or len(self.newline) != 2:
            raise ValueError("tokens of the piece vocabulary cross spaces or newlines")

        self.a_sizes, self.b_sizes = (np.array([len(held.get(i, b"")) for i in range(max(held) + 1)]) for held in (self.a_bytes, self.b_bytes))

    def ids(self, text: str) -> tuple[list[int], list[int]]:
        """Ids of a text that begins with the space put before it."""
        return self.a.encode(text, add_special_tokens=False).ids, self.b.encode(text[1:])


def components(a_sizes: np.ndarray, b_sizes: np.ndarray) -> np.ndarray:
    """The component of each token, A tokens first, by union-find over the edges between tokens that share a byte.

    Sizes are in bytes, at least one each, and both sides sum to the same. Each token is joined to the
    one of the other side that holds its first byte, if that begins before it or, for a B token, with
    it; all other overlaps follow from these edges. Roots are then found by halving all paths at once.
    A component is named by its first token, which is an A token.
    """
    n_a = len(a_sizes)
    starts_a, starts_b = np.cumsum(a_sizes) - a_sizes, np.cumsum(b_sizes) - b_sizes
    over_a = np.searchsorted(starts_b, starts_a, "right") - 1
    over_b = np.searchsorted(starts_a, starts_b, "right") - 1
    parent = np.concatenate([np.where(starts_b[over_a] < starts_a, n_a + over_a, np.arange(n_a)), over_b]) if n_a else np.zeros(0, "i8")
    while True:
        higher = parent[parent]
        if (higher == parent).all():
            return parent
        parent = higher


def groups_of(a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each component's A and B tokens end, in the order of the text."""
    names = components(a_sizes, b_sizes)
    n_a = len(a_sizes)
    place = np.cumsum(names[:n_a] == np.arange(n_a)) - 1  # of the components, by their first tokens
    of_a, of_b = place[names[:n_a]], place[names[n_a:]]
    return tuple(np.flatnonzero(np.append(x[1:] != x[:-1], True)) + 1 if len(x) else np.zeros(0, "i8") for x in (of_a, of_b))


def pieces_of(text: str) -> list[str]:
    """The pieces of a text without the space put before it. One that begins with neither space nor newline stands for itself after a space."""
    words = text.replace("\n", " \n").split(" ")
    blank = "  " in text or "\n\n" in text or " \n" in text or text[0] in " \n" or text[-1] in " \n"
    if not blank and not (JOINED.search(text) if not text.isascii() or any(c in text for c in "\t\r\x0b\x0c") else None):
        return words
    out, held = [], ""
    for word in words:
        held += word if word[:1] == "\n" else " " + word
        if word not in ("", "\n") and word[-1] not in BLANK:
            out.append(held)
            held = ""
    return [*out, held] if held else out


class Aligner:
    """Alignments of texts; those of short pieces are kept."""

    def __init__(self, tokenizers: Tokenizers, most: int = 150_000) -> None:
        self.tokenizers, self.most = tokenizers, most
        self.kept: dict[str, tuple | None] = {}
        self.older: dict[str, tuple | None] = {}

    def aligned(self, pieces: list[str]) -> list[tuple[int, str, bytes] | None]:
        """Of each piece: A tokens times BOTH and B tokens, the groups as text, and their linked pairs as little-endian int64; None if the bytes differ.

        The pieces are put one after another. If a piece's bytes differ from its tokens', halves are
        tried, and so on.
        """
        raw = [" a", *(p if p[0] in " \n" else " " + p for p in pieces)]
        # A piece that ends in white space can't have another after it.
        apart = {p for p, r in zip(pieces, raw[1:]) if r[-1] in BLANK} if len(pieces) > 1 else ()
        if apart:
            found = dict(zip(rest := [p for p in pieces if p not in apart], self.aligned(rest) if rest else []))
            return [self.aligned([p])[0] if p in apart else found[p] for p in pieces]
        text, t = "".join(raw), self.tokenizers
        a, b = t.ids(text)
        if not b"".join(map(t.a_bytes.__getitem__, a)) == b"".join(map(t.b_bytes.__getitem__, b)) == text.encode():
            if len(pieces) == 1:
                return [None]
            return self.aligned(pieces[: len(pieces) // 2]) + self.aligned(pieces[len(pieces) // 2 :])
        ids_a, ids_b = np.array(a), np.array(b)
        sizes_a = t.a_sizes[ids_a]
        ends_a, ends_b = groups_of(sizes_a, t.b_sizes[ids_b])
        # The tokens of a component that end together are the last of each side.
        pairs = (ids_a[ends_a - 1] * SIDE + ids_b[ends_b - 1]).astype("<i8").tobytes()
        group_bytes = np.cumsum(sizes_a)[ends_a - 1]
        at = (np.searchsorted(group_bytes, np.cumsum([len(r.encode()) for r in raw])) + 1).tolist()
        counts = np.diff((ends_a * BOTH + ends_b)[np.array(at) - 1]).tolist()
        ends_a, ends_b = ends_a.tolist(), ends_b.tolist()
        named_a, named_b, join = list(map(str, a)), list(map(str, b)), ",".join
        spelled = [f"{join(named_a[i:j])}|{join(named_b[k:m])}" for i, j, k, m in zip([0, *ends_a], ends_a, [0, *ends_b], ends_b)]
        return [(n, ";".join(spelled[lo:hi]), pairs[8 * lo : 8 * hi]) for n, lo, hi in zip(counts, at, at[1:])]

    def texts(self, texts: list[str | None]) -> list[tuple[int, int, int, str, np.ndarray]]:
        """A tokens, B tokens, groups, the groups as text and the linked pairs of whole texts; zeros and nothing for one without tokens."""
        cut = [pieces_of(t) if t else [] for t in texts]
        if len(self.kept) > self.most:
            self.older, self.kept = self.kept, {}
        kept, older = self.kept, self.older
        new = dict.fromkeys(p for p in set().union(*cut) if p not in kept)
        for p in [p for p in new if p in older]:
            kept[p] = older[p]
            del new[p]
        long, lacking, size = {}, [], 0
        for i, p in enumerate(new, 1):
            lacking.append(p)
            size += len(p)
            if size > 200_000 or i == len(new):
                for q, found in zip(lacking, self.aligned(lacking)):
                    (kept if len(q) <= LONGEST else long)[q] = found
                lacking, size = [], 0
        out = []
        for pieces in cut:
            found = list(map(kept.get, pieces)) if not long else [long[p] if p in long else kept[p] for p in pieces]
            if not found or None in found:
                out.append((0, 0, 0, "", np.zeros(0, "i8")))
                continue
            counts, spelled, pairs = zip(*found)
            links = np.frombuffer(b"".join(pairs), "<i8")
            out.append((*divmod(sum(counts), BOTH), len(links), ";".join(spelled), links))
        return out


_LOADED: list = []


def _aligner(held) -> Aligner:
    """The aligner of a worker, made once for a broadcast, whose value is kept beside it."""
    if not _LOADED or _LOADED[0] is not held.value:
        _LOADED[:] = [held.value, Aligner(Tokenizers(*held.value))]
    return _LOADED[1]


def align(docs: DataFrame, source: bytes, model: bytes, key: str = "doc_id") -> DataFrame:
    """Every text cut into minimal groups of A and B tokens.

    Columns: ``key``, n_a, n_b, n_groups, groups (``a1,a2|b1;a3|b2,b3``: ids in order) and pairs, an
    array of the distinct linked pairs (``a * SIDE + b``) with how often the text links each. A null or
    empty text, and one whose tokens on either side don't spell a space and the text, has no tokens.
    Rows keep their number, also repeated ones and those without key; texts of any length are read
    whole. Other columns are ignored.
    """
    held = docs.sparkSession.sparkContext.broadcast((source, model))
    kind = docs.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(held)
        for batch in batches:
            each, pairs, times = [], [], []
            for *found, linked in aligner.texts(batch.column(1).to_pylist()):
                each.append(found)
                pair, n = np.unique(linked, return_counts=True)
                pairs.append(pair)
                times.append(n)
            ends = pa.array(np.cumsum([0, *map(len, pairs)]).astype("i4"))
            links = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(np.concatenate(pairs)), pa.array(np.concatenate(times).astype("i4"))], ["pair", "n"]))
            counts = [pa.array([x[i] for x in each], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(to_arrow_type(kind)), *counts, pa.array([x[3] for x in each], pa.string()), links], [key, "n_a", "n_b", "n_groups", "groups", "pairs"])

    schema = f"`{key}` {kind.simpleString()}, n_a long, n_b long, n_groups long, groups string, pairs array<struct<pair: long, n: int>>"
    return docs.select(key, "text").mapInArrow(run, schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """Links of each pair over all rows of ``align``: pair, count, and best, whether no pair with this B id has more."""
    counts = aligned.select(F.explode("pairs").alias("p")).groupBy(F.col("p.pair").alias("pair")).agg(F.sum("p.n").alias("count"))
    counts = stage_table(counts, "pairs")
    b = F.pmod("pair", F.lit(SIDE))
    top = counts.groupBy(b.alias("_b")).agg(F.max("count").alias("_top"))  # a row for each id of B's vocabulary at most
    return stage_table(counts.join(F.broadcast(top), b == F.col("_b")).select("pair", "count", (F.col("count") == F.col("_top")).alias("best")), "counts")


def linked(docs: DataFrame, source: bytes, model: bytes, key: str = "doc_id", table: int = 1 << 17, keep: Callable[[Column], Column] = lambda groups: groups) -> DataFrame:
    """``align`` with what the corpus says of each text's links. ``keep`` says what of ``groups`` goes on, all or a digest.

    ``align``'s columns without pairs, and n_links, n_best (links whose pair has the highest count of
    its B id over the corpus, ties included) and count_sum (counts of the linked pairs over all links).
    Texts without tokens have 0 and an empty ``groups``. ``table`` bounds the broadcast of frequent
    pairs; no documents give no rows.
    """
    with arrow_rows(docs.sparkSession, 500):
        aligned = stage_table(align(docs, source, model, key).withColumn("groups", keep(F.col("groups"))).withColumn("_row", F.monotonically_increasing_id()), "aligned")
    counts = pair_counts(aligned)
    step = F.floor(F.log2("count") * 16)
    least, held = 1 << 30, 0
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):
        if held + r["n"] > table:
            break
        least, held = r["step"], held + r["n"]
    common, rare = F.broadcast(counts.filter(step >= least)), counts.filter(step < least)
    each = aligned.select("_row", F.explode("pairs").alias("p")).select("_row", "p.pair", "p.n")
    sums = [F.sum("n").alias("n_links"), F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum")]
    found = each.join(common, "pair").groupBy("_row").agg(*sums).unionByName(each.join(common, "pair", "left_anti").join(rare, "pair").groupBy("_row").agg(*sums))
    total = found.groupBy("_row").agg(*(F.sum(c).alias(c) for c in ("n_links", "n_best", "count_sum")))
    return aligned.join(total, "_row", "left").select(key, "n_a", "n_b", "n_groups", "groups", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_links", "n_best", "count_sum")))
