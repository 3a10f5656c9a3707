"""BPE encoding and decoding with a tokenization automaton.

The merges of a byte-level BPE vocabulary are compiled into a deterministic automaton over tokens by
one merge gadget after another. At first there is one state with an arc for each byte. The gadget of
merge k, ``(u, v) -> uv``, sends all u-arcs to a copy of their target that has no v-arc, and adds a
uv-arc, to the old target of v, wherever a u-arc starts. The automaton then accepts exactly the
token sequences that the merges produce, so a word has one accepted path that spells it.

All arcs with one label keep one target, so a state is known by the label read last, and a copy
differs from its original by one missing arc. The gadgets are therefore kept in factored form: for
each label its missing arcs with the number of the gadget that took them, and for each merged token
its two halves. ``follows`` reads a transition from those tables and keeps it in a flat table.

Encoding walks these transitions. The automaton is deterministic over tokens, but a word is given in
bytes, so at a state several arc labels can fit what follows; long ones are tried first, and a
position from which the word can't be finished is given up for good. So it is a search over one
deterministic automaton that has one accepted path for each word; it is bounded by word length times
label length, and most words take no step back. Spelling out an automaton over bytes would need a
state for each pair of token and position in it. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers.pre_tokenizers import ByteLevel

from kelpline.llm.common import Recent

#: The characters that Unicode calls white space.
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def _class(first: str, like: str) -> str:
    """The code points whose category begins with ``first``, as ranges of a pattern.

    Unicode versions differ in what is assigned. Where two of them disagree, the library is asked
    whether it puts the code point into one piece with ``like``.
    """
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    newer = set(regex.findall(f"\\p{{{first}}}", every))
    older = {c for c in every if unicodedata.category(c)[0] == first}
    split = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    held = sorted(map(ord, newer & older | {c for c in newer ^ older if len(split(like + c)) == 1}))
    starts = [c for i, c in enumerate(held) if not i or held[i - 1] != c - 1]
    stops = [c for i, c in enumerate(held) if i + 1 == len(held) or held[i + 1] != c + 1]
    return "".join(f"\\U{lo:08x}-\\U{hi:08x}" for lo, hi in zip(starts, stops))


@functools.cache
def fine() -> str:
    """The published pre-split pattern of byte-level BPE, with the classes spelled out.

    It is made once, in the driver, and sent to the workers with the vocabulary.
    """
    letter, number = _class("L", "a"), _class("N", "1")
    return f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{WHITE}{letter}{number}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"


#: Cuts a text where the pattern above always cuts, at far less cost.
COARSE = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")
#: Pieces and words of more characters than this aren't kept in the caches.
CACHED_BYTES = 64
#: Ids whose labels are laid out at a time.
STRETCH = 1 << 18


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files: printable bytes are themselves."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Kept(dict):
    """Transitions that were read once, by ``before * 2**20 + after``; bounded."""

    def __init__(self, read, most: int) -> None:
        self.read, self.most = read, most

    def __missing__(self, key: int) -> bool:
        if len(self) >= self.most:
            self.clear()
        found = self[key] = self.read(key >> 20, key & 0xFFFFF)
        return found


class Automaton:
    """The compiled automaton of one vocabulary. ``source`` is the JSON of the tokenizer file.

    Only byte-level BPE without normalizer, prefix space and dropout is taken; others raise ValueError.
    """

    def __init__(self, source: bytes | str, kept: int = 200_000) -> None:
        spec = json.loads(source)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or spec.get("normalizer") or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError("only plain byte-level BPE vocabularies can be compiled")
        letters = byte_letters()
        added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        if any(x.get(k) for x in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that take in their neighbourhood aren't supported")
        spelled = {t: i for t, i in model["vocab"].items() if t not in added}
        self.ids = {bytes(letters[c] for c in t): i for t, i in spelled.items()}
        self.labels = {i: b for b, i in self.ids.items()} | {i: t.encode() for t, i in added.items()}
        self.added = added
        self.cut_added = re.compile("(" + "|".join(sorted(map(re.escape, added), key=len, reverse=True)) + ")") if added else None
        size = max(self.labels) + 1
        if size > 1 << 20:
            raise ValueError("the vocabulary is too large")
        self.left, self.right, self.born = [-1] * size, [-1] * size, [0] * size
        self.missing: dict[int, int] = {}
        for k, merge in enumerate(model["merges"], 1):
            u, v = merge.split(" ") if isinstance(merge, str) else merge
            a, b, ab = spelled[u], spelled[v], spelled[u + v]
            if (self.born[ab] or self.left[ab] >= 0) or not self._arc(a, b):
                continue  # no path has this pair any more
            self.left[ab], self.right[ab], self.born[ab] = a, b, k
            self.missing[a << 20 | b] = k
        self.follows = _Kept(self._arc, kept)
        self.reach: dict[bytes, int] = {}
        for b, i in self.ids.items():
            if len(b) == 1 or self.born[i]:
                self.reach[b[:4]] = max(self.reach.get(b[:4], 1), len(b))

    def _arc(self, before: int, after: int) -> bool:
        """Whether the state that ``before`` leads to has an arc labelled ``after``."""
        missing, left, right, born = self.missing, self.left, self.right, self.born
        until = 1 << 40
        while before >= 0:
            label, taken_by = after, 1 << 40
            while label >= 0:
                k = missing.get(before << 20 | label)
                if k is not None and k < until and k <= taken_by:
                    return False
                taken_by, label = born[label], left[label]
            until, before = born[before], right[before]
        return True

    def encode_word(self, word: bytes) -> list[int]:
        """The one accepted path that spells ``word``."""
        path: list[int] = []
        ends, at, n, before = [0], 0, len(word), -1
        ids, follows, reach, born = self.ids, self.follows, self.reach, self.born
        dead: set[int] = set()
        size = min(n, reach.get(word[:4], 3))
        while at < n:
            while size:
                label = ids.get(word[at : at + size])
                if label is not None and at + size not in dead and (size == 1 or born[label]) and (before < 0 or follows[before << 20 | label]):
                    break
                size -= 1
            if size:
                path.append(label)
                at += size
                ends.append(at)
                before = label
                size = min(n - at, reach.get(word[at : at + 4], 3))
            else:
                if not path:
                    raise ValueError("the vocabulary doesn't spell every byte")
                dead.add(at)
                path.pop()
                ends.pop()
                size, at = at - ends[-1] - 1, ends[-1]
                before = path[-1] if path else -1
        return path


class Encoder:
    """Ids of whole texts; pieces, and the words in them, that were met before come from bounded caches."""

    def __init__(self, automaton: Automaton, n_words: int = 150_000, n_pieces: int = 50_000, pattern: str | None = None) -> None:
        self.automaton = automaton
        split = re.compile(pattern or fine()).findall
        self.words = Recent(lambda w: np.array(automaton.encode_word(w.encode()), "<i4").tobytes(), n_words, CACHED_BYTES)
        self.pieces = Recent(lambda p: b"".join(map(self.words.__getitem__, split(p))), n_pieces, CACHED_BYTES)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian int32."""
        cut, known = self.automaton.cut_added, self.pieces.__getitem__
        if cut is None or not cut.search(text):
            return b"".join(map(known, COARSE.findall(text)))
        out, added = [], self.automaton.added
        for part in cut.split(text):
            if part in added:
                out.append(np.array([added[part]], "<i4").tobytes())
            else:
                out += map(known, COARSE.findall(part))
        return b"".join(out)


_LOADED: dict[int, Encoder] = {}


def _cache(source: bytes, pattern: str) -> Encoder:
    """The compiled automaton of a worker; it is made once for a worker and vocabulary."""
    key = hash(source)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Encoder(Automaton(source), pattern=pattern)
    return _LOADED[key]


def id_lists(encoder: Encoder, texts: pa.Array) -> pa.ListArray:
    found = [encoder.encode(x or "") for x in texts.to_pylist()]
    offsets = np.zeros(len(found) + 1, "<i4")
    np.cumsum([len(x) // 4 for x in found], out=offsets[1:])
    values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(found))])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def spelled(labels: "Labels", lists: pa.ListArray) -> pa.Array:
    """The text of each list; its bytes are laid out from the labels of STRETCH ids at a time."""
    ids = pa.compute.fill_null(lists.flatten(), -1).to_numpy()
    counts = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy()
    ids = np.where((ids >= 0) & (ids < labels.unknown), ids, labels.unknown)
    sizes = labels.sizes[ids]
    parts = []
    for lo in range(0, len(ids), STRETCH):
        size = sizes[lo : lo + STRETCH]
        shift = labels.starts[ids[lo : lo + STRETCH]] - (np.cumsum(size) - size)
        parts.append(labels.flat[np.repeat(shift, size) + np.arange(size.sum())])
    data = np.concatenate(parts) if parts else labels.flat[:0]
    ends = np.concatenate(([0], np.cumsum(sizes, dtype="i8")))[np.concatenate(([0], np.cumsum(counts)))]
    texts = pa.Array.from_buffers(pa.string(), len(lists), [None, pa.py_buffer(ends.astype("<i4")), pa.py_buffer(data)])
    try:
        texts.validate(full=True)
        return texts
    except pa.ArrowInvalid:  # not all of it is UTF-8
        return pa.array([data[lo:hi].tobytes().decode("utf-8", "replace") for lo, hi in zip(ends[:-1], ends[1:])], pa.string())


def with_columns(docs: DataFrame, held: str, made: dict[str, T.DataType], work) -> DataFrame:
    """``docs`` with the columns ``made``, which ``work`` makes from slices of the column ``held``; columns of these names are replaced."""
    taken = {name.lower() for name in made}
    rest = [f for f in docs.schema.fields if f.name.lower() not in taken]
    schema = T.StructType([*rest, *(T.StructField(name, kind, False) for name, kind in made.items())])
    keep = [f.name for f in rest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.get_field_index
            for lo, hi in slices(batch.column(place(held))):
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*(part.column(place(c)) for c in keep), *work(part.column(place(held)))], [*keep, *made])

    return docs.select(*(F.col(f"`{f}`") for f in dict.fromkeys([*keep, held]))).mapInArrow(run, schema)


IDS = T.ArrayType(T.IntegerType(), False)


def encode(docs: DataFrame, source: bytes, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with the column ``ids_col``: the token ids of the whole text, ``array<int>``.

    A null text is encoded as an empty one; an empty text has no ids. Rows keep their order and
    number, also repeated ones; a column that is already called ``ids_col`` is replaced. There is no
    shuffle: each task holds one Arrow batch and a bounded cache. ``source``, the vocabulary file
    (a few MB whatever the data), is broadcast.
    """
    held = docs.sparkSession.sparkContext.broadcast((source, fine()))
    return with_columns(docs, text_col, {ids_col: IDS}, lambda texts: [id_lists(_cache(*held.value), texts)])


def round_trip(docs: DataFrame, source: bytes, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """What ``decode`` makes of ``encode``, in one pass: a task keeps one worker with one vocabulary."""
    held = docs.sparkSession.sparkContext.broadcast((source, fine()))

    def both(texts: pa.Array) -> list[pa.Array]:
        ids = id_lists(_cache(*held.value), texts)
        return [ids, spelled(_labels(held.value[0]), ids)]

    return with_columns(docs, text_col, {ids_col: IDS, decoded_col: T.StringType()}, both)


def slices(column: pa.Array, most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Row ranges of a string or list column that hold about ``most`` bytes or a quarter as many elements, or one row."""
    is_list = pa.types.is_list(column.type)
    sizes = pa.compute.list_value_length(column) if is_list else pa.compute.binary_length(column)
    lengths = np.asarray([0 if x is None else x for x in sizes.to_pylist()], "i8") * (4 if is_list else 1)
    lo, held = 0, 0
    for i, n in enumerate(lengths):
        if held and held + n > most:
            yield lo, i
            lo, held = i, 0
        held += int(n)
    if lo < len(lengths):
        yield lo, len(lengths)


def decode(docs: DataFrame, source: bytes, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``docs`` with the column ``text_col``: the text that the ids of ``ids_col`` spell.

    Bytes that aren't UTF-8 become U+FFFD. A null list is decoded as an empty one and ids outside
    the vocabulary spell nothing. A column that is already called ``text_col`` is replaced.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(source)
    return with_columns(docs, ids_col, {text_col: T.StringType()}, lambda lists: [spelled(_labels(vocabulary.value), lists)])


_LABELS: dict[int, "Labels"] = {}


def _labels(source: bytes) -> "Labels":
    """The labels of a worker; they are read once for a worker and vocabulary."""
    key = hash(source)
    if key not in _LABELS:
        _LABELS.clear()
        _LABELS[key] = Labels(source)
    return _LABELS[key]


class Labels:
    """The bytes that each id spells, one after another; ``unknown`` stands for all other ids and spells nothing."""

    def __init__(self, source: bytes) -> None:
        spec, letters = json.loads(source), byte_letters()
        added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        found = {i: bytes(letters[c] for c in t) for t, i in spec["model"]["vocab"].items() if t not in added} | {i: t.encode() for t, i in added.items()}
        self.unknown = max(found) + 1
        each = [found.get(i, b"") for i in range(self.unknown + 1)]
        self.flat = np.frombuffer(b"".join(each), "u1")
        self.sizes = np.array([len(x) for x in each], "i4")
        self.starts = np.cumsum(self.sizes) - self.sizes
