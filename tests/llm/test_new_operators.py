"""Filter audit, language model and alignment against brute force."""

import hashlib
import itertools
import math
import os
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kelpline.llm import alignment, context_tree, filter_audit, pii, queries

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0d]+")
DOCS = "doc_id long, lang string, text string, n_chars int, mask string"
LABELS = "doc_id long, quality int, toxic int"


def brute_audit(docs, labels):
    """Rows of the audit by trying every order on every document."""
    good = {k for k, q, _ in labels if q == 1 and k is not None}
    toxic = {k for k, _, t in labels if t == 1 and k is not None}
    fails = []
    for k, lang, text in docs:
        text = text or ""
        words = WORD.findall(text)
        bad = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": k is not None and any(j is not None and j < k and (other or "") == text for j, _, other in docs),
        }
        fails.append((lang or "", k, {f for f in bad if bad[f]}))
    out, shapley = {}, {}
    for part in {p for p, _, _ in fails}:
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [(k, bad) for p, k, bad in fails if p == part]
            every = list(left)
            for step, f in enumerate(order, 1):
                gone = [(k, bad) for k, bad in left if f in bad]
                left = [(k, bad) for k, bad in left if f not in bad]
                out[part, order, step] = [len(left), len(gone), sum(f in bad for _, bad in every) - len(gone), sum(bad == {f} for _, bad in every), sum(k in good for k, _ in gone), sum(k in toxic for k, _ in gone)]
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
    return {key: (*counts, shapley[key[0], key[1][key[2] - 1]]) for key, counts in out.items()}


def audited(rows):
    return {(r["part"], r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]) for r in rows}


def audit_rows():
    long = "word " * 3000
    own = [f"w{i}" for i in range(250)]
    return [
        (1, "en", long), (2, "en", long), (3, "de", long + "x"), (4, "de", long[:-1] + "x"), (5, None, None), (6, None, ""), (7, "", ""), (None, "en", long),
        (8, "en", " ".join(own)), (9, "en", " ".join(own)), (9, "en", " ".join(own)), (10, "fr", "A B C | D"), (10, "fr", "other"), (11, "fr", "é\U0001f600" * 40), (12, "fr", "é\U0001f600" * 40), (13, "fr", "a"),
    ]


def test_audit_of_awkward_rows_is_brute_force(spark):
    rows, labels = audit_rows(), [(1, 1, 0), (2, 0, 1), (2, 1, 1), (9, None, 1), (99, 1, 1), (None, 1, 1), (5, 1, None)]
    docs = spark.createDataFrame([(k, lang, text, 0, "own") for k, lang, text in rows], DOCS)
    got = filter_audit.audit(docs, spark.createDataFrame(labels, LABELS)).collect()
    assert audited(got) == brute_audit(rows, labels) and len(got) == 600 * 4


def test_audit_compares_texts_where_hashes_agree(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "blocks_of", lambda text: F.transform(F.filter(F.array(F.lit(0)), lambda _: F.length(text) > 0), lambda _: F.lit(7).cast("long")))
    rows = audit_rows()
    docs = spark.createDataFrame([(k, lang, text, 0, "own") for k, lang, text in rows], DOCS)
    assert audited(filter_audit.audit(docs, spark.createDataFrame([], LABELS)).collect()) == brute_audit(rows, [])


def test_audit_of_nothing_is_nothing(spark):
    assert filter_audit.audit(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).count() == 0


def test_blocks_cover_a_text(spark):
    text = "ab" * 20_000
    changed = [text[:i] + "X" + text[i + 1 :] for i in (0, 63, 64, 511, 512, 4095, 4096, 32767, 32768, 39_999)]
    found = spark.createDataFrame([(x,) for x in [text, *changed]], "text string").select(filter_audit.blocks_of(F.col("text")).alias("b")).collect()
    whole = found[0]["b"]
    assert len(whole) == 5 and all(sum(x != y for x, y in zip(whole, r["b"])) == 1 for r in found[1:])


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
def test_audit_query_agrees_with_sql(spark):
    duck = duckdb.connect()
    for name in ("documents", "labels"):
        duck.sql(f"CREATE VIEW {name} AS FROM read_parquet('{DATA}/{name}.parquet')")
    frame = queries.QUERIES["op13_filter_audit"](spark, DATA).toPandas()
    theirs = duck.sql(queries.ORACLES["op13_filter_audit"]).df()
    assert sorted(frame.columns) == sorted(theirs.columns) and list(frame.dtypes[sorted(frame.columns)].astype(str)).count("int64") == 7
    assert sorted(frame[sorted(frame.columns)].itertuples(index=False, name=None)) == sorted(theirs[sorted(theirs.columns)].itertuples(index=False, name=None))


def brute_tree(train, depth):
    """A function that gives the log10 probability of a text, from dicts of counts by context and leading bits."""
    counts, children = Counter(), {}

    def steps(text):
        data = b"\n" * depth + text
        for i in range(depth, len(data)):
            bits = [data[i] >> (7 - k) & 1 for k in range(8)]
            for k, bit in enumerate(bits):
                yield data[i - depth : i], tuple(bits[:k]), bit

    for text in train:
        for context, prefix, bit in steps(text):
            for d in range(depth + 1):
                own = context[depth - d :]
                counts[own, prefix, bit] += 1
                if d:
                    children.setdefault((own[1:], prefix), set()).add(own)
    kept = {}

    def kt(own, prefix):
        a, b = counts[own, prefix, 0], counts[own, prefix, 1]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def mixed(own, prefix):
        if (own, prefix) not in kept:
            if len(own) == depth:
                kept[own, prefix] = kt(own, prefix)
            else:
                kept[own, prefix] = np.logaddexp(kt(own, prefix), sum(mixed(c, prefix) for c in children.get((own, prefix), ()))) - math.log(2)
        return kept[own, prefix]

    def chance(context, prefix, bit):
        p = None
        for d in range(depth, -1, -1):
            own = context[depth - d :]
            n = counts[own, prefix, 0] + counts[own, prefix, 1]
            here = (counts[own, prefix, bit] + 0.5) / (n + 1)
            w = 1 if d == depth else math.exp(kt(own, prefix) - math.log(2) - mixed(own, prefix))
            p = here if p is None else w * here + (1 - w) * p
        return p

    return lambda text: sum(math.log10(chance(*s)) for s in steps(text))


def whole_tree(train, depth):
    """As ``brute_tree`` for all texts at once, by one pass over one table of strings without any dealing."""

    def score(texts):
        seen, n = np.unique(context_tree.strings_of(train, depth), return_counts=True)
        asked = [context_tree.strings_of([t], depth) for t in texts]
        every = np.unique(np.concatenate([seen, *asked]))
        counts = np.zeros(len(every))
        counts[np.searchsorted(every, seen)] = n
        each = np.log10(context_tree.mixed_levels(every, counts, None, depth, 0)[0]).sum(axis=0)
        return [each[np.searchsorted(every, a)].sum() for a in asked]

    return score


def brute_scores(docs, depth, whole=False):
    rows = [(k, re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().translate(context_tree.LOWER))) for k, t in docs]
    held = [k is not None and zlib.crc32(str(k).encode()) % 5 == 1 for k, _ in docs]
    trained = [w for (_, w), h in zip(rows, held) if not h]
    seen = Counter(w for words in trained for w in [*words, None])
    n, v = sum(seen.values()), len(seen)
    model = (whole_tree if whole else brute_tree)([b" ".join(w) + b"\n" for w in trained], depth)
    texts = [b" ".join(w) + b"\n" for _, w in rows]
    out = []
    for (k, words), h, score in zip(rows, held, model(texts) if whole else map(model, texts)):
        tokens = [*words, None]
        base = sum(math.log10((seen[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens)
        out.append((k, h, len(tokens), sum(seen[t] > 0 for t in tokens), n, base, score))
    return out


def near(got, want):
    assert len(got) == len(want)
    by = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[6], 6))
    for a, b in zip(sorted(map(tuple, got), key=by), sorted(want, key=by)):
        assert a[:5] == b[:5] and np.allclose(a[5:], b[5:], rtol=1e-9, atol=1e-9), (a, b)


TEXTS = [None, "", "  ", "The cat sat\non the mat", "the CAT sat on the mat", "Zwölf Äpfel \x1c und", "日本語 テキスト", "x" * 300, "the cat " * 40, "never seen words: qjxz"]


@pytest.mark.parametrize("depth, table, words", [(3, 1 << 20, 1 << 17), (4, 50, 3), (5, 0, 0)])
def test_scores_are_those_of_a_plain_tree(spark, depth, table, words):
    docs = [(i, TEXTS[i % len(TEXTS)]) for i in range(24)] + [(None, "the cat"), (3, "the cat"), (3, "the cat")]
    frame = spark.createDataFrame([(k, t, 1.0) for k, t in docs], "doc_id long, text string, score double")
    near(context_tree.scores(frame, depth=depth, table=table, words=words).collect(), brute_scores(docs, depth))


def test_scores_without_training_or_without_rows(spark):
    held = [k for k in range(100) if zlib.crc32(str(k).encode()) % 5 == 1][:3]
    docs = [(k, t) for k, t in zip(held, ("a b", None, "b"))]
    near(context_tree.scores(spark.createDataFrame(docs, "doc_id long, text string")).collect(), brute_scores(docs, 5))
    assert context_tree.scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
def test_score_query_is_the_whole_tree(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = [r for r in queries.QUERIES["op11_context_tree"](spark, DATA).collect()]
    near(got, brute_scores(docs, 5, whole=True))
    held = [r for r in got if r["held_out"]]
    n_bytes = sum(len(b" ".join(context_tree.words_in(t))) + 1 for k, t in docs if zlib.crc32(str(k).encode()) % 5 == 1)
    assert held and -sum(r["score"] for r in held) * math.log2(10) < 3.6 * n_bytes  # bits


def test_chances_of_a_string_add_up(spark):
    texts = [b"abracadabra\n", b"a\n", b"\n"] * 3
    keys = np.unique(context_tree.strings_of(texts, 3), return_counts=True)
    every = np.unique(np.concatenate([keys[0], (keys[0][5] >> 8 << 8) + np.arange(256)]))
    n = np.zeros(len(every))
    n[np.searchsorted(every, keys[0])] = keys[1]
    fixed, *_ = context_tree.mixed_levels(every, n, None, 3, 0)
    assert abs(fixed.prod(axis=0)[every >> 8 == keys[0][5] >> 8].sum() - 1) < 1e-12


def test_groups_are_whole():
    values = sorted([1] * 7 + [2] * 3 + [3] * 20 + [4])
    batches = [pa.RecordBatch.from_arrays([pa.array(values[i : i + 4])], ["v"]) for i in range(0, len(values), 4)]
    tables = [t.column("v").to_pylist() for t in context_tree.whole_groups(iter(batches), "v", 5)]
    assert sum(tables, []) == values and all(not set(a) & set(b) for a, b in itertools.combinations(tables, 2))


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    letters = alignment.byte_letters()
    spelled = {i: bytes(letters[c] for c in t) for t, i in a.get_vocab().items() if t != "<|endoftext|>"}
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    return a, spelled, b


def brute_alignment(texts, libraries):
    """Whole texts by the libraries; groups are cut at the byte offsets where both sides end."""
    a, spelled, b = libraries
    out, counts = [], Counter()
    for text in texts:
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        bytes_a = [spelled[i] for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("\u2581", " ").encode() for i in ids_b]
        if not text or not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            out.append((0, 0, "", []))
            continue
        ends_a, ends_b = np.cumsum(list(map(len, bytes_a))), np.cumsum(list(map(len, bytes_b)))
        at_a, at_b = {e: i for i, e in enumerate(ends_a)}, {e: j for j, e in enumerate(ends_b)}
        groups, links, i, j = [], [], 0, 0
        for end in sorted(at_a.keys() & at_b.keys()):
            groups.append(",".join(map(str, ids_a[i : at_a[end] + 1])) + "|" + ",".join(map(str, ids_b[j : at_b[end] + 1])))
            links.append((ids_a[at_a[end]], ids_b[at_b[end]]))
            i, j = at_a[end] + 1, at_b[end] + 1
        counts.update(links)
        out.append((len(ids_a), len(ids_b), ";".join(groups), links))
    top = {}
    for (_, y), n in counts.items():
        top[y] = max(top.get(y, 0), n)
    return [(n_a, n_b, g.count(";") + 1 if g else 0, len(links), sum(counts[p] == top[p[1]] for p in links), sum(counts[p] for p in links), g) for n_a, n_b, g, links in out]


AWKWARD = [
    None, "", " ", "  ", "\n", "\n\n", "a", " a", "a ", "a  b", "a\nb", "a \nb", "a\n b", "a\n\nb\n", "\u2581x", "a \u2581 b", "don't  they're 'll\n's", "x\ty\r\nz", "\u3000\u00a0a\u2003b", "<|endoftext|> </s> <unk> <0x41> <s>",
    "caf\u00e9 e\u0301 \ufb01 \u212b \U0001f600\U0001f1e6\u200d", "\u65e5\u672c\u8a9e\u30c6\u30ad\u30b9\u30c8", "\x00 \x1c\x1f\x85", "word " * 500, "0123456789" * 50, "antidisestablishmentarianism" * 20, "a" * 5000, "http://x.y/?q=1&r=%20#z",
]


@pytest.mark.parametrize("table", [0, 7, 1 << 17])
def test_alignment_of_awkward_texts_is_brute_force(spark, libraries, table):
    texts = [*AWKWARD, "word word", "word word"]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)] + [(None, "a b", 1, "x")], "doc_id long, text string, n_a int, groups string")
    got = alignment.linked(docs, queries.vocabulary("byte_bpe_50k.json"), queries.vocabulary("piece_bpe_32k.model"), table=table).collect()
    want = brute_alignment([*texts, "a b"], libraries)
    assert len(got) == len(want)
    found = {r["doc_id"]: (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups"]) for r in got}
    for i, w in zip([*range(len(texts)), None], want):
        assert found[i] == w, texts[i] if i is not None else None


def test_alignment_of_drawn_texts_is_brute_force(libraries):
    aligner = alignment.Aligner(alignment.Tokenizers(queries.vocabulary("byte_bpe_50k.json"), queries.vocabulary("piece_bpe_32k.model")), most=50)
    draw = np.random.default_rng(0)
    parts = [*" \n\t\r'.,!?<>\u2581\u00a0\u3000\x1c\x85\x00", " ", " ", "\n", "the", "The", "'s", "'ll", "123", "\u00e9", "\u0301", "\u65e5", "\U0001f600", "<0x0A>", "<|endoftext|>", "</s>", "ing"]
    texts = ["".join(draw.choice(parts, draw.integers(1, 14))) for _ in range(3000)]
    got = [row for i in range(0, len(texts), 100) for row in aligner.texts(texts[i : i + 100])]
    for text, (n_a, n_b, n_groups, groups, links), want in zip(texts, got, brute_alignment(texts, libraries)):
        assert (n_a, n_b, n_groups, len(links), groups) == (*want[:4], want[6]), repr(text)


def brute_components(a_sizes, b_sizes):
    """Groups by joining the sets of every two tokens that share a byte."""
    spans = [(side, i, sum(sizes[:i]), sum(sizes[: i + 1])) for side, sizes in enumerate((a_sizes, b_sizes)) for i in range(len(sizes))]
    sets = [{x} for x in spans]
    for x, y in itertools.combinations(spans, 2):
        if x[0] != y[0] and max(x[2], y[2]) < min(x[3], y[3]):
            one, other = (next(s for s in sets if z in s) for z in (x, y))
            if one is not other:
                sets = [s for s in sets if s is not one and s is not other] + [one | other]
    return sorted((sorted(i for side, i, *_ in s if side == 0), sorted(i for side, i, *_ in s if side == 1)) for s in sets)


def test_components_are_overlaps():
    draw = np.random.default_rng(1)
    for _ in range(200):
        n = int(draw.integers(0, 12))
        a, b = (np.diff([0, *sorted(set(draw.integers(1, n, draw.integers(0, n)).tolist()) if n > 1 else []), n] if n else [0]) for _ in range(2))
        ends_a, ends_b = alignment.groups_of(a, b)
        got = [(list(range(i, j)), list(range(k, m))) for i, j, k, m in zip([0, *ends_a], ends_a, [0, *ends_b], ends_b)]
        assert got == brute_components(a.tolist(), b.tolist())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
def test_alignment_query_is_brute_force(spark, libraries):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = {r["doc_id"]: (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) for r in queries.QUERIES["op12_alignment"](spark, DATA).collect()}
    for (k, _), w in zip(docs, brute_alignment([t for _, t in docs], libraries), strict=True):
        assert got[k] == (*w[:6], hashlib.sha256(w[6].encode()).hexdigest() if w[6] else "")


def test_alignment_of_nothing_is_nothing(spark):
    assert alignment.linked(spark.createDataFrame([], "doc_id long, text string"), queries.vocabulary("byte_bpe_50k.json"), queries.vocabulary("piece_bpe_32k.model")).count() == 0


def test_held_values_are_found():
    draw = np.random.default_rng(0)
    keys = np.unique(np.concatenate([draw.integers(0, 1 << 48, 5000), np.arange(300)]))
    held = context_tree.Held(keys[::2], keys[::2] * 0.5)
    at = held.find(keys)
    assert (held.values[at[::2]] == keys[::2] * 0.5).all() and (at[1::2] == -1).all()
    assert (context_tree.Held(keys[:0], keys[:0] * 1.0).find(keys) == -1).all()


def test_secret_stays_out_of_plans(spark):
    docs = spark.createDataFrame([(1, "Dr. Mary Smith wrote to a.b@c.de, and Smith left")], "doc_id long, text string")
    out = pii.replaced(docs, "hush-hush-4711")
    assert out.collect()[0]["text"] != "Dr. Mary Smith wrote to a.b@c.de, and Smith left"
    plans = spark.sparkContext._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("extended")
    secret = spark.createDataFrame(pa.table({"_key": ["hush-hush-4711"]}))
    for frame in (out, docs.crossJoin(F.broadcast(secret)).withColumn("x", F.sha2("_key", 256))):
        assert "hush" not in frame._jdf.queryExecution().explainString(plans)
    assert "LocalTableScan" in frame._jdf.queryExecution().executedPlan().toString()


def test_many_surnames_have_surrogates_of_their_own(spark):
    names = spark.range(100_000).select(F.lit("family").alias("kind"), F.concat(F.lit("q"), F.col("id").cast("string")).alias("entity"))
    made = pii.surrogates(names, "s")
    assert made.count() == 100_000 == made.select("made").distinct().count()
    spaces = [len(pii.SYLLABLES["latin"]) ** (4 + k) for k in range(pii.ROUNDS)]
    assert spaces[0] < 2_000_000 < spaces[1] and spaces[4] > 10**11
