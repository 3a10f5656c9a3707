"""Results of the text operators against brute force, libraries and round trips."""

import collections
import hashlib
import json
import random
import re
import types
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from kelpline.llm import blob_secrets, bpe, line_dedup, mixing, near_dup, neighbours, pii, quality, queries, token_counts, warc
from kelpline.llm.common import new_folder

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DATA = "/root/testdata/sf0.001"
LETTERS = "abcdet  \n\n\t\r.,!-=;{}()▁<>s/0123éèñß漢字😀　\xa0\x00ſ\x1c²"


def random_texts(n, seed=0, longest=60, letters=LETTERS):
    draw = random.Random(seed)
    return ["".join(draw.choice(letters) for _ in range(draw.randint(0, longest))) for _ in range(n)]


def frame(spark, texts, source=None):
    return spark.createDataFrame([(i, t, "en", source(i) if source else "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")


# 1


def test_surrogates_keep_type_layout_and_identity(spark):
    texts = ["Call +1 (743) 555-3824 or (743) 555-3824, mail Bob.92@Mail2.example.com or BOB.92@MAIL2.EXAMPLE.COM.", "ip 8.196.197.208. card 4111111111111111, 4111 1111 1111 1111", "Herr Karl Muster, Frau Muster, Mrs. Smith; DE89 3704 0044 0532 0130 00; 123-45-6789", "Господин Иван Петров", "nothing 12 here", "again 8.196.197.208"]
    out = {r["doc_id"]: r for r in pii.replaced(frame(spark, texts), "secret").collect()}
    shape = lambda t: re.sub("[0-9]", "0", re.sub("[^\\W\\d_]+", "a", t))
    one = [e["surrogate"] for e in out[0]["entities"]]
    assert one[0].endswith(one[1]) and one[2].upper() == one[3] and shape(one[0]) == "+0 (000) 000-0000"
    cards = [e["surrogate"] for e in out[1]["entities"] if e["kind"] == "card"]
    digits = [int(c) for c in cards[0]]
    assert cards[1].replace(" ", "") == cards[0] and sum(sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(reversed(digits))) % 10 == 0
    names = [e["surrogate"] for e in out[2]["entities"] if e["kind"] == "name"]
    assert names[0].split()[1] in pii.GIVEN["m", "latin"] and names[1].startswith("Frau ") and names[2].startswith("Mrs. ")
    iban = next(e["surrogate"] for e in out[2]["entities"] if e["kind"] == "iban").replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert out[3]["entities"][0]["surrogate"].split()[1] in pii.GIVEN["m", "cyrillic"]
    assert out[4]["text"] == texts[4] and out[5]["text"].endswith(out[1]["entities"][0]["surrogate"])
    for i, r in out.items():
        found = re.findall(pii.PATTERNS["email"] + "|" + pii.PATTERNS["ip"], texts[i])
        assert not any(x in r["text"] for x in found)


def test_name_parts_are_entities(spark):
    texts = ["Mr John Smith came. Mr Smith left; John Smith's hat, Smithson stays. Smith", "Mrs Anna Maria Schmidt, Frau Anna-Lena Meyer and Mr John O'Brien", "Mr Smith; John here has no title", "a@b.example.com only"]
    rows = {r["doc_id"]: r for r in pii.replaced(frame(spark, texts), "secret").collect()}
    out = {i: r["text"] for i, r in rows.items()}
    given, family = re.match(r"Mr (\S+) (\S+) came", out[0]).groups()
    assert out[0] == f"Mr {given} {family} came. Mr {family} left; {given} {family}'s hat, Smithson stays. {family}"
    assert out[2] == f"Mr {family}; John here has no title"
    assert not re.search("Anna|Maria|Schmidt|Lena|Meyer|John|Brien", out[1]) and f"Mr {given} " in out[1]
    assert [len(rows[i]["entities"]) for i in range(4)] == [2, 3, 1, 1]
    many = [f"Mr {chr(65 + i // 26)}{chr(97 + i % 26)}x Smith" for i in range(60)]
    assert len({r["text"] for r in pii.replaced(frame(spark, many), "secret").collect()}) == 60


def test_one_surname_for_one_person(spark):
    texts = ["Herr Karl Muster kam. Herr Muster ging.", "Mr. Smith met Mr. John Smith", "Mr Γιώργος Παππάς saw Κύριος Παππάς", "Mr Արամ Խաչատրյան", "none"]
    out = [r["text"] for r in pii.replaced(frame(spark, texts), "secret").orderBy("doc_id").collect()]
    given, one, two = re.fullmatch(r"Herr (\S+) (\S+) kam\. Herr (\S+) ging\.", out[0]).groups()
    assert one == two != "Muster" and given in pii.GIVEN["m", "latin"]
    one, given, two = re.fullmatch(r"Mr\. (\S+) met Mr\. (\S+) (\S+)", out[1]).groups()
    assert one == two != "Smith" and given in pii.GIVEN["m", "latin"]
    given, one, two = re.fullmatch(r"Mr (\S+) (\S+) saw Κύριος (\S+)", out[2]).groups()
    assert one == two != "Παππάς" and given in pii.GIVEN["m", "greek"] and re.fullmatch("[Ͱ-Ͽ]+", one)
    assert re.fullmatch("Mr [\u0530-\u058f]+ [\u0530-\u058f]+", out[3]) and out[3] != texts[3] and out[4] == "none"
    again = [r["text"] for r in pii.replaced(frame(spark, texts), "secret").orderBy("doc_id").collect()]
    other = [r["text"] for r in pii.replaced(frame(spark, texts), "other").orderBy("doc_id").collect()]
    assert again == out and other[0] != out[0]
    with pytest.raises(ValueError):
        pii.replaced(frame(spark, texts), "")


def test_a_surrogate_is_no_real_entity(spark):
    first = [("family", "muster")]
    make = lambda rows: {r["entity"]: r["made"] for r in pii.surrogates(spark.createDataFrame(rows, "kind string, entity string"), "k").collect()}
    drawn = make(first)["muster"]
    both = make([*first, ("family", drawn)])  # what would be drawn is somebody's name now
    assert both["muster"] not in (drawn, "muster") and both[drawn] not in (drawn, "muster", both["muster"])


def test_endless_hosts_are_read(spark):
    texts = ["x@" + "a." * 60_000 + "com y", "x@" + "a." * 100 + "com y", "q" * 70_000 + "@" + "b" * 70_000 + ".org", "1-" * 50_000, "10.0.0." * 20_000, "Mr " * 30_000]
    out = {r["doc_id"]: r["text"] for r in pii.replaced(frame(spark, texts), "secret").collect()}
    assert len(out) == len(texts) and out[0] == texts[0] and out[1] != texts[1] and out[3] == texts[3]  # no host has over 127 labels


def test_surrogates_of_many_entities_stay_distinct(spark):
    n = 3000
    entities = spark.range(n).select(F.lit("name").alias("kind"), F.concat(F.lit("m:x"), "id").alias("entity"))
    made = pii.surrogates(entities, "k")
    assert made.select("made").distinct().count() == n == made.select("entity").distinct().count()
    few = spark.range(200).select(F.lit("card").alias("kind"), F.lpad(F.col("id").cast("string"), 3, "0").alias("entity"))
    with pytest.raises(RuntimeError):
        pii.surrogates(few, "k")


# 2


def brute_components(texts, words, percent=80):
    sets = []
    for t in texts:
        w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in WORD.findall(t or "")]
        k = min(words, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    up = list(range(len(sets)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = top(i), top(j)
                up[max(x, y)] = min(x, y)
    return [(len(s), top(i)) for i, s in enumerate(sets)]


def family(draw, n, rate, length=120):
    """Copies of copies of a text, each with some words changed."""
    texts = [[f"w{draw.randint(0, 10**6)}" for _ in range(length)]]
    while len(texts) < n:
        texts.append([w if draw.random() > rate * draw.random() else f"v{draw.randint(0, 10**6)}" for w in draw.choice(texts[:8])])
    return [" ".join(t) for t in texts]


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates_are_exact(spark, words):
    draw = random.Random(words)
    texts = family(draw, 90, 0.25) + family(draw, 40, 0.1, 30) + ["", " ", "one", "One", "one two", "one two", "x y z x y z"] + [" ".join(f"u{draw.randint(0, 99)}" for _ in range(40)) for _ in range(30)]
    draw.shuffle(texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(frame(spark, texts).withColumn("doc_id", F.col("doc_id").cast("int" if words == 5 else "long")), near_dup.Likeness(words=words)).collect()}
    want = brute_components(texts, words)
    assert [got[i] for i in range(len(texts))] == want
    assert len({c for _, c in want}) < len(want) - 5


def test_a_common_passage_makes_no_pairs(spark):
    passage, like = " ".join(f"p{i}" for i in range(60)), near_dup.Likeness(words=2)
    made = {}
    for n in (400, 1600):
        texts = [passage + " " + " ".join(f"o{i}x{j}" for j in range(35)) for i in range(n)]
        bodies = near_dup.features(frame(spark, texts), like, "doc_id", whole=True)
        nodes = bodies.select(F.lit(0).cast("long").alias("main"), "key", F.col("key").alias("label"), F.lit(True).alias("apart"))
        made[n] = sum(r["count"] ** 2 for r in near_dup.prefix_groups(nodes, bodies, like).groupBy("grp").count().collect())
    assert made[400] < 80 and made[1600] < 320  # pairs that tiles would compare
    texts = texts[:300] + [texts[0] + " more"]
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(frame(spark, texts), like).collect()}
    assert got == {i: 0 if i == 300 else i for i in range(301)}


def test_pruning_bounds():
    least = near_dup.Likeness().least_matches()
    assert least == sorted(least) and least[-1] < 0.8 * 160


# 3


def brute_lines(texts, least=line_dedup.LEAST_WORDS):
    seen, out = set(), []
    for t in texts:
        lines = t.split("\n")
        full = [(i, x) for i, x in enumerate(lines) if WORD.search(x)]
        gone, fresh = set(), []
        for a in range(len(full)):
            words = 0
            for b in range(a, len(full)):
                words += len(WORD.findall(full[b][1]))
                run = tuple(x for _, x in full[a : b + 1])
                if run in seen:
                    if words >= least:
                        gone.update(i for i, _ in full[a : b + 1])
                else:
                    seen.add(run)
        out.append((len(gone), "\n".join(x for i, x in enumerate(lines) if i not in gone)))
    return out


def test_line_runs_are_exact(spark):
    draw = random.Random(4)
    kinds = ["a b c", "d e f g", "h " * 9, "i j", "k " * 25, "", "  ", "l", "m n o p q", "r " * 12]
    texts = ["\n".join(draw.choice(kinds) + (str(draw.randint(0, 30)) if draw.random() < 0.2 else "") for _ in range(draw.randint(1, 14))) for _ in range(200)]
    got = {r["doc_id"]: (r["n_removed"], r["text"]) for r in line_dedup.without_repeats(frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_lines(texts)


# 4


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    w = {s: weights[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    left, open_, out = share * sum(sizes.values()), set(sizes), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > most * sizes[s]}
        if not over:
            out |= {s: level * w[s] for s in open_}
            break
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def test_mix_comes_near_its_targets(spark):
    draw = random.Random(7)
    name = lambda i: [None, "b", "a", "é", "Z"][0 if i % 2 else i % 5]
    texts = ["w " * draw.randint(0, 400) for _ in range(1500)]
    docs = frame(spark, texts, name)
    rows = mixing.plan(docs).collect()
    assert rows and sorted(map(tuple, rows), key=repr) == sorted(map(tuple, mixing.plan(docs.repartition(7)).collect()), key=repr)
    sizes, taken = collections.Counter(), collections.Counter()
    for r in rows:
        assert r["size"] == len(WORD.findall(texts[r["doc_id"]])) and 0 <= r["taken"] <= 2 * r["size"]
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
    want = brute_targets(sizes)
    for r in rows:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
    for s in sizes:
        assert taken[s] == pytest.approx(want[s], rel=0.01)
    mixed = mixing.mix(docs).select(F.size(F.filter(F.split("text", " "), lambda w: w != "")).alias("n"), "source").groupBy("source").agg(F.sum("n").alias("n")).collect()
    assert {r["source"]: r["n"] for r in mixed} == dict(taken)


def test_apportionment_is_sainte_lague(spark):
    draw = random.Random(3)
    groups = {g: [draw.choice([0, 1, 5, 50, 1000]) * draw.random() for _ in range(draw.randint(1, 12))] for g in range(30)}
    rows = [(g, i, w, 40) for g, ws in groups.items() for i, w in enumerate(ws)]
    df = spark.createDataFrame(rows, "g int, i int, w double, seats int")
    got = {(r["g"], r["i"]): r["quota"] for r in mixing.apportion(df, ["g"], ["i"], "w", F.col("seats"), F.lit(10**6)).collect()}
    for g, ws in groups.items():
        have = [0] * len(ws)
        for _ in range(40 if sum(ws) else 0):
            have[max(range(len(ws)), key=lambda i: (ws[i] / (2 * have[i] + 1), -i))] += 1
        assert [got[g, i] for i in range(len(ws))] == have


def brute_seats(weights, caps, seats):
    have = [0] * len(weights)
    for _ in range(seats):
        open_ = [i for i, w in enumerate(weights) if w > 0 and have[i] < caps[i]]
        if not open_:
            break
        have[max(open_, key=lambda i: (weights[i] / (2 * have[i] + 1), -i))] += 1
    return have


def test_caps_lose_no_seats(spark):
    draw = random.Random(4)
    groups = {0: ([10.0, 1.0], [2, 100], 11), 1: ([1.0], [3], 50), 2: ([0.0, 2.0], [5, 5], 4)}
    for g in range(3, 40):
        n = draw.randint(1, 12)
        groups[g] = ([draw.choice([0, 1, 5, 50]) * (1 + draw.random()) for _ in range(n)], [draw.choice([0, 1, 3, 30, 1000]) for _ in range(n)], draw.choice([0, 1, 7, 40, 200]))
    rows = [(g, i, w, c, n) for g, (ws, caps, n) in groups.items() for i, (w, c) in enumerate(zip(ws, caps))]
    df = spark.createDataFrame(rows, "g int, i int, w double, c long, seats int")
    got = {(r["g"], r["i"]): r["quota"] for r in mixing.apportion(df, ["g"], ["i"], "w", F.col("seats"), F.col("c")).collect()}
    for g, (ws, caps, n) in groups.items():
        assert [got[g, i] for i in range(len(ws))] == brute_seats(ws, caps, n), g
    for g in (0, 5, 6, 7):
        ws, caps, n = groups[g]
        all_ = {r["i"]: r["quota"] for r in mixing.apportion_all(df.filter(f"g = {g}"), [F.col("i").asc()], "w", n, F.col("c")).collect()}
        assert [all_[i] for i in range(len(ws))] == brute_seats(ws, caps, n), g


def test_small_sources_come_to_their_targets(spark):
    texts = ["w " * n for n in (6, 9, 12, 400)]
    rows = {r["source"]: r for r in mixing.plan(frame(spark, texts, lambda i: "abcd"[i])).collect()}
    assert [rows[s]["target"] for s in "abc"] == [12, 18, 24]
    assert all(abs(r["taken"] - r["target"]) <= 1 for r in rows.values())


def test_rows_without_key_are_spread_over_shards(spark):
    docs = spark.range(0, 3000, 1, 4).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a").alias("source"), F.concat(F.lit("w "), "id").alias("text"))
    assert mixing.plan(docs).agg(F.max("at")).first()[0] < 2 * 1000


# 5


def some_records(n):
    bodies = [f"<p>{i}</p>WARC/1.1\r\n".encode() * (i + 1) for i in range(n)]
    return bodies, [warc.record(i, f"http://x/{i}", b, hashlib.sha256(b).hexdigest(), None, "2024-01-01T00:00:00Z") for i, b in enumerate(bodies)]


def test_pages_come_back_from_archives(spark):
    same = "<html>" + "x" * 200
    pages = [(0, "u", "short"), (1, "u", "short"), (5, "u", same), (3, "u\r\nv", same), (4, None, same), (6, "u", None), (7, "u", "é" * 100)]
    folder = new_folder(spark, "warc")
    warc.write_archives(warc.plan_records(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)), folder)
    got = {int(re.search("[0-9]+", r["record_id"])[0]): r for r in warc.read_archives(spark, folder).collect()}
    for page, _, html in pages:
        body, r = (html or "").encode(), got[page]
        assert r["payload_bytes"] == len(body) and r["payload_digest"] == hashlib.sha256(body).hexdigest() and r["reason"] is None
        assert r["record_type"] == ("revisit" if page in (4, 5) else "response")
        assert r["refers_to"] == ("<urn:record:3>" if page in (4, 5) else None)
        assert r["payload"] is None if page in (4, 5) else bytes(r["payload"]) == body


def test_archives_are_bounded_in_bytes(spark):
    draw = random.Random(8)
    pages = {i: draw.randbytes(draw.choice([10, 300, 900, 9000])).hex() for i in range(200)}
    folder = new_folder(spark, "warc")
    rows = spark.createDataFrame(list(pages.items()), "page_id long, html string").withColumn("url", F.lit("u")).coalesce(1)
    warc.write_archives(warc.plan_records(rows), folder, chunk_bytes=3000, most_chunks=2)
    sizes = [r["length"] for r in spark.read.format("binaryFile").load(folder).select("length").collect()]
    longest = max(len(warc.member(warc.record(i, "u", p.encode(), hashlib.sha256(p.encode()).hexdigest(), None, "2024-01-01T00:00:00Z"))) for i, p in pages.items())
    assert len(sizes) > 40 and max(sizes) <= 2 * (max(longest, 3000) + 1)
    got = {int(re.search("[0-9]+", r["record_id"])[0]): r for r in warc.read_archives(spark, folder).collect()}
    assert {i: bytes(r["payload"]).decode() for i, r in got.items()} == pages


@pytest.mark.parametrize("packed", [True, False])
def test_salvage_recovers_all_but_what_is_broken(packed):
    bodies, records = some_records(6)
    stored = [warc.member(r) for r in records] if packed else records
    draw = random.Random(1)
    for trial in range(60):
        parts, broken = list(stored), draw.randrange(6)
        cut = bytearray(parts[broken])
        how = trial % 4
        if how == 0:
            cut = cut[: draw.randrange(4, len(cut) - 4)]
        elif how == 1:
            cut[draw.randrange(len(cut) - 24, len(cut) - 5)] ^= 0xFF  # headers have no check
        elif how == 2:
            cut[0:3] = b"???"
        else:
            cut = bytes(cut) + b"garbage between"
        parts[broken] = bytes(cut)
        data = b"".join(parts)
        found = list(warc.salvage(data))
        kept = {f.headers["warc-record-id"]: f.block.partition(b"\r\n\r\n")[2] for f in found if f.headers}
        for i, body in enumerate(bodies):
            if i != broken or how == 3:
                assert kept[f"<urn:record:{i}>"] == body, (trial, how, i, broken)
        gaps = [(f.start, f.stop) for f in found if f.reason]
        assert gaps and all(a < b <= len(data) for a, b in gaps)
    assert not [f for f in warc.salvage(b"".join(stored)) if f.reason]
    assert not list(warc.salvage(b""))


def salvaged(data):
    found = list(warc.salvage(data))
    return [int(re.search("[0-9]+", f.headers["warc-record-id"])[0]) for f in found if f.headers], [f for f in found if f.reason]


def test_records_before_a_break_in_one_large_member_are_kept():
    draw = random.Random(3)
    bodies = [draw.randbytes(3000).hex().encode() for _ in range(40)]
    records = [warc.record(i, "u", b, hashlib.sha256(b).hexdigest(), None, "2024-01-01T00:00:00Z") for i, b in enumerate(bodies)]
    whole = warc.member(b"".join(records))
    kept, gaps = salvaged(whole[: len(whole) * 3 // 4])
    assert kept == list(range(len(kept))) and 28 <= len(kept) < 40 and len(gaps) == 1
    # The gap covers what was not recovered: about one record and a step of the decompressor.
    assert gaps[0].stop == len(whole) * 3 // 4 and gaps[0].stop - gaps[0].start < 6000 + 2 * warc.STEP
    wrong_sum = whole[:-8] + bytes(4) + whole[-4:]
    kept, gaps = salvaged(wrong_sum + warc.member(records[0]))
    assert kept == [*range(40), 0] and len(gaps) == 1
    undigested = b"".join(re.sub(rb"WARC-Block-Digest: [^\r]*\r\n", b"", r) for r in records)
    assert salvaged(warc.member(undigested)[:-8] + bytes(8))[0] == []
    kept, _ = salvaged(whole[: len(whole) // 2] + warc.member(records[7])[:-3])
    assert kept[-1] == 7 and len(kept) >= 19

    kept, _ = salvaged(whole[: len(whole) // 2] + records[30] + records[31])
    assert kept[-2:] == [30, 31]
    stored = warc.member(b"".join(records), 0)
    assert salvaged(stored[:-8] + bytes(8))[0] == list(range(40))


def test_plain_records_after_a_payload_with_a_member_are_kept():
    bodies = [warc.member(b"packed payload"), b"one", b"two"]
    records = [warc.record(i, "u", b, hashlib.sha256(b).hexdigest(), None, "2024-01-01T00:00:00Z") for i, b in enumerate(bodies)]
    assert salvaged(b"".join(records)) == ([0, 1, 2], [])
    kept, gaps = salvaged(b"XXXX" + records[0][4:] + records[1] + records[2])
    assert kept == [1, 2] and gaps
    assert salvaged(records[1] + warc.member(records[2]) + b"\0" + records[0]) == ([1, 2, 0], [])


def test_other_version_lines_count():
    head = "WARC-Type: resource{0}WARC-Record-ID: <urn:record:5>{0}Content-Length: 3{0}{0}abc{0}{0}"
    data = b"".join((f"WARC/{v}{e}" + head.format(e)).encode() for v in ("0.18", "1.0", "1.1") for e in ("\r\n", "\n"))
    assert salvaged(data) == ([5] * 6, [])


def test_members_stop_where_they_stop():
    sizes = (0, 1, 700, 16_384, 400_000)
    parts = [warc.member(random.Random(n).randbytes(n)) for n in sizes]
    data, at = b"".join(parts), 0
    for n, part in zip(sizes, parts):
        content, stop, why = warc.one_member(data, at)
        assert (len(content), stop, why) == (n, at + len(part), "")
        at = stop


def test_long_members_are_padded():
    data = warc.member(b"x" * (1 << 24))
    assert data[-1] != 0 and zlib.decompress(data, 31) == b"x" * (1 << 24)


# 6, 8


def test_token_counts_equal_the_library(spark):
    model = queries.vocabulary("piece_bpe_32k.model")
    texts = random_texts(3000, 1) + ["<s>x</s> <unk>", " ", "\n", "▁", "a" * 5000, " " * 300]
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    docs = frame(spark, texts)
    got = {r["doc_id"]: r["n"] for r in docs.withColumn("n", token_counts.counter(docs, model, table=50)).collect()}
    assert [got[i] for i in range(len(texts))] == [len(library.encode(t)) for t in texts]


def test_a_worker_keeps_the_lookup_of_its_broadcast():
    model = queries.vocabulary("piece_bpe_32k.model")
    one, other = (types.SimpleNamespace(value=(model, {" a": n})) for n in (5, 7))
    assert token_counts._lookup(one) is token_counts._lookup(one)
    assert [token_counts._lookup(x).count("a") for x in (one, other, one)] == [5, 7, 5]


def test_encoding_equals_the_library(spark):
    source = queries.vocabulary("byte_bpe_50k.json")
    texts = random_texts(3000, 2) + random_texts(500, 3, 80, "ab") + random_texts(500, 4, 80, "ther in") + ["<|endoftext|>", "x <|endoftext|> y<|endoftext|>", "-" * 500, "a" * 3000, " " * 300, "it's 'tis we'll"]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r["doc_id"]: r for r in bpe.decode(bpe.encode(frame(spark, texts), source), source).collect()}
    at_once = {r["doc_id"]: r for r in bpe.round_trip(frame(spark, texts), source).collect()}
    for i, t in enumerate(texts):
        want = library.encode(t, add_special_tokens=False).ids
        assert got[i]["ids"] == at_once[i]["ids"] == want
        assert got[i]["decoded"] == at_once[i]["decoded"] == library.decode(want, skip_special_tokens=False)


def test_automaton_of_a_small_vocabulary():
    letters = {v: k for k, v in bpe.byte_letters().items()}
    draw = random.Random(5)
    vocab = {letters[b]: b for b in range(256)}
    merges, words = [], ["a", "b", "c"]
    for k in range(40):
        u, v = draw.choice(words), draw.choice(words)
        if u + v not in vocab:
            vocab[u + v] = 256 + len(merges)
            merges.append([u, v])
            words.append(u + v)
    spec = {"model": {"type": "BPE", "vocab": vocab, "merges": merges}, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}}
    automaton, back = bpe.Automaton(json.dumps(spec)), {i: t for t, i in vocab.items()}
    for word in random_texts(3000, 6, 25, "abc"):
        parts = list(word)
        for u, v in merges:  # by definition: each merge in turn, from the left
            i = 0
            while i + 1 < len(parts):
                if parts[i] == u and parts[i + 1] == v:
                    parts[i : i + 2] = [u + v]
                i += 1
        assert [back[i] for i in automaton.encode_word(word.encode())] == parts


# 7


def brute_counts(t):
    w, lines, dup, spans = WORD.findall(t), set(), 0, collections.defaultdict(list)
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    for i in range(len(w) - 7):
        spans[tuple(w[i : i + 8])].append(i)
    covered = {j for at in spans.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


def test_quality_counts_and_outliers(spark):
    draw = random.Random(9)
    clean = [" ".join("".join(draw.choice("etaoinshr") for _ in range(draw.randint(2, 9))) for _ in range(draw.randint(30, 200))) for _ in range(300)]
    junk = [" ".join(w + "***" for w in t.split()) for t in clean[:12]]
    texts = clean + junk + ["a b c d e f g h " * 9, "x\nx\n \n\nx y", "", "é漢 😀 " * 30, "a b c d e f g h\n" * 2 + clean[0]] + random_texts(300, 8, 300)
    got = {r["doc_id"]: r for r in quality.judge(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_counts(t)
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
    assert all(got[i]["kept"] for i in range(len(clean)))
    assert not any(got[i]["kept"] for i in range(len(clean), len(clean) + len(junk)))



def test_junk_with_few_symbols_is_rejected(spark):
    draw = random.Random(11)
    clean = [" ".join("".join(draw.choice("etaoinshr") for _ in range(draw.randint(2, 9))) for _ in range(draw.randint(30, 200))) for _ in range(300)]
    one = [clean[0] + " %", clean[1] + " $"]
    junk = []
    for i, t in enumerate(clean[:24]):
        words = t.split()
        n = sum(map(len, words))
        for _ in range(round(n * (0.05 + 0.07 * i / 23) / (0.95 - 0.07 * i / 23)) + 1):
            at = draw.randrange(len(words))
            words[at] += draw.choice("#*$%&|<>")
        junk.append(" ".join(words))
    got = {r["doc_id"]: r["kept"] for r in quality.judge(frame(spark, clean + one + junk)).collect()}
    assert all(got[i] for i in range(302))
    assert not any(got[i] for i in range(302, 302 + len(junk)))


# 9


def test_neighbours_are_exact(spark):
    draw = np.random.default_rng(2)
    vectors = draw.normal(size=(900, 16)).astype("f4") * draw.choice([0.01, 1, 30], size=(900, 1)).astype("f4")
    vectors[100:160] = vectors[7]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for r in neighbours.nearest(df, df.filter("vec_id % 100 = 0"), 10).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    wide = vectors.astype("f8")
    for q in range(0, 900, 100):
        far = np.sqrt(((wide - wide[q]) ** 2).sum(axis=1))
        want = sorted((d, i) for i, d in enumerate(far) if i != q)[:10]
        assert [v for v, _ in got[q]] == [i for _, i in want]
        assert [s for _, s in got[q]] == pytest.approx([d for d, _ in want], abs=1e-12)


# 10

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute_spans(t):
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return sorted(found)


def test_secrets_and_the_ledger(spark):
    draw = random.Random(11)
    bits = ["password", "TOKEN", "Secret ", "api_key", "apikey", "ſecret", '"', "'", " ", ":", "=", "abc", "AKIA", "ABCDEFGH12345678", "deadbeef" * 3, "0123456789", "é", "😀", "\n", "eyJhbGciOi.eyJzdWIiOi.abcdefghij", "-----BEGIN RSA PRIVATE KEY-----"]
    texts = ["".join(draw.choice(bits) for _ in range(draw.randint(0, 14))) for _ in range(800)]
    texts += texts[:50]
    docs, ledger = frame(spark, texts), new_folder(spark, "ledger")
    base = ("assign", "access", "hex")
    got = {r["doc_id"]: r for r in blob_secrets.scan(docs.filter("doc_id < 500"), ledger).collect()}
    assert len(got) == 500
    before = blob_secrets.read_ledger(spark, ledger).count()
    got = {r["doc_id"]: r for r in blob_secrets.scan(docs, ledger).collect()}
    for i, t in enumerate(texts):
        assert [tuple(s) for s in got[i]["spans"] if s["kind"] in base] == brute_spans(t)
    seen = blob_secrets.read_ledger(spark, ledger)
    assert seen.count() == len(set(texts)) == seen.select("blob").distinct().count() > before
    blob_secrets.scan(docs, ledger).count()
    assert blob_secrets.read_ledger(spark, ledger).count() == len(set(texts))
    newer = (*blob_secrets.RULES[:-1], blob_secrets.Rule("hosted", "gh[pousr]_[A-Za-z0-9]{36,}"))
    blob_secrets.scan(docs, ledger, newer).count()
    assert blob_secrets.read_ledger(spark, ledger).filter(f"array_contains(versions, '{newer[-1].version}')").count() == len(set(texts))


@pytest.mark.parametrize("few", [0, 100])
def test_a_scan_reads_the_shelves_of_its_blobs_only(spark, monkeypatch, few):
    monkeypatch.setattr(blob_secrets, "FEW_BLOBS", few)
    ledger, texts = new_folder(spark, "ledger"), [f"password = hunter{i}" for i in range(300)]
    blob_secrets.scan(frame(spark, texts), ledger).count()
    shelf = hashlib.sha256(b"password = newcomer").digest()[0]
    files = [f for f in Path(ledger).glob("shelf=*/*.parquet") if f.parent.name != f"shelf={shelf}"]
    assert len(files) > 100
    for f in files:
        f.write_bytes(b"not Parquet")
    got = blob_secrets.scan(frame(spark, ["password = newcomer"] * 2), ledger).collect()
    assert [[s["kind"] for s in r["spans"]] for r in got] == [["assign"]] * 2


# pipeline


def test_pipeline_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    stage = dict(corpus_pipeline.STAGES)
    left = {r["doc_id"]: r["text"] for r in stage["quality_rules"](spark, docs, DATA).collect()}
    for i, t in texts.items():
        n, _, _, _, rep = brute_counts(t)
        assert i not in left or not (n < 20 or 100 * rep > 30 * n)
    lines = {r["doc_id"]: r for r in stage["line_dedup"](spark, docs, DATA).collect()}
    order = sorted(texts)
    want = brute_lines([texts[i] for i in order])
    assert {i: r["text"] for i, r in lines.items()} == {i: t for i, (n, t) in zip(order, want) if not n or WORD.search(t)}
    assert all(r["n_chars"] == len(r["text"]) for r in lines.values())
    near = {r["doc_id"] for r in stage["near_dedup"](spark, docs, DATA).collect()}
    assert near == {order[i] for i, (_, c) in enumerate(brute_components([texts[i] for i in order], 5)) if c == i}
    judged = {r["doc_id"] for r in quality.judge(docs).collect() if r["kept"]}
    assert set(left) == judged
    out = corpus_pipeline.run(spark, DATA)
    assert out.count() > 0 and out.filter("NOT round_trip").count() == 0


def test_stages_judge_rows_not_ids(spark):
    draw = random.Random(8)
    prose = lambda n: " ".join("".join(draw.choice("abcdefghij") for _ in range(draw.randint(3, 8))) for _ in range(n))
    good, copy, other, last = prose(100), prose(90), prose(80), prose(70)
    rows = [(1, good), (1, "two words"), (None, "too short"), (None, other), (2, copy), (3, copy + " more"), (3, last), (None, copy), (5, "x"), (5, "x")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    stage = dict(corpus_pipeline.STAGES)
    texts = lambda name: sorted(((r["doc_id"], r["text"]) for r in stage[name](spark, docs, "unused").collect()), key=repr)
    long_ = [(i, t) for i, t in rows if len(t.split()) >= 20]
    assert texts("quality_rules") == sorted(long_, key=repr)
    assert texts("near_dedup") == sorted([(1, good), (1, "two words"), (None, "too short"), (None, other), (2, copy), (3, last), (5, "x")], key=repr)


def test_long_runs_of_short_lines(spark):
    draw = random.Random(11)
    run = [f"l{draw.randint(0, 9)}" for _ in range(90)]
    texts = ["\n".join(run), "\n".join(["a", *run[10:75], "b", *run[:19]]), "\n".join(run[30:] + run[:50]), "\n".join(["c"] * 70), "\n".join(["c"] * 45 + ["d"])]
    got = {r["doc_id"]: (r["n_removed"], r["text"]) for r in line_dedup.without_repeats(frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_lines(texts)
