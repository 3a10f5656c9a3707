"""The registered queries of the text operators; each applies its operator to a whole table."""

from __future__ import annotations

import secrets
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpline.llm import alignment, blob_secrets, bpe, context_tree, filter_audit, line_dedup, mixing, near_dup, neighbours, pii, quality, token_counts, warc
from kelpline.llm.common import new_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> bytes:
    return Path(public_tokenizers.path(name)).read_bytes()


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document and the text they decode to, as counts and digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    source = vocabulary("byte_bpe_50k.json")
    both = bpe.round_trip(docs, source).drop("text")
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document as the piece vocabulary gives them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n_tokens = token_counts.counter(docs, vocabulary("piece_bpe_32k.model"))
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return docs.select("doc_id", n_bytes.alias("n_bytes"), n_tokens.alias("n_tokens")).withColumn("over_limit", F.col("n_tokens") > 4096)


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document, scanned once per blob into a ledger of this run."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = blob_secrets.scan(docs, new_folder(spark, "ledger"))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = tuple(r.kind for r in blob_secrets.BASE)
    return found.select(
        "doc_id",
        *map(count, base),
        F.sha2(blob_secrets.digest(F.col("spans"), base), 256).alias("base_sha256"),
        blob_secrets.digest(F.col("spans")).alias("spans"),
    )


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.plan(docs).select("doc_id", "size", "source_size", "target", "taken")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes every page as a WARC record and tells what reading the archives back gives."""
    folder = new_folder(spark, "warc")
    warc.write_archives(warc.plan_records(table(spark, sf_dir, "pages")), folder)
    found = warc.read_archives(spark, folder, with_payload=False).filter("reason IS NULL")
    return found.select(
        warc.key_of(F.col("record_id")).cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        warc.key_of(F.col("refers_to")).cast("long").alias("refers_to"),
    )


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rules and the verdict on every document."""
    return quality.judge(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest rows of every embedding whose id is divisible by 100."""
    rows = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(rows, rows.filter("vec_id % 100 = 0"), 10)


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near copies by 2-word shingles."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dup.near_duplicates(docs, near_dup.Likeness(words=2))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document, how many were later copies, and a digest of the text that stays."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    left = line_dedup.without_repeats(docs.withColumn("n_lines", F.size(F.split("text", "\n", -1)).cast("long")))
    text = F.coalesce("text", F.lit(""))
    return left.select("doc_id", "n_lines", "n_removed", F.length(text).cast("long").alias("n_chars_left"), F.sha2(text, 256).alias("text_sha256"))


def op1_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with surrogates for personal data, and how many of each kind.

    The secret is the session's spark.kelpline.secret; without one a run draws its own, and another
    run gives other surrogates.
    """
    secret = spark.conf.get("spark.kelpline.secret", None) or secrets.token_hex(32)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    count = lambda kind: F.size(F.filter("entities", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return pii.replaced(docs, secret).select("doc_id", "text", *map(count, pii.PATTERNS))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes, in every order, by language."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return filter_audit.audit(docs, table(spark, sf_dir, "labels"))


def op11_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document by word counts and by context-tree weighting, learnt from four fifths."""
    return context_tree.scores(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minimal groups of the two vocabularies' tokens in every document, and how usual its links are."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    digest = lambda groups: F.when(groups == "", "").otherwise(F.sha2(groups, 256))
    found = alignment.linked(docs, vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"), keep=digest)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("groups").alias("groups_sha256"))


QUERIES = {
    "op1_surrogates": op1_surrogates,
    "op3_line_dedup": op3_line_dedup,
    "op2_near_duplicates": op2_near_duplicates,
    "op9_neighbours": op9_neighbours,
    "op5_warc": op5_warc,
    "op7_quality": op7_quality,
    "op4_mixing": op4_mixing,
    "op6_token_counts": op6_token_counts,
    "op10_secrets": op10_secrets,
    "op8_bpe_round_trip": op8_bpe_round_trip,
    "op13_filter_audit": op13_filter_audit,
    "op11_context_tree": op11_context_tree,
    "op12_alignment": op12_alignment,
}

ORACLES: dict[str, str] = {
    "op9_neighbours": """
        WITH fine AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
                      WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
                        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                        AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        pairs AS (SELECT q.vec_id AS query_id, c.vec_id,
                         sqrt(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: (q.v[i] - c.v[i]) * (q.v[i] - c.v[i])))) AS score
                  FROM fine q JOIN fine c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS place FROM pairs)
        SELECT query_id, place::INTEGER AS rank, vec_id, score FROM ranked WHERE place <= 10""",
    "op13_filter_audit": """
        WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
        w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM d),
        m AS (SELECT doc_id, part, (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
                + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text))::INT
                + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(doc_id > first, false)::INT AS mask FROM w),
        l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY 1),
        c AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL),
        f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS b),
        o AS (SELECT p.x || q.x || r.x || s.x || t.x AS filter_order, unnest([1, 2, 3, 4, 5]) AS step, unnest([p.b, q.b, r.b, s.b, t.b]) AS own,
                unnest([0, p.b, p.b + q.b, p.b + q.b + r.b, p.b + q.b + r.b + s.b]) AS before
              FROM f p, f q, f r, f s, f t WHERE p.b | q.b | r.b | s.b | t.b = 31),
        a AS (SELECT part, filter_order, step, own, sum(n * (mask & (own | before) = 0)::INT) AS kept, sum(n * (mask & own <> 0 AND mask & before = 0)::INT) AS removed,
                sum(n * (mask & own <> 0 AND mask & before <> 0)::INT) AS redundant, sum(n * (mask = own)::INT) AS unique_fails,
                sum(good * (mask & own <> 0 AND mask & before = 0)::INT) AS good_lost, sum(toxic * (mask & own <> 0 AND mask & before = 0)::INT) AS toxic_lost
              FROM c, o GROUP BY ALL)
        SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
               good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM a""",
}
