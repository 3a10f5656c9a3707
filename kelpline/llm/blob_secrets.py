"""Secret scans with an incremental ledger of content-addressed blobs.

Every version of every path is addressed by the SHA-256 of its text. The ledger, a Parquet folder,
holds for each blob the rule versions that have scanned it and the spans they found. A run scans
only blobs with rule versions that the ledger lacks, once for each blob however many paths hold it,
appends what it found in one committed write, and joins the findings back to all paths.

The ledger is partitioned by the first byte of the address. A run reads the shelves that its blobs
lie on; few blobs are sent to the scan of the ledger, so of a large one only their rows are shuffled.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpline.llm.common import stage_table


@dataclass(frozen=True)
class Rule:
    """One kind of secret. Leftmost matches that don't overlap; ``least`` is asked of ``group`` afterwards.

    ``needs``: lower-case strings of which the lower-cased text must hold one, or else nothing matches.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    any_case: bool = False
    needs: tuple[str, ...] = ()
    compiled: re.Pattern = field(init=False, compare=False, repr=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "compiled", re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0)))

    @property
    def version(self) -> str:
        """Changes with whatever decides what the rule finds, so a changed rule scans every blob again."""
        content = repr((self.pattern, self.group, self.least, self.any_case, self.needs))
        return f"{self.kind}-{hashlib.sha256(content.encode()).hexdigest()[:16]}"

    def spans(self, text: str, low: str) -> Iterator[tuple[int, int]]:
        if not self.needs or any(x in low for x in self.needs):
            for m in self.compiled.finditer(text):
                if m.end(self.group) - m.start(self.group) >= self.least:
                    yield m.span()


BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True, ("password", "passwd", "secret", "token", "api")),
    Rule("access", "AKIA[A-Z0-9]+", 0, 20, False, ("akia",)),
    Rule("hex", "[0-9a-f]+", 0, 24),
)
RULES = (
    *BASE,
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", needs=("private key",)),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", needs=("eyj",)),
    Rule("hosted", r"gh[pousr]_[A-Za-z0-9]{36,}", needs=("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
)

FOUND = "array<struct<version string, start long, stop long>>"
SCANNED = f"blob binary, versions array<string>, found {FOUND}"
LEDGER = f"{SCANNED}, shelf int"
#: Up to so many addresses, of 32 bytes each, are broadcast to the scan of the ledger.
FEW_BLOBS = 100_000


def read_ledger(spark, path: str) -> DataFrame:
    """One row per blob and run: ``blob``, ``versions`` that scanned it, ``found`` spans, ``shelf``. Empty if there is none yet."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], LEDGER)


def shelf_of(blob: Column) -> Column:
    """The first byte of an address as a number."""
    return F.conv(F.hex(F.substring(blob, 1, 1)), 16, 10).cast("int")


def scan(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scan what is new in ``versions`` and return each of its rows' ``key`` with ``blob`` and ``spans``.

    ``versions``: one row for each path and historical version; other columns are ignored. ``spans``
    is an array of (start, rank, kind, stop) by start and then by the rules' order; positions are
    code points, ends exclusive. A null text is scanned as an empty one. Rows come back as often as
    they are given. ``ledger`` is a folder that all executors share; it is created or appended to.

    Texts move once, by their own hash, and only those that need a scan; each is scanned in the
    memory of one row. Of the ledger only the shelves asked for are read. Findings are joined back by blob as a plain join, which Spark splits where
    one blob has very many paths.
    """
    spark = versions.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    blob = F.unhex(F.sha2(text, 256))
    paths = stage_table(versions.select(F.col(key).alias("key"), blob.alias("blob")), "paths")
    wanted = {r.version: r for r in rules}
    blobs = paths.groupBy("blob").agg(F.min("key").alias("key"))
    few = paths.select("blob").distinct().limit(FEW_BLOBS + 1).count() <= FEW_BLOBS
    shelves = [r[0] for r in paths.select(shelf_of(F.col("blob"))).distinct().collect()]  # 256 at most

    def asked_rows() -> DataFrame:
        rows = read_ledger(spark, ledger).filter(F.col("shelf").isin(shelves))
        return rows.join(F.broadcast(paths.select("blob").distinct()), "blob", "left_semi") if few else rows

    seen = asked_rows().groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("versions"))).alias("seen"))
    asked = F.array(*map(F.lit, wanted))
    todo = (
        blobs.join(seen, "blob", "left")
        .select("blob", "key", F.array_except(asked, F.coalesce("seen", F.array().cast("array<string>"))).alias("versions"))
        .filter(F.size("versions") > 0)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for b, t, names in zip(*(batch.column(c) for c in range(3))):
                t = t.as_py()
                low = t.lower()
                out.append({"blob": b.as_py(), "versions": names.as_py(), "found": [{"version": v, "start": s, "stop": e} for v in names.as_py() for s, e in wanted[v].spans(t, low)]})
            kind = pa.schema([("blob", pa.binary()), ("versions", pa.list_(pa.string())), ("found", pa.list_(pa.struct([("version", pa.string()), ("start", pa.int64()), ("stop", pa.int64())])))])
            yield pa.RecordBatch.from_pylist(out, schema=kind)

    texts = versions.select(F.col(key).alias("key"), blob.alias("blob"), text.alias("text"))
    # Null keys count as equal here, so a path without a key is scanned too.
    same = texts["blob"].eqNullSafe(todo["blob"]) & texts["key"].eqNullSafe(todo["key"])
    fresh = texts.join(todo.hint("shuffle_hash"), same).select(texts["blob"], texts["text"], todo["versions"])
    # Rows repeated under one key are recorded once. Shelves are dealt to tasks by size.
    new = fresh.mapInArrow(run, SCANNED).dropDuplicates(["blob"]).withColumn("shelf", shelf_of(F.col("blob")))
    new.hint("rebalance", "shelf").write.mode("append").partitionBy("shelf").parquet(ledger)

    rank = F.create_map(*(F.lit(x) for i, v in enumerate(wanted) for x in (v, i)))
    kinds = F.create_map(*(F.lit(x) for v, r in wanted.items() for x in (v, r.kind)))
    span = lambda x: F.struct(x["start"].alias("start"), rank[x["version"]].alias("rank"), kinds[x["version"]].alias("kind"), x["stop"].alias("stop"))
    found = (
        asked_rows().select("blob", F.filter("found", lambda x: x["version"].isin(*wanted)).alias("found")).filter(F.size("found") > 0)
        .groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("found"))).alias("found"))
        .select("blob", F.array_sort(F.transform("found", span)).alias("spans"))
    )
    none = F.array().cast("array<struct<start:bigint,rank:int,kind:string,stop:bigint>>")
    return paths.join(found, "blob", "left").select(F.col("key").alias(key), "blob", F.coalesce("spans", none).alias("spans"))


def digest(spans, kinds: tuple[str, ...] | None = None):
    """``kind:start:end`` of the spans (of ``kinds`` only), joined by commas."""
    held = spans if kinds is None else F.filter(spans, lambda x: x["kind"].isin(*kinds))
    return F.array_join(F.transform(held, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")
