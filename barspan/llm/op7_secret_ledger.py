"""Secret scans over an incremental ledger of blobs.

Every version of every text is a blob, named by the SHA-256 of its UTF-8 bytes. The ledger is
a Parquet table with one row per (blob, rule version) that was ever scanned, with its findings
(none is a finding too). A scan takes the distinct blobs of the given rows, leaves out those the
ledger has under the current rule version, runs the rules over the rest, appends them, and
joins the findings back to every row that holds the blob. A changed rule set has another
version, so old blobs are scanned again; unchanged texts never are.

Spans are in code points, end exclusive; matches of one kind do not overlap. A group of equal
texts is scanned once, and only distinct texts are moved.

Nulls: a null text is the empty blob; a null id is returned. Repeated rows give repeated rows.
An empty table gives an empty result and leaves the ledger as it is. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barspan.llm.common import modest_batches, shared_dir
from barspan.llm.textops import tidy

# The base rules, in the order that ties are listed in.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_MIN, ACCESS_MIN, HEX_MIN = 6, 20, 24
BASE = ("assign", "access", "hex")
#: Kinds that this scanner adds: public key formats with a fixed prefix.
ADDED = {
    "pem": r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----",
    "forge": r"gh[pousr]_[A-Za-z0-9]{36,}",
    "chat": r"xox[abprs]-[A-Za-z0-9-]{10,}",
    "cloud": r"AIza[A-Za-z0-9_-]{35}",
    "jwt": r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    "userinfo": r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,100}:[^\s/:@]{3,200}@",
}
KINDS = (*BASE, *ADDED)
LEDGER = "blob string, rule_version string, findings array<struct<kind:string,start:int,end:int>>"

_ASSIGN = re.compile(ASSIGN, re.ASCII | re.IGNORECASE)
# a run of the class is taken whole, so a minimum in the pattern drops just the short runs
_ACCESS = re.compile(rf"AKIA[A-Z0-9]{{{ACCESS_MIN - 4},}}")
_HEX = re.compile(rf"[0-9a-f]{{{HEX_MIN},}}")
_ADDED = {k: re.compile(p) for k, p in ADDED.items()}
_HINTS = {"pem": "-----BEGIN ", "forge": "gh", "chat": "xox", "cloud": "AIza", "jwt": "eyJ", "userinfo": "://"}
_ASSIGN_HINTS = ("passw", "secret", "token", "api")


def rule_version() -> str:
    rules = [ASSIGN, ASSIGN_MIN, ACCESS_MIN, HEX_MIN, *ADDED.items()]
    return hashlib.sha256(repr(rules).encode()).hexdigest()


def find(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of a text, by start, then by the order of ``KINDS``."""
    out = []
    low = text.lower()
    if any(h in low for h in _ASSIGN_HINTS):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_MIN]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    for kind, hint in _HINTS.items():
        if hint in text:
            out += [(kind, *m.span()) for m in _ADDED[kind].finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _scanned(blobs: DataFrame, version: str) -> DataFrame:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        for b in batches:
            found = [[dict(zip(("kind", "start", "end"), s)) for s in find(t.as_py())] for t in b.column("text")]
            cols = [b.column("blob"), pa.array([version] * b.num_rows, pa.string()), pa.array(found, kind)]
            yield pa.RecordBatch.from_arrays(cols, ["blob", "rule_version", "findings"])

    return blobs.mapInArrow(tidy(run), LEDGER)


def _text():
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger at ``path``; one that is not there yet is empty."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(path)


def scan(docs: DataFrame, ledger_path: str, version: str | None = None) -> DataFrame:
    """Scan what the ledger lacks, append it, and return (doc_id, blob, findings) for every row."""
    spark, version = docs.sparkSession, version or rule_version()
    modest_batches(spark)
    seen = read_ledger(spark, ledger_path).where(F.col("rule_version") == version).select("blob")
    texts = docs.select(_text().alias("text")).withColumn("blob", F.sha2("text", 256)).select("blob", "text")
    fresh = texts.dropDuplicates(["blob"]).join(seen, "blob", "left_anti").select("blob", "text")
    _scanned(fresh, version).write.mode("append").parquet(ledger_path)
    # two writers, or a retried append, may leave a blob twice: its findings are the same
    found = read_ledger(spark, ledger_path).where(F.col("rule_version") == version).select("blob", "findings").dropDuplicates(["blob"])
    paths = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(_text(), 256).alias("blob"))
    return paths.join(found, "blob")


def digests(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of the base spans and all spans as text."""

    def spelled(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("findings", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("findings", lambda s: s["kind"].isin(*BASE))
    return found.select(
        "doc_id", *[count(k) for k in BASE], F.sha2(spelled(base), 256).alias("base_sha256"), spelled(F.col("findings")).alias("spans")
    )


def secrets(docs: DataFrame, ledger_path: str | None = None) -> DataFrame:
    """Digests of every document under a ledger that is new unless ``ledger_path`` names one."""
    return digests(scan(docs, ledger_path or shared_dir(docs.sparkSession, "secret-ledger")))
