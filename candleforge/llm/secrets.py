"""Secret scans over an incremental blob ledger.

Every version of every document is addressed by the SHA-256 of its text. A ledger, a table in the shared folder, holds
the findings per (blob, rule version); only pairs that it lacks are scanned, each once however many paths or versions
share the blob, and appended. Findings are joined back to all paths. Everything is a DataFrame expression.

Positions: Java's split() and find() walk the same leftmost non-overlapping matches, so the lengths of the pieces
between matches and of the matches themselves, summed up in order, give each match's place in code points.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from candleforge.llm.common import checkpointed, exists, shared_root


@dataclass(frozen=True)
class Rule:
    """Matches of `pattern`, kept if group `group` has at least `least` characters."""

    kind: str
    pattern: str
    group: int
    least: int


# The base rules, in the order in which kinds are listed.
ASSIGN = Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6)
ACCESS = Rule("access", r"AKIA[A-Z0-9]+", 0, 20)
HEX = Rule("hex", r"[0-9a-f]+", 0, 24)
RULES = (ASSIGN, ACCESS, HEX)
RULE_VERSION = "base-1"

#: Findings are broadcast up to this size, reckoned as so much for each blob and each span.
BROADCAST_BYTES, BLOB_BYTES, SPAN_BYTES = 16 << 20, 160, 32

LEDGER = "blob string, rule_version string, n_assign long, n_access long, n_hex long, spans array<struct<start:long,kind:int,end:long>>"


def _search(rule: Rule) -> str:
    """The pattern that is looked for. Runs of one character class match maximally, so a minimum length may be
    part of it without changing which runs are kept; for the assignment a short value must still be consumed."""
    if rule is HEX:
        return f"[0-9a-f]{{{rule.least},}}"
    if rule is ACCESS:
        return f"AKIA[A-Z0-9]{{{rule.least - 4},}}"
    return rule.pattern


def _matches(text: Column, rule: Rule) -> Column:
    """array<struct<gap, size, kept>>: for each match the characters since the last one, its length, whether it counts."""
    pattern = F.lit(_search(rule))
    gaps = F.transform(F.split(text, _search(rule), -1), F.length)
    sizes = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length)
    kept = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), lambda x: F.length(x) >= rule.least)
    return F.when(text.rlike(_search(rule)), F.arrays_zip(gaps.alias("gap"), sizes.alias("size"), kept.alias("kept")))


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES, version: str = RULE_VERSION) -> DataFrame:
    """Ledger rows of blobs (blob, text), one per blob, those without findings included."""
    marked = blobs.select("blob", F.explode(F.array(*[F.struct(F.lit(i).alias("kind"), _matches(F.col("text"), r).alias("m")) for i, r in enumerate(rules)])).alias("x"))
    hits = marked.where(F.col("x.m").isNotNull()).select("blob", F.col("x.kind").alias("kind"), F.posexplode("x.m").alias("i", "p"))
    order = Window.partitionBy("blob", "kind").orderBy("i")
    upto = F.sum(F.col("p.gap") + F.coalesce(F.col("p.size"), F.lit(0))).over(order)
    placed = hits.select("blob", "kind", (upto - F.col("p.size")).cast("long").alias("start"), upto.cast("long").alias("end"), F.col("p.kept").alias("kept"))
    counts = [F.count_if(F.col("kind") == i).alias(f"n_{r.kind}") for i, r in enumerate(rules)]
    found = placed.where("kept").groupBy("blob").agg(*counts, F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))
    return found.select("blob", F.lit(version).alias("rule_version"), *[f"n_{r.kind}" for r in rules], "spans")


def blob_of(text: Column) -> Column:
    """Content address of a text; null is the empty text."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def unseen_blobs(versions: DataFrame, ledger: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(fresh, texts): the distinct contents of versions (blob, text) that the ledger, of one rule version, lacks, as
    (blob), checkpointed, and as (blob, text).

    Addresses are compared first. If few are new, only their texts are shuffled, to meet their copies; otherwise all are,
    once, copies within a task only once.
    """
    fresh = versions.select("blob").distinct()
    if ledger is None:
        return checkpointed(fresh), versions.dropDuplicates(["blob"])
    fresh = checkpointed(fresh.join(ledger.select("blob"), "blob", "left_anti"))
    if fresh.count() * BLOB_BYTES <= BROADCAST_BYTES:
        return fresh, versions.join(F.broadcast(fresh), "blob", "left_semi").dropDuplicates(["blob"])
    return fresh, versions.dropDuplicates(["blob"]).join(fresh, "blob", "left_semi")


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, version: str = RULE_VERSION) -> DataFrame:
    """Ledger rows of the contents of versions (text and any other columns) that the ledger lacks, to be appended to it; a
    blob without findings has a row with none."""
    addressed = versions.select(blob_of(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
    fresh, texts = unseen_blobs(addressed, None if ledger is None else ledger.where(F.col("rule_version") == version))
    found = checkpointed(scan_blobs(texts, rules, version).drop("rule_version"))
    zero = [F.coalesce(F.col(f"n_{r.kind}"), F.lit(0).cast("long")).alias(f"n_{r.kind}") for r in rules]
    spans = F.coalesce("spans", F.array().cast("array<struct<start:long,kind:int,end:long>>")).alias("spans")
    return fresh.join(found, "blob", "left").select("blob", F.lit(version).alias("rule_version"), *zero, spans)


def span_text(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    one = lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    return F.coalesce(F.array_join(F.transform(spans, one), ","), F.lit(""))


def _findings(texts: DataFrame, ledger: BlobLedger | None) -> DataFrame:
    """Ledger rows with findings of the contents of texts (text), which the ledger, if any, holds from now on."""
    if ledger is None:
        return scan(texts).where(F.size("spans") > 0)
    ledger.update(texts)
    known = ledger.read().where((F.col("rule_version") == RULE_VERSION) & (F.size("spans") > 0))
    return known.join(texts.select(blob_of(F.col("text")).alias("blob")).distinct(), "blob", "left_semi")


def document_findings(docs: DataFrame, ledger: BlobLedger | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, spans array) of every row of docs.

    Null text is empty and has no findings; texts are searched whole; of matches that begin together the kind listed
    first comes first. Repeated rows are repeated; null ids keep their rows; an empty table gives an empty result; other
    columns are not read, whatever their names. With a ledger, contents that it holds are not scanned again.
    """
    paths = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    joined = _matched(paths.select("doc_id", blob_of(F.col("text")).alias("blob")), _findings(paths, ledger).drop("rule_version"), "blob")
    return joined.select("doc_id", *[F.coalesce(f"n_{r.kind}", F.lit(0).cast("long")).alias(f"n_{r.kind}") for r in RULES], "spans")


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", ledger: BlobLedger | None = None) -> DataFrame:
    """docs with every found span replaced by a mark, overlapping spans by one; other texts are untouched.

    Columns, whatever their names, rows, repeated ones too, and nulls stay; texts of any length are redacted whole. An
    n_chars column, where there is one, follows the new text. An empty table gives an empty result.
    """
    text = F.col(text_col)
    # the row goes as one struct, so that no column's name can clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text.alias("text"), blob_of(text).alias("blob"))
    joined = _matched(rows, _findings(docs.select(text.alias("text")), ledger).select("blob", "spans"), "blob")
    old = F.col("text")

    def step(acc: Column, s: Column) -> Column:
        # a span that begins inside the last one only moves its end
        gap = F.when(s["start"] >= acc["at"], F.concat(F.substring(old, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mark))).otherwise(F.lit(""))
        return F.struct(F.concat(acc["out"], gap).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    clean = F.aggregate("spans", start, step, lambda acc: F.concat(acc["out"], F.substring(old, (acc["at"] + 1).cast("int"), F.length(old))))
    new = joined.select("row", F.when(F.col("spans").isNull(), old).otherwise(clean).alias("text"), F.col("spans").isNotNull().alias("found"))
    own = {c: F.col("row").getField(c) for c in docs.columns} | {text_col: F.col("text")}
    if "n_chars" in own:
        own["n_chars"] = F.when(F.col("found"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(own["n_chars"])
    return new.select(*[c.alias(name) for name, c in own.items()])


def _matched(left: DataFrame, findings: DataFrame, key: str) -> DataFrame:
    """left with the findings of its blobs. Findings are written first; where they are few they are broadcast, so that
    neither texts nor the copies of one blob are shuffled, else both sides are shuffled for the join alone, which
    lets adaptive execution split a blob that very many rows share."""
    found = checkpointed(findings)
    size = found.agg(F.sum(F.lit(BLOB_BYTES) + F.size("spans") * SPAN_BYTES).alias("n")).first().n or 0
    return left.join(F.broadcast(found) if size <= BROADCAST_BYTES else found, key, "left")


class BlobLedger:
    """The ledger as an append-only Parquet table, a folder for each rule version. Every row holds all about its blob, so
    a batch that a lost driver left in part, or that two runs appended, needs no repair."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    @staticmethod
    def shared(spark: SparkSession) -> BlobLedger:
        """The ledger of the folder that the cluster shares; it outlives the application."""
        return BlobLedger(spark, f"{shared_root(spark)}/blob-ledger")

    def read(self) -> DataFrame:
        """All rows; an absent ledger is empty. A blob that was appended twice counts once."""
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], LEDGER)
        return self.spark.read.schema(LEDGER).parquet(self.path).dropDuplicates(["blob", "rule_version"])

    def update(self, versions: DataFrame, version: str = RULE_VERSION) -> DataFrame:
        """Scan what is new in versions (text) and append it; returns the rows appended."""
        held = self.read() if exists(self.spark, self.path) else None
        new = checkpointed(scan(versions, held, version=version))
        if not new.isEmpty():
            new.write.mode("append").partitionBy("rule_version").parquet(self.path)
        return new
