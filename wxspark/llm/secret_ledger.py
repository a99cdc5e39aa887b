"""Secret scan with an incremental blob ledger, in DataFrame operations only.

Every version of every document is addressed by the SHA-256 of its content. The ledger is a Parquet table with one row per
(blob, rule, rule version) that was scanned, with the spans found (often none), appended in one write: a pair in it
is never scanned again, and a new version of one rule makes only that rule run over the known blobs. Findings go
back to all documents, and all their versions, that hold the blob.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wxspark.llm.common import sheltered
from wxspark.session import stored

LEDGER = "blob string, rule string, version int, spans array<struct<start:int,end:int>>"


@dataclass(frozen=True)
class Rule:
    """``pattern`` in Java syntax, matched leftmost without overlaps; a match counts if ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1


#: Runs of a fixed class are taken greedily, so a minimum length can stand in the pattern. That is not so for assignments,
#: where a short value still uses up its text.
BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
EXTRA_RULES = (Rule("pem", r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----"),)
RULES = BASE_RULES + EXTRA_RULES


def content_id(text: str | Column) -> Column:
    """Address of a content; null counts as the empty text."""
    return F.sha2(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), 256)


def spans(text: str, rule: Rule) -> Column:
    """array<struct<start, end>> in code points: the text between matches and the matches, both in order, give the places."""
    col = F.col(text)
    between = F.split(col, rule.pattern, -1)
    whole = F.regexp_extract_all(col, F.lit(rule.pattern), F.lit(0))
    checked = F.regexp_extract_all(col, F.lit(rule.pattern), F.lit(rule.group))
    gaps = F.transform(F.slice(between, 1, F.size(whole)), F.length)
    step = F.arrays_zip(gaps.alias("gap"), F.transform(whole, F.length).alias("size"), F.transform(checked, F.length).alias("checked"))
    none = F.array().cast("array<struct<start:int,end:int,ok:boolean>>")
    start = F.struct(none.alias("out"), F.lit(0).alias("at"))

    def add(a: Column, x: Column) -> Column:
        at = a["at"] + x["gap"]
        one = F.struct(at.alias("start"), (at + x["size"]).alias("end"), (x["checked"] >= rule.least).alias("ok"))
        return F.struct(F.concat(a["out"], F.array(one)).alias("out"), (at + x["size"]).alias("at"))

    found = F.aggregate(step, start, add, lambda a: F.filter(a["out"], lambda s: s["ok"]))
    plain = F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    return F.when(col.rlike(rule.pattern), plain).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger at ``path``; empty when nothing was scanned yet."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.read.schema(LEDGER).parquet(path)
    return spark.createDataFrame([], LEDGER)


def scan(versions: DataFrame, path: str, rules: tuple[Rule, ...] = RULES, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Scan the unseen (blob, rule version) pairs of ``versions`` into the ledger at ``path``; returns the scanned rows.

    ``versions`` has a row per path and historical version; null texts are empty. One row stands for each unseen blob: the
    one with the smallest ``row_id``, rows that repeat it included, which then count once. The large side is shuffled
    by blob and row id together, so copies of one blob are not gathered anywhere.
    """
    spark = versions.sparkSession
    rows = versions.select(F.col(row_id).alias("_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text")).withColumn("_blob", content_id("_text"))
    blobs = rows.groupBy("_blob").agg(F.min("_id").alias("_id"))
    pairs = blobs.withColumn("rule", F.explode(F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])))
    seen = ledger(spark, path).select(F.col("blob").alias("_blob"), F.struct(F.col("rule").alias("kind"), "version").alias("rule")).distinct()
    unseen = pairs.join(seen, ["_blob", "rule"], "left_anti").groupBy("_blob", "_id").agg(F.collect_set("rule.kind").alias("due"))
    unseen = unseen.select(F.col("_blob").alias("blob"), F.col("_id").alias("id"), "due")
    due = rows.join(unseen.hint("shuffle_hash"), (F.col("_blob") == F.col("blob")) & F.col("_id").eqNullSafe(F.col("id")))
    per_rule = [
        F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version"), F.when(F.array_contains("due", r.kind), spans("_text", r)).alias("spans"))
        for r in rules
    ]
    found = due.select("blob", F.explode(F.array(*per_rule)).alias("f")).where("f.spans is not null")
    scanned = found.groupBy("blob", "f.rule", "f.version").agg(F.min("f.spans").alias("spans"))
    scanned.write.mode("append").parquet(path)
    return ledger(spark, path)


def findings(scanned: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per blob with at least one finding: (blob, found), sorted by start and then by the order of the rules."""
    rank = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    current = None
    for r in rules:
        this = (F.col("rule") == r.kind) & (F.col("version") == r.version)
        current = this if current is None else current | this
    each = scanned.where(current & (F.size("spans") > 0)).select("blob", "rule", F.explode("spans").alias("s"))
    one = F.struct(F.col("s.start").alias("start"), rank[F.col("rule")].alias("rank"), F.col("s.end").alias("end"), F.col("rule").alias("kind"))
    return each.groupBy("blob").agg(F.sort_array(F.collect_set(one)).alias("found"))


def attach(versions: DataFrame, found: DataFrame, text: str = "text", into: str = "found") -> DataFrame:
    """All rows of ``versions`` and a column ``into`` with what was found (an empty array where there is nothing).

    A column of ``versions`` called ``into`` is replaced; all others stay, whatever their names.
    """
    empty = F.array().cast(found.schema["found"].dataType)
    renamed = found.select(F.col("blob").alias("_found_blob"), F.col("found").alias("_found"))

    def run(rows: DataFrame) -> DataFrame:
        joined = rows.withColumn("_blob", content_id(F.col(text).cast("string"))).join(renamed, F.col("_blob") == F.col("_found_blob"), "left")
        return joined.withColumn(into, F.coalesce("_found", empty))

    return sheltered(versions, (text,), run, adds=(into,))


def masked(text: str = "text", found: str = "found", mark: str = "[SECRET]") -> Column:
    """The text with every finding replaced by ``mark``; findings that overlap are replaced together."""
    col = F.coalesce(F.col(text), F.lit(""))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def add(a: Column, s: Column) -> Column:
        fresh = s["start"] >= a["at"]
        piece = F.concat(a["out"], F.substring(col, a["at"] + 1, F.greatest(s["start"] - a["at"], F.lit(0))), F.lit(mark))
        return F.struct(F.when(fresh, piece).otherwise(a["out"]).alias("out"), F.greatest(a["at"], s["end"]).alias("at"))

    whole = F.aggregate(found, start, add, lambda a: F.concat(a["out"], F.substring(col, a["at"] + 1, F.length(col))))
    return F.when(F.size(found) == 0, F.col(text)).otherwise(whole)


def labelled(found: Column) -> Column:
    """kind:start:end of each finding, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("found", lambda s: s["kind"] == kind))


def report(documents: DataFrame, path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, counts and spans per document, by way of the ledger at ``path``.

    The ledger grows in two runs, as it does from day to day: the contents whose address lies in the lower half under the base rules, then
    all contents under all rules. The second run scans new contents in full and the known ones for the newer rules alone.
    """
    docs = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    scan(docs.where(content_id("text") < "8"), path, tuple(r for r in rules if r in BASE_RULES))
    found = findings(scan(docs, path, rules), rules)
    addressed = stored(docs.select("doc_id", content_id("text").alias("blob")), "addressed")
    empty = F.array().cast(found.schema["found"].dataType)
    places = found.select(F.col("blob").alias("_blob"), F.col("found").alias("_found"))
    rows = addressed.join(places, F.col("blob") == F.col("_blob"), "left").select("doc_id", F.coalesce("_found", empty).alias("found"))
    base = [r.kind for r in BASE_RULES]
    only_base = F.filter("found", lambda s: s["kind"].isin(base))
    counts = [_count(k).cast("long").alias(f"n_{k}") for k in base]
    return rows.select("doc_id", *counts, F.sha2(labelled(only_base), 256).alias("base_sha256"), labelled(F.col("found")).alias("spans"))
