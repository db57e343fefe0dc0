"""SimHash near-duplicates by multi-index hashing.

A fingerprint has 64 bits; a bit is set if it is set in over half of the XXH64
hashes (seed 42) of the text's word shingles, repeats included.  Two
fingerprints at 3 or fewer differing bits differ in at most one bit in one of
their two halves: each distinct fingerprint probes, for each half, the 33
values of the Hamming ball of radius 1, meets the fingerprints stored under
their exact half, and the whole distance is verified.  Equal fingerprints are
one node, so copies are never expanded into pairs.

Nulls and oddities: null, empty and wordless texts have fingerprint zero and
link like any other; a null id is carried along and never names a component
that has another id.  Repeated rows get one row each.  An empty table gives an
empty table.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm.common import FOLD, prepare, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
HALF = 32
PART = 1 << 16  # shingles whose bits are unpacked at a time


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit fingerprint as a signed integer."""
    found = WORD.findall((text or "").translate(FOLD))
    if not found:
        return 0
    data = [w.encode("utf-8", "surrogatepass") for w in found]
    size = min(shingle, len(data))
    if size == 3:
        hashes = [xxhash.xxh64_intdigest(b"%b %b %b" % x, 42) for x in zip(data, data[1:], data[2:])]
    else:
        hashes = [xxhash.xxh64_intdigest(b" ".join(data[i:i + size]), 42) for i in range(len(data) - size + 1)]
    values = np.array(hashes, dtype=">u8")
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(values), PART):
        ones += np.unpackbits(values[i:i + PART].view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(values)).view(">i8")[0])


def fingerprints(docs: DataFrame, ident: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(id, uid, fp) of every row; uid is a hash of id and text."""
    def run(batches):
        for b in batches:
            prints = [fingerprint(t.as_py(), shingle) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(prints, pa.int64())], names=["id", "uid", "fp"])

    kind = docs.schema[ident].dataType.simpleString()
    return docs.select(F.col(ident).alias("id"), F.xxhash64(F.col(ident), F.col(text)).alias("uid"), F.col(text).alias("text")).mapInArrow(
        run, f"id {kind}, uid bigint, fp bigint")


def links(distinct: DataFrame, max_bits: int = 3) -> DataFrame:
    """Pairs (u, v), u < v, of different fingerprints at ``max_bits`` or fewer differing bits (3 at most)."""
    if not 0 <= max_bits <= 3:
        raise ValueError("two halves with a ball of radius 1 find distances up to 3")
    halves = [(F.lit(0).alias("s"), F.shiftrightunsigned("fp", HALF).alias("key")),
              (F.lit(1).alias("s"), F.col("fp").bitwiseAND(F.lit((1 << HALF) - 1)).alias("key"))]
    stored = distinct.select("fp", F.explode(F.array(*[F.struct(*h) for h in halves])).alias("x")).select("x.s", "x.key", "fp")
    ball = F.array(F.lit(0).cast("long"), *[F.lit(1 << k).cast("long") for k in range(HALF)])
    probes = (
        stored.select("s", "fp", "key", F.explode(ball).alias("flip"))
        .select("s", F.col("key").bitwiseXOR(F.col("flip")).alias("key"), F.col("fp").alias("u"))
    )
    return (
        probes.join(stored.withColumnRenamed("fp", "v"), ["s", "key"])
        .where((F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= max_bits))
        .select("u", "v").distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each node's component, for nodes with an edge.

    Alternating large-star and small-star steps; edges are rewired to the least
    neighbour until nothing changes, and the table is checkpointed each round."""
    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        else:
            both = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        joined = both.join(least, "u")
        if large:
            out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        return out.where("u != v")

    def mark(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    e = edges.select("u", "v").checkpoint()
    before = mark(e)
    while before[0]:
        e = star(star(e, True), False).distinct().checkpoint()
        after = mark(e)
        if after == before:
            break
        before = after
    return e.select(F.greatest("u", "v").alias("node"), F.least("u", "v").alias("root"))


def near_duplicates(docs: DataFrame, ident: str = "doc_id", text: str = "text", shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """(id, uid, fp, root, component): one row per row of ``docs``; component is the
    least id reachable over links of ``max_bits`` or fewer bits, root the least
    fingerprint."""
    prints = fingerprints(docs, ident, text, shingle).checkpoint()
    distinct = prints.groupBy("fp").agg(F.min("id").alias("least")).checkpoint()
    roots = components(links(distinct, max_bits)).withColumnRenamed("node", "fp")
    classes = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = classes.groupBy("root").agg(F.min("least").alias("component"))
    member = classes.select("fp", "root").join(named, "root").select("fp", "root", "component")
    return prints.join(member, "fp").select("id", "uid", "fp", "root", "component")


def representatives(docs: DataFrame, ident: str = "doc_id", text: str = "text", shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """One row of ``docs`` per component, that of the least id (null ids last), all columns as they are."""
    classes = near_duplicates(docs, ident, text, shingle, max_bits)
    kept = classes.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("n"), "id", "uid")).alias("x")).select(F.col("x.uid").alias("uid_"))
    # Rows equal in id and text have one uid; the join leaves them all and the last step one.
    own = docs.toDF(*[f"c{i}_" for i in range(len(docs.columns))])  # the caller may have a column uid_
    uid = F.xxhash64(*[F.col(own.columns[docs.columns.index(c)]) for c in (ident, text)])
    return own.withColumn("uid_", uid).join(kept, "uid_", "left_semi").dropDuplicates(["uid_"]).drop("uid_").toDF(*docs.columns)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return near_duplicates(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))
