"""SimHash near-dedup with deletion-variant signatures.

Fingerprint: texts are lower-cased (A-Z), cut into words ``[^\\x20\\x09-\\x0D]+``
and into shingles of ``shingle`` words, repeats included; a bit of the 64-bit
fingerprint is set if it is set in over half of the shingles' XXH64 (seed 42).

Links: two fingerprints link at ``max_bits`` = 2 or fewer differing bits.  The
fingerprint is cut into two segments of 32 bits; then one of the segments of
a linked pair differs by at most one bit.  If it is the low one, the pair shares
a one-wildcard variant of it (wildcard bit, the other 31 bits); if the low one
differs by two bits, the high one doesn't differ at all.  So every distinct fingerprint
is indexed under the 32 variants of its low segment and its high segment as
it is; the keys are equality-joined and the candidates verified on all bits.

Copies and hot signatures.  Equal fingerprints are one node from the start, so
exact copies cost nothing.  Signatures are counted first (with partial sums in each
task); one with a single fingerprint is gone, one with two gives its pair
at once, one with up to ``pair_bucket`` is compared pairwise in a bounded list.
The fingerprints of fuller signatures (many near copies that share a segment)
are linked exactly by another equality: two fingerprints are within 2 bits if
and only if their sets {itself, its 64 one-bit neighbours} meet, so each
member is tied to the least member under each of its 65 keys; a key has at
most 65 distinct members, and every two of them are linked.  No pair of such a crowd is
spelled out, none is lost.

Components are found by star contraction on the links (``graph.components``).

Defined results
* null and empty texts have the fingerprint zero, linked like any other;
* repeated rows and rows with a null id take part like others; the component
  id is the least non-null doc_id of the component, null if it has none;
* extra columns are kept, a clashing output name is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlake.llm import tokens as T
from textlake.llm.common import cut, free_name, utf8
from textlake.llm.graph import components

SHINGLE = 3
MAX_BITS = 2
#: Signatures of up to so many fingerprints are compared pairwise.
PAIR_BUCKET = 16


def fingerprints(texts: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """64-bit fingerprints (uint64) of some texts."""
    out = np.zeros(len(texts), np.uint64)
    digest = xxhash.xxh64_intdigest
    for lo, hi in T.chunks(texts):
        hashes: list[int] = []
        counts = np.zeros(hi - lo, np.int64)
        for k in range(lo, hi):
            words = texts[k].lower().split()
            if not words:
                continue
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = np.concatenate([[0], ends[:-1] + 1])
            n = max(len(words) - shingle + 1, 1)
            last = ends[-n:].tolist()
            hashes += [digest(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), last)]
            counts[k - lo] = n
        if not hashes:
            continue
        h = np.array(hashes, np.uint64)
        off = np.concatenate([[0], np.cumsum(counts)])
        for bit in range(64):
            ones = np.concatenate([[0], np.cumsum((h >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)])
            is_set = 2 * (ones[off[1:]] - ones[off[:-1]]) > counts
            out[lo:hi] |= is_set.astype(np.uint64) << np.uint64(bit)
    return out


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "_fp", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with the fingerprint as a (signed) long."""

    @F.arrow_udf("long")
    def judge(t: pa.Array) -> pa.Array:
        return pa.array(fingerprints(t.to_pylist(), shingle).view(np.int64))

    return docs.withColumn(out, judge(utf8(F.col(text))))


_SIGNATURES = """
explode(concat(transform(sequence(0, 31), b -> shiftleft(cast(b AS BIGINT), 32) | (fp & 4294967295L & ~shiftleft(1L, b))),
               array(shiftleft(32L, 32) | shiftrightunsigned(fp, 32)))) AS sig"""


def links(prints: DataFrame, pair_bucket: int = PAIR_BUCKET, max_bits: int = MAX_BITS) -> DataFrame:
    """Links ``a``, ``b`` between distinct fingerprints (column ``fp``) of at
    most 2 differing bits: every linked pair is joined by a chain of them."""
    if max_bits != 2:
        raise ValueError("the two-segment index is for 2 bits")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    sigs = prints.selectExpr("fp", _SIGNATURES)
    full = cut(sigs.groupBy("sig").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
               .filter(F.col("n") > 1))
    found = full.filter((F.col("n") == 2) & near).select("a", "b")
    many = full.filter(F.col("n") > 2).select("sig", "n")
    members = cut(sigs.join(many, "sig").select("sig", "n", "fp"))
    # some: bounded lists, compared pairwise and verified
    some = (members.filter(F.col("n") <= pair_bucket).groupBy("sig").agg(F.collect_list("fp").alias("g"))
            .select("g", F.explode("g").alias("a")).select("a", F.explode("g").alias("b"))
            .filter((F.col("a") < F.col("b")) & near).distinct())
    # crowds: keys are the fingerprint and its one-bit neighbours
    crowd = members.filter(F.col("n") > pair_bucket).select("fp").distinct()
    keys = crowd.selectExpr("fp", "explode(concat(array(fp), transform(sequence(0, 63), b -> fp ^ shiftleft(1L, b)))) AS key")
    least = keys.groupBy("key").agg(F.min("fp").alias("a"), F.count("*").alias("n")).filter(F.col("n") > 1)
    tied = (keys.join(least.select("key", "a"), "key").select("a", F.col("fp").alias("b"))
            .filter(F.col("a") < F.col("b")).distinct())
    return cut(found.unionByName(some).unionByName(tied).distinct())


def _row_keys(doc_id: str, text: str):
    """128 bits for a row's id and text (never null), so that repeated rows are equal."""
    return (F.xxhash64(F.col(doc_id), F.col(text)).alias("_k1"),
            F.xxhash64(F.col(text), F.lit(1), F.col(doc_id)).alias("_k2"))


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
           max_bits: int = MAX_BITS, pair_bucket: int = PAIR_BUCKET) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, its row keys, ``fp``, ``root``
    (least fingerprint of the component) and ``component_id``."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), *_row_keys(doc_id, text), F.col(text).alias("_t"))
    rows = cut(with_fingerprint(rows, "_t", "fp", shingle).drop("_t"))
    prints = rows.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    # every print becomes 33 rows: deal the few bytes out to all tasks first
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    roots = components(links(prints.select("fp").repartition(parts), pair_bucket, max_bits), "a", "b")
    named = (prints.join(roots, prints["fp"] == roots["node"], "left")
             .select("fp", "least_id", F.coalesce("root", "fp").alias("root")))
    tops = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = named.join(tops, "root").select("fp", "root", "component_id")
    return rows.join(named, "fp").select("doc_id", "_k1", "_k2", "fp", "root", "component_id")


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **params) -> DataFrame:
    """One document of each group: the one named by the component id (of
    repeated rows one, of a group without ids one); same columns as ``docs``."""
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("_k1"), F.col("_k2"))
    keep = (groups(docs, doc_id, text, **params).groupBy("root").agg(F.min(order).alias("k"))
            .select("k._k1", "k._k2"))
    k1, k2 = free_name(docs, "_k1"), free_name(docs, "_k2")
    a, b = _row_keys(doc_id, text)
    # repeats of a row go in the tasks that read them, so no key is left with many texts
    rows = docs.withColumns({k1: a, k2: b}).dropDuplicates([k1, k2])
    kept = rows.join(keep, (rows[k1] == keep["_k1"]) & (rows[k2] == keep["_k2"]), "left_semi")
    return kept.drop(k1, k2)
