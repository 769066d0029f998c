"""Near-duplicates by SimHash: covering hash tables find every pair of fingerprints within two bits.

Edge cases: null, empty and all-space texts have fingerprint zero and are linked like any other;
texts of fewer words than a shingle are one shingle; repeated rows stay rows; a null doc_id never
names a component unless no member has an id; columns of the output's names are replaced.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscope.llm.rows import with_columns_from
from tabscope.operators.components import connected_components
from tabscope.scratch import materialize

BITS = 64
RADIUS = 2
_FIELDS = T.StructType([T.StructField("fingerprint", T.LongType())])


def shingle_hashes(text: bytes | None, size: int = 3) -> np.ndarray:
    words = (text or b"").lower().split()  # bytes: A-Z and the six ASCII spaces only
    if not words:
        return np.empty(0, np.uint64)
    shingles = zip(*(words[i:] for i in range(size))) if len(words) >= size else [words]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(b" ".join(s), 42) for s in shingles), np.uint64)


def majority(hashes: np.ndarray, chunk: int = 1 << 16) -> int:
    """Bits set in over half the hashes, as a signed 64-bit number."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), chunk):
        part = hashes[at : at + chunk].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def with_fingerprints(docs: DataFrame, text: str = "text", size: int = 3) -> DataFrame:
    """``docs`` with ``fingerprint`` (long): the SimHash of the word shingles of the whole text."""

    def run(texts: list[bytes | None]) -> dict:
        return {"fingerprint": [majority(shingle_hashes(t, size)) for t in texts]}

    return with_columns_from(docs, text, _FIELDS, run)


def covering_masks(bits: int = BITS, radius: int = RADIUS) -> list[int]:
    """Masks such that any ``radius`` bits are all outside one of them.

    Bit i gets a nonzero vector of radius+1 binary digits; mask v holds the bits whose vector has an
    odd number of digits in common with v. ``radius`` vectors never span all of the space, so some
    nonzero v is orthogonal to the vectors of any ``radius`` differing bits: that mask skips them.
    """
    vectors = (1 << (radius + 1)) - 1
    return [
        sum(1 << i for i in range(bits) if ((i % vectors + 1) & v).bit_count() % 2)
        for v in range(1, vectors + 1)
    ]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def near_links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) that join all fingerprints within two differing bits, from distinct ``fingerprint``.

    A bucket of a covering table holds fingerprints that agree under its mask. Only buckets of two
    or more go on; there each fingerprint stands under itself and under its changes of one skipped
    bit. Two fingerprints are within two bits if and only if they stand under a common value, at
    most 65 do, and a star over those replaces the pairs. So a bucket of any size costs a fixed
    number of rows for each fingerprint, and no pair is listed.
    """
    masks = covering_masks()
    own = F.col("fingerprint")
    keyed = distinct.select(
        "fingerprint",
        F.posexplode(F.array(*[own.bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("tab", "key"),
    )
    busy = keyed.groupBy("tab", "key").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    skipped = F.array(*[
        F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)) for i in range(BITS) if not m >> i & 1])
        for m in masks
    ])
    flips = F.explode(F.element_at(skipped, F.col("tab") + 1)).alias("flip")
    stands = keyed.join(busy, ["tab", "key"]).select("fingerprint", flips)
    under = stands.select("fingerprint", own.bitwiseXOR(F.col("flip")).alias("value"))
    stars = under.groupBy("value").agg(F.collect_set("fingerprint").alias("near")).filter(F.size("near") > 1)
    spokes = stars.select(F.array_min("near").alias("a"), F.explode("near").alias("b"))
    return spokes.filter("a <> b").distinct()


def classes(prints: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(fingerprint, component_id, firsts): the smallest id reachable over links, per fingerprint.

    ``firsts`` counts the rows of the fingerprint that carry that id (zero if it has none).
    """
    held = prints.groupBy("fingerprint", F.col(doc_id).alias("id")).agg(F.count("*").alias("n"))
    smallest = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "n")).alias("first")
    distinct = materialize(held.groupBy("fingerprint").agg(smallest), "simhash-distinct")
    members = connected_components(near_links(distinct), "a", "b").select(F.col("node").alias("fingerprint"), "component")
    rooted = distinct.join(members, "fingerprint", "left").withColumn("root", F.coalesce("component", "fingerprint"))
    names = rooted.groupBy("root").agg(F.min("first").alias("name"))
    mine = F.col("first") == F.col("name")
    return rooted.join(names, "root").select(
        "fingerprint", F.col("name.id").alias("component_id"),
        F.when(mine, F.col("first.n")).otherwise(F.lit(0)).alias("firsts"), "root",
    )


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id."""
    prints = materialize(with_fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).drop("text"), "simhash")
    found = classes(prints).select("fingerprint", "component_id")
    hexed = F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint")
    return prints.join(found, "fingerprint").select("doc_id", hexed, "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component: the one with the smallest id, once; all columns stay.

    Among rows that share this id, in one fingerprint or several, any one stays.
    """
    columns = docs.columns
    prints = materialize(with_fingerprints(docs.withColumnsRenamed({c: f"c{i}" for i, c in enumerate(columns)}), f"c{columns.index(text)}"), "simhash-rows")
    key = f"c{columns.index(doc_id)}"
    found = materialize(classes(prints.select("fingerprint", key), key).filter("firsts > 0"), "simhash-kept")
    once = found.groupBy("root").agg(F.sum("firsts").alias("rows"))
    kept = found.join(once, "root").select("fingerprint", "component_id", "root", "rows")
    rows = prints.join(kept, "fingerprint").filter(F.col(key).eqNullSafe(F.col("component_id")))
    single, repeated = rows.filter("rows = 1"), rows.filter("rows > 1").dropDuplicates(["root"])
    back = [F.col(f"c{i}").alias(c) for i, c in enumerate(columns)]
    return single.select(*back).union(repeated.select(*back))
