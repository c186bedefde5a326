"""SimHash near-duplicates by multi-index hashing.

A 64-bit fingerprint is cut into two segments of 32 bits. Fingerprints that differ in at
most two bits differ in at most one bit of one segment, so each distinct fingerprint looks
up the ball of radius one around both of its segment values in the tables of segment
values, and every match is verified on all 64 bits. Equal fingerprints are one entry of
the tables, so copies never meet each other. Links become components.

Null text and text without words have fingerprint zero and are linked like any other. A null
doc_id links through its fingerprint; its component is that of the fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches_by_bytes, checkpoint, ship
from .components import components

SHINGLE_WORDS = 3
MAX_BITS = 2
SEED = 42
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit SimHash of a whole text; a bit is set if over half the shingle hashes have it."""
    import numpy as np
    from xxhash import xxh64_intdigest
    words = (text or "").encode().translate(_LOWER).split()
    n = len(words)
    if not n:
        return 0
    if n <= shingle_words:
        return xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    length = np.fromiter(map(len, words), np.int64, n)
    begin = np.concatenate([[0], np.cumsum(length + 1)[:-1]])
    total = n - shingle_words + 1
    ends = (begin + length)[shingle_words - 1:].tolist()
    begins = begin[:total].tolist()
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, total, 65_536):
        part = [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(begins[i:i + 65_536], ends[i:i + 65_536])]
        bits = np.unpackbits(np.array(part, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.nonzero(2 * counts > total)[0].tolist()))


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, tag, fp) per row; fp is the fingerprint's bits as a signed long, tag a hash of the text. No shuffle."""
    ship(docs.sparkSession)

    def run(it: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        for batch in batches_by_bytes(it, "text", 4 << 20):
            fp = np.array([fingerprint(t, shingle_words) for t in batch.column(2).to_pylist()], dtype=np.uint64)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(fp.view(np.int64))],
                                  names=["doc_id", "tag", "fp"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["text"]).alias("tag"),
                       docs["text"]).mapInArrow(run, "doc_id long, tag long, fp long")


def _segment_keys(fp, i: int):
    return F.shiftrightunsigned(fp, 32) if i else fp.bitwiseAND(F.lit(0xFFFFFFFF))


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Pairs a < b (signed order) of distinct fingerprints of column fp that differ in at most ``max_bits`` bits.

    ``max_bits`` may be 0 to 3: with two segments one of them has at most one wrong bit.

    Spark sizes the probes without the exploded rows (66 a fingerprint), so the join names its way: never a broadcast.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("two segments with balls of radius one cover at most three bits")
    one = fps.select("fp").distinct()
    radius = max_bits // 2
    fp = F.col("fp")
    masks = [0] + [1 << j for j in range(32) if radius]
    tables = one.select("fp", F.posexplode(F.array(*(_segment_keys(fp, i) for i in (0, 1)))).alias("seg", "key"))
    probes = (one.select("fp", F.posexplode(F.array(*(_segment_keys(fp, i) for i in (0, 1)))).alias("seg", "own"))
              .select("fp", "seg", F.explode(F.array(*(F.lit(m).cast("long") for m in masks))).alias("mask"), "own")
              .select("fp", "seg", F.col("own").bitwiseXOR(F.col("mask")).alias("key")))
    p, t = probes.alias("p"), tables.alias("t")
    near = F.bit_count(F.col("p.fp").bitwiseXOR(F.col("t.fp"))) <= max_bits
    return (p.join(t.hint("merge"), (F.col("p.seg") == F.col("t.seg")) & (F.col("p.key") == F.col("t.key"))
                   & (F.col("p.fp") < F.col("t.fp")) & near)
            .select(F.col("p.fp").alias("a"), F.col("t.fp").alias("b")).distinct())


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, tag, fp, component, component_id) per row of ``docs``.

    component names the group by a fingerprint; component_id is the smallest doc_id reachable, null only if
    every document of the component has a null doc_id.
    """
    own = checkpoint(fingerprints(docs, shingle_words))
    nodes = checkpoint(own.groupBy("fp").agg(F.min("doc_id").alias("first_doc")))
    groups = components(links(nodes, max_bits))
    labelled = nodes.join(groups, nodes["fp"] == groups["node"], "left").select(
        "fp", "first_doc", F.coalesce("component", "fp").alias("component"))
    first = labelled.groupBy("component").agg(F.min("first_doc").alias("component_id"))
    of_fp = checkpoint(labelled.join(first, "component").select("fp", "component", "component_id"))
    return own.join(of_fp, "fp").select("doc_id", "tag", "fp", "component", "component_id")


def keep_one(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each group, with all columns: that of the smallest doc_id (null is the largest).

    Decisions are made on (doc_id, hash of the text) alone; texts are shuffled once, by those keys, so no group
    meets in one task. Of rows that repeat doc_id and text the one with the least hash of all its columns stays.
    """
    found = checkpoint(near_duplicates(docs, shingle_words, max_bits).select("doc_id", "tag", "component"))
    kept = (found.groupBy("component")
            .agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag")).alias("k"), F.count(F.lit(1)).alias("n"))
            .select(F.col("k.doc_id").alias("k_id"), F.col("k.tag").alias("k_tag")))
    row = docs.select(F.struct("*").alias("row"), F.xxhash64(docs["text"]).alias("tag"),
                      docs["doc_id"].cast("long").alias("doc_id"))
    out = row.join(kept.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("k_id"))
                   & (F.col("tag") == F.col("k_tag")), "left_semi")
    if found.groupBy("doc_id", "tag").count().where("count > 1").limit(1).count():
        first = Window.partitionBy("doc_id", "tag").orderBy(F.xxhash64(F.to_json("row")))
        out = out.withColumn("nth", F.row_number().over(first)).where("nth = 1")
    return out.select("row.*")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, fingerprint as 16 lower-case hex digits, component_id."""
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
