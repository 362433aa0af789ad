"""Sharding by minimax contiguous partition, with DataFrame functions only.

Atoms are sets of whole equal-text groups, ordered by the first digits of the text's MD5: at most
`2**atom_bits` of them, so their sizes are a bounded table. A binary search over the capacity finds
the smallest one for which cutting greedily gives at most `shards` contiguous runs; under that
capacity the runs are cut towards fair shares of what remains. Slots number a shard's rows without gaps: salted buckets are counted,
summed up, and numbered inside, so neither a large shard nor a hot text is one task's work.

Edge cases: a null text counts as an empty one (8 bytes, CRC 0) and shares its group; equal texts
share a shard; fewer atoms than shards leave shards empty; repeated rows each get a slot; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, slices_for, written

SHARDS = 24
ATOM_BITS = 16


def feasible(sums: list[int], capacity: int, shards: int) -> list[int] | None:
    """Greedy check: the last atom index (exclusive) of each run under `capacity`, or None if it takes more than `shards`."""
    cuts, at, base = [], 0, 0
    while at < len(sums):
        nxt = bisect_right(sums, base + capacity, at)
        if nxt == at or len(cuts) == shards:
            return None
        cuts.append(nxt)
        base, at = sums[nxt - 1], nxt
    return cuts


def fair_share(sizes: list[int], shards: int) -> float:
    """An equal share among the shards that are left when each atom beyond it has one of its own; 0 if those take all."""
    heavy, share = [], 0.0
    while shards > len(heavy):
        share = (sum(sizes) - sum(heavy)) / (shards - len(heavy))
        beyond = [x for x in sizes if x > share]
        if len(beyond) == len(heavy):
            return share
        heavy = beyond
    return 0.0


def even_cuts(sizes: list[int], sums: list[int], capacity: int, shards: int) -> list[int]:
    """Cuts under a feasible capacity, each nearest to a fair share of what remains, as far as the rest still fits."""
    need = [0] * (len(sums) + 1)  # the fewest runs under `capacity` that take the atoms from here on
    for i in range(len(sums) - 1, -1, -1):
        need[i] = 1 + need[bisect_right(sums, (sums[i - 1] if i else 0) + capacity, i)]
    cuts, at, base = [], 0, 0
    for left in range(shards, 0, -1):
        if at == len(sums):
            break
        last = bisect_right(sums, base + capacity, at)
        share = fair_share(sizes[at:], left)
        nxt = min(max(bisect_right(sums, base + share, at), at + 1), last)
        if nxt < last and sums[nxt] - base - share < base + share - sums[nxt - 1]:
            nxt += 1
        while need[nxt] > left - 1:
            nxt += 1
        cuts.append(nxt)
        base, at = sums[nxt - 1], nxt
    return cuts


def minimax_cuts(sizes: list[int], shards: int) -> tuple[int, list[int]]:
    """The smallest capacity that is feasible, and even cuts under it."""
    if not sizes:
        return 0, []
    sums = list(accumulate(sizes))
    low, high = max(max(sizes), -(-sums[-1] // shards)), sums[-1]
    while low < high:
        mid = (low + high) // 2
        if feasible(sums, mid, shards) is None:
            low = mid + 1
        else:
            high = mid
    return low, even_cuts(sizes, sums, low, shards)


def atom_of(text: Column, bits: int = ATOM_BITS) -> Column:
    """The first `bits` bits of the text's MD5: equal texts share an atom."""
    head = F.conv(F.substring(F.md5(F.encode(text, "UTF-8")), 1, 8), 16, 10).cast("long")
    return F.shiftright(head, 32 - bits).cast("int")


def shard(docs: DataFrame, shards: int = SHARDS, atom_bits: int = ATOM_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard. The law is `bytes`."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = written(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            (F.octet_length(text).cast("long") + 8).alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            atom_of(text, atom_bits).alias("_atom"),
        ),
        "sizes",
    )
    atoms = rows.groupBy("_atom").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()  # at most 2**atom_bits rows
    atoms.sort(key=lambda r: r["_atom"])
    _, cuts = minimax_cuts([r["bytes"] for r in atoms], shards)
    starts = [atoms[c]["_atom"] for c in cuts[:-1]]  # the first atom of each later shard
    number = sum((F.when(F.col("_atom") >= s, 1).otherwise(0) for s in starts), F.lit(0)).cast("int")
    buckets = slices_for(sum(r["n"] for r in atoms), shards * 50_000, 16)
    salted = rows.select("*", number.alias("shard"), F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(buckets)).cast("int").alias("_bucket"))
    counted = salted.groupBy("shard", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counted.select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    inside = Window.partitionBy("shard", "_bucket").orderBy("doc_id", "text_crc32", "size")
    out = salted.withColumn("_in", F.row_number().over(inside) - 1).join(firsts, ["shard", "_bucket"])
    return out.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("_first") + F.col("_in")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op5_minimax_sharding(spark, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir))
