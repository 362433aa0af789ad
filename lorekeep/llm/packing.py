"""Best-fit packing with Martello-Toth dominance reduction.

The plan is made on the histogram of piece lengths, which has at most `capacity` rows whatever the
corpus: `dominance` permanently fixes sets that provably dominate every other filling of a bin, and
`best_fit` packs what is left, longest first, each into the fullest bin that takes it. Both work on
(length, how many), so the driver's work and memory depend on the capacity alone. Pieces then find
their place by their rank among the pieces of the same length; ranks come from salted buckets, so a
length shared by a third of all rows is no hot key.

Edge cases: a null text is an empty one; an empty document is one piece of the single end id; an
empty table gives an empty result; repeated rows are packed once each; other columns are ignored.
"""

from __future__ import annotations

import os
import re
from bisect import bisect_left
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, slices_for, written

CAPACITY = 2048


# ---------------------------------------------------------------- the plan, on the histogram
class _Stock:
    """How many pieces of each length are left, with the lengths in order."""

    def __init__(self, counts: dict[int, int]):
        self.n = {s: c for s, c in counts.items() if c > 0}
        self.sizes = sorted(self.n)

    def take(self, s: int, k: int) -> None:
        self.n[s] -= k
        if not self.n[s]:
            del self.n[s]
            del self.sizes[bisect_left(self.sizes, s)]

    def largest(self, most: int, used: dict[int, int] = {}) -> int:  # noqa: B006
        """The largest length <= most of which more than `used` are left; 0 if none."""
        i = bisect_left(self.sizes, most + 1) - 1
        while i >= 0 and self.n[self.sizes[i]] <= used.get(self.sizes[i], 0):
            i -= 1
        return self.sizes[i] if i >= 0 else 0

    def smallest(self, k: int, used: dict[int, int]) -> list[int]:
        """The k smallest pieces that are left beside `used`."""
        out: list[int] = []
        for s in self.sizes:
            free = self.n[s] - used.get(s, 0)
            out += [s] * min(free, k - len(out))
            if len(out) >= k:
                break
        return out


def _best_pair(stock: _Stock, j: int, room: int) -> tuple[int, int]:
    """Two lengths a >= b beside j with the largest a + b <= room."""
    best = (0, 0)
    for b in stock.sizes:
        if 2 * b > room:
            break
        used = Counter((j, b))
        if stock.n[b] < used[b]:
            continue
        a = stock.largest(room - b, used)
        if a >= b and a + b > sum(best):
            best = (a, b)
    return best


def _beaten(stock: _Stock, room: int, a: int, b: int) -> bool:
    """True if {a, b} dominates every pair c >= d that fits: c <= a and d <= b, or c + d <= a."""
    i = bisect_left(stock.sizes, b + 1)
    while i < len(stock.sizes) and 2 * stock.sizes[i] <= room:
        d = stock.sizes[i]
        c = stock.largest(room - d)
        if c >= d and c + d > a:
            return False
        i += 1
    return True


def dominance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[dict[int, int], int]], dict[int, int]]:
    """Fixes dominating sets. Returns [(lengths of a bin, how many such bins)] and the remaining counts.

    For the longest piece j with room = capacity - j: alone, if nothing fits beside it; with the one
    piece that fills the room exactly; with the largest that fits, if no two fit; with the largest
    that fits or with the best two, where these dominate all pairs and no three fit. Each step keeps
    an optimal packing reachable (Martello and Toth 1990); a step is taken for as many equal bins at
    once as the counts allow without changing its premises. A length without such a step is passed over
    and stays among the pieces for shorter ones.
    """
    stock, fixed = _Stock(counts), []
    for s in list(stock.sizes):  # exact pairs dominate whatever else is there
        t = capacity - s
        if s < t and s in stock.n and t in stock.n:
            k = min(stock.n[s], stock.n[t])
            fixed.append(({t: 1, s: 1}, k))
            stock.take(s, k)
            stock.take(t, k)
        elif s == t and stock.n.get(s, 0) > 1:
            k = stock.n[s] // 2
            fixed.append(({s: 2}, k))
            stock.take(s, 2 * k)
    below = capacity + 1  # no set is known to dominate for the lengths from here on: they still go with shorter ones, or are left for best fit
    while i := bisect_left(stock.sizes, below):
        j = stock.sizes[i - 1]
        room = capacity - j
        few = stock.smallest(3, {j: 1})
        one = stock.largest(room, {j: 1})
        k = stock.n[j]
        if not one:
            if few and few[0] <= room:  # cannot happen: the smallest fits but none was found
                raise AssertionError("inconsistent stock")
            fixed.append(({j: 1}, k if not few or j > room else 1))
            stock.take(j, fixed[-1][1])
            continue
        chosen: list[int] = []
        if one == room or len(few) < 2 or few[0] + few[1] > room:
            chosen = [one]
        elif len(few) < 3 or sum(few) > room:
            a, b = _best_pair(stock, j, room)
            if one >= a + b:
                chosen = [one]
            elif a and _beaten(stock, room, a, b) and a >= one:
                chosen = [a, b]
        if not chosen:
            below = j
            continue
        need: dict[int, int] = {j: 1}
        for x in chosen:
            need[x] = need.get(x, 0) + 1
        # equal bins at once, while each chosen length outlasts them
        times = max(1, min(stock.n[x] // c for x, c in need.items()) - 2)
        fixed.append((need, times))
        for x, c in need.items():
            stock.take(x, c * times)
    return fixed, stock.n


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Best fit, longest first, on counts: equal pieces and equal bins move together."""
    open_bins: dict[int, list[list]] = {}  # room left -> [[lengths, how many bins]]
    rooms: list[int] = []
    done: list[tuple[dict[int, int], int]] = []

    def put(room: int, lengths: dict[int, int], n: int) -> None:
        if n <= 0:
            return
        if not room:
            done.append((lengths, n))
            return
        if room not in open_bins:
            open_bins[room] = []
            rooms.insert(bisect_left(rooms, room), room)
        open_bins[room].append([lengths, n])

    for s in sorted((s for s, c in counts.items() if c > 0), reverse=True):
        left = counts[s]
        while left:
            i = bisect_left(rooms, s)
            if i == len(rooms):
                per = capacity // s
                full, rest = divmod(left, per)
                put(capacity - per * s, {s: per}, full)
                if rest:
                    put(capacity - rest * s, {s: rest}, 1)
                break
            room = rooms[i]
            lengths, n = open_bins[room][-1]
            fit = room // s  # the fullest bin stays the fullest that fits until it can take no more
            use = min(n, max(1, left // fit)) if left >= fit else 1
            each = fit if left >= fit else left
            open_bins[room][-1][1] -= use
            if not open_bins[room][-1][1]:
                open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room]
                    rooms.pop(i)
            put(room - each * s, lengths | {s: lengths.get(s, 0) + each}, use)
            left -= each * use
    for groups in open_bins.values():
        done += [(lengths, n) for lengths, n in groups]
    return done


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """[(lengths of a bin, how many such bins)]: the dominating sets, then best fit for the remainder."""
    fixed, rest = dominance(counts, capacity)
    return fixed + best_fit(rest, capacity)


def places(bins: list[tuple[dict[int, int], int]]) -> np.ndarray:
    """Rows (length, first rank, how many per bin, first bin number, offset in the bin), ordered by length and rank."""
    rows, seen, first = [], {}, 0
    for lengths, n in bins:
        offset = 0
        for s, q in sorted(lengths.items(), reverse=True):
            rows.append((s, seen.get(s, 0), q, first, offset))
            seen[s] = seen.get(s, 0) + q * n
            offset += q * s
        first += n
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


# ---------------------------------------------------------------- tokens
#: Letters for which NFC and lower-casing are a look-up; other chunks take the tokenizer's whole road.
_PLAIN = re.compile("[a-zà-öø-ÿ]+")
_MARKS = b".,;:!?"


def _byte_letters() -> dict[int, int]:
    """Byte -> character in byte-level vocabularies: printable ones stand for themselves, the rest follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: b for b in shown} | {b: 256 + i for i, b in enumerate(rest)}


class _Encoder(dict):
    """chunk without white space -> its ids as little-endian unsigned 32-bit bytes.

    The tokenizer drops white space and never merges across it, so a text's ids are those of its
    chunks in a row. Within a chunk it splits letters from marks, so marks after a letter are
    taken off first, and plain words go straight to the tokenizer's merge model. The memory is
    emptied at a size bound.
    """

    BOUND = 600_000

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.letters = _byte_letters()

    def whole(self, chunk: str) -> bytes:
        return np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __missing__(self, chunk: bytes) -> bytes:
        text = chunk.decode("utf-8")
        low = text.lower()
        if chunk[-1] in _MARKS and _PLAIN.fullmatch(low, 0, len(low) - 1):
            out = self[chunk[:-1]] + self[chunk[-1:]]
        elif _PLAIN.fullmatch(low):
            out = b"".join(x.id.to_bytes(4, "little") for x in self.merge(low.encode().decode("latin-1").translate(self.letters)))
        else:
            out = self.whole(text)
        if len(chunk) <= 64:
            if len(self) >= self.BOUND:
                self.clear()
            self[chunk] = out
        return out

    def encode(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, (text or "").encode("utf-8", "replace").split()))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def tokenize_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids (binary, little-endian unsigned 32-bit)."""
    path = path or tokenizer_path()
    step = 4 * capacity
    end = int(end_id).to_bytes(4, "little")

    def cut(batches):
        import pyarrow as pa

        encoder = _Encoder(path)
        names = ["doc_id", "piece", "start", "length", "ids"]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        rows, held = [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encoder.encode(text.as_py()) + end
                for k in range(0, len(ids), step):
                    part = ids[k : k + step]
                    rows.append((doc, k // step, k // 4, len(part) // 4, part))
                    held += len(part) + 40
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids binary")


# ---------------------------------------------------------------- placement
def pack(pieces: DataFrame, capacity: int = CAPACITY, length: str = "length", salt: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """The pieces with sequence_id and offset. `pieces` should be a written table: it is read twice.

    Ranks among equal lengths: rows are counted by (length, bucket), a running sum over the buckets
    gives each its first rank, and row_number counts on inside a bucket. Buckets grow with the rows.
    """
    spark = pieces.sparkSession
    total = pieces.count()
    buckets = slices_for(total, 100_000, 256)
    rows = pieces.withColumn("_bucket", F.pmod(F.xxhash64(*salt), F.lit(buckets)).cast("int"))
    sums = rows.groupBy(length, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    counts = {int(r[0]): int(r[1]) for r in sums.groupBy(length).agg(F.sum("_n")).collect()}  # at most `capacity` rows
    table = places(plan(counts, capacity))
    before = Window.partitionBy(length).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sums.withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(length, "_bucket").orderBy(*salt)
    ranked = rows.withColumn("_in", F.row_number().over(inside) - 1).join(firsts, [length, "_bucket"])
    ranked = ranked.withColumn("_rank", (F.col("_first") + F.col("_in")).cast("long")).drop("_first", "_in", "_bucket")
    names = ranked.columns
    held = spark.sparkContext.broadcast(table)  # bounded by the capacity, not by the corpus

    def place(batches):
        import pyarrow as pa

        t = held.value
        top = int(t[:, 1].max()) + 1 if len(t) else 1
        keys = t[:, 0] * top + t[:, 1] if len(t) else np.zeros(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            size = batch.column(names.index(length)).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column(names.index("_rank")).to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.searchsorted(keys, size * top + np.minimum(rank, top - 1), side="right") - 1
            row = t[at]
            k = rank - row[:, 1]
            cols = [batch.column(i) for i, n in enumerate(names) if n != "_rank"]
            cols += [pa.array(row[:, 3] + k // row[:, 2]), pa.array(row[:, 4] + (k % row[:, 2]) * size)]
            yield pa.RecordBatch.from_arrays(cols, [n for n in names if n != "_rank"] + ["sequence_id", "offset"])

    schema = T.StructType([f for f in ranked.schema.fields if f.name != "_rank"] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(place, schema)


def packed_documents(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """Placement of every piece with a digest of its ids."""
    pieces = tokenize_pieces(docs, path, capacity)
    narrow = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(written(narrow, "pieces"), capacity)


def sequences(pieces: DataFrame, placed: DataFrame, keys: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """The sequences themselves: sequence_id, ids (binary). A sequence has `capacity` ids at most."""
    joined = pieces.join(placed.select(*keys, "sequence_id", "offset"), list(keys))
    gathered = joined.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("_p"))
    return gathered.select("sequence_id", F.expr("aggregate(_p, cast('' as binary), (s, x) -> concat(s, x.ids))").alias("ids"))


def op1_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return packed_documents(documents(spark, sf_dir))

