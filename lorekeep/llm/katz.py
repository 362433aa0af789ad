"""Scoring texts by a Katz backoff bigram model, learned from the same table.

P(w | v) is d(c) * c(v, w) / (c(v) + h), with Good-Turing discounts d, if the pair (v, w) was seen,
else alpha(v) * P(w); alpha(v) hands exactly the mass that is left to the words not seen after v, so
each P(. | v) sums to one over the V known words and one class of unknown ones. The discounts free
that mass and h is 0, as in Katz's formula; only where none of v's pairs is discounted (all counts
above K), and in contexts split over slices (see below), h sets half a count aside. P(w) is
Good-Turing discounted as well; the freed mass is the unknown class's. Counts above K are not
discounted. Where counts of counts give no usable discount, (r - 0.5) / r takes its place; if no
count is small at all, unigrams fall back to (c + 0.5) / (N + 0.5 (V + 1)).

Nothing is held whole anywhere. Documents are read once, into blocks: a table of token streams, and
one of the blocks' word lists, which goes when words are counted. Words go to slices by hash, which count them and answer each block with
the counts it asked for. Pairs go to slices by their first word, with the documents that hold them;
a first word that makes up a large share of all tokens is split by its second word. A slice counts
its pairs, knows its contexts whole (a split context's sums are put together in a table that has at
most 4 rows a slice), and leaves for each block a compact record of terms, in which only the discounts
are open. Those follow from the counts of counts of all slices, and a last pass adds up each text's
terms. Counts, slices and tables grow with the input; a slice's size does not.

Words are told apart by 64-bit hashes. With its count, a word's slice gives it a number, small for
frequent words; pairs and contexts travel by these numbers, as bytes of equal weight side by side,
which compress well. Pairs are told apart by mixing two numbers.

Edge cases: a null text is an empty one (one token: its end); a null doc_id counts as the text
"null"-less empty string for the training split; an empty training set makes every word unknown;
repeated rows are scored and counted each; other columns are ignored.
"""

from __future__ import annotations


import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, WordHashes, documents, dropped, release_shuffles, scratch_path, slices_for, trim, written

FOLDS, HELD_OUT = 5, 1
#: Counts up to K are discounted.
K = 5
#: Set aside in contexts all of whose counts are above K, where discounting frees nothing, and in split ones.
HALF = 0.5
BLOCK_TOKENS = 1_000_000
_U = np.uint64
#: The key of a text's end, which is a token; the number of its start, which is only a context and above all words' numbers.
END_KEY, START = _U(0x656E64), _U(1 << 56)


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def share_of(tokens: int, slices: int) -> float:
    """A context above this many tokens is split."""
    return max(2.0, tokens / (4 * slices))


def aside(small: np.ndarray, split: np.ndarray) -> np.ndarray:
    """h of contexts, from how many of their pairs are discounted (by count 1..K) and whether they are split."""
    return np.where(split | (small.sum(axis=1) == 0), HALF, 0.0)


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % FOLDS == HELD_OUT


def good_turing(of_count: list[int], k: int = K) -> list[float]:
    """Discounts d_1..d_k from counts of counts n_1..n_(k+1); each lies in (0, 1)."""
    n = [0, *of_count]
    out = []
    tail = (k + 1) * n[k + 1] / n[1] if n[1] else 0.0
    for r in range(1, k + 1):
        d = -1.0
        if n[r] and n[r + 1] and tail < 1:
            d = ((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail)
        out.append(d if 0 < d < 1 else (r - 0.5) / r)
    return out


class Unigrams:
    """log10 P(w) from a count; 0 stands for an unknown word."""

    def __init__(self, tokens: int, types: int, of_count: list[int]):
        self.n, self.v = tokens, types
        d = good_turing(of_count)
        lost = sum(r * m * (1 - x) for r, m, x in zip(range(1, K + 1), of_count, d))
        self.plain = not tokens or lost <= 0
        self.d = np.array([*d, 1.0])
        self.unknown = lost / tokens if not self.plain else 0.5 / (tokens + 0.5 * (types + 1))

    def p(self, c: np.ndarray) -> np.ndarray:
        c = np.asarray(c, np.float64)
        if self.plain:
            return (c + 0.5) / (self.n + 0.5 * (self.v + 1))
        d = self.d[np.clip(c.astype(np.int64) - 1, 0, K)]
        return np.where(c > 0, d * c / self.n, self.unknown)


def _pack(packer, *arrays: np.ndarray) -> bytes:
    """Arrays as one blob: first bytes of all values, then their second bytes, and so on."""
    head = np.array([len(a) for a in arrays], np.int64)
    return packer.compress(head.tobytes() + b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays))


def _open(opener, blob: bytes, *kinds) -> list[np.ndarray]:
    raw = opener.decompress(blob, max_output_size=2**31 - 1)
    head = np.frombuffer(raw, np.int64, len(kinds))
    at, out = 8 * len(kinds), []
    for n, kind in zip(head.tolist(), kinds):
        width = np.dtype(kind).itemsize
        planes = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(n))
        at += n * width
    return out


# ---------------------------------------------------------------- 1: blocks of tokens
_BLOCK = "kind int, block string, blob binary"
_STREAM = (np.int64, np.uint8, np.uint32, np.uint32, np.uint32)  # doc ids (2**63-1: null), held out, tokens a doc, slices of words, stream


def tokenised(docs: DataFrame, slices: int) -> DataFrame:
    """Blocks of documents: ids and token stream (kind 0), words and their training counts (kind 1). Written at once, so a block's name holds."""

    def run(batches):
        import uuid

        import pyarrow as pa
        import zstandard

        hashes, packer = WordHashes(), zstandard.ZstdCompressor(level=3)
        end = END_KEY.tobytes()
        ids, held, sizes, streams, n = [], [], [], [], 0

        def block():
            keys, at, often = np.unique(np.concatenate(streams), return_inverse=True, return_counts=True)
            order = np.argsort(-often, kind="stable")
            place = np.empty(len(keys), np.uint32)
            place[order] = np.arange(len(keys), dtype=np.uint32)
            keys, stream, out = keys[order], place[at], np.array(held, np.uint8)
            count = np.bincount(stream[np.repeat(out == 0, sizes)], minlength=len(keys)).astype(np.uint32)
            to = (mix(keys) % _U(slices)).astype(np.uint32)
            blobs = [_pack(packer, np.array(ids, np.int64), out, np.array(sizes, np.uint32), to, stream), _pack(packer, keys, count)]
            return pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array([uuid.uuid4().hex] * 2), pa.array(blobs, pa.binary())], ["kind", "block", "blob"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                w = (text.as_py() or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
                s = np.frombuffer(b"".join(map(hashes.__getitem__, w)) + end, np.uint64)
                ids.append(2**63 - 1 if doc is None else doc)
                held.append(held_out(doc))
                sizes.append(len(s))
                streams.append(s)
                n += len(s)
                if n >= BLOCK_TOKENS or len(ids) >= 65_000:
                    yield block()
                    ids, held, sizes, streams, n = [], [], [], [], 0
        if ids:
            yield block()

    return docs.mapInArrow(run, _BLOCK)


# ---------------------------------------------------------------- 2: word counts
def _stats_cols(prefix: str = "n") -> list[str]:
    return [f"{prefix}{r}" for r in range(1, K + 2)]


def word_counts(blocks: DataFrame, slices: int) -> DataFrame:
    """Answers (block, slice, blob of the counts and numbers of the block's words in that slice) and one row of statistics a slice."""

    def ask(batches):
        import pyarrow as pa
        import zstandard

        packer, opener = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
        for batch in batches:
            for name, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                keys, count = _open(opener, blob.as_py(), np.uint64, np.uint32)
                to = mix(keys) % _U(slices)
                out = [[], [], []]
                for k in range(slices):
                    mine = to == k
                    if mine.any():
                        for col, v in zip(out, (k, name, _pack(packer, keys[mine], count[mine]))):
                            col.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1]), pa.array(out[2], pa.binary())], ["slice", "block", "blob"])

    def answer(table):
        import pyarrow as pa
        import zstandard

        trim()
        packer, opener = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
        asked = [_open(opener, b.as_py(), np.uint64, np.uint32) for b in table.column("blob")]
        keys, at = np.unique(np.concatenate([k for k, _ in asked]), return_inverse=True)
        count = np.bincount(at, np.concatenate([c for _, c in asked]), len(keys)).astype(np.int64)
        of = np.bincount(np.minimum(count[count > 0], K + 2), minlength=K + 3)
        slice_ = table.column("slice")[0].as_py()
        number = np.empty(len(keys), np.uint64)
        number[np.lexsort((keys, -count))] = np.arange(len(keys), dtype=np.uint64) * _U(slices) + _U(slice_)
        names, blobs, pos = table.column("block").to_pylist(), [], 0
        for k, _ in asked:
            mine = at[pos : pos + len(k)]
            blobs.append(_pack(packer, count[mine].astype(np.uint64), number[mine]))
            pos += len(k)
        rows = [(n, slice_, b, None) for n, b in zip(names, blobs)]
        rows.append((None, slice_, None, [int(count.sum()), int((count > 0).sum()), *(int(x) for x in of[1 : K + 2])]))
        kinds = [pa.string(), pa.int32(), pa.binary(), pa.list_(pa.int64())]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["block", "slice", "blob", "stats"])

    asks = blocks.select("block", "blob").mapInArrow(ask, "slice int, block string, blob binary")
    return asks.groupBy("slice").applyInArrow(answer, "block string, slice int, blob binary, stats array<bigint>")


# ---------------------------------------------------------------- 3: pairs to slices
_PAIRS = (np.uint64, np.uint64, np.uint64, np.uint64, np.uint32, np.uint32, np.uint32, np.uint32)
# first words' numbers as differences, second words' numbers, their counts, training count in the block, entries, then entries: document, how often
_TERMS = "kind int, slice int, block string, blob binary, stats array<bigint>"


def pairs_of(blocks: DataFrame, answers: DataFrame, words: Unigrams, train_docs: int, slices: int) -> DataFrame:
    """From each block and its answers: rows of documents (kind 0) and pairs by slice (kind 1)."""
    share = share_of(words.n, slices)

    def run(table):
        import pyarrow as pa
        import zstandard

        trim()
        packer, opener = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
        got = {s: b for s, b in zip(table.column("slice").to_pylist(), table.column("blob").to_pylist())}
        name = table.column("block")[0].as_py()
        ids, held, sizes, to, stream = _open(opener, got.pop(-1), *_STREAM)
        count, number = np.zeros(len(to), np.uint64), np.zeros(len(to), np.uint64)
        for s, b in got.items():
            count[to == s], number[to == s] = _open(opener, b, np.uint64, np.uint64)
        order = np.argsort(number)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        count, number, stream = count[order], number[order], place[stream]
        doc = np.repeat(np.arange(len(ids)), sizes)
        c = count[stream]
        base = np.log10((c + 0.5) / (words.n + 0.5 * (words.v + 1)))
        n_docs = len(ids)
        stats = [ids, held, sizes, np.bincount(doc, c > 0, n_docs).astype(np.uint32), np.bincount(doc, base, n_docs)]
        rows = [(0, -1, name, _pack(packer, *stats), None)]
        starts = np.cumsum(sizes) - sizes
        second = stream
        first = np.empty_like(second)
        first[1:] = second[:-1]
        first[starts[sizes > 0]] = len(number)  # the start of a text
        # entries (pair, document) with how often, in order of the pair
        pair = first * (len(number) + 1) + second
        order = np.lexsort((doc, pair))
        p, d = pair[order], doc[order]
        new = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (d[1:] != d[:-1])])
        often = np.diff(np.r_[new, len(p)]).astype(np.uint32)
        p, d = p[new], d[new]
        heads = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
        entries = np.diff(np.r_[heads, len(p)]).astype(np.uint32)
        trained = np.add.reduceat(np.where(held[d] == 0, often, 0), heads).astype(np.uint32)
        all_numbers = np.r_[number, START]
        all_count = np.r_[count, _U(train_docs)]
        i1, i2 = p[heads] // (len(number) + 1), p[heads] % (len(number) + 1)
        k1, k2, c1, c2 = all_numbers[i1], all_numbers[i2], all_count[i1], all_count[i2]
        with np.errstate(over="ignore"):
            parts_ = np.maximum(1, np.ceil(c1 / share)).astype(np.uint64)  # as many as its share asks for
            to = (mix(mix(k1) + np.where(c1 > share, mix(k2) % parts_, 0).astype(np.uint64) * _U(0x9E3779B97F4A7C15)) % _U(slices)).astype(np.int64)
        entry_to = np.repeat(to, entries)
        by, by_entry = np.argsort(to, kind="stable"), np.argsort(entry_to, kind="stable")
        at, at_entry = np.searchsorted(to[by], np.arange(slices + 1)), np.searchsorted(entry_to[by_entry], np.arange(slices + 1))
        for s in range(slices):
            m, e = by[at[s] : at[s + 1]], by_entry[at_entry[s] : at_entry[s + 1]]
            if len(m):
                rows.append((1, s, name, _pack(packer, np.diff(k1[m], prepend=_U(0)), k2[m], c1[m], c2[m], trained[m], entries[m], d[e].astype(np.uint32), often[e]), None))
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.list_(pa.int64())]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["kind", "slice", "block", "blob", "stats"])

    both = blocks.select("block", F.lit(-1).alias("slice"), "blob").unionByName(answers.select("block", "slice", "blob"))
    return both.groupBy("block").applyInArrow(run, _TERMS)


_RECORD = (np.uint32, np.float64, np.uint32, np.uint64, np.float64, np.uint64, np.uint32, np.uint32, np.uint32)
# documents, their fixed sums, counts of discounts 1..K (K a document); contexts: key, mass seen below, count; of each: kinds 1..K (K a context); open entries: document index and context index packed below


def terms_of(pairs: DataFrame, words: Unigrams, slices: int) -> DataFrame:
    """Counts the pairs of a slice. Leaves records (kind 1), rows of documents as they are (kind 0), sums of split contexts (kind 2) and statistics (kind 3)."""
    share = share_of(words.n, slices)

    def run(table):
        import pyarrow as pa
        import zstandard

        trim()
        packer, opener = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.list_(pa.int64())]
        names = ["kind", "slice", "block", "blob", "stats"]
        if table.column("kind")[0].as_py() == 0:
            return table.select(names)
        slice_ = table.column("slice")[0].as_py()
        blocks = table.column("block").to_pylist()
        got = [_open(opener, b.as_py(), *_PAIRS) for b in table.column("blob")]
        for g in got:
            g[0] = np.cumsum(g[0], dtype=np.uint64)
        k1, k2, c1, c2, trained = (np.concatenate([g[i] for g in got]) for i in range(5))
        for g in got:  # whole columns are held now
            g[0] = g[1] = g[4] = None
        with np.errstate(over="ignore"):
            key = mix(k1 + mix(k2) * _U(0x9E3779B97F4A7C15))
        _, one, at = np.unique(key, return_index=True, return_inverse=True)
        total = np.bincount(at, trained, len(one)).astype(np.int64)
        of = np.bincount(np.minimum(total[total > 0], K + 2), minlength=K + 3)
        # what each context has seen: kinds by count 1..K, and the lower model's mass
        contexts, ctx = np.unique(k1[one], return_inverse=True)
        seen = total > 0
        lower = words.p(c2[one])
        mass = np.bincount(ctx, np.where(seen, lower, 0.0), len(contexts))
        small = np.stack([np.bincount(ctx, total == r, len(contexts)) for r in range(1, K + 1)], axis=1).astype(np.uint32)
        c_ctx = np.zeros(len(contexts), np.uint64)
        c_ctx[ctx] = c1[one]
        rows = [(3, slice_, None, None, [int(x) for x in of[1 : K + 2]])]
        split = c_ctx > share
        half = aside(small, split)
        if split.any():
            rows.append((2, slice_, None, _pack(packer, contexts[split], mass[split], small[split].ravel()), None))
        pos = 0
        for name, g in zip(blocks, got):
            n = len(g[2])
            mine = at[pos : pos + n]
            pos += n
            entry = np.repeat(np.arange(n), g[5])
            d, often = g[6].astype(np.int64), g[7].astype(np.int64)
            docs, dd = np.unique(d, return_inverse=True)
            t, a, b = total[mine][entry], g[2].astype(np.float64)[entry], g[3][entry]
            known = t > 0
            with np.errstate(divide="ignore"):
                fixed = np.where(known, np.log10(np.where(known, t, 1) / np.where(known, a + half[ctx[mine]][entry], 1)), np.log10(words.p(b)))
            sums = np.bincount(dd, fixed * often, len(docs))
            hist = np.stack([np.bincount(dd, np.where(t == r, often, 0), len(docs)) for r in range(1, K + 1)], axis=1).astype(np.uint32)
            open_ = ~known & (a > 0)
            own, oi = np.unique(ctx[mine][entry][open_], return_inverse=True)
            rows.append((1, slice_, name, _pack(packer, docs.astype(np.uint32), sums, hist.ravel(), contexts[own], mass[own], c_ctx[own], small[own].ravel(), dd[open_].astype(np.uint32), np.stack([oi, often[open_]], axis=1).astype(np.uint32).ravel()), None))
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    keyed = pairs.withColumn("_to", F.when(F.col("kind") == 0, F.concat(F.lit("d"), F.col("block"))).otherwise(F.col("slice").cast("string")))
    return keyed.groupBy("_to").applyInArrow(run, _TERMS)


# ---------------------------------------------------------------- 4: scores
_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scores_of(terms: DataFrame, words: Unigrams, discounts: list[float], split: dict[int, tuple]) -> DataFrame:
    d = np.array(discounts)
    gaps = np.array([r * (1 - x) for r, x in zip(range(1, K + 1), d)])
    logs = np.log10(d)
    spread = terms.sparkSession.sparkContext.broadcast(split)  # at most 4 contexts a slice

    def run(table):
        import pyarrow as pa
        import zstandard

        opener = zstandard.ZstdDecompressor()
        kinds, blobs = table.column("kind").to_pylist(), table.column("blob").to_pylist()
        ids, held, sizes, known, base = _open(opener, blobs[kinds.index(0)], np.int64, np.uint8, np.uint32, np.uint32, np.float64)
        score = np.zeros(len(ids))
        for kind, blob in zip(kinds, blobs):
            if kind != 1:
                continue
            docs, sums, hist, keys, mass, count, small, who, entry = _open(opener, blob, *_RECORD)
            score[docs] += sums + hist.reshape(-1, K) @ logs
            if len(who):
                small, mass = small.reshape(-1, K).astype(np.float64), mass.copy()
                parted = np.zeros(len(keys), bool)
                for i, key in enumerate(keys.tolist()):
                    if key in spread.value:
                        mass[i], small[i] = spread.value[key]
                        parted[i] = True
                h = aside(small, parted)
                freed = (small @ gaps + h) / (count + h)
                alpha = np.log10(freed) - np.log10(np.maximum(1 - mass, 1e-300))
                e = entry.reshape(-1, 2)
                np.add.at(score, docs[who], alpha[e[:, 0]] * e[:, 1])
        n = len(ids)
        return pa.table(
            [pa.array(ids, mask=ids == 2**63 - 1), pa.array(held == 1), pa.array(sizes.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(np.full(n, words.n, np.int64)), pa.array(base), pa.array(score)],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    return terms.where("kind < 2").groupBy("block").applyInArrow(run, _SCORED)


def katz_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs."""
    import zstandard

    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    if not rows:
        return spark.createDataFrame([], _SCORED)
    word_slices, slices = slices_for(size, 64 << 20, 48), slices_for(size, 12 << 20)
    path = scratch_path(spark, "blocks")
    tokenised(docs, word_slices).write.partitionBy("kind").parquet(path)
    blocks, lists = (spark.read.schema("block string, blob binary").parquet(f"{path}/kind={k}") for k in (0, 1))
    answers = written(word_counts(lists, word_slices), "word-counts")
    dropped(spark, f"{path}/kind=1")
    release_shuffles(spark)
    totals = [sum(c) for c in zip(*(r[0] for r in answers.where("stats is not null").select("stats").collect()))]  # one row a slice
    words = Unigrams(totals[0], totals[1], totals[2:])
    ids = docs.select(F.pmod(F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")), F.lit(FOLDS)).alias("fold"))
    train_docs = ids.where(F.col("fold") != HELD_OUT).count()
    pairs = pairs_of(blocks, answers.where("block is not null"), words, train_docs, slices)
    terms = written(terms_of(pairs, words, slices), "terms")
    release_shuffles(spark)
    found = [r[0] for r in terms.where("kind = 3").select("stats").collect()]  # one row a slice
    discounts = good_turing([sum(c) for c in zip(*found)] if found else [0] * (K + 1))
    split: dict[int, tuple] = {}
    opener = zstandard.ZstdDecompressor()
    for r in terms.where("kind = 2").select("blob").toLocalIterator():  # at most 4 contexts a slice, in parts
        keys, mass, small = _open(opener, bytes(r[0]), np.uint64, np.float64, np.uint32)
        for k, m, s in zip(keys.tolist(), mass.tolist(), small.reshape(-1, K).astype(np.float64)):
            old = split.get(k, (0.0, np.zeros(K)))
            split[k] = (old[0] + m, old[1] + s)
    return scores_of(terms, words, discounts, split)


def op9_katz_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz_scores(documents(spark, sf_dir))


