"""N-gram Jaccard join with PartEnum signatures.

Two sets of sizes a and b with 100 * intersection >= 75 * union differ in at most d = (a + b) / 7
features. Sizes fall into bands [2^c, 2^(c+1)); a set signs for its own band, and for the next one if
a partner may lie there. In a band the feature domain is cut into n1 partitions by hash, n1 above the
band's largest d, and subsets of partitions are enumerated; a signature is the part of the set that
falls into the subset. In bands where d is at most FULL, all subsets of n1 - d partitions are taken. In
larger bands subsets are single partitions (the corner of the family with the fewest signatures): at
least n1 - d of them agree, so it is enough that each set hands out the d + 1 best of them in one
order that both sets share: parts with more rare features first, empty parts last. So every similar
pair shares a signature, whatever the texts.

Equal sets are one member. The work goes in three turns, each confirmed by whole texts:

1. The HEADS first signatures of a set meet by themselves, each group as a star around its smallest
   id. This finds most links of near copies at little cost, so that a cluster is one component before
   its members meet again under all their signatures.
2. All signatures, dealt into slices. A group whose members are one component by now is done; small
   groups give their pairs across components, large ones a star around two members of their main
   component, and their member list.
3. Large groups that still lie in several components. Groups with one main component are put together
   where that means fewer comparisons than they need apart (near-copy clusters meet under a hundred
   signatures). Members outside the main component meet all others in cells of bounded size.

Pairs of turns 1 and 2 are sieved by the parity of features in bins (bins of unlike parity bound the
differences from below), cells of turn 3 by bitmaps of 8 to 16 bins a feature. Both only rule out what
cannot be linked. No link is capped, dropped or sampled away; pairs within a component are not listed.

Edge cases: null texts and texts without words have empty sets, n_shingles 0, and link with nothing;
texts of fewer than `words` words have one shingle; repeated rows of one doc_id are one document; a
null doc_id takes part with its text's class but is nobody's smallest id; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, WordHashes, documents, dropped, parts, release_shuffles, scratch_path, slices_for, trim, written

WORDS = 5
PERCENT = 75
#: Largest d of a band for which all subsets of partitions are enumerated.
FULL = 2
#: Signatures of a set that meet in the first turn.
HEADS = 4
#: Signatures that a task gathers before it hands them out to the slices.
BLOCK_SIGS = 2_000_000
#: Groups up to SMALL members give their pairs at once. A star's cell has about CHUNK texts, a cell of bitmaps about CELL members a
#: side, a row of members LIST at most.
SMALL, CHUNK, CELL, LIST = 8, 64, 128, 4096
#: Features in so many of a sample of SAMPLE_ROWS short texts count as common when signatures are ordered. All sets use one
#: list, so any list is correct; the sample only decides how selective the signatures are that come first.
COMMON, SAMPLE_ROWS, SAMPLE_CHARS = 3, 3000, 16_384

_U = np.uint64
_M1, _M2, _M3 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _M2
        x = (x ^ (x >> _U(27))) * _M3
        return x ^ (x >> _U(31))


def shingles(text: str | None, hashes: WordHashes, words: int = WORDS) -> np.ndarray:
    """The sorted distinct 64-bit shingles of a text."""
    w = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not w:
        return np.zeros(0, np.uint64)
    a = np.frombuffer(b"".join(map(hashes.__getitem__, w)), dtype="<u8")
    n = max(1, len(a) - words + 1)
    with np.errstate(over="ignore"):
        s = np.full(n, min(words, len(a)), dtype=np.uint64)
        for j in range(min(words, len(a))):
            s = (s ^ a[j : j + n]) * _M1
            s ^= s >> _U(29)
    s = mix(s)
    s.sort()
    return s[np.r_[True, s[1:] != s[:-1]]]


def set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits of the whole set."""
    import xxhash

    x = xxhash.xxh3_128_intdigest(s.tobytes())
    return x >> 64, x & (2**64 - 1)


def most_apart(a: int, b: int, percent: int = PERCENT) -> int:
    """The largest size of the symmetric difference of linked sets of sizes a and b."""
    return (100 - percent) * (a + b) // (100 + percent)


def partner_max(a: int, percent: int = PERCENT) -> int:
    return 100 * a // percent


def bands(a: int, percent: int = PERCENT) -> list[tuple[int, int, int]]:
    """(band, its number of partitions, most differences to a partner there) for a set of size a."""
    own, out = a.bit_length() - 1, []
    widest = partner_max(a, percent)
    for c in range(own, widest.bit_length()):
        top = (1 << (c + 1)) - 1
        k_band = most_apart(top, top, percent)
        n1 = k_band + 2 if k_band <= FULL else k_band + k_band // 4 + 2
        out.append((c, n1, most_apart(a, min(widest, top), percent)))
    return out


def signatures(s: np.ndarray, common: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The PartEnum signatures of a set; `common` flags its features that many sets share."""
    return np.concatenate(by_band(s, common, percent))


def by_band(s: np.ndarray, common: np.ndarray, percent: int = PERCENT) -> list[np.ndarray]:
    """The signatures for each band of bands(), the set's own first."""
    from itertools import combinations

    out = []
    with np.errstate(over="ignore"):
        h = mix(s + _M1)
        for c, n1, k in bands(len(s), percent):
            part = (mix(s ^ _U((c * 2 + 1) * 0x5851F42D4C957F2D & (2**64 - 1))) % _U(n1)).astype(np.int64)
            k_band = most_apart((1 << (c + 1)) - 1, (1 << (c + 1)) - 1, percent)
            if k_band <= FULL:
                sums = np.zeros(n1, np.uint64)
                np.add.at(sums, part, h)
                kept = np.array(list(combinations(range(n1), n1 - k_band)), np.int64)
                out.append(mix(sums[kept].sum(axis=1, dtype=np.uint64) + (_U(c * 65536) + np.arange(len(kept), dtype=np.uint64)) * _M2))
                continue
            order = np.argsort(part, kind="stable")
            p = part[order]
            first = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
            sums = np.add.reduceat(h[order], first)
            rare = np.minimum(np.add.reduceat((~common[order]).astype(np.int64), first), 62)
            sig = mix(sums + (p[first].astype(np.uint64) * _U(64) + _U(c)) * _M2)
            key = ((_U(62) - rare.astype(np.uint64)) << _U(58)) | (sig >> _U(6))
            if len(key) > k + 1:
                key = np.partition(key, k)[: k + 1]
            elif len(key) < k + 1:  # too few parts hold anything: empty parts come last in the order
                empty = np.setdiff1d(np.arange(n1), p[first])[: k + 1 - len(key)].astype(np.uint64)
                key = np.r_[key, (_U(63) << _U(58)) | (mix((empty * _U(64) + _U(c)) * _M2 + _U(1)) >> _U(6))]
            out.append(key)
    return out


def parity(s: np.ndarray) -> np.ndarray:
    """A bit per bin, set where an odd number of features falls; one to two bins a feature, 64 at least."""
    bins = max(64, 2 << (len(s).bit_length() - 1))
    return np.packbits((np.bincount((mix(s + _U(55)) & _U(bins - 1)).astype(np.int64), minlength=bins) & 1).astype(np.uint8), bitorder="little")


def bitmap(s: np.ndarray) -> np.ndarray:
    """A bit per bin, set where any feature falls; eight to sixteen bins a feature."""
    bits = np.zeros(max(64, 16 << (len(s).bit_length() - 1)), np.uint8)
    bits[(mix(s + _U(77)) & _U(len(bits) - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little")


def folded(rows: np.ndarray, width: int, by) -> np.ndarray:
    """Bitmaps as of fewer bins; bins are low bits of a hash, so halves lie on one another."""
    while rows.shape[1] > width:
        half = rows.shape[1] // 2
        rows = by(rows[:, :half], rows[:, half:])
    return rows


def sizes_fit(x, y, percent: int = PERCENT):
    return 100 * np.minimum(x, y) >= percent * np.maximum(x, y)


def linked(x: np.ndarray, y: np.ndarray, percent: int = PERCENT) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort()
    inter = int((both[1:] == both[:-1]).sum())
    return 100 * inter >= percent * (len(x) + len(y) - inter)


# ---------------------------------------------------------------- sets and signatures
_SIGNED = "doc_id long, n_shingles long, k1 long, k2 long, heads array<long>, parity binary, sigs binary"


def common_features(docs: DataFrame, words: int = WORDS) -> np.ndarray:
    """Shingles that several texts of a bounded sample share, sorted."""
    step = max(1, docs.count() // SAMPLE_ROWS)
    rows = docs.where((F.pmod(F.xxhash64("doc_id"), F.lit(step)) == 0) & (F.length("text") <= SAMPLE_CHARS)).limit(SAMPLE_ROWS)
    hashes = WordHashes()
    found = [s for s in (shingles(r["text"], hashes, words) for r in rows.select("text").toLocalIterator()) if len(s)]
    if not found:
        return np.zeros(0, np.uint64)
    kinds, count = np.unique(np.concatenate(found), return_counts=True)
    return kinds[count >= COMMON]


def signed(docs: DataFrame, common: np.ndarray, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """A row per document: its size, its set's key, its first signatures, parities, and all signatures (48 bits each)."""
    spread = docs.sparkSession.sparkContext.broadcast(common)  # bounded by the sample

    def run(batches):
        import pyarrow as pa

        hashes, often = WordHashes(), spread.value
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary()]
        names = ["doc_id", "n_shingles", "k1", "k2", "heads", "parity", "sigs"]
        rows: list[tuple] = []

        def signed64(x):
            return x - 2**64 if x >= 2**63 else x

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
            rows.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                s = shingles(text.as_py(), hashes, words)
                if not len(s):
                    rows.append((doc, 0, None, None, None, None, None))
                else:
                    key = set_key(s)
                    if len(often):
                        at = np.searchsorted(often, s)
                        flags = often[np.minimum(at, len(often) - 1)] == s
                    else:
                        flags = np.zeros(len(s), bool)
                    each = by_band(s, flags, percent)
                    first = np.concatenate([np.partition(x, HEADS)[:HEADS] if len(x) > HEADS else x for x in each])
                    sigs = (mix(np.concatenate(each)) >> _U(16)).astype("<u8")
                    short = np.ascontiguousarray(sigs.view(np.uint8).reshape(-1, 8)[:, :6])
                    rows.append((doc, len(s), signed64(key[0]), signed64(key[1]), (mix(first) >> _U(1)).astype(np.int64), parity(s).tobytes(), short.tobytes()))
                if len(rows) >= 1024:
                    yield flush()
        if rows:
            yield flush()
        hashes.clear()
        trim()

    return docs.mapInArrow(run, _SIGNED)


def _planes(x: np.ndarray, width: int) -> bytes:
    """The low bytes of numbers, plane by plane: high planes are nearly constant and compress well."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unplaned(raw: bytes, at: int, n: int, width: int) -> np.ndarray:
    full = np.zeros((n, 8), np.uint8)
    full[:, :width] = np.frombuffer(raw, np.uint8, width * n, at).reshape(width, n).T
    return full.view("<u8").ravel()


def sliced(sets: DataFrame, slices: int) -> DataFrame:
    """slice, blob: the signatures (rows of doc_id, n, comp, sigs) of many sets that fall into one slice."""

    def run(batches):
        import pyarrow as pa
        import zstandard

        packer = zstandard.ZstdCompressor(level=1)
        ids, size, comp, sigs, held = [], [], [], [], 0

        def block():
            i, n, c = (np.array(x, np.int64) for x in (ids, size, comp))
            count = np.array([len(x) // 6 for x in sigs])
            full = np.zeros((int(count.sum()), 8), np.uint8)
            full[:, :6] = np.frombuffer(b"".join(sigs), np.uint8).reshape(-1, 6)
            v = full.view("<u8").ravel()
            who = np.repeat(np.arange(len(i), dtype=np.uint64), count)
            to, v = v % _U(slices), v // _U(slices)
            order = np.lexsort((v, to))
            v, who, to = v[order], who[order], to[order]
            edges = np.searchsorted(to, np.arange(slices + 1, dtype=np.uint64))
            out = []
            for k in np.flatnonzero(np.diff(edges)).tolist():
                a, b = edges[k], edges[k + 1]
                used, local = np.unique(who[a:b].astype(np.int64), return_inverse=True)
                head = np.array([b - a, len(used)], np.int64)
                blob = head.tobytes() + _planes(v[a:b], 6) + _planes(local, 4) + _planes(i[used], 8) + _planes(c[used] - i[used], 8) + _planes(n[used], 4)
                out.append((k, packer.compress(blob)))
                if len(out) >= 32:
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], ["slice", "blob"])
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], ["slice", "blob"])

        for batch in batches:
            ids += batch.column(0).to_pylist()
            size += batch.column(1).to_pylist()
            comp += batch.column(2).to_pylist()
            more = batch.column(3).to_pylist()
            sigs += more
            held += sum(map(len, more)) // 6
            if held >= BLOCK_SIGS:
                yield from block()
                ids, size, comp, sigs, held = [], [], [], [], 0
        if ids:
            yield from block()
        ids = size = comp = sigs = None
        trim()

    return sets.select("doc_id", "n", "comp", "sigs").mapInArrow(run, "slice int, blob binary")


# ---------------------------------------------------------------- groups
_GROUPS = "kind int, a long, b long, members binary"


def grouped(blobs: DataFrame) -> DataFrame:
    """kind 0: pairs (a, b) across components. kind 1: large groups (key a) with lists of members, list number b."""

    def run(table):
        import pyarrow as pa
        import zstandard

        opener = zstandard.ZstdDecompressor()
        sigs, who, ids, comp, size, base = [], [], [], [], [], 0
        for blob in table.column("blob"):
            raw = opener.decompress(blob.as_py(), max_output_size=2**31 - 1)
            n, m = (int(x) for x in np.frombuffer(raw, np.int64, 2))
            sigs.append(_unplaned(raw, 16, n, 6))
            who.append(_unplaned(raw, 16 + 6 * n, n, 4).astype(np.int64) + base)
            at = 16 + 10 * n
            ids.append(_unplaned(raw, at, m, 8).view(np.int64))
            comp.append(_unplaned(raw, at + 8 * m, m, 8).view(np.int64) + ids[-1])
            size.append(_unplaned(raw, at + 16 * m, m, 4).astype(np.int64))
            base += m
        sigs, who, ids, comp, size = (np.concatenate(x) for x in (sigs, who, ids, comp, size))
        order = np.argsort(sigs, kind="stable")
        s, who = sigs[order], who[order]
        first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        count = np.diff(np.r_[first, len(s)])
        several = count > 1
        c = comp[who]
        several &= np.minimum.reduceat(c, first) != np.maximum.reduceat(c, first)
        pairs: set[tuple[int, int]] = set()
        groups: dict[int, np.ndarray] = {}
        for start, n in zip(first[several].tolist(), count[several].tolist()):
            w = who[start : start + n]
            i, k, z = ids[w], comp[w], size[w]
            if n <= SMALL:
                i_, k_, z_ = i.tolist(), k.tolist(), z.tolist()
                for x in range(n):
                    for y in range(x + 1, n):
                        if k_[x] != k_[y] and 100 * min(z_[x], z_[y]) >= PERCENT * max(z_[x], z_[y]):
                            pairs.add((min(i_[x], i_[y]), max(i_[x], i_[y])))
                continue
            i, at = np.unique(i, return_index=True)
            k, z = k[at], z[at]
            key = int(mix(i.astype(np.uint64)).sum(dtype=np.uint64) >> _U(1))
            if key in groups or len(i) < 2:
                continue
            groups[key] = i
            kinds, members = np.unique(k, return_counts=True)
            main = kinds[np.argmax(members)]
            inside = np.flatnonzero(k == main)
            inside = inside[np.argsort(mix(i[inside].astype(np.uint64)))][:2]
            for x in inside.tolist():
                fit = (k != main) & sizes_fit(z, z[x])
                pairs.update((min(int(i[x]), y), max(int(i[x]), y)) for y in i[fit].tolist())
        kind, a_, b_, lists = [0] * len(pairs), [p[0] for p in pairs], [p[1] for p in pairs], [None] * len(pairs)
        for key, i in groups.items():
            for number, at in enumerate(range(0, len(i), LIST)):
                kind.append(1), a_.append(key), b_.append(number), lists.append(i[at : at + LIST].tobytes())
        return pa.table([pa.array(kind, pa.int32()), pa.array(a_, pa.int64()), pa.array(b_, pa.int64()), pa.array(lists, pa.binary())], names=["kind", "a", "b", "members"])

    return blobs.groupBy("slice").applyInArrow(run, _GROUPS)


def members_of(lists: DataFrame) -> DataFrame:
    """g, doc_id of the member lists (a, members)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for key, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.frombuffer(blob.as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), key), pa.int64()), pa.array(ids, pa.int64())], ["g", "doc_id"])

    return lists.select("a", "members").mapInArrow(run, "g long, doc_id long")


# ---------------------------------------------------------------- sieves
_CANDIDATES = "a long, b long, comp_a long, comp_b long, apart long"


def _vectors(column, rows) -> np.ndarray:
    """Binary values of one length as rows of bytes."""
    values = [column[int(i)].as_py() for i in rows]
    return np.frombuffer(b"".join(values), np.uint8).reshape(len(rows), -1)


def sieved(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b, comp_a, comp_b) whose sizes and parities don't rule a link out. sets: doc_id, n, parity."""
    side = lambda x: sets.select(F.col("doc_id").alias(x), F.col("n").alias(f"n_{x}"), F.col("parity").alias(f"p_{x}"))
    joined = pairs.join(side("a"), "a").where("a <> b and comp_a <> comp_b").join(side("b"), "b")
    joined = joined.where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)").select("a", "b", "comp_a", "comp_b", "n_a", "n_b", "p_a", "p_b")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            n = batch.column(4).to_numpy(), batch.column(5).to_numpy()
            width = [np.array([len(x.as_py()) for x in batch.column(k)], np.int64) for k in (6, 7)]
            apart = np.zeros(batch.num_rows, np.int64)
            for x, y in set(zip(*(w.tolist() for w in width))):
                for rows in np.array_split(at := np.flatnonzero((width[0] == x) & (width[1] == y)), 1 + len(at) * max(x, y) // (8 << 20)):
                    if len(rows):
                        p, q = (folded(_vectors(batch.column(k), rows), min(x, y), np.bitwise_xor) for k in (6, 7))
                        apart[rows] = np.bitwise_count(p ^ q).sum(axis=1, dtype=np.int64)
            keep = apart <= (100 - percent) * (n[0] + n[1]) // (100 + percent)
            yield pa.RecordBatch.from_arrays([*(batch.column(k).filter(pa.array(keep)) for k in range(4)), pa.array(apart[keep])], ["a", "b", "comp_a", "comp_b", "apart"])

    return joined.mapInArrow(run, _CANDIDATES)


def mapped(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n, bits: the bitmaps of documents."""

    def run(batches):
        import pyarrow as pa

        hashes = WordHashes()
        for batch in batches:
            sets = [shingles(x.as_py(), hashes, words) for x in batch.column(1)]
            rows = [pa.array([len(s) for s in sets], pa.int64()), pa.array([bitmap(s).tobytes() if len(s) else b"" for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *rows], ["doc_id", "n", "bits"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, bits binary")


def across(cells: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs of a cell's two sides that bitmaps don't rule out: the intersection is at most the bins in common and the features
    beside a bin's first. cells: cell, side_a, inside (a member of the main component), doc_id, comp, n, bits."""

    def run(table):
        import pyarrow as pa

        side, inside = (np.array(table.column(k).to_pylist(), bool) for k in ("side_a", "inside"))
        doc, comp, n = (table.column(k).to_numpy() for k in ("doc_id", "comp", "n"))
        width = np.array([len(x.as_py()) for x in table.column("bits")], np.int64)
        bits = {int(w): (_vectors(table.column("bits"), np.flatnonzero(width == w))) for w in np.unique(width)}
        place = np.zeros(len(doc), np.int64)
        for w in bits:
            place[width == w] = np.arange((width == w).sum())
        found = []
        for x in np.flatnonzero(side).tolist():
            fit = ~side & (comp != comp[x]) & (inside | (doc > doc[x])) & sizes_fit(n, n[x], percent)
            for w in np.unique(width[fit]).tolist():
                rows = np.flatnonzero(fit & (width == w))
                least = min(w, int(width[x]))
                p = folded(bits[int(width[x])][place[x] : place[x] + 1], least, np.bitwise_or)
                q = folded(bits[w][place[rows]], least, np.bitwise_or)
                more = np.minimum(n[x] - int(np.bitwise_count(p).sum()), n[rows] - np.bitwise_count(q).sum(axis=1, dtype=np.int64))
                most = np.bitwise_count(p & q).sum(axis=1, dtype=np.int64) + more
                keep = (100 + percent) * most >= percent * (n[x] + n[rows])
                found += [(int(doc[x]), int(doc[y]), int(comp[x]), int(comp[y]), int(n[x] + n[y] - 2 * m)) for y, m in zip(rows[keep].tolist(), most[keep].tolist())]
        columns = list(zip(*found)) if found else [[]] * 5
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["a", "b", "comp_a", "comp_b", "apart"])

    return cells.groupBy("cell").applyInArrow(run, _CANDIDATES)


# ---------------------------------------------------------------- links
def _by_cell(rows: DataFrame) -> DataFrame:
    """Members of a cell next to each other, in order."""
    return rows.repartition(max(parts(rows.sparkSession), 8), "cell").sortWithinPartitions("cell", "pos")


def _streamed(batches, names, finish):
    """Calls finish(rows of a cell) for each cell of a sorted stream; rows are dicts."""
    now, rows = None, []
    for batch in batches:
        cols = [batch.column(i) for i in range(len(names))]
        for i in range(batch.num_rows):
            cell = cols[0][i].as_py()
            if cell != now and rows:
                yield from finish(rows)
                rows = []
            now = cell
            rows.append({n: c[i].as_py() for n, c in zip(names, cols)})
    if rows:
        yield from finish(rows)


def starred(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b, comp_a, comp_b) as cells: a against about CHUNK of its partners. A cell may hold its head alone."""
    many = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("_n"), F.min("comp_a").alias("comp"))
    celled = pairs.join(many.select("a", "_n"), "a").withColumn("cell", F.xxhash64("a", F.pmod(F.xxhash64("b"), F.col("_n")).cast("int")))
    heads = many.select("a", "comp", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("i"))
    heads = heads.select(F.xxhash64("a", "i").alias("cell"), F.lit(0).alias("pos"), F.lit(True).alias("side_a"), F.col("a").alias("doc_id"), "comp")
    return heads.unionByName(celled.select("cell", F.lit(1).alias("pos"), F.lit(False).alias("side_a"), F.col("b").alias("doc_id"), F.col("comp_b").alias("comp")))


def _near(ids: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of documents that may be among the ids: a filter of at most 2**18 hash buckets, sent to all."""
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 18)).cast("int")
    wanted = ids.select(bucket.alias("_b")).distinct()
    return rows.withColumn("_b", bucket).join(F.broadcast(wanted), "_b", "left_semi").drop("_b")


def confirmed(pairs: DataFrame, docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) among written pairs (a, b, comp_a, comp_b) that whole texts confirm; inside a cell, members that are connected
    already are not compared."""
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id")))
    joined = _by_cell(starred(pairs).join(_near(ids, docs), "doc_id").select("cell", "pos", "side_a", "doc_id", "comp", "text"))
    names = joined.columns

    def run(batches):
        import pyarrow as pa

        hashes = WordHashes()

        def finish(rows):
            sets = [shingles(r["text"], hashes, words) for r in rows]
            up: dict[int, int] = {}

            def root(x):
                while up.get(x, x) != x:
                    x = up[x]
                return x

            for i, a in enumerate(rows):
                if not a["side_a"]:
                    continue
                for j, b in enumerate(rows):
                    if (j > i or not b["side_a"]) and a["doc_id"] != b["doc_id"]:
                        x, y = root(a["comp"]), root(b["comp"])
                        if x != y and linked(sets[i], sets[j], percent):
                            up[max(x, y)] = min(x, y)
                            yield min(a["doc_id"], b["doc_id"]), max(a["doc_id"], b["doc_id"])

        out = []
        for row in _streamed(batches, names, finish):
            out.append(row)
            if len(out) >= 8192:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])

    return joined.mapInArrow(run, "a long, b long")


# ---------------------------------------------------------------- components
def components(links: DataFrame) -> DataFrame:
    """doc_id, comp (smallest id reachable) for every end of a link: least labels of neighbours, then a jump to the label's own."""
    spark = links.sparkSession
    edges_at = scratch_path(spark, "edges")
    links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).write.parquet(edges_at)
    edges = spark.read.schema("a long, b long").parquet(edges_at)
    at, turn = "", edges.groupBy(F.col("a").alias("doc_id")).agg(F.least(F.min("b"), F.col("doc_id")).alias("comp")).withColumn("was", F.lit(-1).cast("long"))
    while True:
        old, at = at, scratch_path(spark, "labels")
        turn.write.parquet(at)
        if old:
            dropped(spark, old)
        after = spark.read.schema("doc_id long, comp long, was long").parquet(at)
        if after.where("was <> comp").limit(1).count() == 0:
            dropped(spark, edges_at)
            return after.select("doc_id", "comp")
        labels = after.select("doc_id", "comp")
        near = edges.join(labels.withColumnRenamed("doc_id", "b"), "b").groupBy(F.col("a").alias("doc_id")).agg(F.min("comp").alias("near"))
        lower = labels.join(near, "doc_id").select("doc_id", F.col("comp").alias("was"), F.least("comp", "near").alias("comp"))
        tops = lower.select(F.col("doc_id").alias("comp"), F.col("comp").alias("top"))
        turn = lower.join(tops, "comp", "left").select("doc_id", F.least("comp", F.coalesce("top", "comp")).alias("comp"), "was")


# ---------------------------------------------------------------- the join
_SETS = "k1 long, k2 long, doc_id long, copies long, n long, heads array<long>, parity binary"


class _Tables:
    """Scratch tables by name; drop() deletes what no later plan reads."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def write(self, name: str, df: DataFrame) -> DataFrame:
        path, schema = scratch_path(self.spark, name), df.schema
        df.write.parquet(path)
        self.paths[name] = path
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            dropped(self.spark, self.paths.pop(name))


def _labelled(rows: DataFrame, labels: DataFrame, column: str, name: str) -> DataFrame:
    known = labels.select(F.col("doc_id").alias(column), F.col("comp").alias("_c"))
    return rows.join(known, column, "left").withColumn(name, F.coalesce("_c", column)).drop("_c")


def open_cells(groups: DataFrame, tables: _Tables) -> DataFrame | None:
    """The large groups (g, doc_id, comp) of several components as cells: cell, side_a, inside, doc_id, comp."""
    by = groups.groupBy("g", "comp").agg(F.count(F.lit(1)).alias("n"))
    main = by.groupBy("g").agg(F.count(F.lit(1)).alias("comps"), F.sum("n").alias("size"), F.max(F.struct("n", "comp")).alias("m")).where("comps > 1")
    main = tables.write("mains", main.select("g", "size", F.col("size") - F.col("m.n"), F.col("m.comp")).toDF("g", "size", "out", "main"))
    if main.limit(1).count() == 0:
        return None
    member = tables.write("open", groups.join(main, "g"))
    # groups of one main component go together where that takes fewer comparisons
    united = member.select("main", "doc_id", "comp").distinct()
    together = united.groupBy("main").agg(F.count(F.lit(1)).alias("size"), F.sum((F.col("comp") != F.col("main")).cast("long")).alias("out"))
    apart = main.groupBy("main").agg(F.sum(F.col("size").cast("double") * F.col("out")).alias("cost"))
    plan = tables.write("plan", together.join(apart, "main").select("main", F.col("size").alias("u_size"), F.col("out").alias("u_out"), (F.col("size").cast("double") * F.col("out") <= F.col("cost")).alias("unite")))
    one = united.join(plan.where("unite"), "main").select(F.col("main").alias("s"), F.lit(True).alias("u"), "doc_id", "comp", "main", F.col("u_size").alias("size"), F.col("u_out").alias("out"))
    each = member.join(plan.where("not unite").select("main"), "main").select(F.col("g").alias("s"), F.lit(False).alias("u"), "doc_id", "comp", "main", "size", "out")
    rows = one.unionByName(each)
    blocks = lambda n: F.greatest(F.ceil(F.col(n) / CELL), F.lit(1)).cast("int")
    at = lambda n: F.pmod(F.xxhash64("doc_id"), blocks(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    keep = ["s", "u", "doc_id", "comp", (F.col("comp") == F.col("main")).alias("inside")]
    side_a = rows.where("comp <> main").select(*keep, at("out").alias("i"), every("size").alias("j"), F.lit(True).alias("side_a"))
    side_b = rows.select(*keep, every("out").alias("i"), at("size").alias("j"), F.lit(False).alias("side_a"))
    return side_a.unionByName(side_b).select(F.xxhash64("s", "u", "i", "j").alias("cell"), "side_a", "inside", "doc_id", "comp")


def labels_of(docs: DataFrame, sets: DataFrame, rows: DataFrame, slices: int, tables: _Tables, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, comp of every set with a link; ids are each set's smallest. rows: k1, k2, doc_id, n_shingles, sigs."""
    spark = docs.sparkSession
    light = sets.select("doc_id", "n", "parity")

    # turn 1: the first signatures, as stars
    head = sets.select("doc_id", F.explode("heads").alias("sig"))
    hub = head.groupBy("sig").agg(F.min("doc_id").alias("a"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    stars = head.join(hub, "sig").where("a <> doc_id").select("a", F.col("doc_id").alias("b"))
    stars = stars.distinct().withColumn("comp_a", F.col("a")).withColumn("comp_b", F.col("b"))
    found = tables.write("sieved0", sieved(stars, light, percent))
    links = tables.write("links0", confirmed(found, docs, words, percent))
    tables.drop("sieved0")
    labels = components(links)

    # turn 2: all signatures
    known = sets.select("k1", "k2", "doc_id").join(labels, "doc_id").select("k1", "k2", "comp")
    every = rows.select("k1", "k2", "doc_id", "n_shingles", "sigs", F.lit(None).cast("long").alias("comp"))
    every = every.unionByName(known, allowMissingColumns=True).groupBy("k1", "k2")
    every = every.agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n"), F.max("comp").alias("comp"), F.any_value("sigs", True).alias("sigs"))
    every = every.where("doc_id is not null").select("doc_id", "n", F.coalesce("comp", "doc_id").alias("comp"), "sigs")
    groups = tables.write("groups", grouped(sliced(every, slices)))
    release_shuffles(spark)
    pairs = groups.where("kind = 0").select("a", "b").distinct()
    pairs = _labelled(_labelled(pairs, labels, "a", "comp_a"), labels, "b", "comp_b").select("a", "b", "comp_a", "comp_b")
    found = tables.write("sieved1", sieved(pairs, light, percent))
    links = links.unionByName(tables.write("links1", confirmed(found, docs, words, percent)))
    tables.drop("sieved1")

    # turn 3: large groups that are still in several components
    lists = groups.where("kind = 1").groupBy("a", "b").agg(F.any_value("members").alias("members"))
    lists = tables.write("lists", lists.select("a", "members"))
    tables.drop("groups")
    labels = components(links)
    if lists.limit(1).count() == 0:
        return labels
    cells = open_cells(_labelled(members_of(lists), labels, "doc_id", "comp"), tables)
    if cells is None:
        return labels
    cells = tables.write("cells", cells)
    ids = cells.select("doc_id").distinct()
    drawn = tables.write("bitmaps", mapped(_near(ids, docs).join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"]), words))
    found = tables.write("candidates", across(cells.join(drawn, "doc_id"), percent))
    release_shuffles(spark)
    best = found.groupBy("a", "comp_b").agg(F.min(F.struct("apart", "b", "comp_a")).alias("m"))
    best = tables.write("best", best.select("a", "m.b", "m.comp_a", "comp_b"))
    links = links.unionByName(tables.write("links2", confirmed(best, docs, words, percent)))
    labels = components(links)
    left = _labelled(_labelled(found.select("a", "b").distinct(), labels, "a", "comp_a"), labels, "b", "comp_b").where("comp_a <> comp_b")
    left = tables.write("left", left.select("a", "b", "comp_a", "comp_b"))
    if left.limit(1).count() == 0:
        return labels
    last = tables.write("links3", confirmed(left, docs, words, percent))
    return labels if last.limit(1).count() == 0 else components(links.unionByName(last))


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id: one row per row of docs."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tables = _Tables(spark)
    signed_rows = tables.write("signed", signed(docs, common_features(docs, words), words, percent))
    rows = signed_rows.where("n_shingles > 0")
    classes = rows.groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"), F.max("n_shingles").alias("n"))
    drawn = rows.where("doc_id is not null").select("doc_id", "heads", "parity").dropDuplicates(["doc_id"])
    classes = tables.write("classes", classes)
    sets = tables.write("sets", classes.where("doc_id is not null").join(drawn, "doc_id"))
    labels = labels_of(docs, sets, rows, slices_for(size, 12 << 20), tables, words, percent)
    known = classes.withColumnRenamed("doc_id", "rep").join(labels.withColumnRenamed("doc_id", "rep"), "rep", "left").where("copies > 1 or comp is not null")
    known = known.select("k1", "k2", F.coalesce("comp", "rep").alias("comp"))
    out = signed_rows.select("doc_id", "n_shingles", "k1", "k2").join(known, ["k1", "k2"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce("comp", "doc_id").alias("component_id"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
