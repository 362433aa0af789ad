"""SentencePiece encoding and decoding by a max-plus parallel scan.

The best segmentation of a text is a longest path, a product of matrices in the max-plus semiring.
Texts beyond CHUNK characters are split into chunks. A state at a chunk's border is the number of the
chunk's first characters that a piece begun earlier covers, below the longest piece's length. Each
chunk gives a transfer matrix from its entry to its exit states; matrices are combined associatively,
which gives the best score up to each border and, backwards, the state of every border on a best
path; then each chunk is traced back by itself between its two states.

Scores are the model file's own piece scores, added exactly; equal sums prefer the longer piece at
each end, as the library's unigram mode does. The file at hand is of the merge-rule kind, whose own
merging is not a longest path: here its pieces and scores are read in the unigram mode, with the same
ids, and decoding is the same for both. Where no piece fits, a character becomes its UTF-8 byte
pieces. A chunk between two known borders is solved by the tokenizers library's longest path over the
same pieces and scores; entering and leaving a border at every state, and stretches that spell a
control or byte piece's name, by forward() here. Pieces never run from a non-blank into a blank
(checked when the model is read), so a path splits before each run of blanks, and a chunk's matrix
needs forward() only before its first and after its last such place. Chunk borders are put at such places where there are any; elsewhere, sums that are equal on both sides
of a border may be resolved to another path of the same score.

Edge cases: null and empty texts have no ids and one empty row; a text without any blank is solved by
full matrices; repeated rows are encoded each; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, parts, written

#: Texts longer than this are split.
CHUNK = 32_768
BLANK = "▁"
NEVER = float("-inf")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Model:
    """Pieces and scores of a SentencePiece file, and best paths over them."""

    def __init__(self, path: str):
        import os

        import sentencepiece

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        from tokenizers import Tokenizer, models

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.piece: list[str] = []
        self.byte = [-1] * 256
        for i in range(sp.get_piece_size()):
            p = sp.id_to_piece(i)
            self.piece.append(p)
            if sp.is_byte(i):
                self.byte[int(p[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.score[p], self.id[p] = sp.get_score(i), i
        #: byte pieces stand as private characters until runs of them are read; no other piece holds such a character
        self.shown = [p.replace(BLANK, " ") for p in self.piece]
        for b, i in enumerate(self.byte):
            if i >= 0:
                self.shown[i] = chr(_FIRST + b)
        self.longest = max(map(len, self.score))
        self.unknown = min(self.score.values()) - 10
        self.cuts = not any(BLANK in p.lstrip(BLANK) for p in self.score)
        self.lengths: dict[str, list[int]] = {}  # first two characters -> lengths of pieces
        for p in self.score:
            self.lengths.setdefault(p[:2], set()).add(len(p))  # type: ignore[arg-type]
        self.lengths = {k: sorted(v) for k, v in self.lengths.items()}
        # what an id adds to a path's score; of a byte run, each character's first byte carries the unknown character's
        self.value = np.array([self.score.get(p, 0.0) for p in self.piece])
        for b, i in enumerate(self.byte):
            if i >= 0:
                self.value[i] = 0.0 if 0x80 <= b < 0xC0 else self.unknown
        named = [p for i, p in enumerate(self.piece) if p not in self.score or i in self.byte]
        self.named = re.compile("|".join(map(re.escape, named)) or "(?!)")
        #: the library's longest path, if all bytes have pieces; it would take the names of other pieces in a text for those pieces
        vocabulary = [(p, self.score.get(p, 0.0)) for p in self.piece]
        self.native = Tokenizer(models.Unigram(vocabulary, sp.unk_id(), True)) if min(self.byte) >= 0 else None

    # -- one stretch
    def forward(self, s: str, n: int, start: list[float]) -> tuple[list[float], list[int]]:
        """best[e], back[e] for ends e <= len(s) by pieces that start below n. start: scores of entering at 0, 1, ..; back -1: entered there."""
        best, back = [NEVER] * (len(s) + 1), [-2] * (len(s) + 1)
        for i, v in enumerate(start):
            if v > NEVER:
                best[i], back[i] = v, -1
        score, lengths = self.score, self.lengths
        for b in range(n):
            at = best[b]
            if at == NEVER:
                continue
            single = False
            for k in (1, *lengths.get(s[b : b + 2], ())):
                e = b + k
                if e > len(s) or (k == 1 and single):
                    continue
                got = score.get(s[b:e])
                if k == 1:
                    single = True
                    got = self.unknown if got is None else got
                if got is not None and at + got > best[e]:
                    best[e], back[e] = at + got, b
        return best, back

    def ids_of(self, s: str, back: list[int], end: int) -> tuple[list[int], int]:
        """Ids of the path that ends at `end`, and where it was entered."""
        out, e = [], end
        while back[e] >= 0:
            p = s[back[e] : e]
            got = self.id.get(p)
            out += [got] if got is not None else [self.byte[x] for x in reversed(p.encode("utf-8", "surrogatepass"))]
            e = back[e]
        return out[::-1], e

    def plain(self, s: str) -> tuple[float, bytes]:
        """solved(), by forward()."""
        best, back = self.forward(s, len(s), [0.0])
        return best[len(s)], np.array(self.ids_of(s, back, len(s))[0], "<u4").tobytes()

    def solved(self, s: str) -> tuple[float, bytes]:
        """Score and ids of a text with borders on both sides."""
        if self.native is None:
            return self.plain(s)
        if self.named.search(s):
            got = [self.plain(x) if self.named.search(x) else self.solved(x) for x in self.stretches(s)]
            return sum(x[0] for x in got), b"".join(x[1] for x in got)
        ids = np.array(self.native.encode_batch_fast([s], add_special_tokens=False)[0].ids, "<u4")
        return float(self.value[ids].sum()), ids.tobytes()

    def stretches(self, s: str) -> list[str]:
        return _STRETCH.findall(s) if self.cuts else [s]

    # -- chunks
    def matrix(self, s: str, n: int) -> np.ndarray:
        """Transfer matrix of a chunk of n characters; s holds up to longest - 1 more."""
        size = self.longest
        out = np.full((size, size), NEVER)
        cut = _first_cut(s, n) if self.cuts else 0
        if cut:
            last = _last_cut(s, n)
            middle = self.solved(s[cut:last])[0]
            tail, _ = self.forward(s[last:], n - last, [0.0])
            after = np.array([tail[n - last + j] if n - last + j < len(tail) else NEVER for j in range(size)])
            for i in range(min(size, cut + 1)):
                head, _ = self.forward(s[i:cut], cut - i, [0.0])
                out[i] = head[cut - i] + middle + after
            return out
        for i in range(min(size, n + 1)):
            best, _ = self.forward(s[i:], n - i, [0.0])
            for j in range(size):
                if n - i + j < len(best):
                    out[i, j] = best[n - i + j]
        return out

    def trace(self, s: str, n: int, entry: int, exit_: int) -> tuple[float, bytes]:
        """Score and ids of the best path of a chunk from its entry to its exit state."""
        return self.solved(s[entry : n + exit_])

    def decode(self, ids: list[int]) -> str:
        """Text of ids with blanks as spaces; the blank that encoding puts first is still there."""
        text = "".join(map(self.shown.__getitem__, ids))
        return _BYTES.sub(lambda m: bytes(ord(c) - _FIRST for c in m[0]).decode("utf-8", "replace"), text)


_FIRST = 0xF0000
_BYTES = re.compile(f"[{chr(_FIRST)}-{chr(_FIRST + 255)}]+")
_STRETCH = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+$")
_CUT = re.compile(f"(?<=[^{BLANK}]){BLANK}")


def _first_cut(s: str, n: int) -> int:
    m = _CUT.search(s, 0, n)
    return m.start() if m else 0


def _last_cut(s: str, n: int) -> int:
    at = n
    while at > 0:
        at = s.rfind(BLANK, 0, at)
        if at <= 0:
            return 0
        if s[at - 1] != BLANK:
            return at
    return 0


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def states(matrices: list[np.ndarray]) -> list[tuple[int, int]]:
    """(entry, exit) of every chunk on a best path: prefix products by doubling, then backwards."""
    prefix = list(matrices)
    gap = 1
    while gap < len(prefix):
        prefix = [combine(prefix[k - gap], m) if k >= gap else m for k, m in enumerate(prefix)]
        gap *= 2
    out, leave = [], 0
    for k in range(len(matrices) - 1, -1, -1):
        enter = 0 if k == 0 else int(np.argmax(prefix[k - 1][0] + matrices[k][:, leave]))
        out.append((enter, leave))
        leave = enter
    return out[::-1]


def normalise(text: str | None) -> str:
    """A blank before the text, spaces as blanks; this model changes nothing else."""
    return BLANK + text.replace(" ", BLANK) if text else ""


def split_points(s: str, chunk: int, longest: int) -> list[int]:
    """Chunk borders: every `chunk` characters, moved back to a place where paths split if one is near."""
    out, at = [0], 0
    while len(s) - at > chunk:
        end = at + chunk
        m = _last_cut(s[max(at, end - 1024) : end], min(1024, end - at))
        at = max(at, end - 1024) + m if m else end
        out.append(at)
    return [*out, len(s)]


_CHUNKS = "doc_id long, row_id string, chunk int, start long, n int, text string, n_tokens long, score double, ids binary"


def chunked(docs: DataFrame, path: str, chunk: int) -> DataFrame:
    """Short texts encoded at once (chunk 0 with ids); long ones cut into chunks with their text."""

    def run(batches):
        import hashlib

        import pyarrow as pa

        model = Model(path)
        names = ["doc_id", "row_id", "chunk", "start", "n", "text", "n_tokens", "score", "ids"]
        kinds = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.float64(), pa.binary()]
        rows, held = [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                s = normalise(text.as_py())
                if len(s) <= chunk:
                    score, ids = model.trace(s, len(s), 0, 0) if s else (0.0, b"")
                    rows.append((doc, None, 0, 0, len(s), None, len(ids) // 4, score, ids))
                    held += len(ids)
                else:
                    name = hashlib.md5(f"{doc} {s}".encode("utf-8", "surrogatepass")).hexdigest()
                    edges = split_points(s, chunk, model.longest)
                    for k, (a, b) in enumerate(zip(edges, edges[1:])):
                        part = s[a : b + model.longest - 1]
                        rows.append((doc, name, k, a, b - a, part, None, None, None))
                        held += 4 * len(part)
                if held > 4 << 20 or len(rows) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return docs.mapInArrow(run, _CHUNKS)


def _matrices(chunks: DataFrame, path: str) -> DataFrame:
    """row_id, chunk, matrix: each chunk by itself, wherever it was dealt."""

    def run(batches):
        import pyarrow as pa

        model = Model(path)
        for batch in batches:
            rows = [(r["row_id"], r["chunk"], model.matrix(r["text"], r["n"]).tobytes()) for r in batch.to_pylist()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.int32(), pa.binary()))], ["row_id", "chunk", "matrix"])

    return chunks.mapInArrow(run, "row_id string, chunk int, matrix binary")


def _border_states(chunks: DataFrame, longest: int) -> DataFrame:
    """row_id, chunk, entry, exit for the chunks of long texts; a text's matrices are a small part of its size."""

    def run(table):
        import pyarrow as pa

        name = table.column("row_id")[0].as_py()
        got = sorted(dict(zip(table.column("chunk").to_pylist(), table.column("matrix").to_pylist())).items())
        path = states([np.frombuffer(m, np.float64).reshape(longest, longest) for _, m in got])
        return pa.table([pa.array([name] * len(got)), pa.array([k for k, _ in got], pa.int32()), pa.array([p[0] for p in path], pa.int32()), pa.array([p[1] for p in path], pa.int32())], names=["row_id", "chunk", "entry", "leave"])

    return chunks.select("row_id", "chunk", "matrix").groupBy("row_id").applyInArrow(run, "row_id string, chunk int, entry int, leave int")


def encode(docs: DataFrame, path: str | None = None, chunk: int = CHUNK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, chunk, start, n_chars, n_tokens, score, ids (binary): a row per chunk, in order a text's ids. start and n_chars count characters of the normalised text."""
    path = path or model_path()
    longest = Model(path).longest
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = written(chunked(narrow, path, chunk), "chunks", "zstd")
    short = rows.where("row_id is null").select("doc_id", "chunk", "start", F.col("n").cast("long").alias("n_chars"), "n_tokens", "score", "ids")
    # chunks of one text go to many tasks, once: for their matrices and again for their paths
    long_ = rows.where("row_id is not null").select("doc_id", "row_id", "chunk", "start", "n", "text").repartition(parts(docs.sparkSession), "row_id", "chunk")
    border = _border_states(_matrices(long_, path), longest)

    def trace(batches):
        import pyarrow as pa

        model = Model(path)
        names = ["doc_id", "chunk", "start", "n_chars", "n_tokens", "score", "ids"]
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.binary()]
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                score, ids = model.trace(r["text"], r["n"], r["entry"], r["leave"])
                rows.append((r["doc_id"], r["chunk"], r["start"] + r["entry"], r["n"] + r["leave"] - r["entry"], len(ids) // 4, score, ids))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    traced = long_.join(border, ["row_id", "chunk"]).drop("row_id").mapInArrow(trace, short.schema)
    return short.unionByName(traced)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """The encoded rows with their text; a text's first space stands for the blank that encoding adds."""
    path = path or model_path()
    schema = T.StructType([*encoded.schema.fields, T.StructField("text", T.StringType())])
    names = schema.names

    def run(batches):
        import pyarrow as pa

        model = Model(path)
        for batch in batches:
            at = batch.schema.get_field_index("ids")
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                texts = [model.decode(np.frombuffer(x, "<u4").tolist()) for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts)], names)

    return encoded.mapInArrow(run, schema)


def op4_piece_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded again: counts, scores and digests per chunk."""
    out = decode(encode(documents(spark, sf_dir)))
    return out.select("doc_id", "chunk", "start", "n_chars", "n_tokens", "score", F.crc32("ids").alias("ids_crc32"), F.crc32(F.encode("text", "UTF-8")).alias("text_crc32"))
