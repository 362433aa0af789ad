"""Quality rules as a short-circuit cascade.

Every rule is a test on a text's measures; a text is kept if no rule rejects it, so the verdict does
not depend on the order. The order decides the work: each rule's cost (seconds) and selectivity
(share rejected) are estimated on a bounded sample of SAMPLE_ROWS rows, and rules run by rejection
per cost, highest first, until one rejects. Measures are computed when a rule first needs them and
shared between rules.

Edge cases: a null text has no words and fails the base rule; a text without words likewise; an
empty table gives an empty result (rules keep their given order); repeated rows are judged alike;
other columns pass through `judged`, whose own columns replace any of the same names.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordHashes, documents

SAMPLE_ROWS = 256
SYMBOLS = re.compile(rb"[#*$%&|<>]")
LETTER = re.compile(r"[^\W\d_]")
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


class Measured:
    """A text's measures, each computed on first use."""

    def __init__(self, text: str | None, hashes: WordHashes):
        self.raw = (text or "").encode("utf-8", "surrogatepass")
        self.hashes = hashes

    def __getattr__(self, name: str):
        value = getattr(self, f"_{name}")()
        self.__dict__[name] = value
        return value

    def _words(self):
        return self.raw.split()

    def _n_words(self):
        return len(self.words)

    def _word_chars(self):
        joined = b"".join(self.words)
        return len(joined) if joined.isascii() else len(joined.decode("utf-8", "surrogatepass"))

    def _n_symbols(self):
        return len(SYMBOLS.findall(self.raw))

    def _lines(self):
        return [x for x in self.raw.split(b"\n") if x and not x.isspace()]

    def _n_lines(self):
        return len(self.lines)

    def _n_dup_lines(self):
        return len(self.lines) - len(set(self.lines))

    def _n_repeat_words(self):
        """Words in 3-word windows that occur twice or more. Hashes find the windows, the words confirm them."""
        w, n = self.words, len(self.words) - 2
        if n < 2:
            return 0
        a = np.frombuffer(b"".join(map(self.hashes.__getitem__, w)), dtype="<u8")
        with np.errstate(over="ignore"):
            k = (a[:-2] * np.uint64(0x9E3779B97F4A7C15) + a[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + a[2:]
        order = np.argsort(k, kind="stable")
        same = k[order[1:]] == k[order[:-1]]
        if not same.any():
            return 0
        at = np.flatnonzero(np.r_[False, same] | np.r_[same, False])
        seen: dict[tuple, int] = {}
        spots = order[at].tolist()
        for i in spots:
            key = (w[i], w[i + 1], w[i + 2])
            seen[key] = seen.get(key, 0) + 1
        hit = np.array([i for i in spots if seen[(w[i], w[i + 1], w[i + 2])] > 1], dtype=np.int64)
        covered = np.zeros(len(w), dtype=bool)
        for d in range(3):
            covered[hit + d] = True
        return int(covered.sum())

    def _lettered(self):
        """Words that hold a letter."""
        return sum(1 for x in self.words if x.isalpha() or LETTER.search(x.decode("utf-8", "surrogatepass")))

    def _longest(self):
        return max(map(len, self.words), default=0)


@dataclass(frozen=True)
class Rule:
    """rejects: text's measures -> True if the text goes."""

    name: str
    rejects: Callable[[Measured], bool]


BASE = (
    Rule("few_words", lambda m: m.n_words < 50),
    Rule("repeated_words", lambda m: 100 * m.n_repeat_words > 50 * m.n_words),
)
#: Production rules. Shares of the words or lines, far outside what prose shows.
RULES = (
    *BASE,
    Rule("symbols", lambda m: 10 * m.n_symbols > m.n_words),
    Rule("repeated_lines", lambda m: m.n_lines >= 4 and 2 * m.n_dup_lines > m.n_lines),
    Rule("short_words", lambda m: m.word_chars < 2 * m.n_words),
    Rule("long_words", lambda m: m.word_chars > 15 * m.n_words),
    Rule("few_letters", lambda m: 10 * m.lettered < 7 * m.n_words),
)


def cascade(texts: list[str | None], rules: tuple[Rule, ...]) -> list[str]:
    """Rule names by rejection per cost on the given texts, highest first; ties keep the given order."""
    hashes = WordHashes()
    scored = []
    for i, rule in enumerate(rules):
        began, rejected = time.perf_counter(), 0
        for text in texts:
            rejected += bool(rule.rejects(Measured(text, hashes)))
        cost = max(time.perf_counter() - began, 1e-9) / max(1, len(texts))
        scored.append((-(rejected / max(1, len(texts))) / cost, i, rule.name))
    return [name for _, _, name in sorted(scored)]


def judged(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS, measures: bool = True) -> DataFrame:
    """docs with kept and, if measures are asked for, these and base_failed. Base rules that `rules` lacks are asked last. The sample
    only orders the rules."""
    rules = (*rules, *(r for r in BASE if r not in rules))
    order = cascade([r[0] for r in docs.select(text).limit(sample_rows).collect()], rules)
    named = {r.name: r for r in rules}
    base = {r.name for r in BASE}
    names = MEASURES if measures else ()
    own = [*names, "base_failed", "kept"] if measures else ["kept"]
    through = [c for c in docs.columns if c not in own]
    at = through.index(text)

    def judge(batches):
        import pyarrow as pa

        hashes = WordHashes()
        for batch in batches:
            step = 512
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                out: list[list] = [[] for _ in own]
                for value in part.column(at):
                    m = Measured(value.as_py(), hashes)
                    failed = next((n for n in order if named[n].rejects(m)), None)
                    # base_failed is asked for by itself, and only where it is returned; measures already taken are not taken again
                    asked = [failed in base or any(r.rejects(m) for r in BASE)] if measures else []
                    for col, v in zip(out, [*(getattr(m, n) for n in names), *asked, failed is None]):
                        col.append(v)
                kinds = [pa.int64()] * len(names) + [pa.bool_()] * (len(own) - len(names))
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(c, k) for c, k in zip(out, kinds))], [*through, *own])

    kinds = [T.LongType()] * len(names) + [T.BooleanType()] * (len(own) - len(names))
    src = docs.select(*through)
    schema = T.StructType(src.schema.fields + [T.StructField(n, k) for n, k in zip(own, kinds)])
    return src.mapInArrow(judge, schema)


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    out = judged(documents(spark, sf_dir).select(F.col("doc_id"), F.col("text")))
    return out.drop("text")


#: DuckDB twin of op7: the four measures, the base rule and the production rules.
OP7_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT doc_id, text,
         regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d),
i AS (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS p FROM w WHERE len(words) >= 3),
t AS (SELECT doc_id, p, words[p] AS a, words[p + 1] AS b, words[p + 2] AS c FROM i),
n AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, a, b, c) AS k FROM t),
r AS (
  SELECT doc_id, count(DISTINCT q) AS n_repeat_words
  FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM n WHERE k > 1) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         len(lines) AS n_lines,
         len(list_filter(words, lambda x: regexp_matches(x, '\p{L}'))) AS lettered
  FROM w LEFT JOIN r ON w.doc_id = r.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR (n_lines >= 4 AND 2 * n_dup_lines > n_lines)
            OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 10 * lettered < 7 * n_words) AS kept
FROM b
"""
