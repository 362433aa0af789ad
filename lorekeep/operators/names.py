"""Fuzzy joins of names that lose no pair above the threshold.

A pair is scored only if both names share a key, and keys are chosen so that every pair of at least the wanted score shares one.
With r = t / (2 - t), a name x that scores t or more by longest common subsequence keeps all but K = floor((1 - r) |x|) of its
characters, whatever the order of its tokens:

* g: pairs of letters within tokens. A removed character takes two of them, so the 2K + 1 rarest of x and those of y share one
  (prefix filter). Names of such short tokens that none need be left meet by all they have, and among each other by
  l: their K + 1 rarest letters.
* t: tokens. One name within the other, or shared tokens that make up r of a name: of that name the rarest tokens of more than
  (1 - r) |x| characters hold a shared one; they meet all tokens of the other.
* d: tokens, full stops being blanks: all but a share 1 - t of the tokens found in the other name.
* i: a token and the initial of another one, which an initial in the left name may stand for.
* n: tokens with all forms of first names; a Jaccard of t leaves |x| - ceil(t |x|) + 1 rarest elements that share one.
* p, v: for stretches of the longer name, the shorter one's rarest pairs of letters meet all of the longer one's; where it needs
  none of them, its rarest letters do.

"Rarest" is by counts over both tables, so a common token or pair of letters is no key of a name that has a rarer one. All of it is
joins and windows over exploded keys; skewed keys are left to the adaptive skew join.

Where the longest common subsequence alone decides, few letters make few pairs of letters, and nearly all names share one. There the
left name is cut into pieces: of the D letters that a pair may lose in all, some piece and the stretch that stands for it in the right
name lose D / pieces at most, two or fewer. Keys are what is left of both then, with the piece's place; see pieces().

Each different name is searched once, whatever the number of rows that have it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import PARTIAL_WEIGHT
from ..functions import columns as X
from .entities import company_score, indel_ratio, name_score, plain_score, with_score
from .graph import shared_checkpoints

#: What each measure needs.
KINDS = {name_score: "gltdin", plain_score: "glt", indel_ratio: "gl", company_score: "gltpv"}
#: Kinds whose keys must be among the rarest of one name only.
ONE_SIDED = "tdpv"
#: The longest names that are cut into pieces; a longer one meets others by its pairs of letters.
LONGEST = 32


def _tokens(name: Column) -> Column:
    return F.filter(F.split(name, r"\s+"), lambda t: t != "")


def _numbered(items: Column) -> Column:
    """Equal items told apart by how often they came before."""
    return F.transform(items, lambda x, i: F.concat(x, F.lit("#"), F.size(F.filter(F.slice(items, F.lit(1), i), lambda y: y == x)).cast("string")))


def _pairs_of_letters(tokens: Column) -> Column:
    two = lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 1, F.lit(1))), lambda i: F.substr(t, i, F.lit(2)))
    return F.flatten(F.transform(F.filter(tokens, lambda t: F.length(t) > 1), two))


def _letters(tokens: Column) -> Column:
    return F.filter(F.split(F.array_join(tokens, ""), ""), lambda c: c != "")


def _forms(tokens: Column) -> Column:
    """Tokens with all forms of the first names that they may stand for."""
    from .entities import _FORMS

    table = F.create_map(*[x for k, v in _FORMS.items() for x in (F.lit(k), F.array(*map(F.lit, sorted(v))))])
    return F.array_distinct(F.flatten(F.transform(tokens, lambda t: F.array_append(F.coalesce(table[t], F.array().cast("array<string>")), t))))


def keys(names: DataFrame, t: float, kinds: str, left: bool) -> DataFrame:
    """_id, _kind, _key, _w (weight), _most (weight of the rarest keys that may find no partner) of names (_id, _n)."""
    gone = lambda least: 1 - least / (2 - least)
    floor = lambda c: F.floor(c + 1e-9).cast("double")
    size, toks, dotless = F.length("_n"), _tokens(F.col("_n")), _tokens(F.regexp_replace("_n", r"\.", " "))
    removed = floor(gone(t) * size)
    rows = names.select("_id", "_n", toks.alias("_t"), dotless.alias("_d"), removed.alias("_k"))
    rows = rows.withColumns({"_g": _numbered(_pairs_of_letters(F.col("_t"))), "_l": _numbered(_letters(F.col("_t")))})
    once = F.array_distinct("_t")  # a measure may take repeated tokens once
    twice, more = F.size("_g") - F.size(_pairs_of_letters(once)), F.size("_l") - F.size(_letters(once))
    one, void = F.lit(1.0), F.size("_g") - twice - 2 * F.col("_k") <= 0
    wide = _forms(F.col("_t"))
    others = F.filter("_d", lambda y: F.length(y) == 1) if left else F.col("_d")
    initial = F.flatten(F.transform("_d", lambda x: F.transform(others, lambda y: F.concat(x, F.lit("|"), F.substring(y, 1, 1)))))
    cut = floor(gone(min(0.999, t / PARTIAL_WEIGHT)) * F.length("_n"))
    made = {
        "g": (F.col("_g"), lambda k: one, 2 * F.col("_k") + twice),
        "l": (F.when(void, F.col("_l")), lambda k: one, F.col("_k") + more),
        "t": (F.array_distinct("_t"), lambda k: F.length(k) + 1.0, gone(t) * F.length("_n") + 1e-9),
        "d": (F.array_distinct("_d"), lambda k: one, floor((1 - t) * F.size("_d"))),
        "i": (F.array_distinct(initial), lambda k: one, F.lit(1e9)),
        "n": (wide, lambda k: one, F.size(wide) - F.ceil(t * F.size(wide) - 1e-9).cast("double")),
        "p": (F.col("_g"), lambda k: one, 2 * cut),
        "v": (F.col("_l"), lambda k: one, F.when(F.size("_g") <= 2 * cut, cut).otherwise(-1)),
    }
    parts = []
    for kind in kinds:
        found, weight, most = made[kind]
        parts.append(rows.select("_id", F.lit(kind).alias("_kind"), F.explode(found).alias("_key"), most.cast("double").alias("_most")).withColumn("_w", weight(F.col("_key"))))
    return reduce(DataFrame.unionByName, parts)


def _lost(n: int, m: int, t: float) -> tuple[int, int] | None:
    """How many letters a left name of n and a right one of m letters may lose for an indel ratio of t; None if no pair reaches it."""
    most = math.floor((1 - t) * (n + m) + 1e-9)
    if abs(n - m) > most:
        return None
    most -= (most - n - m) % 2  # what is lost is odd when the lengths add up to an odd number
    return (most + n - m) // 2, (most + m - n) // 2


def pieces(name: str, others: list[int], t: float, left: bool) -> set[str]:
    """The keys by which a name meets all names, of `others` letters, whose indel ratio with it is t or more. A key names the left name's
    length, in how many pieces it is cut, which piece it is of, and the letters kept."""
    found = set()
    kept = lambda text, gone: map("".join, combinations(text, len(text) - gone))
    for other in others:
        n, m = (len(name), other) if left else (other, len(name))
        lost = _lost(n, m, t)
        if lost is None:
            continue
        many = sum(lost) // 3 + 1
        each = sum(lost) // many
        for k in range(many):
            start, end, mark = n * k // many, n * (k + 1) // many, f"{n}.{many}.{k}."
            for a in range(min(each, lost[0], end - start) + 1):
                if many == 1 and a < lost[0]:  # of a whole name as many letters are taken off as may be
                    continue
                if left:
                    found.update(mark + z for z in kept(name[start:end], a))
                    continue
                for b in range(min(each - a, lost[1]) + 1):
                    size = end - start - a + b
                    first, last = max(0, start - lost[0]), min(m - size, start + lost[1])
                    first, last = (max(first, m - size) if k == many - 1 else first), (min(last, 0) if k == 0 else last)
                    for at in range(first, last + 1):
                        found.update(mark + z for z in kept(name[at : at + size], b))
    return found


def _by_pieces(left: DataFrame, right: DataFrame, t: float) -> DataFrame:
    """_na, _nb: pairs of different names (_n), of LONGEST letters at most, that may have an indel ratio of t."""
    short = [side.where(F.length("_n") <= LONGEST) for side in (left, right)]
    sizes = [sorted(r[0] for r in side.select(F.length("_n")).distinct().collect()) for side in short]  # LONGEST numbers at most

    def cut(others: list[int], is_left: bool):
        @F.pandas_udf("array<string>")
        def made(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for names in batches:
                yield pd.Series([list(pieces(n, others, t, is_left)) for n in names])

        return made

    told = [
        side.select(F.col("_n").alias(name), F.explode(cut(others, is_left)("_n")).alias("_k")).select(name, F.xxhash64("_k").alias("_k"))
        for is_left, side, name, others in zip((True, False), short, ("_na", "_nb"), sizes[::-1])
    ]
    return told[0].join(told[1], "_k").select("_na", "_nb").distinct()


def _by_keys(left: DataFrame, right: DataFrame, t: float, kinds: str) -> DataFrame:
    """_na, _nb: pairs of different names (_n) that share a key of one of the kinds."""
    told = [keys(side.select(F.col("_n").alias("_id"), "_n"), t, kinds, k == 0) for k, side in enumerate((left, right))]
    often = told[0].unionByName(told[1]).groupBy("_kind", "_key").agg(F.count(F.lit(1)).alias("_often"))
    before = Window.partitionBy("_id", "_kind").orderBy("_often", "_key").rowsBetween(Window.unboundedPreceding, -1)
    rare = [k.join(often, ["_kind", "_key"]).withColumn("_rare", F.coalesce(F.sum("_w").over(before), F.lit(0.0)) <= F.col("_most")) for k in told]
    either = F.col("_kind").isin(*ONE_SIDED)
    a, b = (x.where(F.col("_rare") | either).select("_kind", "_key", F.col("_id").alias(f"_n{name}"), F.col("_rare").alias(f"_{name}")) for x, name in zip(rare, "ab"))
    return a.join(b, ["_kind", "_key"]).where("_a or _b").select("_na", "_nb").distinct()


def similar_names(left: DataFrame, right: DataFrame, least: float = 0.85, measure=name_score) -> DataFrame:
    """a, b, name_score: all pairs of names (id, name; normalised, '' and null names have no pair) of `left` and `right` that the
    measure scores at `least` or more; for persons' names it must be above 0.8, what initials alone make."""
    kinds = KINDS[measure]
    if "i" in kinds and least <= 0.8:
        raise ValueError("initials alone score 0.8: nothing finds such pairs")
    shared_checkpoints(left.sparkSession)
    kept = lambda side: side.where("name <> ''").select(F.col("id").alias("_id"), F.col("name").alias("_n")).checkpoint()  # noqa: E731  names are made once
    sides = [kept(left)]
    sides.append(sides[0] if right is left else kept(right))
    names = [side.select("_n").distinct() for side in sides]
    if measure is indel_ratio:
        pairs = _by_pieces(*names, least)
        if any((side.agg(F.max(F.length("_n"))).first()[0] or 0) > LONGEST for side in sides):
            near = least / (2 - least) * LONGEST - 1e-9  # what a longer name may meet
            long = _by_keys(*(side.where(F.length("_n") >= near) for side in names), least, kinds)
            pairs = pairs.unionByName(long.where((F.greatest(F.length("_na"), F.length("_nb")) > LONGEST) & (F.least(F.length("_na"), F.length("_nb")) * 2 >= least * (F.length("_na") + F.length("_nb")) - 1e-9)))
    else:
        pairs = _by_keys(*names, least, kinds)
    scored = with_score(pairs, "_na", "_nb", measure).where(F.col("name_score") >= least)
    return scored.join(sides[0].toDF("a", "_na"), "_na").join(sides[1].toDF("b", "_nb"), "_nb").select("a", "b", "name_score")


def within(names: DataFrame, least: float, measure=indel_ratio) -> DataFrame:
    """a, b, name_score: the same within one table (id, name), each pair once, the smaller id first; the measure is symmetric."""
    return similar_names(names, names, least, measure).where("a < b")


def sorted_tokens(name: Column) -> Column:
    """A normalised name with its tokens in order."""
    return F.array_join(F.array_sort(_tokens(X.normalise_name(name))), " ")
