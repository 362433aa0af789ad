"""Scalar functions as Column expressions: text, sets, vectors, time, scores."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C


def any_of(text: Column, patterns: list[str]) -> Column:
    """True if any pattern occurs (case as the patterns say)."""
    return reduce(lambda a, b: a | b, (text.rlike(p) for p in patterns), F.lit(False))


def hits(text: Column, patterns: list[str]) -> Column:
    """How many of the patterns occur."""
    return reduce(lambda a, b: a + b, (text.rlike(p).cast("int") for p in patterns), F.lit(0))


def words_found(text: Column, words: list[str]) -> Column:
    """How many of the plain words occur as substrings of the lower-cased text."""
    found = lambda t: reduce(lambda a, b: a + b, (t.contains(w).cast("int") for w in words), F.lit(0))
    return F.transform(F.array(F.lower(text)), found)[0]  # the text is lower-cased once


def first_match(text: Column, banks: dict[str, list[str]], otherwise: str | None = None) -> Column:
    """The first key any of whose patterns occurs."""
    out = F.lit(otherwise)
    for name, patterns in reversed(list(banks.items())):
        if patterns:
            out = F.when(any_of(text, patterns), name).otherwise(out)
    return out


def most_hits(text: Column, banks: dict[str, list[str]], otherwise: str | None = None) -> Column:
    """The key with most patterns found, the first among equals; `otherwise` if none is found."""
    counts = {name: hits(text, patterns) for name, patterns in banks.items()}
    best = F.greatest(*counts.values())
    out = F.lit(otherwise)
    for name in reversed(list(counts)):
        out = F.when((counts[name] == best) & (best > 0), name).otherwise(out)
    return out


def tokens(text: Column) -> Column:
    """Lower-case ASCII words and numbers that stand alone."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), 1), lambda x: x.rlike("^[a-z0-9]+$"))


def query_terms(query: list[str]) -> list[str]:
    """The distinct tokens() of a query's strings, in order."""
    return list(dict.fromkeys(t for q in query for t in re.findall(r"[^\W]+", q.lower()) if re.fullmatch("[a-z0-9]+", t)))


def long_words(text: Column, least: int = 4) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), 1), lambda x: F.length(x) >= least))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct elements; 0 if either set is empty."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / either).otherwise(F.lit(0.0))


def sentences(text: Column) -> Column:
    return F.split(text, r"(?<=[.!?])\s+")


def strip_html(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]+>", " "), r"\s+", " "))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, never below 0."""
    return F.greatest(F.lit(0.0), dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))))


def stub_embedding(text: Column, buckets: int = 64, most: int = 128) -> Column:
    """Unit vector of character codes: code i of the first `most` characters goes to bucket i mod `buckets`."""
    head = F.substring(text, 1, most)
    code = lambda i: F.ascii(F.substr(head, i, F.lit(1))).cast("double")  # noqa: E731  0 beyond the end
    sums = F.transform(F.sequence(F.lit(1), F.lit(buckets)), lambda k: sum((code(k + n) for n in range(buckets, most, buckets)), code(k)))
    norm = lambda s: F.sqrt(F.aggregate(s, F.lit(0.0), lambda t, x: t + x * x))
    unit = F.transform(F.array(sums), lambda s: F.transform(F.array(norm(s)), lambda n: F.transform(s, lambda x: F.when(n > 0, x / n).otherwise(0.0)))[0])  # each is computed once
    return unit[0]


def days_between(later: Column, earlier: Column) -> Column:
    """Whole days, rounded down for negative spans too; parts of a second count."""
    return F.floor((F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 86_400_000_000)


def recency(age_days: Column, days: float = C.RECENCY_DAYS) -> Column:
    return F.exp(-F.coalesce(age_days, F.lit(9999)) / days)


def freshness(age_days: Column, half_life: float = 90.0) -> Column:
    return F.coalesce(F.exp(-age_days * F.log(F.lit(2.0)) / half_life), F.lit(0.5))


def authority(source_type: Column, senior: Column | None = None) -> Column:
    base = F.coalesce(F.create_map(*[F.lit(x) for kv in C.SOURCE_AUTHORITY.items() for x in kv])[source_type], F.lit(C.SOURCE_AUTHORITY["unknown"]))
    return base if senior is None else F.least(F.lit(1.0), base + F.when(senior, 0.15).otherwise(0.0))


def importance(text: Column, high: list[str] = C.HIGH_IMPORTANCE, medium: list[str] = C.MEDIUM_IMPORTANCE) -> Column:
    return F.least(F.lit(1.0), (2 * words_found(text, high) + words_found(text, medium)) / 28.0)


def urgency(days_left: Column) -> Column:
    out = F.lit(0.15)
    for most, score in reversed(C.URGENCY_STEPS):
        out = F.when(days_left <= most, score).otherwise(out)
    return F.when(days_left.isNull(), 0.1).when(days_left < 0, 1.0).otherwise(out)


def silence_penalty(days: Column, steps: list[tuple[int, float]] = C.SILENCE_PENALTIES) -> Column:
    """The penalty of the deepest step reached."""
    out = F.lit(0.0)
    for least, penalty in steps:
        out = F.when(days >= least, penalty).otherwise(out)
    return out


def band(score: Column, bands: list[tuple[str, float]]) -> Column:
    out = F.lit(bands[-1][0])
    for name, least in reversed(bands[:-1]):
        out = F.when(score >= least, name).otherwise(out)
    return out


def normalise_email(e: Column) -> Column:
    return F.lower(F.trim(e))


def email_domain(e: Column) -> Column:
    return F.regexp_replace(F.split(normalise_email(e), "@")[1], "^www\\.", "")


def _bare_letters() -> tuple[str, str]:
    """Lower-case Latin letters with marks, and the same without: what canonical decomposition takes off, and stroked letters."""
    found = {chr(c): unicodedata.normalize("NFD", chr(c))[0] for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)] if chr(c).islower()}
    found = {c: plain for c, plain in found.items() if c != plain and plain.isascii()} | {"\u0142": "l", "\u00f8": "o", "\u0111": "d"}
    return "".join(found), "".join(found.values())


_MARKED, _BARE = _bare_letters()


def normalise_name(name: Column) -> Column:
    """Marks off Latin letters, lower case; word characters of any script, @ . and - stay, others are blanks; white space squeezed."""
    plain = F.regexp_replace(F.translate(F.lower(name), _MARKED, _BARE), "[\u0300-\u036f]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"(?U)[^\w\s@.\-]", " "), r"\s+", " "))


def company_key(name: Column) -> Column:
    """Normalised name without legal suffixes."""
    bare = F.regexp_replace(normalise_name(name), r"\b(" + "|".join(C.LEGAL_SUFFIXES) + r")\b\.?", "")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def same_first_name(token: Column) -> Column:
    """A short form's full first name, or the token itself."""
    pairs = [F.lit(x) for full, shorts in C.NICKNAMES.items() for s in shorts for x in (s, full)]
    return F.coalesce(F.create_map(*pairs)[token], token)


def nickname_likeness(a: Column, b: Column) -> Column:
    """Jaccard of two names' tokens, each with all forms of the first name it may stand for."""
    forms = {f: sorted({full, *shorts}) for full, shorts in C.NICKNAMES.items() for f in (full, *shorts)}
    table = F.create_map(*[x for k, v in forms.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    wide = lambda n: F.array_distinct(F.flatten(F.transform(F.split(n, r"\s+"), lambda t: F.concat(F.array(t), F.coalesce(table[t], F.array().cast("array<string>"))))))
    return jaccard(wide(a), wide(b))


def snippet(text: Column, most: int | Column, after_stop: str = " \u2026", after_cut: str = " \u2026") -> Column:
    """The first `most` characters, back to the last full stop if it lies in the second half; a mark shows the cut."""
    most = F.lit(most) if isinstance(most, int) else most
    head = text.substr(F.lit(1), most)
    stop = F.length(head) - F.instr(F.reverse(head), ".") + 1
    kept = F.when((F.instr(head, ".") > 0) & (stop - 1 > F.floor(most / 2)), F.concat(head.substr(F.lit(1), stop), F.lit(after_stop))).otherwise(F.concat(head, F.lit(after_cut)))
    return F.when(F.length(text) <= most, text).otherwise(kept)


def summarised(text: Column, tokens: Column) -> Column:
    """A text cut to a number of tokens (4 characters each)."""
    return snippet(text, (tokens * 4).cast("int"), " [summarised]", "\u2026 [summarised]")


def date_label(ts: Column, unknown: str = "unknown date") -> Column:
    return F.coalesce(F.date_format(ts, "MMM dd, yyyy"), F.lit(unknown))


def tie(linked: Column, mentioned_in: Column, focus: list[str] | None) -> Column:
    """Strength of a row's tie to the entities in focus: linked ids first, then names in the metadata."""
    if not focus:
        return F.lit(C.TIE_UNKNOWN)
    direct = F.coalesce(F.arrays_overlap(linked, F.array(*map(F.lit, focus))), F.lit(False))
    named = reduce(lambda a, b: a | b, (F.coalesce(F.lower(mentioned_in).contains(f.lower().replace("_", " ")), F.lit(False)) for f in focus))
    return F.when(direct, C.TIE_DIRECT).when(named, C.TIE_MENTIONED).otherwise(C.TIE_NONE)


def participants(text: Column, *known: Column, most: int = 5) -> Column:
    """Names: the given arrays first, then capitalised two-word names of the text, each once."""
    found = F.regexp_extract_all(text, F.lit(r"\b([A-Z][a-z]+ [A-Z][a-z]+)\b"), 1)
    return F.slice(F.array_distinct(F.concat(*[F.coalesce(k, F.array().cast("array<string>")) for k in known], found)), 1, most)


def revenue(text: Column, impact: Column) -> Column:
    """0..1: the first sign of the ladder if any revenue word occurs, else the company's impact."""
    t = F.lower(text)
    ladder = F.lit(C.REVENUE_OTHER)
    for pattern, score in reversed(C.REVENUE_LADDER):
        ladder = F.when(t.rlike(pattern), score).otherwise(ladder)
    by_impact = F.coalesce(F.create_map(*[F.lit(x) for kv in C.REVENUE_BY_IMPACT.items() for x in kv])[impact], F.lit(C.REVENUE_NONE))
    return F.when(words_found(t, C.REVENUE_WORDS) > 0, ladder).otherwise(by_impact)


def relationship_importance(text: Column, rank: Column) -> Column:
    by_rank = F.coalesce(F.create_map(*[F.lit(x) for kv in C.IMPORTANCE_BY_RANK.items() for x in kv])[rank], F.lit(C.IMPORTANCE_NONE))
    return F.when(words_found(text, C.KEY_RELATIONSHIP_WORDS) > 0, C.KEY_RELATIONSHIP).otherwise(by_rank)


def ceo_involvement(text: Column, mentioned: Column, forwarded: Column) -> Column:
    return F.when((words_found(text, C.CEO_WORDS) > 0) | F.coalesce(mentioned, F.lit(False)), 1.0).when(F.coalesce(forwarded, F.lit(False)), 0.8).otherwise(0.0)


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4)


def content_hash(body: Column) -> Column:
    return F.sha2(body, 256)


def document_hash(source_type: Column, source_id: Column, title: Column, content: Column, created_at: Column) -> Column:
    """sha256 of the five fields as JSON with sorted keys, the content cut to 1000 characters; beyond ASCII, characters stand as they are."""
    said = lambda c: F.when(c.isNull(), "null").otherwise(F.regexp_replace(F.to_json(F.array(c.cast("string"))), r"^\[|\]$", ""))
    fields = {"content": F.substring(content, 1, 1000), "created_at": created_at, "source_id": source_id, "source_type": source_type, "title": title}
    parts = [F.concat(F.lit(f'"{name}": '), said(c)) for name, c in fields.items()]
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")), 256)

