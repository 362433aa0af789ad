"""Identity resolution, merging, and quality checks of stored entities."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import columns as X


def indel_ratio(a: str, b: str) -> float:
    """Normalised indel similarity: twice the longest common subsequence over both lengths, by bit-parallel rows."""
    if not a and not b:
        return 1.0
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & at.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return 2 * (len(a) - row.bit_count()) / (len(a) + len(b))


def token_sort(a: str, b: str) -> float:
    """The names with their tokens in order."""
    return indel_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a: str, b: str) -> float:
    """The best of: shared tokens against either name, and the names behind their shared tokens; 1 if one name's tokens are all in the other."""
    ta, tb = {*a.split()}, {*b.split()}
    if not ta or not tb:
        return 0.0
    shared, only_a, only_b = sorted(ta & tb), sorted(ta - tb), sorted(tb - ta)
    if shared and not (only_a and only_b):
        return 1.0
    base, x, y = " ".join(shared), " ".join([*shared, *only_a]), " ".join([*shared, *only_b])
    return max(indel_ratio(x, y), indel_ratio(base, x), indel_ratio(base, y)) if shared else indel_ratio(x, y)


def plain_score(a: str, b: str) -> float:
    return max(indel_ratio(a, b), token_sort(a, b), token_set(a, b))


def initials_score(a: str, b: str) -> float:
    """Tokens found in the other name over the longer name's tokens; an initial counts 0.8. Full stops don't count."""
    ta, tb = a.replace(".", " ").split(), b.replace(".", " ").split()
    if not ta or not tb:
        return 0.0
    found = 0.0
    for x in ta:
        for y in tb:
            if len(x) == 1 and y.startswith(x):
                found += 0.8
                break
            if x == y:
                found += 1.0
                break
    return found / max(len(ta), len(tb))


_FORMS = {form: {full, *shorts} for full, shorts in C.NICKNAMES.items() for form in (full, *shorts)}


def nickname_score(a: str, b: str) -> float:
    """Jaccard of the tokens with all forms of the first names they may stand for."""
    wide = lambda name: set().union(*({t} | _FORMS.get(t, set()) for t in name.split())) if name.split() else set()
    x, y = wide(a), wide(b)
    return len(x & y) / len(x | y) if x and y else 0.0


def name_score(a: str, b: str) -> float:
    """Persons' names: the best of five measures."""
    return max(plain_score(a, b), initials_score(a, b), nickname_score(a, b))


def with_score(pairs: DataFrame, a: str, b: str, measure=name_score) -> DataFrame:
    """Adds name_score by a measure of two names, in Arrow batches; blocking comes before."""

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in batches:
            yield pd.Series([measure(p or "", q or "") for p, q in zip(x, y)])

    return pairs.withColumn("name_score", score(F.col(a), F.col(b)))


def _told(name: str) -> tuple[str, str, tuple[str, ...], tuple[str, ...]]:
    """The tokens in order, the distinct ones in order, and what a name meets another by, as the left one and as the right one: if
    nothing of it is shared, no token, initial or form of a first name is."""
    tokens, dotless = name.split(), name.replace(".", " ").split()
    wide = {*tokens, *dotless}.union(*(_FORMS.get(t, ()) for t in tokens))
    left = (*wide, *(f"{x}*" for x in dotless if len(x) == 1))
    return " ".join(sorted(tokens)), " ".join(sorted({*tokens})), left, (*wide, *{f"{y[0]}*" for y in dotless})


def _common(xs: list[str], ys: list[str]) -> np.ndarray:
    """Lengths of the longest common subsequences, a row for each of ys, by bit-parallel rows of all xs (64 letters at most) at once.
    In the order of ys each begins with the rows of the letters that it shares with the one before."""
    codes = np.array(xs, "U")
    codes = codes.view(np.uint32).reshape(len(xs), -1) if codes.dtype.itemsize else np.zeros((len(xs), 0), np.uint32)
    kind = np.uint32 if codes.shape[1] <= 32 else np.uint64
    hits = {}
    for c in {*"".join(ys)}:
        hits[c] = np.zeros(len(xs), kind)
        for i in range(codes.shape[1]):
            hits[c] |= (codes[:, i] == ord(c)).astype(kind) << kind(i)
    rows = np.empty((max(map(len, ys), default=0) + 1, len(xs)), kind)
    rows[0] = np.iinfo(kind).max
    hit, out, before = np.empty(len(xs), kind), np.empty((len(ys), len(xs)), np.uint8), ""
    for k in sorted(range(len(ys)), key=ys.__getitem__):
        y, same = ys[k], 0
        while same < min(len(y), len(before)) and y[same] == before[same]:
            same += 1
        for d in range(same, len(y)):
            np.bitwise_and(rows[d], hits[y[d]], out=hit)
            np.add(rows[d], hit, out=rows[d + 1])
            np.subtract(rows[d], hit, out=hit)
            rows[d + 1] |= hit
        out[k], before = np.bitwise_count(~rows[len(y)]), y
    return out


def name_scores(left: list[str], right: list[str], known: dict | None = None) -> np.ndarray:
    """name_score of each of left (a row) with each of right. Names that share no token, initial or form are scored by their longest
    common subsequences, all at once; the others, and what is longer than 64 letters, one by one. `known` keeps what some thousand
    names are told by from call to call."""
    known = {} if known is None else known
    if len(known) > 1 << 14:
        known.clear()
    best = np.zeros((len(right), len(left)))
    hard = [[k for k, x in enumerate(names) if len(x) > 64 or "\0" in x] for names in (left, right)]
    if any(hard):
        easy = [sorted({*range(len(names))}.difference(h)) for names, h in zip((left, right), hard)]
        best[np.ix_(easy[1], easy[0])] = name_scores([left[i] for i in easy[0]], [right[j] for j in easy[1]], known).T
        for i, j in {*((i, j) for i in hard[0] for j in range(len(right))), *((i, j) for j in hard[1] for i in range(len(left)))}:
            best[j, i] = name_score(left[i], right[j])
    if any(hard) or not best.size:
        return best.T
    a, b = ([known[x] if x in known else known.setdefault(x, _told(x)) for x in names] for names in (left, right))
    forms = [(left, right), ([x[0] for x in a], [y[0] for y in b]), ([x[1] for x in a], [y[1] for y in b])]
    for k, (xs, ys) in enumerate(forms):
        if k and (xs, ys) == forms[k - 1]:
            continue
        both = np.add.outer(np.fromiter(map(len, ys), float, len(ys)), np.fromiter(map(len, xs), float, len(xs)))
        with np.errstate(invalid="ignore"):
            ratio = np.multiply(_common(xs, ys), 2.0) / both
        if k == 0:
            ratio[both == 0] = 1.0
        np.fmax(best, ratio, out=best)
    where: dict[str, list[int]] = {}
    for j, y in enumerate(b):
        for key in y[3]:
            where.setdefault(key, []).append(j)
    for i, x in enumerate(a):
        met = {j for key in x[2] if key in where for j in where[key]}
        for j in met:
            best[j, i] = name_score(left[i], right[j])
    return best.T


def _with_scores(pairs: DataFrame, a: str, b: str) -> DataFrame:
    @F.arrow_udf("array<double>")
    def score(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        known: dict = {}
        for x, y in batches:
            y = y.fill_null([]) if y.null_count else y
            names, sizes, flat = x.to_pylist(), y.value_lengths().to_numpy(zero_copy_only=False), y.flatten()
            ends = np.cumsum(sizes)
            out = np.empty(len(flat))
            at, sames = 0, []
            for i in range(1, len(names) + 1):  # neighbours that meet the same names
                if i == len(names) or not flat.slice(ends[i] - sizes[i], sizes[i]).equals(flat.slice(ends[at] - sizes[at], sizes[at])):
                    sames.append((at, i))
                    at = i
            for i, j in sames:
                if sizes[i]:
                    others = flat.slice(ends[i] - sizes[i], sizes[i]).to_pylist()
                    out[ends[i] - sizes[i] : ends[j - 1]] = name_scores([n or "" for n in names[i:j]], [n or "" for n in others], known).ravel()
            yield pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(out))

    return pairs.withColumn("name_score", score(F.col(a), F.col(b)))


def with_name_score(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Adds name_score. Where b is an array of names, the scores are one too: many at once, most of all where rows with equal arrays
    come one after another."""
    return _with_scores(pairs, a, b) if pairs.schema[b].dataType.typeName() == "array" else with_score(pairs, a, b)


def resolve(mentions: DataFrame, entities: DataFrame, aliases: DataFrame, least: float = 0.85) -> DataFrame:
    """mention_id, name, email -> entity_id, stage, score. E-mail first, then alias, then fuzzy names, of which no pair above `least` is lost; each stage sees what the earlier ones left."""
    m = mentions.withColumns({"_e": X.normalise_email(F.col("email")), "_n": X.normalise_name(F.col("name"))})
    ent = entities.withColumns({"_ee": X.normalise_email(F.col("email")), "_en": X.normalise_name(F.col("name"))})
    by_mail = m.where("_e <> ''").join(ent.where("_ee <> ''").groupBy(F.col("_ee").alias("_e")).agg(F.min("entity_id").alias("entity_id")), "_e").select("mention_id", "entity_id", F.lit("email").alias("stage"), F.lit(1.0).alias("score"))
    left = m.join(by_mail, "mention_id", "left_anti")
    alias = aliases.groupBy(X.normalise_name(F.col("alias")).alias("_n")).agg(F.min("entity_id").alias("entity_id"), F.max("confidence").alias("score"))
    by_alias = left.where("_n <> ''").join(alias, "_n").select("mention_id", "entity_id", F.lit("alias").alias("stage"), "score")
    left, ent = left.join(by_alias, "mention_id", "left_anti").where("_n <> ''"), ent.where("_en <> ''")

    from .names import similar_names

    found = similar_names(left.select(F.col("mention_id").alias("id"), F.col("_n").alias("name")), ent.select(F.col("entity_id").alias("id"), F.col("_en").alias("name")), least)
    scored = found.toDF("mention_id", "entity_id", "name_score")
    w = Window.partitionBy("mention_id").orderBy(F.desc("name_score"), "entity_id")
    fuzzy = scored.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("mention_id", "entity_id", F.lit("fuzzy").alias("stage"), F.col("name_score").alias("score"))
    return by_mail.unionByName(by_alias).unionByName(fuzzy)


def partial_ratio(a: str, b: str) -> float:
    """The shorter name against the best stretch of its length in the longer one; stretches may stick out at both ends."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return float(not b)
    n = len(a)
    return max(indel_ratio(a, b[max(0, i) : i + n]) for i in range(1 - n, len(b)))


def company_score(a: str, b: str) -> float:
    """Companies' names: as they are, and the partial ratio at a discount."""
    return max(plain_score(a, b), C.PARTIAL_WEIGHT * partial_ratio(a, b))


def _cascade(mentions: DataFrame, id_col: str, stages) -> DataFrame:
    """Each stage (a function of what is left) gives id, entity_id, stage, score; a mention leaves with its first stage. What a stage
    found and what it left are checkpointed, as the next stages read both."""
    from .graph import shared_checkpoints

    shared_checkpoints(mentions.sparkSession)
    out, left = None, mentions
    for stage in stages:
        found = stage(left).select(id_col, "entity_id", "stage", "score")
        best = Window.partitionBy(id_col).orderBy(F.desc("score"), "entity_id")
        found = found.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r").checkpoint()
        out = found if out is None else out.unionByName(found)
        left = left.join(found, id_col, "left_anti").checkpoint()
    return out


def resolve_companies(mentions: DataFrame, companies: DataFrame, aliases: DataFrame, least: float = C.COMPANY_LEAST) -> DataFrame:
    """mention_id, name, domain, short -> entity_id, stage, score: by domain, alias, known short form, then names alike (without
    legal suffixes). companies: entity_id, name, domain; aliases: alias, entity_id, confidence."""
    short = F.lower(F.trim("short"))
    m = mentions.withColumns({"_d": F.regexp_replace(F.lower(F.trim("domain")), r"^(www\.)", ""), "_n": X.company_key(F.col("name")), "_s": short})
    c = companies.withColumn("_cn", X.company_key(F.col("name"))).withColumnRenamed("domain", "_cd").select("entity_id", "_cn", "_cd")
    known = aliases.select(F.col("alias").alias("_a"), "entity_id", F.col("confidence").alias("score"))
    full = F.create_map(*[F.lit(x) for kv in C.COMPANY_SHORT.items() for x in kv])[F.col("_s")]

    from .names import similar_names

    def fuzzy(left):
        found = similar_names(left.select(F.col("mention_id").alias("id"), F.col("_n").alias("name")), c.select(F.col("entity_id").alias("id"), F.col("_cn").alias("name")), least, company_score)
        return found.toDF("mention_id", "entity_id", "score").withColumn("stage", F.lit("fuzzy"))

    return _cascade(m, "mention_id", [
        lambda left: left.where("_d <> ''").join(c, left["_d"] == c["_cd"]).withColumns({"stage": F.lit("domain"), "score": F.lit(1.0)}),
        lambda left: left.join(known, (left["_n"] == known["_a"]) & (left["_n"] != "")).withColumn("stage", F.lit("alias")).unionByName(left.join(known, (left["_s"] == known["_a"]) & (left["_s"] != "")).withColumn("stage", F.lit("alias"))),
        lambda left: left.withColumn("_f", full).join(c, F.col("_f") == c["_cn"]).withColumns({"stage": F.lit("abbreviation"), "score": F.lit(C.SHORT_CONFIDENCE)}),
        fuzzy,
    ])


def resolve_projects(mentions: DataFrame, projects: DataFrame, aliases: DataFrame, least: float = C.PROJECT_LEAST) -> DataFrame:
    """mention_id, name, code, company_id -> entity_id, stage, score: by short code, alias, then names alike, among the company's own
    projects where it has any. projects: entity_id, name, code, company_id."""
    m = mentions.withColumns({"_k": F.upper(F.trim("code")), "_n": X.normalise_name(F.col("name"))})
    p = projects.select("entity_id", X.normalise_name(F.col("name")).alias("_pn"), F.col("code").alias("_pk"), F.col("company_id").alias("_pc"))
    known = aliases.select(F.col("alias").alias("_a"), "entity_id", F.col("confidence").alias("score"))

    from .names import similar_names

    def fuzzy(left):
        owners = p.select(F.col("_pc").alias("company_id")).distinct().withColumn("_own", F.lit(True))
        left = left.where("_n <> ''").join(owners, "company_id", "left")
        found = similar_names(left.select(F.col("mention_id").alias("id"), F.col("_n").alias("name")), p.select(F.col("entity_id").alias("id"), F.col("_pn").alias("name")), least, plain_score)
        pairs = found.toDF("mention_id", "entity_id", "score").join(left.select("mention_id", "company_id", "_own"), "mention_id").join(p.select("entity_id", "_pc"), "entity_id")
        return pairs.where("_own is null or company_id = _pc").select("mention_id", "entity_id", F.lit("fuzzy").alias("stage"), "score")

    return _cascade(m, "mention_id", [
        lambda left: left.where("_k <> ''").join(p, left["_k"] == p["_pk"]).withColumns({"stage": F.lit("code"), "score": F.lit(1.0)}),
        lambda left: left.where("_n <> ''").join(known, left["_n"] == known["_a"]).withColumn("stage", F.lit("alias")),
        fuzzy,
    ])


def resolve_by_context(mentions: DataFrame, persons: DataFrame, least: float = C.PERSON_LEAST, weight: float = C.CONTEXT_WEIGHT) -> DataFrame:
    """What names alone leave open: mention_id, name, company_id, project_ids against persons of the same company or a shared
    project: name likeness plus `weight` for the company and for each of up to two projects, from least - weight on."""
    m = mentions.select("mention_id", X.normalise_name(F.col("name")).alias("_n"), F.col("company_id").alias("_mc"), F.coalesce("project_ids", F.array().cast("array<string>")).alias("_mp")).where("_n <> ''")
    p = persons.select("entity_id", X.normalise_name(F.col("name")).alias("_pn"), F.col("company_id").alias("_pc"), F.coalesce("project_ids", F.array().cast("array<string>")).alias("_pp"))
    by_company = m.join(p, m["_mc"] == p["_pc"])
    by_project = m.withColumn("_x", F.explode("_mp")).join(p.withColumn("_x", F.explode("_pp")), "_x").drop("_x")
    pairs = by_company.unionByName(by_project).dropDuplicates(["mention_id", "entity_id"])
    same = F.coalesce((F.col("_mc") == F.col("_pc")).cast("int"), F.lit(0))
    bonus = weight * same + weight * F.least(F.size(F.array_intersect("_mp", "_pp")), F.lit(2))
    scored = with_name_score(pairs, "_n", "_pn").withColumn("score", F.round(F.least(F.lit(1.0), F.col("name_score") + bonus), 6)).where(F.col("score") >= least - weight)
    best = Window.partitionBy("mention_id").orderBy(F.desc("score"), "entity_id")
    return scored.withColumn("_r", F.row_number().over(best)).where("_r = 1").select("mention_id", "entity_id", F.lit("context").alias("stage"), "score")


def boosted(resolved: DataFrame, mentions: DataFrame, persons: DataFrame) -> DataFrame:
    """Resolutions (mention_id, entity_id, score) raised where company or projects agree."""
    m = mentions.select("mention_id", F.col("company_id").alias("_mc"), F.coalesce("project_ids", F.array().cast("array<string>")).alias("_mp"))
    p = persons.select("entity_id", F.col("company_id").alias("_pc"), F.coalesce("project_ids", F.array().cast("array<string>")).alias("_pp"))
    rows = resolved.join(m, "mention_id", "left").join(p, "entity_id", "left")
    more = F.coalesce((F.col("_mc") == F.col("_pc")).cast("int"), F.lit(0)) * C.BOOST_COMPANY + C.BOOST_PROJECT * F.least(F.coalesce(F.size(F.array_intersect("_mp", "_pp")), F.lit(0)), F.lit(C.BOOST_PROJECTS))
    return rows.withColumn("score", F.round(F.least(F.lit(1.0), F.col("score") + more), 6)).select(*resolved.columns)


def resolve_persons(mentions: DataFrame, persons: DataFrame, aliases: DataFrame, least: float = C.PERSON_LEAST) -> DataFrame:
    """mention_id -> entity_id, stage, score, by the first stage that finds a canonical person: email_exact, email_array (0.98),
    email_alias, alias (of the name, then of the e-mail), fuzzy (names alike, among the persons of the mention's company where that has
    any, raised by company and projects), context.

    mentions: mention_id, name, email, company_id, project_ids; persons: entity_id, name, email, emails (array), company_id, project_ids,
    is_canonical; aliases: alias, alias_type, entity_id, confidence. Ties go to the higher score, then the smaller entity_id."""
    from .names import similar_names

    m = mentions.withColumns({"_e": X.normalise_email(F.col("email")), "_n": X.normalise_name(F.col("name"))})
    p = persons.where("is_canonical").withColumns({"_pe": X.normalise_email(F.col("email")), "_pn": X.normalise_name(F.col("name"))})
    known = aliases.join(p.select("entity_id"), "entity_id", "left_semi").select("alias_type", "entity_id", F.col("confidence").alias("score"), X.normalise_email(F.col("alias")).alias("_ae"), X.normalise_name(F.col("alias")).alias("_an"))
    others = p.select("entity_id", F.explode(F.transform("emails", X.normalise_email)).alias("_oe")).distinct()

    def fuzzy(left):
        left, named = left.where("_n <> ''"), p.where("_pn <> ''")
        owners = p.select(F.col("company_id")).where("company_id is not null").distinct().withColumn("_own", F.lit(True))
        found = similar_names(left.select(F.col("mention_id").alias("id"), F.col("_n").alias("name")), named.select(F.col("entity_id").alias("id"), F.col("_pn").alias("name")), least).toDF("mention_id", "entity_id", "score")
        pairs = found.join(left.join(owners, "company_id", "left").select("mention_id", "company_id", "_own"), "mention_id").join(p.select("entity_id", F.col("company_id").alias("_pc")), "entity_id")
        best = Window.partitionBy("mention_id").orderBy(F.desc("score"), "entity_id")
        first = pairs.where("_own is null or company_id = _pc").withColumn("_r", F.row_number().over(best)).where("_r = 1").select("mention_id", "entity_id", "score")
        return boosted(first, mentions, persons).withColumn("stage", F.lit("fuzzy"))

    said = lambda stage, **c: {"stage": F.lit(stage), **c}
    return _cascade(m, "mention_id", [
        lambda left: left.where("_e <> ''").join(p.select("entity_id", "_pe"), F.col("_e") == F.col("_pe")).withColumns(said("email_exact", score=F.lit(1.0))),
        lambda left: left.where("_e <> ''").join(others, F.col("_e") == F.col("_oe")).withColumns(said("email_array", score=F.lit(0.98))),
        lambda left: left.where("_e <> ''").join(known.where("alias_type = 'email'"), F.col("_e") == F.col("_ae")).withColumns(said("email_alias")),
        lambda left: left.where("_n <> ''").join(known, F.col("_n") == F.col("_an")).withColumns(said("alias")),
        lambda left: left.where("_e <> ''").join(known, F.col("_e") == F.col("_ae")).withColumns(said("alias")),
        fuzzy,
        lambda left: resolve_by_context(left.select("mention_id", "name", "company_id", "project_ids"), p.select("entity_id", "name", "company_id", "project_ids"), least),
    ])


def register_aliases(aliases: DataFrame, fresh: DataFrame) -> DataFrame:
    """Insert if absent, by normalised value."""
    key = X.normalise_name(F.col("alias"))
    known = aliases.select(key.alias("_k")).distinct()
    new = fresh.withColumn("_k", key).dropDuplicates(["_k"]).join(known, "_k", "left_anti").drop("_k")
    return aliases.unionByName(new)


def merge_entities(entities: DataFrame, mapping: DataFrame) -> DataFrame:
    """mapping: entity_id, canonical_id. Counters add up, e-mails unite, first and last sight widen."""
    mapped = entities.join(mapping, "entity_id", "left").withColumn("entity_id", F.coalesce("canonical_id", "entity_id"))
    return mapped.groupBy("entity_id").agg(F.min("name").alias("name"), F.array_sort(F.collect_set("email")).alias("emails"), F.sum("n_items").alias("n_items"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.count(F.lit(1)).alias("n_merged"))


def duplicates(rows: DataFrame, key, id_col: str) -> DataFrame:
    """Keys that several rows share."""
    return rows.withColumn("key", key).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(id_col).alias("first_id")).where("n > 1 and key is not null and key <> ''")


def missing(rows: DataFrame, known: DataFrame, col: str, key: str) -> DataFrame:
    """Rows whose reference isn't known (left anti)."""
    return rows.join(known.select(F.col(key).alias(col)), col, "left_anti")


def insert_new(current: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Idempotent insert: what isn't there yet, once."""
    return fresh.dropDuplicates(keys).join(current.select(*keys), keys, "left_anti")
