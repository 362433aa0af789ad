"""Text to rows: enrichment, sentences, chunkers, detectors' candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import columns as X


def enrich(docs: DataFrame, text_col: str = "text", least: int = 10) -> DataFrame:
    """Arrays and flags found in each text of at least `least` characters, each array sorted and capped."""
    t = F.col(text_col)

    def found(pattern: str, cap: int, group: int = 0):
        return F.slice(F.array_sort(F.array_distinct(F.regexp_extract_all(t, F.lit(pattern), group))), 1, cap)

    rows = docs.where(F.length(t) >= least)
    return rows.withColumns(
        {
            "emails": found(C.EMAIL, 50), "urls": found(C.URL, 50), "tickets": found(C.TICKET, 50), "dates": found(C.DATES, 50), "deadlines": found(C.DEADLINE, 20, 1),
            "organisations": found(C.ORGANISATION, 30), "phones": found(C.PHONE, 50), "word_count": F.size(F.split(F.trim(t), r"\s+")), "relative_dates": found(C.RELATIVE_TIME, 50),
            "meetings": found(C.MEETING, 20), "projects": found(C.PROJECT, 20, 1), "has_action_items": t.rlike(C.ACTION_ITEM), "has_commitments": t.rlike(C.PROMISE),
        }
    )


def deadlines_in_context(docs: DataFrame, id_col: str, text_col: str = "text", before: int = 30, cap: int = 20) -> DataFrame:
    """id, deadlines: (phrase, text, context of up to `before` characters to the left), in order of place, `cap` at most."""
    body = C.DEADLINE.replace("(?i)\\b", "", 1)
    wide = rf"(?i)(?s:(.{{0,{before}}}?))\b({body})"
    left, whole, said = (F.regexp_extract_all(F.col(text_col), F.lit(wide), k) for k in (1, 2, 3))
    rows = F.zip_with(F.zip_with(left, whole, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), said, lambda x, c: F.struct(x["b"].alias("phrase"), F.trim(c).alias("text"), x["a"].alias("context")))
    return docs.select(id_col, F.slice(rows, 1, cap).alias("deadlines")).where(F.size("deadlines") > 0)


def explode_sentences(docs: DataFrame, id_col: str, text_col: str = "text", least: int = 10) -> DataFrame:
    rows = docs.select(id_col, F.posexplode(X.sentences(F.col(text_col))).alias("pos", "sentence"))
    return rows.where(F.length("sentence") >= least)


def word_windows(docs: DataFrame, id_col: str, text_col: str = "text", size: int = 800, overlap: int = 100) -> DataFrame:
    """Windows of `size` words that start every size - overlap words."""
    words = F.split(F.trim(F.regexp_replace(F.col(text_col), r"\s+", " ")), " ")
    rows = docs.where(F.trim(F.col(text_col)) != "").select(id_col, words.alias("_w"))
    starts = F.sequence(F.lit(0), F.size("_w") - 1, F.lit(size - overlap))
    parts = rows.select(id_col, "_w", F.posexplode(starts).alias("chunk_index", "_s"))
    piece = F.slice("_w", F.col("_s") + 1, size)
    return parts.select(id_col, "chunk_index", F.size(piece).alias("n_words"), F.array_join(piece, " ").alias("content"))


def headed_sections(docs: DataFrame, id_col: str, text_col: str, patterns: list[str] = C.HEADINGS, least: int = 30, first: str = "Introduction") -> DataFrame:
    """Sections that start at heading lines; text before the first is `first`; short bodies go. Lines keep their order, so this works for agendas and clauses too."""
    lines = docs.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("pos", "line"))
    return _sections(lines, id_col, patterns, least, first)


def _sections(lines: DataFrame, id_col: str, patterns: list[str], least: int, first: str) -> DataFrame:
    w = Window.partitionBy(id_col).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    heads = lines.withColumn("_h", X.any_of(F.col("line"), patterns)).withColumn("section", F.sum(F.col("_h").cast("int")).over(w))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("_h"), F.struct("pos", "line")))), lambda x: x["line"]), "\n")
    title = F.coalesce(F.max(F.when(F.col("_h"), F.regexp_replace("line", r"^#+\s*", ""))), F.lit(first))
    return heads.groupBy(id_col, "section").agg(title.alias("title"), F.trim(body).alias("body")).where(F.length("body") >= least)


def email_turns(mails: DataFrame, id_col: str, text_col: str, least: int = 20) -> DataFrame:
    """A mail's turns: split at forward marks and at 'On ... wrote:' lines."""
    marked = F.regexp_replace(F.col(text_col), r"(?mi)(-{6,}\s*Forwarded\s+message\s*-{6,}|^-{3,}\s*Forwarded message\s*-{3,}\s*$|^On .{5,100} wrote:\s*$)", "\u0001")
    rows = mails.select(id_col, F.posexplode(F.split(marked, "\u0001")).alias("turn", "content"))
    return rows.withColumn("content", F.regexp_replace("content", r"^\s+|\s+$", "")).where(F.length("content") >= least)


def marked_sections(docs: DataFrame, id_col: str, text_col: str, patterns: list[str], titles: tuple[str, str], least: int) -> DataFrame:
    """id, section, title, content: what follows each place that a pattern finds, with the place's own words as title; what stands
    before the first place, and a text without any, get the given titles. Short ones go."""
    places = "(?m)(" + "|".join(f"(?:{p})" for p in patterns) + ")"
    parts = F.split(F.regexp_replace(F.col(text_col), places, "\u0001$1\u0002"), "\u0001")
    rows = docs.where(F.trim(text_col) != "").select(id_col, F.size(parts).alias("_n"), F.posexplode(parts).alias("section", "_p"))
    head = F.when(F.col("section") > 0, F.trim(F.substring_index("_p", "\u0002", 1))).when(F.col("_n") == 1, titles[1]).otherwise(titles[0])
    body = F.when(F.col("section") > 0, F.expr("substring(_p, instr(_p, '\u0002') + 1)")).otherwise(F.col("_p"))
    return rows.select(id_col, "section", head.alias("title"), F.regexp_replace(body, r"^\s+|\s+$", "").alias("content")).where(F.length("content") >= least)


def in_windows(sections: DataFrame, keys: list[str], size: int, overlap: int) -> DataFrame:
    """Contents of over `size` words as windows (part, whole words), others as they are (part 0)."""
    words = F.split(F.trim(F.regexp_replace("content", r"\s+", " ")), " ")
    starts = F.when(F.size("_w") <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.size("_w") - 1, F.lit(size - overlap)))
    rows = sections.withColumn("_w", words).select(*keys, "content", "_w", F.posexplode(starts).alias("part", "_s"))
    piece = F.when(F.size("_w") <= size, F.col("content")).otherwise(F.array_join(F.slice("_w", F.col("_s") + 1, size), " "))
    return rows.select(*keys, "part", (F.size("_w") > size).alias("windowed"), piece.alias("content"))


def chunk(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", type_col: str = "source_type") -> DataFrame:
    """Each document by the chunker of its source type: id, chunk_index, strategy, title, is_key, content. Mails by turn, meeting
    notes by agenda, contracts by clause, documents by heading, all others by sliding windows; what is too long goes in windows, and
    a text other than a mail that yields nothing falls back to windows. is_key: an action, a decision, or a clause that must not be missed."""
    keys, none = [id_col, "_type", "section", "title"], F.lit(None).cast("string")
    rows = docs.select(id_col, F.col(text_col).alias("_t"), F.col(type_col).alias("_type")).where(F.trim("_t") != "")
    mail = email_turns(rows.where("_type = 'email'"), id_col, "_t").select(id_col, F.lit("email").alias("_type"), F.col("turn").alias("section"), none.alias("title"), "content")
    notes = marked_sections(rows.where("_type = 'meeting_notes'"), id_col, "_t", C.AGENDA, C.MEETING_TITLES, C.MEETING_LEAST).withColumn("_type", F.lit("meeting_notes"))
    deal = marked_sections(rows.where("_type = 'contract'"), id_col, "_t", C.CLAUSES, C.CONTRACT_TITLES, C.CONTRACT_LEAST).withColumn("_type", F.lit("contract"))
    paper = headed_sections(rows.where(F.col("_type").isin(*C.SECTIONED)), id_col, "_t").select(id_col, F.lit("document").alias("_type"), "section", "title", F.col("body").alias("content"))
    parts = [
        in_windows(mail, keys, C.CHUNK_WORDS["email"], C.CHUNK_OVERLAP), in_windows(notes, keys, C.CHUNK_WORDS["meeting_notes"], C.CHUNK_OVERLAP),
        in_windows(deal, keys, C.CHUNK_WORDS["contract"], C.CONTRACT_OVERLAP), in_windows(paper, keys, C.CHUNK_WORDS["document"], C.CHUNK_OVERLAP),
    ]
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    plain = rows.where("_type <> 'email'").join(found.select(id_col).distinct(), id_col, "left_anti")
    slid = word_windows(plain, id_col, "_t").select(id_col, F.lit("other").alias("_type"), F.lit(0).alias("section"), none.alias("title"), F.col("chunk_index").alias("part"), F.lit(True).alias("windowed"), "content")
    found = found.unionByName(slid)
    names = {"email": ("email_conversation", "email_conversation_window"), "meeting_notes": ("agenda_section", "agenda_window"), "contract": ("clause_boundary", "clause_window"), "document": ("section_aware", "section_window")}
    strategy = F.lit("sliding_window")
    for kind, (whole, window) in names.items():
        strategy = F.when(F.col("_type") == kind, F.when(F.col("windowed"), window).otherwise(whole)).otherwise(strategy)
    title = F.lower(F.coalesce("title", F.lit("")))
    key = F.when(F.col("windowed"), False).when(F.col("_type") == "meeting_notes", title.contains("action") | title.contains("decision")).when(F.col("_type") == "contract", X.words_found(title, C.KEY_CLAUSES) > 0).otherwise(False)
    index = F.row_number().over(Window.partitionBy(id_col).orderBy("section", "part")) - 1
    return found.select(id_col, index.alias("chunk_index"), strategy.alias("strategy"), "title", key.alias("is_key"), "content")


def risks(texts: DataFrame, id_col: str, text_col: str, rules=C.RISK_RULES, around: int = 100, least: float = 0.3) -> DataFrame:
    """A row per text, rule and match: category, title, match_text, excerpt of `around` characters on both sides, severity (medium
    where no word tells) and confidence (0.4, 0.1 for each of the category's rules in the excerpt up to 0.3, 0.1 for a party)."""
    low = F.lower(F.col(text_col))
    each = F.array(*[F.struct(F.lit(c).alias("category"), F.lit(title).alias("title"), F.regexp_extract_all(low, F.lit(f"({p})"), 1).alias("found"), F.split(low, p).alias("_parts")) for c, p, title in rules])
    hit = texts.select(id_col, F.col(text_col).alias("_t"), F.explode(F.filter(each, lambda r: F.size(r["found"]) > 0)).alias("r")).select(id_col, "_t", "r.*")
    rows = hit.select(id_col, "_t", "category", "title", "found", "_parts", F.posexplode("found").alias("match_no", "match_text"))
    # a match starts after the texts between the earlier matches and those matches themselves
    before = F.aggregate(F.slice("_parts", 1, F.col("match_no") + 1), F.lit(0), lambda n, x: n + F.length(x)) + F.aggregate(F.slice("found", 1, F.col("match_no")), F.lit(0), lambda n, x: n + F.length(x))
    start = F.greatest(F.lit(0), before - around)
    excerpt = F.trim(F.col("_t").substr(start + 1, before + F.length("match_text") + around - start))
    rows = rows.select(id_col, "category", "title", "match_no", "match_text", excerpt.alias("excerpt"))
    low = F.lower(F.col("excerpt"))
    more = F.lit(0)
    for category in dict.fromkeys(c for c, _, _ in rules):
        more = F.when(F.col("category") == category, X.hits(low, [p for c, p, _ in rules if c == category])).otherwise(more)
    party = F.when(X.words_found(low, C.RISK_CONTEXT) > 0, 0.1).otherwise(0.0)
    confidence = F.least(F.lit(1.0), F.lit(0.4) + F.least(more * 0.1, F.lit(0.3)) + party)
    return rows.withColumns({"severity": X.first_match(low, C.SEVERITY_WORDS, "medium"), "confidence": confidence}).where(F.col("confidence") >= least)


def events_of(texts: DataFrame, text_col: str, default: str = "email_sent") -> DataFrame:
    """event_type (first bank that hits), importance and milestone flag."""
    kind = X.first_match(F.lower(F.col(text_col)), C.EVENT_PATTERNS, default)
    weight = F.create_map(*[F.lit(x) for kv in C.EVENT_IMPORTANCE.items() for x in kv])
    out = texts.withColumn("event_type", kind)
    return out.withColumns({"importance": weight[F.col("event_type")], "is_milestone": F.col("event_type").isin(C.MILESTONES)})


def classify_queries(queries: DataFrame, col: str = "query") -> DataFrame:
    """category, intent, temporal scope and capitalised entities without question words."""
    t = F.lower(F.col(col))
    names = F.regexp_extract_all(F.col(col), F.lit(r"((?:[A-Z][A-Za-z]+)(?:\s[A-Z][A-Za-z]+)*)"), 1)
    plain = F.filter(names, lambda x: ~F.lower(x).isin("what", "who", "where", "when", "why", "how", "which", "summarize", "status", "show", "list", "tell"))
    return queries.withColumns({"category": X.most_hits(t, C.CATEGORY_SIGNALS, "general"), "intent": X.first_match(t, C.INTENT_SIGNALS, "general"), "temporal": X.first_match(t, C.TEMPORAL_SIGNALS, "all_time"), "entities": plain})


def intents(queries: DataFrame, col: str = "query") -> DataFrame:
    """The first engine's intent of each question, by plain words, and its plan: memories, collection, n_vectors, signals, days_back."""
    t = F.lower(F.col(col))
    kind = F.lit("general")
    for name, words in reversed(list(C.INTENT_WORDS.items())):
        kind = F.when(X.words_found(t, words) > 0, name).otherwise(kind)
    schema = "intent string, memories array<string>, collection string, n_vectors int, signals array<string>, days_back int"
    plans = queries.sparkSession.createDataFrame([(k, *v) for k, v in C.INTENT_PLANS.items()], schema)
    return queries.withColumn("intent", kind).join(F.broadcast(plans), "intent")


def event_rows(texts: DataFrame, source_type: str, text_col: str = "text") -> DataFrame:
    """Timeline events of mails, meeting notes or contracts: event_type, importance, milestone, title (512 characters), excerpt
    (2000), description. Meetings (agenda, decisions: arrays) are held, and matter more with decisions; contracts are signed."""
    rows = events_of(texts, text_col)
    none = F.array().cast("array<string>")
    about = F.lit(None).cast("string")
    if source_type == "meeting_notes":
        decided = F.coalesce("decisions", none)
        listed = lambda c, n: F.when(F.size(F.coalesce(c, none)) > 0, F.array_join(F.slice(c, 1, n), "; "))
        about = F.nullif(F.concat_ws(" | ", F.concat(F.lit("Agenda: "), listed(F.col("agenda"), 5)), F.concat(F.lit("Decisions: "), listed(F.col("decisions"), 3))), F.lit(""))
        rows = rows.withColumns({"event_type": F.lit("meeting_held"), "importance": F.when(F.size(decided) > 0, 0.65).otherwise(0.45), "is_milestone": F.lit(False)})
    if source_type == "contract":
        rows = rows.withColumns({"event_type": F.lit("contract_signed"), "importance": F.lit(0.95), "is_milestone": F.lit(True)})
    return rows.withColumns({"source_type": F.lit(source_type), "title": F.substring("title", 1, 512), "excerpt": F.substring(text_col, 1, C.EXCERPT_MOST), "description": about})
