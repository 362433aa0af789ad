"""The fuzzy join of names against all pairs."""

import random

import pytest

from lorekeep.operators import consistency, entities, names

FIRST = ["robert", "bob", "john", "jon", "katherine", "kathryn", "cathryn", "william", "bill", "ann", "anna", "li", "j", "j.", "k", "m."]
LAST = ["smith", "smyth", "smithson", "meyerson", "mayerson", "brown", "braun", "o", "ng", "lee", "garcia", "garzia", "de", "la", "acme", "corp"]


def _names(n, seed):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        toks = [rng.choice(FIRST)] * rng.choice((1, 1, 1, 2)) + [rng.choice(LAST) for _ in range(rng.choice((0, 1, 1, 1, 2)))]
        if rng.random() < 0.3:
            i = rng.randrange(len(toks))
            k = rng.randrange(len(toks[i]) + 1)
            toks[i] = toks[i][:k] + rng.choice("aeksz.") + toks[i][k + rng.choice((0, 1)) :]
        rng.shuffle(toks)
        out.append(" ".join(toks).strip())
    return [*out, "kathryn meyerson", "", None, "ab cd", "a b", "b a", "x"]


@pytest.mark.parametrize("measure,least", [(entities.name_score, 0.85), (entities.plain_score, 0.85), (entities.indel_ratio, 0.9), (entities.company_score, 0.85)])
def test_no_pair_is_lost(spark, measure, least):
    a, b = _names(120, 1), [*_names(110, 2), "cathryn mayerson"]
    left, right = (spark.createDataFrame(list(enumerate(x)), "id long, name string") for x in (a, b))
    got = {(r["a"], r["b"]): round(r["name_score"], 9) for r in names.similar_names(left, right, least, measure).collect()}
    want = {(i, j): round(measure(x, y), 9) for i, x in enumerate(a) for j, y in enumerate(b) if x and y and measure(x, y) >= least}
    assert got == want and len(want) > 30


def test_pairs_within_one_table(spark):
    rows = [(1, "John Smith"), (2, "smith, john"), (3, "Katherine Jones"), (4, "Katherin Jones"), (5, ""), (6, None), (7, "Someone Else")]
    got = {(r["a"], r["b"]) for r in consistency.alike(spark.createDataFrame(rows, "id long, name string")).collect()}
    assert got == {(1, 2), (3, 4)}
    assert consistency.alike(spark.createDataFrame([], "id long, name string")).count() == 0


def test_a_common_token_makes_no_pairs(spark):
    """Names that share only a common token meet nowhere."""
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice("abcdefghijklmnop") for _ in range(9)) + " smith") for i in range(400)]
    df = spark.createDataFrame(rows, "id long, name string").withColumnRenamed("id", "_id").withColumnRenamed("name", "_n")
    told = names.keys(df, 0.85, "t", True)
    assert told.where("_key = 'smith'").count() == 400
    small = spark.createDataFrame(rows, "id long, name string")
    assert names.within(small, 0.85, entities.plain_score).count() == sum(entities.plain_score(x, y) >= 0.85 for i, (_, x) in enumerate(rows) for _, y in rows[i + 1 :])


def test_initials_need_a_threshold_above_their_score(spark):
    with pytest.raises(ValueError):
        names.similar_names(spark.createDataFrame([(1, "a b")], "id long, name string"), spark.createDataFrame([(1, "a b")], "id long, name string"), 0.8)


def test_persons_by_stages(spark):
    mentions = [
        (1, None, " JS@x.com ", None, None), (2, None, "john2@x.com", None, None), (3, None, "old@x.com", None, None), (4, "Johnny the Smith", None, None, None), (5, "Jon Smith", None, 10, ["p1"]),
        (6, "Jon Smith", None, 11, []), (7, "Jon Smith", None, 99, None), (8, "Zoe", None, 11, ["p1", "p2"]), (9, "Nobody", "no@x.com", None, None), (10, "", "", None, None), (11, "x", "nick@x.com", None, None),
    ]
    persons = [
        (30, "John Smith", "js@x.com", ["JOHN2@x.com"], 10, ["p1"], True), (31, "John Smyth", None, [], 11, [], True), (32, "Zoe Park", "z@x.com", None, 11, ["p1", "p2"], True), (33, "Jon Smith", "merged@x.com", ["js@x.com"], 10, [], False),
    ]
    aliases = [("old@x.com", "email", 31, 0.95), ("johnny the smith", "name", 30, 0.9), ("nick@x.com", "handle", 32, 0.8), ("no@x.com", "email", 33, 1.0)]
    m = spark.createDataFrame(mentions, "mention_id long, name string, email string, company_id long, project_ids array<string>")
    p = spark.createDataFrame(persons, "entity_id long, name string, email string, emails array<string>, company_id long, project_ids array<string>, is_canonical boolean")
    a = spark.createDataFrame(aliases, "alias string, alias_type string, entity_id long, confidence double")
    got = {r["mention_id"]: (r["entity_id"], r["stage"], round(r["score"], 3)) for r in entities.resolve_persons(m, p, a).collect()}
    near = {k: round(entities.name_score("jon smith", n), 3) for k, n in ((30, "john smith"), (31, "john smyth"))}
    assert got[1] == (30, "email_exact", 1.0) and got[2] == (30, "email_array", 0.98) and got[3] == (31, "email_alias", 0.95) and got[4] == (30, "alias", 0.9) and got[11] == (32, "alias", 0.8)
    assert got[5][:2] == (30, "fuzzy") and got[5][2] >= near[30]  # raised by company and project
    assert (near[31] >= 0.85 and got[6][:2] == (31, "fuzzy")) or 6 not in got or got[6][1] == "context"  # only the company's own
    assert got[7] == (30, "fuzzy", near[30])  # a company without persons: all are asked
    assert 9 not in got and 10 not in got
    assert entities.resolve_persons(m.where("false"), p, a).count() == 0


def test_few_letters_make_few_candidates(spark):
    """Names of so few letters that nearly all share a pair of them; none of a pair from 0.8 on is lost, copies are searched once."""
    rng = random.Random(8)
    made = lambda: "".join(rng.choice("abdefgiklmnoprst") for _ in range(6)) + " " + "".join(rng.choice("abdefgiklmnoprst") for _ in range(7))
    a = [made() for _ in range(400)]
    b = [x[:2] + x[3:] if i % 2 else x[:9] + x[8:] for i, x in enumerate(a[:100])] + [made() for _ in range(200)]
    left, right = (spark.createDataFrame([(n,) for n in x], "_n string") for x in (a, b))
    assert 100 <= names._by_pieces(left, right, 0.8).count() < 300  # of 120,000
    long = [x * 3 for x in a[:20]]
    rows = [spark.createDataFrame(list(enumerate(x)), "id long, name string") for x in (a + long + a[:5], b + long)]
    got = {(r["a"], r["b"]) for r in names.similar_names(*rows, 0.8, entities.indel_ratio).collect()}
    assert got == {(i, j) for i, x in enumerate(a + long + a[:5]) for j, y in enumerate(b + long) if entities.indel_ratio(x, y) >= 0.8}


def test_no_piece_misses_a_pair():
    rng, seen = random.Random(3), 0
    for _ in range(4000):
        letters = "abcd"[: rng.choice((2, 3, 4))]
        x = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 20)))
        y = list(x)
        for _ in range(rng.randrange(8)):
            at = rng.randrange(len(y) + 1)
            y[at : at + rng.choice((0, 1))] = rng.choice(("", *letters))
        y, t = "".join(y), rng.choice((0.6, 0.75, 0.8, 0.9, 0.98))
        if y and entities.indel_ratio(x, y) >= t:
            seen += 1
            assert names.pieces(x, [len(y)], t, True) & names.pieces(y, [len(x)], t, False)
    assert seen > 1000


def test_short_names_have_no_keys_of_letters(spark, monkeypatch):
    """Where no name is longer than LONGEST, names meet by pieces only; at 0.98 a name of 14 letters is its only key, so keys, and what
    they take of the disk, grow with the names."""
    monkeypatch.setattr(names, "_by_keys", lambda *a: pytest.fail("pairs of letters"))
    rows = [(i, "".join(chr(97 + (i * 7 + j * j) % 23) for j in range(6)) + " " + "".join(chr(97 + (i // 23 + j) % 23) for j in range(7))) for i in range(200)]
    assert all(len(names.pieces(n, [14], 0.98, left)) == 1 for _, n in rows for left in (True, False))
    table = spark.createDataFrame([*rows, (500, rows[3][1]), (501, None), (502, "")], "id long, name string")
    want = {(a, b) for a, x in [*rows, (500, rows[3][1])] for b, y in [*rows, (500, rows[3][1])] if a < b and x == y}
    assert (3, 500) in want and {(r["a"], r["b"]) for r in names.within(table, 0.98).collect()} == want


def test_many_names_are_scored_as_one_by_one():
    """Blocks of names get the very scores of pairs: shared and repeated tokens, initials, first names, marks, long and empty names."""
    told = ["", "a", "j smith", "john smith", "jon smyth", "johnny b. goode", "b.goode j", "bob bob", "robert", "acme acme corp", "corp acme", "zoë \U0001f600 x", "x y", "  odd   blanks ", ".", "a.b", "nul\0", "customer 000000012", "supplier 000000012", "supplier 000000013", "q" * 32, "q" * 33, "r" * 63 + "s", "ab " * 21, "ab " * 22, "long " * 40, "lo ng" * 30]
    random.seed(5)
    told += ["".join(random.choice("ab .") for _ in range(random.randint(0, 12))) for _ in range(60)]
    for left, right in ((told, told[::-1]), (told[:3], told), ([], told), (told, []), ([""], ["", "b"]), (["customer 1", "customer 22"], ["supplier 3", "supplier 35"])):
        assert entities.name_scores(left, right).tolist() == [[entities.name_score(a, b) for b in right] for a in left]
