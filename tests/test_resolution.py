"""Constraint trees, entity resolution and evidence spans."""

import random

from pyspark.sql import functions as F

from lodespark.functions import constraints as C
from lodespark.operators import entities as E
from lodespark.operators import spans as P
from lodespark.plans import resolution as R


def shown(n):
    return n and (n.term if n.kind == "term" else f"({f' {n.kind} '.join(map(shown, n.parts))})" if n.kind != "not" else f"!{shown(n.parts[0])}")


def test_precedence_of_trees():
    cases = {
        "a OR b AND NOT c": "(a or (b and !c))", "(a OR b) AND c": "((a or b) and c)", 'x y NOT "visual cortex" z': "(x y and !visual cortex z)", "a AND (b OR": "(a and b)", "NOT (a b)": "!a b", "": None, "AND OR": None, "NOT NOT a": "!!a",
    }
    for query, want in cases.items():
        assert shown(C.tree(query)) == want, query


def test_terms_without_structure():
    t = C.split_terms('neuropixels AND mouse NOT "visual cortex" bold')
    assert (t.positive, t.negative, t.implied) == (["neuropixels", "mouse", "bold"], ["visual cortex"], ["ephys", "fmri"])


def test_predicate_of_nulls_and_scan(spark, sf):
    rows = [(1, "Mouse brain", None), (2, None, None), (3, "rat", "mouse"), (4, "", "fish")]
    df = spark.createDataFrame(rows, "id int, a string, b string")
    got = lambda q: [r.id for r in df.where(C.predicate(C.tree(q), [F.col("a"), F.col("b")])).orderBy("id").collect()]
    assert got("mouse") == [1, 3] and got("NOT mouse") == [2, 4] and got("mouse NOT rat OR fish") == [1, 4]
    exact = lambda q: [r.id for r in df.where(C.predicate(C.tree(q), [F.col("a"), F.col("b")], case_sensitive=True)).orderBy("id").collect()]
    assert exact("mouse") == [3] and exact("NOT (mouse OR fish)") == [1, 2] and exact("NOT (rat AND mouse) NOT NOT brain") == [1]
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = R._scanned(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "StringContains(p_name,cold)" in plan and "Not(StringContains(p_name,ECONOMY))" in plan


def test_entities_of_hubs_kinds_and_nulls(spark):
    schema = "record_id string, dataset_id string, paper_id string, source string, source_id string, doi string, title string, url string, aliases array<string>"
    hub = [(f"h{k:03}", f"ds{k:03}", None, None, None, None, f"t{k % 2}", None, ["Hub  Name"]) for k in range(200)]
    rows = hub + [
        ("a", None, "p1", None, None, "https://doi.org/10.1/X.", "one", "u1", None), ("b", None, "p2", None, None, "doi:10.1/x", "two", "u1", None), ("c", None, "p2", "OpenAlex", "https://openalex.org/w7", None, "two", None, [None, ""]),
        ("m", "d9", None, None, None, None, None, None, ["same"]), ("n", None, "p9", None, None, None, None, None, ["same"]), ("u", None, None, None, None, None, "x", None, ["same"]), (None, "ds001", None, None, None, None, "lost", None, None),
    ]
    df = spark.createDataFrame(rows, schema)
    got = E.resolve_entities(df)
    lookup = {r.record_id: r.canonical_id for r in got["lookup"].collect()}
    assert {lookup[x] for x in "abc"} == {"paper:doi:10.1/x"}
    assert {lookup[h[0]] for h in hub} == {"ds000"}
    assert lookup["m"] == lookup["n"] == "alias:same" and lookup["u"] == "unknown:u" and None not in lookup
    entities = {r.canonical_id: r for r in got["entities"].collect()}
    assert (entities["ds000"].n_records, entities["ds000"].entity_type, entities["alias:same"].entity_type) == (200, "dataset", "unknown")
    conflicts = {(r.canonical_id, r.field, r.value): r.n_records for r in got["conflicts"].collect()}
    assert conflicts[("ds000", "title", "t0")] == 100 and conflicts[("paper:doi:10.1/x", "title", "two")] == 2
    assert not any(field == "url" for _, field, _ in conflicts)
    assert all(t.count() == 0 for t in E.resolve_entities(df.where(F.lit(False))).values())


def brute(text, statement, least):
    low, wanted = text.lower(), statement.lower().strip()
    if not low or not wanted:
        return None
    best = (0, 0)
    for size in range(len(wanted), 0, -1):
        at = [low.find(wanted[k : k + size]) for k in range(len(wanted) - size + 1)]
        at = [x for x in at if x >= 0]
        if at:
            best = (min(at), size)
            break
    score = best[1] / len(wanted)
    return None if not best[1] or score < least else (best[0], best[0] + best[1], round(score, 3))


def test_stretches_against_brute_force():
    rnd = random.Random(3)
    for _ in range(400):
        text, statement = ("".join(rnd.choice("ab. ") for _ in range(rnd.randrange(n))) for n in (40, 12))
        got = P.locate(text, statement, 0.5)
        assert (got and (*got[:2], got[4])) == brute(text, statement, 0.5), (text, statement)


def test_spans_of_odd_rows(spark):
    long = "x" * 300_000 + " The mouse ran. It was fast. " + "y" * 300_000
    rows = [(1, long, "it was fast"), (2, None, "a"), (3, "a", None), (4, "", "a"), (5, "abc", "  "), (6, "zzz", "abc"), (1, long, "it was fast")]
    df = spark.createDataFrame(rows, "id int, text string, statement string").withColumn("CHAR_START", F.lit(1))
    got = P.locate_spans(df).collect()
    assert [(r.id, r.char_start, r.sentence_id, r.match_method) for r in got] == [(1, 300_016, 1, "exact")] * 2
    assert P.locate_spans(df.where(F.lit(False))).count() == 0


def test_query_of_spans_against_brute_force(spark, sf, duck):
    docs = dict(duck.execute("SELECT doc_id, text FROM documents WHERE text IS NOT NULL").fetchall())
    items = dict(duck.execute("SELECT item_id, text FROM benchmark").fetchall())
    want, five = {}, R.TOGETHER
    runs = lambda t: {tuple(w[k : k + five]) for w in [t.lower().split()] for k in range(len(w) - five + 1)}
    asked = {k: (v[: R.STATEMENT], runs(v[: R.STATEMENT])) for k, v in items.items()}
    for d, text in docs.items():
        own = runs(text)
        for k, (statement, need) in asked.items():
            if own & need and (found := brute(text, statement, 0.3)):
                want[d, k] = found
    got = {(r.doc_id, r.item_id): (r.char_start, r.char_end, r.match_score) for r in R._spans(spark, sf).collect()}
    assert got == want and got
