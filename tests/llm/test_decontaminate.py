import re

from tessera.llm import decontaminate as D

ITEM = "Alice buys 12 apples and gives 5 apples to Bob, then Alice sells 3 kg of pears for 7.50 dollars before Bob returns 5 apples to Alice again."


def brute_template(text):
    out, last = [], None
    for m in re.finditer(r"(?:\d(?:[.,](?=\d))?|[A-Za-z\u0080-\U0010ffff])+", text or ""):
        w, gap = m[0], text[last : m.start()] if last is not None else "."
        low = "".join(c.lower() if c.isascii() or "À" <= c <= "Þ" and c != "×" else c for c in w)
        capital = len(w) > 1 and w[0].isascii() and w[0].isupper() and w[1].isascii() and w[1].islower()
        kind = "NUM" if w[0].isdigit() or low in D.NUMBERS else "UNIT" if low in D.UNITS else None
        out.append((kind, low, capital, not set(gap) & set('.!?:;\n"|')))
        last = m.end()
    names = {low for _, low, capital, inside in out if capital and inside}
    return [(kind or ("NAME" if capital and low in names else None), low) for kind, low, capital, _ in out]


def brute_windows(text, literal=False):
    t = brute_template(text)
    out = set()
    for i in range(len(t) - 4):
        w = t[i : i + 5]
        if literal:
            out.add(tuple(v for _, v in w))
        elif sum(k is None for k, _ in w) >= 2:
            out.add(tuple(k or v for k, v in w))
    return out


def test_templates_against_brute_force(spark):
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + [ITEM, "", None, "one 2,000.5 Km é É x", "Zz Ab. Ab: Cd ef"]
    df = spark.createDataFrame(list(enumerate(docs)), "key long, text string").fillna("")
    got = {}
    for r in D._window_rows(df, None).collect():
        got.setdefault((r.key, r.literal), set()).add(r.win)
    for i, t in enumerate(docs):
        assert len(got.get((i, False), ())) == len(brute_windows(t)), i
        if len(brute_template(t)) >= 5:
            assert len(got.get((i, True), ())) == len(brute_windows(t, True)), i


def test_reparameterised_questions_and_consistency(spark):
    same_shape = "Carol buys 90 apples and gives 8 apples to Dan, then Erin sells 2 kg of pears for 9 dollars before Fay returns 6 apples to Gus again."
    other = ITEM.replace("Alice", "Carol").replace("Bob", "Dan").replace("12", "90").replace("5", "8").replace("3 kg", "40 pounds")
    rows = [
        (1, "Intro words here. " + ITEM + " The end."), (2, "x. " + other), (3, "x. " + ITEM.upper()), (4, "x. " + same_shape), (5, ITEM[:50]),
        (6, None), (7, ""), (8, "word " * 100_000), (None, ITEM), (1, "Intro words here. " + ITEM + " The end."),
    ]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(100, ITEM, 1), (101, "too short", 1), (102, None, 1), (None, ITEM, 1)], "item_id long, text string, doc_id int")
    got = {r.doc_id: r for r in D.contained(docs, bench).collect()}
    assert set(got) == {1, 2, 3, None} and {r.item_id for r in got.values()} == {100}
    assert got[1].exact and not got[2].exact and got[1].coverage == 1.0
    kept = D.clean(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {4, 5, 6, 7, 8}
    assert D.contained(docs.limit(0), bench).count() == 0 and D.contained(docs, bench.limit(0)).count() == 0


def test_a_large_benchmark_joins_without_broadcast(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    want = sorted(D.contained(docs, bench).collect())
    monkeypatch.setattr(D, "BROADCAST_WINDOWS", -1)
    assert sorted(D.contained(docs, bench).collect()) == want


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    want = set()
    for literal in (False, True):
        items = {r.item_id: brute_windows(r.text, literal) for r in bench.collect()}
        for r in docs.collect():
            w = brute_windows(r.text, literal)
            want |= {(r.doc_id, i) for i, x in items.items() if x and len(x & w) >= 0.8 * len(x)}
    got = {(r.doc_id, r.item_id) for r in D.contained(docs, bench).collect()}
    assert got == want and got


def test_consistency_is_that_of_one_occurrence(spark):
    sibling = ITEM.replace("Alice", "Carol").replace("Bob", "Dan").replace("12", "90").replace("5", "8").replace("3 kg", "40 pounds")
    third = ITEM.replace("Alice", "Erin").replace("Bob", "Gus").replace("12", "17").replace("5", "6").replace("3 kg", "22 grams")
    choices = "How many are drawn: 3 of the red balls or 4 of the red balls or 5 of the red balls or 6 of the red balls?"
    cut = ITEM.replace("then Alice sells", "then right away Alice sells")
    rows = [(1, f"{ITEM} {sibling} {third}"), (2, f"x. {sibling} {third}"), (3, f"Well. {choices}"), (4, f"{cut} {sibling}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(100, ITEM), (101, choices)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in D.contained(docs, bench).collect()}
    assert {(1, 100), (2, 100), (3, 101)} <= set(got)
    assert got[1, 100].exact and got[3, 101].exact and not got[2, 100].exact
    assert got[1, 100].consistency == got[3, 101].consistency == 1.0
    assert {r.doc_id for r in D.clean(docs, bench).collect()} <= {4}


def test_names_where_a_sentence_begins(spark):
    item = "Tom has 5 red apples in a big box. Tom buys 3 more apples at the old market. Tom gives 2 green apples to his aunt."
    rows = [(1, item.replace("Tom", "Ann").replace("5", "9")), (2, "We saw Tom there. " + item), (3, "Nothing of it. The rest is prose of the usual kind.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, "Here is Tom again. " + item)], "item_id long, text string")
    docs = docs.union(spark.createDataFrame([(4, "Here is Ann again. " + rows[0][1])], docs.schema))
    assert {r.doc_id for r in D.contained(docs, bench).collect()} == {2, 4}


def test_short_items_and_items_of_numbers(spark):
    bench = spark.createDataFrame([(1, "Why not now?"), (2, "12 + 5 + 7 + 9 = 33"), (3, "go"), (4, "!?"), (5, None)], "item_id long, text string")
    rows = [(1, "Yes. Why not now? Well."), (2, "he asked why not now or then"), (3, "sum: 12 + 5 + 7 + 9 = 33, see"), (4, "sum: 12 + 5 + 7 + 8 = 32, see"), (5, "Go!\nso"), (6, "go on"), (7, "why not\nnow")]
    got = {(r.doc_id, r.item_id) for r in D.contained(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == {(1, 1), (3, 2), (5, 3), (7, 1)}


def test_a_phrase_of_all_items_pairs_no_documents(spark):
    """The rarest windows look; a window that all items share finds nothing by itself, yet counts."""
    stem = "answer the question below as well as you can and say why it is so"
    bench = spark.createDataFrame([(k, f"{stem} what about topic{k}x and also thing{k}y or even place{k}z") for k in range(300)], "item_id long, text string")
    docs = spark.createDataFrame([(k, f"{stem} what about topic{k}x and also thing{k}y or even place{k}z" if k < 5 else stem) for k in range(200)], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in D.contained(docs, bench).collect()} == {(k, k) for k in range(5)}
