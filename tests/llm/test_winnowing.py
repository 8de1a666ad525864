
from pyspark.sql import functions as F

from almanack.llm import winnowing

from .conftest import ROWS


def test_edits(docs, no_docs):
    rows = winnowing.edits(docs).collect()
    assert len(rows) == len(ROWS)
    known = {}
    for i, t in ROWS:
        known.setdefault(i, []).append(t or "")
    # ids with one text, whose next document is unmistakable too
    order = sorted((i for i in known if i is not None), reverse=True)
    for r in rows:
        if r.doc_id is None or len(set(known[r.doc_id])) > 1:
            continue
        k = order.index(r.doc_id)
        if k + 1 == len(order) or len(set(known[order[k + 1]])) > 1:
            continue
        text, other = known[r.doc_id][0], known[order[k + 1]][0]
        cut = len(text) // 3
        assert r.n_chars == len(text)
        assert r.edited == text[: len(text) - cut] + other[:cut]
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert winnowing.edits(no_docs).count() == 0


def test_one_document_follows_itself(spark):
    row = winnowing.edits(spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).first()
    assert row.edited == "abcdab" and row.near_next == 1


def marks(spark, texts, k=3, window=4):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: (r.hashes, r.positions) for r in winnowing.fingerprints(df, k, window).collect()}


def test_rightmost_minimum_of_each_window(spark):
    text = " ".join(f"t{i * 7 % 11}" for i in range(60)) + " same" * 12
    hashes, positions = marks(spark, [text])[0]
    words = text.lower().split()
    grams = spark.createDataFrame([(i, *words[i : i + 3]) for i in range(len(words) - 2)], "i int, a string, b string, c string")
    values = [
        r[0]
        for r in grams.orderBy("i").select(F.shiftrightunsigned(F.shiftrightunsigned(F.xxhash64(F.xxhash64("a"), F.xxhash64("b"), F.xxhash64("c")), 31), 0)).collect()
    ]
    want = []
    for s in range(len(values) - 3):
        low = min(values[s : s + 4])
        at = max(i for i in range(s, s + 4) if values[i] == low)
        if at not in want:
            want.append(at)
    assert positions == want


def test_shared_run_gives_a_shared_mark(spark):
    run = " ".join(f"word{i}" for i in range(6))  # k + window - 1
    a, b = marks(spark, [f"x y z {run} q", f"{run} entirely other words after it"]).values()
    assert set(a[0]) & set(b[0])


def test_edges(spark):
    got = marks(spark, ["", "one", "one two", " ", "東京の祭り", "x" * 100, "one"])
    assert got[0] == ([], []) and got[3] == ([], [])
    assert got[1] == got[6] and len(got[1][0]) == 1 and len(got[2][0]) == 1 and len(got[4][0]) >= 1 and len(got[5][0]) == 1


def test_fingerprint_string(docs):
    rows = winnowing.edits(docs).select("doc_id", winnowing.fingerprint(F.col("hashes")).alias("f"), F.size("hashes").alias("n")).collect()
    assert all(len(r.f) == 8 * r.n for r in rows)
    same = {r.f for r in rows if r.doc_id in (1, 7)}
    assert len(same) == 2  # 1 and one of the two texts under 7 are equal


def test_no_python_in_the_plan(docs):
    plan = winnowing.edits(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
