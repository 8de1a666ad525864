"""Entity resolution against a plain statement of its rule on small tables."""

import datetime as dt
import math
import random
from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from almanack.functions.similarity import name_grams, norm_name, sequence_ratio, shared_grams
from almanack.operators import resolve as r

SCHEMA = (
    "id long, source_name string, source_id string, source_url string, name_ja string, start_date timestamp_ntz, end_date timestamp_ntz, "
    "location_name string, is_active boolean, official_url string, raw_description string, annotation_status string, secondary_source_urls array<string>"
)
RANKS = {"a": 1, "b": 2, "c": 2}
WORDS = ["spring lantern festival", "spring lantern festivals", "spring lanterns festival", "night market tokyo", "night markets tokyo", "film talk", "film talks", "x", "ab", "abc"]


def table(spark, seed, n, sources="abcde", days=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        name = rng.choice(WORDS)
        if rng.random() < 0.4:
            k = rng.randrange(len(name))
            name = name[:k] + rng.choice("abcxyz ") + name[k + rng.randrange(2):]
        day = dt.datetime(2024, 1, 1 + rng.randrange(days), rng.randrange(24))
        rows.append((i, rng.choice(sources), f"s{i}", f"u{i}", name, day, day, "中野 ホール", True, None, f"text {i % 7}", "annotated", []))
    return spark.createDataFrame(rows, SCHEMA), rows


def norms(spark, rows):
    df = spark.createDataFrame([(x[0], x[4]) for x in rows], "id long, n string").select("id", norm_name(F.col("n")).alias("n"))
    return {x["id"]: x["n"] for x in df.collect()}


def scan(rows, norm, ranks, threshold):
    """The rule, said sequentially: visit rows in order; a standing row meets later ones."""
    out, absorbed = set(), set()
    by_day = {}
    for x in sorted(rows, key=lambda x: (x[5], x[0])):
        by_day.setdefault(x[5].date(), []).append(x)
    for group in by_day.values():
        for i, a in enumerate(group):
            if a[0] in absorbed:
                continue
            for b in group[i + 1:]:
                if b[0] in absorbed or a[1] == b[1]:
                    continue
                if SequenceMatcher(None, norm[a[0]], norm[b[0]]).ratio() < threshold:
                    continue
                keep_a = ranks.get(a[1], 99) <= ranks.get(b[1], 99)
                out.add((a[0], b[0]) if keep_a else (b[0], a[0]))
                absorbed.add(b[0] if keep_a else a[0])
    return out


@pytest.mark.parametrize("seed,n", [(1, 60), (2, 120), (3, 200), (4, 30)])
def test_primary_choice_matches_sequential_scan(spark, seed, n):
    df, rows = table(spark, seed, n)
    want = scan(rows, norms(spark, rows), RANKS, 0.85)
    got = {(x["primary_id"], x["secondary_id"]) for x in r.assign_primary(df, F.to_date("start_date"), ranks=RANKS).collect()}
    assert got == want and got


@pytest.mark.parametrize("seed,n,days", [(1, 60, 3), (5, 200, 1)])
def test_rows_say_what_the_pairs_say(spark, seed, n, days):
    df, rows = table(spark, seed, n, days=days)
    want = scan(rows, norms(spark, rows), RANKS, 0.85)
    got = r.decide(df, F.to_date("start_date"), ranks=RANKS).rows().collect()
    assert {x["id"] for x in got} == {x[0] for x in rows if x[4] is not None} and len(got) == len(rows)
    for x in got:
        assert x["secondaries"] == sum(p == x["id"] for p, _ in want)
        assert x["lost"] == any(s == x["id"] for _, s in want)
        if x["absorbed_by"] is not None:
            assert (x["absorbed_by"], x["id"]) in want


def test_copies_in_two_sources_stay_in_linear_size(spark):
    """5,000 rows of a source that lose to each of 5,000 later ones: 25 million decisions, one link."""
    n = 5000
    first = F.lit("2024-01-01").cast("timestamp_ntz")
    df = spark.range(2 * n).select(
        "id", F.when(F.col("id") < n, F.lit("z")).otherwise(F.lit("a")).alias("source_name"), F.lit("one name for all of them").alias("name_ja"),
        (first + F.make_dt_interval(secs=F.col("id"))).alias("start_date"))
    made = r.decide(df, F.to_date("start_date"), ranks=RANKS)
    assert made.links.count() == 1 and made.absorbed.count() == 0
    rows = made.rows()
    assert rows.groupBy("secondaries", "lost").count().orderBy("lost").collect() == [(n, False, n), (0, True, n)]


def test_primary_choice_with_one_hot_day_and_copies(spark):
    df, rows = table(spark, 9, 150, sources="abcdefgh", days=1)
    want = scan(rows, norms(spark, rows), RANKS, 0.85)
    got = {(x["primary_id"], x["secondary_id"]) for x in r.assign_primary(df.repartition(3), F.to_date("start_date"), ranks=RANKS).collect()}
    assert got == want


@pytest.mark.parametrize("threshold", [0.8, 0.85, 0.95])
def test_near_classes_loses_no_pair(spark, threshold):
    _df, rows = table(spark, 5, 300, days=2)
    df = _df
    norm = norms(spark, rows)
    keys = {(x[5].date(), norm[x[0]]) for x in rows}
    want = set()
    for d, a in keys:
        for e, b in keys:
            if d == e and a < b and max(SequenceMatcher(None, a, b).ratio(), SequenceMatcher(None, b, a).ratio()) >= threshold:
                want.add((d, frozenset((a, b))))
    near = r.near_classes(r.name_classes(df, F.to_date("start_date")), threshold)
    got = {(x["block_a"], frozenset((x["norm_a"], x["norm_b"]))) for x in near.collect()}
    assert got == want and got


@pytest.mark.parametrize("days,k", [(0, 30), (1, 50), (3, 20)])
def test_audit_pairs(spark, days, k):
    df, rows = table(spark, 11, 90, days=9)
    norm = norms(spark, rows)
    order = sorted(rows, key=lambda x: (x[5], x[0]))
    pairs = []
    for i, a in enumerate(order):
        for b in order[i + 1:]:
            if a[1] != b[1] and (b[5].date() - a[5].date()).days <= days:
                s = SequenceMatcher(None, norm[a[0]], norm[b[0]]).ratio()
                if s >= 0.8:
                    pairs.append((s, a[0], b[0]))
    want = sorted(pairs, key=lambda p: (-p[0], p[1], p[2]))[:k]
    got = [(x["sim"], x["id_a"], x["id_b"]) for x in r.audit_pairs(df, days=days, k=k).collect()]
    assert got == want


@pytest.mark.parametrize("k", [1, 2, 5, 40, 2000])
def test_audit_many_copies(spark, k):
    """Copies at mixed hours, whose ids and starts disagree in order."""
    rng = random.Random(3)
    names = ["Lantern Festival of the North", "Lantern Festival of the Nortx", "Something else altogether"]
    df, rows = table(spark, 5, 3, days=1)
    rows = [
        tuple({**dict(zip(df.columns, rows[0])), "id": i, "source_name": rng.choice("abc"), "source_id": f"s{i}", "source_url": f"u{i}", "name_ja": rng.choice(names),
               "start_date": dt.datetime(2024, 5, rng.choice([1, 1, 2]), rng.randint(0, 3)), "secondary_source_urls": []}.values())
        for i in rng.sample(range(100), 70)
    ]
    df = spark.createDataFrame(rows, df.schema)
    at = {c: df.columns.index(c) for c in ("id", "source_name", "start_date")}
    norm = norms(spark, rows)
    order = sorted(rows, key=lambda x: (x[at["start_date"]], x[at["id"]]))
    pairs = []
    for i, a in enumerate(order):
        for b in order[i + 1:]:
            if a[at["source_name"]] != b[at["source_name"]]:
                s = SequenceMatcher(None, norm[a[0]], norm[b[0]]).ratio()
                if s >= 0.8:
                    pairs.append((s, a[0], b[0]))
    want = sorted(pairs, key=lambda p: (-p[0], p[1], p[2]))[:k]
    assert [(x["sim"], x["id_a"], x["id_b"]) for x in r.audit_pairs(df, days=1, k=k).collect()] == want


def test_merge_of_very_many_secondaries(spark):
    """One primary, 100,000 secondaries with few texts: what it gathers is distinct."""
    n = 100_000
    day = F.lit("2024-05-01").cast("timestamp_ntz")
    rows = spark.range(n + 1).select(
        "id", F.concat(F.lit("s"), F.col("id") % 3).alias("source_name"), F.concat(F.lit("u"), F.col("id") % 50).alias("source_url"), day.alias("start_date"),
        F.lit(None).cast("string").alias("official_url"), F.concat(F.lit("text "), F.col("id") % 4).alias("raw_description"),
        F.lit("annotated").alias("annotation_status"), F.array().cast("array<string>").alias("secondary_source_urls"), F.lit(True).alias("is_active"),
    )
    pairs = spark.range(1, n + 1).select(F.lit(0).cast("long").alias("primary_id"), F.col("id").alias("secondary_id"))
    out = {x["id"]: x for x in r.apply_merge(rows, pairs).where("id < 3").collect()}
    assert len(out[0]["secondary_source_urls"]) == 50 and out[0]["secondary_source_urls"][:2] == ["u1", "u2"]
    assert out[0]["raw_description"].count("---") == 3 and out[0]["is_active"] and not out[2]["is_active"]


def test_audit_leaves_out_merged_urls(spark):
    df, rows = table(spark, 12, 60, days=1)
    df = df.withColumn("secondary_source_urls", F.when(F.col("id") == 0, F.array(F.lit("u1"), F.lit("u2"))).otherwise(F.col("secondary_source_urls")))
    ids = {x for p in r.audit_pairs(df, days=0, k=500).collect() for x in (p["id_a"], p["id_b"])}
    assert not ids & {1, 2} and ids


def test_merge_application(spark):
    day = dt.datetime(2024, 5, 1)
    row = lambda i, src, name, **kw: tuple({**dict(
        id=i, source_name=src, source_id=f"s{i}", source_url=f"u{i}", name_ja=name, start_date=day, end_date=None, location_name=None,
        is_active=True, official_url=None, raw_description=f"text {i}", annotation_status="annotated", secondary_source_urls=[]), **kw}.values())
    rows = [row(1, "z", "Lantern Festival 2024"), row(2, "b", "lantern festival 2024", official_url="off"), row(3, "a", "LanternFestival2024", raw_description="main"),
            row(4, "a", "Lantern Festival 2024"), row(5, "y", "Lantern Festival 2024", source_id="s5_sub1")]
    df = spark.createDataFrame(rows, SCHEMA)
    pairs = r.assign_primary(r.mergeable(df), F.to_date("start_date"), ranks=RANKS)
    want = scan([x for x in rows if "_sub" not in x[2]], norms(spark, rows), RANKS, 0.85)
    assert {(p["primary_id"], p["secondary_id"]) for p in pairs.collect()} == want
    out = {x["id"]: x for x in r.apply_merge(df, pairs).collect()}
    assert not out[1]["is_active"] and not out[2]["is_active"] and out[3]["is_active"] and out[5]["is_active"]
    assert out[3]["secondary_source_urls"][:2] == ["u1", "u2"] and out[3]["official_url"] == "off"
    assert out[3]["raw_description"] == "main\n\n---\n別来源補足 (z)\ntext 1\n\n---\n別来源補足 (b)\ntext 2"
    assert out[3]["annotation_status"] == "pending" and out[5]["annotation_status"] == "annotated"
    again = r.apply_merge(spark.createDataFrame(list(out.values()), SCHEMA), pairs)
    assert sorted(again.collect()) == sorted(out.values())


def test_news_matching_edges(spark):
    d = lambda x: dt.datetime.fromisoformat(x)
    official = [(1, "o1", d("2024-06-01"), d("2024-06-10"), "中野 区民ホール"), (2, "b", d("2024-06-01"), None, "中野・会館"), (3, "a", d("2024-05-30"), d("2024-05-01"), "中野")]
    news = [(10 + i, "n", d(x), None, "新宿、中野") for i, x in enumerate(["2024-03-03", "2024-03-02", "2024-06-10", "2024-06-11", "2024-06-01"])]
    news += [(30, "n", d("2024-06-01"), None, "大阪"), (31, "n", d("2024-06-01"), None, None), (32, "n", d("2024-02-20"), None, "中野")]
    schema = "id long, source_name string, start_date timestamp_ntz, end_date timestamp_ntz, location_name string"
    got = r.match_news(spark.createDataFrame(news, schema), spark.createDataFrame(official, schema), ranks=RANKS)
    want = set()
    for n in news:
        best = None
        for o in official:
            end = o[3] or o[2]
            shared = {"中野", "区民ホール", "会館"} & set((n[4] or "").replace("、", " ").split()) & set((o[4] or "").replace("・", " ").split())
            if o[2].date() - dt.timedelta(90) <= n[2].date() <= end.date() and shared:
                key = (RANKS.get(o[1], 99), o[2], o[0])
                best = min(best or key, key)
        if best:
            want.add((n[0], best[2]))
    assert {(x["news_id"], x["official_id"]) for x in got.collect()} == want and want


def meet(a, b, threshold, common):
    """The candidate rule in plain terms: shared grams that may align, counted, against the need."""
    x = {e[:3]: e[3:] for e in name_grams(a, threshold, common)}
    y = {e[:3]: e[3:] for e in name_grams(b, threshold, common)}
    total, longer = len(a) + len(b), len(b) - len(a)
    unmatched = total - 2 * math.ceil(threshold * total / 2 - 1e-9)
    shared, spare, width = 0, 0, 1
    for (step, up, gram), (times, first, last, left) in x.items():
        for low in (False, True):
            other = y.get((step, low, gram))
            if other and not (up and low) and 2 * (other[1] - last) <= longer + unmatched and 2 * (other[2] - first) >= longer - unmatched:
                shared, spare, width = shared + min(times, other[0]), max(left, other[3]), len(gram)
    return abs(longer) <= unmatched and shared > 0 and shared >= shared_grams(total, width, threshold) - spare


def check(a, b, threshold, common):
    if a != b and max(sequence_ratio(a, b), sequence_ratio(b, a)) >= threshold:
        assert meet(a, b, threshold, common) and meet(b, a, threshold, common)


@settings(max_examples=300, deadline=None)
@given(st.text("abcde", max_size=14), st.text("abcde", max_size=14), st.sampled_from([0.6, 0.7, 0.8, 0.85, 0.95]))
def test_similar_names_are_candidates(a, b, threshold):
    check(a, b, threshold, {"ab": 3, "bc": 2})


@settings(max_examples=400, deadline=None)
@given(st.text("abcdefgh", min_size=1, max_size=90), st.lists(st.tuples(st.integers(0, 89), st.sampled_from(["", "a", "bc", "xyz"])), max_size=9), st.sampled_from([0.8, 0.85, 0.9, 0.95]))
def test_edited_names_are_candidates(a, edits, threshold):
    b = list(a)
    for i, ch in edits:
        b[i % len(b)] = ch
    check(a, "".join(b), threshold, {"ab": 3, "abc": 2, "abcd": 9, "a": 1})


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 60), st.integers(0, 12), st.sampled_from(["ab", "a", "abc"]), st.sampled_from([0.8, 0.85, 0.9]))
def test_repeating_names_are_candidates(n, more, unit, threshold):
    check(unit * n, unit * n + unit[:1] * more, threshold, {})
    check(unit * n + "z" * more, "z" * more + unit * n, threshold, {unit[:2]: 5})


def test_long_unlike_names_are_no_candidates(spark):
    """Names over one set of syllables share many grams, but not enough of them in place."""
    rng = random.Random(8)
    syllables = [a + b + c for a in "tnrskm" for b in "aeio" for c in ["", "n", "l", "sh"]]
    names = ["".join(rng.choice(syllables) for _ in range(rng.randrange(15, 50))) for _ in range(150)]
    names += [n[:30] + "q" + n[31:] for n in names[:10]]
    rows = [(i, n, dt.datetime(2024, 1, 1)) for i, n in enumerate(names)]
    df = spark.createDataFrame(rows, "id long, name_ja string, start_date timestamp_ntz")
    classes = r.name_classes(df, F.to_date("start_date")).withColumn("n", F.monotonically_increasing_id())
    assert 10 <= r.candidates(classes, 0.85).count() < 1000  # of 12,720 pairs
    assert r.near_classes(classes.drop("n"), 0.85).count() == 10


@pytest.mark.parametrize("days", [0, 2])
def test_names_in_many_tiles_lose_no_pair(spark, monkeypatch, days):
    """Tiles of three names: pairs are found in their tiles, and no shared gram or candidate leaves a task."""
    monkeypatch.setattr(r, "TILE_NAMES", 3)
    df, rows = table(spark, 21, 120, days=6)
    norm = norms(spark, rows)
    keys = sorted({(x[5].date(), norm[x[0]]) for x in rows})
    want = set()
    for i, (d, a) in enumerate(keys):
        for e, b in keys[i + 1:]:
            if (a != b or d != e) and (e - d).days <= days and a and b and max(SequenceMatcher(None, a, b).ratio(), SequenceMatcher(None, b, a).ratio()) >= 0.85:
                want.add(frozenset(((d, a), (e, b))))
    near = r.near_classes(r.name_classes(df, F.to_date("start_date")), 0.85, days)
    found = [frozenset(((x["block_a"], x["norm_a"]), (x["block_b"], x["norm_b"]))) for x in near.collect()]
    assert set(found) == want and len(found) == len(want) > 20
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "gram" not in plan
