"""Worked examples of the text and date rules."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from almanack.functions import dates, places, similarity, tags, text, titles, urls
from almanack.operators import filters as f

C = F.col


def day(*a):
    return dt.datetime(*a)


def test_names(one):
    got = one([("台湾祭 －台南ランタン祭－",), ("Foo® Bar",), ("A　B c",)], "n string", similarity.norm_name(C("n")))
    assert got == ["台湾祭", "foo(r)bar", "abc"]


def test_ratio_is_the_standard_one_and_ordered(one):
    long_a, long_b = "ab" * 120, "ba" * 120
    rows = [("abcd", "bcde"), ("tide", "diet"), ("diet", "tide"), (long_a, long_b), ("", ""), (None, "a")]
    got = one(rows, "a string, b string", similarity.ratio(C("a"), C("b")))
    from difflib import SequenceMatcher
    assert got[0] == 0.75 and got[1:4] == [SequenceMatcher(None, *r).ratio() for r in rows[1:4]] and got[4] == 1.0 and got[5] is None
    assert got[1] != got[2]


def test_venue_tokens(one):
    assert one([("中野 区民ホール", "新宿・区民ホール"), ("中野", "新宿"), (None, "新宿"), ("", "")], "a string, b string", places.venues_overlap(C("a"), C("b"))) == [True, False, False, False]


def test_classifier(one):
    rules = {"movie": ["映画"], "tech": ["IT"]}
    names = tags.joined([C("j"), C("e")])
    got = one([("映画上映会", None), (None, "Visit Italy"), (None, None), ("開催レポート", "映画")], "j string, e string", tags.classify(names, names, rules, ["レポート"]))
    assert got == [["movie"], ["tech"], ["senses"], ["report", "movie"]]


def test_commands(one):
    labels = {"1": "movie", "音楽": "performing_arts", "電影": "movie"}
    got = one([("1, 音楽",), ("English",), ("??",), ("電影，1",), (" 日本語 ",)], "t string", tags.parse_command(C("t"), labels))
    assert [tuple(x) for x in got] == [
        ("category", None, ["movie", "performing_arts"]), ("lang", "en", None), ("unknown", None, None), ("category", None, ["movie"]), ("lang", "ja", None)]


def test_labels(one):
    assert one([(["movie", "x"],), ([],)], "c array<string>", tags.valid_labels(C("c"))) == [["movie"], ["senses"]]
    got = one([(["movie"], "上映会＋トーク"), (["art"], "戦後の海峡"), (["lecture"], "講演"), (["art"], "上映と座談")], "c array<string>, t string", tags.inject_labels(C("c"), C("t")))
    assert got == [["movie", "lecture"], ["art", "geopolitics", "history"], ["lecture"], ["art", "lecture"]]
    assert one([("映画ドラマ",), ("教養",), ("スポーツ",)], "g string", tags.genre_labels(C("g"))) == [["tv_program", "drama"], ["tv_program", "report"], ["tv_program"]]
    assert one([(["#Food", "Art "], "Jazz live")], "g array<string>, t string", tags.tag_hints(C("g"), C("t"))) == [["art", "lifestyle_food", "performing_arts", "taiwan_japan"]]


def test_paid(one):
    assert one([("入場無料 1000円",), ("料金 1000円",), ("なし",), ("FREE 100円",), (None,)], "t string", text.is_paid(C("t"))) == [False, True, None, True, None]
    assert one([("FREE 100円",), ("100 Yen",)], "t string", text.is_paid(C("t"), text.FREE_WORDS_ANY_CASE, text.PAID_WORDS_ANY_CASE, True)) == [False, True]


def test_guarded_relevance(spark):
    df = spark.createDataFrame([("仙台湾の朝",), ("仙台湾と台湾",), ("東京",)], "t string")
    assert [r["t"] for r in f.relevant_guarded(df, "t", ["台湾"], "仙台湾").collect()] == ["仙台湾と台湾"]


def test_split_venue(one):
    v, a = places.split_venue(C("t"))
    rows = [("下北沢SHELTER (東京都)東京都世田谷区北沢２丁目... 会場マップ・アクセス方法はこちら x",), ("どこか",)]
    assert one(rows, "t string", v) == ["下北沢SHELTER (東京都)", "どこか"]
    assert one(rows, "t string", a) == ["東京都世田谷区北沢２丁目...", None]


def test_eras(one):
    rows = [("2025年10月25日（土曜日）",), ("令和8（2026）年４月12日（日）",), ("令和8年4月12日",), ("令和8年2月30日",), ("大正8年2月3日",), ("なし",)]
    assert one(rows, "t string", dates.parse_era(C("t"))) == [day(2025, 10, 25), day(2026, 4, 12), day(2026, 4, 12), None, None, None]


def test_parse_date_forms(one):
    rows = [("2026/1/5",), ("2026.01.05（月）",), ("２０２６年１月５日",), ("2026年5月",), ("2026年13月1日",), ("x2026/1/5",), ("2026/1/5 10:00",), (None,)]
    assert one(rows, "t string", dates.parse_date(C("t"))) == [day(2026, 1, 5)] * 3 + [day(2026, 5, 1), None, None, None, None]


def test_body_dates(one):
    rows = [("日時：2026年5月4日（月・祝）～5日（火・祝）",), ("期間：2026年5月1日～10月",), ("会期：2026年5月1日～6月2日",), ("日時：未定の予定です\n開催日：2026/5/1 ",), ("なし",)]
    got = one(rows, "t string", dates.body_dates(C("t")))
    assert [tuple(x) if x else None for x in got] == [
        (day(2026, 5, 4), day(2026, 5, 5)), (day(2026, 5, 1), day(2026, 10, 31)), (day(2026, 5, 1), day(2026, 6, 2)), (day(2026, 5, 1), None), None]


def test_tiers(one):
    rows = [("題", "日時：10.11 Sat 16:30～19:00（開 16:00）", day(2025, 10, 1)), ("題", "11月28日〜12月14日に開催", day(2025, 12, 1)), ("題", "1月5日(月)の様子", day(2026, 1, 9)),
            ("3/17(火) 題", "本文", day(2026, 5, 1)), ("題", None, day(2026, 5, 1))]
    got = one(rows, "title string, body string, pub timestamp_ntz", dates.tier_dates(C("title"), C("body"), C("pub")))
    assert [(x["tier"], x["start"], x["end"]) for x in got] == [
        ("dotted", day(2025, 10, 11), day(2025, 10, 11)), ("range", day(2025, 11, 28), day(2025, 12, 14)), ("prose", day(2026, 1, 5), day(2026, 1, 5)),
        ("title", day(2027, 3, 17), day(2027, 3, 17)), ("published", day(2026, 5, 1), day(2026, 5, 1))]


def test_anchored(one):
    rows = [("12月30日", day(2026, 1, 5)), ("1月10日", day(2025, 12, 20)), ("2月31日", day(2025, 12, 20))]
    assert one(rows, "t string, p timestamp_ntz", dates.anchored_date(C("t"), C("p"))) == [day(2025, 12, 30), day(2026, 1, 10), day(2025, 12, 20)]


def test_schedules(one):
    rows = [("4/25(土)・26(日)12:30、4/27(月)～5/1(金)12:40、5/2(土)～8(金)10:00", day(2026, 4, 20)), ("なし", day(2026, 4, 20))]
    got = one(rows, "t string, r timestamp_ntz", dates.schedule_span(C("t"), C("r")))
    assert tuple(got[0]) == (day(2026, 4, 25), day(2026, 5, 8)) and (got[1] is None or got[1]["start"] is None)
    got = one([("4月29日 水曜 25:00　X", day(2026, 4, 29)), ("未定", day(2026, 4, 29))], "t string, r timestamp_ntz", dates.broadcast_slot(C("t"), C("r")))
    assert tuple(got[0]) == (day(2026, 4, 30, 1), "X") and tuple(got[1]) == (None, "未定")
    got = one([("Fri, Apr 24, 2026 - Wed, Mar 31, 2027",), ("Mon, May 12, 2025\n12:00 AM - 12:30 PM",), ("TBA",)], "t string", dates.ticket_span(C("t")))
    assert [tuple(x) for x in got] == [(day(2026, 4, 24), day(2027, 3, 31)), (day(2025, 5, 12), day(2025, 5, 12, 12, 30)), (None, None)]
    got = one([("◎4月22日（水）～27日（月）\n◎9階", day(2026, 4, 1)), ("◎12月29日～1月11日", day(2026, 12, 1))], "t string, r timestamp_ntz", dates.store_span(C("t"), C("r")))
    assert [tuple(x) for x in got] == [(day(2026, 4, 22), day(2026, 4, 27)), (day(2026, 12, 29), day(2027, 1, 11))]


def test_titles(one):
    rows = [("原題：阿嬤的夢中情人 Forever Love",), ("原題または英題：Forever Love",), ("原題：阿嬤的夢中情人",), ("なし",)]
    zh, en = titles.split_title(C("t"))
    assert one(rows, "t string", zh) == ["阿嬤的夢中情人", None, "阿嬤的夢中情人", None]
    assert one(rows, "t string", en) == ["Forever Love", "Forever Love", None, None]
    assert one([("映画「X」トー クイベント レポ ート 2",), ("会 - 夜市の会 report",), ("ab報告",)], "t string", titles.report_fragment(C("t"))) == ["映画「X」", "夜市の会", None]
    assert one([("《old》と『old』とold",)], "t string", titles.swap_title(C("t"), [F.lit("old")], F.lit("new"))) == ["《new》と『new』とold"]


def test_keys_and_urls(one):
    assert one([("TaiwanCulturalCenterScraper",), ("Peatix",)], "t string", text.snake(C("t"))) == ["taiwan_cultural_center", "peatix"]
    assert one([(" Foo bar/映画  10!",)], "t string", text.slug(C("t"))) == ["foo_bar_映画_10"]
    assert one([("https://note.com/ab_c/",), ("ab_c",), ("https://note.com/a/n/n1",), ("a b",)], "t string", urls.account_id(C("t"), "note\\.com")) == ["ab_c", "ab_c", None, None]
    assert one([("http://[bad",), ("https://a.b/c",)], "t string", urls.host_or_raw(C("t")))[1] == "a.b"


def test_html(one):
    from almanack.functions import markup
    page = "<script>x()</script><p>A&amp;B<br/>&nbsp;C</p><table><tr><th>k<td> v &lt;1\n</table><dl><dt>会場<dd>中野</dl>"
    assert one([(page,), (None,)], "h string", markup.html_text(C("h"), "visible")) == ["A&B C k v <1 会場 中野", None]
    assert one([("a<br>b &amp; c<BR />\n\nd",)], "h string", markup.html_text(C("h"), "lines")) == ["a\nb & c\nd"]
    assert one([(page,), (None,)], "h string", markup.html_kv(C("h"))) == [{"k": "v <1", "会場": "中野"}, None]


def test_label_blocks(one):
    t = "題\n日程\n5月1日\n会場：\n中野\n3階\n西\n北\n主催\n言語：\n日本語"
    got = one([(t,)], "t string", text.label_block(C("t"), ["日程", "会場", "主催", "言語"]))[0]
    assert [tuple(x) for x in got] == [("日程", "5月1日"), ("会場", "中野\n3階\n西"), ("言語", "日本語")]


def test_prices(one):
    rows = [("前売¥3,000（税込） 当日¥3,000（税込） ¥0",), ("無料 ￥500",), ("なし",), (None,)]
    assert one(rows, "t string", text.prices(C("t"))) == ["¥3,000（税込） / ¥0", "￥500", None, None]
    assert one(rows, "t string", text.ticket_paid(C("t"))) == [False, False, True, None]


@pytest.mark.parametrize("region,public,admin", [
    ("tokyo", {0, 1, 2, 4, 6}, {0, 1, 2, 7}),
    ("taiwan", {3}, {3, 4}),
    ("other_japan", {8}, {5, 8}),
    ("online", {6}, {6}),
])
def test_regions(spark, region, public, admin):
    rows = [(0, None, None), (1, "", "x"), (2, "東京都新宿区", "x"), (3, "台北市", "x"), (4, "台北駐日代表処", "x"), (5, "大阪市", None), (6, None, "オンライン"), (7, "  ", None), (8, "大阪市", "会館")]
    df = spark.createDataFrame(rows, "id int, location_address string, location_name string")
    ids = lambda d: {r["id"] for r in d.collect()}
    assert ids(f.by_region(df, region)) == public
    assert ids(f.by_region_admin(df, region)) == (admin | ({6} if region == "tokyo" else set()))
