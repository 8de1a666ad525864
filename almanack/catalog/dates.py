"""Date rules over texts that Spark writes from the order dates.

The five order priorities choose the written form, so every form meets the whole table. The
SQL side states the expected date from the same columns and never parses the text.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from almanack.catalog.registry import query
from almanack.functions import dates as d

P = "CASE o_orderpriority WHEN '1-URGENT' THEN {} WHEN '2-HIGH' THEN {} WHEN '3-MEDIUM' THEN {} WHEN '4-NOT SPECIFIED' THEN {} ELSE {} END"

# y, m and pd come from the order date; dd runs over 1..31 whatever the month, so some dates
# do not exist. m2/d2 is a later date.
BASE_SQL = """SELECT *, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, CAST(o_custkey % 31 + 1 AS INT) AS dd,
 CAST(month(o_orderdate + INTERVAL 40 DAYS) AS INT) AS m2, CAST(day(o_orderdate + INTERVAL 40 DAYS) AS INT) AS d2, CAST(year(o_orderdate + INTERVAL 40 DAYS) AS INT) AS y2 FROM orders"""
DAY = "try_cast(printf('%04d-%02d-%02d', {}, {}, {}) AS DATE)"
TEXT = "strftime({}, '%Y-%m-%d')"


def base(c):
    o = c.table("orders")
    later = F.col("o_orderdate") + F.expr("interval 40 days")
    return o.withColumns({
        "y": F.year("o_orderdate"), "m": F.month("o_orderdate"), "dd": (F.col("o_custkey") % 31 + 1).cast("int"),
        "m2": F.month(later), "d2": F.day(later), "y2": F.year(later)})


def forms(*texts):
    """One written form per priority; ``{y}`` and the like are replaced by column values."""
    names = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"]
    out = None
    for i, t in enumerate(texts):
        parts = []
        for piece in t.replace("}", "{").split("{"):
            parts.append(F.col(piece).cast("string") if piece in ("y", "m", "dd", "m2", "d2", "y2", "era", "sera", "m_0", "dd_0") else F.lit(piece))
        text = F.concat(*parts)
        if i < 4:
            out = F.when(F.col("o_orderpriority") == names[i], text) if out is None else out.when(F.col("o_orderpriority") == names[i], text)
        else:
            out = out.otherwise(text)
    return out


def fmt(c):
    return F.date_format(c, "yyyy-MM-dd")


YMD = DAY.format("y", "m", "dd")
Y2 = DAY.format("y2", "m2", "d2")


@query("h25_parse_date", f"""
SELECT o_orderkey, {TEXT.format(P.format(YMD, YMD, YMD, YMD, DAY.format('y', 'm', '1')))} AS d FROM ({BASE_SQL})""")
def _(c):
    t = forms("{y}/{m}/{dd}", "{y}.{m}.{dd}（金）", "{y}年{m}月{dd}日（月・祝）", " {y}-{m}-{dd} ", "{y} 年{m} 月")
    return base(c).select("o_orderkey", fmt(d.parse_date(t)).alias("d"))


@query("h26_parse_era", f"""
SELECT o_orderkey, {TEXT.format(P.format('CASE WHEN y >= 2000 THEN ' + YMD + ' END', YMD, YMD, YMD, YMD))} AS d FROM ({BASE_SQL})""")
def _(c):
    b = base(c).withColumns({"era": F.col("y") - 1988, "sera": F.col("y") - 1925})
    t = forms("{y}年{m}月{dd}日（土曜日）", "平成{era}年{m}月{dd}日", "平成{era}（{y}）年{m}月{dd}日（日）", "第３回 平成{era}年{m}月{dd}日", "昭和{sera}年{m}月{dd}日")
    wide = F.translate(t, "0123456789", d.FULL_WIDTH)
    t = F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", wide).otherwise(t)
    return b.select("o_orderkey", fmt(d.parse_era(t)).alias("d"))


@query("h27_split_range", f"""
SELECT o_orderkey, {TEXT.format(YMD)} AS s, {TEXT.format(P.format(Y2, Y2, Y2, 'NULL', 'NULL'))} AS e FROM ({BASE_SQL})""")
def _(c):
    t = forms("{y}/{m}/{dd} ～ {y2}/{m2}/{d2}", "{y}.{m}.{dd}〜{y2}.{m2}.{d2}", "{y}-{m}-{dd} – {y2}-{m2}-{d2}", "{y}-{m}-{dd}", "{y}年{m}月{dd}日")
    s, e = d.split_range(t)
    return base(c).select("o_orderkey", fmt(s).alias("s"), fmt(e).alias("e"))


END28 = P.format(DAY.format("y", "m", "d2"), DAY.format("y", "m2", "d2"), "NULL", "last_day(" + DAY.format("y", "m2", "1") + ")", Y2)


@query("h28_body_dates", f"""
SELECT o_orderkey, {TEXT.format(YMD)} AS s, {TEXT.format(f'CASE WHEN {YMD} IS NOT NULL THEN {END28} END')} AS e FROM ({BASE_SQL})""")
def _(c):
    t = forms("本文\n■日時：{y}年{m}月{dd}日（月・祝）～{d2}日（火・祝）\n会場：ホール", "前文 期間：未定です。\n会期: {y}年{m}月{dd}日～{m2}月{d2}日", "開催日：{y}/{m}/{dd}\n終",
              "開催期間：{y}年{m}月{dd}日〜{m2} 月", "日 時 ： {y}.{m}.{dd}（土）～{y2}.{m2}.{d2}（日）")
    r = d.body_dates(t)
    return base(c).select("o_orderkey", fmt(r["start"]).alias("s"), fmt(r["end"]).alias("e"))


PUB = "CAST(o_orderdate AS DATE)"


def near(m, day, years, cond):
    cands = ", ".join(DAY.format(f"y + {k}" if k >= 0 else f"y - {-k}", m, day) for k in years)
    return f"list_filter([{cands}], lambda x: x IS NOT NULL AND {cond})[1]"


ABS = lambda n: f"abs(x - {PUB}) <= {n}"
DOT = near("m2", "dd", (0, 1, -1), ABS(180))
RS, RE = near("m", "dd", (0, 1, -1), ABS(365)), near("m2", "d2", (0, 1, -1), ABS(365))
PROSE = near("m", "dd", (0, -1, 1), f"{PUB} - x BETWEEN 0 AND 180")
SLASH0 = DAY.format("y", "m2", "dd")
SLASH = f"CASE WHEN {PUB} - {SLASH0} > 30 THEN {DAY.format('y + 1', 'm2', 'dd')} ELSE {SLASH0} END"
S29 = P.format(f"coalesce({YMD}, {PUB})", f"coalesce({DOT}, {PUB})", f"coalesce({RS}, {PUB})", f"coalesce({PROSE}, {PUB})", f"coalesce({SLASH}, {PUB})")
E29 = P.format("NULL", "NULL", f"CASE WHEN {RS} IS NOT NULL THEN {RE} END", "NULL", "NULL")
T29 = P.format(*[f"CASE WHEN {x} IS NULL THEN 'published' ELSE '{n}' END" for x, n in ((YMD, "label"), (DOT, "dotted"), (RS, "range"), (PROSE, "prose"), (SLASH, "title"))])


@query("h29_tier_dates", f"""
SELECT o_orderkey, {TEXT.format(S29)} AS s, {TEXT.format(f'coalesce({E29}, {S29})')} AS e, {T29} AS tier FROM ({BASE_SQL})""")
def _(c):
    b = base(c).withColumn("dd_0", F.lpad(F.col("dd").cast("string"), 2, "0"))
    body = forms("日時：{y}年{m}月{dd}日", "日時：{m2}.{dd_0} Sat 16:30～19:00（開 16:00）", "会場にて{m}月{dd}日(土) 〜 {m2}月{d2}日まで", "{m}月{dd}日(土)に開催された会の様子", "本文のみ")
    title = forms("題", "題", "題", "題", "【{m2}/{dd}(火)】題")
    b = b.select("o_orderkey", "o_orderdate", body.alias("body"), title.alias("title"))
    b = b.withColumn("r", d.tier_dates(F.col("title"), F.col("body"), F.col("o_orderdate")))
    r = F.col("r")
    return b.select("o_orderkey", fmt(r["start"]).alias("s"), fmt(r["end"]).alias("e"), r["tier"].alias("tier"))


YEAR30 = "y + CASE WHEN m2 < m - 6 THEN 1 WHEN m2 > m + 6 THEN -1 ELSE 0 END"


@query("h30_anchored_date", f"""
SELECT o_orderkey, {TEXT.format(P.format(f'coalesce({YMD}, {DAY.format("y", "m", "dd")}, {PUB})', f'coalesce({YMD}, {PUB})', f'coalesce({DAY.format(YEAR30, "m2", "dd")}, {PUB})', PUB, f'coalesce({Y2}, {PUB})'))} AS d FROM ({BASE_SQL})""")
def _(c):
    t = forms("開催 {y}年{m}月{dd}日（土）", "on {y}/{m}/{dd} in", "来る{m2}月{dd}日に", "日付なし", "{y2}/{m2}/{d2} と {m}月1日")
    return base(c).select("o_orderkey", fmt(d.anchored_date(t, F.col("o_orderdate"))).alias("d"))


ROLL = f"CASE WHEN {DAY.format('y', 'm2', 'dd')} < {PUB} - 30 THEN {DAY.format('y + 1', 'm2', 'dd')} ELSE {DAY.format('y', 'm2', 'dd')} END"
LATE = f"CASE WHEN {Y2} > DATE '2000-06-01' - 730 THEN {Y2} END"
Q31 = P.format(
    f"coalesce(strftime({YMD}, '%Y-%m-%d') || ' 13:30', strftime({PUB}, '%Y-%m-%d') || ' 00:00')",
    f"coalesce(strftime({ROLL}, '%Y-%m-%d'), strftime({PUB}, '%Y-%m-%d')) || ' 00:00'",
    f"strftime(coalesce({LATE}, {PUB}), '%Y-%m-%d') || ' 00:00'", f"strftime({PUB}, '%Y-%m-%d') || ' 00:00'", f"strftime({PUB}, '%Y-%m-%d') || ' 00:00'")


@query("h31_release_date", f"SELECT o_orderkey, {Q31} AS d FROM ({BASE_SQL})")
def _(c):
    t = forms("開催日時：{y}年{m}月{dd}日（土）13：30～", "日程: {m2}月{dd}日 会場", "{y}年{m}月1日 発表。\n次は{y2}年{m2}月{d2}日です", "{y}年{m}月1日 発表", "日付なし")
    r = d.release_date(t, F.col("o_orderdate"), F.lit("2000-06-01").cast("timestamp_ntz"))
    return base(c).select("o_orderkey", F.date_format(r, "yyyy-MM-dd HH:mm").alias("d"))


@query("h32_infer_year", f"""
SELECT o_orderkey, y + CASE WHEN m2 < m - 3 THEN 1 ELSE 0 END AS quarter, y + CASE WHEN m2 < m AND m = 12 AND m2 <= 3 THEN 1 ELSE 0 END AS december,
 y + CASE WHEN coalesce({PUB} - {DAY.format('y', 'm2', 'dd')} > 365, false) THEN 1 ELSE 0 END AS over_a_year,
 y + CASE WHEN coalesce({DAY.format('y', 'm2', 'dd')} < {PUB} - 7, false) THEN 1 ELSE 0 END AS lookback FROM ({BASE_SQL})""")
def _(c):
    m, day, ref = F.col("m2"), F.col("dd"), F.col("o_orderdate")
    pick = lambda p: d.infer_year(m, day, ref, p)
    return base(c).select("o_orderkey", pick("quarter").alias("quarter"), pick("december").alias("december"), pick("year").alias("over_a_year"), pick("lookback").alias("lookback"))


QY = lambda mm: f"y + CASE WHEN {mm} < m - 3 THEN 1 ELSE 0 END"
SCHED = "[" + ", ".join([DAY.format(QY("m"), "m", "dd"), DAY.format(QY("m"), "m", "1"), DAY.format(QY("m2"), "m2", "d2"), DAY.format(QY("m2"), "m2", "28")]) + "]"


@query("h33_schedule_span", f"SELECT o_orderkey, {TEXT.format(f'list_min({SCHED})')} AS s, {TEXT.format(f'list_max({SCHED})')} AS e FROM ({BASE_SQL})")
def _(c):
    t = F.concat_ws("", F.col("m").cast("string"), F.lit("/"), F.col("dd").cast("string"), F.lit("(土)・1(日)12:30、"), F.col("m2").cast("string"), F.lit("/"), F.col("d2").cast("string"), F.lit("(月)～28(金)10:00"))
    r = d.schedule_span(t, F.col("o_orderdate"))
    return base(c).select("o_orderkey", fmt(r["start"]).alias("s"), fmt(r["end"]).alias("e"))


@query("h33_period_span", f"""
SELECT o_orderkey, {TEXT.format(DAY.format('y', 'm', 'dd'))} AS s, {TEXT.format(f"CASE WHEN {YMD} IS NOT NULL THEN {DAY.format('y + CASE WHEN m2 < m THEN 1 ELSE 0 END', 'm2', 'd2')} END")} AS e FROM ({BASE_SQL})""")
def _(c):
    t = F.concat_ws("", F.col("m").cast("string"), F.lit("/"), F.col("dd").cast("string"), F.lit("(土)～"), F.col("m2").cast("string"), F.lit("/"), F.col("d2").cast("string"), F.lit("(金)"))
    r = d.period_span(t, F.col("o_orderdate"))
    return base(c).select("o_orderkey", fmt(r["start"]).alias("s"), fmt(r["end"]).alias("e"))


SLOT = lambda yy: f"(CAST({DAY.format(yy, 'm2', 'dd')} AS TIMESTAMP) + to_hours(CAST(20 + o_custkey % 8 AS INT)) + INTERVAL 15 MINUTES)"


@query("h33_broadcast_slot", f"""
SELECT o_orderkey, strftime(CASE WHEN {SLOT('y')} < o_orderdate - INTERVAL 7 DAYS THEN {SLOT('y + 1')} ELSE {SLOT('y')} END, '%Y-%m-%d %H:%M') AS at, 'ch' || o_orderstatus AS channel FROM ({BASE_SQL})""")
def _(c):
    t = F.concat(F.col("m2").cast("string"), F.lit("月"), F.col("dd").cast("string"), F.lit("日 水曜 "), (F.col("o_custkey") % 8 + 20).cast("string"), F.lit(":15　ch"), F.col("o_orderstatus"))
    r = d.broadcast_slot(t, F.col("o_orderdate"))
    return base(c).select("o_orderkey", F.date_format(r["at"], "yyyy-MM-dd HH:mm").alias("at"), r["channel"].alias("channel"))


ENGLISH = "EEE, MMM d, yyyy"
LATER = "(o_orderdate + INTERVAL 40 DAYS)"
TS = "strftime({}, '%Y-%m-%d %H:%M')"


@query("h33_ticket_span", f"""
SELECT o_orderkey, {P.format(TS.format('o_orderdate'), TS.format('o_orderdate + INTERVAL 13 HOURS'), TS.format(YMD), TS.format('o_orderdate'), 'NULL')} AS s,
 {P.format(TS.format(LATER), TS.format('o_orderdate + INTERVAL 15 HOURS + INTERVAL 30 MINUTES'), TS.format(YMD), TS.format('o_orderdate'), 'NULL')} AS e FROM ({BASE_SQL})""")
def _(c):
    day, later = F.date_format("o_orderdate", ENGLISH), F.date_format(F.col("o_orderdate") + F.expr("interval 40 days"), ENGLISH)
    pri = F.col("o_orderpriority")
    t = (F.when(pri == "1-URGENT", F.concat(F.lit("DATE AND TIME\n"), day, F.lit(" - "), later))
         .when(pri == "2-HIGH", F.concat(F.lit("DATE AND TIME\n"), day, F.lit("\n1:00 PM - 3:30 PM GMT+09:00")))
         .when(pri == "3-MEDIUM", F.concat(F.lit("開催 "), F.col("y").cast("string"), F.lit("年"), F.col("m").cast("string"), F.lit("月"), F.col("dd").cast("string"), F.lit("日")))
         .when(pri == "4-NOT SPECIFIED", F.concat(day, F.lit("\ndoors open")))
         .otherwise(F.lit("TBA")))
    r = d.ticket_span(t)
    out = lambda x: F.date_format(x, "yyyy-MM-dd HH:mm")
    return base(c).select("o_orderkey", out(r["start"]).alias("s"), out(r["end"]).alias("e"))


DEC = "y + CASE WHEN m2 < m AND m = 12 AND m2 <= 3 THEN 1 ELSE 0 END"
ST = DAY.format(DEC, "m2", "dd")
ST2 = DAY.format(DEC, "m2", "28")
ST3 = DAY.format(f"{DEC} + CASE WHEN m < m2 THEN 1 ELSE 0 END", "m", "15")


@query("h33_store_span", f"""
SELECT o_orderkey, {TEXT.format(ST)} AS s, {TEXT.format(f"CASE WHEN {ST} IS NOT NULL THEN " + P.format(ST2, ST3, ST, ST2, ST) + " END")} AS e FROM ({BASE_SQL})""")
def _(c):
    t = forms("◎{m2}月{dd}日（水）～28日（月）\n◎9階 催場", "◎{m2}月{dd}日（水）～{m}月15日（月）", "◎{m2}月{dd}日（水）", "◎ {m2}月{dd}日〜28日", "◎{m2}月{dd}日 のみ")
    r = d.store_span(t, F.col("o_orderdate"))
    return base(c).select("o_orderkey", fmt(r["start"]).alias("s"), fmt(r["end"]).alias("e"))


@query("h44_date_hint", """
SELECT id, '開催日時: ' || strftime(start_date, '%Y年%m月%d日') || CASE WHEN end_date IS NOT NULL AND end_date <> start_date THEN ' ～ ' || strftime(end_date, '%Y年%m月%d日') ELSE '' END || chr(10) || chr(10) || source_name AS text FROM ev""", "ev")
def _(c):
    return c.events().select("id", d.with_date_hint(F.col("source_name"), F.col("start_date"), F.col("end_date")).alias("text"))


@query("h6_date_in_range", f"""
SELECT id, coalesce(CAST(updated_at AS DATE) BETWEEN CAST(start_date AS DATE) - 1 AND CAST(end_date AS DATE), false) AS inside, coalesce(DATE '2024-01-20' BETWEEN CAST(start_date AS DATE) - 10 AND CAST(end_date AS DATE), false) AS fixed FROM ev""", "ev")
def _(c):
    inside = lambda v, back: d.date_in_range(v, F.col("start_date"), F.col("end_date"), back)
    return c.events().select("id", inside(F.col("updated_at"), 1).alias("inside"), inside(F.lit("2024-01-20").cast("date"), 10).alias("fixed"))
