"""Text, label, place, title and identifier rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from almanack.catalog.registry import query
from almanack.functions import markup, places, tags, text, titles, urls

# -- labels ------------------------------------------------------------------------------------

RULES = {"movie": ["tion the", "Euch"], "art": ["LES ", "mentre"], "tech": ["IT", "ai"], "nature": ["einer"], "urban": ["zzz"]}
REPORT = ["| ", "REPORT"]


def rules_sql(corpus, names):
    tests = [f"CASE WHEN {' OR '.join(f'contains({names}, {chr(39)}{w.lower()}{chr(39)})' for w in REPORT)} THEN 'report' END"]
    tests += [f"CASE WHEN {' OR '.join(f'contains({corpus}, {chr(39)}{w.lower()}{chr(39)})' for w in ws)} THEN '{k}' END" for k, ws in RULES.items()]
    return f"list_filter([{', '.join(tests)}], lambda x: x IS NOT NULL)"


CORPUS_SQL = "t AS (SELECT id, category, lower(concat_ws(' ', nullif(name_ja,''), nullif(name_zh,''), nullif(name_en,''))) AS names, lower(concat_ws(' ', nullif(name_ja,''), nullif(name_zh,''), nullif(name_en,''), nullif(description_ja,''), nullif(description_zh,''), nullif(description_en,''))) AS corpus FROM doc)"
NAMES = ["name_ja", "name_zh", "name_en"]


def labelled(c):
    d = c.docs().withColumns({"names": tags.joined(NAMES), "corpus": tags.joined([*NAMES, "description_ja", "description_zh", "description_en"])})
    return d.withColumn("found", tags.classify(F.col("names"), F.col("corpus"), RULES, REPORT))


@query("h9_classify", f"""
WITH {CORPUS_SQL}, f AS (SELECT id, {rules_sql('corpus', 'names')} AS found FROM t)
SELECT id, CASE WHEN len(found) > 0 THEN array_to_string(found, ',') ELSE 'senses' END AS labels FROM f""", "doc")
def _(c):
    return labelled(c).select("id", F.array_join("found", ",").alias("labels"))


@query("e8_backfill_labels", f"""
WITH {CORPUS_SQL}, f AS (SELECT id, category, {rules_sql('corpus', 'names')} AS found FROM t),
 a AS (SELECT id, category, list_filter(found, lambda x: x IN ('movie', 'tech', 'nature') AND NOT list_contains(category, x)) AS added FROM f)
SELECT id, array_to_string(list_sort(list_distinct(list_concat(category, added))), ',') AS tags FROM a WHERE len(added) > 0""", "doc")
def _(c):
    from almanack.operators.enrich import backfill_tags
    return backfill_tags(labelled(c), F.col("found"), ["movie", "tech", "nature"]).select("id", F.array_join("category", ",").alias("tags"))


@query("h10_valid_labels", """
SELECT id, CASE WHEN len(k) = 0 THEN 'senses' ELSE array_to_string(k, ',') END AS labels FROM (SELECT id, list_filter(category, lambda x: x IN ('art', 'lecture')) AS k FROM doc)""", "doc")
def _(c):
    return c.docs().select("id", F.array_join(tags.valid_labels(F.col("category"), ["art", "lecture"]), ",").alias("labels"))


JA = "CASE o_orderpriority WHEN '1-URGENT' THEN '映画上映とトーク' WHEN '2-HIGH' THEN '研究会と戦後' WHEN '3-MEDIUM' THEN '海峡の危機' WHEN '4-NOT SPECIFIED' THEN '音楽ドラマ映画' ELSE '入場無料 1000円' END || '（' || o_orderstatus || CAST(o_orderkey AS STRING) || '）'"


@query("h11_inject_labels", f"""
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'art,lecture' WHEN '2-HIGH' THEN 'art,lecture,history' WHEN '3-MEDIUM' THEN 'art,geopolitics' ELSE 'art' END AS labels FROM orders""")
def _(c):
    o = c.table("orders").withColumn("t", F.expr(JA))
    return o.select("o_orderkey", F.array_join(tags.inject_labels(F.array(F.lit("art")), F.col("t")), ",").alias("labels"))


@query("h12_genre_labels", """
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'tv_program,movie' WHEN '4-NOT SPECIFIED' THEN 'tv_program,drama' ELSE 'tv_program' END AS labels FROM orders""")
def _(c):
    o = c.table("orders").withColumn("t", F.expr(JA))
    return o.select("o_orderkey", F.array_join(tags.genre_labels(F.col("t")), ",").alias("labels"))


MYTAGS = {"src1": "art", "src2": "movie", "en": "business", "fr": "nature"}


@query("h13_tag_hints", r"""
SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter([CASE source WHEN 'src1' THEN 'art' WHEN 'src2' THEN 'movie' END, CASE lang WHEN 'en' THEN 'business' WHEN 'fr' THEN 'nature' END,
 CASE WHEN regexp_matches(text, '(?i)tion the|les eau') THEN 'movie' END, CASE WHEN regexp_matches(text, '(?i)einer|mentre') THEN 'lecture' END, 'taiwan_japan'], lambda x: x IS NOT NULL))), ',') AS labels FROM documents""")
def _(c):
    d = c.table("documents")
    got = tags.tag_hints(F.array(F.concat(F.lit("#"), F.col("source")), F.col("lang")), F.col("text"), MYTAGS, (("tion the|les eau", "movie"), ("einer|mentre", "lecture")))
    return d.select("doc_id", F.array_join(got, ",").alias("labels"))


LABELS = {"la": "movie", "the": "art", "le": "movie", "und": "history", "que": "tech"}
LABELS_SQL = "CASE {0} WHEN 'la' THEN 'movie' WHEN 'the' THEN 'art' WHEN 'le' THEN 'movie' WHEN 'und' THEN 'history' WHEN 'que' THEN 'tech' END"


@query("h14_parse_command", rf"""
WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '[,，\s]+'), lambda t: t <> '') AS t FROM conversations),
 m AS (SELECT conv_id, turn, list_filter(list_transform(t, lambda x: coalesce({LABELS_SQL.format('x')}, {LABELS_SQL.format('lower(x)')})), lambda x: x IS NOT NULL) AS k FROM w)
SELECT conv_id, turn, CASE WHEN len(k) > 0 THEN 'category' ELSE 'unknown' END AS kind, CASE WHEN len(k) > 0 THEN array_to_string(list_sort(list_distinct(k)), ',') END AS tags FROM m""")
def _(c):
    t = c.table("conversations")
    p = tags.parse_command(F.col("text"), LABELS)
    return t.select("conv_id", "turn", p["kind"].alias("kind"), F.array_join(F.array_sort(p["tags"]), ",").alias("tags"))


@query("h14_language_command", """
SELECT id, CASE WHEN lang = 'zh' THEN 'zh' WHEN lang = 'en' THEN 'en' WHEN lang = 'ja' THEN 'ja' END AS lang, CASE WHEN lang IN ('zh', 'en', 'ja') THEN 'lang' ELSE 'unknown' END AS kind FROM place""", "place")
def _(c):
    said = F.when(F.col("lang") == "zh", " 中文 ").when(F.col("lang") == "en", "English").when(F.col("lang") == "ja", "日本語").otherwise("??")
    p = tags.parse_command(said, LABELS)
    return c.places().select("id", p["lang"].alias("lang"), p["kind"].alias("kind"))


@query("h15_paid_words", """
SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN false END AS paid_ja,
 CASE WHEN contains(lower(o_orderstatus || ' ' || CAST(o_orderkey AS STRING)), 'f ') THEN false WHEN contains(CAST(o_orderkey AS STRING), '7') THEN true END AS paid_any FROM orders""")
def _(c):
    o = c.table("orders").withColumn("t", F.expr(JA)).withColumn("u", F.concat(F.col("o_orderstatus"), F.lit(" "), F.col("o_orderkey").cast("string")))
    return o.select("o_orderkey", text.is_paid(F.col("t")).alias("paid_ja"), text.is_paid(F.col("u"), ["f "], ["7"], any_case=True).alias("paid_any"))


@query("h15_paid_documents", """
SELECT doc_id, CASE WHEN contains(text, 'tion of') OR contains(text, 'einer') THEN false WHEN contains(text, 'ment ') THEN true END AS paid FROM documents""")
def _(c):
    return c.table("documents").select("doc_id", text.is_paid(F.col("text"), ["tion of", "einer"], ["ment "]).alias("paid"))


@query("h16_prices", r"""
SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN NULL WHEN o_orderpriority = '1-URGENT' THEN '¥0 / ¥' || CAST(o_custkey AS STRING) || '（税込）' ELSE '¥' || CAST(o_custkey AS STRING) || '（税込） / ￥9,' || CAST(o_custkey AS STRING) END AS price,
 CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderpriority <> '1-URGENT' AND o_custkey <> 0 END AS paid FROM orders""")
def _(c):
    k = F.col("o_custkey").cast("string")
    t = F.when(F.col("o_orderpriority") == "5-LOW", F.lit(None)).when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit("前売 ¥0 当日 ¥"), k, F.lit("（税込）"))).otherwise(
        F.concat(F.lit("前売¥"), k, F.lit("（税込） 当日 ¥"), k, F.lit("（税込） ￥9,"), k))
    return c.table("orders").select("o_orderkey", text.prices(t).alias("price"), text.ticket_paid(t).alias("paid"))


# -- markup and blocks -------------------------------------------------------------------------

@query("h17_html_plain", r"""SELECT page_id, md5(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '^\s+|\s+$', '', 'g')) AS text_md5 FROM pages""")
def _(c):
    return c.table("pages").select("page_id", F.md5(markup.html_text(F.col("html"), "plain")).alias("text_md5"))


@query("h17_html_visible")
def _(c):
    return c.table("pages").select("page_id", markup.html_text(F.col("html"), "visible").alias("text"))


@query("h17_html_lines")
def _(c):
    return c.table("pages").select("page_id", markup.html_text(F.col("html"), "lines").alias("text"))


# A page with a script, a style, line breaks and character references around a place's name.
WRITTEN_PAGE = (
    "'<html><script>var a=''<b>'';</script><style>p{}</style><p>' || coalesce(location_name, '') || '<br>A &amp; B &lt;' || CAST(id AS STRING)"
    " || '&gt;</p><div>' || chr(10) || chr(10) || ' x&#39;y&nbsp;&#x4e2d;</div></html>'"
)
TAIL = "'A & B <' || CAST(id AS STRING) || '>'"


@query("h17_written_modes", rf"""
SELECT id, trim(regexp_replace(coalesce(location_name, '') || ' ' || {TAIL}, '[ 　]+', ' ', 'g')) || ' x''y 中' AS visible,
 regexp_replace('var a='' ''; p{{}} ' || coalesce(location_name, '') || ' ' || {TAIL}, '[ 　]+', ' ', 'g') || ' x''y 中' AS spaced,
 'var a='''';p{{}}' || coalesce(location_name, '') || chr(10) || {TAIL} || chr(10) || 'x''y' || chr(160) || '中' AS lines FROM ev""", "ev")
def _(c):
    page = F.expr(WRITTEN_PAGE)
    return c.events().select("id", *[markup.html_text(page, mode).alias(mode) for mode in ("visible", "spaced", "lines")])


@query("h51_html_pairs")
def _(c):
    return c.table("pages").select("page_id", F.to_json(markup.html_kv(F.col("html"))).alias("pairs"))


@query("h51_html_pairs_written", """
SELECT id, location_name AS venue, source_name AS organizer FROM ev""", "ev")
def _(c):
    cell = lambda x: F.coalesce(F.regexp_replace(F.col(x), "&", "&amp;"), F.lit(""))
    page = F.concat(F.lit("<p>x<dl><dt>会場</dt><dd>"), cell("location_name"), F.lit("</dd></dl><table><tr><th>主催<td>"), cell("source_name"), F.lit("</table>"))
    kv = markup.html_kv(page)
    return c.events().select("id", F.nullif(kv["会場"], F.lit("")).alias("venue"), kv["主催"].alias("organizer"))


@query("h18_cut_noise", r"""
SELECT doc_id, md5(regexp_replace(split_part(split_part(text, 'http', 1), ' | ', 1), '^\s+|\s+$', '', 'g')) AS text_md5 FROM documents""")
def _(c):
    return c.table("documents").select("doc_id", F.md5(text.cut_at(F.col("text"), ["http", " | "])).alias("text_md5"))


@query("e11_clean_text", r"""
SELECT id, md5(n) AS text_md5 FROM (SELECT id, raw_description, nullif(regexp_replace(split_part(split_part(raw_description, 'http', 1), ' | ', 1), '^\s+|\s+$', '', 'g'), '') AS n FROM doc) WHERE n IS DISTINCT FROM raw_description""", "doc")
def _(c):
    from almanack.operators.enrich import clean_text
    return clean_text(c.plain_docs(), ["raw_description"], ["http", " | "]).select("id", F.md5("raw_description").alias("text_md5"))


LBL = ["日程", "時間", "会場", "主催"]


@query("h19_label_block", """
SELECT id, location_name || chr(10) || source_name AS venue, CASE WHEN is_active AND location_name IS NOT NULL THEN event_type END AS host FROM ev""", "ev")
def _(c):
    t = F.concat(F.lit("題\n日程：\n会場\n "), F.col("location_name"), F.lit(" \n\n"), F.col("source_name"), F.lit("\n主催:\n"),
                 F.when(F.col("is_active"), F.col("event_type")).otherwise(F.lit("")), F.lit("\n時間\n10時\n11時\n12時\n13時\n"))
    b = text.label_block(t, LBL)
    return c.events().select("id", text.label_value(b, "会場").alias("venue"), text.label_value(b, "主催").alias("host"))


@query("h19_next_line", "SELECT id, event_type AS period, CASE WHEN is_active THEN source_name END AS place FROM ev", "ev")
def _(c):
    t = F.concat(F.lit("期間\n"), F.col("event_type"), F.lit("\n場所\n"), F.when(F.col("is_active"), F.col("source_name")).otherwise(F.lit("")), F.lit("\n主催\n"))
    b = text.next_line(t, ["期間", "場所", "主催"])
    return c.events().select("id", text.label_value(b, "期間").alias("period"), text.label_value(b, "場所").alias("place"))


# -- places ------------------------------------------------------------------------------------

@query("h20_venue_by_label", "SELECT id, name AS venue, coalesce(nullif(trim(location_address), ''), '料金：無料') AS address FROM place", "place")
def _(c):
    t = F.concat(F.lit("日時：未定\n会　場："), F.col("name"), F.lit("（3階）\n住　所: "), F.coalesce("location_address", F.lit("")), F.lit("\n料金：無料"))
    return c.places().select("id", places.by_label(t, ["会場", r"会\s*場", "場所"], 2, 80, "[。（]").alias("venue"),
                             places.by_label(t, [r"住\s*所"], 3, 80).alias("address"))


@query("h20_venue_below_label", "SELECT id, name AS venue FROM place", "place")
def _(c):
    t = F.concat(F.lit("日時\n2026年\n会 場\n"), F.col("name"), F.lit("\n所在地\n東京"))
    return c.places().select("id", places.below_label(t, [r"会\s*場"], 5, 120).alias("venue"))


@query("h21_at_venue", "SELECT id, CASE WHEN balance >= 0 THEN name END AS venue FROM place", "place")
def _(c):
    t = F.concat(F.lit("4月18日 夜市"), F.when(F.col("balance") >= 0, F.lit("＠")).otherwise(F.lit(" ")), F.col("name"), F.lit("」） 続き"))
    return c.places().select("id", places.at_venue(t).alias("venue"))


@query("h22_venue_override", "SELECT id, CASE WHEN balance >= 0 THEN name || '（東京都）' END AS venue FROM place", "place")
def _(c):
    t = F.concat(F.lit("第3回\n"), F.when(F.col("balance") >= 0, F.lit("※ 会場は、")).otherwise(F.lit("会場: ")), F.col("name"), F.lit("（東京都） です。\n以上"))
    return c.places().select("id", places.override_venue(t).alias("venue"))


@query("h23_split_venue", """
SELECT id, CASE WHEN balance >= 0 THEN name || ' (東京都)' ELSE name || ' 大ホール' END AS venue, CASE WHEN balance >= 0 THEN '世田谷区' || source_name END AS address FROM place""", "place")
def _(c):
    t = F.when(F.col("balance") >= 0, F.concat(F.col("name"), F.lit(" (東京都)世田谷区"), F.col("source_name"), F.lit(" 会場マップ・アクセス方法はこちら→"))).otherwise(F.concat(F.col("name"), F.lit(" 大ホール ")))
    v, a = places.split_venue(t)
    return c.places().select("id", v.alias("venue"), a.alias("address"))


@query("h24_online", r"""
SELECT id, CASE WHEN regexp_matches(coalesce(location_name, ''), 'online|オンライン|ライブ配信|配信のみ|[Zz][Oo][Oo][Mm]') THEN 'オンライン' ELSE nullif(location_name, '') END AS venue,
 CASE WHEN regexp_matches(coalesce(location_name, ''), 'online|オンライン|ライブ配信|配信のみ|[Zz][Oo][Oo][Mm]') THEN 'オンライン' ELSE nullif(location_address, '') END AS address FROM place""", "place")
def _(c):
    n = F.col("location_name")
    return c.places().select("id", places.online_name(n).alias("venue"), places.online_address(n, F.col("location_address")).alias("address"))


@query("h38_blank_and_label", r"""
SELECT id, nullif(trim(location_address), '') IS NULL AS no_address, CASE WHEN trim(coalesce(location_address,'')) <> '' THEN ltrim(location_address, '：；:; 　') END AS address FROM place""", "place")
def _(c):
    shown = F.concat(F.lit("：; "), F.col("location_address"))
    a = F.when(text.blank_null(F.col("location_address")).isNotNull(), shown)
    return c.places().select("id", text.blank_null(F.col("location_address")).isNull().alias("no_address"), places.strip_label(a).alias("address"))


@query("h39_to_traditional", """
SELECT id, '東京' || CAST(id AS STRING) || '區會館' AS t FROM place""", "place")
def _(c):
    return c.places().select("id", places.to_traditional(F.concat(F.lit("东京"), F.col("id").cast("string"), F.lit("区会馆"))).alias("t"))


# -- titles ------------------------------------------------------------------------------------

@query("h34_split_title", """
SELECT p_partkey, CASE WHEN p_size < 15 THEN '阿嬤的夢中情人' WHEN p_size < 30 THEN '夢' || p_name WHEN p_size < 40 THEN NULL END AS zh, CASE WHEN p_size < 15 THEN p_name WHEN p_size >= 30 AND p_size < 40 THEN p_name END AS en FROM part""")
def _(c):
    t = (F.when(F.col("p_size") < 15, F.concat(F.lit("2025年\n原題：阿嬤的夢中情人 "), F.col("p_name"))).when(F.col("p_size") < 30, F.concat(F.lit("原題：夢"), F.col("p_name"), F.lit("\n監督")))
         .when(F.col("p_size") < 40, F.concat(F.lit("原題または英題： "), F.col("p_name"))).otherwise(F.col("p_name")))
    zh, en = titles.split_title(t)
    return c.table("part").select("p_partkey", zh.alias("zh"), en.alias("en"))


@query("h35_bracket_title", "SELECT p_partkey, CASE WHEN p_size < 25 THEN p_name ELSE p_brand || ' ' || p_name END AS title FROM part")
def _(c):
    t = F.when(F.col("p_size") < 25, F.concat(F.lit("台湾ドラマ「 "), F.col("p_name"), F.lit("　」 EP22「"), F.col("p_brand"), F.lit("」"))).otherwise(F.concat(F.col("p_brand"), F.lit(" "), F.col("p_name")))
    return c.table("part").select("p_partkey", titles.bracket_title(t).alias("title"))


@query("h36_swap_title", """
SELECT p_partkey, CASE WHEN p_size < 10 THEN '《N》と「N」と' || p_name || '、"' || p_brand || '"' ELSE '《' || p_name || '》と「' || p_name || '」と' || p_name || '、"N"' END AS t FROM part""")
def _(c):
    p, b = F.col("p_name"), F.col("p_brand")
    t = F.concat(F.lit("《"), p, F.lit("》と「"), p, F.lit("」と"), p, F.lit('、"'), b, F.lit('"'))
    old = F.when(F.col("p_size") < 10, p).otherwise(b)
    return c.table("part").select("p_partkey", titles.swap_title(t, [F.lit(""), old], F.lit("N")).alias("t"))


@query("h37_strip_report", r"""
SELECT id, trim(raw_title) AS t, nullif(CASE WHEN length(trim(raw_title)) >= 4 THEN source_name || 'zz' END, '') AS fragment FROM doc""", "doc")
def _(c):
    head = F.col("raw_title")
    t = F.concat(head, F.lit(" トー クイベント レポ ート 第2回"))
    u = F.concat(head, F.lit(" － "), F.col("source_name"), F.lit("zz 開催報告"))
    frag = F.regexp_replace(titles.report_fragment(F.regexp_replace(u, "開催", "")), "^ +", "")
    return c.plain_docs().select("id", F.trim(titles.strip_report(t)).alias("t"), F.when(F.length(F.trim(head)) >= 4, frag).alias("fragment"))


# -- identifiers -------------------------------------------------------------------------------

@query("h40_url_ids", r"""
SELECT page_id, nullif(regexp_extract(url, '/en/(\d+)', 1), '') AS num, nullif(regexp_extract(url, 'page=(\d+)', 1), '') AS param, split_part(regexp_replace(url, '/+$', ''), '/', -1) AS segment,
 left(regexp_replace(regexp_replace(lower(regexp_replace(url, 'https?://', '')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 60) AS slug FROM pages""")
def _(c):
    u = F.col("url")
    return c.table("pages").select("page_id", urls.url_id(u, "number", "en").alias("num"), urls.url_id(u, "param", "page").alias("param"),
                                   urls.url_id(u, "segment").alias("segment"), urls.url_id(u, "slug").alias("slug"))


@query("h41_hash_ids", """
SELECT page_id, 'gnews_' || left(md5(url), 12) AS a, 'p_' || left(md5(url), 8) AS b, left(sha1(url), 10) AS c FROM pages""")
def _(c):
    u = F.col("url")
    return c.table("pages").select("page_id", urls.stable_id("gnews_", u).alias("a"), urls.stable_id("p_", u, "md5", 8).alias("b"), urls.stable_id("", u, "sha1", 10).alias("c"))


@query("h41_slug_or_hash", r"""
SELECT page_id, CASE WHEN split_part(regexp_replace(url, '/+$', ''), '/', -1) LIKE '9%' THEN 's_' || split_part(regexp_replace(url, '/+$', ''), '/', -1) ELSE 's_' || left(sha1(url), 10) END AS sid FROM pages""")
def _(c):
    seg = urls.last_segment(F.col("url"))
    u = F.when(seg.startswith("9"), F.col("url")).otherwise(F.lit("https://x.example.org/honten/h/"))
    return c.table("pages").select("page_id", urls.slug_or_hash("s_", u, F.col("url"), ("", "honten", "h")).alias("sid"))


@query("h42_text_slug", r"""
SELECT id, left(trim(regexp_replace(regexp_replace(lower(trim(raw_title)), '[^\p{L}\p{N}\p{M}_]+', '_', 'g'), '_+', '_', 'g'), '_'), 60) AS slug FROM doc""", "doc")
def _(c):
    return c.plain_docs().select("id", text.slug(F.col("raw_title")).alias("slug"))


@query("h43_account_ids", r"""
SELECT page_id, coalesce(nullif(regexp_extract(url, '^https?://[a-z.-]+/en/([A-Za-z0-9_-]{2,})/?$', 1), ''), CASE WHEN page_id < 100 THEN 'user_' || CAST(page_id AS STRING) END) AS account FROM pages""")
def _(c):
    raw = F.when(F.col("url").rlike("/en/[A-Za-z0-9_-]{2,}/?$"), F.col("url")).when(F.col("page_id") < 100, F.concat(F.lit(" user_"), F.col("page_id").cast("string"), F.lit(" "))).otherwise(F.lit("not a name!"))
    return c.table("pages").select("page_id", urls.account_id(raw, r"[a-z.-]+", "en/").alias("account"))


@query("h45_snake_key", "SELECT p_partkey, lower(replace(p_name, ' ', '_')) AS k FROM part")
def _(c):
    name = F.concat(F.replace(F.initcap("p_name"), F.lit(" "), F.lit("")), F.lit("Scraper"))
    return c.table("part").select("p_partkey", text.snake(name).alias("k"))


@query("h46_article_url", "SELECT page_id, CASE WHEN url LIKE 'https%' AND NOT contains(url, 'blog.') THEN url ELSE 'https://link.example.org/' || CAST(page_id AS STRING) END AS u FROM pages")
def _(c):
    guid = F.when(F.col("url").startswith("https"), F.concat(F.lit(" "), F.col("url"))).otherwise(F.lit("tag:1"))
    link = F.concat(F.lit("https://link.example.org/"), F.col("page_id").cast("string"))
    return c.table("pages").select("page_id", urls.article_url(guid, link, "blog.").alias("u"))


@query("h47_length_limits", "SELECT doc_id, length(left(text, 500)) AS n500, md5(left(text, 2000)) AS m2000, md5(left(text, 20000)) AS m20000 FROM documents")
def _(c):
    t = F.col("text")
    return c.table("documents").select("doc_id", F.length(text.cut(t, 500)).cast("long").alias("n500"), F.md5(text.cut(t, 2000)).alias("m2000"), F.md5(text.cut(t, 20000)).alias("m20000"))


@query("h48_report_lines", """
WITH w AS (SELECT source, count(*) AS runs, round_even(CAST(count(*) FILTER (coalesce(success, true)) AS DOUBLE) / count(*), 2) AS rate, CAST(sum(events_processed) AS BIGINT) AS ev FROM runs WHERE ran_at >= TIMESTAMP '2024-01-18 12:00:00' GROUP BY source)
SELECT source, printf('  %s %s: %d 件 (%d 次, 成功率 %d%%)', CASE WHEN rate = 1.0 THEN '✅' WHEN rate >= 0.5 THEN '⚠' ELSE '❌' END, source, ev, runs, CAST(floor(rate * 100) AS INT)) AS line FROM w""", "runs")
def _(c):
    from almanack.operators.aggregates import weekly_by_source
    w = weekly_by_source(c.runs(), "2024-01-18 12:00:00")
    return w.select("source", text.report_line(F.col("source"), F.col("total_events"), F.col("runs"), F.col("success_rate")).alias("line"))


@query("h48_weekly_report", """
WITH w AS (SELECT source, count(*) AS runs, round_even(CAST(count(*) FILTER (coalesce(success, true)) AS DOUBLE) / count(*), 2) AS rate, CAST(sum(events_processed) AS BIGINT) AS ev, CAST(sum(cost_usd) AS DOUBLE) AS cost FROM runs WHERE ran_at >= TIMESTAMP '2024-01-18 12:00:00' GROUP BY source),
 t AS (SELECT CAST(sum(cost_usd) AS DOUBLE) AS cost, count(*) AS n FROM runs WHERE ran_at >= TIMESTAMP '2024-01-18 12:00:00'),
 e AS (SELECT count(*) FILTER (created_at >= TIMESTAMP '2024-01-18 12:00:00') AS fresh, count(*) FILTER (annotation_status = 'pending') AS pending FROM ev WHERE is_active),
 l AS (SELECT string_agg(printf('  %s %s: %d 件 (%d 次, 成功率 %d%%)', CASE WHEN rate = 1.0 THEN '✅' WHEN rate >= 0.5 THEN '⚠' ELSE '❌' END, source, ev, runs, CAST(floor(rate * 100) AS INT)), chr(10) ORDER BY source) AS lines FROM w)
SELECT '📊 週報' || chr(10) || printf('📅 %s ～', '2024-01-18') || chr(10) || chr(10) || printf('🆕 本週新增事件: %d 件', fresh) || chr(10) || printf('⏳ 待標注: %d 件', pending) || chr(10) || printf('💰 本週費用: $%.6f', cost) || chr(10) || printf('🔄 執行次數: %d 次', n) || chr(10) || chr(10) || '📋 各來源狀態:' || chr(10) || lines AS message FROM t, e, l""", "runs ev")
def _(c):
    from almanack.plans.broadcast import weekly_report
    return weekly_report(c.runs(), c.events(), "2024-01-18 12:00:00", "📊 週報")


@query("h50_card_fields", """
SELECT id, CASE WHEN balance >= 0 THEN '東京' ELSE '' END AS prefecture, name AS title, 'a ' || source_name || chr(10) || 'b' AS bullets, CASE WHEN balance < 5000 THEN '中野駅 徒歩' || source_name END AS station FROM place""", "place")
def _(c):
    lines = F.array(F.lit("2026.06.26 ～ 2026.06.28"), F.lit(""), F.col("name"), F.concat(F.lit(" - a "), F.col("source_name")), F.lit("- b"), F.lit("祭り"),
                    F.when(F.col("balance") >= 0, F.lit(" 東京 ")).otherwise(F.lit("海外")), F.when(F.col("balance") < 5000, F.concat(F.lit("中野駅 徒歩"), F.col("source_name"))).otherwise(F.lit("駐車場")))
    r = text.card_fields(lines, ["東京", "大阪"])
    return c.places().select("id", *[r[k].alias(k) for k in ("prefecture", "title", "bullets", "station")])


@query("h52_json_pick", """
SELECT event_id, json_extract_string(props, '$.k') AS plain, CASE WHEN user_id < 50 THEN event_type ELSE '' END AS nested FROM events""")
def _(c):
    doc = F.concat(F.lit('{"t": {"ja": '), F.when(F.col("user_id") < 50, F.concat(F.lit('"'), F.col("event_type"), F.lit('"'))).otherwise(F.lit('{"x": 1}')), F.lit(', "en": "e"}}'))
    return c.table("events").select("event_id", text.json_pick(F.col("props"), "k", "ja").alias("plain"), text.json_pick(doc, "t", "ja").alias("nested"))
