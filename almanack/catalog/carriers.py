"""Event-domain views over the given tables, in Spark and (for checks) in SQL.

The tables hold no event listings, so each domain table is derived from one of
them by plain column expressions. One expression text serves both engines
wherever the dialects agree; a pair ``(spark, duck)`` is given where they differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanack.sources.tables import read_table

REF = "2024-01-25 12:00:00"

TITLE = ("split_part(text, '\\n', 1)", "split_part(text, chr(10), 1)")
DIGIT = "substr(source, length(source), 1)"

LISTING_DOC = [
    ("id", "doc_id"),
    ("source_name", "source"),
    ("source_id", "CASE WHEN n_chars < 60 THEN 'd' || CAST(doc_id AS STRING) || '_sub1' ELSE 'd' || CAST(doc_id AS STRING) END"),
    ("source_url", "'https://' || source || '.example.org/e/' || CAST(doc_id AS STRING)"),
    ("original_language", "lang"),
    ("name_ja", "CASE WHEN lang = 'fr' THEN NULL WHEN lang = 'de' THEN '' ELSE title END"),
    ("name_zh", "CASE WHEN lang = 'fr' THEN title WHEN lang = 'en' THEN '' END"),
    ("name_en", "CASE WHEN lang = 'de' THEN title WHEN lang = 'en' THEN 'EN ' || title END"),
    ("description_ja", "CASE WHEN lang IN ('fr', 'es') THEN text END"),
    ("description_zh", "CASE WHEN lang = 'es' THEN text WHEN lang = 'de' THEN '' END"),
    ("description_en", "CASE WHEN lang IN ('en', 'de') THEN text END"),
    ("raw_title", "title"),
    ("raw_description", "text"),
    ("category", (
        "array_compact(array(CASE lang WHEN 'en' THEN 'movie' WHEN 'fr' THEN 'art' WHEN 'de' THEN 'lecture' ELSE 'history' END, "
        "CASE WHEN n_chars > 1500 THEN 'books_media' END, CASE WHEN contains(text, '@') THEN 'business' END, "
        "CASE WHEN contains(title, '|') THEN 'report' END, CASE WHEN quality = 1 THEN 'tech' END))",
        "list_filter([CASE lang WHEN 'en' THEN 'movie' WHEN 'fr' THEN 'art' WHEN 'de' THEN 'lecture' ELSE 'history' END, "
        "CASE WHEN n_chars > 1500 THEN 'books_media' END, CASE WHEN contains(text, '@') THEN 'business' END, "
        "CASE WHEN contains(title, '|') THEN 'report' END, CASE WHEN quality = 1 THEN 'tech' END], lambda x: x IS NOT NULL)")),
    ("start_date", (
        "timestamp_ntz'2024-01-01 09:00:00' + make_dt_interval(CAST(n_chars % 60 AS INT))",
        "TIMESTAMP '2024-01-01 09:00:00' + to_days(CAST(n_chars % 60 AS INT))")),
    ("end_date", (
        "CASE WHEN lang <> 'es' THEN timestamp_ntz'2024-01-01 18:00:00' + make_dt_interval(CAST(n_chars % 60 + length(title) % 9 AS INT)) END",
        "CASE WHEN lang <> 'es' THEN TIMESTAMP '2024-01-01 18:00:00' + to_days(CAST(n_chars % 60 + length(title) % 9 AS INT)) END")),
    ("is_paid", "toxic = 1"),
    ("is_active", "coalesce(quality, 1) = 1"),
    ("annotation_status", "CASE WHEN quality IS NULL THEN 'pending' WHEN toxic = 1 THEN 'error' WHEN quality = 1 THEN 'annotated' ELSE 'reviewed' END"),
    ("created_at", (
        "timestamp_ntz'2023-12-01 00:00:00' + make_dt_interval(0, 0, CAST(n_chars AS INT))",
        "TIMESTAMP '2023-12-01 00:00:00' + to_minutes(CAST(n_chars AS INT))")),
    ("official_url", "CASE WHEN contains(text, 'http') THEN 'https://official.example.org/' || CAST(doc_id AS STRING) END"),
    ("secondary_source_urls", (
        "CASE WHEN lang = 'de' THEN array('https://mirror.example.org/' || CAST(doc_id AS STRING)) ELSE CAST(array() AS array<string>) END",
        "CASE WHEN lang = 'de' THEN ['https://mirror.example.org/' || CAST(doc_id AS STRING)] ELSE CAST([] AS VARCHAR[]) END")),
    ("location_name", f"CASE {DIGIT} WHEN '0' THEN '新宿 区民ホール' WHEN '1' THEN '中山、会館' WHEN '3' THEN 'オンライン配信' WHEN '4' THEN '大阪 区民ホール' WHEN '6' THEN 'オンライン' WHEN '7' THEN '' END"),
    ("location_address", f"CASE {DIGIT} WHEN '0' THEN '東京都新宿区' WHEN '1' THEN '台北市中山区' WHEN '3' THEN '' WHEN '4' THEN '大阪府大阪市' WHEN '5' THEN '東京都港区 台北駐日経済文化代表処' WHEN '7' THEN '福岡県福岡市' WHEN '8' THEN '  ' WHEN '9' THEN '高雄市' END"),
    ("parent_event_id", "CASE WHEN n_chars < 300 THEN doc_id + 1 END"),
    ("lang", "lang"),
    ("n_chars", "n_chars"),
]

FROM_LABELS = {"category", "is_paid", "is_active", "annotation_status"}

LISTING_EVENT = [
    ("id", "event_id"),
    ("source_name", "event_type || '_' || CAST(CAST(floor(k / 10) AS INT) AS STRING)"),
    ("event_type", "event_type"),
    ("user_id", "user_id"),
    ("item", "k"),
    ("value", "value"),
    ("start_date", "ts"),
    ("end_date", (
        "CASE WHEN event_type <> 'signup' THEN ts + make_dt_interval(0, CAST(floor(value) AS INT)) END",
        "CASE WHEN event_type <> 'signup' THEN ts + to_hours(CAST(floor(value) AS INT)) END")),
    ("is_active", "event_type <> 'error'"),
    ("annotation_status", "CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'annotated' WHEN 'purchase' THEN 'reviewed' WHEN 'error' THEN 'error' ELSE 'pending' END"),
    ("created_at", "ts"),
    ("updated_at", (
        "ts + make_dt_interval(0, 0, CAST(floor(value) AS INT))",
        "ts + to_minutes(CAST(floor(value) AS INT))")),
    ("parent_event_id", "CASE WHEN k < 20 THEN event_id + 1 END"),
    ("location_name", "CASE WHEN k < 5 THEN NULL ELSE 'ホール' || CAST(k AS STRING) || ' 中野（会館' || CAST(CAST(floor(k / 7) AS INT) AS STRING) || '）' END"),
]

RUNS = [
    ("id", "id"),
    ("source", "source_name"),
    ("ran_at", "start_date"),
    ("events_processed", "CAST(floor(value / 10) AS INT)"),
    ("tokens_in", "user_id * 10"),
    ("tokens_out", "CAST(item * 7 AS BIGINT)"),
    ("cost_usd", "CAST(CAST(user_id * 10 + item AS DECIMAL(12,0)) / 1000 AS DECIMAL(12,6))"),
    ("success", "CASE WHEN event_type = 'error' THEN false WHEN event_type = 'signup' THEN NULL ELSE true END"),
    ("duration_seconds", "CAST(floor(value) AS BIGINT)"),
]

VIEWS = [("id", "id"), ("event_id", "item"), ("viewed_at", "start_date"), ("user_id", "user_id")]

PLACE = [
    ("id", "c_custkey"),
    ("name", "c_name"),
    ("source_name", "CASE c_mktsegment WHEN 'MACHINERY' THEN 'iwafu' WHEN 'BUILDING' THEN 'koryu' WHEN 'FURNITURE' THEN 'peatix' ELSE lower(c_mktsegment) END"),
    ("lang", "CASE WHEN c_nationkey < 8 THEN 'zh' WHEN c_nationkey < 14 THEN 'en' WHEN c_nationkey < 20 THEN 'ja' ELSE 'fr' END"),
    ("is_active", "c_acctbal >= 0"),
    ("status", "CASE WHEN c_acctbal < 0 THEN 'blocked' ELSE 'active' END"),
    ("location_name", "CASE WHEN c_nationkey % 6 = 0 THEN NULL WHEN c_nationkey % 6 = 1 THEN 'オンライン' WHEN c_nationkey % 6 = 2 THEN '' ELSE '会館' || CAST(c_nationkey AS STRING) END"),
    ("location_address",
     "CASE c_nationkey WHEN 0 THEN '東京都新宿区西新宿' WHEN 1 THEN '台北市中山区' WHEN 2 THEN '' WHEN 3 THEN NULL WHEN 4 THEN '大阪府大阪市北区' "
     "WHEN 5 THEN '東京都港区 台北駐日経済文化代表処' WHEN 6 THEN '台南市' WHEN 7 THEN '福岡県福岡市' WHEN 8 THEN '   ' WHEN 9 THEN '東京' "
     "WHEN 10 THEN '東　京' WHEN 11 THEN '台湾文化センター 千代田区' WHEN 12 THEN 'オンライン' WHEN 13 THEN 'Tokyo' WHEN 14 THEN '北海道札幌市' "
     "WHEN 15 THEN '渋谷区神南' WHEN 16 THEN '高雄市' WHEN 17 THEN '東 京' WHEN 18 THEN ' 東京都 ' WHEN 19 THEN '台灣台中' ELSE '愛知県' || c_name END"),
    ("balance", "c_acctbal"),
]

REGISTRY = [
    ("id", "p_partkey"),
    ("name", "p_name || ' ' || p_brand"),
    ("url", "'https://' || lower(replace(p_brand, '#', '')) || '.example.org/' || replace(p_name, ' ', '-') || '/' || CAST(p_partkey AS STRING)"),
    ("status", "CASE p_type WHEN 'ECONOMY' THEN 'candidate' WHEN 'MEDIUM' THEN 'researched' WHEN 'STANDARD' THEN 'recommended' WHEN 'PROMO' THEN 'not-viable' ELSE 'implemented' END"),
    ("agent_category", "CASE WHEN p_size < 10 THEN 'peatix_organizer' WHEN p_size < 20 THEN 'note_creator' ELSE 'general' END"),
    ("category", "CASE WHEN p_size > 40 THEN 'movie' WHEN p_size > 30 THEN 'unknown' END"),
    ("issue_url", "CASE WHEN p_size % 3 = 0 THEN 'https://issues.example.org/' || CAST(p_partkey AS STRING) WHEN p_size % 3 = 1 THEN '' END"),
    ("source_type", "CASE WHEN p_size < 15 THEN 'theater' WHEN p_size < 30 THEN 'museum' END"),
    ("scraper_source_name", "CASE WHEN p_size <> 50 THEN 'supp_' || CAST(p_size AS STRING) END"),
    ("source_profile", "CASE WHEN p_size % 4 = 0 THEN '{\"creator_id\": \"c' || CAST(p_partkey AS STRING) || '\", \"location_name\": \"Hall ' || CAST(p_size AS STRING) || '\", \"categories\": [\"art\"]}' WHEN p_size % 4 = 1 THEN '{\"location_name\": \"\"}' END"),
    ("first_seen_at", ("timestamp_ntz'2023-01-01 00:00:00' + make_dt_interval(CAST(p_size AS INT))", "TIMESTAMP '2023-01-01 00:00:00' + to_days(CAST(p_size AS INT))")),
]


def _exprs(spec, dialect: int) -> list[str]:
    out = []
    for name, e in spec:
        out.append(f"{e if isinstance(e, str) else e[dialect]} AS {name}")
    return out


class Carriers:
    """Lazily built domain tables over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    def plain_docs(self) -> DataFrame:
        """Listings without the columns that labels decide; no join."""
        base = self.table("documents").withColumn("title", F.expr(TITLE[0]))
        return base.selectExpr(*_exprs([x for x in LISTING_DOC if x[0] not in FROM_LABELS], 0))

    def docs(self) -> DataFrame:
        base = (
            self.table("documents")
            .join(self.table("labels"), "doc_id", "left")
            .withColumn("title", F.expr(TITLE[0]))
        )
        return base.selectExpr(*_exprs(LISTING_DOC, 0))

    def events(self) -> DataFrame:
        base = self.table("events").withColumn(
            "k", F.get_json_object("props", "$.k").cast("int")
        )
        return base.selectExpr(*_exprs(LISTING_EVENT, 0))

    def runs(self) -> DataFrame:
        return self.events().selectExpr(*_exprs(RUNS, 0))

    def views(self) -> DataFrame:
        return self.events().where("event_type = 'view'").selectExpr(*_exprs(VIEWS, 0))

    def places(self) -> DataFrame:
        return self.table("customer").selectExpr(*_exprs(PLACE, 0))

    def registry(self) -> DataFrame:
        return self.table("part").selectExpr(*_exprs(REGISTRY, 0))


CTES = {
    "doc": f"SELECT {', '.join(_exprs(LISTING_DOC, 1))} FROM (SELECT d.*, l.quality, l.toxic, {TITLE[1]} AS title FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)",
    "ev": f"SELECT {', '.join(_exprs(LISTING_EVENT, 1))} FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)",
    "runs": f"SELECT {', '.join(_exprs(RUNS, 1))} FROM ev",
    "views": f"SELECT {', '.join(_exprs(VIEWS, 1))} FROM ev WHERE event_type = 'view'",
    "place": f"SELECT {', '.join(_exprs(PLACE, 1))} FROM customer",
    "reg": f"SELECT {', '.join(_exprs(REGISTRY, 1))} FROM part",
}
