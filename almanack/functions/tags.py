"""Topic labels from words, genres, hints and commands."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from almanack.functions.base import strings

# Labels an annotator may use, and the label given when none is left.
VALID_LABELS = (
    "movie", "performing_arts", "senses", "retail", "nature",
    "tech", "tourism", "lifestyle_food", "books_media", "gender", "geopolitics",
    "art", "lecture", "taiwan_japan", "business", "academic", "competition",
    "indigenous", "history", "urban", "workshop", "report",
)
FALLBACK_LABEL = "senses"
REPORT_LABEL = "report"

# Words that add a label to an annotated row.
LECTURE_WORDS = (
    "座談", "講座", "座談会", "座談會", "トークイベント", "トークショー", "講演会", "講演",
    "シンポジウム", "勉強会", "例会", "基調講演", "映後座談", "セッション", "研究会", "フォーラム",
)
TALK_WORDS = ("トーク", "座談", "講演")
SCREENING_WORD = "上映"
GEOPOLITICS_WORDS = (
    "危機", "海峡", "独立", "民主化", "移民政策", "インド太平洋", "日台関係", "主権", "国際フォーラム",
    "給食政策", "デジタル政府", "行政×AI", "公共政策", "安全保障", "防衛",
)
HISTORY_WORDS = (
    "戦没", "植民地", "統治", "秘録", "同化", "傷痕", "アーカイブ", "慰霊", "戦争", "戦前", "戦後",
    "日本統治", "総督府", "霧のごとく", "大濛",
)

# Broadcast genres in the order they are tried.
GENRE_LABELS = (
    (("ドラマ",), "drama"),
    (("映画",), "movie"),
    (("音楽",), "performing_arts"),
    (("ドキュメンタリー", "教養", "報道"), "report"),
)
BROADCAST_LABEL = "tv_program"

# Site tags, title patterns, and the label every row gets.
TAG_LABELS = {
    "Culture": "art",
    "Festival": "senses",
    "Food": "lifestyle_food",
    "Shopping": "retail",
    "Music": "performing_arts",
    "Art": "art",
    "Exhibition": "art",
    "Film": "movie",
    "Movie": "movie",
    "Lecture": "lecture",
    "Academic": "academic",
    "Nature": "nature",
    "Tourism": "tourism",
    "Theater": "performing_arts",
    "Dance": "performing_arts",
    "Community": "taiwan_japan",
}
HINTS = (
    ("映画|film|movie|cinema", "movie"),
    ("concert|音楽|music|live", "performing_arts"),
    ("展覧|exhibition|exhibit|gallery|art", "art"),
    ("matsuri|festival|fes|祭", "senses"),
    ("food|restaurant|noodle|dish|cuisine|夜市|night market", "lifestyle_food"),
    ("lecture|seminar|talk|session|学術|研究", "lecture"),
    ("台湾|Taiwan|Taiwanese", "taiwan_japan"),
)
COMMON_LABEL = "taiwan_japan"

# Commands that choose a language.
LANGUAGE_COMMANDS = {
    "中文": "zh", "繁中": "zh", "zh": "zh", "中国語": "zh", "台語": "zh",
    "日本語": "ja", "日語": "ja", "ja": "ja", "japanese": "ja",
    "english": "en", "英語": "en", "en": "en",
}


def has_word(text: Column, words: Sequence[str]) -> Column:
    """Any of the words occurs; one short expression however long the list is."""
    return F.exists(strings(words), lambda w: F.contains(text, w))


def joined(cols: Sequence[Column | str]) -> Column:
    """Non-empty texts joined by spaces, lower case."""
    parts = [F.nullif(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in cols]
    return F.lower(F.concat_ws(" ", *parts))


def classify(
    names: Column,
    corpus: Column,
    rules: Mapping[str, Sequence[str]],
    report_words: Sequence[str] = (),
    fallback: str = FALLBACK_LABEL,
) -> Column:
    """Labels of all rules with a word in the text, in rule order; at least the fallback.

    ``rules`` is an input (label to words). The report label looks at names only and comes
    first. Pass texts from :func:`joined`, bound to columns, so that they are lowered once.
    """
    low = lambda words: [w.lower() for w in words]
    tests = [F.when(has_word(corpus, low(words)), F.lit(label)) for label, words in rules.items()]
    if report_words:
        tests.insert(0, F.when(has_word(names, low(report_words)), F.lit(REPORT_LABEL)))
    found = F.array_compact(F.array(*tests))
    return F.when(F.size(found) > 0, found).otherwise(strings([fallback]))


def valid_labels(c: Column, vocabulary: Sequence[str] = VALID_LABELS, fallback: str = FALLBACK_LABEL) -> Column:
    kept = F.filter(c, lambda x: x.isin(*vocabulary))
    return F.when(F.size(kept) > 0, kept).otherwise(strings([fallback]))


def inject_labels(c: Column, text: Column) -> Column:
    """Add lecture, geopolitics and history on word hits, keeping the order of the rest."""
    screening = F.array_contains(c, "movie") | text.contains(SCREENING_WORD)
    lecture = has_word(text, LECTURE_WORDS) | (screening & has_word(text, TALK_WORDS))
    wanted = F.array_compact(
        F.array(
            F.when(lecture, F.lit("lecture")),
            F.when(has_word(text, GEOPOLITICS_WORDS), F.lit("geopolitics")),
            F.when(has_word(text, HISTORY_WORDS), F.lit("history")),
        )
    )
    return F.concat(c, F.array_except(wanted, c))


def genre_labels(c: Column, genres=GENRE_LABELS, base: str = BROADCAST_LABEL) -> Column:
    """The base label, and the label of the first genre that occurs."""
    extra = F.coalesce(*[F.when(has_word(c, words), F.lit(label)) for words, label in genres])
    return F.array_compact(F.array(F.lit(base), extra))


def tag_hints(tags: Column, text: Column, table: Mapping[str, str] = TAG_LABELS, hints=HINTS, common: str = COMMON_LABEL) -> Column:
    """Labels of known tags and of title patterns plus the common one, sorted."""
    lookup = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    mapped = F.transform(tags, lambda t: F.element_at(lookup, F.trim(F.ltrim(t, F.lit("#")))))
    hit = F.array(*[F.when(text.rlike(f"(?iu){p}"), F.lit(label)) for p, label in hints], F.lit(common))
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(mapped, hit))))


def parse_command(c: Column, labels: Mapping[str, str], languages: Mapping[str, str] = LANGUAGE_COMMANDS) -> Column:
    """struct(kind, lang, tags): a language command, else known label tokens, else unknown."""
    table = lambda m: F.create_map(*[F.lit(x) for kv in m.items() for x in kv])
    pick = lambda m, t: F.coalesce(F.element_at(table(m), t), F.element_at(table(m), F.lower(t)))
    lang = pick(languages, F.trim(c))
    tokens = F.filter(F.split(c, r"(?U)[,，\s]+"), lambda t: t != "")
    tags = F.array_distinct(F.array_compact(F.transform(tokens, lambda t: pick(labels, t))))
    kind = F.when(lang.isNotNull(), F.lit("lang")).when(F.size(tags) > 0, F.lit("category")).otherwise(F.lit("unknown"))
    return F.struct(
        kind.alias("kind"), lang.alias("lang"), F.when(kind == "category", tags).alias("tags")
    )
