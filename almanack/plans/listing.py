"""Listing pages: one specification compiled into one lazy DataFrame."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almanack.functions.localized import localized_name
from almanack.operators import filters as f
from almanack.operators.joins import with_parent

SEARCHED = ("name_ja", "name_zh", "name_en", "description_ja", "description_zh", "description_en")


@dataclass(frozen=True)
class ListingSpec:
    """The filters of a listing. Empty values switch a filter off."""

    q: str = ""
    categories: str = ""
    time_mode: str = "active"
    from_: str = ""
    to: str = ""
    paid: str = ""
    region: str = ""
    active: str = "active"
    annotation: str = ""
    source: str = ""
    locale: str = "ja"

    def without(self, *names: str) -> ListingSpec:
        """The same filters with some switched off, for facet counts."""
        blank = {n: getattr(ListingSpec(), n) for n in names}
        return replace(self, **blank)


def public_rows(df: DataFrame, spec: ListingSpec, ref) -> DataFrame:
    out = f.visible(df)
    if spec.q:
        out = f.search(out, SEARCHED, spec.q)
    if spec.categories:
        out = f.by_category(out, spec.categories)
    if spec.time_mode == "active":
        out = f.ongoing(out, ref)
    elif spec.time_mode == "past":
        out = f.in_range(out, spec.from_, spec.to)
    return out.where(f.paid_match(spec.paid)).where(f.region_match(spec.region))


def listing(df: DataFrame, spec: ListingSpec, ref) -> DataFrame:
    """The public page: filtered rows in start order, each with its parent's name."""
    rows = f.flags(public_rows(df, spec, ref), ref)
    shown = with_parent(rows, df, localized_name(spec.locale)).select(
        "id",
        localized_name(spec.locale).alias("name"),
        "parent_name",
        F.slice("category", 1, 2).alias("tags"),
        "start_date",
        "end_date",
        "ended",
        "multi_day",
        "is_paid",
    )
    return shown.orderBy(F.asc_nulls_last("start_date"), "id")


# Filters of a listing by switch; a switch at this value lets every row pass.
OFF = {"q": "", "categories": "", "time_mode": "all", "paid": "", "region": "", "active": "all", "annotation": "", "source": ""}
#: What each facet counts: its column (an array counts each of its values) and the switch it belongs to.
FACETS = {
    "source_name": "source", "category": "categories", "is_paid": "paid", "is_active": "active", "annotation_status": "annotation",
}


def switch_tests(spec: ListingSpec, ref) -> dict[str, Column]:
    """The admin filter of every switch that is on, alone."""
    alone = lambda name: replace(ListingSpec(**OFF, locale=spec.locale, from_=spec.from_, to=spec.to), **{name: getattr(spec, name)})
    return {name: admin_predicate(alone(name), ref) for name, off in OFF.items() if getattr(spec, name) != off}


def masked_facets(df: DataFrame, tests: dict[str, Column], facets: dict[str, tuple[Column, str]]) -> DataFrame:
    """(facet, value, n): counts of all facets in one pass, each under every test but its own switch's.

    A row's failed tests make a bit mask. A row that fails none counts in every facet, one that fails
    a single test only in the facets of that switch, any other in none.
    """
    bit = {name: 1 << k for k, name in enumerate(tests)}
    mask = F.lit(0)
    for name, test in tests.items():
        mask = mask + F.when(test, F.lit(0)).otherwise(F.lit(bit[name]))
    fed = lambda switch: F.col("_mask").isin(0, bit.get(switch, 0))
    values = {name: F.transform(c, lambda x: x.cast("string")) if many else F.array(c.cast("string"))
              for name, (c, _) in facets.items() for many in [df.select(c.alias("c")).dtypes[0][1].startswith("array")]}
    entry = lambda name: F.transform(values[name], lambda v: F.struct(F.lit(name).alias("facet"), v.alias("value")))
    none = F.slice(entry(next(iter(facets))), 1, 0)
    lists = [F.when(fed(switch), F.coalesce(entry(name), none)).otherwise(none) for name, (_, switch) in facets.items()]
    marked = df.withColumn("_mask", mask).where(F.bit_count("_mask") <= 1)
    return marked.select(F.explode(F.concat(*lists)).alias("e")).select("e.*").groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))


def all_facets(df: DataFrame, spec: ListingSpec, ref, facets: dict[str, str] | None = None) -> DataFrame:
    """Every facet of the admin listing, from one scan."""
    return masked_facets(df, switch_tests(spec, ref), {c: (F.col(c), switch) for c, switch in (facets or FACETS).items()})


def admin_predicate(spec: ListingSpec, ref) -> Column:
    """All admin filters as one predicate, so that facets can drop their own."""
    tests: list[Column] = []
    if spec.q:
        tests.append(f.admin_match(spec.q, spec.locale))
    if spec.categories:
        tests.append(F.arrays_overlap("category", f.strings(spec.categories.split(","))))
    if spec.time_mode == "active":
        tests.append(f.is_ongoing(ref))
    elif spec.time_mode == "past":
        tests.append(f.admin_range("start_date", spec.from_, spec.to))
    tests.append(f.paid_match(spec.paid))
    tests.append(f.region_match_admin(spec.region))
    tests.append(f.state_match(spec.active, spec.annotation, spec.source))
    return f.all_of(tests)


def facet_counts(df: DataFrame, spec: ListingSpec, ref, facet: str = "source_name", switch: str = "source") -> DataFrame:
    """Counts per facet value under every filter but the facet's own."""
    return df.where(admin_predicate(spec.without(switch), ref)).groupBy(facet).agg(
        F.count(F.lit(1)).alias("n")
    )
