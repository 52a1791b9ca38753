"""Seed list against seed list, and seed list against registry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webstrata.functions import urls as U
from webstrata.operators import joins as J
from webstrata.plans.fixtures import Views
from webstrata.plans.registry import query
from webstrata.sources.tables import seeds_from_text

_SIDE = "select surt, id, row_number() over (partition by surt order by id) n from seed where seedlist_id = {}"
_COMPARE = f"""select case when l.id is null then 'right' when r.id is null then 'left' else 'common' end side, coalesce(l.surt, r.surt) surt, l.id left_id, r.id right_id
    from ({_SIDE.format(0)}) l full outer join ({_SIDE.format(1)}) r on l.surt = r.surt and l.n = r.n"""


def _lists(v: Views) -> tuple[DataFrame, DataFrame]:
    return v.seed.where("seedlist_id = 0"), v.seed.where("seedlist_id = 1")


@query(_COMPARE)
def seedlist_compare(v: Views) -> DataFrame:
    return J.compare_seedlists(*_lists(v))


@query(f"select surt, left_id from ({_COMPARE}) where side = 'common'")
def seedlist_common(v: Views) -> DataFrame:
    return J.compare_seedlists(*_lists(v)).where("side = 'common'").select("surt", "left_id")


@query("select surt, count(*) n from (select surt from seed where seedlist_id = 0 except all select surt from seed where seedlist_id = 1) group by surt")
def seedlist_only_left(v: Views) -> DataFrame:
    return J.compare_seedlists(*_lists(v)).where("side = 'left'").groupBy("surt").agg(F.count("*").alias("n"))


@query("select surt, count(*) n from (select surt from seed where seedlist_id = 1 except all select surt from seed where seedlist_id = 0) group by surt")
def seedlist_only_right(v: Views) -> DataFrame:
    return J.compare_seedlists(*_lists(v)).where("side = 'right'").groupBy("surt").agg(F.count("*").alias("n"))


@query("select surt, count(*) n from (select surt from seed where seedlist_id = 0 intersect all select surt from seed where seedlist_id = 1) group by surt")
def seedlist_common_as_bag(v: Views) -> DataFrame:
    left, right = _lists(v)
    return left.select("surt").intersectAll(right.select("surt")).groupBy("surt").agg(F.count("*").alias("n"))


_HOST = "lower(regexp_extract({}, '://([^/?#:]+)', 1))"
_SEEDS = f"select {_HOST.format('url')} k, max_by(id, struct_pack(s := surt, i := id)) seed_id, max(surt) surt from seed where seedlist_id = 0 group by 1"
_TITLES = f"select pi, name, {_HOST.format('gather_url')} k from title where gather_url <> ''"


def _keyed(v: Views) -> tuple[DataFrame, DataFrame]:
    seeds = v.seed.where("seedlist_id = 0").select("id", "surt", F.nullif(U.host(F.col("url")), F.lit("")).alias("key"))
    titles = v.title.where("gather_url <> ''").select("pi", "name", F.nullif(U.host(F.col("gather_url")), F.lit("")).alias("key"))
    return seeds, titles


@query(f"select s.seed_id, s.surt, t.pi, t.name title from ({_SEEDS}) s join ({_TITLES}) t on t.k = s.k")
def seed_registry_matches(v: Views) -> DataFrame:
    return J.seeds_with_titles(*_keyed(v))


@query(f"select s.seed_id, s.surt, t.pi, t.name title from ({_SEEDS}) s join ({_TITLES}) t on t.k = s.k order by surt, seed_id, pi limit 50 offset 50")
def seed_registry_matches_page(v: Views) -> DataFrame:
    """The second page of the matches in their order."""
    return J.matches_in_order(*_keyed(v)).offset(50).limit(50)


@query(f"select s.seed_id, s.surt from ({_SEEDS}) s where s.k not in (select k from ({_TITLES}))")
def seed_registry_unmatched(v: Views) -> DataFrame:
    return J.seeds_without_title(*_keyed(v))


_KEY = """concat('(', array_to_string(list_reverse(string_split(regexp_replace(lower(regexp_extract({0}, '://([^/?#:]+)', 1)), '^www[0-9]*\\.', ''), '.')), ','), ',)', regexp_replace(lower(regexp_extract({0}, '://[^/?#]*([^#]*)', 1)), '/+$', ''))"""


@query(f"""select s.seed_id, s.surt, t.pi, t.name title from (select {_KEY.format('url')} k, max_by(id, struct_pack(s := surt, i := id)) seed_id, max(surt) surt from seed group by 1) s
    join (select pi, name, {_KEY.format('gather_url')} k from title where gather_url <> '') t on t.k = s.k""")
def seed_registry_matches_by_page(v: Views) -> DataFrame:
    seeds = v.seed.select("id", "surt", U.comparison_key(F.col("url")).alias("key"))
    return J.seeds_with_titles(seeds, v.title.where("gather_url <> ''").select("pi", "name", U.comparison_key(F.col("gather_url")).alias("key")))


@query("select 2 seedlist_id, url, count(*) over () total_seeds from (select distinct case when regexp_matches(u, '^[a-zA-Z][a-zA-Z+.-]*://?') then u else concat('http://', u) end url from (select trim(case when page_id % 2 = 0 then url else regexp_replace(url, '^https?://', ' ') end) u from pages))")
def seed_text_import(v: Views) -> DataFrame:
    """A seed list from pasted text: lines trimmed, schemes implied, duplicates gone."""
    line = F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(F.regexp_replace("url", "^https?://", " "))
    seeds = seeds_from_text(v.table("pages").select(F.lit(2).alias("seedlist_id"), line.alias("text")))
    return seeds.select("seedlist_id", "url", seeds.agg(F.count("*")).scalar().alias("total_seeds"))
