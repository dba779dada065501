"""The queries op1 to op10 and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import ann, decontamination, language_id, lm_scoring, near_dedup, packing, sharding, substring_dedup, toxicity, url_filters

URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("block", "net", "/de/"),
    ("allow", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
SHARDS = [f"shard-{i:02d}" for i in range(16)]
#: A prime of over a hundred slots for each shard.
SHARD_SLOTS = 1619


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder_is(mod: int, value: int, key: str = "doc_id") -> Column:
    """Whether crc32(key as text) mod ``mod`` is value; a null key is not."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % mod == value, F.lit(False))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs, ~remainder_is(4, 2))
    found = language_id.identify(docs, model)
    return found.select("doc_id", remainder_is(4, 2).alias("held_out"), "lang_pred", "score", "ambiguous")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = lm_scoring.train_and_score(docs, ~remainder_is(5, 1))
    return scored.select("doc_id", remainder_is(5, 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents"), "doc_id", SHARDS, SHARD_SLOTS)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~remainder_is(3, 1))
    return toxicity.score(docs, model).select("doc_id", remainder_is(3, 1).alias("held_out"), "score", "predicted")


QUERIES = {f.__name__: f for f in (op1_language_id, op2_lm_scoring, op3_url_filters, op4_substring_dedup, op5_packing, op6_simhash_near_dedup, op7_decontamination, op8_nearest_neighbours, op9_sharding, op10_toxicity)}

_URL_SQL = r"""
with parts as (
  select page_id, case when contains(url, '://') then url[instr(url, '://') + 3 :] else '' end as rest from pages
), urls as (
  select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from parts
), rules(verdict, rule_host, rule_path) as (
  values ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'), ('allow', 'example.net', '/de/8'), ('block', 'org', '/es/')
), fits as (
  select u.page_id, r.rule_host || r.rule_path as rule, r.verdict, row_number() over (partition by u.page_id order by length(r.rule_host) desc, length(r.rule_path) desc) as k
  from urls u join rules r on (u.host = r.rule_host or ends_with(u.host, '.' || r.rule_host)) and starts_with(u.path, r.rule_path)
)
select u.page_id, coalesce(u.host, '') as host, coalesce(u.path, '') as path, f.rule, coalesce(f.verdict, 'allow') as verdict
from urls u left join fits f on f.page_id = u.page_id and f.k = 1
"""

_SUBSTRING_SQL = r"""
with d as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), win as (
  select doc_id, i, array_to_string(w[i : i + 34], ' ') as k from (select doc_id, w, unnest(range(1, len(w) - 33)) as i from d where len(w) >= 35)
), twice as (
  select md5(k) as m from win group by 1 having count(*) > 1
), gone as (
  select distinct doc_id, unnest(range(i, i + 35)) as p from win join twice on md5(k) = m
), words as (
  select doc_id, unnest(w) as x, unnest(range(1, len(w) + 1)) as p from d
), kept as (
  select words.doc_id, count(*) as n, string_agg(x, ' ' order by words.p) as t from words anti join gone on words.doc_id = gone.doc_id and words.p = gone.p group by 1
)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(len(w) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(t, '')) as kept_sha256
from d left join kept on kept.doc_id = d.doc_id
"""

#: By brute force over all windows that share a shingle with an item; items of five words and more. A document
#: that is shorter than the item is one window.
_LEAK_SQL = r"""
with lows as (
  select 'd' as side, doc_id as id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents
  union all select 'b', item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') from benchmark
), w as (
  select side, id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w from lows
), s as (
  select side, id, len(w) as n, i - 1 as i, md5(array_to_string(w[i : i + 4], ' ')) as k from (select side, id, w, unnest(range(1, len(w) - 3)) as i from w where len(w) >= 5)
), item as (
  select id as item_id, n, k, count(*) as c from s where side = 'b' group by 1, 2, 3
), hit as (
  select distinct d.id as doc_id, item.item_id, d.n as words, item.n, d.i from s d join item on item.k = d.k where d.side = 'd'
), win as (
  select distinct doc_id, item_id, n, words, unnest(range(greatest(i - n + 5, 0), greatest(least(i, words - n), 0) + 1)) as start from hit
), held as (
  select win.doc_id, win.item_id, win.n, win.words, win.start, s.k, count(*) as c from win join s on s.side = 'd' and s.id = win.doc_id and s.i >= win.start and s.i < win.start + win.n - 4 group by all
), shared as (
  select h.doc_id, h.item_id, h.start, (least(h.words, h.n) - 4) + (h.n - 4) as total, sum(least(h.c, item.c)) as common from held h join item on item.item_id = h.item_id and item.k = h.k group by all
), best as (
  select doc_id, item_id, start, cast(common as double) / cast(total - common as double) as similarity, row_number() over (partition by doc_id, item_id order by cast(common as double) / cast(total - common as double) desc, start) as r from shared
)
select doc_id, item_id, cast(start as integer) as start, similarity from best where r = 1 and similarity >= 0.8
"""

#: The table is filled one claim at a time: st holds owners by slot, and how far down its list each shard is.
_SHARD_SQL = f"""
with recursive pref as (
  select i, ('0x' || md5('shard-' || lpad(cast(i as varchar), 2, '0') || '/offset')[:15])::bigint % {SHARD_SLOTS} as o,
         ('0x' || md5('shard-' || lpad(cast(i as varchar), 2, '0') || '/skip')[:15])::bigint % {SHARD_SLOTS - 1} + 1 as s
  from range({len(SHARDS)}) t(i)
), fill as (
  select 0 as step, cast([] as bigint[]) as taken
  union all
  select step + 1, list_append(taken, (
    select (p.o + j * p.s) % {SHARD_SLOTS} from range({SHARD_SLOTS}) r(j) where not list_contains(taken, (p.o + j * p.s) % {SHARD_SLOTS}) order by j limit 1))
  from fill join pref p on p.i = step % {len(SHARDS)} where step < {SHARD_SLOTS}
), owner as (
  select unnest(taken) as slot, (unnest(range({SHARD_SLOTS}))) % {len(SHARDS)} as i from fill where step = {SHARD_SLOTS}
), docs as (
  select doc_id, ('0x' || md5(coalesce(cast(doc_id as varchar), ''))[:15])::bigint % {SHARD_SLOTS} as slot from documents
)
select doc_id, cast(docs.slot as integer) as slot, 'shard-' || lpad(cast(i as varchar), 2, '0') as shard from docs join owner on owner.slot = docs.slot
"""

ORACLE_SQL = {"op3_url_filters": _URL_SQL, "op4_substring_dedup": _SUBSTRING_SQL, "op7_decontamination": _LEAK_SQL, "op9_sharding": _SHARD_SQL}
