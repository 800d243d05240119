"""Data-set building: samples, dense ids, splits, history tables, risk look-ups, sequence merges, input checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.functions.policy import DIMS
from wardline.operators import build, history
from wardline.plans import adapters as A
from wardline.plans import runner
from wardline.plans.registry import query
from wardline.sources.shared import tasks

BOUNDS = build.Bounds(least=20, most=200, positives=5, liked=6, sizes={True: 8, False: 60})

SQL_LISTS = """with anime as (select p_partkey raw_item, p_name title, p_type kind from part where p_partkey % 17 <> 0),
people as materialized (select c_custkey, c_name name, c_custkey % 10 = 0 is_minor from customer),
lists as (select name, l_partkey raw_item, case when l_linenumber = 7 then null else cast(l_quantity as bigint) % 11 end score, l_orderkey * 10 + l_linenumber n,
  case when l_orderkey % 3 = 0 then cast(floor(epoch(o_orderdate)) as bigint) when l_orderkey % 3 = 1 or l_orderkey % 2 = 0 then cast(epoch(date_trunc('day', o_orderdate)) as bigint) else 0 end ts
  from lineitem join orders on l_orderkey = o_orderkey join people on c_custkey = o_custkey),
valid as materialized (select * from lists where score > 0 and raw_item in (select raw_item from anime))"""
SQL_BUILD = f"""{SQL_LISTS}, cnt as (select name, count(*) total, count(*) filter (score > {BOUNDS.liked}) positives from valid group by 1),
pool as (select people.name, is_minor, total, positives, row_number() over (partition by is_minor order by md5('{BOUNDS.seed}|' || people.name), people.name) k from people join cnt on cnt.name = people.name where total between {BOUNDS.least} and {BOUNDS.most} and positives >= {BOUNDS.positives}),
chosen as materialized (select name, is_minor, total, positives, row_number() over (order by md5('{BOUNDS.seed + 2}|' || name), name) - 1 u from pool where k <= case when is_minor then {BOUNDS.sizes[True]} else {BOUNDS.sizes[False]} end),
last as (select u, raw_item, max({{'n': n, 'score': score, 'ts': ts}}) x from valid join chosen using (name) group by 1, 2),
ids as (select raw_item, row_number() over (order by raw_item) - 1 i from (select distinct raw_item from last)),
inter as materialized (select u, i, raw_item, x.score score, x.ts ts, x.score > {BOUNDS.liked} is_liked from last join ids using (raw_item)),
back as (select u, i, ts, row_number() over (partition by u order by ts desc, i desc) b, count(*) over (partition by u) n from inter where is_liked),
parts as materialized (select u, i, ts, case b when 1 then 'test' when 2 then 'valid' else 'train' end split from back where n >= 3)"""


def lists(spark, sf_dir):
    """List rows with scores, one of three kinds of time, and some without a score; the catalogue; the people."""
    items = A.read(spark, sf_dir, "part").where("p_partkey % 17 <> 0").select(F.col("p_partkey").alias("raw_item"), F.col("p_name").alias("title"), F.col("p_type").alias("kind"))
    people = A.read(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"), (F.col("c_custkey") % 10 == 0).alias("is_minor"))
    rows = A.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity").join(A.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate"), "l_orderkey")
    rows = rows.join(people.select(F.col("c_custkey").alias("o_custkey"), "name"), "o_custkey")
    k, day = F.col("l_orderkey") % 3, F.date_format("o_orderdate", "yyyy-MM-dd")
    unix = F.when(k == 0, F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).cast("string")).otherwise(" ")
    ts = build.event_time(unix, F.when(k == 1, day).otherwise("0000-00-00"), F.when((k == 2) & (F.col("l_orderkey") % 2 == 0), day))
    score = F.when(F.col("l_linenumber") != 7, F.col("l_quantity").cast("long") % 11)
    return rows.select("name", F.col("l_partkey").alias("raw_item"), score.alias("score"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("n"), ts.alias("ts")), items, people.select("name", "is_minor")


def built(spark, sf_dir):
    rows, items, people = lists(spark, sf_dir)
    rows = build.valid_ratings(rows, items)
    chosen = build.selected_users(people, rows, BOUNDS)
    inter = build.interactions_of(chosen, rows, BOUNDS)
    return chosen, inter, items


@query(f"{SQL_LISTS} select name, raw_item, count(*) n, max(ts) last from valid group by 1, 2")
def valid_list_rows(spark, sf_dir):
    """Rated rows of catalogue items with their times from whichever field has one."""
    rows, items, _ = lists(spark, sf_dir)
    return build.valid_ratings(rows, items).groupBy("name", "raw_item").agg(F.count("*").alias("n"), F.max("ts").alias("last"))


@query(f"{SQL_BUILD} select u, i, ts, split from parts")
def list_dataset_build(spark, sf_dir):
    """The split of the liked interactions of a sample of eligible users."""
    _, inter, _ = built(spark, sf_dir)
    return build.liked_split(inter).select("u", "i", "ts", "split")


@query(f"{SQL_BUILD} select u, name, is_minor, total, positives from chosen")
def list_dataset_users(spark, sf_dir):
    """The sampled users of both groups, numbered in one shuffled order."""
    chosen, _, _ = built(spark, sf_dir)
    return chosen.select("u", "name", "is_minor", "total", "positives")


@query(
    f"""{SQL_BUILD}, h as (select distinct u, i from parts where split = 'train'), j as (select h.u, h.i, inter.raw_item, inter.score, inter.ts, chosen.name, chosen.is_minor, chosen.total score_user, ids.raw_item raw_item_item, title
  from h join inter on inter.u = h.u and inter.i = h.i left join chosen on chosen.u = h.u left join ids on ids.i = h.i left join anime on anime.raw_item = ids.raw_item)
select *, row_number() over (partition by u order by ts, i) history_rank, count(*) over (partition by u) history_len, count(*) over (partition by u) - row_number() over (partition by u order by ts, i) + 1 reverse_rank from j"""
)
def list_history_table(spark, sf_dir):
    """Training pairs with interaction, user and item columns; a name that is taken gets a suffix."""
    chosen, inter, items = built(spark, sf_dir)
    own = inter.select("i", "raw_item").distinct().join(items.select("raw_item", "title"), "raw_item", "left")
    table = build.history_table(build.liked_split(inter), inter.select("u", "i", "raw_item", "score", "ts"), chosen.select("u", "name", "is_minor", F.col("total").alias("score")), own)
    return table.select("u", "i", "raw_item", "score", "ts", "name", "is_minor", "score_user", "raw_item_item", "title", "history_rank", "history_len", "reverse_rank")


@query(
    f"""{A.PRELUDE}, links as (select p_partkey raw, 'tt' || lpad(cast(p_partkey * 3 as varchar), 7, '0') tconst from part where p_partkey % 5 <> 0),
guide as (select 'tt' || lpad(cast(i * 3 as varchar), 7, '0') tconst, is_adult, {", ".join(DIMS)} from item where i % 3 <> 0), details as (select p_partkey raw, p_partkey % 7 = 0 adult from part where p_partkey % 2 = 0),
r as (select p_partkey i, links.tconst, {", ".join(f"coalesce({d}, 1) {d}" for d in DIMS)}, coalesce(is_adult, false) or coalesce(adult, false) is_adult, guide.tconst is null risk_missing
  from part left join links on links.raw = p_partkey left join guide on guide.tconst = links.tconst left join details on details.raw = p_partkey)
select *, greatest({", ".join(DIMS)}) risk_max, round(({" + ".join(DIMS)}) / 5, 4) risk_mean, {" + ".join(DIMS)} risk_sum from r"""
)
def risk_lookup_three_step(spark, sf_dir):
    """Items through links, annotations and details, with defaults where a step has nothing."""
    part = A.read(spark, sf_dir, "part").select("p_partkey")
    tconst = lambda c: F.concat(F.lit("tt"), F.lpad((F.col(c) * 3).cast("string"), 7, "0")).alias("tconst")
    links = part.where("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("raw"), tconst("p_partkey"))
    guide = A.items(spark, sf_dir).where("i % 3 <> 0").select(tconst("i"), "is_adult", *DIMS)
    details = part.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("raw"), (F.col("p_partkey") % 7 == 0).alias("adult"))
    return build.risk_lookup(part.select(F.col("p_partkey").alias("i"), F.col("p_partkey").alias("raw")), links, guide, details).drop("raw")


SQL_MORE = f"""{A.PRELUDE}, base as (select u, i from spl where split = 'train'), held as (select u, i from spl where split <> 'train'),
more as materialized (select u, (u * 13 + k * 7) % (select count(*) from item) i, k n from usr cross join (select unnest(generate_series(0, 19)) k) union all select u, i, 50 from spl where u % 3 = 0),
pairs as (select u, i, count(*) c, exists (select 1 from base b where b.u = more.u and b.i = more.i) b, exists (select 1 from held h where h.u = more.u and h.i = more.i) h from more group by 1, 2)"""


def merging(spark, sf_dir):
    rows = A.split(spark, sf_dir).select("u", "i", "split")
    n = A.items(spark, sf_dir).agg(F.count("*").alias("size"))
    # users come in few files: dealt before each becomes twenty rows
    made = A.users(spark, sf_dir).repartition(tasks(spark), "u").select("u", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("n")).join(F.broadcast(n), F.lit(True))
    made = made.select("u", ((F.col("u") * 13 + F.col("n") * 7) % F.col("size")).alias("i"), F.col("n").cast("long").alias("n"))
    more = made.unionByName(rows.where("u % 3 = 0").select("u", "i", F.lit(50).cast("long").alias("n")))
    return rows.where("split = 'train'"), more, rows.where("split <> 'train'")


@query(f"{SQL_MORE} select u, i, 'base' source from base union all select u, i, 'more' from pairs where not b and not h")
def sequence_merge(spark, sf_dir):
    """Training rows and what generated rows add to them."""
    return build.merged_sequences(*merging(spark, sf_dir))


@query(f"{SQL_MORE} select cast(sum(c) as bigint) n_more, cast(sum(c) filter (b) as bigint) n_in_base, cast(coalesce(sum(c) filter (not b and h), 0) as bigint) n_held_out, cast(sum(c - 1) filter (not b and not h) as bigint) n_repeated, count(*) filter (not b and not h) n_added from pairs")
def sequence_merge_counts(spark, sf_dir):
    return build.merge_counts(*merging(spark, sf_dir))


@query("""with s as (select c_custkey u, c_custkey % 10 = 0 is_minor, row_number() over (partition by c_custkey % 10 = 0 order by md5('31|' || c_custkey), c_custkey) k from customer)
select u, is_minor, row_number() over (order by md5('33|' || u), u) - 1 place from s where k <= case when is_minor then 10 else 40 end""")
def samples_shuffled_together(spark, sf_dir):
    """Samples of minors and adults in one shuffled order."""
    from wardline.operators.sampling import stratified

    who = A.users(spark, sf_dir)
    parts = [stratified(who.where(F.col("is_minor") == flag), "u", "is_minor", {flag: n}, 31) for flag, n in ((True, 10), (False, 40))]
    return build.shuffled_together(parts, "u", 33)


@query(f"{A.PRELUDE}, p as (select u, i, row_number() over (partition by u order by ts, i) pos from spl) select u, string_agg(i || ':' || pos, ',' order by i) ids from p group by 1")
def item_place_maps(spark, sf_dir):
    """Per user a map from item to place, as text."""
    maps = build.place_maps(A.interactions(spark, sf_dir), 3)
    return maps.select("u", F.array_join(F.transform(F.map_entries("ids"), lambda e: F.concat(e["key"].cast("string"), F.lit(":"), e["value"].cast("string"))), ",").alias("ids"))


VALUE = "case event_id % 50 when 0 then 'nan'::double when 1 then 'inf'::double when 2 then null else value end"


@query(f"""select "check", n from (select count(*) filter (v is null or isnan(v) or isinf(v)) a, count(*) filter (not coalesce(not isnan(v) and v >= 0 and v <= 50, false)) b, count(*) filter (event_type not in ('view', 'click')) c from (select event_type, {VALUE} v from events)) unpivot (n for "check" in (a as 'finite', b as 'in_range', c as 'known_type'))""")
def input_assertions(spark, sf_dir):
    """Counts of rows that break stated conditions, over values with planted faults."""
    k = F.col("event_id") % 50
    rows = A.read(spark, sf_dir, "events").select("event_type", F.when(k == 0, float("nan")).when(k == 1, float("inf")).when(k == 2, F.lit(None).cast("double")).otherwise(F.col("value")).alias("v"))
    return build.assertions(rows, {"finite": build.finite(F.col("v")), "in_range": ~F.isnan("v") & F.col("v").between(0, 50), "known_type": F.col("event_type").isin("view", "click")})


@query("select doc_id, source from documents order by doc_id limit 25 offset 10")
def documents_head(spark, sf_dir):
    """A stated stretch of the documents by id, as a limited run takes it."""
    return build.head(A.read(spark, sf_dir, "documents").select("doc_id", "source"), 25, 10, "doc_id")


@query("select c_custkey raw, c_name from customer where c_custkey in (7, 42, 100)")
def raw_id_lookup(spark, sf_dir):
    """Rows of a few raw ids."""
    return A.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("raw"), "c_name").where(F.col("raw").isin(7, 42, 100))


@query(
    f"""{A.PRELUDE}, b as (select u, i, 'train' p from spl where split = 'train' union select u, i, 'train_valid_test' from spl union select u, i, 'last5' from hist where back <= 5 and n >= 3
  union select u, i, 'all_and_pools' from spl union select u, unnest([(i * 3 + 1) % 1000, (u + i) % 1000]), 'all_and_pools' from spl where split = 'test')
select u, p as policy, (select count(*) from item) - count(distinct item.i) eligible, min(item.i) first_blocked from b join item on item.i = b.i group by 1, 2"""
)
def block_policies(spark, sf_dir):
    """What each policy of blocked items leaves of the catalogue per user."""
    rows = A.split(spark, sf_dir)
    test = rows.where("split = 'test'").select("u", F.explode(F.array((F.col("i") * 3 + 1) % 1000, (F.col("u") + F.col("i")) % 1000)).alias("i"))
    last = history.last_k(A.interactions(spark, sf_dir), 5).join(rows.select("u").distinct(), "u", "left_semi")
    seen = rows.select("u", "i")
    parts = {"train": rows.where("split = 'train'").select("u", "i"), "train_valid_test": seen, "last5": last.select("u", "i"), "all_and_pools": seen.union(test)}
    blocked = reduce(DataFrame.union, [p.select("u", "i", F.lit(n).alias("policy")) for n, p in parts.items()]).distinct()
    items = A.items(spark, sf_dir).select("i")
    n = items.agg(F.count("*").alias("n"))
    own = blocked.join(items, "i").groupBy("u", "policy").agg(F.count("*").alias("c"), F.min("i").alias("first_blocked"))
    return own.join(F.broadcast(n), F.lit(True)).select("u", "policy", (F.col("n") - F.col("c")).alias("eligible"), "first_blocked")


@query("with l as (select event_id % 40 epoch, round(avg(value), 6) ndcg from events where event_id % 7 <> 0 group by 1) select epoch, ndcg from l order by ndcg desc, epoch limit 1")
def best_epoch(spark, sf_dir):
    """The best row of a training log."""
    log = A.read(spark, sf_dir, "events").where("event_id % 7 <> 0").groupBy((F.col("event_id") % 40).alias("epoch")).agg(F.round(F.avg("value"), 6).alias("ndcg"))
    return runner.best_epoch(log, "ndcg")
