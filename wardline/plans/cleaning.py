"""Loose spellings, times, demographic words, texts and lists as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.functions import clean
from wardline.operators import build, records, retrieval
from wardline.plans import adapters as A
from wardline.plans.registry import query

SPELLED = ["G - All Ages", " pg - children", "PG-13 - Teens 13 or older", "R - 17+ (violence & profanity)", "R+ - Mild Nudity", "Rx - Hentai", "0", "1", "2", "3", "4", "5", "g", "PG", "pg13", "r17", "R_PLUS", "rx", "", "something else"]
NAMES = ["G", "PG", "PG13", "R17", "RPLUS", "RX"] * 2 + ["G", "PG", "PG13", "R17", "RPLUS", "RX", "UNKNOWN", "SOMETHING ELSE"]


def nth(values: list[str], k):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(values) + 1).cast("int"))


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


@query(f"select p_partkey, {sql_list(NAMES)}[p_partkey % {len(NAMES)} + 1] bucket from part")
def loose_buckets(spark, sf_dir):
    """Rating buckets from descriptions, codes and names."""
    return A.read(spark, sf_dir, "part").select("p_partkey", clean.loose_bucket(nth(SPELLED, F.col("p_partkey"))).alias("bucket"))


@query("select event_id, case event_id % 4 when 0 then cast(floor(epoch(ts)) as bigint) when 1 then cast(epoch(date_trunc('day', ts)) as bigint) when 2 then cast(epoch(date_trunc('day', ts)) as bigint) + 86400 else 0 end as \"seconds\" from events")
def timestamp_cascade(spark, sf_dir):
    """Seconds from unix time, else the finish date, else the start date, else the epoch."""
    k, ts = F.col("event_id") % 4, F.col("ts")
    unix = F.when(k == 0, F.unix_timestamp(ts.cast("timestamp")).cast("string")).otherwise(F.lit("n/a"))
    finish = F.when(k == 1, F.date_format(ts, "yyyy-MM-dd")).when(k == 3, "2020-00-00")
    start = F.when(k == 2, F.date_format(F.date_add(ts.cast("date"), 1), "yyyy-MM-dd"))
    return A.read(spark, sf_dir, "events").select("event_id", build.event_time(unix, finish, start).alias("seconds"))


@query("select event_id, epoch_ms(cast(floor(epoch(ts)) as bigint) * 1000) as happened from events")
def unix_timestamps(spark, sf_dir):
    """Times of unix seconds."""
    rows = A.read(spark, sf_dir, "events").select("event_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("s"))
    return rows.select("event_id", F.timestamp_seconds("s").cast("timestamp_ntz").alias("happened"))


GENDERS, WORDS = ["F", "m", " female", "MAN", "woman", "x", ""], ["female", "male", "female", "male", "female", "unknown-gender", "unknown-gender"]
AGES, SAID = [1, 18, 25, 35, 45, 50, 56, 99], ["Under 18", "18-24", "25-34", "35-44", "45-49", "50-55", "56+", "unknown"]


@query(f"select c_custkey, {sql_list(WORDS)}[c_custkey % {len(WORDS)} + 1] gender, {sql_list(SAID)}[c_custkey % {len(SAID)} + 1] age from customer")
def demographic_words(spark, sf_dir):
    """Gender marks and age codes as words."""
    k = F.col("c_custkey")
    code = F.element_at(F.array(*[F.lit(a) for a in AGES]), (k % len(AGES) + 1).cast("int"))
    return A.read(spark, sf_dir, "customer").select("c_custkey", clean.gender_word(nth(GENDERS, k)).alias("gender"), clean.age_text(code).alias("age"))


@query("select c_custkey, case c_custkey % 4 when 0 then true when 1 then c_custkey % 8 = 1 when 2 then c_custkey % 3 = 0 else false end is_minor from customer")
def minor_cascade(spark, sf_dir):
    """Minors by the stated flag, else the description, else the age."""
    k, n = F.col("c_custkey") % 4, F.col("c_custkey")
    flag = F.when(k == 0, True)
    told = F.when(k == 1, F.when(n % 8 == 1, "age: UNDER 18").otherwise("25-34")).otherwise("")
    age = F.when(k == 2, F.when(n % 3 == 0, 12).otherwise(40))
    return A.read(spark, sf_dir, "customer").select("c_custkey", clean.is_minor(flag, told, age).alias("is_minor"))


@query("select event_id, case event_id % 3 when 0 then strftime(ts, '%Y%m%d%H%M%S') when 1 then strftime(ts, '%Y%m%d') || '000000' else '00000000000000' end key from events")
def sortable_keys(spark, sf_dir):
    """Fourteen digits that sort like the times they come from."""
    k, ts = F.col("event_id") % 3, F.col("ts")
    text = F.when(k == 0, F.date_format(ts, "yyyy-M-d'T'H:m:s")).when(k == 1, F.date_format(ts, "yyyy/MM/dd")).otherwise("no time")
    return A.read(spark, sf_dir, "events").select("event_id", clean.sort_key(text).alias("key"))


@query("select p_partkey, 'Title: ' || case when p_partkey % 5 = 0 then 'Unknown' else p_name end || '. Genres: ' || case when p_partkey % 3 = 0 then 'Not specified' else p_type end || '. Overview: ' || case when p_partkey % 2 = 0 then 'Not available' else p_brand || ' and more' end as text from part")
def item_text_triple(spark, sf_dir):
    """Title, genres and overview of an item as one line with defaults."""
    k = F.col("p_partkey")
    text = clean.item_text(F.when(k % 5 != 0, F.col("p_name")), F.when(k % 3 != 0, F.col("p_type")).otherwise("  "), F.when(k % 2 != 0, F.concat(F.lit("  "), "p_brand", F.lit("\n and\tmore"))))
    return A.read(spark, sf_dir, "part").select("p_partkey", text.alias("text"))


@query("select c_custkey, array_to_string(list_sort(list_distinct(list_filter([c_custkey % 7, 5, c_custkey % 3, 10], lambda x: x > 0))), ',') cutoffs, array_to_string(case when c_custkey % 5 = 5 then [] when c_custkey % 5 = 4 then [4, 9] else [c_custkey % 5, 4, 9] end, ',') firsts from customer")
def number_lists(spark, sf_dir):
    """Sorted positive cutoffs of a list, and numbers where they first stand."""
    k = F.col("c_custkey")
    text = F.concat_ws(", ", (k % 7).cast("string"), F.lit("5"), F.lit("x"), (k % 3).cast("string"), F.lit(""), F.lit("10"), F.lit("5"))
    parts = F.array((k % 5).cast("string"), F.lit("4"), F.lit("none"), (k % 5).cast("string"), F.lit("9"), F.lit(" 4 "))
    text_of = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
    return A.read(spark, sf_dir, "customer").select("c_custkey", text_of(clean.cutoffs(text)).alias("cutoffs"), text_of(clean.first_numbers(parts)).alias("firsts"))


@query("select conv_id, turn, case when instr(text, ' the ') > 0 then trim(substr(text, instr(text, ' the ') + 5)) else trim(text) end tail from (select conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) text from conversations)")
def marker_tail(spark, sf_dir):
    """The text after a marker."""
    rows = A.read(spark, sf_dir, "conversations")
    flat = clean.strip(F.regexp_replace("text", r"\s+", " "))
    return rows.select("conv_id", "turn", clean.after(flat, " the ").alias("tail"))


@query("""select event_id, case event_id % 3 when 2 then null else '{"id":' || event_id || '}' end line, case event_id % 3 when 2 then null when 1 then '{"id":' || event_id || '}' else '{"a":1}' || chr(10) || '{"id":' || event_id || '}' end span from events""")
def json_out_of_output(spark, sf_dir):
    """The last line that is an object, and the stretch from the first to the last brace, of generated output."""
    rows = A.read(spark, sf_dir, "events")
    last = F.concat(F.lit('{"id":'), "event_id", F.lit("}"))
    k = F.col("event_id") % 3
    text = F.when(k == 0, F.concat(F.lit('loading\n{"a":1}\n'), last, F.lit("\ndone"))).when(k == 1, F.concat(F.lit("```json\n"), last, F.lit("\n```"))).otherwise("nothing {here")
    return rows.select("event_id", clean.last_json_line(text).alias("line"), records.last_json(text).alias("span"))


@query("select p_partkey, case when p_partkey % 4 = 3 then null else 'tt' || case when length(cast(p_partkey * 977 as varchar)) < 7 then lpad(cast(p_partkey * 977 as varchar), 7, '0') else cast(p_partkey * 977 as varchar) end end tconst from part")
def title_ids(spark, sf_dir):
    """Title ids of seven digits or more from numbers with and without mark."""
    k, n = F.col("p_partkey") % 4, (F.col("p_partkey") * 977).cast("string")
    text = F.when(k == 0, n).when(k == 1, F.concat(F.lit("tt"), n)).when(k == 2, F.concat(F.lit(" "), n, F.lit(" "))).otherwise("")
    return A.read(spark, sf_dir, "part").select("p_partkey", clean.title_id(text).alias("tconst"))


@query(r"select doc_id, length(t) n, md5(t) digest, regexp_matches(text, '[一-鿿]') cjk from (select doc_id, text, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[　\t ]+', ' ', 'g'), '\n{4,}', chr(10) || chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') t from documents)")
def document_clean(spark, sf_dir):
    """Documents with unified line ends and blanks, as digests, and whether they hold CJK characters."""
    t = clean.clean_document(F.col("text"))
    return A.read(spark, sf_dir, "documents").select("doc_id", F.length(t).cast("long").alias("n"), F.md5(t).alias("digest"), records.has_cjk(F.col("text")).alias("cjk"))


@query(f"{A.PRELUDE}, b as (select u, i, row_number() over (partition by u order by ts desc, i desc) b from spl where split = 'train') select u, i, b - 5 n from b where b > 5")
def sft_targets(spark, sf_dir):
    """Training rows outside the profile's five latest, latest first."""
    return records.targets(A.split(spark, sf_dir).where("split = 'train'"), 5).select("u", "i", "n")


@query(
    """with recursive w as (select doc_id, coalesce(text, '') t from documents), p as materialized (select doc_id, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x)), lambda x: length(x) >= 4) l from w),
s as (select doc_id, l, 1 k, '' open_, cast([] as varchar[]) out from p
  union all select doc_id, l, k + 1, case when length(l[k]) > 650 then '' when length(open_) + length(l[k]) + (case when open_ = '' then 0 else 1 end) <= 650 then case when open_ = '' then l[k] else open_ || chr(10) || l[k] end else l[k] end,
  case when length(l[k]) > 650 then list_concat(list_concat(out, case when open_ = '' then [] else [open_] end), list_transform(range(0, greatest(1, length(l[k]) - 80), 570), lambda a: substr(l[k], a + 1, 650)))
    when length(open_) + length(l[k]) + (case when open_ = '' then 0 else 1 end) <= 650 then out else list_append(out, open_) end from s where k <= len(l)),
f as (select doc_id, case when open_ = '' then out else list_append(out, open_) end c from s where k = len(l) + 1)
select doc_id page, count(*) n, max(length(x)) longest, md5(string_agg(x, '|' order by o)) digest from (select doc_id, unnest(c) x, generate_subscripts(c, 1) o from f) group by 1"""
)
def chunk_packing(spark, sf_dir):
    """Paragraphs gathered into chunks, long ones sliding, as counts and digests per document."""
    rows = A.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("page"), F.coalesce("text", F.lit("")).alias("text"))
    parts = retrieval.paragraphs(rows, "page", r"(?!)")
    chunks = retrieval.packed_chunks(parts.select("page", "n", "text"))
    lists = chunks.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("n", "chunk"))).alias("x"))
    text = F.col("x.chunk")
    return lists.select("page", F.size("x").cast("long").alias("n"), F.array_max(F.transform(text, lambda c: F.length(c))).cast("long").alias("longest"), F.md5(F.array_join(text, "|")).alias("digest"))


@query("select vec_id, format('{:.3f}', round(cast(embedding[1] as double), 3) + 0.0) first, format('{:.3f}', round(cast(embedding[2] as double) * 2, 3) + 0.0) inner_, label from embeddings")
def nested_rounding(spark, sf_dir):
    """A nested record whose doubles are rounded wherever they stand."""
    e = F.col("embedding")
    nested = F.struct(e.alias("all"), F.create_map(F.lit("m"), F.struct((e[1].cast("double") * 2).alias("x"), "label")).alias("by"))
    rows = A.read(spark, sf_dir, "embeddings").select("vec_id", nested.alias("r"))
    rows = rows.select("vec_id", clean.rounded(F.col("r"), rows.schema["r"].dataType, 3).alias("r"))
    shown = lambda x: F.format_string("%.3f", x)
    return rows.select("vec_id", shown(F.col("r.all")[0]).alias("first"), shown(F.col("r.by")["m"]["x"]).alias("inner_"), F.col("r.by")["m"]["label"].alias("label"))


SQL_POLICY_TAGS = "list_filter([" + ", ".join("case when " + " or ".join(f"contains(t, '{w}')" for w in words) + f" then '{tag}' end" for tag, words in sorted(retrieval.POLICY_LEXICON.items())) + "], lambda x: x is not null)"
PHRASES = ["禁止暴力与血腥内容", "Protect the CHILD from alcohol", "成年人", "nothing here", "Horror and vulgar adult-oriented scenes", ""]


@query(f"select event_id, case when len(x) > 0 then array_to_string(x, '|') else 'general' end tags from (select event_id, {SQL_POLICY_TAGS} x from (select event_id, lower({sql_list(PHRASES)}[event_id % {len(PHRASES)} + 1] || ' ' || event_type) t from events))")
def policy_tags(spark, sf_dir):
    """Tags of policy phrases under the nine keyword lists."""
    text = F.concat(nth(PHRASES, F.col("event_id")), F.lit(" "), "event_type")
    return A.read(spark, sf_dir, "events").select("event_id", F.array_join(retrieval.tags(text, retrieval.POLICY_LEXICON), "|").alias("tags"))
