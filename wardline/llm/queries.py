"""The queries op1 to op13: each operator over its whole table, with the digests its contract names."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm import alignment, decontamination, fingerprints, language_id, line_dedup, packing, quality_rules, resampling, secret_scan, simhash, substring_dedup, toxicity, url_filters
from wardline.llm.common import table


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def piece_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def sha256(text: str):
    return F.sha2(F.col(text), 256)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", sha256("kept_text").alias("kept_sha256"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge_urls(table(spark, sf_dir, "pages"), url_filters.rule_table(spark))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_file())
    return rows.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secret_scan.secret_spans(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return rows.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(secret_scan.listed(base), 256).alias("base_sha256"),
        secret_scan.listed(F.col("spans")).alias("spans"),
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_dropped", sha256("kept_text").alias("kept_sha256"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.apply_policy(quality_rules.ledger(table(spark, sf_dir, "documents")))
    failed = F.col("fail_bits").bitwiseAND(F.lit(quality_rules.mask("base"))) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "kept", "fail_bits", "policy")


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of each policy does alone, from the ledger of operator 7."""
    rows = quality_rules.ledger(table(spark, sf_dir, "documents")).select("fail_bits")
    # the ledger's bit patterns are counted once; every policy reads the counts
    parts = [quality_rules.ablations(rows, p).select(F.lit(p).alias("policy"), "*") for p in quality_rules.POLICIES]
    return reduce(DataFrame.union, parts)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    digits = lambda name: F.lower(F.lpad(F.hex(name), 16, "0"))
    return rows.select("doc_id", digits("fp").alias("fingerprint"), "component_id", digits("component_fp").alias("component_fingerprint"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "item_id", "matched", "first")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), tokenizer_file(), piece_file())


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_substring_dedup, op2_url_filters, op3_packing, op4_language_id, op5_secret_scans, op6_line_dedup, op7_quality_rules, op8_simhash, op9_decontamination, op10_toxicity, op11_fingerprints, op12_alignment, op13_resampling, quality_ablations)
}

WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]"

#: The quality ledger in SQL: measurements and one bit per rule.
LEDGER = rf"""
with d as materialized (select doc_id, coalesce(text, '') text, regexp_extract_all(coalesce(text, ''), '{WORD}') w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) l from documents),
g as (select doc_id, s, array_to_string(list_slice(w, s, s + 7), ' ') g from d, unnest(generate_series(1, len(w) - 7)) t(s) where len(w) >= 8),
r8 as (select doc_id, s from g qualify count(*) over (partition by doc_id, g) > 1),
c as (select doc_id, count(distinct i) n from (select doc_id, unnest(generate_series(s, s + 7)) i from r8) group by 1),
m8 as (select doc_id, cast(len(w) as bigint) n_words, cast(length(regexp_replace(text, '{BLANK}', '', 'g')) as bigint) word_chars, cast(length(text) - length(translate(text, '#*$%&|<>', '')) as bigint) n_symbols,
  cast(len(l) as bigint) n_lines, cast(len(l) - len(list_distinct(l)) as bigint) n_dup_lines, coalesce(n, 0) n_repeat_words,
  cast(length(regexp_replace(text, '[^A-Z]', '', 'g')) as bigint) n_capitals, cast(len(list_filter(w, lambda x, i: i > 1 and x = w[i - 1])) as bigint) n_stutter from d left join c using (doc_id)),
b as (select *, cast({" + ".join(f"(case when {rule} then {1 << i} else 0 end)" for i, (_, rule) in enumerate(quality_rules.RULES))} as bigint) fail_bits from m8)"""

#: Query 9 in SQL: the same seeds and verification, positions by list functions.
SPLIT = rf"list_filter(regexp_split_to_array(lower(case when regexp_matches(t, '[{decontamination.UNSPACED_SQL}{decontamination.MARKS_SQL}]') then regexp_replace(regexp_replace(t, '[{decontamination.MARKS_SQL}]', ' ', 'g'), '([{decontamination.UNSPACED_SQL}])', ' \1 ', 'g') else t end), '{decontamination.SEPARATORS_SQL}'), lambda x: x <> '')"


def sql_seed(mask: tuple, at: str) -> str:
    return " || ' ' || ".join(f"w[{at} + {i + 1}]" for i in mask)


def sql_decontamination() -> str:
    masks = (*decontamination.MASKS, decontamination.SHORT, decontamination.WHOLE)
    spans = (*[decontamination.SPAN] * len(decontamination.MASKS), len(decontamination.SHORT), decontamination.EXACT)
    places = [f"select id, n, unnest(range(0, n - {decontamination.SPAN - 1})) q, w from items where n >= {decontamination.SPAN}"] * len(decontamination.MASKS)
    places += [f"select id, n, unnest({list(decontamination.SHORT_AT)}) q, w from items where n between {decontamination.SPAN} and {decontamination.SURE - 1}", f"select id, n, 0 q, w from items where n < {decontamination.SPAN}"]
    keys = " union all ".join(f"select id, n, q, {m} m, {sql_seed(mask, 'q')} seed from ({place})" for m, (mask, place) in enumerate(zip(masks, places, strict=True)))
    seeds = " union all ".join(f"select d, p, {m} m, {sql_seed(mask, 'p')} seed from (select d, w, unnest(range(0, len(w) - {span - 1})) p from docs)" for m, (mask, span) in enumerate(zip(masks, spans, strict=True)))
    return f"""with docs as materialized (select row_number() over () d, doc_id, {SPLIT} w from (select distinct doc_id, text t from documents)),
items as materialized (select row_number() over () id, item_id, w, len(w) n from (select item_id, {SPLIT} w from (select distinct item_id, text t from benchmark)) where len(w) >= {decontamination.EXACT}),
keys as materialized ({keys}), seeds as ({seeds}),
hits as (select distinct d, id, p - q s from seeds join keys using (m, seed)),
eq as (select hits.d, id, s, n, least(n, 13) wide, list_transform(range(greatest(s, 0), least(len(docs.w), greatest(s, 0) + n)), lambda j: case when docs.w[j + 1] = items.w[j - s + 1] then 1 else 0 end) e from hits join docs using (d) join items using (id)),
best as (select d, id, s, n, wide, list_max(list_transform(range(0, greatest(0, len(e) - wide) + 1), lambda a: list_sum(e[a + 1:a + wide]))) matched from eq)
select doc_id, item_id, cast(max(matched) as bigint) matched, cast(min(s) filter (matched >= case when best.n < {decontamination.SPAN} then best.n else ceil(wide * 0.8::double) end) as bigint) as first
from best join docs using (d) join items using (id) group by d, doc_id, item_id having first is not null"""




def sql_fingerprints() -> str:
    """Query 11 in SQL: whole texts by Horner's rule, spans doubled up from their halves."""
    f = fingerprints
    p, b = f.PRIME, f.BASES[0]
    whole = ", ".join(f"list_reduce(list_prepend(0::bigint, list_reverse(c)), lambda a, x: (a * {base} + x) % {p}) w{i}" for i, base in enumerate(f.BASES))
    doubled = "".join(f"h{2 * w} as (select *, (x + lead(x, {w}) over q * {pow(b, w, p)}) % {p} y from h{w} window q as (partition by id, kind order by i)),\nd{2 * w} as (select id, kind, i, n, y x from h{2 * w}),\n".replace(f"from h{w} window", f"from {'d' if w > 1 else 'h'}{w} window") for w in (1, 2, 4, 8))
    narrow = f"select id, kind, (x + coalesce(lead(x, 1) over q, 0) * {b} + coalesce(lead(x, 2) over q, 0) * {pow(b, 2, p)}) % {p} v, i, n, {f.NARROW} w from h1 where n < {f.NARROW_TO} window q as (partition by id, kind order by i)"
    near = lambda x, y: f"case when {x}.f = {y}.f then 1.0::double else len(list_filter(range(1, {f.SLOTS + 1}), lambda j: {x}.s[j] = {y}.s[j] and {x}.s[j] <> 'ff'))::double / greatest(1, len(list_filter(range(1, {f.SLOTS + 1}), lambda j: {x}.s[j] <> 'ff' or {y}.s[j] <> 'ff'))) end"
    reach = lambda x, y: f"coalesce(list_position(list_transform(range(1, least(len({x}.c), len({y}.c)) + 1), lambda j: {x}.c[j] = {y}.c[j]), false) - 1, least(len({x}.c), len({y}.c)))::bigint"
    return f"""
with o as (select doc_id, coalesce(text, '') t, row_number() over (order by doc_id desc) r, count(*) over () m from documents),
two as (select o.doc_id id, x.doc_id following, o.t, left(o.t, length(o.t) - length(o.t) // 3) || left(x.t, length(o.t) // 3) e from o join o x on x.r = o.r % o.m + 1),
texts as materialized (select id, kind, t, list_transform(regexp_extract_all(t, '(?s).'), lambda x: unicode(x)::bigint + 1) c from (select id, 0 kind, t from two union all select id, 1, e from two)),
wholes as materialized (select id, kind, {whole} from texts),
h1 as materialized (select id, kind, unnest(c) x, unnest(range(len(c))) i, len(c) n from texts),
{doubled}spans as (select id, kind, x v, i, n, {f.WIDE} w from d{f.WIDE} where n >= {f.WIDE_FROM} union all {narrow}),
least_ as (select id, kind, (v * {f.SPREAD} % {p}) >> {f.SLOT_BITS} slot, min(v * {f.SPREAD} % {p} & {(1 << f.SLOT_BITS) - 1}) x from spans where i <= n - least(w, n) group by all),
slots as (select id, kind, map_from_entries(list((slot, x))) s from least_ group by all),
prints as materialized (select texts.id, texts.kind, t, c, list_transform(range({f.SLOTS}), lambda j: coalesce(printf('%02x', s[j] % {f.EMPTY}), 'ff')) s, printf('%08x%08x', w0, w1) w from texts join wholes using (id, kind) left join slots using (id, kind)),
f as materialized (select *, w || array_to_string(s, '') f from prints)
select a.id doc_id, len(a.c)::bigint n_chars, sha256(b.t) edited_sha256, a.f fingerprint, b.f edited_fingerprint, {near("a", "b")} near_edited, {near("a", "x")} near_next, {reach("a", "b")} prefix_edited, {reach("a", "x")} prefix_next
from f a join f b on a.id = b.id and a.kind = 0 and b.kind = 1 join two on two.id = a.id join f x on x.id = two.following and x.kind = 0"""


#: Query 13 in SQL: crc32 by its table over the bytes of each distinct feature.
RESAMPLED = r"""
with recursive words(kind, id, w) as (select kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')
  from (select 0 kind, doc_id id, text from documents union all select 1, null, text from benchmark)),
runs as materialized (select kind, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) f from words),
crcs as materialized (select list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, b: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) t),
features as (select distinct f, list_transform(regexp_extract_all(hex(encode(f)), '..'), lambda x: cast('0x' || x as bigint)) b from (select distinct f from runs)),
buckets as materialized (select f, xor(list_reduce(list_prepend(4294967295::bigint, b), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) % 10000 k from features cross join crcs),
n as (select k, count(*) filter (kind = 0)::double s, count(*) filter (kind = 1)::double t from runs join buckets using (f) group by k),
gain as (select k, floor(1000 * ln((t + 1) * (sum(s) over () + 10000) / ((s + 1) * (sum(t) over () + 10000)))) g from n),
summed as (select id, count(*) n_features, sum(g)::bigint weight from runs join buckets using (f) join gain using (k) where kind = 0 group by id),
scored as (select doc_id, len(w) n_words, coalesce(n_features, 0) n_features, coalesce(weight, 0) weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((cast('0x' || sha256('42:' || doc_id)[1:8] as bigint) + 0.5) / 4294967296.0::double)))::bigint score
  from (select id doc_id, w from words where kind = 0) left join summed on doc_id = id),
ranked as (select *, case when n_words >= 20 then row_number() over (partition by n_words >= 20 order by score desc, doc_id) end r, count(*) filter (n_words >= 20) over () able from scored)
select doc_id, cast(n_features as bigint) n_features, weight, score, case when r <= 5 * able // 100 then r end "rank" from ranked"""

ORACLE: dict[str, str] = {
    "op11_fingerprints": sql_fingerprints(),
    "op13_resampling": RESAMPLED,
    "op1_substring_dedup": rf"""
with d as materialized (select doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') w from documents),
wins as materialized (select doc_id, s, md5(array_to_string(list_slice(w, s, s + 19), ' ')) g from d, unnest(generate_series(1, len(w) - 19)) t(s) where len(w) >= 20),
firsts as (select g, min((doc_id, s)) f from wins group by g),
gone as (select distinct doc_id, i from (select wins.doc_id, unnest(generate_series(s, s + 19)) i from wins join firsts using (g) where (doc_id, s) <> f)),
lost as (select doc_id, list(i) l from gone group by doc_id)
select d.doc_id, cast(len(w) as bigint) n_words, cast(coalesce(len(l), 0) as bigint) n_removed,
  sha256(array_to_string(case when l is null then w else list_filter(w, lambda x, i: not list_contains(l, i)) end, ' ')) kept_sha256
from d left join lost using (doc_id)""",
    "op2_url_filters": r"""
with u as (select page_id, case when instr(url, '://') > 0 then regexp_extract(substr(url, instr(url, '://') + 3), '^[^?#]*') else '' end bare from pages),
p as (select page_id, translate(regexp_extract(coalesce(bare, ''), '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host, substr(coalesce(bare, ''), length(regexp_extract(coalesce(bare, ''), '^[^/]*')) + 1) path from u),
r(h, q, a) as (values ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
f as (select page_id, host, path, arg_max(h || q, length(h || q)) "rule", arg_max(a, length(h || q)) a from p left join r on (host = h or ends_with(host, '.' || h)) and starts_with(path, q) group by all)
select page_id, host, path, "rule", coalesce(a, 'allow') verdict from f""",
    "op6_line_dedup": rf"""
with d as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) n from documents),
k as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') key from d),
c as (select key, max(doc_id) last from k where length(key) >= 40 group by key having count(distinct doc_id) >= 5),
j as (select doc_id, n, line, last is not null and last <> doc_id gone from k left join c using (key))
select doc_id, count(*) n_lines, count(*) filter (gone) n_dropped, sha256(coalesce(string_agg(line, chr(10) order by n) filter (not gone), '')) kept_sha256 from j group by doc_id""",
    "op9_decontamination": sql_decontamination(),
    "op7_quality_rules": f"{LEDGER} select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & {quality_rules.mask('base')} <> 0 base_failed, fail_bits & {quality_rules.mask('v2')} = 0 kept, fail_bits, 'v2' policy from b",
    "quality_ablations": f"""{LEDGER}, p(policy, m) as (values {", ".join(f"('{p}', {quality_rules.mask(p)}::bigint)" for p in quality_rules.POLICIES)}),
r("rule", bit) as (values {", ".join(f"('{n}', {1 << i}::bigint)" for i, (n, _) in enumerate(quality_rules.RULES))})
select policy, "rule", count(*) filter (fail_bits & bit <> 0) n_fail, count(*) filter (fail_bits & m = bit) n_only, count(*) filter (fail_bits & m & ~bit = 0) n_kept_without from b cross join p cross join r where m & bit <> 0 group by all""",
}
