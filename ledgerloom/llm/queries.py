"""Thin queries of the corpus operators over the test tables, and their SQL."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import decontamination, fill_in_middle, importance, line_dedup, mixing, ngram_join, quality_model, quality_rules, repeats, secret_scan, token_counts, toxicity, url_filters
from ledgerloom.llm.common import batches, table


#: Rows of this remainder are held out of learning.
HELD_OUT = 2


def op1_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades 0 (poor), 1 (sound but toxic), 2 (sound and clean); kept: at least
    grade 1 is likelier than not."""
    batches(spark)
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rated = labels.where(toxicity.remainder(F.col("doc_id")) != HELD_OUT).select("doc_id", (F.col("quality") * (2 - F.col("toxic"))).alias("grade"))
    rows = quality_model.score(docs, quality_model.fit(docs, rated, 3))
    return rows.select("doc_id", F.coalesce(toxicity.remainder(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"), "expected_grade", F.col("tails")[0].alias("p_sound"), F.col("tails")[1].alias("p_clean"), (F.col("tails")[0] >= 0.5).alias("kept"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger under the newest policy. base_failed is the contract's rule."""
    rows = quality_rules.apply_policy(quality_rules.ledger(table(spark, sf_dir, "documents")), quality_rules.POLICIES["v1"])
    base = ~quality_rules.verdict(quality_rules.POLICIES["base"])
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "failed", "policy")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches(spark)
    labels = table(spark, sf_dir, "labels").where(toxicity.remainder(F.col("doc_id")) != HELD_OUT)
    rows = toxicity.toxicity_scores(table(spark, sf_dir, "documents"), labels)
    return rows.select("doc_id", F.coalesce(toxicity.remainder(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"), "score", "predicted")


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches(spark)
    kept = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator's spans and the digest columns of the contract."""
    batches(spark)
    spans = secret_scan.scan_secrets(table(spark, sf_dir, "documents"))
    line = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    return spans.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), exact_chars=1)
    return out.select("doc_id", "n_lines", "n_removed", "n_near", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches(spark)
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"), shingle=4, percent=85)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    batches(spark)
    return token_counts.token_counts(table(spark, sf_dir, "documents"), str(public_tokenizers.path("word_bpe_49k.json")))


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.filter_urls(table(spark, sf_dir, "pages"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches(spark)
    rows = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_features", "weight", "score", "rank")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the rearranged texts and of what is restored from them."""
    batches(spark)
    cut = fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    restored = fill_in_middle.restore(F.col("output"), F.col("form"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"))


def quality_rules_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the newest policy costs, off the ledger's bits."""
    return quality_rules.ablation(quality_rules.ledger(table(spark, sf_dir, "documents")), quality_rules.POLICIES["v1"])


QUERIES = {
    "quality_rules_ablation": quality_rules_ablation,
    "op1_quality_model": op1_quality_model,
    "op2_quality_rules": op2_quality_rules,
    "op3_toxicity": op3_toxicity,
    "op4_repeats": op4_repeats,
    "op5_decontamination": op5_decontamination,
    "op6_mixing": op6_mixing,
    "op7_secret_scan": op7_secret_scan,
    "op8_line_dedup": op8_line_dedup,
    "op9_ngram_join": op9_ngram_join,
    "op10_token_counts": op10_token_counts,
    "op11_url_filters": op11_url_filters,
    "op12_importance": op12_importance,
    "op13_fill_in_middle": op13_fill_in_middle,
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_TERMS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

ORACLES = {
    "op2_quality_rules": rf"""
with d as (
  select row_number() over () as rid, doc_id, coalesce(text, '') as text, {_WORDS} as w,
         string_split(coalesce(text, ''), chr(10)) as lines from documents),
p as (
  select rid, unnest(range(1, len(w) - 6)) as pos, w from d where len(w) >= 8),
g as (select rid, pos, array_to_string(w[pos:pos + 7], ' ') as gram from p),
r as (select rid, pos, count(*) over (partition by rid, gram) as n from g),
c as (select distinct rid, unnest(range(pos, pos + 8)) as word from r where n > 1),
m as (select rid, count(*) as n_repeat_words from c group by rid),
x as (
  select d.doc_id, len(w)::bigint as n_words, length(regexp_replace(text, '[ 	-
]+', '', 'g'))::bigint as word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols,
         (len(list_filter(lines, lambda l: regexp_matches(l, '[^ 	-
]')))
          - len(list_distinct(list_filter(lines, lambda l: regexp_matches(l, '[^ 	-
]')))))::bigint as n_dup_lines,
         coalesce(n_repeat_words, 0)::bigint as n_repeat_words, len(lines)::bigint as n_lines,
         length(regexp_replace(text, '[^!]+', '', 'g'))::bigint as n_bangs,
         length(regexp_replace(text, '[^0-9]+', '', 'g'))::bigint as n_digits
  from d left join m on d.rid = m.rid),
f as (
  select *, (n_words < 20)::bigint + 2 * (100 * n_repeat_words > 30 * n_words)::bigint + 4 * (5 * n_symbols > 2 * n_words)::bigint
         + 8 * (10 * n_bangs > 3 * n_words)::bigint + 16 * (n_lines >= 4 and 100 * n_dup_lines > 30 * n_lines)::bigint
         + 32 * (word_chars < 2 * n_words or word_chars > 20 * n_words)::bigint + 64 * (100 * n_digits > 30 * word_chars)::bigint as failed
  from x)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 as base_failed, failed = 0 as kept, failed, 'v1' as policy from f
""",
    "op5_decontamination": rf"""
with b as (select item_id, {_TERMS} as w from benchmark),
bg as (
  select distinct item_id, least(13, len(w)) as len, array_to_string(w[pos:pos + least(13, len(w)) - 1], ' ') as gram
  from (select item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) as pos from b where len(w) > 0)),
d as (select row_number() over () as rid, doc_id, {_TERMS} as w from documents),
n as (select distinct len from bg),
p as (select rid, w, len, unnest(range(1, len(w) - len + 2)) as pos from d, n where len(w) >= len),
h as (
  select rid, pos, p.len, item_id from (select rid, pos, len, array_to_string(w[pos:pos + len - 1], ' ') as gram from p) p
  join bg on bg.len = p.len and bg.gram = p.gram),
k as (select rid, count(distinct word) as n_hit from (select rid, unnest(range(pos, pos + len)) as word from h) group by rid),
i as (select rid, count(*) as n_items, string_agg(id, ',' order by id) as ids from (select distinct rid, item_id::varchar as id from h) group by rid)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit > 0 and 20 * n_hit >= len(w), false) as contaminated
from d left join k on d.rid = k.rid left join i on d.rid = i.rid
""",
    "op6_mixing": rf"""
with d as (
  select doc_id, source, len({_WORDS})::bigint as size,
         ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint as place
  from documents),
s as (
  select source, sum(size)::bigint as source_size,
         row_number() over (order by source nulls last) as rank
  from d group by source),
w as (
  select *, [3.0, 1.0, 2.0][((rank - 1) % 3 + 1)::int]::double as weight, (source_size * 2.0)::double as cap from s),
l as (
  select *, (sum(source_size) over () * 1.5::double
             - coalesce(sum(cap) over (order by cap / weight, rank rows between unbounded preceding and 1 preceding), 0))
            / (sum(weight) over () - coalesce(sum(weight) over (order by cap / weight, rank rows between unbounded preceding and 1 preceding), 0)) as level
  from w),
f as (
  select *, min(case when level * weight <= cap then row(cap / weight, rank, level) end) over () as fill from l),
t as (
  select source, source_size, case when fill is null then cap else least(cap, fill[3] * weight) end as target from f),
q as (
  select row_number() over () as rid, d.doc_id, d.size, t.source_size, t.target,
         (sum(d.size) over (partition by d.source order by place, d.doc_id, d.size rows between unbounded preceding and current row) - d.size)::bigint as before
  from d join t on d.source is not distinct from t.source),
e as (
  select rid, unnest(range(1, 2 * size + 1)) as k from q),
w2 as (
  select q.rid, case when k <= size then before + k else source_size + before + k - size end / target as fin from q join e using (rid)),
o as (select rid, fin, row_number() over (order by fin, rid) as place from w2),
k as (
  select rid, count(*) as taken, max(fin) as virtual_finish from o
  where place <= (select sum(floor(target)) from t) group by rid)
select doc_id, size, source_size, target, coalesce(taken, 0)::bigint as taken, virtual_finish from q left join k using (rid)
""",
}

ORACLES["op13_fill_in_middle"] = r"""
with d as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as u,
         sha256('1:' || coalesce(doc_id::varchar, '')) as g from documents),
h as (
  select *, len(u)::bigint as n, ('0x' || substr(g, 1, 8))::bigint % (len(u) + 1) as x, ('0x' || substr(g, 9, 8))::bigint % (len(u) + 1) as y,
         case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or ('0x' || substr(g, 17, 8))::bigint % 100 >= 90 then 'plain'
              when ('0x' || substr(g, 25, 8))::bigint % 100 < 20 then 'spm' else 'psm' end as form
  from d),
c as (
  select *, array_to_string(u[1:least(x, y)], '') as prefix, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') as middle,
         array_to_string(u[greatest(x, y) + 1:n], '') as suffix from h)
select doc_id, n, form, case when form <> 'plain' then length(prefix) end::bigint as prefix_chars, case when form <> 'plain' then length(middle) end::bigint as middle_chars,
       sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
       sha256(prefix || middle || suffix) as restored_sha256
from c
"""

def _attribute_sql(name: str) -> str:
    pattern = rf"""(?i)[\s"''/]{name}\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))"""
    return " || ".join(f"regexp_extract(tag, '{pattern}', {k})" for k in (1, 2, 3))


# Groups by reach from blocked addresses over links whose ends no rule allows.
ORACLES["op11_url_filters"] = r"""
with recursive p as (
  select row_number() over () as rid, page_id, coalesce(html, '') as html,
         case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
u as (
  select rid, page_id, html, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) as path, regexp_extract(coalesce(rest, ''), '^[^?#]*(\?[^#]*)', 1) as query from p),
rules(rhost, rpath, verdict) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
tags as (select rid, host as site, path as folder, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)\b[^<>]*>')) as tag from u where host <> ''),
attrs as (select rid, site, folder, tag, [$ATTRIBUTES] as v from tags),
refs as (
  select rid, site, folder, trim(replace(case
    when regexp_matches(tag, '(?i)^<link') and regexp_matches(v[1], '(?i)(^|\s)canonical(\s|$)') then v[3]
    when regexp_matches(tag, '(?i)^<meta') and regexp_matches(v[2], '(?i)^\s*refresh\s*$') then regexp_extract(v[4], '(?is)^[\s\d.]*[;,]\s*(?:url\s*=\s*)?["'']?([^"'']*)', 1) end,
    '&amp;', '&')) as ref from attrs),
aims as (
  select rid, case when regexp_matches(ref, '^[A-Za-z][A-Za-z0-9+.-]*://') then ref when regexp_matches(ref, '^[A-Za-z][A-Za-z0-9+.-]*:') then null
    when starts_with(ref, '//') then 'http:' || ref when starts_with(ref, '/') then 'http://' || site || ref when starts_with(ref, '?') then 'http://' || site || folder || ref
    else 'http://' || site || case when folder = '' then '/' else regexp_replace(folder, '[^/]*$', '') end || ref end as url
  from refs where ref is not null and not regexp_matches(ref, '^(#|$)')),
cut as (select rid, substr(url, instr(url, '://') + 3) as rest from aims where contains(url, '://')),
ends as (
  select rid, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path, regexp_extract(rest, '^[^?#]*(\?[^#]*)', 1) as query from cut),
places as (select distinct host, path, query from (select host, path, query from u union all select host, path, query from ends)),
ruled as (
  select host, path, query, max_by(rhost || rpath, length(rhost || rpath)) filter (starts_with(path, rpath)) as rule,
         max_by(verdict, length(rhost || rpath)) filter (starts_with(path, rpath)) as verdict, max_by(verdict, length(rhost || rpath)) as known
  from places join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(case when path = '' then '/' else path end, rpath) group by all),
named as (
  select p.*, host || case when path = '' then '/' else path end || query as node, rule, verdict, known from places p left join ruled using (host, path, query)),
links as (
  select distinct a.node as a, b.node as b from u join named a using (host, path, query) join ends e using (rid)
  join named b on b.host = e.host and b.path = e.path and b.query = e.query
  where a.host <> '' and b.host <> '' and coalesce(a.known, '') <> 'allow' and coalesce(b.known, '') <> 'allow'),
both_ways as (select a, b from links union select b, a from links),
reach(node) as (
  select distinct a from both_ways join named on node = a where known = 'block'
  union select b from reach join both_ways on a = reach.node)
select page_id, host, path, rule, coalesce(verdict, known, case when host <> '' and node in (select node from reach) then 'block' else 'allow' end) as verdict
from u join named using (host, path, query)
""".replace("$ATTRIBUTES", ", ".join(map(_attribute_sql, ("rel", "http-equiv", "href", "content"))))

# CRC-32 as a table of 256 remainders and a fold over the bytes of each distinct run.
ORACLES["op12_importance"] = rf"""
with recursive k(n, c, i) as (
  select n::bigint, n::bigint, 0 from range(256) t(n)
  union all select n, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, i + 1 from k where i < 8),
tab as (select list(c order by n) as t from k where i = 8),
w as (
  select row_number() over () as rid, true as doc, doc_id, {_TERMS} as w from documents
  union all select row_number() over (), false, null, {_TERMS} from benchmark),
g as (
  select rid, doc, doc_id, len(w) as n_words, w || list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1])
         || list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) as runs from w),
e as (select rid, doc, unnest(runs) as s from g),
x as (select s, list_transform(range(0, octet_length(encode(s))), lambda i: ('0x' || substr(hex(encode(s)), 2 * i + 1, 2))::bigint) as b from (select distinct s from e)),
h as (select s, xor(list_reduce(b, lambda c, v: xor(t[(xor(c, v) & 255) + 1], c >> 8), 4294967295::bigint), 4294967295) % 10000 as bucket from x, tab),
n as (select rid, doc, bucket, count(*) as n from e join h using (s) group by all),
c as (
  select b.bucket, coalesce(sum(n) filter (doc), 0)::double as s, coalesce(sum(n) filter (not doc), 0)::double as t
  from range(10000) b(bucket) left join n using (bucket) group by 1),
gain as (
  select bucket, floor(1000 * ln((t + 1) * (sum(s) over () + 10000) / ((s + 1) * (sum(t) over () + 10000))))::bigint as gain from c),
v as (select rid, sum(n * gain)::bigint as weight from n join gain using (bucket) where doc group by rid),
r as (
  select g.rid, doc_id, n_words, len(runs)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
         coalesce(weight, 0)::bigint + floor(-1000.0::double * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5::double) / 4294967296.0::double)))::bigint as score
  from g left join v on g.rid = v.rid where g.doc),
o as (select *, row_number() over (partition by n_words >= 20 order by score desc, doc_id nulls last) as place, count(*) filter (n_words >= 20) over () as many from r)
select doc_id, n_features, weight, score, case when n_words >= 20 and place <= many * 5 // 100 then place end::bigint as rank from o
"""

_RULES = ", ".join(f"('{r.name}', {1 << i})" for i, r in enumerate(quality_rules.RULES))
ORACLES["quality_rules_ablation"] = f"""
with q as ({ORACLES["op2_quality_rules"]}), r(rule, bit) as (values {_RULES})
select rule, bit, coalesce(sum((failed & bit <> 0)::int), 0)::bigint as n_failed, coalesce(sum((failed = bit)::int), 0)::bigint as n_only,
       coalesce(sum((failed = 0)::int), 0)::bigint as n_kept, coalesce(sum((failed & ~bit = 0)::int), 0)::bigint as n_kept_without
from q, r group by rule, bit
"""
