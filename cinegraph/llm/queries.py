"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from cinegraph.llm import ann, conversation_repair, fingerprint, license_scan, lm, mixing, ngram_join, packing, quality, secret_scan, vector_codes, warc, wavelet
from cinegraph.llm.common import table, words_of


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return packed.select("doc.doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op4_wavelet_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.size(words_of(F.col("text"))).alias("size"))
    return mixing.mix(docs, F.col("size")).select("_row.doc_id", "size", "source_size", "target", "taken")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digest(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest(vectors, vectors.where("vec_id % 20 = 0"))


def op9_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest(table(spark, sf_dir, "pages"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.judge(docs).select("_row.doc_id", *(f"_q.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), "base_failed", "kept")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.digest(table(spark, sf_dir, "conversations"))


def op12_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.digest(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.digest(table(spark, sf_dir, "embeddings"))


_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

_OP2 = r"""
with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from w)
  union select doc_id, array_to_string(w, ' ') from w where len(w) between 1 and 4),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
l as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 80 * (a.n + b.n - c)),
e as (select x, y from l union all select y, x from l),
walk as (select doc_id as d, doc_id as r from documents union select d, y from walk join e on x = r)
select d as doc_id, coalesce(any_value(n.n), 0)::bigint as n_shingles, min(r) as component_id from walk left join n on n.doc_id = d group by d
"""

_OP5 = rf"""
with d as (select doc_id, source, len({_WORDS})::bigint as size from documents),
src as (select source, sum(size)::bigint as source_size from d group by source),
ranked as (select *, row_number() over (order by source nulls last) - 1 as k from src),
weighed as (select *, [5.0::double, 2.0::double, 1.0::double][(k % 3 + 1)::int] as weight, 3.0::double * source_size as cap from ranked),
level as (select *, cap / weight as r,
  ((sum(source_size) over ())::double - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0::double))
   / sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following) as lv from weighed),
lam as (select arg_min(lv, r) as lv from level where lv <= r),
plan as (select level.source, source_size, coalesce(least(cap, lam.lv * weight), cap) as target from level, lam),
wants as (select *, round(target)::bigint as want from plan),
whole as (select *, case when source_size > 0 then want // source_size else 0 end as times from wants),
run as (select d.doc_id, d.size, w.source_size, w.target, w.times, w.want - w.times * w.source_size as rest,
  coalesce(sum(d.size) over (partition by d.source order by md5(concat_ws(':', d.doc_id::varchar, '17')), d.doc_id, d.size rows between unbounded preceding and 1 preceding), 0) as before
  from d join whole w on d.source is not distinct from w.source)
select doc_id, size, source_size, target, (times * size + greatest(0, least(size, rest - before)))::bigint as taken from run
"""

_STOP = ", ".join(f"'{w}'" for w in sorted(set(quality.STOP_WORDS)))
_OP10 = rf"""
with d as (select doc_id, coalesce(text, '') as text, {_WORDS} as w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from documents),
win as (select doc_id, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4] as g from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from d)),
twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as c from win) where c > 1),
rep as (select doc_id, count(distinct i + k)::bigint as n from twice, range(0, 5) as t(k) group by doc_id),
m as (select d.doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols,
  (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(rep.n, 0)::bigint as n_repeat_words, len(lines) as n_lines,
  length(regexp_replace(text, '[^\p{{Lu}}]+', '', 'g')) as n_capitals, length(regexp_replace(text, '[^A-Za-z]+', '', 'g')) as n_latin,
  len(list_filter(w, lambda x: lower(x) in ({_STOP}))) as n_stop,
  length(regexp_replace(text, '[^{quality.UNSPACED}]+', '', 'g')) as n_unspaced,
  coalesce(list_max(list_transform(w, lambda x: length(regexp_replace(x, '[{quality.UNSPACED}]+', '', 'g')))), 0) as longest
  from d left join rep on d.doc_id = rep.doc_id),
f as (select *, (n_words < 10 or 100 * n_repeat_words > 20 * n_words) as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and word_chars::double / n_words >= 1.5 and (word_chars - n_unspaced)::double / n_words <= 25 and longest <= 20000
  and n_symbols / (n_words + n_unspaced::double / {quality.UNSPACED_WORD}) <= 0.1
  and n_capitals::double / (word_chars + {quality.SMALL_CHARS}) <= 0.5 and ((n_stop + {quality.FREE_STOPS}) * word_chars)::double / greatest(n_words * n_latin, 1) >= 0.005
  and n_dup_lines::double / n_lines <= 0.6 as kept from f
"""

_OP9 = r"""
with p as (select page_id, coalesce(html, '') as html, url, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') as bare from pages),
q as (select *, regexp_extract(bare, '^([^?]*)', 1) as place, regexp_extract(bare, '\?(.*)$', 1) as query from p),
k as (select *, list_sort(list_filter(string_split(query, '&'), lambda x: x <> '' and not regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)'))) as kept from q),
c as (select page_id, html, regexp_replace(regexp_replace(lower(regexp_extract(place, '^([^/]*)', 1)), '^(www|m)\.', ''), ':(80|443)$', '')
  || regexp_replace(regexp_extract(place, '^[^/]*(/.*)$', 1), '/+$', '') || case when len(kept) > 0 then '?' || array_to_string(kept, '&') else '' end as canonical_url from k),
v as (select 2 * page_id + 1 as record_id, page_id, canonical_url, case when page_id % 9 = 0 then 60 * page_id - 1 else 60 * page_id + 1 + 997 * (page_id % 97) end as ts,
  case when page_id % 5 = 0 then md5(page_id::varchar) else md5(html) end as etag from c),
r as (select 2 * page_id as response_id, page_id as r_page, canonical_url, 60 * page_id as r_ts, md5(html) as r_etag from c),
m as (select v.record_id, v.page_id, v.canonical_url, v.etag, r.response_id, r.r_page, r.r_etag from v asof left join r on v.canonical_url = r.canonical_url and v.ts > r.r_ts),
s as (select *, case when response_id is null then 'orphan' when etag = r_etag then 'resolved' else 'changed' end as status from m)
select record_id, canonical_url, response_id, status,
  case when status = 'resolved' then 'content-type=text/html;date=r' || page_id || ';etag=W/' || etag else 'content-type=none;date=r' || page_id || ';etag=W/' || etag end as headers,
  case when status = 'resolved' then r_etag end as payload_md5 from s
"""


def _repair() -> str:
    """One row of a conversation, from its last to its first: for each state (z nothing yet, s, u, a) the least (cost, audit) to the end."""
    after, may = {"z": "u", "s": "u", "u": "a", "a": "u"}, {"z": "su", "s": "u", "u": "a", "a": "u"}
    line = lambda role, text, to: f"{role} || ':' || {text} || coalesce(chr(10) || {to}.r, '')"
    full = {"u": "'user'", "a": "'assistant'"}
    insert = lambda q: f"{{'c': {q}.c + 3, 'a': 'I' || {q}.a, 'r': {line(full[q[-1]], repr(''), q)}}}"
    own = []
    for q in "zsua":
        ways = [f"{{'c': w.{q}.c + 4, 'a': 'D' || w.{q}.a, 'r': w.{q}.r}}"]
        ways += [f"case when fault <= 1 and kind = '{k}' then {{'c': w.{k}.c + 3 * fault, 'a': 'K' || w.{k}.a, 'r': {line('role', 'text', f'w.{k}')}}} end" for k in may[q]]
        n = after[q]
        ways.append(f"case when fault <= 1 then {{'c': w.{n}.c + 3 + 3 * fault, 'a': 'R' || w.{n}.a, 'r': {line(full[n], 'text', f'w.{n}')}}} end")
        own.append(f"list_sort(list_filter([{', '.join(ways)}], lambda x: x is not null))[1] as m{q}")
    least = lambda q, n: f"list_sort([m{q}, {insert(n)}])[1]"
    return f"""select conv_id, i, {least('z', 'u')} as z, {least('s', 'u')} as s, u, a from
    (select conv_id, i, mz, ms, {least('u', 'ma')} as u, {least('a', 'mu')} as a from (select f.conv_id, f.i, {', '.join(own)} from walk w join f on f.conv_id is not distinct from w.conv_id and f.i = w.i - 1))"""


_OP11 = rf"""
with recursive b as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k from conversations),
x as (select *, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(k, ''), lambda c: ord(c)::bigint)),
  lambda h, c: list_reduce([xor(h, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, (v & 1) * 3988292384::bigint))), 4294967295::bigint) % 20 as k20 from b),
d as (select conv_id, turn, case when k20 = 4 then 'user' else role end as role, case k20 when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
  unnest(range(case when k20 = 3 then 2 else 1 end)) as time from x where k20 <> 0),
o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, sha256(text), time) as i from d),
f as (select conv_id, turn, role, text, i, left(role, 1) as kind, lead(left(role, 1)) over (partition by conv_id order by i) as follows,
  case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 3 when row_number() over (partition by conv_id, role, text order by i) > 1 then 2 when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') then 1 else 0 end as fault from o),
g as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 3) as blank, count(*) filter (fault = 2) as duplicate, count(*) filter (fault = 1) as truncated,
  count(*) filter (kind || follows not in ('su', 'ua', 'au')) as illegal, max(i) as n from f group by conv_id),
walk as (select conv_id, n + 1 as i, {{'c': 0, 'a': '', 'r': null::varchar}} as z, {{'c': 6, 'a': 'II', 'r': 'user:' || chr(10) || 'assistant:'}} as s,
  {{'c': 3, 'a': 'I', 'r': 'assistant:'}} as u, {{'c': 0, 'a': '', 'r': null::varchar}} as a from g
  union all {_repair()})
select c.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  coalesce(w.z.c, 0)::bigint as cost, coalesce(w.z.a, '') as audit, sha256(coalesce(w.z.r, '')) as repaired_sha256
from (select distinct conv_id from conversations) c left join g on g.conv_id is not distinct from c.conv_id left join walk w on w.conv_id is not distinct from c.conv_id and w.i = 1
"""

_BOUND = f"(case when len({{s}}) < {fingerprint.LEAST} then '{fingerprint.ALL}' else greatest({{s}}[-1], '{fingerprint.BELOW}') end)"
_LIKE = f"""(select case when len(a) + len(b) = 0 then 1.0::double when {{of}} = 0 then 0.0::double else len(list_intersect(a, b))::double / {{of}} end
  from (select list_filter({{x}}, lambda h: h <= least({_BOUND.format(s="{x}")}, {_BOUND.format(s="{y}")})) as a, list_filter({{y}}, lambda h: h <= least({_BOUND.format(s="{x}")}, {_BOUND.format(s="{y}")})) as b))"""
_UNION, _OWN = "len(list_distinct(list_concat(a, b)))", "len(a)"
_OP12 = rf"""
with d as (select doc_id, coalesce(text, '') as t, row_number() over (order by doc_id desc nulls last) as i, count(*) over () as n from documents),
e as (select d.doc_id, d.i, d.i % d.n + 1 as j, d.t, left(d.t, length(d.t) - length(d.t) // 2) || left(x.t, length(d.t) // 2) as ed from d join d x on x.i = d.i % d.n + 1),
w as (select i, kind, list_filter(regexp_split_to_array(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from (select i, 'own' as kind, t from e union all select i, 'ed', ed from e)),
g as (select i, kind, array_to_string(w[k:k + 4], ' ') as g from (select i, kind, w, unnest(range(1, len(w) - 3)) as k from w) union all select i, kind, array_to_string(w, ' ') from w where len(w) between 1 and 4),
h as (select distinct i, kind, left(md5(g), {fingerprint.HEX}) as h from g),
s as (select i, kind, list(h order by h) as s from (select *, row_number() over (partition by i, kind order by h) as r from h) where h < '{fingerprint.BELOW}' or r <= {fingerprint.LEAST} group by all),
q as (select e.doc_id, length(e.t)::bigint as n_chars, sha256(e.ed) as edited_sha256, coalesce(a.s, []) as x, coalesce(b.s, []) as y, coalesce(c.s, []) as z from e
  left join s a on a.i = e.i and a.kind = 'own' left join s b on b.i = e.i and b.kind = 'ed' left join s c on c.i = e.j and c.kind = 'own')
select doc_id, n_chars, edited_sha256, array_to_string(x, ',') as fingerprint, array_to_string(y, ',') as edited_fingerprint,
  {_LIKE.format(x="x", y="y", of=_UNION)} as near_edited, {_LIKE.format(x="x", y="z", of=_UNION)} as near_next, {_LIKE.format(x="x", y="z", of=_OWN)} as contained_next from q
"""


def _lloyd(rounds: int) -> str:
    """Rounds of assignment and means as one table after another."""
    out = ""
    for n in range(rounds + 1):
        out += f"""
a{n} as (select i, k.p, min(struct_pack(d := list_sum(list_transform(list_zip(k.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint, e := c.e)) as m from k join c{n} c on k.p = c.p group by all),"""
        if n < rounds:
            out += f"""
s{n} as (select p, e, j, sum(v)::bigint as s, count(*) as n from (select k.p, a.m.e as e, unnest(k.x) as v, unnest(range(len(k.x))) as j from k join a{n} a on a.i = k.i and a.p = k.p) group by all),
c{n + 1} as (select c.p, c.e, coalesce(any_value(m.x), any_value(c.x)) as x from c{n} c left join (select p, e, list((s - (s % n + n) % n) // n order by j) as x from s{n} group by all) m on m.p = c.p and m.e = c.e group by all),"""
    return out


_OP13 = f"""
with v as (select row_number() over (order by vec_id) as i, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as x from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
k as (select i, p, x[p * len(x) // 4 + 1:(p + 1) * len(x) // 4] as x from v, range(4) as t(p)),
c0 as (select p, i - 1 as e, x from k where i <= {vector_codes.ENTRIES}),{_lloyd(vector_codes.ROUNDS)}
r as (select i, string_agg(printf('%02x', m.e), '' order by p) as code, sum(m.d)::bigint as error from a{vector_codes.ROUNDS} group by i),
h as (select sha256(string_agg(array_to_string(x, ','), ',' order by p, e)) as h from c{vector_codes.ROUNDS})
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, h.h as codebooks_sha256 from r join v using (i), h
"""

QUERIES = {"op1_secret_scan": op1_secret_scan, "op2_ngram_join": op2_ngram_join, "op3_best_fit_packing": op3_best_fit_packing, "op4_wavelet_output": op4_wavelet_output, "op5_mixing": op5_mixing, "op6_license_scan": op6_license_scan, "op7_lm_scoring": op7_lm_scoring, "op8_nearest_neighbours": op8_nearest_neighbours, "op9_warc_revisits": op9_warc_revisits, "op10_quality_rules": op10_quality_rules, "op11_conversation_repair": op11_conversation_repair, "op12_document_fingerprints": op12_document_fingerprints, "op13_vector_codes": op13_vector_codes, "pipeline": corpus_pipeline.run}
ORACLE_SQL = {"op2_ngram_join": _OP2, "op5_mixing": _OP5, "op9_warc_revisits": _OP9, "op10_quality_rules": _OP10, "op11_conversation_repair": _OP11, "op12_document_fingerprints": _OP12, "op13_vector_codes": _OP13}
