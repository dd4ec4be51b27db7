"""Check texts (DuckDB SQL) of the operators whose results SQL can express."""

CHECKS: dict[str, str] = {}

_MIX = r"""
with sizes as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+')) as size from {documents}),
per as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as src
  from sizes group by source),
weighted as (select *, case src % 3 when 0 then 5 when 1 then 2 else 1 end as weight from per),
levels as (
  select *, (sum(source_size) over () - coalesce(sum(3 * source_size) over w, 0))
    / (sum(weight) over () - coalesce(sum(weight) over w, 0)) as level
  from weighted
  window w as (order by 3 * source_size / weight, src rows between unbounded preceding and 1 preceding)),
targets as (
  select source, src, source_size, least(3.0::double * source_size, weight * max(level) over ())::double as target from levels),
lines as (
  select doc_id, size, t.src, source_size, target, round(target)::bigint as length,
    (coalesce(sum(size) over (partition by t.src order by
      ('0x' || substr(md5('mix' || coalesce(doc_id::varchar, 'null')), 1, 15))::bigint, doc_id, size
      rows between unbounded preceding and 1 preceding), 0))::bigint as start
  from sizes s join targets t on s.source is not distinct from t.source)
select doc_id, size, source_size, target,
  case when size = 0 then 0 else (length // source_size) * size
    + greatest(0, least(start + size, length % source_size) - start) end::bigint as taken
from lines
"""

CHECKS["op4_source_mix"] = _MIX.replace("{documents}", "documents")

_WINDOWS = r"""
with texts as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w, row_number() over () as r
  from {documents}),
items as (
  select coalesce(item_id::varchar, '') as item, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w
  from benchmark),
phrases as (
  select distinct item, least(len(w), 10) as n, list_aggregate(w[i : i + 9], 'string_agg', ' ') as phrase
  from (select item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) as i from items where len(w) > 0)),
lengths as (select distinct n from phrases),
places as (
  select r, i, n, list_aggregate(w[i : i + n - 1], 'string_agg', ' ') as phrase
  from (select r, w, n, unnest(range(1, len(w) - n + 2)) as i from texts, lengths where len(w) >= n)),
hits as (select r, i, p.n, item from places p join phrases q on p.phrase = q.phrase and p.n = q.n),
words as (select r, count(distinct k) as n_hit from (select r, unnest(range(i, i + n)) as k from hits) group by r),
found as (
  select r, count(*) as n_items, string_agg(item, ',' order by item) as ids from (select distinct r, item from hits) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(ids, '')) as items_sha256, n_hit is not null as contaminated
from texts left join words using (r) left join found using (r)
"""

CHECKS["op5_fm_index"] = _WINDOWS.replace("{documents}", "documents")

_LINKS = r"""
with recursive texts as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') as w from documents),
tokens as (
  select distinct doc_id, list_aggregate(w[i : i + 4], 'string_agg', ' ') as t
  from (select doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) as i from texts where len(w) > 0)),
sizes as (select doc_id, count(*) as n from tokens group by doc_id),
pairs as (
  select x.doc_id as a, y.doc_id as b, count(*) as k from tokens x join tokens y on x.t = y.t and x.doc_id < y.doc_id
  group by all),
links as (
  select a, b from pairs join sizes p on p.doc_id = a join sizes q on q.doc_id = b
  where 100 * k >= 80 * (p.n + q.n - k)),
ends as (select a, b from links union all select b, a from links),
reach as (select doc_id as a, doc_id as b from texts union select r.a, e.b from reach r join ends e on r.b = e.a),
comp as (select a as doc_id, min(b) as component_id from reach group by a)
select doc_id, coalesce(n, 0)::bigint as n_shingles, component_id from comp left join sizes using (doc_id)
"""

CHECKS["op9_jaccard_join"] = _LINKS

_ARCHIVE = r"""
with p as (
  select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as h, strlen(coalesce(html, ''))::bigint as payload_bytes from pages),
g as (select *, max(page_id) over (partition by h) as top from p),
parts as (select page_id, ('0x' || substr(h, 5 * i + 1, 5))::int as v, i from g, unnest(range(0, 8)) r(i)),
digits as (
  select page_id, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> s) & 31) + 1, 1), '' order by i, s desc) as payload_digest
  from parts, (values (15), (10), (5), (0)) t(s) group by page_id)
select g.page_id, payload_bytes, payload_digest, case when top = g.page_id then 'response' else 'revisit' end as record_type,
  case when top <> g.page_id then top end as refers_to
from g join digits using (page_id)
"""

CHECKS["op6_warc_salvage"] = _ARCHIVE

_QUALITY = r"""
with texts as (
  select doc_id, lang, coalesce(text, '') as t, row_number() over () as r,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') as w from documents),
base as (
  select *, len(w) as n_words, coalesce(length(list_aggregate(w, 'string_agg', '')), 0) as word_chars, length(t) as chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')) as n_symbols,
    length(t) - length(regexp_replace(t, '[0-9]+', '', 'g')) as digit,
    length(t) - length(regexp_replace(t, '\p{Lu}+', '', 'g')) as upper_case,
    length(t) - length(regexp_replace(t, '[!-/:-@\[-`{-~]+', '', 'g')) as punctuation,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) as lines from texts),
windows as (
  select r, i, list_aggregate(w[i : i + 7], 'string_agg', ' ') as p from (select r, w, unnest(range(1, len(w) - 6)) as i from base)),
twice as (select r, i from windows qualify count(*) over (partition by r, p) > 1),
covered as (select r, count(distinct k) as n_repeat_words from (select r, unnest(range(i, i + 8)) as k from twice) group by r),
words as (select r, lang, lower(x) as x from (select r, lang, unnest(w) as x from base)),
counts as (select lang, x, count(*) as n from words where lang is not null group by all),
large as (
  select lang, sum(n) as total from counts group by lang
  having sum(n) >= (select sum(n) from counts) * 0.01),
common as (select lang, x from counts join large using (lang) where n >= total * 0.005),
hist as (
  select b.r, b.lang, c.x, count(v.x) as n from base b join common c on c.lang = b.lang
  left join words v on v.r = b.r and v.x = c.x group by all),
bins as (
  select r, lang, x, n::double as n from hist
  union all select r, any_value(b.lang), null, any_value(b.n_words) - sum(h.n) from hist h join base b using (r) group by r),
classes as (
  select r, lang, unnest(['letter', 'space', 'digit', 'upper', 'punctuation']) as x,
    unnest([word_chars - digit - upper_case - punctuation, chars - word_chars, digit, upper_case, punctuation])::double as n
  from base where r in (select r from hist)),
kinds as (select 'w' as kind, * from bins union all select 'c', * from classes),
ref as (select kind, lang, x, sum(n) as n from kinds group by all),
shares as (
  select b.kind, r, b.n / sum(b.n) over (partition by b.kind, r) as p, q.n / sum(q.n) over (partition by b.kind, r) as q
  from kinds b join ref q on q.kind = b.kind and q.lang = b.lang and q.x is not distinct from b.x
  where r in (select r from base where n_words >= 50 and chars >= 200)),
far as (
  select kind, r, sqrt(greatest(0, sum(case when p > 0 then p * log2(p / ((p + q) / 2)) else 0 end
    + case when q > 0 then q * log2(q / ((p + q) / 2)) else 0 end) / 2)) as d from shares group by kind, r),
judged as (
  select base.*, coalesce(n_repeat_words, 0) as rep, fc.d as class_distance, fw.d as word_distance,
    n_words < 20 or 100 * coalesce(n_repeat_words, 0) > 30 * n_words as base_failed
  from base left join covered using (r)
  left join (select r, d from far where kind = 'c') fc using (r) left join (select r, d from far where kind = 'w') fw using (r))
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols,
  (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, rep::bigint as n_repeat_words, base_failed,
  not base_failed and not coalesce(class_distance > 0.24 or word_distance > 0.315, false) as kept,
  lang, round(class_distance, 6) as class_distance, round(word_distance, 6) as word_distance
from judged
"""

CHECKS["op2_distribution_divergence"] = _QUALITY

CHECKS["op11_hard_negatives"] = """
with good as (
  select row_number() over () as r, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
  from embeddings
  where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pairs as (
  select a.r as a, a.vec_id as anchor_id, c.vec_id, a.label = c.label as same,
    list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2]))::bigint as score
  from good a join good c on a.r <> c.r where a.vec_id % 100 = 0),
positives as (
  select a, anchor_id, vec_id as positive_id, score as positive_score from pairs where same
  qualify row_number() over (partition by a order by score desc, vec_id) <= 5),
windows as (
  select p.a, p.positive_id, p.anchor_id, p.positive_score, n.vec_id as negative_id, n.score as negative_score,
    row_number() over (partition by p.a, p.positive_id order by n.score desc, n.vec_id) as rank
  from positives p join pairs n on n.a = p.a and not n.same
    and 80 * p.positive_score <= 100 * n.score and n.score <= p.positive_score)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from windows where rank <= 5
"""

CHECKS["op13_collocation_trie"] = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\f\r]')) as piece
  from documents),
words as (select lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') as w from pieces),
totals as (select lang, sum(len(w)) as n from words group by lang),
grams as (
  select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: list_aggregate(w[i : i + k - 1], 'string_agg', ' '))) as phrase
  from words, (values (1), (2), (3)) as sizes(k) where len(w) >= k),
f as (select lang, k, phrase, count(*) as f from grams group by all having count(*) >= 10),
cuts as (
  select lang, phrase, f as a, k as size, unnest(range(1, k)) as k, string_split(phrase, ' ') as w from f where k >= 2),
scored as (
  select c.lang, c.phrase, c.a, c.size, l.f as l, r.f as r,
    (c.a::hugeint * c.a::hugeint * 1000000 // (l.f::hugeint * r.f::hugeint))::bigint as score
  from cuts c
  join f l on l.lang = c.lang and l.phrase = list_aggregate(c.w[1 : c.k], 'string_agg', ' ')
  join f r on r.lang = c.lang and r.phrase = list_aggregate(c.w[c.k + 1 : c.size], 'string_agg', ' ')
  qualify row_number() over (partition by c.lang, c.phrase order by score, c.k) = 1),
longer as (
  select lang, phrase, max(f) as longest from (
    select lang, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) as phrase, f
    from (select lang, f, string_split(phrase, ' ') as w from f where k = 3)) group by all),
ranked as (
  select s.lang, row_number() over (partition by s.lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, score
  from scored s left join longer using (lang, phrase) where longest is null or 100 * longest < 50 * a)
select lang, rank, phrase, a, l, r, n::bigint as n, score from ranked join totals using (lang) where rank <= 2000
"""
