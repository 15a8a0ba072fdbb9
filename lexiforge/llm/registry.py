"""The queries of the training-data operators, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexiforge.llm.bilinear import op11_lm_scoring
from lexiforge.llm.byte_bpe import op7_byte_bpe
from lexiforge.llm.decontaminate import op5_decontamination
from lexiforge.llm.filter_audit import op12_filter_audit
from lexiforge.llm.html_text import op9_html_extraction
from lexiforge.llm.jaccard import op2_ngram_jaccard_join
from lexiforge.llm.licenses import op4_license_scan
from lexiforge.llm.personal_data import op3_personal_data
from lexiforge.llm.quality import op6_quality_rules
from lexiforge.llm.spelling import op13_spelling_variants
from lexiforge.llm.substrings import op10_substring_dedup
from lexiforge.llm.token_files import op8_token_files
from lexiforge.llm.warc import op1_warc_histories

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_warc_histories, op2_ngram_jaccard_join, op3_personal_data, op4_license_scan, op5_decontamination, op6_quality_rules, op7_byte_bpe, op8_token_files, op9_html_extraction, op10_substring_dedup, op11_lm_scoring, op12_filter_audit, op13_spelling_variants)
}
_SPACE = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: The other queries rest on trained models, tokenizer libraries or transitive links; tests hold them against brute-force
#: versions.
SQL: dict[str, str] = {
    "op1_warc_histories": r"""with u as (select page_id, url, coalesce(html, '') as body, regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?(?:[^@/?#]*@)?([^/?#:]*)(?::(\d*))?([^?#]*)(?:\?([^#]*))?', ['host', 'port', 'path', 'query']) as m from pages),
k as (select page_id, body, case when url is null then '' else array_to_string(list_reverse(string_split(regexp_replace(lower(m.host), '^www\d*\.', ''), '.')), ',') || case when m.port in ('', '80', '443') then '' else ':' || m.port end || ')'
  || case when m.path = '' then '/' else lower(m.path) end || case when m.query = '' then '' else '?' || array_to_string(list_sort(string_split(lower(m.query), '&')), '&') end end as url_key,
  strftime(make_timestamp((1704067200 + coalesce(page_id, 0) % 31536000) * 1000000), '%Y%m%d%H%M%S') as captured_at from u),
p as (select *, max(page_id) over (partition by body) as keep, row_number() over (order by url_key, captured_at, page_id nulls first) - 1 as position from k)
select page_id, url_key, captured_at, position, octet_length(encode(body))::bigint as payload_bytes,
  array_to_string(list_transform(range(32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(sha1(body), 5 * (j // 4) + 1, 5))::bigint >> (15 - 5 * (j % 4)))) & 31) + 1, 1)), '') as payload_digest,
  case when keep is not null and (page_id is null or page_id < keep) then 'revisit' else 'response' end as record_type,
  case when keep is not null and (page_id is null or page_id < keep) then keep end as refers_to from p""",
    "op5_decontamination": f"""with d as (select doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) as ws from documents),
b as (select item_id, regexp_extract_all({_LOWER}, {_ALNUM}) as ws, least(10, len(ws)) as k from benchmark),
bw as (select distinct item_id, k, array_to_string(ws[i:i + k - 1], ' ') as g from (select *, unnest(range(1, len(ws) - k + 2)) as i from b where k > 0)),
dw as (select doc_id, k, i, array_to_string(ws[i:i + k - 1], ' ') as g from (select d.*, n.k, unnest(range(1, len(ws) - n.k + 2)) as i from d, (select distinct k from bw) n)),
h as (select doc_id, item_id, i, k from dw join bw using (k, g)), n as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + k)) as p from h) group by doc_id),
t as (select doc_id, count(*) as n_items, string_agg(x, ',' order by x) as ids from (select distinct doc_id, item_id::varchar as x from h) group by doc_id)
select doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join n using (doc_id) left join t using (doc_id)""",
    "op10_substring_dedup": f"""with d as (select doc_id, regexp_extract_all(coalesce(text, ''), {_SPACE}) as ws from documents),
w as (select doc_id, i, array_to_string(ws[i:i + 12], ' ') as g from (select *, unnest(range(1, len(ws) - 11)) as i from d)),
m as (select g, min(doc_id) as least_id from w group by g), gone as (select distinct doc_id, unnest(range(i, i + 13)) as p from w join m using (g) where least_id < doc_id),
a as (select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as p from d),
k as (select doc_id, string_agg(word, ' ' order by p) as kept, count(*) as n from a anti join gone using (doc_id, p) group by doc_id)
select doc_id, len(ws)::bigint as n_words, (len(ws) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join k using (doc_id)""",
    "op12_filter_audit": r"""with x as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
e as (select *, min(doc_id) over (partition by t) as least_id from x),
f as (select doc_id, part, [len(ws) < 50, 100 * len(list_distinct(ws)) < 65 * len(ws), 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(least_id < doc_id, false)] as fails from e),
l as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id),
c as (select part, fails, list_sum(list_transform(fails, lambda b: b::int)) as n_fails, count(*) as n, coalesce(sum(good), 0) as good, coalesce(sum(toxic), 0) as toxic from f left join l using (doc_id) group by part, fails),
k as (select unnest(['A', 'B', 'C', 'D', 'E']) as x), o as (select p.x || q.x || r.x || s.x || u.x as filter_order from k p, k q, k r, k s, k u where len(list_distinct([p.x, q.x, r.x, s.x, u.x])) = 5),
st as (select filter_order, i as step, ascii(filter_order[i]) - 64 as own, list_transform(range(1, i), lambda j: ascii(filter_order[j]) - 64) as earlier from o, (select unnest(range(1, 6)) as i)),
g as (select part, filter_order, step, n, good, toxic, n_fails, fails[own] as here, list_contains(list_transform(earlier, lambda j: fails[j]), true) as gone from c, st)
select part, filter_order, step::int as step, coalesce(sum(n) filter (where not here and not gone), 0)::bigint as kept, coalesce(sum(n) filter (where here and not gone), 0)::bigint as removed,
  coalesce(sum(n) filter (where here and gone), 0)::bigint as redundant, coalesce(sum(n) filter (where here and n_fails = 1), 0)::bigint as unique_fails,
  coalesce(sum(good) filter (where here and not gone), 0)::bigint as good_lost, coalesce(sum(toxic) filter (where here and not gone), 0)::bigint as toxic_lost, coalesce(sum(n * 120 // greatest(n_fails, 1)) filter (where here), 0)::bigint as shapley
from g group by part, filter_order, step""",
    "op13_spelling_variants": r"""with recursive steps as (select i, i as x, 0 as k from (select unnest(range(256)) as i) union all select i, case when x & 1 = 1 then xor(3988292384, x >> 1) else x >> 1 end, k + 1 from steps where k < 8),
crc as (select list(x order by i) as t from steps where k = 8),
r as (select doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run from documents),
g as (select doc_id, run, count(*) as n from r group by doc_id, run),
b as (select *, flatten(list_transform(string_split(coalesce(doc_id::varchar, '') || ':' || run, ''), lambda c: case when unicode(c) < 128 then [unicode(c)] else [195, unicode(c) - 64] end)) as bytes from g),
h as (select run, n, xor(list_reduce(list_prepend(4294967295::bigint, bytes::bigint[]), lambda s, y: xor(s >> 8, t[(xor(s, y) & 255) + 1])), 4294967295) as h from b, crc),
w as (select case when h % 97 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, n from h),
v as (select word, sum(n)::bigint as n from w group by word having length(word) >= 5 and sum(n) >= 3),
k as (select word, n, i, substr(word, 1, i - 1) as a, substr(word, i + 1) as z from (select *, unnest(range(1, length(word) + 1)) as i from v)),
p as (select x.word, y.word as other, y.n from k x join k y using (i, a, z) where x.word <> y.word
  union select x.word, y.word, y.n from k x join v y on x.a || x.z = y.word union select y.word, x.word, x.n from k x join v y on x.a || x.z = y.word),
m as (select word, count(*) as n_near, first(other order by n desc, other) as best, max(n) as best_n from p group by word),
f as (select v.word, v.n, coalesce(n_near, 0) as n_near, case when best_n >= 2 * v.n then best end as form, case when best_n >= 2 * v.n then best_n end as form_n from v left join m using (word)),
c as (select word, word as root, form as onward from f union all select c.word, c.onward, f.form from c join f on f.word = c.onward)
select f.word, n, n_near, form, form_n, root from f join c on c.word = f.word and c.onward is null""",
}
