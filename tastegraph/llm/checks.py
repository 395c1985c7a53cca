"""SQL that the text queries must agree with, where SQL can say it on whole tables.

The others hash, learn, align or tokenize in ways SQL has no words for; tests
hold them against plain versions.
"""

CHECKS: dict[str, str] = {
    "op1_suffix_dedup": """
with docs as materialized (
  select doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, ''))) as n
  from documents),
strings as materialized (
  select doc_id, i, md5(substr(h, 2 * i + 1, 800)) as k
  from (select doc_id, h, unnest(range(n - 399)) as i from docs where n >= 400) z),
twice as (select k from strings group by k having count(*) > 1),
starts as materialized (select doc_id, i from strings where k in (select k from twice)),
runs as (
  select doc_id, i, sum(fresh) over (partition by doc_id order by i) as run
  from (select doc_id, i,
               case when i > lag(i) over (partition by doc_id order by i) + 400 then 1 else 0 end as fresh
        from starts) z),
spans as (select doc_id, run, min(i) as a, max(i) + 400 as b from runs group by doc_id, run),
gone as (
  select doc_id, cast(sum(b - a) as bigint) as n_removed, count(*) as n_spans,
         list(a order by a) as a, list(b order by a) as b
  from spans group by doc_id)
select d.doc_id, cast(d.n as bigint) as n_bytes, coalesce(g.n_removed, 0) as n_removed,
       coalesce(g.n_spans, 0) as n_spans,
       sha256(unhex(case when g.a is null then d.h else concat(
         substr(d.h, 1, 2 * g.a[1]),
         array_to_string(list_transform(range(1, len(g.a) + 1), lambda r:
           substr(d.h, 2 * g.b[r] + 1,
                  2 * (case when r < len(g.a) then g.a[r + 1] else d.n end - g.b[r]))), '')) end)) as kept_sha256
from docs d left join gone g on g.doc_id = d.doc_id""",
    "op5_embedding_dedup": """
with recursive usable as materialized (
  select vec_id, label, embedding::double[] as v,
         sqrt(list_dot_product(embedding::double[], embedding::double[])) as size
  from embeddings
  where label is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as materialized (
  select a.vec_id as x, b.vec_id as y
  from usable a join usable b
    on b.label = a.label and b.vec_id <> a.vec_id and len(b.v) = len(a.v)
  where list_dot_product(a.v, b.v) / (a.size * b.size) >= 0.93),
reach as (
  select vec_id as x, vec_id as y from embeddings
  union
  select r.x, l.y from reach r join links l on l.x = r.y)
select e.vec_id, coalesce(n.n, 0) as n_links, c.least as component_id, e.vec_id = c.least as kept
from embeddings e
join (select x, min(y) as least from reach group by x) c on c.x = e.vec_id
left join (select x, count(distinct y) as n from links group by x) n on n.x = e.vec_id""",
    "op7_substring_dedup": """
with docs as materialized (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as words from documents),
windows as materialized (
  select doc_id, i, md5(array_to_string(words[i:i + 19], ' ')) as k
  from (select doc_id, words, unnest(range(1, len(words) - 18)) as i from docs where len(words) >= 20) z),
firsts as (select k, min({'d': doc_id, 'i': i}) as f from windows group by k),
again as (
  select w.doc_id, w.i from windows w join firsts f on f.k = w.k
  where w.doc_id <> f.f.d or w.i <> f.f.i),
gone as (
  select doc_id, list(distinct place) as places
  from (select doc_id, unnest(range(i, i + 20)) as place from again) z group by doc_id)
select d.doc_id, cast(len(d.words) as bigint) as n_words,
       cast(coalesce(len(g.places), 0) as bigint) as n_removed,
       sha256(array_to_string(case when g.places is null then d.words else
         list_filter(d.words, lambda w, i: not list_contains(g.places, i)) end, ' ')) as kept_sha256
from docs d left join gone g on g.doc_id = d.doc_id""",
    "op12_fill_middle": """
with docs as materialized (
  select doc_id, coalesce(text, '') as text, sha256('1:' || doc_id) as h,
         regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as t
  from documents),
drawn as (
  select doc_id, text, t, len(t) as n,
         ('0x' || substr(h, 1, 8))::bigint % (len(t) + 1) as u,
         ('0x' || substr(h, 9, 8))::bigint % (len(t) + 1) as v,
         case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>')
                or ('0x' || substr(h, 17, 8))::bigint % 100 >= 90 then 'plain'
              when ('0x' || substr(h, 25, 8))::bigint % 100 < 20 then 'spm' else 'psm' end as form
  from docs),
parted as (
  select doc_id, text, n, form,
         array_to_string(t[1:least(u, v)], '') as p,
         array_to_string(t[least(u, v) + 1:greatest(u, v)], '') as m,
         array_to_string(t[greatest(u, v) + 1:n], '') as s
  from drawn)
select doc_id, cast(n as bigint) as n, form,
       case when form <> 'plain' then cast(length(p) as bigint) end as prefix_chars,
       case when form <> 'plain' then cast(length(m) as bigint) end as middle_chars,
       sha256(case form when 'plain' then text
                        when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m
                        else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
       sha256(text) as restored_sha256
from parted""",
    "op13_vector_codes": """
with recursive kept as materialized (
  select vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::double)) as q
  from embeddings
  where embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
cut as materialized (
  select vec_id, label, p, q[p * len(q) // 4 + 1:(p + 1) * len(q) // 4] as x
  from kept, (select unnest(range(4)) as p)),
first as (
  select p, cast(row_number() over (partition by p order by vec_id) - 1 as bigint) as entry, x as e
  from cut where vec_id in (select vec_id from kept order by vec_id limit 256)),
books as (
  select 0 as round, p, entry, e from first
  union all
  (with placed as (
     select p, x, unnest(entry) as entry, dim from (
       select c.p, c.x, len(c.x) as dim,
              [arg_min(b.entry, {'d': list_inner_product(c.x, c.x) - 2 * list_inner_product(c.x, b.e)
                                      + list_inner_product(b.e, b.e), 'i': b.entry})] as entry
       from cut c join books b on b.p = c.p where b.round < 4
       group by c.vec_id, c.p, c.x)),
   sums as (
     select p, entry, i, floor(cast(sum(x[i]) as double) / count(*)) as mean
     from (select p, entry, x, unnest(range(1, dim + 1)) as i from placed) group by p, entry, i),
   means as (select p, entry, list(mean order by i) as e from sums group by p, entry)
   select b.round + 1, b.p, b.entry, coalesce(m.e, b.e)
   from books b left join means m on m.p = b.p and m.entry = b.entry where b.round < 4)),
final as materialized (select p, entry, e from books where round = 4),
coded as materialized (
  select c.vec_id, c.label, c.p, min({'d': list_inner_product(c.x, c.x) - 2 * list_inner_product(c.x, b.e)
                                  + list_inner_product(b.e, b.e), 'i': b.entry}) as near
  from cut c join final b on b.p = c.p group by c.vec_id, c.label, c.p),
rows as (
  select vec_id, label, array_to_string(list(printf('%02x', near.i) order by p), '') as code,
         cast(sum(near.d) as bigint) as error
  from coded group by vec_id, label)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error,
       (select sha256(string_agg(cast(cast(v as bigint) as varchar), ',' order by p, entry, i))
        from (select p, entry, unnest(e) as v, unnest(range(len(e))) as i from final)) as codebooks_sha256
from rows""",
}
