"""SQL of the same rows, where SQL can express the operator."""

ORACLE: dict[str, str] = {}

ORACLE["op9_web_archives"] = """
with p as (
    select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as digest,
           octet_length(encode(coalesce(html, ''))) as size
    from pages
), f as (
    select digest, size, max(page_id) as first from p where size >= 1000 group by all having count(*) > 1
)
select page_id, cast(p.size as bigint) as payload_bytes, p.digest as payload_digest,
       case when page_id < first then 'revisit' else 'response' end as record_type,
       case when page_id < first then first end as refers_to
from p left join f on p.digest = f.digest and p.size = f.size
"""

ORACLE["op10_top_inner_products"] = """
with v as (
    select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
    from embeddings
    where vec_id is not null and embedding is not null
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
    select q.vec_id as query_id, c.vec_id as vec_id,
           cast(list_inner_product(q.v, c.v) as bigint) as score
    from v as q join v as c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id
), r as (
    select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s
)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 5
"""

ORACLE["op8_quality_rules"] = r"""
with d as (
    select doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w,
           list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l
    from (select doc_id, coalesce(text, '') as text from documents)
), g as (
    select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g
    from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from d)
), r as (
    select doc_id, i from g qualify count(*) over (partition by doc_id, g) > 1
), c as (
    select doc_id, count(distinct place) as n
    from (select doc_id, unnest([i, i + 1, i + 2]) as place from r) group by doc_id
), m as (
    select d.doc_id, len(w) as n_words,
           length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) as word_chars,
           length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) as n_symbols,
           len(l) - len(list_distinct(l)) as n_dup_lines, len(l) as n_lines,
           coalesce(c.n, 0) as n_repeat_words,
           length(regexp_replace(text, '\P{Lu}+', '', 'g')) as n_capitals
    from d left join c on d.doc_id = c.doc_id
), b as (
    select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m
)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars,
       cast(n_symbols as bigint) as n_symbols, cast(n_dup_lines as bigint) as n_dup_lines,
       cast(n_repeat_words as bigint) as n_repeat_words, base_failed,
       not (base_failed or 10 * n_symbols > n_words or 2 * n_dup_lines > n_lines
            or 10 * n_capitals > 3 * word_chars or word_chars < 3 * n_words
            or word_chars > 12 * n_words) as kept
from b
"""

ORACLE["op1_line_dedup"] = r"""
with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents),
s as (select doc_id, unnest(range(len(l))) as n, unnest(l) as line from d),
p as (
    select doc_id, n, line, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') as t from s
), f as (
    select t, min(struct_pack(doc_id := doc_id, n := n)) as first, length(t) as size from p where t <> '' group by t
), h as (
    select *, size // 2 as half from f where size >= 20
    union all select *, (size - 1) // 2 as half from f where size >= 20 and size % 2 = 0
), c as (
    select a.t as a, b.t as b, a.first as first, a.size as m, b.size as k
    from h as a join h as b on a.half = b.half and left(a.t, a.half) = left(b.t, b.half)
    where b.first < a.first and abs(a.size - b.size) <= 1
    union select a.t, b.t, a.first, a.size, b.size
    from h as a join h as b on a.half = b.half and right(a.t, a.half) = right(b.t, b.half)
    where b.first < a.first and abs(a.size - b.size) <= 1
), x as (
    select distinct a from c where case
        when m = k then len(list_filter(range(1, m + 1), lambda i: substr(a, i, 1) <> substr(b, i, 1))) <= 1
        when m > k then len(list_filter(range(m), lambda i: left(a, i) || substr(a, i + 2) = b)) > 0
        else len(list_filter(range(k), lambda i: left(b, i) || substr(b, i + 2) = a)) > 0 end
), r as (
    select p.doc_id, p.n, p.line,
           p.t = '' or (struct_pack(doc_id := p.doc_id, n := p.n) = f.first and x.a is null) as kept
    from p left join f on p.t = f.t left join x on p.t = x.a
)
select doc_id, count(*) as n_lines, cast(sum(cast(kept as bigint)) as bigint) as n_kept,
       coalesce(string_agg(line, chr(10) order by n) filter (where kept), '') as text
from r group by doc_id
"""

ORACLE["op7_ngram_jaccard_join"] = r"""
with recursive w as (
    select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') as w from documents
), s as (
    select distinct doc_id, array_to_string(list_slice(w, i, i + 4), ' ') as g
    from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from w where len(w) > 0)
), z as (select doc_id, count(*) as size from s group by doc_id),
b as (select a.doc_id as a, b.doc_id as b, count(*) as n
      from s as a join s as b on a.g = b.g and a.doc_id <> b.doc_id group by all),
e as (
    select a, b from b join z as x on x.doc_id = a join z as y on y.doc_id = b
    where n >= 0.8 * (x.size + y.size - n) - 1e-9
), c(doc_id, reached) as (
    select doc_id, doc_id from w
    union select c.doc_id, e.b from c join e on c.reached = e.a
)
select c.doc_id, min(reached) as class_id,
       (select count(*) from e where e.a = c.doc_id) as n_links
from c group by c.doc_id
"""

ORACLE["op12_minhash_dedup"] = r"""
with recursive w as (
    select doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
    from documents
), s as (
    select distinct doc_id, array_to_string(list_slice(w, i, i + 1), ' ') as g
    from (select doc_id, w, unnest(range(1, greatest(len(w) - 1, 1) + 1)) as i from w where len(w) > 0)
), z as (select doc_id, count(*) as size from s group by doc_id),
b as (select a.doc_id as a, b.doc_id as b, count(*) as n
      from s as a join s as b on a.g = b.g and a.doc_id <> b.doc_id group by all),
e as (
    select a, b from b join z as x on x.doc_id = a join z as y on y.doc_id = b
    where 100 * n >= 80 * (x.size + y.size - n)
), c(doc_id, reached) as (
    select doc_id, doc_id from w
    union select c.doc_id, e.b from c join e on c.reached = e.a
)
select c.doc_id, coalesce(any_value(z.size), 0) as n_shingles, min(reached) as component_id,
       c.doc_id = min(reached) as kept
from c left join z on z.doc_id = c.doc_id
group by c.doc_id
"""
