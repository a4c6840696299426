"""SQL that yields the same rows as each registered query on the same tables."""

from __future__ import annotations

from corpora.functions import text as T
from corpora.functions.scores import BAND, EXAM, EXAM_CODES, Scale
from corpora.functions.stop_words import ENGLISH
from corpora.sources.tables import MISSING
from workload.inputs import CODES, INPUT_SQL


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def with_inputs(names: str, body: str) -> str:
    """``body`` after the named inputs and its own common table expressions."""
    ctes = ",\n".join(f"{n} as ({INPUT_SQL[n]})" for n in names.split())
    body = body.strip()
    if body.startswith("with "):
        return f"with {ctes},\n{body[5:]}" if ctes else body
    return f"with {ctes}\n{body}"


def collapsed(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{T.SPACE}]+', ' ', 'g'))"


def stripped(x: str) -> str:
    return rf"regexp_replace({x}, '^[{T.SPACE}]+|[{T.SPACE}]+\z', '', 'g')"


def essay(x: str) -> str:
    outside = "[^A-Za-z0-9" + T.KEPT_PUNCTUATION.replace("'", "''") + "]+"
    return f"trim(regexp_replace({x}, '{outside}', ' ', 'g'))"


def number(x: str) -> str:
    pattern = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
    return f"case when regexp_matches({stripped(x)}, '{pattern}') then try_cast({stripped(x)} as double) end"


def word_list(x: str) -> str:
    return f"regexp_extract_all(lower({x}), {quoted(T.WORD)})"


def token_list(x: str) -> str:
    return f"regexp_extract_all({x}, '{T.TOKEN}')"


def word_total(x: str) -> str:
    return f"case when {x} = '' then 0 else length({x}) - length(replace({x}, ' ', '')) + 1 end"


def share(fraction: float, total: str) -> str:
    return f"cast(ceil(cast({fraction} as double) * ({total})) as bigint)"


def place(key: str, seed: object = 42) -> str:
    return f"md5('{seed}:' || {key})"


def nearest(x: str, scale: Scale) -> str:
    """Index of the first of the smallest distances to the valid scores."""
    values = ", ".join(f"cast({v} as double)" for v in scale.values)
    distances = f"list_transform([{values}], lambda v: abs(v - ({x})))"
    return f"(list_position({distances}, list_min({distances})) - 1)"


def valid(x: str, scale: Scale) -> str:
    values = ", ".join(f"cast({v} as double)" for v in scale.values)
    return f"([{values}])[{nearest(x, scale)} + 1]"


ORACLE: dict[str, str] = {}

# --- sources ---------------------------------------------------------------

ORACLE["q01_union_tables"] = """
select * from documents
union all by name select * from conversations
union all by name select * from benchmark"""

ORACLE["q02_text_columns"] = f"""
select file, text from (
    select 'documents.parquet' as file, {stripped('text')} as text from documents
    union all select 'conversations.parquet', {stripped('text')} from conversations
    union all select 'benchmark.parquet', {stripped('text')} from benchmark)
where length(text) >= 40"""

ORACLE["q03_labelled_texts"] = with_inputs("rated", f"""
select Essay as text, label from (select Essay, {number('Overall')} as label from rated)
where Essay is not null and label is not null""")

_missing = ", ".join(quoted(m) for m in MISSING)
ORACLE["q03_labelled_csv"] = with_inputs("rated", f"""
select Essay as text, label from (select Essay, {number('Overall')} as label from rated)
where Essay not in ({_missing}) and label is not null""")
ORACLE["q04_corpus_files"] = rf"""
with lines as (
    select 'documents' as corpus,
           unnest(string_split_regex(text, '\r\n|\r|\n')) as text
    from documents
    union all select 'benchmark', text from benchmark where text not in ({_missing})
    union all select 'conversations', text from conversations),
clean as (select corpus, {stripped('text')} as text from lines)
select corpus, text, count(*) as n from clean where text <> '' group by all"""

ORACLE["q05_manifest_corpora"] = rf"""
with texts as (
    select case when lang in ('en', 'fr') then 'both' else lang end as corpus, 'lang=' || lang as place, text from documents
    union all select 'benchmark', 'benchmark', text from benchmark where text not in ({_missing})),
clean as (select corpus, place, {stripped('text')} as text from texts)
select corpus, place, text, count(*) as n from clean where text <> '' group by all"""

ORACLE["q05_manifest"] = """
with usable as (
    select page_id, regexp_extract(url, '://([^/]+)', 1) as name, url as path from pages)
select name, min(page_id) over (partition by name) as first_row, page_id, path
from usable where name <> '' and path <> ''"""

_codes = ", ".join(quoted(c) for c in CODES)
_code_table = "(values " + ", ".join(f"({quoted(c)}, cast({v} as double))" for c, v in EXAM_CODES) + ")"
ORACLE["q06_annotated_answers"] = f"""
with codes(answer_s, mapped_score) as (select * from {_code_table} t),
scripts as (
    select 's' || doc_id as script_id, {essay('text')} as text,
           [{_codes}][n_chars % 18 + 1] as first_code, [{_codes}][doc_id % 18 + 1] as second_code
    from documents where doc_id % 50 <> 7),
found as (
    select script_id, 'answer1' as answer_id, text, first_code as answer_s from scripts
    union all select script_id, 'answer2', text, second_code from scripts)
select script_id, script_id || '.xml' as file_name, answer_id, text, answer_s, mapped_score
from found join codes using (answer_s)"""

ORACLE["q06_parse_errors"] = """
select '/exam/s' || doc_id || '.xml' as path from documents where doc_id % 50 = 7"""


def three_way(units: str, key: str, seed: int = 42) -> str:
    """Ranked units and their split, as the CTE ``placed``."""
    return f"""
ranked as (
    select {key}, row_number() over (order by {place(key, seed)}) as r, count(*) over () as total
    from {units}),
placed as (
    select {key}, case when r <= {share(0.15, 'total')} then 'test'
                       when r <= {share(0.15, 'total')}
                                 + {share(0.1765, 'total - ' + share(0.15, 'total'))} then 'dev'
                       else 'train' end as split
    from ranked)"""


ORACLE["q07_write_and_read_back"] = f"""
with {three_way('documents', 'doc_id')}
select split, count(*) as n_rows, cast(5 as integer) as n_columns from placed group by split"""

# --- filters and cleaning ----------------------------------------------------

ORACLE["q08_required_values"] = with_inputs("rated", """
select doc_id, Overall from rated where Essay is not null and Overall is not null""")

_cleaned = f"""
present as (
    select *, row_number() over (partition by Essay order by doc_id) as copy
    from rated where Essay is not null and Overall is not null),
scored as (select doc_id, Essay, {number('Overall')} as Overall, Task_Type from present where copy = 1),
cleaned as (
    select doc_id, {essay('Essay')} as Essay, Overall, Task_Type from scored
    where Overall between 1 and 9 and length(Essay) >= 100 and Task_Type = 2)"""
ORACLE["q09_cleaned_essays"] = with_inputs("rated", f"with {_cleaned} select * from cleaned")

_banded = """
banded as (
    select doc_id, text, upper(trim(cefr)) as cefr, band
    from learner join (values ('A1', 'A1_A2'), ('A2', 'A1_A2'), ('B1', 'B1_B2'), ('B2', 'B1_B2'),
                              ('C1', 'C1'), ('B2', 'B2_C1'), ('C1', 'B2_C1')) b(level, band)
         on upper(trim(cefr)) = level)"""
ORACLE["q10_band_rows"] = with_inputs("learner", f"with {_banded} select doc_id, cefr, band from banded")
ORACLE["q10_band_summary"] = with_inputs("learner", f"""
with {_banded}
select band as split, count(*) as n_rows, cast(sum(len({token_list('text')})) as bigint) as total_tokens,
       '{T.TOKENIZER}' as tokenizer
from banded group by band""")
ORACLE["q10_written_bands"] = with_inputs("learner", f"""
with {_banded}
select band, count(*) as n_rows, cast(sum(len({token_list('text')})) as bigint) as total_tokens,
       '{T.TOKENIZER}' as tokenizer, count(*) as n_read, cast(sum(doc_id) as bigint) as sum_read
from banded group by band""")

_nul = "replace({}, chr(0), ' ')"
ORACLE["q11_selected_documents"] = f"""
with clean as (
    select doc_id as row_no, lang, {collapsed(_nul.format('text'))} as text
    from documents where lang in ('en', 'fr')),
counted as (select *, cast({word_total('text')} as integer) as word_count from clean)
select 'doc_' || lpad(cast(row_number() over (order by row_no) - 1 as varchar), 6, '0') as doc_id,
       row_no, lang, word_count, text
from counted where word_count between 50 and 400"""

_parts = f"""
texts as (select doc_id, {stripped('text')} as text from documents),
keys as (
    select min(doc_id) as doc_id, cast(len({token_list('text')}) as bigint) as length
    from texts where text <> '' group by text),
ranked as (
    select doc_id, length, {place('doc_id')} as h, row_number() over (order by {place('doc_id')}) as r,
           count(*) over () as total
    from keys),
sized as (select *, {share(0.05, 'total')} as held from ranked),
parts as (
    select doc_id, length, h, case when r <= held then 'eval' else 'train' end as part,
           r <= held + greatest(1, floor(cast(0.5 as double) * (total - held))) as in_subset,
           length <= 512 as short
    from sized),
spent as (
    select doc_id, sum(length) over (order by h rows unbounded preceding) as upto
    from parts where part = 'train' and in_subset and short),
decided as (
    select parts.*, in_subset and short and (part = 'eval' or coalesce(upto <= 20000, false)) as kept
    from parts left join spent using (doc_id))"""


def _stage(number_: int, name: str, condition: str) -> str:
    return f"""
select part, {number_} as stage_no, '{name}' as stage, count(*) filter ({condition}) as n_rows,
       cast(coalesce(sum(length) filter ({condition}), 0) as bigint) as n_tokens,
       '{T.TOKENIZER}' as tokenizer
from decided group by part"""


ORACLE["q12_token_budget"] = f"with {_parts}" + " union all ".join([
    _stage(0, "split", "true"),
    _stage(1, "subset", "in_subset"),
    _stage(2, "length", "in_subset and short"),
    _stage(3, "budget", "kept"),
])
ORACLE["q12_budgeted_corpus"] = f"""
with {_parts}
select doc_id, {stripped('documents.text')} as text, part, length
from decided join documents using (doc_id) where kept"""

_mapped = f"""
codes(answer_s, mapped_score) as (select * from {_code_table} t),
mapped as (select * from answers join codes using (answer_s))"""
ORACLE["q13_mapped_scores"] = with_inputs("answers", f"""
with {_mapped} select doc_id, script_id, answer_id, answer_s, mapped_score from mapped""")

# --- joins -------------------------------------------------------------------

_sentences = "greatest(1, len(regexp_extract_all(text, '[.!?]+')))"
ORACLE["q14_features_with_metadata"] = f"""
select id as doc_id, file as temp_filename, '/out/' || file as Filename,
       cast(len({word_list('text')}) as integer) as n_words,
       cast({_sentences} as integer) as n_sentences, lang, source, doc_id as row_no
from (select *, case when doc_id % 2 = 0 then 'essay ' else 'essay_' end || doc_id // 2 as id,
             'essay_' || doc_id // 2 || case when doc_id % 2 = 0 then '-' || substr(md5(id), 1, 16) else '' end
                 || '.txt' as file
      from documents)"""

ORACLE["q15_linked_by_position"] = f"""
with left_side as (
    select doc_id as feature_no, cast(len({word_list('text')}) as integer) as n_words,
           row_number() over (order by doc_id) as spot from documents),
right_side as (select doc_id, row_number() over (order by doc_id desc) as spot from documents)
select feature_no, n_words, doc_id from left_side join right_side using (spot)"""

ORACLE["q15_safe_keys"] = """
with plain as (
    select page_id, trim(regexp_replace(url, '[^A-Za-z0-9_.-]+', '_', 'g'), '_') as name from pages)
select page_id, substr(case when name = '' then cast(page_id as varchar) else name end, 1, 120) as safe_key
from plain"""

# --- splits and samples --------------------------------------------------------

_scripts = f"""
{_mapped},
prepared as (
    select * from (select *, row_number() over (partition by text order by doc_id) as copy from mapped)
    where copy = 1),
units as (select distinct script_id from prepared),
{three_way('units', 'script_id')},
result as (select * from prepared join placed using (script_id))"""
ORACLE["q16_split_by_script"] = with_inputs("answers", f"""
with {_scripts} select doc_id, script_id, mapped_score, split from result""")
ORACLE["q16_split_sizes"] = with_inputs("answers", f"""
with {_scripts}
select split, count(*) as n_rows, cast(6 as integer) as n_columns from result group by split""")
ORACLE["q18_leakage"] = with_inputs("answers", f"""
with {_scripts},
pairs(split_a, split_b) as (values ('train', 'dev'), ('train', 'test'), ('dev', 'test'))
select split_a, split_b,
       (select count(*) from (select script_id from result where split = split_a
                              intersect select script_id from result where split = split_b)) as shared
from pairs""")


def few_shot(n: int, rows: str) -> str:
    """Sampled rows ``(doc_id, label, mode)`` of one size."""
    return f"""
select doc_id, label, mode from (
    with sizes as (select label, count(*) as size from {rows} group by label),
    facts as (select sum(size) as total, count(*) as classes, min(size) as least from sizes),
    exact as (
        select label, size, size * cast({n} as double) / total as quota,
               least >= 2 and classes <= {n} and total - {n} >= classes as possible, total
        from sizes, facts),
    quotas as (
        select label, possible, total,
               floor(quota) + case when row_number() over (order by quota - floor(quota) desc, label)
                                        <= {n} - sum(floor(quota)) over () then 1 else 0 end as quota
        from exact),
    ordered as (
        select doc_id, label, row_number() over (order by {place('doc_id')}) as r,
               row_number() over (partition by label order by {place('doc_id')}) as in_class
        from {rows})
    select doc_id, label,
           case when total <= {n} then 'all' when possible then 'stratified' else 'random' end as mode
    from ordered join quotas using (label)
    where case when total <= {n} then true when possible then in_class <= quota else r <= {n} end)"""


ORACLE["q17_few_shot"] = with_inputs("labelled", " union all ".join(
    f"select *, {n} as shots from ({few_shot(n, 'labelled')})" for n in (50, 100, 200)))
ORACLE["q17_label_histogram"] = with_inputs("labelled", """
select label, count(*) as n from labelled group by label""")

ORACLE["q23_nested_subsets"] = f"""
with ranked as (
    select doc_id, row_number() over (order by {place('doc_id')}) as r, count(*) over () as total
    from documents),
sized as (select *, {share(0.05, 'total')} as held from ranked)
select doc_id, case when r <= held then 'eval' else 'train' end as part,
       cast(case when r <= held then null
                 when r <= held + greatest(1, floor(cast(0.25 as double) * (total - held))) then 0.25
                 when r <= held + greatest(1, floor(cast(0.5 as double) * (total - held))) then 0.5
                 else 1.0 end as double) as subset
from sized"""

ORACLE["q24_distinct_texts"] = """
select doc_id, text, lang, source, n_chars from (
    select *, row_number() over (partition by text order by doc_id) as copy from documents)
where copy = 1"""

ORACLE["q25_random_documents"] = f"""
select doc_id, lang from documents order by {place('doc_id')} limit 120"""

ORACLE["q26_split_by_row"] = with_inputs("rated", f"""
with {_cleaned}, {three_way('cleaned', 'doc_id')}
select doc_id, Overall, split from cleaned join placed using (doc_id)""")

ORACLE["q27_few_shot_fallback"] = f"""
with named as (
    select doc_id, case when doc_id = 0 then 'single' else lang end as label from documents)
{few_shot(50, 'named')}"""

_odd = (
    "translate(text, 'qxzwk', chr(160) || chr(12288) || chr(133) || chr(28) || chr(0))"
)
ORACLE["q28_clean_documents"] = f"""
with odd as (select doc_id, {_odd} as text from documents)
select doc_id, {collapsed(_nul.format('text'))} as clean, {stripped('text')} as stripped from odd"""

# --- words ---------------------------------------------------------------------


def tally(rows: str, stop_words: bool = False) -> str:
    """CTEs ``<rows>_counts`` and ``<rows>_stats``."""
    found = word_list("text")
    if stop_words:
        stops = ", ".join(quoted(w) for w in ENGLISH)
        found = f"list_filter({found}, lambda w: length(w) >= 3 and w not in ({stops}))"
    return f"""
{rows}_words as (select corpus, {found} as words from {rows}),
{rows}_counts as (
    select corpus, word, count(*) as n
    from (select corpus, unnest(words) as word from {rows}_words) group by all),
{rows}_stats as (
    select corpus, n_texts, coalesce(n_tokens, 0) as n_tokens, coalesce(n_types, 0) as n_types
    from (select corpus, count(*) filter (len(words) > 0) as n_texts from {rows}_words group by corpus)
    left join (select corpus, cast(sum(n) as bigint) as n_tokens, count(*) as n_types
               from {rows}_counts group by corpus) using (corpus))"""


ORACLE["q19_word_counts"] = with_inputs("by_language", f"""
with {tally('by_language')} select corpus, word, n from by_language_counts""")
ORACLE["q19_corpus_statistics"] = with_inputs("downstream", f"""
with {tally('downstream')} select * from downstream_stats""")
ORACLE["q19_streamed_word_counts"] = ORACLE["q19_word_counts"]
ORACLE["q19_streamed_statistics"] = with_inputs("by_language", f"""
with {tally('by_language')} select * from by_language_stats""")
ORACLE["q19_type_sketches"] = with_inputs("by_language", f"""
with {tally('by_language')}
select corpus, count(*) as n_types, true as within_bound from by_language_counts group by corpus
union all select '*', count(distinct word), true from by_language_counts""")
ORACLE["q29_content_words"] = with_inputs("by_language", f"""
with {tally('by_language', True)} select corpus, word, n from by_language_counts""")

_top = """
select corpus as corpus_name, rank, word, n as count, round(n / n_tokens, 9) as relative_frequency,
       n_texts, n_tokens, n_types
from best join by_language_stats using (corpus) where rank <= 50"""
ORACLE["q20_top_words"] = with_inputs("by_language", f"""
with {tally('by_language')},
best as (
    select *, cast(row_number() over (partition by corpus order by n desc, word) as integer) as rank
    from by_language_counts)
{_top}""")
ORACLE["q20_top_words_first_seen"] = with_inputs("by_language", f"""
with {tally('by_language')},
places as (
    select corpus, doc_id, unnest({word_list('text')}) as word,
           generate_subscripts({word_list('text')}, 1) as spot
    from by_language),
firsts as (
    select corpus, word, min(doc_id * 10000000 + spot) as place from places group by all),
best as (
    select *, cast(row_number() over (partition by corpus order by n desc, place) as integer) as rank
    from by_language_counts join firsts using (corpus, word))
{_top}""")


ORACLE["q20_top_words_with_paths"] = with_inputs("by_language", f"""
with {tally('by_language')},
best as (
    select *, cast(row_number() over (partition by corpus order by n desc, word) as integer) as rank
    from by_language_counts)
{_top.replace('corpus as corpus_name', "corpus as corpus_name, 'z/' || corpus || ' | a/' || corpus as corpus_paths")}""")


def divergences(stop_words: bool = False, smoothing: str = "1e-12", others: str = "") -> str:
    return f"""
{tally('by_language', stop_words)},
{tally('downstream', stop_words)},
pairs as (
    select distinct a.corpus as pretraining_name, b.corpus as downstream_name
    from by_language a, downstream b{others}),
a_side as (
    select pretraining_name, downstream_name, word, n as a
    from pairs join by_language_counts on corpus = pretraining_name),
b_side as (
    select pretraining_name, downstream_name, word, n as b
    from pairs join downstream_counts on corpus = downstream_name),
joint as (
    select pretraining_name, downstream_name, word, coalesce(a, 0) as a, coalesce(b, 0) as b
    from a_side full outer join b_side using (pretraining_name, downstream_name, word)),
totals as (
    select pretraining_name, downstream_name, count(*) as v, sum(a) as na, sum(b) as nb
    from joint group by all),
shares as (
    select pretraining_name, downstream_name, v,
           (a + cast({smoothing} as double)) / (na + cast({smoothing} as double) * v) as p,
           (b + cast({smoothing} as double)) / (nb + cast({smoothing} as double) * v) as q
    from joint join totals using (pretraining_name, downstream_name)),
sums as (
    select pretraining_name, downstream_name, v as full_vocab_size,
           sum(p * log2(p / ((p + q) / 2))) as kp, sum(q * log2(q / ((p + q) / 2))) as kq
    from shares group by all)"""


ORACLE["q21_divergence"] = with_inputs("by_language downstream", f"""
with {divergences()}
select pretraining_name, downstream_name, full_vocab_size, round(kp, 9) as kl_pretraining,
       round(kq, 9) as kl_downstream, round((kp + kq) / 2, 9) as jsd_full_vocab,
       round(sqrt((kp + kq) / 2), 9) as js_distance_full_vocab
from sums""")


def _report(stop_words: bool) -> str:
    return with_inputs("by_language downstream", f"""
with {divergences(stop_words)}
select pretraining_name, downstream_name, true as lowercase, {str(stop_words).lower()} as remove_function_words,
       {"'nltk'" if stop_words else 'cast(null as varchar)'} as stopword_library,
       cast({3 if stop_words else 'null'} as integer) as min_word_len,
       x.n_texts as pretraining_n_texts, x.n_tokens as pretraining_n_tokens,
       x.n_types as pretraining_n_types, y.n_texts as downstream_n_texts,
       y.n_tokens as downstream_n_tokens, y.n_types as downstream_n_types, full_vocab_size,
       round((kp + kq) / 2, 9) as jsd_full_vocab, round(sqrt((kp + kq) / 2), 9) as js_distance_full_vocab
from sums join by_language_stats x on x.corpus = pretraining_name
          join downstream_stats y on y.corpus = downstream_name
order by downstream_name, (kp + kq) / 2, pretraining_name""")


_others = " union all select distinct 'nothing', corpus from downstream"
ORACLE["q22_report_with_paths"] = with_inputs("by_language downstream", f"""
with {divergences(False, '1e-6', _others)}
select pretraining_name, 'z/' || pretraining_name || ' | a/' || pretraining_name as pretraining_paths,
       downstream_name, 'z/' || downstream_name || ' | a/' || downstream_name as downstream_paths,
       true as lowercase, false as remove_function_words, cast(null as varchar) as stopword_library,
       cast(null as integer) as min_word_len, cast(1e-6 as double) as smoothing,
       coalesce(x.n_texts, 0) as pretraining_n_texts, coalesce(x.n_tokens, 0) as pretraining_n_tokens,
       coalesce(x.n_types, 0) as pretraining_n_types, y.n_texts as downstream_n_texts,
       y.n_tokens as downstream_n_tokens, y.n_types as downstream_n_types, full_vocab_size,
       round((kp + kq) / 2, 9) as jsd_full_vocab, round(sqrt((kp + kq) / 2), 9) as js_distance_full_vocab
from sums left join by_language_stats x on x.corpus = pretraining_name
          join downstream_stats y on y.corpus = downstream_name""")
ORACLE["q22_alignment_report"] = _report(False)
ORACLE["q29_content_word_report"] = _report(True)

# --- scores ----------------------------------------------------------------------

_errors = """count(*) as n, round(sqrt(avg((gold - pred) * (gold - pred))), 9) as rmse,
       round(corr(gold, pred), 9) as pearson"""
ORACLE["q30_error_and_pearson"] = with_inputs("predictions", f"""
select run_id, {_errors} from predictions group by run_id""")


def ranks(rows: str, run: str) -> str:
    return f"""
ranked as (
    select {run},
           rank() over (partition by {run} order by gold)
               + (count(*) over (partition by {run}, gold) - 1) / 2 as gold_rank,
           rank() over (partition by {run} order by pred)
               + (count(*) over (partition by {run}, pred) - 1) / 2 as pred_rank
    from {rows}),
spearmans as (select {run}, corr(gold_rank, pred_rank) as spearman from ranked group by {run})"""


def kappas(rows: str, run: str, scale: Scale) -> str:
    return f"""
classed as (
    select {run}, {nearest('gold', scale)} as a, {nearest('pred', scale)} as b from {rows}),
occurring as (
    select {run}, class, row_number() over (partition by {run} order by class) as number
    from (select {run}, a as class from classed union select {run}, b from classed)),
numbered as (
    select c.{run}, x.number as a, y.number as b, c.a as fixed_a, c.b as fixed_b
    from classed c join occurring x on x.{run} = c.{run} and x.class = c.a
                   join occurring y on y.{run} = c.{run} and y.class = c.b),
kappas as (
    select {run},
           1 - sum((a - b) ** 2) / (sum(a * a) + sum(b * b) - 2 * sum(a) * sum(b) / count(*)) as qwk,
           1 - sum((fixed_a - fixed_b) ** 2)
               / (sum(fixed_a * fixed_a) + sum(fixed_b * fixed_b)
                  - 2 * sum(fixed_a) * sum(fixed_b) / count(*)) as qwk_fixed
    from numbered group by {run})"""


ORACLE["q31_spearman"] = with_inputs("predictions", f"""
with {ranks('predictions', 'run_id')} select run_id, round(spearman, 9) as spearman from spearmans""")
ORACLE["q32_quadratic_kappa"] = with_inputs("predictions", f"""
with {kappas('predictions', 'run_id', BAND)}
select run_id, round(qwk, 9) as qwk, round(qwk_fixed, 9) as qwk_fixed from kappas""")
ORACLE["q33_normalized_scores"] = with_inputs("predictions", """
select doc_id, round((pred - 1) / 8, 9) as share, round((pred - 1) / 8 * 20, 9) as exam_score,
       round((pred - 1) / 8 * 8 + 1, 9) as band_score
from predictions""")
_exam_pred = "round((pred - 1) / 8 * 20, 6)"
ORACLE["q34_snapped_scores"] = with_inputs("predictions", f"""
select doc_id, cast({nearest('pred', BAND)} as integer) as band_class, {valid('pred', BAND)} as band_score,
       cast({nearest(_exam_pred, EXAM)} as integer) as exam_class, {valid(_exam_pred, EXAM)} as exam_score
from predictions""")

# --- saved runs --------------------------------------------------------------------

_run_facts = r"""
facts as (
    select distinct run,
           case when run like 'Transfer%' then 'transfer' else 'in-domain' end as experiment,
           case when run like 'Transfer%' then 'FCE' else 'IELTS' end as source, 'IELTS' as target,
           lower(regexp_extract(run, '(?i)(ROBERTA|DISTILBERT|BERT)(_\d+)?$', 1)) as model,
           run ilike '%dapt%' as adapted,
           try_cast(regexp_extract(run, '_(\d+)$', 1) as integer) as shots
    from saved)"""
_run_metrics = f"""
{_run_facts},
{ranks('saved', 'run')},
{kappas('saved', 'run', BAND)},
errors as (
    select run, sqrt(avg((gold - pred) * (gold - pred))) as rmse, corr(gold, pred) as pearson
    from saved group by run),
wide as (
    select run as run_id, experiment, source, target, model, adapted, shots, 'test' as split,
           rmse, pearson, spearman, qwk
    from facts join errors using (run) join spearmans using (run) join kappas using (run))"""
ORACLE["q40_saved_runs"] = with_inputs("saved", f"""
with {_run_metrics}
select run_id, experiment, source, target, model, adapted, shots, split, metric, round(value, 9) as value
from (unpivot wide on rmse, pearson, spearman, qwk into name metric value value)""")
ORACLE["q40_metric_files"] = with_inputs("saved", f"""
with {_run_facts},
errors as (
    select run, count(*) as n, round(sqrt(avg((gold - pred) * (gold - pred))), 6) as rmse,
           round(corr(gold, pred), 6) as pearson
    from saved group by run),
wide as (
    select run as run_id, model, adapted, shots,
           case n % 2 when 0 then 'dev' else 'test' end as split, rmse, pearson
    from facts join errors using (run))
select run_id, model, adapted, shots, split, metric, value
from (unpivot wide on rmse, pearson into name metric value value)""")
ORACLE["q41_perplexity"] = with_inputs("predictions", """
with losses as (
    select run_id, factor, avg((gold - pred) * (gold - pred)) * factor as loss
    from predictions, (values (cast(1 as double)), (cast(5 as double)), (cast(60 as double))) f(factor)
    group by run_id, factor)
select run_id, factor, round(loss, 9) as loss,
       round(case when loss < 50 then exp(loss) end, 6) as perplexity
from losses""")
ORACLE["q42_best_checkpoint"] = with_inputs("predictions", f"""
with checkpoints as (
    select run_id, doc_id % 4 * 100 + 100 as step, {_errors} from predictions group by all)
select run_id, rmse, step, n, pearson from (
    select *, row_number() over (partition by run_id order by rmse, step) as r from checkpoints)
where r = 1""")
_change = ", ".join(
    f"round(max(case when adapted then {m} end), 9) as adapted_{m}, "
    f"round(max(case when not adapted then {m} end), 9) as base_{m}, "
    f"round(max(case when adapted then {m} end) - max(case when not adapted then {m} end), 9) as {m}_change"
    for m in ("rmse", "pearson", "spearman", "qwk")
)
ORACLE["q43_adapted_against_base"] = with_inputs("saved", f"""
with {_run_metrics}
select experiment, target, model, shots, {_change}
from wide group by experiment, target, model, shots having count(distinct adapted) = 2""")
ORACLE["q43_bands_against_base"] = with_inputs("predictions", """
with placed as (select *, cast(substr(run_id, 4) as integer) % 12 as k from predictions),
errors as (
    select k % 4 as kind, ['50', '100', '200'][k // 4 % 3 + 1] as shots,
           sqrt(avg((gold - pred) * (gold - pred))) as rmse, corr(gold, pred) as pearson
    from placed group by all),
base as (select shots, rmse, pearson from errors where kind = 0)
select 'FCE' as source, 'IELTS' as target, cast(e.shots as integer) as shots,
       ['A1A2', 'B1B2', 'B2C1'][kind] as band,
       round(e.rmse, 9) as adapted_rmse, round(b.rmse, 9) as base_rmse, round(e.rmse - b.rmse, 9) as rmse_change,
       round(e.pearson, 9) as adapted_pearson, round(b.pearson, 9) as base_pearson,
       round(e.pearson - b.pearson, 9) as pearson_change
from errors e left join base b on e.shots = b.shots where kind > 0""")
_cells = ", ".join(f"round(max(case when shots = {n} then rmse end), 9) as rmse_{n}" for n in (50, 100, 200))
ORACLE["q44_transfer_grid"] = with_inputs("saved", f"""
with {_run_metrics}
select source, target, model, adapted, {_cells}
from wide where experiment = 'transfer' group by source, target, model, adapted""")

# --- document profiles ---------------------------------------------------------------

_surface = f"""
split as (select doc_id, lang, text, {word_list('text')} as words from documents),
counted as (
    select doc_id, lang, cast(len(words) as integer) as n_words,
           cast({_sentences} as integer) as n_sentences,
           cast(length(array_to_string(words, '')) as integer) as n_letters,
           len(list_distinct(words)) as types
    from split),
surface as (
    select doc_id, lang, n_words, n_sentences, n_letters, n_words / n_sentences as mean_sentence_length,
           case when n_words > 0 then n_letters / n_words end as mean_word_length,
           case when n_words > 0 then types / n_words end as type_token_ratio
    from counted)"""
ORACLE["q45_document_profile"] = f"""
with {_surface}
select doc_id, lang, n_words, n_sentences, n_letters, round(mean_sentence_length, 9) as mean_sentence_length,
       round(mean_word_length, 9) as mean_word_length, round(type_token_ratio, 9) as type_token_ratio
from surface"""
_long = f"""
{_surface},
doubles as (
    select lang, cast(n_words as double) as n_words, cast(n_sentences as double) as n_sentences,
           cast(n_letters as double) as n_letters, mean_sentence_length, mean_word_length, type_token_ratio
    from surface),
long as (
    unpivot doubles on n_words, n_sentences, n_letters, mean_sentence_length, mean_word_length,
            type_token_ratio into name feature value value),
by_group as (
    select lang as "group", feature, count(value) as n, avg(value) as mean, stddev_samp(value) as sd
    from long group by all)"""
ORACLE["q45_group_profile"] = f"""
with {_long}
select "group", feature, n, round(mean, 6) as mean, round(sd, 6) as sd from by_group"""
ORACLE["q45_group_quantiles"] = f"""
with {_long}
select lang as "group", feature, round(quantile_cont(value, 0.25), 6) as p25,
       round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.75), 6) as p75
from long group by all"""
ORACLE["q46_external_analyser"] = f"""
with parts as (
    select doc_id, list_filter(string_split_regex(text, '[{T.SPACE}]+'), lambda x: x <> '') as parts
    from documents)
select doc_id, len(parts) as n_parts,
       coalesce(list_max(list_transform(parts, lambda x: length(x))), 0) as longest
from parts"""
ORACLE["q46_table_function"] = ORACLE["q46_external_analyser"]
ORACLE["q47_closest_groups"] = f"""
with {_long},
spread as (select feature, stddev_samp(value) as sd from long group by feature)
select t."group" as target, g."group" as "group",
       round(avg(abs(g.mean - t.mean) / s.sd), 6) as mean_abs_z
from by_group g join by_group t on g.feature = t.feature and g."group" <> t."group"
     join spread s on s.feature = g.feature
where t."group" in ('en', 'de') group by all"""

# --- models and sequences ------------------------------------------------------------

_shots = " union all ".join(
    f"select doc_id, {n} as shots from ({few_shot(n, 'labelled')})" for n in (50, 100, 200)
)
ORACLE["q49_calibrated_transfer"] = with_inputs("predictions", f"""
with labelled as (select doc_id, gold as label from predictions),
other as (select doc_id, gold, round((pred - 1) / 8 * 20, 6) as pred from predictions),
chosen as ({_shots}),
lines as (
    select shots, regr_slope(gold, pred) as slope, regr_intercept(gold, pred) as intercept
    from chosen join other using (doc_id) group by shots),
moved as (select shots, gold, slope * pred + intercept as pred from other, lines),
{ranks('moved', 'shots')},
{kappas('moved', 'shots', BAND)},
errors as (
    select shots, count(*) as n, sqrt(avg((gold - pred) * (gold - pred))) as rmse,
           corr(gold, pred) as pearson
    from moved group by shots)
select shots, n, round(rmse, 6) as rmse, round(pearson, 6) as pearson, round(spearman, 6) as spearman,
       round(qwk, 6) as qwk
from errors join spearmans using (shots) join kappas using (shots)""")

ORACLE["q50_truncated_sequences"] = f"""
with split as (select doc_id, {token_list('text')} as tokens from documents)
select doc_id,
       '[CLS] ' || case when len(tokens) > 0 then array_to_string(tokens[1:126], ' ') || ' ' else '' end
           || '[SEP]' as tokens,
       '1' || repeat('0', cast(least(len(tokens), 126) as integer)) || '1' as special,
       least(len(tokens), 126) + 2 as length, len(tokens) > 126 as truncated
from split"""

_masked = f"""
split as (select doc_id, {token_list('text')} as tokens from documents),
placed as (
    select doc_id, cast(generate_subscripts(tokens, 1) - 1 as integer) as position,
           unnest(tokens) as label
    from (select doc_id, tokens[1:126] as tokens from split)),
chosen as (
    select *, substr({place("doc_id || ':' || position", '42:action')}, 1, 8) as fate
    from placed where substr({place("doc_id || ':' || position")}, 1, 8) < '26666666'),
acted as (
    select doc_id, position, label,
           case when fate < 'cccccccc' then 'mask' when fate < 'e6666666' then 'random' else 'keep' end
               as action
    from chosen)"""
ORACLE["q51_masked_positions"] = f"""
with {_masked}
select *, case action when 'mask' then '[MASK]' when 'keep' then label end as input from acted"""
ORACLE["q51_random_tokens"] = f"""
with {_masked},
vocabulary as (
    select token, row_number() over (order by token) as spot, count(*) over () as size
    from (select distinct unnest({token_list('text')}) as token from benchmark)),
picked as (
    select acted.*,
           cast('0x' || substr({place("doc_id || ':' || position", '42:token')}, 1, 15) as bigint)
               % (select max(size) from vocabulary) + 1 as spot
    from acted where action = 'random')
select doc_id, position, label, action, token as input from picked join vocabulary using (spot)
union all
select *, case action when 'mask' then '[MASK]' else label end from acted where action <> 'random'"""


# --- regression ----------------------------------------------------------------------

_MODEL_FEATURES = ["n_words", "n_sentences", "mean_sentence_length", "mean_word_length", "type_token_ratio"]


def _list(item: str, size: int, name: str) -> str:
    return f"list_transform(range(1, {size + 1}), lambda {name}: {item})"


def regression(strengths: list[float]) -> str:
    """Moments of the splits, models by elimination, and their errors, as the CTE ``path``."""
    p = len(_MODEL_FEATURES)
    values = ", ".join(f"cast({f} as double) as v{i}" for i, f in enumerate(_MODEL_FEATURES, 1))
    known = " and ".join(f"{f} is not null" for f in _MODEL_FEATURES)
    places = range(1, p + 2)
    second = ", ".join("[" + ", ".join(f"covar_pop(v{i}, v{j})" for j in places) + "]" for i in places)
    first = _list(
        _list(f"case when j = {p + 1} then c[i][j] / sqrt(c[i][i]) when i = j then 1 + strength "
              "else c[i][j] / sqrt(c[i][i] * c[j][j]) end", p + 1, "j"), p, "i")
    step = _list(_list("case when i = k then a[i][j] / a[k][k] else a[i][j] - a[i][k] * a[k][j] / a[k][k] end", p + 1, "j"), p, "i")
    return f"""
{_surface},
{three_way('documents', 'doc_id')},
vectors as (
    select split, {values}, cast(1.0 as double) + (n_chars % 17) * cast(0.5 as double) as v{p + 1}
    from surface join (select doc_id, n_chars from documents) using (doc_id) join placed using (doc_id)
    where {known}),
moments as (
    select split, count(*) as n, [{', '.join(f'avg(v{i})' for i in places)}] as m, [{second}] as c
    from vectors group by split),
train as (select m, c from moments where split = 'train'),
steps(strength, k, a) as (
    select strength, 1, {first} from train, (select unnest({strengths}::double[]) as strength)
    union all select strength, k + 1, {step} from steps where k <= {p}),
weights as (
    select strength, m, {_list(f'a[i][{p + 1}] / sqrt(c[i][i])', p, 'i')} as w from steps, train where k = {p + 1}),
models as (select strength, w, m[{p + 1}] - list_sum({_list('w[i] * m[i]', p, 'i')}) as b from weights),
parts as (
    select strength, split, n, c[{p + 1}][{p + 1}] as yy, list_sum({_list(f'w[i] * c[i][{p + 1}]', p, 'i')}) as xy,
           list_sum({_list('list_sum(' + _list('w[i] * w[j] * c[i][j]', p, 'j') + ')', p, 'i')}) as xx,
           m[{p + 1}] - b - list_sum({_list('w[i] * m[i]', p, 'i')}) as bias
    from models, moments),
path as (
    select strength, split, n, sqrt(yy - 2 * xy + xx + bias * bias) as rmse, xy / sqrt(xx * yy) as pearson from parts)"""


ORACLE["q48_penalty_path"] = f"""
with recursive {regression([0.01, 0.1, 1.0])}
select strength, split, n, round(rmse, 6) as rmse, round(pearson, 6) as pearson from path"""
_prediction = " + ".join(["b", *[f"w[{i}] * v{i}" for i, _ in enumerate(_MODEL_FEATURES, 1)]])
ORACLE["q48_score_regression"] = f"""
with scored as (
    with recursive {regression([0.01, 0.1, 1.0])},
    best as (select strength from path where split = 'dev' order by rmse, strength limit 1)
    select split, strength, v{len(_MODEL_FEATURES) + 1} as gold, round({_prediction}, 6) as pred
    from models join best using (strength), vectors where split <> 'train'),
{ranks('scored', 'split')},
{kappas('scored', 'split', BAND)},
errors as (
    select split, any_value(strength) as strength, count(*) as n,
           sqrt(avg((gold - pred) * (gold - pred))) as rmse, corr(gold, pred) as pearson
    from scored group by split)
select split, strength, n, round(rmse, 6) as rmse, round(pearson, 6) as pearson,
       round(spearman, 6) as spearman, round(qwk, 6) as qwk
from errors join spearmans using (split) join kappas using (split)"""
