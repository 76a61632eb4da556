"""The registered queries in DuckDB's SQL, put together from named parts."""

from __future__ import annotations

from ..functions import fixed as X
from ..functions.text import STOPWORDS
from ..operators import context as C
from ..operators import retrieval as R


def q(text: str) -> str:
    """A string literal; line ends by number, so that none is lost."""
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {q(f'^{X.SPACE}+|{X.SPACE}+$')}, '', 'g')"


def any_of(x: str, terms) -> str:
    return "(" + " or ".join(f"contains({x}, {q(t)})" for t in terms) + ")"


STOP = "(" + ", ".join(map(q, STOPWORDS)) + ")"


def tokens(source: str, keys: str, text: str = "text") -> str:
    """select keys, term from source, a row a token."""
    raw = f"unnest(regexp_extract_all(lower({text}), {q(X.TOKEN)}))"
    return (
        f"select {keys}, term from (select {keys}, translate(regexp_replace(regexp_replace(tok, {q(X.TOKEN_EDGE)}, '', 'g'), "
        f"{q(X.DIACRITICS)}, '', 'g'), 'إأآىة', 'ااايه') as term from (select {keys}, {raw} as tok from {source})) "
        f"where term <> '' and term not in {STOP}"
    )


def chunks(size: int = 1000, overlap: int = 150) -> str:
    step = size - overlap
    return f"""
base as (select doc_id, text, length(text) as n from documents where length(text) > 0),
win as (select doc_id, text, n, unnest(generate_series(0, case when n <= {size} then 0 else cast(ceil((n - {size}) / {step}.0) as bigint) end)) as w from base),
piece as (select doc_id, w, {strip(f'substr(text, cast(w * {step} + 1 as bigint), {size})')} as text, w * {step} as char_start, least(w * {step} + {size}, n) as char_end from win),
chunks as (select doc_id, position, doc_id || ':fixed_size:' || position as chunk_id, text, char_start, char_end from
  (select *, row_number() over (partition by doc_id order by w) - 1 as position from piece where text <> ''))"""


SENTENCES = "list_filter(list_transform(string_split(regexp_replace(text, '([.!?؟])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: " + strip("s") + "), lambda s: s <> '')"
ONE = "questions as (select item_id as qid, 0 as query_idx, text from benchmark)"
MANY = f"""
wordings as (select item_id as qid, list_concat([text], list_slice({SENTENCES}, 1, 3)) as ws from benchmark),
numbered as (select qid, unnest(ws) as text, generate_subscripts(ws, 1) as i from wordings),
kept as (select qid, text, min(i) as i from numbered group by 1, 2),
questions as (select qid, text, row_number() over (partition by qid order by i) - 1 as query_idx from kept)"""


def bm25(top_k: int, name: str = "hits") -> str:
    return f"""
toks as ({tokens('chunks', 'chunk_id')}),
post as (select chunk_id, term, count(*) as tf from toks group by 1, 2),
lens as (select chunk_id, sum(tf) as dl from post group by 1),
tot as (select (select count(*) from chunks) as n, (select sum(dl) from lens) as words),
dfs as (select term, count(*) as df from post group by 1),
raws as (select term, df, ln(n - df + 0.5) - ln(df + 0.5) as raw from dfs, tot),
terms as (select term, df, case when raw < 0 then {R.EPSILON} * (select avg(raw) from raws) else raw end as idf from raws),
asked as (select qid, query_idx, term, count(*) as qtf from ({tokens('questions', 'qid, query_idx')}) group by 1, 2, 3),
scored as (select qid, query_idx, chunk_id, round_even(sum(qtf * idf * tf * {R.K1 + 1} / (tf + {R.K1} * ({1 - R.B} + {R.B} * dl * n / words))), 6) as score
  from asked join terms using (term) join post using (term) join lens using (chunk_id), tot group by 1, 2, 3),
{name} as (select * from (select *, row_number() over (partition by qid, query_idx order by score desc, chunk_id) as rank from scored) where rank <= {top_k})"""


def hashed(source: str, keys: str, name: str) -> str:
    """name(keys, idx, value): vectors by hashing, of unit length, without their zeros."""
    part = lambda i: f"cast('0x' || substr(md5(tok), {8 * i + 1}, 8) as bigint)"
    return f"""
{name}_tok as (select {keys}, unnest(regexp_extract_all(lower(text), {q(X.TOKEN)})) as tok from {source}),
{name}_m as (select {keys}, (256 * (({part(0)} + {part(1)} + {part(2)}) % 3) + {part(3)}) % 768 as m from {name}_tok),
{name}_sum as (select {keys}, m % 384 as idx, sum(case when m < 384 then 1 else -1 end) as v from {name}_m group by {keys}, m % 384 having v <> 0),
{name} as (select {keys}, idx, v / sqrt(sum(v * v) over (partition by {keys})) as value from {name}_sum)"""


def semantic(top_k: int) -> str:
    return f"""{hashed('chunks', 'chunk_id', 'cv')}, {hashed('questions', 'qid, query_idx', 'qv')},
ids as (select qid, query_idx, chunk_id from questions, chunks where regexp_matches(questions.text, '\\S')),
dots as (select qid, query_idx, chunk_id, sum(qv.value * cv.value) as s from qv join cv using (idx) group by 1, 2, 3),
sem_all as (select ids.*, round_even(coalesce(s, 0), 6) as score from ids left join dots using (qid, query_idx, chunk_id)),
sem as (select * from (select *, row_number() over (partition by qid, query_idx order by score desc, chunk_id) as rank from sem_all) where rank <= {top_k})"""


FUSED = """
both_ as (select coalesce(s.qid, k.qid) as qid, coalesce(s.query_idx, k.query_idx) as query_idx, coalesce(s.chunk_id, k.chunk_id) as chunk_id,
  s.score as semantic_score, s.rank as semantic_rank, k.score as keyword_score, k.rank as keyword_rank
  from sem s full join hits k on s.qid = k.qid and s.query_idx = k.query_idx and s.chunk_id = k.chunk_id)"""
RRF = f"""{FUSED},
fused as (select *, round_even(coalesce(1.0 / (60 + semantic_rank), 0) + coalesce(1.0 / (60 + keyword_rank), 0), 9) as score from both_)"""
WEIGHTED = f"""{FUSED},
sn as (select qid, query_idx, chunk_id, case when max(score) over w = min(score) over w then 0 else (score - min(score) over w) / (max(score) over w - min(score) over w) end as s from sem window w as (partition by qid, query_idx)),
kn as (select qid, query_idx, chunk_id, case when max(score) over w = min(score) over w then 0 else (score - min(score) over w) / (max(score) over w - min(score) over w) end as k from hits window w as (partition by qid, query_idx)),
fused as (select both_.*, round_even(0.4 * coalesce(s, 0) + 0.6 * coalesce(k, 0), 9) as score from both_ left join sn using (qid, query_idx, chunk_id) left join kn using (qid, query_idx, chunk_id))"""
ORDERED = """
ordered as (select *, row_number() over (partition by qid, query_idx order by score desc, semantic_rank nulls last, keyword_rank nulls last, chunk_id) as rank from fused)"""

MERGED = """
merged_all as (select qid, chunk_id, max(score) as score, arg_max(query_idx, (score, -query_idx)) as best_query,
  list(query_idx order by query_idx, rank) as qs, list(score order by query_idx, rank) as ss, min((query_idx, rank)) as first from hits group by 1, 2),
merged as (select * from (select *, row_number() over (partition by qid order by score desc, first, chunk_id) as rank from merged_all) where rank <= 20)"""


def words(x: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({x}), {q(X.WORD)}))"


def share(a: str, b: str) -> str:
    return f"(case when len({a}) > 0 then len(list_intersect({a}, {b})) / len({a}) else 0.0 end)"


def features() -> str:
    """Candidates with their features; needs chunks, questions, hits and merged."""
    lower = "lower(text)"
    asked = "lower(array_to_string(vs, chr(10)))"
    both = lambda terms: " + ".join(f"(contains({asked}, {q(t)}) and contains({lower}, {q(t)}))::int" for t in terms)
    formula = f"(regexp_matches({lower}, {q(X.FORMULA)}) or {any_of(lower, X.FORMULA_TERMS)})"
    return f"""
asked_by as (select qid, query_idx, text as w from questions),
vlist as (select m.qid, m.chunk_id, list(a.w order by a.query_idx) as found from merged m join asked_by a on a.qid = m.qid and list_contains(m.qs, a.query_idx) group by 1, 2),
cand as (select m.qid, m.chunk_id, m.rank, m.score, c.text, len(list_distinct(m.qs)) as n_found,
  list_slice(case when v.found[1] = q0.w then v.found else list_concat([q0.w], v.found) end, 1, 5) as vs
  from merged m join chunks c using (chunk_id) join vlist v using (qid, chunk_id) join asked_by q0 on q0.qid = m.qid and q0.query_idx = 0 where m.rank <= 15),
sep as (select *, list_transform(vs, lambda v: {share(words('v'), words('text'))}) as shares from cand),
feat as (select *, round(1 / (1 + exp(-(8 * list_max(shares) - 4))), 9) as pair, round(list_max(shares), 9) as lexical,
  vs[list_position(shares, list_max(shares))] as best_query, case when {formula} then 0.1 else 0.0 end as formula_bonus,
  least(0.08, ({both(X.RERANK_TERMS)}) * 0.02) as keyword_bonus, least(0.08, ({both(X.RERANK_PHRASES)}) * 0.08) as phrase_bonus,
  least(1.0, greatest(0.0, score * 10)) as retrieval, least(0.08, greatest(0, n_found - 1) * 0.02) as multi_bonus from sep),
scored2 as (select *, round_even(0.74 * pair + 0.07 * retrieval + 0.11 * lexical + 0.0 + formula_bonus + keyword_bonus + phrase_bonus + multi_bonus, 6) as new_score from feat),
reranked as (select * from (select *, row_number() over (partition by qid order by new_score desc, rank, chunk_id) as new_rank from scored2) where new_rank <= 5)"""


FIVE = "select h.qid, h.rank, h.chunk_id, h.score, c.text, 'doc' || c.doc_id || '.txt' as source from hits h join chunks c using (chunk_id)"


def blocks(budget: int, rows: str = FIVE, mark: str = "") -> str:
    """taken and ctx, with ``mark`` before their names: blocks and contexts of rows(qid, rank, chunk_id, score, text, source)."""
    return f"""
{mark}top as ({rows}),
{mark}heads as (select *, '[Source ' || rank || ' | TYPE=TEXT | FILE=' || source || ' | SCORE=' || printf('%.4f', round_even(score, 4)) || ']' as head from {mark}top),
{mark}blk as (select *, head || chr(10) || 'TEXT CONTENT:' || chr(10) || text as block from {mark}heads),
{mark}run as (select *, sum(length(block)) over (partition by qid order by rank) as upto from {mark}blk),
{mark}taken as (select qid, rank as index, chunk_id, case when upto <= {budget} then block else substr(block, 1, {budget}) end as block from {mark}run
  where upto <= {budget} or (rank = 1 and length(head) + 20 < {budget})),
{mark}ctx as (select qid, string_agg(block, {q(X.BLOCK_SEPARATOR)} order by index) as context, count(*) as n_sources from {mark}taken group by 1)"""


def prompt(question: str, context: str) -> str:
    return f"{q(C.USER_START)} || case when regexp_matches({context}, '\\S') then {context} else {q(X.NO_CONTEXT)} end || {q(C.USER_MIDDLE)} || {question} || {q(C.USER_END)}"


def eval_tokens(x: str) -> str:
    return f"list_distinct(regexp_extract_all(translate(regexp_replace(lower(coalesce({x}, '')), {q(X.EVAL_DIACRITICS)}, '', 'g'), 'أإآى', 'اااي'), {q(X.EVAL_TOKEN)}))"


def eval_share(a: str, b: str, w: float) -> str:
    return f"least(1.0, len(list_intersect({a}, {b})) / greatest(1.0, len({a}) * {w}))"


PAIRS = """
pairs as (select conv_id, turn, text as answer, lag(text) over o as question, lag(role) over o as before_role, lag(text, 2) over o as context from conversations window o as (partition by conv_id order by turn)),
qa as (select conv_id, turn, question, answer, coalesce(context, '') as context from conversations join pairs using (conv_id, turn) where role = 'assistant' and before_role = 'user')"""


def route_case(x: str) -> str:
    lower = f"lower({x})"
    return f"""case when {any_of(x, X.MULTI_PART)} or {any_of(lower, X.MULTI_PART)} then 'advanced_rag|decomposition,compression'
  when {any_of(lower, X.CONDITIONAL)} and {any_of(lower, X.EXCEPTION)} then 'advanced_rag|rewriting,reranking,crag'
  when {any_of(lower, X.DOCUMENT_SENSITIVE)} then 'basic_rag|' end"""


def fallback_case(x: str) -> str:
    lower = f"lower({x})"
    return f"""case when {any_of(lower, X.FALLBACK_COMPARE)} then 'advanced_rag|decomposition,compression'
  when {any_of(lower, X.FALLBACK_DATE)} then 'advanced_rag|self_query' when {any_of(lower, X.FALLBACK_VAGUE)} then 'advanced_rag|rewriting'
  when len(regexp_extract_all({x}, {q(r'[^\s\x{A0}]+')})) <= 7 and {any_of(lower, X.FALLBACK_FOCUSED)} then 'basic_rag|' else 'basic_rag|' end"""


def price_case(model: str, prices, default, which: int) -> str:
    ordered = " ".join(f"when contains(lower({model}), {q(k)}) then {v[which]}" for k, v in prices)
    return f"case {ordered} else {default[which]} end"
