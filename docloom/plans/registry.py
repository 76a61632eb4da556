"""All registered queries of the library, with their SQL.

Each reads the given tables in whole. Where a table lacks what an operator needs, an adapter says
what stands in: documents' lines for paragraphs, benchmark items for questions, their sentences for
generated wordings, conversations for answers and calls, orders for metadata, events for
recognised tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import text as T
from ..operators import blockmax, chunking, context, elements, embed, evaluation, filtering, filters, hooks, rerank, retrieval, routing, vectors
from ..operators.written import written
from ..sources import files, layout, ocr, tables
from . import pipelines, report
from . import sql as S

SIZE, OVERLAP = 1000, 150
TOP_K = 5
DEPTH = max(TOP_K, 8)

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "mock_answer"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return tables.table(spark, d, name, {"documents": "doc_id", "pages": "page_id"}.get(name))


# --- adapters -----------------------------------------------------------------------------


def _chunks(spark, d):
    return chunking.fixed_size(_t(spark, d, "documents"), SIZE, OVERLAP)


def _questions(spark, d):
    return _t(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.lit(0).alias("query_idx"), "text")


def _wordings(spark, d):
    parts = F.filter(F.transform(F.split("text", r"(?<=[.!?؟])\s+"), T.strip), lambda s: s != "")
    base = _t(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text", F.slice(parts, 1, 3).alias("generated"))
    return retrieval.wordings(base, "generated")


def _paragraphs(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", F.regexp_replace("text", "\n", "\n\n").alias("text"))
    return elements.text_elements(docs)


def _headed(spark, d):
    """Every fifth line is a heading of levels 1, 2, 3 in turn."""
    n = F.floor(F.col("pos") / 5)
    head = F.col("pos") % 5 == 0
    return (
        _paragraphs(spark, d)
        .withColumn("type", F.when(head, "heading").otherwise("paragraph"))
        .withColumn("level", F.when(head, (n % 3 + 1).cast("int")))
        .withColumn("page", (F.floor(F.col("pos") / 12) + 1).cast("int"))
    )


_HEADED = f"""
docs as (select doc_id, replace(text, chr(10), chr(10) || chr(10)) as text from documents),
lines as (select doc_id, unnest(string_split_regex(text, '\\n\\s*\\n')) as raw, generate_subscripts(string_split_regex(text, '\\n\\s*\\n'), 1) as ln from docs),
para as (select doc_id, row_number() over (partition by doc_id order by ln) - 1 as pos, {S.strip('raw')} as text from lines where {S.strip('raw')} <> ''),
headed as (select doc_id, pos, text, case when pos % 5 = 0 then 'heading' else 'paragraph' end as type,
  case when pos % 5 = 0 then (pos // 5) % 3 + 1 end as level, pos // 12 + 1 as page from para)"""


def _order_tables(spark, d):
    """A table for each customer: orders as rows below a header."""
    orders = _t(spark, d, "orders")
    row = F.array(F.col("o_orderkey").cast("string"), "o_orderstatus", F.concat(F.lit(" "), F.col("o_orderpriority"), F.lit(" ")))
    rows = orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", row.alias("row")))).alias("r"))
    head = F.array(F.array(F.lit("order"), F.lit("status"), F.lit("priority"), F.lit("")))
    return rows.select("o_custkey", F.concat(head, F.transform("r", lambda x: x["row"])).alias("rows"))


# --- sources and elements -----------------------------------------------------------------


@query(f"with {_HEADED} select doc_id, pos::bigint as pos, 'paragraph' as type, text from para")
def text_elements(spark, d):
    return _paragraphs(spark, d).select("doc_id", F.col("pos").cast("long").alias("pos"), "type", "text")


@query(
    f"with {_HEADED}, r as (select doc_id, pos, case when type = 'heading' then repeat('#', level::int) || ' ' || text else text end as t from headed) "
    "select doc_id, md5(string_agg(t, chr(10) || chr(10) order by pos)) as text_md5, sum(length(t))::bigint + 2 * (count(*) - 1) as n_chars from r group by 1"
)
def full_text_render(spark, d):
    full = elements.full_text(_headed(spark, d))
    return full.select("doc_id", F.md5(F.col("full_text").cast("binary")).alias("text_md5"), F.length("full_text").cast("long").alias("n_chars"))


@query(
    f"with {_HEADED}, h as (select doc_id, pos, type, text, {', '.join(f'''max(case when type = 'heading' and level = {k} then pos end) over o as p{k}''' for k in (1, 2, 3))} "
    "from headed window o as (partition by doc_id order by pos rows unbounded preceding)) "
    "select h.doc_id, h.pos::bigint as pos, concat_ws(' > ', a.text, case when h.p2 > coalesce(h.p1, -1) then b.text end, "
    "case when h.p3 > coalesce(h.p1, -1) and h.p3 > coalesce(h.p2, -1) then c.text end) as section from h "
    "left join headed a on a.doc_id = h.doc_id and a.pos = h.p1 left join headed b on b.doc_id = h.doc_id and b.pos = h.p2 "
    "left join headed c on c.doc_id = h.doc_id and c.pos = h.p3 where h.type <> 'heading'"
)
def section_paths(spark, d):
    return elements.section_paths(_headed(spark, d), 3).select("doc_id", F.col("pos").cast("long").alias("pos"), "section")


@query()
def markdown_elements(spark, d):
    """Documents as Markdown: every fifth line a heading, every seventh a table whose first cell it is."""
    marked = F.array_join(
        F.transform(
            F.split("text", "\n"),
            lambda x, i: F.when(i % 5 == 0, F.concat(F.lit("## "), x)).when(i % 7 == 3, F.concat(F.lit("| a | b |\n|---|---|\n| "), x, F.lit(" | c |"))).otherwise(x),
        ),
        "\n",
    )
    out = elements.markdown_elements(_t(spark, d, "documents").select("doc_id", marked.alias("text")))
    return out.select("doc_id", F.col("pos").cast("long").alias("pos"), "type", "text", "level", "table")


@query()
def html_elements(spark, d):
    pages = _t(spark, d, "pages").select(
        F.col("page_id").cast("string").alias("doc_id"), F.col("url").alias("path"), F.lit("html").alias("format"), F.col("html").cast("binary").alias("content")
    )
    return files.parsed(pages).select("doc_id", "pos", "type", "text", "level", "table", "_error")


@query(
    "with r as (select o_custkey, '| ' || o_orderkey || ' | ' || o_orderstatus || ' | ' || o_orderpriority || ' |  |' as line, o_orderkey from orders) "
    "select o_custkey, '**Table: orders**' || chr(10) || chr(10) || '| order | status | priority |  |' || chr(10) || '| --- | --- | --- | --- |' || chr(10) || "
    "string_agg(line, chr(10) order by o_orderkey) as markdown from r group by 1"
)
def markdown_table_render(spark, d):
    return _order_tables(spark, d).select("o_custkey", T.table_markdown(F.col("rows"), F.lit("orders")).alias("markdown"))


_PIECE_START = "'**Table: orders**' || chr(10) || chr(10) || '| order | status | priority |  |' || chr(10) || '| --- | --- | --- | --- |'"


@query(
    "with recursive lines as (select o_custkey, '| ' || o_orderkey || ' | ' || o_orderstatus || ' | ' || o_orderpriority || ' |  |' as line, row_number() over (partition by o_custkey order by o_orderkey) as n from orders), "
    f"start as (select {_PIECE_START} as head), "
    "filled as (select o_custkey, n, line, 0 as piece, (length(head) + 1 + length(line))::bigint as used from lines, start where n = 1 "
    "union all select l.o_custkey, l.n, l.line, case when f.used + 1 + length(l.line) > 300 then f.piece + 1 else f.piece end, "
    "(case when f.used + 1 + length(l.line) > 300 then length(head) else f.used end + 1 + length(l.line))::bigint from filled f join lines l on l.o_custkey = f.o_custkey and l.n = f.n + 1, start) "
    "select o_custkey, piece, head || chr(10) || string_agg(line, chr(10) order by n) as text from filled, start group by 1, 2, head"
)
def table_pieces(spark, d):
    tables = _order_tables(spark, d).select("o_custkey", T.table_markdown(F.col("rows")).alias("md"))
    pieces = chunking.table_splitter(300)(F.col("md"), F.lit("orders"))
    return tables.select("o_custkey", F.posexplode(pieces).alias("piece", "text"))


_OCR = f"""
tok as (select user_id as page, event_id // 1000 as block, event_id % 9 as line, event_id as word, case when event_id % 4 = 0 then substr(event_type, 1, 4) else event_type end as t, value as conf from events)"""


def _ocr_tokens(spark, d):
    word = F.when(F.col("event_id") % 4 == 0, F.substring("event_type", 1, 4)).otherwise(F.col("event_type"))
    return _t(spark, d, "events").select(
        F.lit(0).alias("doc_id"),
        F.col("user_id").alias("page"),
        F.floor(F.col("event_id") / 1000).alias("block_num"),
        F.lit(0).alias("par_num"),
        (F.col("event_id") % 9).alias("line_num"),
        F.col("event_id").alias("word_num"),
        word.alias("text"),
        F.col("value").cast("string").alias("conf"),
    )


_OCR_TEXT = f"""{_OCR},
good as (select * from tok where not (conf < 20 and length(t) <= 4)),
ln as (select page, block, line, string_agg(t, ' ' order by word) as s from good group by 1, 2, 3),
dedup as (select page, block, line, s from (select *, lag(s) over (partition by page order by block, line) as p from ln) where p is distinct from s),
pg as (select page, string_agg(s, chr(10) order by block, line) as text from dedup group by 1)"""


@query(f"with {_OCR_TEXT} select page, text from pg")
def ocr_lines(spark, d):
    return ocr.page_text(_ocr_tokens(spark, d)).select("page", "text")


@query(
    f"with {_OCR_TEXT}, st as (select page, round_even(avg(conf), 6) as mean_conf, sum((conf < 25 and length(t) <= 4)::int)::bigint as low_count, count(*) as token_count from tok group by 1) "
    "select page, mean_conf, low_count, token_count, (length(regexp_replace(coalesce(text, ''), '\\s+', '', 'g')) < 20 or mean_conf < 18) as weak from st left join pg using (page)"
)
def ocr_page_quality(spark, d):
    tokens = _ocr_tokens(spark, d)
    both = ocr.page_stats(tokens).join(ocr.page_text(tokens), ["doc_id", "page"], "left")
    weak = ocr.is_weak(F.coalesce("text", F.lit("")), F.col("mean_conf"), F.col("token_count"))
    return both.select("page", "mean_conf", "low_count", "token_count", weak.alias("weak"))


# --- chunks -------------------------------------------------------------------------------


@query(f"with {S.chunks(SIZE, OVERLAP)} select doc_id, position::bigint as position, chunk_id, text, char_start::bigint as char_start, char_end::bigint as char_end from chunks")
def fixed_size_chunks(spark, d):
    n = lambda c: F.col(c).cast("long").alias(c)
    return _chunks(spark, d).select("doc_id", n("position"), "chunk_id", "text", n("char_start"), n("char_end"))


@query(
    f"with {S.chunks(SIZE, OVERLAP)} select doc_id, count(*) as n_chunks, min(length(text))::bigint as shortest, max(length(text))::bigint as longest, sum(length(text))::bigint as total from chunks group by 1"
)
def fixed_size_stats(spark, d):
    n = F.length("text").cast("long")
    return _chunks(spark, d).groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.min(n).alias("shortest"), F.max(n).alias("longest"), F.sum(n).alias("total"))


@query()
def recursive_chunks(spark, d):
    return chunking.recursive(_paragraphs(spark, d))


@query()
def structural_chunks(spark, d):
    return chunking.structural(_headed(spark, d))


@query()
def procedure_chunks(spark, d):
    """Every ninth line starts a procedure."""
    text = F.when(F.col("pos") % 9 == 4, F.concat(F.lit("Procedure "), F.col("pos").cast("string"), F.lit(": "), F.col("text"))).otherwise(F.col("text"))
    return chunking.procedures(_paragraphs(spark, d).withColumn("text", text))


@query()
def parent_child_chunks(spark, d):
    return chunking.parent_child(_paragraphs(spark, d))


# --- tokens and vectors -------------------------------------------------------------------


@query(f"with toks as ({S.tokens('documents', 'doc_id')}) select doc_id, term, count(*) as tf from toks group by 1, 2")
def tokens(spark, d):
    rows = _t(spark, d, "documents").select("doc_id", F.explode(T.tokens(F.col("text"))).alias("term"))
    return rows.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


@query(
    f"with {S.chunks(SIZE, OVERLAP)}, {S.ONE}, {S.bm25(TOP_K)} select term, df, round_even(idf, 6) as idf from terms"
)
def term_stats(spark, d):
    _, terms, _ = retrieval.index(_chunks(spark, d))
    return terms.select("term", "df", F.bround("idf", 6).alias("idf"))


@query(f"with {S.hashed('documents', 'doc_id', 'v')} select doc_id, idx::int as idx, round_even(value, 6) as value from v")
def hash_embedding(spark, d):
    vectors = embed.HashingEmbedder().embed(_t(spark, d, "documents"), ["doc_id"], "text")
    rows = vectors.select("doc_id", F.posexplode("vector").alias("idx", "value")).filter("value <> 0")
    return rows.select("doc_id", "idx", F.bround("value", 6).alias("value"))


def _vectors(spark, d):
    return _t(spark, d, "embeddings").filter("embedding is not null").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), "label")


def _cosine_sql(same: str) -> str:
    return (
        "with s as (select a.vec_id as query, b.vec_id as chunk_id, round_even(list_dot_product(a.embedding::double[], b.embedding::double[]) / sqrt(list_dot_product(a.embedding::double[], a.embedding::double[]) "
        f"* list_dot_product(b.embedding::double[], b.embedding::double[])), 6) as score from embeddings a join embeddings b on {same} where a.vec_id % 20 = 0), "
        "r as (select *, row_number() over (partition by query order by score desc, chunk_id) as rank from s) select query, chunk_id, score, rank::int as rank from r where rank <= 10"
    )


@query(_cosine_sql("true"))
def cosine_topk(spark, d):
    rows = _vectors(spark, d)
    asked = rows.filter("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query"), "vector")
    return retrieval.cosine_topk(asked, rows, 10).select("query", "chunk_id", "score", "rank")


@query(_cosine_sql("true"))
def cosine_topk_tiles(spark, d):
    """The same by tiles of small blocks: the plan for more queries than a block holds."""
    rows = _vectors(spark, d)
    asked = rows.filter("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query"), "vector")
    return vectors.topk_tiles(asked, rows, 10, block_rows=256)[0].select("query", "chunk_id", "score", "rank")


@query(_cosine_sql("a.label = b.label"))
def cosine_topk_filtered(spark, d):
    rows = _vectors(spark, d)
    asked = rows.filter("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query"), "vector", "label")
    return retrieval.cosine_topk(asked, rows, 10, where="label").select("query", "chunk_id", "score", "rank")


# --- retrieval ----------------------------------------------------------------------------


def _keyword(spark, d, top_k=40):
    return retrieval.bm25(_questions(spark, d), _chunks(spark, d), top_k)


def _semantic(spark, d, top_k=40):
    e = embed.HashingEmbedder()
    key = F.concat_ws(":", "qid", "query_idx").alias("query")
    asked = e.embed(retrieval.usable(_questions(spark, d), top_k), ["qid", "query_idx"], "text").select(key, "vector")
    hits = vectors.topk_texts(asked, _chunks(spark, d), top_k, e)
    part = lambda i: F.split("query", ":")[i]
    return hits.select(part(0).cast("long").alias("qid"), part(1).cast("int").alias("query_idx"), "chunk_id", "score", "rank")


def _hits(df):
    return df.select("qid", "chunk_id", "score", F.col("rank").cast("int").alias("rank"))


_HITS = "select qid, chunk_id, score, rank::int as rank from "


@query(f"with {S.chunks(SIZE, OVERLAP)}, {S.ONE}, {S.bm25(10)} {_HITS} hits")
def bm25_topk(spark, d):
    return _hits(_keyword(spark, d, 10))


@query(f"with {S.chunks(SIZE, OVERLAP)}, {S.ONE}, {S.bm25(10)} {_HITS} hits")
def bm25_blockmax(spark, d):
    """The same hits from packed postings, without the blocks that can't hold one."""
    return _hits(blockmax.bm25(_questions(spark, d), _chunks(spark, d), 10)[0])


@query(f"with {S.chunks(SIZE, OVERLAP)}, {S.ONE}, {S.semantic(10)} {_HITS} sem")
def hash_semantic_topk(spark, d):
    return _hits(_semantic(spark, d, 10))


_FUSION = f"with {S.chunks(SIZE, OVERLAP)}, {S.ONE}, {S.semantic(40)}, {S.bm25(40)}"
_FUSED = "select qid, chunk_id, score, semantic_rank::int as semantic_rank, keyword_rank::int as keyword_rank, rank::int as rank from ordered"


def _fused(df):
    n = lambda c: F.col(c).cast("int").alias(c)
    return df.select("qid", "chunk_id", "score", n("semantic_rank"), n("keyword_rank"), n("rank"))


@query(f"{_FUSION}, {S.RRF}, {S.ORDERED} {_FUSED}")
def rrf_fusion(spark, d):
    return _fused(retrieval.rrf(_semantic(spark, d), _keyword(spark, d)))


@query(f"{_FUSION}, {S.WEIGHTED}, {S.ORDERED} {_FUSED}")
def weighted_fusion(spark, d):
    return _fused(retrieval.weighted(_semantic(spark, d), _keyword(spark, d), alpha=0.4))


@query(f"{_FUSION}, {S.RRF}, {S.ORDERED} {_FUSED} where rank <= {TOP_K}")
def hybrid_topk(spark, d):
    return _fused(retrieval.hybrid(_semantic(spark, d), _keyword(spark, d), TOP_K))


@query(
    f"{_FUSION}, {S.RRF}, {S.ORDERED}, good as (select o.*, row_number() over (partition by qid, query_idx order by rank) as r2 from ordered o join chunks c using (chunk_id) "
    "join labels l on l.doc_id = c.doc_id where l.quality = 1) select qid, chunk_id, score, semantic_rank::int as semantic_rank, keyword_rank::int as keyword_rank, r2::int as rank from good where r2 <= 5"
)
def hybrid_postfilter(spark, d):
    """Only chunks of documents of quality 1, after fusion; a question may keep fewer than five."""
    fused = retrieval.rrf(_semantic(spark, d), _keyword(spark, d))
    of = _chunks(spark, d).select("chunk_id", "doc_id").join(_t(spark, d, "labels").filter("quality = 1"), "doc_id")
    kept = fused.join(of.select("chunk_id"), "chunk_id", "left_semi")
    order = Window.partitionBy("qid", "query_idx").orderBy("rank")
    return _fused(kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= TOP_K))


def _metadata_orders(spark, d):
    date = F.date_format("o_orderdate", "yyyy-MM-dd")
    meta = F.create_map(
        F.lit("Issue_Date"), date, F.lit("department"), F.col("o_orderpriority"), F.lit("section"), F.concat(F.lit("S-"), F.col("o_orderstatus")),
        F.lit("issue_year"), F.when(F.col("o_orderkey") % 3 != 0, F.year("o_orderdate").cast("string")),
    )
    return _t(spark, d, "orders").select("o_orderkey", F.map_filter(meta, lambda k, v: v.isNotNull()).alias("metadata"), "o_orderstatus", "o_orderpriority")


@query("select o_orderkey from orders where contains(lower(o_orderpriority), 'urgent') and o_orderstatus = 'O' and year(o_orderdate) > 1996")
def metadata_filter_store(spark, d):
    rows = _metadata_orders(spark, d)
    return rows.filter(filters.store_filter(F.col("metadata"), {"department": "URGENT", "section": "s-o", "year_gt": 1996})).select("o_orderkey")


@query("select o_orderkey from orders where o_orderpriority in ('1-URGENT', '2-HIGH') and o_orderkey % 3 <> 0 and year(o_orderdate) = 1997")
def metadata_filter_keyword(spark, d):
    rows = _metadata_orders(spark, d)
    wanted = {"department": ["1-URGENT", "2-HIGH"], "issue_year": "1997", "year_gt": 1990}
    return rows.filter(filters.keyword_filter(F.col("metadata"), wanted)).select("o_orderkey")


@query("select o_orderkey from orders where contains(lower(o_orderstatus), 'f') and year(o_orderdate) = 1998 and contains(lower(o_orderpriority), 'low')")
def metadata_filter_engine(spark, d):
    rows = _metadata_orders(spark, d).withColumn("metadata", F.map_filter("metadata", lambda k, _: k != "section"))
    wanted = {"section": "F", "issue_year": 1998, "document": "low", "year_gt": 1997}
    keep = filters.engine_filter(F.col("metadata"), wanted, F.col("o_orderstatus"), F.col("o_orderpriority"), F.lit(""))
    return rows.filter(keep).select("o_orderkey")


def _filtered_chunks(spark, d):
    """Chunks with metadata of their documents: source, language, two years and dates."""
    n = F.col("doc_id")
    meta = F.create_map(
        F.lit("Document"), F.concat(F.lit(" "), "source", F.lit(".PDF")), F.lit("department"), F.col("lang"),
        F.lit("issue_date"), F.concat((1990 + n % 30).cast("string"), F.lit("-05-01")), F.lit("review_year"), F.when(n % 4 != 0, (2000 + n % 20).cast("string")),
    )
    docs = _t(spark, d, "documents").withColumn("metadata", F.map_filter(meta, lambda k, v: v.isNotNull()))
    return chunking.fixed_size(docs, SIZE, OVERLAP, keep=("metadata",)).select("chunk_id", "text", "metadata")


def _filtered_questions(spark, d):
    """Benchmark items, each with the filter that its number says, and every fifth with none."""
    n = F.col("qid")
    one = lambda *kv: F.create_map(*(x if isinstance(x, Column) else F.lit(x) for x in kv))
    year = lambda x: x.cast("string")
    wanted = (
        F.when(n % 5 == 1, one("department", "EN ", "year_gt", year(2005 + n % 7)))
        .when(n % 5 == 2, one("issue_year", year(1990 + n % 30), "document", "Src"))
        .when(n % 5 == 3, one("document", "src1", "review_year", year(2000 + n % 20)))
        .when(n % 5 == 4, one("version", "2", "department", "en"))
    )
    return _questions(spark, d).withColumn("wanted", F.when(n % 10 == 0, F.create_map().cast("map<string,string>")).otherwise(wanted))


_META = """
meta as (select chunk_id, ' ' || source || '.PDF' as document, lang, 1990 + doc_id % 30 as issued, case when doc_id % 4 <> 0 then 2000 + doc_id % 20 end as reviewed from chunks join documents using (doc_id))"""
_STORE_OK = """(q.qid % 5 = 0 or (q.qid % 5 = 1 and contains(lower(m.lang), 'en') and greatest(m.issued, coalesce(m.reviewed, 0)) > 2005 + q.qid % 7)
  or (q.qid % 5 = 2 and m.issued = 1990 + q.qid % 30 and contains(lower(m.document), 'src')) or (q.qid % 5 = 3 and contains(lower(m.document), 'src1') and m.reviewed = 2000 + q.qid % 20))"""
_KEYWORD_OK = """(q.qid % 5 = 0 or (q.qid % 5 = 1 and false) or (q.qid % 5 = 3 and m.lang in ('en', 'fr') and m.reviewed = 2000 + q.qid % 20) or (q.qid % 5 = 4 and m.lang = 'en' and m.reviewed > 2010))"""


@query(
    f"with {S.chunks(SIZE, OVERLAP)}, {S.ONE}, {S.semantic(10)}, {_META}, ok as (select a.qid, a.chunk_id, a.score, row_number() over (partition by a.qid order by a.score desc, a.chunk_id) as rank "
    f"from sem_all a join meta m using (chunk_id) join questions q on q.qid = a.qid where {_STORE_OK}) {_HITS} ok where rank <= 10"
)
def semantic_by_own_filter(spark, d):
    """Vector search of questions that each have a filter of their own, applied before the ten best are taken."""
    e, asked = embed.HashingEmbedder(), _filtered_questions(spark, d)
    of = e.embed(asked, ["qid"], "text").join(asked.select("qid", "wanted"), "qid").withColumnRenamed("qid", "query")
    return _hits(filtering.topk_texts(of, _filtered_chunks(spark, d), 10, e).withColumnRenamed("query", "qid"))


@query(
    f"with {S.chunks(SIZE, OVERLAP)}, {S.ONE}, {S.bm25(10)}, {_META}, ok as (select a.qid, a.chunk_id, a.score, row_number() over (partition by a.qid order by a.score desc, a.chunk_id) as rank "
    f"from scored a join meta m using (chunk_id) join questions q on q.qid = a.qid where {_KEYWORD_OK}) {_HITS} ok where rank <= 10"
)
def keyword_by_own_filter(spark, d):
    """BM25 of questions that each have a filter of their own: equal values, one of a list, years."""
    n = F.col("qid")
    one = lambda *kv: F.create_map(*(x if isinstance(x, Column) else F.lit(x) for x in kv))
    wanted = (
        F.when(n % 5 == 1, one("department", "EN"))
        .when(n % 5 == 2, one("issue_year", "2001"))  # of the index's own years only, which no chunk has
        .when(n % 5 == 3, one("department", '["en", "fr"]', "review_year", (2000 + n % 20).cast("string")))
        .when(n % 5 == 4, one("department", "en", "year_gt", "2010"))
    )
    return _hits(filtering.bm25(_questions(spark, d).withColumn("wanted", wanted), written(_filtered_chunks(spark, d), "chunks-metadata"), 10))


@query(
    f"{_FUSION}, {S.RRF}, {S.ORDERED}, {_META}, good as (select o.*, row_number() over (partition by o.qid, o.query_idx order by o.rank) as r2 from ordered o join meta m using (chunk_id) join questions q on q.qid = o.qid "
    f"where {_STORE_OK}) select qid, chunk_id, score, semantic_rank::int as semantic_rank, keyword_rank::int as keyword_rank, r2::int as rank from good where r2 <= {TOP_K}"
)
def hybrid_by_own_filter(spark, d):
    """Fused hits, each question's held against its own filter before the cut."""
    return _fused(filtering.hybrid(_semantic(spark, d), _keyword(spark, d), _filtered_questions(spark, d), _filtered_chunks(spark, d), TOP_K))


_MANY = f"with {S.chunks(SIZE, OVERLAP)}, {S.MANY}, {S.bm25(DEPTH)}, {S.MERGED}"


def _many_hits(spark, d):
    return retrieval.bm25(_wordings(spark, d), _chunks(spark, d), DEPTH)


def _listed(c, kind="string"):
    return F.array_join(F.transform(c, lambda x: x.cast(kind)), ",")


@query(
    f"{_MANY} select qid, chunk_id, score, best_query::int as best_query, array_to_string(list_distinct(qs).list_sort(), ',') as queries, len(ss)::int as n_scores, rank::int as rank from merged"
)
def multi_query_merge(spark, d):
    rows = retrieval.merge(_many_hits(spark, d))
    return rows.select("qid", "chunk_id", "score", F.col("best_query").cast("int").alias("best_query"), _listed("queries").alias("queries"), F.size("scores").alias("n_scores"), F.col("rank").cast("int").alias("rank"))


@query(
    f"{_MANY}, sub as (select m.*, len(list_filter(qs, lambda x: x > 0)) as n_sub from merged m) select qid, chunk_id, score, len(ss)::int + 1 as n_scores, n_sub::int as n_sub, rank::int as rank from sub"
)
def decomposed_merge(spark, d):
    """The sentences are the sub-questions; their hits and the question's are merged as lists are."""
    rows = retrieval.merge(_many_hits(spark, d), listed=True)
    return rows.select("qid", "chunk_id", "score", F.size("scores").alias("n_scores"), F.size(F.filter("queries", lambda x: x > 0)).alias("n_sub"), F.col("rank").cast("int").alias("rank"))


_TAGGED = f"""{_MANY}, placed as (select *, case when query_idx = 0 then 1073741824 else query_idx end as place from hits),
tag_all as (select qid, chunk_id, max(score) as score, arg_max(query_idx, (score, -place, -rank)) as best_query, list(query_idx order by place, rank) as qs, count(*) + 1 as n_scores,
  min((place, rank)) as first, arg_min(query_idx, (place, rank)) as first_query from placed group by 1, 2),
tagged as (select *, row_number() over (partition by qid order by score desc, first, chunk_id) as rank from tag_all)"""


@query(
    f"{_TAGGED} select qid, chunk_id, score, best_query::int as best_query, nullif(first_query, 0)::int as sub_index, array_to_string(list_distinct(qs).list_sort(), ',') as queries, n_scores::int as n_scores, rank::int as rank from tagged where rank <= 20"
)
def decomposed_tags(spark, d):
    """Hits of sub-questions and of the question, merged; each keeps the first sub-question that found it."""
    rows = retrieval.merge_decomposed(_many_hits(spark, d))
    n = lambda c: F.col(c).cast("int").alias(c)
    return rows.select("qid", "chunk_id", "score", n("best_query"), n("sub_index"), _listed(F.sort_array("queries")).alias("queries"), F.size("scores").alias("n_scores"), n("rank"))


@query(
    f"{_MANY} select h.qid, h.query_idx::int as query_idx, count(*) as result_count, string_agg(case when h.rank <= 5 then h.chunk_id end, ',' order by h.rank) as top_chunks, "
    "sum(case when h.rank <= 5 then length(substr(c.text, 1, 500)) end)::bigint as preview_chars from hits h join chunks c using (chunk_id) group by 1, 2"
)
def query_stats(spark, d):
    rows = retrieval.query_stats(_many_hits(spark, d), _chunks(spark, d))
    chars = F.aggregate(F.transform("previews", F.length), F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("qid", F.col("query_idx").cast("int").alias("query_idx"), "result_count", F.array_join("top_chunks", ",").alias("top_chunks"), chars.alias("preview_chars"))


# --- rerank, confidence, correction, compression ------------------------------------------


def _candidates(spark, d):
    asked = _wordings(spark, d).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("query_idx", "text"))).alias("w"))
    hits = written(retrieval.merge(_many_hits(spark, d)).filter(F.col("rank") <= rerank.CANDIDATES), "merged")
    rows = retrieval.met(_chunks(spark, d).select("chunk_id", "text"), hits).join(asked, "qid")
    found = F.transform("queries", lambda i: F.filter("w", lambda x: x["query_idx"] == i)[0]["text"])
    return rows.withColumns(
        {"variants": rerank.variants(F.col("w")[0]["text"], found), "n_found": F.size("queries"), "chunk_type": F.lit("text")}
    )


_FEAT = f"{_MANY}, {S.features()}"
_FEATURES = "qid, chunk_id, pair, lexical, formula_bonus, keyword_bonus, phrase_bonus, multi_bonus, retrieval, new_score"


@query(f"{_FEAT} select {_FEATURES}, md5(best_query) as best_query from scored2")
def rerank_features(spark, d):
    rows = rerank.features(_candidates(spark, d))
    return rows.select(*_FEATURES.split(", "), F.md5(F.col("best_query").cast("binary")).alias("best_query"))


@query(f"{_FEAT} select qid, chunk_id, new_score, new_rank::int as new_rank from reranked")
def rerank_topk(spark, d):
    return rerank.rerank(_candidates(spark, d), TOP_K).select("qid", "chunk_id", "new_score", F.col("new_rank").cast("int").alias("new_rank"))


_CONF = f"""{_FEAT},
f as (select qid, count(*) as n, max(case when new_rank = 1 then pair end) as top, max(case when new_rank = 2 then pair end) as second, avg(case when new_rank <= 3 then pair end) as av,
  sum(({S.any_of('text', X.EVIDENCE_TERMS)})::int) as forms from reranked group by 1),
g as (select qid, n, top, av, forms, case when second is null then top else greatest(0.0, top - second) end as margin from f),
h as (select *, round(greatest(0.0, least(1.0, 0.55 * top + 0.35 * av + 0.1 * least(1.0, margin * 5))), 9) as raw from g)"""


@query(
    f"{_CONF} select i.item_id as qid, coalesce(round_even(raw, 3), 0.0) as confidence, case when raw >= 0.8 then 'Very High' when raw >= 0.65 then 'High' when raw >= 0.45 then 'Medium' when raw >= 0.25 then 'Low' else 'Very Low' end as label, "
    "coalesce(round_even(top, 3), 0.0) as top_score, coalesce(round_even(av, 3), 0.0) as average_top_score, coalesce(round_even(margin, 3), 0.0) as margin, coalesce(round_even(least(1.0, forms / 2), 3), 0.0) as formula_evidence, least(5, coalesce(n, 0))::int as evidence_count "
    "from benchmark i left join h on h.qid = i.item_id"
)
def confidence(spark, d):
    rows = rerank.confidence(_questions(spark, d), rerank.rerank(_candidates(spark, d), TOP_K))
    return rows.select("qid", "confidence", "label", "top_score", "average_top_score", "margin", "formula_evidence", "evidence_count")


@query(
    f"{_FEAT}, m as (select qid, round(avg(pair), 9) as mean from reranked group by 1) select i.item_id as qid, case when coalesce(mean, 0) < 0.4 then 'not_relevant' when mean < 0.55 then 'uncertain' else 'relevant' end as decision, "
    "case when coalesce(mean, 0) < 0.55 then 'rewrite' else 'keep' end as action, coalesce(round_even(mean, 3), 0.0) as score from benchmark i left join m on m.qid = i.item_id"
)
def corrective_check(spark, d):
    rows = rerank.corrective_check(_questions(spark, d), rerank.rerank(_candidates(spark, d), TOP_K))
    return rows.select("qid", "decision", "action", "score")


def _five(spark, d):
    chunks = _chunks(spark, d)
    hits = retrieval.bm25(_questions(spark, d), chunks, TOP_K).drop("query_idx")
    rows = hits.join(chunks.select("chunk_id", "doc_id", "text"), "chunk_id")
    return rows.withColumns(
        {
            "chunk_type": F.lit("text"),
            "source": F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".txt")),
            "page": F.lit(None).cast("int"),
            "section": F.lit(None).cast("string"),
        }
    )


_ONE = f"with {S.chunks(SIZE, OVERLAP)}, {S.ONE}, {S.bm25(TOP_K)}"
_COMPRESSED = f"""{_ONE},
hc as (select h.qid, h.chunk_id, c.text, q.text as question from hits h join chunks c using (chunk_id) join questions q on q.qid = h.qid),
parts as (select qid, chunk_id, text, question, unnest(list_filter(list_transform(string_split(regexp_replace(text, '([.!?؟])\\s+|\\n', '\\1' || chr(1), 'g'), chr(1)), lambda s: {S.strip('s')}), lambda s: s <> '')) as s,
  generate_subscripts(list_filter(list_transform(string_split(regexp_replace(text, '([.!?؟])\\s+|\\n', '\\1' || chr(1), 'g'), chr(1)), lambda s: {S.strip('s')}), lambda s: s <> ''), 1) as i from hc),
mark as (select *, len(list_intersect({S.words('s')}, {S.words('question')})) > 0 as hit from parts),
near as (select *, hit or coalesce(lag(hit) over w, false) or coalesce(lead(hit) over w, false) as keep from mark window w as (partition by qid, chunk_id order by i)),
short as (select qid, chunk_id, string_agg(s, ' ' order by i) as short from near where keep group by 1, 2),
comp as (select hc.qid, hc.chunk_id, hc.text, coalesce(short, hc.text) as compressed from hc left join short using (qid, chunk_id))"""


def _compressed(spark, d):
    asked = _questions(spark, d).select("qid", F.array("text").alias("queries"))
    return rerank.compress(_five(spark, d).join(asked, "qid"))


@query(f"{_COMPRESSED} select qid, chunk_id, compressed from comp")
def compress_context(spark, d):
    return _compressed(spark, d).select("qid", "chunk_id", "compressed")


@query(f"{_COMPRESSED} select qid, sum(length(text))::bigint as chars_before, sum(length(compressed))::bigint as chars_after, sum(length(text) - length(compressed))::bigint as chars_removed from comp group by 1")
def compression_stats(spark, d):
    return rerank.compression_stats(_compressed(spark, d))


# --- context and answers ------------------------------------------------------------------

_BUDGET = 3000


def _contexts(spark, d, budget=_BUDGET):
    q = _questions(spark, d)
    return q.select("qid", F.col("text").alias("question")).join(context.build(q, _five(spark, d), budget), "qid")


_CTX = f"{_ONE}, {S.blocks(_BUDGET)}, asked_q as (select item_id as qid, text as question, coalesce(context, '') as context, coalesce(n_sources, 0) as n_sources from benchmark left join ctx on ctx.qid = item_id)"
_PROMPTED = f"{_CTX}, prompted as (select *, {S.prompt('question', 'context')} as prompt from asked_q)"


@query(f"{_CTX} select qid, index::int as index, chunk_id, block from taken")
def context_blocks(spark, d):
    return context.blocks(_five(spark, d), _BUDGET).select("qid", F.col("index").cast("int").alias("index"), "chunk_id", "block")


@query(f"{_PROMPTED} select qid, 1 as n_messages, md5(prompt) as prompt_md5, length(prompt)::bigint as prompt_chars, n_sources::int as n_sources from prompted")
def prompt_messages(spark, d):
    rows = context.messages(_contexts(spark, d))
    last = F.element_at("messages", -1)["content"]
    n = F.when(F.col("sources").isNull(), 0).otherwise(F.size("sources"))
    return rows.select("qid", F.size("messages").alias("n_messages"), F.md5(last.cast("binary")).alias("prompt_md5"), F.length(last).cast("long").alias("prompt_chars"), n.alias("n_sources"))


@query(
    f"{_PROMPTED}, e as (select *, {S.strip('context')} as c from prompted) select qid, question, case when c <> '' then {S.q(X.MOCK_PREFIX)} || substr(c, 1, 500) else {S.q(X.NOT_FOUND)} end || {S.q(X.MOCK_SUFFIX)} as answer, (length(prompt) // 4)::bigint as input_tokens from e"
)
def mock_answer(spark, d):
    """Questions to answers: chunks, BM25, context, prompt, the stand-in model."""
    rows = _contexts(spark, d).withColumn("prompt", context.prompt(F.col("question"), F.col("context")))
    rows = hooks.MockLLM().generate(rows, "", "prompt", "answer")
    used, _ = hooks.mock_usage(F.col("prompt"), F.col("answer"))
    return rows.select("qid", "question", "answer", used.alias("input_tokens"))


# --- routes -------------------------------------------------------------------------------


def _asked(spark, d):
    users = _t(spark, d, "conversations").filter("role = 'user'").select(F.concat_ws(":", "conv_id", "turn").alias("qid"), F.coalesce("text", F.lit("")).alias("question"))
    items = _t(spark, d, "benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("qid"), F.col("text").alias("question"))
    return users.union(items)


_ASKED = "with asked as (select conv_id || ':' || turn as qid, coalesce(text, '') as question from conversations where role = 'user' union all select 'b' || item_id, text from benchmark)"


@query(
    f"{_ASKED}, n as (select qid, regexp_replace({S.strip('question')}, '\\s+', ' ', 'g') as x from asked), r as (select qid, {S.route_case('x')} as r from n) "
    "select qid, string_split(r, '|')[1] as route, string_split(r, '|')[2] as techniques from r"
)
def route_rules(spark, d):
    rows = _asked(spark, d).withColumn("r", routing.by_rules(F.col("question")))
    return rows.select("qid", "r.route", F.array_join("r.techniques", ",").alias("techniques"))


@query(f"{_ASKED}, r as (select qid, {S.fallback_case('question')} as r from asked) select qid, string_split(r, '|')[1] as route, string_split(r, '|')[2] as techniques from r")
def route_fallback(spark, d):
    rows = _asked(spark, d).withColumn("r", routing.fallback(F.col("question")))
    return rows.select("qid", "r.route", F.array_join("r.techniques", ",").alias("techniques"))


@query("select event_id, case when event_type <> 'error' then (json_extract_string(props, '$.k'))::int end as issue_year, case when event_type in ('view', 'click') then event_type end as section, (case when event_type <> 'error' then 1 else 0 end + (event_type in ('view', 'click'))::int)::int as n from events")
def self_query_filters(spark, d):
    """Replies of a filter model made of events: a fence, an unknown field, a year that is no number."""
    year = F.when(F.col("event_type") == "error", F.lit('"soon"')).otherwise(F.get_json_object("props", "$.k"))
    section = F.when(F.col("event_type").isin("view", "click"), F.col("event_type")).otherwise("")
    reply = F.format_string('```json\n{"issue_year": %s, "section": " %s ", "other": 1, "version": null}\n```', year, section)
    rows = _t(spark, d, "events").select("event_id", routing.filters(reply).alias("f"))
    return rows.select("event_id", F.col("f")["issue_year"].cast("int").alias("issue_year"), F.col("f")["section"].alias("section"), F.size("f").alias("n"))


@query(
    "with h as (select conv_id, turn, role, text, string_agg(role || ':' || coalesce(text, ''), chr(10)) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding) as s, "
    "count(*) over (partition by conv_id order by turn) - 1 as n from conversations) select conv_id, turn, text as question, n::int as n_history, md5(coalesce(s, '')) as history_md5 from h where role = 'user'"
)
def chat_history(spark, d):
    rows = context.chat_history(_t(spark, d, "conversations"))
    text = F.array_join(F.transform("history", lambda m: F.concat(m["role"], F.lit(":"), F.coalesce(m["content"], F.lit("")))), "\n")
    return rows.select("conv_id", "turn", "question", F.size("history").alias("n_history"), F.md5(text.cast("binary")).alias("history_md5"))


@query(
    "with p as (select *, sum(length(coalesce(text, '')) + 1) over (partition by conv_id order by turn) - length(coalesce(text, '')) - 1 as start from conversations), "
    "h as (select a.conv_id, a.turn, string_agg(b.role || ':' || coalesce(b.text, ''), chr(10) order by b.turn) as s, count(*) as n from p a join p b on a.conv_id = b.conv_id and b.start < a.start and b.start >= a.start - 1000 where a.role = 'user' group by 1, 2) "
    "select a.conv_id, a.turn, coalesce(n, 0)::int as n_history, md5(coalesce(s, '')) as history_md5 from conversations a left join h using (conv_id, turn) where a.role = 'user'"
)
def recent_history(spark, d):
    """Each user turn with the whole turns before it that fit 1,000 characters."""
    rows = context.recent_history(_t(spark, d, "conversations"), 1000)
    text = F.array_join(F.transform("history", lambda m: F.concat(m["role"], F.lit(":"), F.coalesce(m["content"], F.lit("")))), "\n")
    return rows.select("conv_id", "turn", F.size("history").alias("n_history"), F.md5(text.cast("binary")).alias("history_md5"))


# --- evaluation and costs -----------------------------------------------------------------


def _pairs(spark, d):
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = _t(spark, d, "conversations").withColumns(
        {"question": F.lag("text").over(order), "asked_by": F.lag("role").over(order), "context": F.lag("text", 2).over(order)}
    )
    rows = rows.filter("role = 'assistant' and asked_by = 'user'")
    return rows.select("conv_id", "turn", "question", F.col("text").alias("answer"), F.coalesce("context", F.lit("")).alias("context"), F.lit("basic_rag").alias("route"), F.col("question").alias("reference"))


_QT = f"qt as (select *, {S.eval_tokens('question')} as qw, {S.eval_tokens('answer')} as aw, {S.eval_tokens('context')} as cw from qa)"
_FA = f"""sent as (select conv_id, turn, cw, unnest(string_split(regexp_replace(answer, '([.!?؟])\\s+', '\\1' || chr(1), 'g'), chr(1))) as s from qt where context <> ''),
sw as (select *, {S.eval_tokens('s')} as w from sent where regexp_matches(s, '[^\\s\\x{{A0}}]')),
fa as (select conv_id, turn, round_even(round(avg(case when contains(lower(s), '[source') and len(w) > 3 then {S.eval_share('w', 'cw', 0.45)} else {S.eval_share('w', 'cw', 0.55)} end), 9), 3) as f from sw group by 1, 2)"""
_QA = f"with {S.PAIRS}, {_QT}"
_FAITH = f"{_QA}, {_FA}"
_METRICS = ["context_relevance", "faithfulness", "answer_relevance"]


@query(
    f"{_FAITH} select conv_id, turn, case when context = '' then 0.0 else round_even({S.eval_share('qw', 'cw', 0.45)}, 3) end as context_relevance, "
    f"case when context = '' then 0.0 else coalesce(f, 0.0) end as faithfulness, round_even({S.eval_share('qw', 'aw', 0.35)}, 3) as answer_relevance from qt left join fa using (conv_id, turn)"
)
def eval_metrics(spark, d):
    return evaluation.evaluate(_pairs(spark, d), ["conv_id", "turn"]).select("conv_id", "turn", *_METRICS)


@query(
    f"{_QA} select conv_id, turn, case when question is null or question = '' then null when len(list_intersect(aw, qw)) > 0 then round_even(round(2 * len(list_intersect(aw, qw)) / (len(aw) + len(qw)), 9), 3) else 0.0 end as correctness from qt"
)
def eval_correctness_f1(spark, d):
    rows = _pairs(spark, d)
    return rows.select("conv_id", "turn", evaluation.f1(F.col("answer"), F.col("reference")).alias("correctness"))


_MODELS = ("qwen3-max", "models/gemini-3.5-flash-lite-001", "qwen-plus", "gemini-2.5-flash-lite", "another")
_STEPS = ("router", "final_generation", " rewriter ", "evaluation_judge")


def _calls(spark, d):
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (n % len(names) + 1).cast("int"))
    quarter = lambda c: F.floor(F.length(F.coalesce(c, F.lit(""))) / 4).cast("long")
    return _pairs(spark, d).select(
        "conv_id", "turn", pick(_MODELS, F.col("conv_id")).alias("model"), quarter("question").alias("input_tokens"), quarter("answer").alias("output_tokens"), pick(_STEPS, F.col("turn")).alias("step")
    )


_LIST = lambda names: "[" + ", ".join(map(S.q, names)) + "]"
_SIM = sorted(X.SIMULATED_PRICES.items(), key=lambda p: -len(p[0]))
_ACT = list(X.ACTUAL_PRICES.items())
_COST = f"""with {S.PAIRS},
calls as (select conv_id, turn, {_LIST(_MODELS)}[conv_id % 5 + 1] as model, (length(coalesce(question, '')) // 4)::bigint as input_tokens, (length(coalesce(answer, '')) // 4)::bigint as output_tokens, {_LIST(_STEPS)}[turn % 4 + 1] as step from qa),
priced as (select *, case trim(step) when 'router' then 'routing' when 'rewriter' then 'rewriting' else trim(step) end as technique,
  round_even(input_tokens / 1000000 * {S.price_case('model', _SIM, X.SIMULATED_DEFAULT, 0)} + output_tokens / 1000000 * {S.price_case('model', _SIM, X.SIMULATED_DEFAULT, 1)}, 10) as cost,
  round_even(input_tokens / 1000000 * {S.price_case('model', _ACT, X.ACTUAL_DEFAULT, 0)} + output_tokens / 1000000 * {S.price_case('model', _ACT, X.ACTUAL_DEFAULT, 1)}, 10) as actual_cost from calls)"""


@query(f"{_COST} select conv_id, turn, model, technique, input_tokens, output_tokens, round_even(cost, 8) as cost, round_even(actual_cost, 8) as actual_cost from priced")
def cost_report(spark, d):
    rows = evaluation.costs(_calls(spark, d))
    return rows.select("conv_id", "turn", "model", "technique", "input_tokens", "output_tokens", F.bround("cost", 8).alias("cost"), F.bround("actual_cost", 8).alias("actual_cost"))


@query(
    f"{_COST} select coalesce(technique, '(all)') as technique, count(*) as n_calls, sum(input_tokens)::bigint as input_tokens, sum(output_tokens)::bigint as output_tokens, round_even(sum(cost::decimal(28,10))::double, 6) as cost from priced group by rollup (technique)"
)
def cost_by_technique(spark, d):
    rows = evaluation.by_technique(evaluation.costs(_calls(spark, d)))
    return rows.withColumns({"technique": F.coalesce("technique", F.lit("(all)")), "cost": F.bround("cost", 6)})


# Two runs over all benchmark items: on the five BM25 hits as they are, and on the same hits compressed.
_REPORTED = "qwen3-max"
_AS_FOUND, _SHORT = "as_found", "compressed"
_RUNS = f"""{_COMPRESSED}, {S.blocks(_BUDGET, mark='w_')},
{S.blocks(_BUDGET, "select h.qid, h.rank, h.chunk_id, h.score, k.compressed as text, 'doc' || c.doc_id || '.txt' as source from hits h join comp k using (qid, chunk_id) join chunks c using (chunk_id)", 's_')},
both_runs as (select item_id as qid, text as question, '{_AS_FOUND}' as pipeline, coalesce(context, '') as context, coalesce(n_sources, 0) as n_sources from benchmark left join w_ctx on qid = item_id
  union all select item_id, text, '{_SHORT}', coalesce(context, ''), coalesce(n_sources, 0) from benchmark left join s_ctx on qid = item_id),
prompts as (select *, {S.prompt('question', 'context')} as prompt, {S.strip('context')} as inner_text, regexp_replace({S.strip('question')}, '\\s+', ' ', 'g') as flat from both_runs),
spoken as (select *, case when inner_text <> '' then {S.q(X.MOCK_PREFIX)} || substr(inner_text, 1, 500) else {S.q(X.NOT_FOUND)} end as said, coalesce({S.route_case('flat')}, {S.fallback_case('question')}) as decision from prompts),
qa as (select qid as conv_id, pipeline as turn, question, said || {S.q(X.MOCK_SUFFIX)} as answer, context, n_sources, decision, length(prompt) // 4 as input_tokens, length(said) // 4 as output_tokens from spoken),
{_QT}, {_FA},
measured as (select turn as pipeline, conv_id as qid, string_split(decision, '|')[1] as route, string_split(decision, '|')[2] as techniques,
  case when context = '' then 0.0 else round_even({S.eval_share('qw', 'cw', 0.45)}, 3) end as context_relevance, case when context = '' then 0.0 else coalesce(f, 0.0) end as faithfulness,
  round_even({S.eval_share('qw', 'aw', 0.35)}, 3) as answer_relevance, n_sources, 1 as n_calls, input_tokens, output_tokens,
  round_even(input_tokens / 1000000 * {X.SIMULATED_PRICES[_REPORTED][0]} + output_tokens / 1000000 * {X.SIMULATED_PRICES[_REPORTED][1]}, 10) as cost
  from qt left join fa using (conv_id, turn))"""


def _runs(spark, d):
    """The two runs, measured."""
    asked = _questions(spark, d).select("qid", "text")
    route = routing.route(F.col("text"))
    found = written(_five(spark, d), "found")
    short = rerank.compress(found.join(asked.select("qid", F.array("text").alias("queries")), "qid")).withColumn("text", F.col("compressed")).drop("compressed", "queries")
    for name, hits in ((_AS_FOUND, found), (_SHORT, short)):
        rows = asked.join(context.build(asked, hits, _BUDGET), "qid").withColumns({"route": route["route"], "techniques": route["techniques"]})
        rows = rows.withColumn("prompt", context.prompt(F.col("text"), F.col("context")))
        yield report.measured(hooks.MockLLM().generate(rows, "", "prompt", "answer"), name, _REPORTED)


_SPENT = ["n_sources", "n_calls", "input_tokens", "output_tokens"]


@query(f"{_RUNS} select pipeline, qid, route, techniques, {', '.join([*_METRICS, *_SPENT])}, round_even(cost, 8) as cost from measured")
def measured_runs(spark, d):
    """Each question of both runs with its metrics, tokens and cost."""
    one, two = _runs(spark, d)
    rows = one.unionByName(two).withColumns({"techniques": F.array_join("techniques", ","), "cost": F.bround("cost", 8)})
    return rows.select("pipeline", "qid", "route", "techniques", *_METRICS, *_SPENT, "cost")


_LONG = " union all ".join(f"select pipeline, route, techniques, '{m}' as metric, {m}::decimal(28,10) as v from measured" for m in [*_METRICS, *_SPENT, "cost"])


@query(
    f"{_RUNS}, long as ({_LONG}), listed as (select *, case when techniques = '' then ['{report.NO_TECHNIQUE}'] else string_split(techniques, ',') end as ts from long), "
    "each as (select pipeline, route, metric, v, unnest(ts) as technique, generate_subscripts(ts, 1) = 1 as once from listed), "
    "sets as (select pipeline, route, technique, metric, grouping(technique) = 0 as told, grouping(pipeline) as g, grouping(route) as gr, count(*) as a, count(*) filter (where once) as b, "
    "sum(v) as sa, sum(v) filter (where once) as sb, min(v)::double as least, max(v)::double as most from each group by grouping sets ((metric), (pipeline, metric), (pipeline, route, metric), (pipeline, technique, metric))) "
    "select case when told then 'technique' when gr = 0 then 'route' when g = 0 then 'pipeline' else 'all' end as level, pipeline, route, technique, metric, case when told then a else b end as n_questions, "
    "round_even(case when told then sa else sb end::double, 6) as total, round_even(round(case when told then sa::double / a else sb::double / b end, 9), 6) as mean, round_even(least, 8) as least, round_even(most, 8) as most from sets"
)
def run_report(spark, d):
    """Totals and means of both runs: over all, by pipeline, by route, by technique."""
    one, two = _runs(spark, d)
    rows = report.by_levels(one.unionByName(two)).filter(F.col("metric").isin(*_METRICS, *_SPENT, "cost"))
    return rows.select("level", "pipeline", "route", "technique", "metric", "n_questions", "total", "mean", F.bround("least", 8).alias("least"), F.bround("most", 8).alias("most"))


@query(
    f"{_RUNS} select a.qid, " + ", ".join(f"a.{m} as advanced_{m}, b.{m} as basic_{m}, round_even(a.{m} - b.{m}, 3) as delta_{m}" for m in _METRICS)
    + f", round_even(a.cost, 8) as advanced_cost, round_even(b.cost, 8) as basic_cost, round_even(a.cost - b.cost, 8) as delta_cost from measured a join measured b on a.qid = b.qid and a.pipeline = '{_SHORT}' and b.pipeline = '{_AS_FOUND}'"
)
def basic_vs_advanced(spark, d):
    """Both runs side by side."""
    basic, advanced = _runs(spark, d)
    rows = report.side_by_side(advanced, basic).withColumns({f"{x}_cost": F.bround(f"{x}_cost", 8) for x in ("advanced", "basic", "delta")})
    return rows.drop("advanced_correctness", "basic_correctness", "delta_correctness")


# --- more of the scalar functions, and whole pipelines ------------------------------------


@query(f"select doc_id, array_to_string(regexp_extract_all(text, {S.q(X.YEAR)}, 1), ',') as years from documents")
def year_mentions(spark, d):
    rows = _t(spark, d, "documents").select("doc_id", T.years(F.col("text")).alias("y"))
    return rows.select("doc_id", _listed("y").alias("years"))


@query(
    f"with s as (select doc_id, list_sort({S.eval_tokens('text')}) as w from documents) select doc_id, len(w)::int as n_tokens, md5(array_to_string(w, ' ')) as tokens_md5 from s"
)
def evaluation_token_sets(spark, d):
    rows = _t(spark, d, "documents").select("doc_id", F.sort_array(T.evaluation_tokens(F.col("text"))).alias("w"))
    return rows.select("doc_id", F.size("w").alias("n_tokens"), F.md5(F.array_join("w", " ").cast("binary")).alias("tokens_md5"))


_IS_HEADING = (
    f"(l <> '' and length(l) <= 180 and (regexp_matches(l, {S.q(X.PAGE_PROCEDURE)}) or regexp_matches(l, {S.q(X.PAGE_NUMBERED)}) or regexp_matches(l, {S.q(X.PAGE_SECTION)}) "
    f"or (len(regexp_extract_all(l, '[{X.ARABIC}]')) >= 3 and length(l) <= 90 and not regexp_matches(l, '[؛:,.،!?؟]') and not regexp_matches(l, '\\p{{Nd}}{{2,}}') and {S.any_of('l', X.PAGE_HEADING_WORDS)})))"
)


@query(
    f"""with ln as (select doc_id, unnest(string_split(text, chr(10))) as raw, generate_subscripts(string_split(text, chr(10)), 1) as i from documents),
num as (select doc_id, i, case when i % 6 = 1 then i || '. ' || {S.strip('raw')} else {S.strip('raw')} end as l from ln),
k as (select doc_id, i, l, case when l = '' then 'blank' when {_IS_HEADING} then 'heading' else 'paragraph' end as kind from num),
n as (select *, (kind = 'heading' or kind is distinct from lag(kind) over (partition by doc_id order by i))::int as new from k),
g as (select *, sum(new) over (partition by doc_id order by i) as island from n),
e as (select doc_id, island, kind, string_agg(l, chr(10) order by i) as text from g where kind <> 'blank' group by 1, 2, 3)
select doc_id, row_number() over (partition by doc_id order by island) - 1 as pos, kind as type, text from e"""
)
def page_split(spark, d):
    """Documents as pages; every sixth line is numbered."""
    lines = F.transform(
        F.split("text", "\n"),
        lambda x, i: F.when(i % 6 == 0, F.concat((i + 1).cast("string"), F.lit(". "), T.strip(x))).otherwise(x),
    )
    pages = _t(spark, d, "documents").select("doc_id", F.lit(1).alias("page"), F.array_join(lines, "\n").alias("text"))
    return elements.page_elements(pages).select("doc_id", F.col("pos").cast("long").alias("pos"), "type", "text")


@query(
    f"{_ONE}, n as (select qid, chunk_id, case when max(score) over w = min(score) over w then 0.0 else (score - min(score) over w) / (max(score) over w - min(score) over w) end as norm from hits window w as (partition by qid, query_idx)) "
    "select qid, chunk_id, round_even(norm, 6) as norm from n"
)
def minmax_scores(spark, d):
    rows = retrieval.minmax(_keyword(spark, d, TOP_K))
    return rows.select("qid", "chunk_id", F.bround("norm", 6).alias("norm"))


def _generated(spark, d):
    parts = F.filter(F.transform(F.split("text", r"(?<=[.!?؟])\s+"), T.strip), lambda s: s != "")
    return _t(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text", F.slice(parts, 1, 3).alias("generated"))


def _sourced(spark, d):
    docs = _t(spark, d, "documents").withColumn("of", F.concat("source", F.lit("/"), F.col("doc_id").cast("string")))
    return chunking.fixed_size(docs, SIZE, OVERLAP, keep=("of",)).select("chunk_id", "text", F.col("of").alias("source"))


@query()
def advanced_answers(spark, d):
    """The whole conditional pipeline over all benchmark items."""
    rows = pipelines.answer(_generated(spark, d), written(_sourced(spark, d), "chunks-sourced"), TOP_K)
    return rows.select("qid", "route", _listed("techniques").alias("techniques"), "confidence", "label", "action", "answer")


@query()
def replied_answers(spark, d):
    """The same with models' replies made of the items: a router's, rewritten and several wordings, sub-questions, filters."""
    n = F.col("qid")
    parts = lambda key: F.concat(F.lit('{"'), F.lit(key), F.lit('": '), F.to_json("generated"), F.lit("}"))
    route = F.when(n % 4 == 0, '{"route": "simple"}').when(n % 4 == 1, '{"route": "basic_rag"}').when(n % 4 == 2, '{"route": "advanced_rag", "techniques": ["self_query", "multi_query"]}')
    route = route.otherwise('{"route": "advanced_rag", "techniques": ["decomposition", "crag", "rewriting"]}')
    filters = F.concat(F.lit('{"semantic_query": "", "filters": {"department": "EN", "year_gt": "'), (1990 + n % 30).cast("string"), F.lit('"}}'))
    replies = F.create_map(
        F.lit("router"), route, F.lit("decomposition"), parts("subquestions"), F.lit("multi_query"), parts("queries"),
        F.lit("rewriting"), F.concat(F.lit('{"query": '), F.to_json(F.struct(F.get("generated", 0).alias("q"))).substr(F.lit(6), F.lit(10_000)), F.lit("")), F.lit("self_query"), filters,
    )
    rows = pipelines.answer(_generated(spark, d).withColumn("replies", replies), written(_filtered_chunks(spark, d), "chunks-metadata"), TOP_K)
    return rows.select("qid", "route", _listed("techniques").alias("techniques"), "confidence", "label", "action", "answer")


_BASE_ROWS = "select h.qid, h.rank, h.chunk_id, h.score, c.text, c.doc_id::varchar as source from ordered h join chunks c using (chunk_id) where h.rank <= 5"
_BASE = f"with {S.chunks(SIZE, OVERLAP)}, {S.ONE}, {S.semantic(retrieval.fetch_depth(TOP_K))}, {S.bm25(retrieval.fetch_depth(TOP_K))}, {S.RRF}, {S.ORDERED}, {S.blocks(context.BUDGET, _BASE_ROWS)}"


@query(
    f"{_BASE}, e as (select item_id as qid, {S.strip("coalesce(context, '')")} as c, n_sources from benchmark left join ctx on qid = item_id) "
    f"select qid, n_sources::int as n_sources, case when c <> '' then {S.q(X.MOCK_PREFIX)} || substr(c, 1, 500) else {S.q(X.NOT_FOUND)} end || {S.q(X.MOCK_SUFFIX)} as answer from e"
)
def baseline_answers(spark, d):
    rows = pipelines.baseline(_t(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text"), written(_sourced(spark, d), "chunks-sourced"), TOP_K)
    return rows.select("qid", F.size("sources").alias("n_sources"), "answer")


@query()
def pipelines_compared(spark, d):
    """The conditional pipeline and the baseline over all benchmark items, measured alike."""
    asked, chunks = _generated(spark, d), written(_sourced(spark, d), "chunks-sourced")
    advanced = pipelines.answer(asked, chunks, TOP_K).select("qid", F.col("text").alias("question"), "answer", "context", "route")
    basic = pipelines.baseline(asked.select("qid", "text"), chunks, TOP_K)
    basic = basic.select("qid", F.col("text").alias("question"), "answer", "context", F.lit(routing.BASIC).alias("route"))
    measured = (evaluation.evaluate(x.withColumn("reference", F.lit(None).cast("string")), ["qid"]) for x in (advanced, basic))
    return evaluation.compare(*measured, ["qid"], _METRICS)


_CELL = lambda x: f"replace({x}, '|', '')"


@query(
    f"""with ln as (select doc_id, unnest(string_split(text, chr(10))) as raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 as i from documents),
k as (select doc_id, i, {S.strip(_CELL('raw'))} as l, i % 7 = 3 and i % 5 <> 0 as tab from ln),
e as (select doc_id, i, 0 as part, case when i % 5 = 0 then 'heading' else 'paragraph' end as type, l as text, case when i % 5 = 0 then 2 end as level, null as tbl from k where not tab and l <> ''
  union all select doc_id, i, 0, 'table', '', null, '| a | b |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || l || ' | c |' from k where tab),
s as (select *, type = 'paragraph' and not coalesce(lag(type) over o = 'paragraph' and lag(i) over o = i - 1, false) or type <> 'paragraph' as new from e window o as (partition by doc_id order by i)),
g as (select *, sum(new::int) over (partition by doc_id order by i) as island from s)
select doc_id, (island - 1)::bigint as pos, min(type) as type, string_agg(text, chr(10) order by i) as text, min(level)::int as level, min(tbl) as table from g group by doc_id, island"""
)
def markdown_lines(spark, d):
    """Documents as Markdown: every fifth line a heading, some a table whose first cell it is; bars are left out."""
    cell = lambda x: T.strip(F.translate(x, "|", ""))
    line = lambda x, i: F.when(
        i % 5 == 0, F.when(cell(x) != "", F.concat(F.lit("## "), cell(x))).otherwise("")
    ).when(i % 7 == 3, F.concat(F.lit("| a | b |\n|---|---|\n| "), cell(x), F.lit(" | c |"))).otherwise(cell(x))
    marked = F.array_join(F.transform(F.split("text", "\n"), line), "\n")
    out = elements.markdown_elements(_t(spark, d, "documents").select("doc_id", marked.alias("text")))
    return out.select("doc_id", F.col("pos").cast("long").alias("pos"), "type", "text", "level", "table")


@query(
    "with r as (select o_custkey, o_orderkey, '| ' || o_orderkey || ' | ' || o_orderstatus || ' | ' || o_orderpriority || ' |  |' as line from orders) "
    "select o_custkey, 1 as piece, '**Table: orders**' || chr(10) || chr(10) || '| order | status | priority |  |' || chr(10) || '| --- | --- | --- | --- |' || chr(10) || "
    "string_agg(line, chr(10) order by o_orderkey) as text from r group by 1"
)
def table_whole(spark, d):
    """Tables that fit are one piece, which is the table."""
    tables = _order_tables(spark, d).select("o_custkey", T.table_markdown(F.col("rows")).alias("md"))
    pieces = chunking.table_splitter(10_000_000)(F.col("md"), F.lit("orders"))
    return tables.select("o_custkey", F.posexplode(pieces).alias("piece", "text")).withColumn("piece", F.col("piece") + 1)


_REPLY = """with r as (select event_id, event_type as t, substr(event_type, 1, 1) as a, value from events)"""


def _replies(spark, d):
    """Replies of models made of events: fenced, with words around, with unknown names, or none at all."""
    kind = F.col("event_type")
    known = F.when(kind == "view", "advanced_rag").when(kind == "click", "simple").otherwise("maze")
    made = F.format_string('```json\n{"route": "%s", "reason": "%s", "techniques": ["hyde", "%s", "crag"], "query": " %s ", "queries": ["%s", " ", "x", "y", "z"]}\n```', known, kind, kind, kind, kind)
    return _t(spark, d, "events").select("event_id", "event_type", F.when(kind == "error", "no reply").otherwise(made).alias("reply"))


@query(
    f"{_REPLY} select event_id, case t when 'error' then null when 'view' then 'advanced_rag' when 'click' then 'simple' else 'basic_rag' end as route, "
    "case when t = 'error' then null else 'hyde,crag' end as techniques from r"
)
def route_replies(spark, d):
    rows = _replies(spark, d).select("event_id", routing.from_reply(F.col("reply")).alias("r"))
    return rows.select("event_id", "r.route", F.array_join("r.techniques", ",").alias("techniques"))


@query(f"{_REPLY} select event_id, case when t = 'error' then 'asked' else t end as rewritten, case when t = 'error' then '' else t || ',x,y' end as several from r")
def wording_replies(spark, d):
    reply = F.col("reply")
    return _replies(spark, d).select("event_id", routing.rewritten(reply, F.lit("asked")).alias("rewritten"), F.array_join(routing.several(reply), ",").alias("several"))


@query(
    f"{_FAITH}, ev as (select conv_id, turn, round_even(least(1.0, greatest(0.0, turn / 4.0 - 0.25)), 3) as j, case when context = '' then 0.0 else coalesce(f, 0.0) end as f, "
    "turn % 3 = 0 as judged from qt left join fa using (conv_id, turn)) select conv_id, turn, case when judged then j else f end as faithfulness from ev"
)
def eval_judged(spark, d):
    """A judge's values win where it gave any; every third turn has some, beyond 0 and 1 too."""
    value = (F.col("turn") / 4.0 - 0.25).cast("double")
    names = ("context_relevance", "faithfulness", "answer_relevance", "correctness")
    judge = F.when(F.col("turn") % 3 == 0, F.struct(*(value.alias(n) for n in names)))
    return evaluation.evaluate(_pairs(spark, d).withColumn("judge", judge), ["conv_id", "turn"], judge="judge").select("conv_id", "turn", "faithfulness")


@query(f"{_COST} select conv_id as qid, count(*) as n_calls, round_even(sum(actual_cost::decimal(28,10))::double, 8) as total_cost from priced group by 1")
def calls_of_question(spark, d):
    calls = evaluation.costs(_calls(spark, d)).withColumn("qid", F.col("conv_id"))
    return evaluation.latest_calls(calls).select("qid", "n_calls", "total_cost")


@query("select o_orderkey, case when o_orderkey % 2 = 0 then o_orderstatus else o_orderpriority end as department from orders")
def attribute_or_metadata(spark, d):
    """A chunk's own attribute, or else its metadata's."""
    rows = _metadata_orders(spark, d)
    own = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus"))
    return rows.select("o_orderkey", T.attribute(own, F.col("metadata"), "department").alias("department"))


@query("select event_id, (case when event_id % 3 = 0 and event_id > 0 then event_id else greatest(1, length(coalesce(props, '')) // 4) end)::bigint as used from events")
def usage_counts(spark, d):
    """Tokens as counted, else a quarter of the characters."""
    return _t(spark, d, "events").select("event_id", hooks.usage_fallback(F.when(F.col("event_id") % 3 == 0, F.col("event_id")), F.col("props")).alias("used"))


def _boxes(spark, d):
    size = F.col("l_quantity").cast("double")
    box = F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("top"), size.alias("x1"), (size / 2).alias("bottom"))
    return _t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(box).alias("boxes"))


@query("select l_orderkey, round_even(least(1.0, sum(l_quantity::double * (l_quantity::double / 2)) / 5000.0), 6) as ratio from lineitem group by 1")
def table_areas(spark, d):
    """Each order as a page of 100 by 50 whose lines are tables."""
    ratio = ocr.table_area_ratio(F.col("boxes"), F.lit(100.0), F.lit(50.0))
    return _boxes(spark, d).select("l_orderkey", F.bround(ratio, 6).alias("ratio"))


_GRID = """
c as (select l_orderkey, l_linenumber, (l_linenumber * 5) % 7 as cell_no, ((l_linenumber - 1) * 37) % 50 * 10.0 as x0, (l_linenumber - 1) // 3 * 3.0 + l_linenumber % 3 * 1.5 as top from lineitem),
o as (select *, row_number() over (partition by l_orderkey order by cell_no) as nth from c),
f as (select l_orderkey, list(top order by nth) as tops from o group by 1),
s as (select l_orderkey, list_reduce(list_prepend(array[]::double[], list_transform(tops, lambda t: [t])), lambda a, b: case when len(list_filter(a, lambda t: abs(t - b[1]) <= 4)) > 0 then a else a || b end) as firsts from f),
m as (select o.*, list_position(list_transform(firsts, lambda t: abs(t - top) <= 4), true) as made from o join s using (l_orderkey)),
n as (select *, min(top) over (partition by l_orderkey, made) as least from m)"""


@query(
    f"with {_GRID} select l_orderkey, l_linenumber::bigint as n, (dense_rank() over (partition by l_orderkey order by least, made) - 1)::bigint as row, "
    "(row_number() over (partition by l_orderkey, made order by x0, nth) - 1)::bigint as col from n"
)
def cell_grid(spark, d):
    """Lines of an order as cells in a mixed order, whose tops are so near each other that the order decides about rows."""
    n = F.col("l_linenumber").cast("long")
    top = F.floor((n - 1) / 3) * 3.0 + n % 3 * 1.5
    cells = _t(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.lit(1).alias("table_no"), (n * 5 % 7).alias("cell_no"),
        ((n - 1) * 37 % 50 * 10.0).alias("x0"), top.alias("top"), n.cast("string").alias("text"),
    )
    out = ocr.cell_rows(cells)
    return out.select(F.col("doc_id").alias("l_orderkey"), F.col("text").cast("long").alias("n"), "row", "col")


def _page_tables(spark, d):
    """Events as tokens on pages by user; lines of the order of that number as tables, of four cells each."""
    e = F.col("event_id")
    tokens = _ocr_tokens(spark, d).drop("doc_id").withColumn("doc_id", F.lit(0))
    place = {"x0": F.col("word_num") % 97 * 10.0, "top": F.floor(F.col("word_num") / 97) % 61 * 10.0}
    tokens = tokens.withColumns(place).withColumns({"x1": F.col("x0") + 8.0, "bottom": F.col("top") + 6.0})
    n, q = F.col("l_linenumber"), F.col("l_quantity").cast("double")
    lines = _t(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.max("l_quantity").alias("l_quantity"))
    lines = lines.select(F.lit(0).alias("doc_id"), F.col("l_orderkey").alias("page"), n.alias("table_no"), (n * 110.0).alias("x0"), (F.col("l_partkey") % 40 * 10.0).alias("top"), (q * 6 + 40).alias("w"))
    boxes = lines.select("doc_id", "page", "table_no", "x0", "top", (F.col("x0") + F.col("w")).alias("x1"), (F.col("top") + F.col("w")).alias("bottom"), F.concat(F.lit("line "), F.col("table_no").cast("string")).alias("caption"))
    i = F.col("cell_no")
    half = F.col("w") / 2
    cells = lines.withColumn("cell_no", F.explode(F.array(*map(F.lit, (2, 0, 3, 1)))))
    cells = cells.withColumns({"x0": F.col("x0") + i % 2 * half, "top": F.col("top") + F.floor(i / 2) * half})
    cells = cells.select("doc_id", "page", "table_no", "cell_no", "x0", "top", (F.col("x0") + half).alias("x1"), (F.col("top") + half).alias("bottom"))
    return tokens, boxes, cells


_LAYOUT = f"""{_OCR},
pt as (select *, word % 97 * 10.0::double + 4 as x, (word // 97) % 61 * 10.0::double + 3 as y from tok),
box as (select l_orderkey as page, l_linenumber as table_no, l_linenumber * 110.0::double as x0, min(l_partkey) % 40 * 10.0::double as top, max(l_quantity)::double * 6 + 40 as w from lineitem group by 1, 2),
inside as (select pt.page, word, min(table_no) as table_no from pt join box on pt.page = box.page and x between x0 and x0 + w and y between top and top + w group by 1, 2)"""


@query(f"with {_LAYOUT} select pt.page, pt.word as event_id, table_no from pt left join inside using (page, word)")
def table_tokens(spark, d):
    """The table, if any, in which each token of a page lies."""
    tokens, boxes, _ = _page_tables(spark, d)
    return layout.held(tokens, boxes, list(ocr.PAGE), "table_no").select("page", F.col("word_num").alias("event_id"), "table_no")


@query(
    f"""with {_LAYOUT},
cell as (select page, table_no, i as cell_no, x0 + i % 2 * (w / 2) as x0, top + i // 2 * (w / 2) as top, w / 2 as h from box, range(4) t(i)),
fit as (select pt.*, inside.table_no from pt join inside using (page, word) where not (conf < 20 and length(t) <= 4)),
cw as (select fit.page, fit.table_no, word, block, line, t, min(cell_no) as cell_no from fit join cell c on c.page = fit.page and c.table_no = fit.table_no and x between c.x0 and c.x0 + c.h and y between c.top and c.top + c.h group by all),
ln as (select page, table_no, cell_no, block, line, string_agg(t, ' ' order by word) as s from cw group by all),
dd as (select *, lag(s) over (partition by page, table_no, cell_no order by block, line) as p from ln),
ct as (select page, table_no, cell_no, string_agg(s, ' ' order by block, line) as t from dd where p is distinct from s group by all),
full_ as (select page, table_no, cell_no, coalesce(t, '') as t from (select distinct page, table_no, cell_no from cell) left join ct using (page, table_no, cell_no)),
rw as (select page, table_no, cell_no // 2 as r, '| ' || string_agg(t, ' | ' order by cell_no) || ' |' as md, max(t) as any_ from full_ group by all)
select page, table_no, '**Table: line ' || table_no || '**' || chr(10) || chr(10) || first(md order by r) || chr(10) || '| --- | --- |' || coalesce(chr(10) || case when count(*) > 1 then last(md order by r) end, '') as markdown from rw where any_ <> '' group by 1, 2"""
)
def page_tables(spark, d):
    """Tables of pages, their cells filled with the tokens that lie in them."""
    return layout.tables(*_page_tables(spark, d))[1].select("page", "table_no", "markdown")
