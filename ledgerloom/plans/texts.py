"""Queries on texts, retrieval and conversations, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom.functions import text as T
from ledgerloom.functions import vectors
from ledgerloom.operators import texts as ops
from ledgerloom.operators.evidence import contained_quotes
from ledgerloom.sources.tables import file_control as control
from ledgerloom.sources.tables import table

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


FOLDED = f"lower(regexp_replace(regexp_replace(translate({{0}}, '{T.ACCENTED}', '{T.PLAIN}'), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g'))"
COLLAPSED = "lower(regexp_replace(regexp_replace({0}, '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g'))"


@query("with m as (select doc_id, list_filter([" + ", ".join(f"case when regexp_matches(text, '(?i){p}') then '{i}' end" for i, p in enumerate(ops.INJECTION_PATTERNS)) + "], lambda x: x is not null) f from documents) select doc_id, len(f) > 0 suspicious, array_to_string(f, '|') matched from m")
def injection_scan(spark, sf_dir):
    return ops.injection_scan(table(spark, sf_dir, "documents"), F.col("text")).select("doc_id", "suspicious", "matched")


@query("select conv_id, count(*) n_pages, string_agg('[PAGE ' || (turn + 1)::varchar || ']' || chr(10) || coalesce(text, ''), chr(10) || chr(10) order by turn, text) tagged from conversations group by 1")
def page_text(spark, sf_dir):
    return ops.page_text(table(spark, sf_dir, "conversations").withColumn("page", F.col("turn") + 1), "conv_id", "page", "text")


LINES = "select doc_id, i::integer line_no, l raw from (select doc_id, unnest(string_split(text, chr(10))) l, generate_subscripts(string_split(text, chr(10)), 1) i from documents) where regexp_matches(l, '\\S')"


@query(LINES)
def page_lines(spark, sf_dir):
    return ops.text_lines(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("select sha256(text) digest, min(doc_id) \"first\", count(*) n from documents group by 1")
def content_dedupe(spark, sf_dir):
    return ops.content_groups(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"select item_id, doc_id from benchmark b join documents d on contains({COLLAPSED.format('d.text')}, {COLLAPSED.format('b.text')}) where length({COLLAPSED.format('b.text')}) > 0")
def provenance(spark, sf_dir):
    found = contained_quotes(table(spark, sf_dir, "benchmark").withColumnRenamed("text", "quote"), table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", T.collapse(F.col("quote")), T.collapse(F.col("text")), ["doc_id"])
    return found.select("item_id", "doc_id")


@query(f"select doc_id, {FOLDED.format('text')} folded from documents")
def text_fold(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.fold(F.col("text")).alias("folded"))


@query("select doc_id, length(regexp_replace(text, '\\s', '', 'g')) >= 40 and length(regexp_replace(text, '[^\\pL\\pN]', '', 'g')) >= 20 and not contains(text, chr(65533)) and not contains(lower(text), '(cid:') usable from documents")
def text_usable(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.usable_native_text(F.col("text")).alias("usable"))


DATE_RE, AMOUNT_RE = "[0-9]{1,2}[/.-][0-9]{1,2}[/.-][0-9]{2,4}", "[0-9]{1,3}(?:[ .][0-9]{3})*[.,][0-9]{2}"


@query(f"select doc_id, array_to_string(regexp_extract_all(text, '{DATE_RE}'), '|') dates, array_to_string(regexp_extract_all(text, '{AMOUNT_RE}'), '|') amounts from documents")
def line_tokens(spark, sf_dir):
    found = lambda p: F.array_join(F.regexp_extract_all("text", F.lit(p), F.lit(0)), "|")
    return table(spark, sf_dir, "documents").select("doc_id", found(DATE_RE).alias("dates"), found(AMOUNT_RE).alias("amounts"))


@query(f"with s as (select doc_id, len(regexp_extract_all(text, '{DATE_RE}'))::bigint d, len(regexp_extract_all(text, '{AMOUNT_RE}'))::bigint a, len(string_split(text, chr(10)))::bigint l from documents) select doc_id, d n_dates, a n_amounts, round(4 * (d > 0)::int + least(a, 12) + least(l, 30) / 5.0, 2)::double score from s")
def text_scores(spark, sf_dir):
    d, a, n = F.regexp_count("text", F.lit(DATE_RE)).cast("long"), F.regexp_count("text", F.lit(AMOUNT_RE)).cast("long"), F.size(F.split("text", "\n"))
    score = F.round(4 * (d > 0).cast("int") + F.least(a, F.lit(12)) + F.least(n, F.lit(30)) / 5.0, 2)
    return table(spark, sf_dir, "documents").select("doc_id", d.alias("n_dates"), a.alias("n_amounts"), score.cast("double").alias("score"))


@query("""with s as (select doc_id, lang, length(text) + 7 * len(regexp_extract_all(text, '[A-Z]')) score from documents) select lang, max_by(doc_id, (score, -doc_id)) doc_id, max(score)::bigint score from s group by 1""")
def variant_select(spark, sf_dir):
    s = table(spark, sf_dir, "documents").withColumn("score", F.length("text") + 7 * F.regexp_count("text", F.lit("[A-Z]")))
    return s.groupBy("lang").agg(F.max_by("doc_id", F.struct(F.col("score"), -F.col("doc_id"))).alias("doc_id"), F.max("score").cast("long").alias("score"))


@query("select doc_id, (i / 700)::integer chunk_id, substring(text, i + 1, 800) chunk from (select doc_id, text, unnest(range(0, length(text), 700))::integer i from documents where length(text) > 0)")
def chunks_fixed(spark, sf_dir):
    return ops.fixed_chunks(table(spark, sf_dir, "documents"), "doc_id", "text")


CHUNKS = """
with recursive l as (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') ls from documents),
s as (select doc_id, ls, 0 i, '' as held, []::varchar[] done from l
 union all select doc_id, ls, i + 1, case when length(j) <= 800 then j when length(x) <= 800 then x else '' end,
  case when length(j) <= 800 then done else list_concat(case when held = '' then done else list_append(done, held) end, case when length(x) <= 800 then []::varchar[] else list_transform(range(0, length(x), 700), lambda p: substring(x, p + 1, 800)) end) end
 from (select *, ls[i + 1] x, case when held = '' then ls[i + 1] else held || chr(10) || ls[i + 1] end j from s where i < len(ls))),
e as (select doc_id, case when held = '' then done else list_append(done, held) end c from s where i = len(ls))
select doc_id, (generate_subscripts(c, 1) - 1)::integer chunk_id, unnest(c) chunk from e"""


@query(CHUNKS)
def chunks_greedy(spark, sf_dir):
    return ops.greedy_chunks(table(spark, sf_dir, "documents"), "doc_id", "text")


DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda x: x[1]::double * x[2]::double))"


@query(f"select vec_id, round(sqrt({DOT.format('embedding', 'embedding')}), 6) length, round(embedding[1]::double / sqrt({DOT.format('embedding', 'embedding')}), 6) first from embeddings")
def vector_normalize(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(vectors.norm(F.col("embedding")), 6).alias("length"), F.round(F.get(vectors.unit(F.col("embedding")), F.lit(0)), 6).alias("first"))


#: Every hundredth row is a query, against all rows.
TOP = f"""s as (select q.vec_id query, v.vec_id, round({DOT.format('q.embedding', 'v.embedding')}, 6) score from embeddings q, embeddings v where q.vec_id % 100 = 0 and q.vec_id <> v.vec_id),
r as (select *, row_number() over (partition by query order by score desc, vec_id)::integer "rank" from s)"""


@query(f'with {TOP} select query, vec_id, score, "rank" from r where "rank" <= 5')
def vector_topk(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return ops.top_k(v.where("vec_id % 100 = 0"), v, "vec_id", "embedding")


@query(f'with {TOP} select query, max(score) best, max(score) >= 0.35 in_scope from r where "rank" <= 5 group by 1')
def in_scope(spark, sf_dir):
    return ops.in_scope(vector_topk(spark, sf_dir))


def _context(ranked):
    tagged = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "vec_id"))), lambda x: F.concat(F.lit("["), x["rank"].cast("string"), F.lit("] "), x["vec_id"].cast("string"))), "\n")
    return ranked.groupBy("query").agg(tagged.alias("context"), (F.max("score") >= 0.35).alias("answered"))


@query(f"""with {TOP} select query, string_agg('[' || "rank"::varchar || '] ' || vec_id::varchar, chr(10) order by "rank") context, max(score) >= 0.35 answered from r where "rank" <= 5 group by 1""")
def rag_answer_context(spark, sf_dir):
    return _context(vector_topk(spark, sf_dir))


def by_turn():
    return Window.partitionBy("conv_id").orderBy("turn")


@query("select conv_id, turn, length(lag(text) over w)::integer previous_chars, lag(role) over w = 'assistant' follows_answer from conversations window w as (partition by conv_id order by turn) qualify role = 'user'")
def chat_followup(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumns({"previous_chars": F.length(F.lag("text").over(by_turn())), "follows_answer": F.lag("role").over(by_turn()) == "assistant"})
    return c.where("role = 'user'").select("conv_id", "turn", "previous_chars", "follows_answer")


@query("select conv_id, turn, count(*) over w n, cast(sum(length(text)) over w as bigint) chars from conversations window w as (partition by conv_id order by turn rows between 3 preceding and current row)")
def chat_history_frame(spark, sf_dir):
    frame = by_turn().rowsBetween(-3, 0)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.count("*").over(frame).alias("n"), F.sum(F.length("text").cast("long")).over(frame).alias("chars"))


@query("select event_id, cast(json_extract(props, '$.k') as bigint) k, props like '{%' is_object from events")
def json_flatten(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.expr("try_variant_get(try_parse_json(props), '$.k', 'bigint')").alias("k"), F.expr("schema_of_variant(try_parse_json(props)) like 'OBJECT%'").alias("is_object"))


@query("select l_orderkey, l_linenumber, substring(sha256(concat_ws('|', l_linenumber::varchar, strftime(l_shipdate, '%Y-%m-%d'), printf('%.2f', l_extendedprice), lower(l_returnflag), lower(l_linestatus))), 1, 16) id from lineitem")
def candidate_id(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", T.candidate_id(F.col("l_linenumber"), F.date_format("l_shipdate", "yyyy-MM-dd"), F.round("l_extendedprice", 2), F.col("l_returnflag"), F.col("l_linestatus")).alias("id"))


@query("""with f as (select page_id, 'page_' || page_id || case page_id % 4 when 0 then '.pdf' when 1 then '.png' when 2 then '.jpg' else '.html' end path, length(html) len, case page_id % 4 when 0 then '255044462D' when 1 then '89504E47' else 'FFD8FFE0' end head from pages)
select page_id, case when len > 3000 then 'too large' when path like '%.html' then 'extension' when path like '%.png' then 'signature' else 'ok' end reason, not (len > 3000 or path like '%.html' or path like '%.png') valid from f""")
def file_control(spark, sf_dir):
    kind = F.element_at(F.array(F.lit(".pdf"), F.lit(".png"), F.lit(".jpg"), F.lit(".html")), (F.col("page_id") % 4 + 1).cast("int"))
    head = F.element_at(F.array(F.lit("255044462D"), F.lit("89504E47"), F.lit("FFD8FFE0"), F.lit("FFD8FFE0")), (F.col("page_id") % 4 + 1).cast("int"))
    f = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("page_"), F.col("page_id"), kind).alias("path"), F.length("html").alias("length"), head.alias("head"))
    return control(f, 3000).select("page_id", "reason", "valid")
