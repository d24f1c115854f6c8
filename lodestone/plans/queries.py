"""The queries of the engine's operators over the test tables, each with SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import SearchSettings
from ..engine import search_hits
from ..functions import text as X
from ..operators import catalog, lexical, ranking, vector
from ..sources.files import EXTRACTORS, accepted, excluded, html_text, levels, outcomes, with_text
from ..storage import bounded_batches, give_back, shared_dir, staged
from ..streaming.indexer import slices
from .tables import FILES, SPACE, VECTORS, chunk_sql, chunks, files, table, vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
SMALL = (200, 40)
#: Lexical queries; the last has only words that more than half of the chunks have, and one is repeated.
ASKED = [(0, "for was"), (1, "with this"), (2, "que"), (3, "der"), (4, "that that"), (5, "the of and")]
#: Fused queries, with the vec_id of their vectors.
FUSED = [(0, "for was", 7), (1, "with this", 11), (2, "que", 3)]
WORD = "that for"
_PAIR = "for was"


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


@query(f"with {chunk_sql()} select file_id, chunk_id, idx, sha256, md5(text) as md5 from chunks")
def ids(spark, d):
    return chunks(spark, d).select("file_id", "chunk_id", "idx", "sha256", F.md5("text").alias("md5"))


@query(f"with {FILES} select file_id, path, size, mtime, sha256(text) as sha256 from files")
def files_catalog(spark, d):
    return files(spark, d).select("file_id", "path", "size", "mtime", F.sha2("text", 256).alias("sha256"))


@query(f"with {FILES} select file_id, path from files where regexp_extract(lower(path), '[.][^./]*$') in ('.txt', '.md', '.pdf', '.docx', '.html', '.htm', '.rtf') and path not like '%/src3/%' and path not like '%/tmp/%'")
def files_filtered(spark, d):
    return files(spark, d).where(accepted(F.col("path")) & ~excluded(F.col("path"), ["**/src3/**"])).select("file_id", "path")


@query(f"with {FILES} select path, case regexp_extract(path, '[.]([^./]*)$', 1) when 'txt' then 'text' when 'md' then 'markdown' when 'html' then 'html' else 'unknown' end as file_type from files")
def file_types(spark, d):
    return files(spark, d).select("path", X.file_type(F.col("path")).alias("file_type"))


@query("""select page_id, trim(regexp_replace(url, '[<>:"|?*]', '_', 'g'), ' .') as safe from pages""")
def path_sanitize(spark, d):
    return table(spark, d, "pages").select("page_id", X.sanitize_path(F.col("url")).alias("safe"))


@query(rf"with c as (select item_id, trim(regexp_replace(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}_{SPACE[1:-1]}]', ' ', 'g'), '{SPACE}+', ' ', 'g')) as cleaned from benchmark) select * from c")
def query_clean(spark, d):
    return table(spark, d, "benchmark").select("item_id", X.clean_query(F.col("text")).alias("cleaned"))


@query(f"with {chunk_sql(*SMALL)} select chunk_id, file_id, idx, token_start, token_end, sha256 from chunks")
def chunks_cut(spark, d):
    return chunks(spark, d, *SMALL).select("chunk_id", "file_id", "idx", "token_start", "token_end", "sha256")


@query(f"with {chunk_sql(*SMALL)} select chunk_id, text, path from chunks where file_id = (select min(file_id) from files)")
def chunk_lookup(spark, d):
    first = files(spark, d).agg(F.min("file_id")).first()[0]
    return chunks(spark, d, *SMALL).where(F.col("file_id") == first).select("chunk_id", "text", "path")


@query(f"with {chunk_sql(*SMALL)} select c.chunk_id, c.idx, f.path, f.size, f.mtime from chunks c join files f using (file_id)")
def chunk_meta(spark, d):
    return chunks(spark, d, *SMALL).select("chunk_id", "file_id", "idx").join(files(spark, d).select("file_id", "path", "size", "mtime"), "file_id").drop("file_id")


@query(f"with {chunk_sql(*SMALL)} select f.file_id, f.path, f.size, f.mtime, count(c.chunk_id) as chunk_count, f.indexed_at from files f left join chunks c on f.file_id = c.file_id group by all")
def file_chunk_counts(spark, d):
    return catalog.file_chunk_counts(files(spark, d), chunks(spark, d, *SMALL))


_FTS = f"{chunk_sql(*SMALL)}, fts as (select chunk_id, path, text from chunks where path not like '/corpus/fr/%'), held as (select * from chunks where path not like '/corpus/de/%')"


def _fts(spark, d):
    """Chunks, the part of them that the lexical index has, and the part that the catalog has."""
    every = chunks(spark, d, *SMALL)
    return every, every.where(~F.col("path").startswith("/corpus/fr/")), every.where(~F.col("path").startswith("/corpus/de/"))


@query(f"with {_FTS} select fts.chunk_id, fts.path from fts left join held using (chunk_id) where held.chunk_id is null")
def orphaned_fts(spark, d):
    _, fts, held = _fts(spark, d)
    return catalog.orphaned_fts(fts, held)


@query(f"with {_FTS} select c.chunk_id, f.path from chunks c join files f using (file_id) left join fts on fts.chunk_id = c.chunk_id where fts.chunk_id is null")
def missing_fts(spark, d):
    every, fts, _ = _fts(spark, d)
    return catalog.missing_fts(every, files(spark, d), fts)


@query(f"with {_FTS} select (select count(*) from files) as total_files, (select count(*) from chunks) as total_chunks, (select count(*) from fts) as total_fts_entries, (select count(distinct path) from fts) as unique_paths, (select sum(size)::bigint from files) as total_size_bytes, (select max(indexed_at) from files) as last_indexed")
def db_stats(spark, d):
    every, fts, _ = _fts(spark, d)
    return catalog.db_stats(files(spark, d), every, fts)


#: A second snapshot: German files are gone, French ones have grown by a line, English and Spanish ones are as they were.
_NEW = f"""{FILES}, new as (select path, text, size, mtime, sha1(path || '|' || mtime || '|' || size) as file_id, mtime + 120 as indexed_at from
  (select path, case lang when 'fr' then text || chr(10) || 'x' else text end as text, case lang when 'fr' then size + 2 else size end as size, mtime from files where lang <> 'de')),
old as (select * from files where lang <> 'es')"""


def _snapshots(spark, d):
    from ..functions.ids import file_id

    every = files(spark, d)
    grown = F.col("lang") == "fr"
    new = every.where("lang <> 'de'").withColumns({"text": F.when(grown, F.concat("text", F.lit("\nx"))).otherwise(F.col("text")), "size": F.when(grown, F.col("size") + 2).otherwise(F.col("size")), "indexed_at": F.col("mtime") + 120})
    new = new.withColumn("file_id", file_id(F.col("path"), F.col("mtime"), F.col("size")))
    return every.where("lang <> 'es'"), new


@query(f"with {_NEW} select path, case when n.path is null then 'deleted' when o.path is null then 'added' when o.file_id = n.file_id and sha256(o.text) = sha256(n.text) then 'unchanged' else 'changed' end as status from old o full outer join new n using (path)")
def change_detection(spark, d):
    old, new = (x.withColumn("bytes_sha256", F.sha2("text", 256)) for x in _snapshots(spark, d))
    return catalog.changes(old, new)


@query(f"with {_NEW} select path, file_id, size, indexed_at from (select *, row_number() over (partition by path order by indexed_at desc, file_id desc) as k from (select path, file_id, size, indexed_at from old union all select path, file_id, size, indexed_at from new)) where k = 1")
def upsert_files(spark, d):
    old, new = _snapshots(spark, d)
    keep = ["path", "file_id", "size", "indexed_at"]
    return catalog.upsert_files(old.select(*keep), new.select(*keep))


@query(f"with {chunk_sql(*SMALL)} select chunk_id, file_id, idx, case when path like '/corpus/fr/%' then upper(text) else text end as text from chunks")
def upsert_chunks(spark, d):
    keep = ["chunk_id", "file_id", "idx", "text"]
    every = chunks(spark, d, *SMALL)
    changed = every.where(F.col("path").startswith("/corpus/fr/"))
    return catalog.replace_rows(every.select(*keep), changed.select(*keep).withColumn("text", X.upper(F.col("text"))), changed.select("file_id"))


@query(f"with {chunk_sql(*SMALL)} select 'files' as relation, count(*) as n from files where lang <> 'fr' union all select 'chunks', count(*) from chunks where path not like '/corpus/fr/%' union all select 'lengths', count(*) from chunks where path not like '/corpus/fr/%'")
def delete_cascade(spark, d):
    # the texts are cut once; only ids are joined
    cut = staged(chunks(spark, d, *SMALL).select("chunk_id", "file_id", F.size(lexical.tokens(F.col("text"))).cast("long").alias("dl")), "split")
    every = files(spark, d).select("file_id", "lang")
    left = catalog.delete_files(every.where("lang = 'fr'"), files=every, chunks=cut.select("chunk_id", "file_id"), lengths=cut.select("chunk_id", "dl"))
    out = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("relation"), "n") for name, df in left.items()]
    return out[0].union(out[1]).union(out[2])


_TOKENS = r"list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}\p{M}\p{Co}]+'), lambda x: x <> '')"
_LEX = f"tok as (select chunk_id, unnest({_TOKENS}) as term from chunks), dl as (select chunk_id, len({_TOKENS})::bigint as dl from chunks), st as (select count(*) as n, avg(dl) as m from dl)"
_BM25 = """tf as (select query_id, phrase, chunk_id, count(*) as f from tok join q using (term) group by all), ni as (select query_id, phrase, count(*) as c from tf group by all),
need as (select query_id, count(*) as needed from q group by all),
part as (select query_id, chunk_id, case when ln((n - c + 0.5::double) / (c + 0.5::double)) > 0 then ln((n - c + 0.5::double) / (c + 0.5::double)) else 1e-6::double end * f * 2.2::double / (f + 1.2::double * (0.25::double + 0.75::double * dl / m)) as p from tf join ni using (query_id, phrase) join dl using (chunk_id), st),
sc as (select query_id, chunk_id, round(sum(p), 6) as score, count(*) as has from part group by all),
lex as (select * exclude (k) from (select query_id, chunk_id, score, row_number() over (partition by query_id order by score desc, chunk_id) as k from sc join need using (query_id) where has = needed) where k <= 200)"""


def _q(asked) -> str:
    return "q(query_id, phrase, term) as (values " + ", ".join(f"({i}, {k}, '{w}')" for i, said in asked for k, w in enumerate(said.split())) + ")"


@query(f"with {chunk_sql()}, {_LEX} select term, count(distinct chunk_id) as n, count(*) as occurrences from tok group by term")
def bm25_stats(spark, d):
    return lexical.term_counts(chunks(spark, d))


@query(f"with {chunk_sql()}, {_LEX}, {_q(ASKED)}, {_BM25} select query_id::bigint as query_id, chunk_id, score from lex")
def lexical_topk(spark, d):
    return lexical.search(chunks(spark, d), ASKED)


@query()
def lexical_topk_porter(spark, d):
    """All three columns, folded and stemmed."""
    return lexical.search(chunks(spark, d), [(0, "things being"), (1, "txt"), (2, "Éléments"), (3, "this_that")], columns=("chunk_id", "text", "path"), stemmed=True)


@query(rf"with {chunk_sql()}, t as (select chunk_id, {_TOKENS} as w from chunks), o as (select chunk_id, w[i] as a, w[i + 1] as b from (select chunk_id, w, unnest(range(1, len(w))) as i from t)) select chunk_id, count(*) as f from o where a = 'it' and b = 'was' group by chunk_id")
def lexical_phrase(spark, d):
    """How often each chunk has the phrase of an underscored word."""
    found = lexical.matches(chunks(spark, d), lexical.phrase_rows([(0, "it_was")]))
    return found.where("query_id is not null and chunk_id is not null").select("chunk_id", F.col("f")[0].alias("f"))


def _vector(spark, d, vec_id):
    return [float(x) for x in table(spark, d, "embeddings").where(F.col("vec_id") == vec_id).first().embedding]


@query(f"""with {chunk_sql()}, {VECTORS}, asked as (select vec_id as query_id, embedding as wanted from embeddings where vec_id % 50 = 0),
s as (select query_id, chunk_id, round(list_cosine_similarity(embedding::double[], wanted::double[]), 6) as score from vectors, asked)
select * exclude (k) from (select *, row_number() over (partition by query_id order by score desc, chunk_id) as k from s) where k <= 300""")
def vector_topk(spark, d):
    """Every vector whose id is divisible by 50 as a query, against all."""
    asked = [(r.vec_id, r.embedding) for r in table(spark, d, "embeddings").where("vec_id % 50 = 0").select("vec_id", "embedding").collect()]
    return vector.nearest(vectors(spark, d), asked)


@query("""with s as (select vec_id, label, round(list_cosine_similarity(embedding::double[], (select embedding from embeddings where vec_id = 7)::double[]), 6) as score from embeddings),
m as (select *, min(score) over (partition by label) as lo, max(score) over (partition by label) as hi from s)
select vec_id, label, round(case when hi = lo then score else (score - lo) / (hi - lo) end, 6) as score, 0.5::double as same from m""")
def minmax_norm(spark, d):
    asked = F.array(*[F.lit(x) for x in _vector(spark, d, 7)])
    s = table(spark, d, "embeddings").select("vec_id", "label", F.round(vector.cosine(F.col("embedding"), asked), 6).alias("score"), F.lit(0.5).alias("same"))
    return s.select("vec_id", "label", F.round(ranking.minmax(F.col("score"), "label"), 6).alias("score"), ranking.minmax(F.col("same"), "label").alias("same"))


def _exact_sql(q: str, text: str = "text") -> str:
    words = f"list_distinct(list_filter(string_split_regex({q}, '{SPACE}+'), lambda x: x <> ''))"
    share = f"(len(list_intersect({words}, string_split_regex(lower({text}), '{SPACE}+')))::double / greatest(len({words}), 1))"
    return f"case when contains(lower({text}), {q}) then 1.0::double when {share} >= 0.7 then {share} else 0.0::double end"


def _position_sql(q: str, text: str = "text") -> str:
    at = f"(strpos(lower({text}), {q}) - 1)"
    return f"case when {at} >= 0 and {at}::double / greatest(length({text}), 1) <= 0.3 then 1 - {at}::double / greatest(length({text}), 1) else 0.0::double end"


@query(f"select doc_id, round({_exact_sql(chr(39) + 'that for was with' + chr(39))}, 6) as exact from documents")
def exact_match(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(X.exact_match(F.lit(" that FOR was with"), F.col("text")), 6).alias("exact"))


@query(f"select doc_id, round({_position_sql(chr(39) + 'that' + chr(39))}, 6) as bonus from documents")
def position_bonus(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(X.position_bonus(F.lit("That "), F.col("text")), 6).alias("bonus"))


def _fused_sql(phrases: str, asked: str) -> str:
    """phrases: q (query_id, phrase, term); asked: asked (query_id, query, vec_id)."""
    return f"""{chunk_sql()}, {VECTORS}, {_LEX}, {phrases}, {_BM25}, {asked},
vec as (select * exclude (k) from (select *, row_number() over (partition by query_id order by score desc, chunk_id) as k from
  (select a.query_id, v.chunk_id, round(list_cosine_similarity(v.embedding::double[], e.embedding::double[]), 6) as score from asked a join embeddings e using (vec_id), vectors v)) where k <= 300),
nl as (select query_id, chunk_id, case when max(score) over w = min(score) over w then score else (score - min(score) over w) / (max(score) over w - min(score) over w) end as bm25 from lex window w as (partition by query_id)),
nv as (select query_id, chunk_id, case when max(score) over w = min(score) over w then score else (score - min(score) over w) / (max(score) over w - min(score) over w) end as cosine from vec window w as (partition by query_id)),
mg as (select query_id, chunk_id, coalesce(bm25, 0) as bm25, coalesce(cosine, 0) as cosine from nl full outer join nv using (query_id, chunk_id)),
pt as (select mg.*, file_id, path, text, query, {_exact_sql("query")} as exact, {_position_sql("query")} as position_bonus from mg join chunks using (chunk_id) join asked using (query_id) where text <> ''),
tot as (select *, round(0.55::double * bm25 + 0.45::double * cosine + 0.2::double * exact + 0.1::double * position_bonus, 6) as score from pt),
merged as (select * exclude (k) from (select *, row_number() over (partition by query_id order by score desc, chunk_id) as k from tot) where k <= 400),
deduped as (select * exclude (k) from (select *, row_number() over (partition by query_id, file_id order by score desc, chunk_id) as k from merged) where k = 1)"""


_FUSED = _fused_sql(_q([x[:2] for x in FUSED]), "asked(query_id, query, vec_id) as (values " + ", ".join(f"({i}, '{w}', {v})" for i, w, v in FUSED) + ")")


def _merged(spark, d):
    near = vector.nearest(vectors(spark, d), [(i, _vector(spark, d, vec_id)) for i, _, vec_id in FUSED])
    queries = spark.createDataFrame([x[:2] for x in FUSED], "query_id long, query string")
    every = chunks(spark, d).select("chunk_id", "file_id", "path", "idx", "text")
    # the chunks are cut once for their words and once for the few candidates' texts, which costs less than writing them
    return ranking.fused(lexical.search(every, [x[:2] for x in FUSED]), near, every, queries)


@query(f"with {_FUSED} select query_id::bigint as query_id, chunk_id, round(bm25, 6) as bm25, round(cosine, 6) as cosine, round(exact, 6) as exact, round(position_bonus, 6) as position_bonus, score from merged")
def hybrid_merge(spark, d):
    return _merged(spark, d).select("query_id", "chunk_id", *[F.round(c, 6).alias(c) for c in ("bm25", "cosine", "exact", "position_bonus")], "score")


@query(f"with {_FUSED} select query_id::bigint as query_id, chunk_id, file_id, score from deduped")
def dedupe_by_file(spark, d):
    return ranking.best_by_file(_merged(spark, d)).select("query_id", "chunk_id", "file_id", "score")


def _found(spark, d):
    return ranking.best(ranking.best_by_file(_merged(spark, d)), SearchSettings().top_k, ["query_id"])


_TOP = f"{_FUSED}, found as (select *, row_number() over (partition by query_id order by score desc, chunk_id)::bigint as rank from deduped qualify rank <= 50)"


@query(f"with {_TOP} select query_id::bigint as query_id, rank, chunk_id, file_id, path, score from found")
def hybrid_search(spark, d):
    return ranking.paged(_found(spark, d), 1, SearchSettings().top_k).select("query_id", "rank", "chunk_id", "file_id", "path", "score")


@query(f"with {_TOP} select query_id::bigint as query_id, rank, chunk_id, score, (select count(*) from found g where g.query_id = f.query_id) as total_hits, ceil((select count(*) from found g where g.query_id = f.query_id) / 7.0)::bigint as total_pages, 2 < ceil((select count(*) from found g where g.query_id = f.query_id) / 7.0) as has_next, true as has_prev from found f where rank between 8 and 14")
def pagination(spark, d):
    return ranking.paged(_found(spark, d), 2, 7).select("query_id", "rank", "chunk_id", "score", "total_hits", "total_pages", "has_next", "has_prev")


_BATCH = _fused_sql(
    rf"""q as (select item_id as query_id, generate_subscripts(w, 1) - 1 as phrase, unnest(w) as term from
  (select item_id, list_filter(string_split(trim(regexp_replace(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}_{SPACE[1:-1]}]', ' ', 'g'), '{SPACE}+', ' ', 'g')), ' '), lambda x: x <> '') as w from benchmark))""",
    f"asked as (select item_id as query_id, regexp_replace(lower(text), '^{SPACE}+|{SPACE}+$', '', 'g') as query, item_id as vec_id from benchmark)",
)


@query(f"with {_BATCH} select query_id::bigint as query_id, chunk_id, file_id, score from deduped qualify row_number() over (partition by query_id order by score desc, chunk_id) <= 50")
def hybrid_batch(spark, d):
    """All benchmark items as queries in one job, by words and by the vector of the item's number; words alone where there is none."""
    every = chunks(spark, d).select("chunk_id", "file_id", "path", "idx", "text")
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    asked = [tuple(r) for r in lexical.phrases_of(items).select("query_id", "phrase", "place", "term", "n_terms").collect()]  # the queries, not the corpus
    known = items.join(table(spark, d, "embeddings"), F.col("query_id") == F.col("vec_id")).select("query_id", "embedding").collect()
    near = vector.nearest(vectors(spark, d), [(r.query_id, r.embedding) for r in known])
    ranked = ranking.fused(lexical.search_phrases(every, asked), near, every, items)
    return ranking.best(ranking.best_by_file(ranked), SearchSettings().top_k, ["query_id"]).select("query_id", "chunk_id", "file_id", "score")


_AT = f"(case when strpos(lower(text), '{_PAIR}') > 0 then strpos(lower(text), '{_PAIR}') else coalesce(list_min(list_filter([strpos(lower(text), 'for'), strpos(lower(text), 'was')], lambda p: p > 0)), 0) end - 1)"
_SNIP = f"""s as (select *, {_AT} as pos from %s),
r as (select *, case when pos < 0 then 0 else greatest(0, pos - 50) end as lo, case when pos < 0 then least(100, length(text)) else least(length(text), pos + {len(_PAIR)} + 50) end as hi from s),
n as (select *, case when pos >= 0 and lo > 0 then '...' else '' end || substr(text, lo + 1, hi - lo) || case when pos >= 0 and hi < length(text) then '...' else '' end as snippet from r)"""


@query(f"with {_SNIP % 'documents'} select doc_id, snippet, lo::bigint as lo, hi::bigint as hi from n")
def snippets(spark, d):
    s = table(spark, d, "documents").select("doc_id", X.make_snippet(F.col("text"), F.lit(_PAIR)).alias("s"))
    return s.select("doc_id", "s.snippet", F.col("s.start").cast("long").alias("lo"), F.col("s.end").cast("long").alias("hi"))


def _marked_sql(text: str, words: str) -> str:
    """Whole words between asterisks, where letters of any script are word characters: twice, since words in a row share what is between them."""
    edge = r"[^\p{L}\p{M}\p{Nd}_\x01\x02]"
    for _ in range(2):
        text = rf"regexp_replace({text}, '(?i)(^|{edge})({words})($|{edge})', '\1' || chr(1) || '\2' || chr(2) || '\3', 'g')"
    return f"replace(replace({text}, chr(1), '**'), chr(2), '**')"


@query(f"select doc_id, {_marked_sql('text', 'that|for')} as marked from documents")
def highlight(spark, d):
    return table(spark, d, "documents").select("doc_id", X.highlight(F.col("text"), WORD).alias("marked"))


_CUT = "substr(clean, 1, 200)"
_SPACE_AT = f"(length({_CUT}) - strpos(reverse({_CUT}), ' '))"


@query(rf"""with {_SNIP % "(select doc_id, text, source from documents)"}, c as (select *, trim(regexp_replace(snippet, '{SPACE}+', ' ', 'g')) as clean from n),
t as (select *, case when length(clean) <= 200 then clean else case when strpos({_CUT}, ' ') > 0 and {_SPACE_AT} > 160 then substr({_CUT}, 1, {_SPACE_AT}) else {_CUT} end || '...' end as short from c)
select doc_id, lo::bigint as start, hi::bigint as "end", {_marked_sql("short", "for|was")} as snippet, case when doc_id % 2 = 0 then 'text' else 'markdown' end as file_type from t""")
def search_hits_of_texts(spark, d):
    """Every document's text as a hit."""
    path = F.concat(F.lit("/x/"), F.col("doc_id"), F.when(F.col("doc_id") % 2 == 0, ".txt").otherwise(".md"))
    docs = table(spark, d, "documents").select("doc_id", "text", path.alias("path"))
    return search_hits(docs, _PAIR).select("doc_id", "start", "end", "snippet", "file_type")


_LOG = "log as (select event_id as run_id, event_type as operation, (epoch_us(ts) // 1000000)::bigint as timestamp, value as seconds, user_id, event_id % 2 = 0 as cache_hit from events)"


def _log(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("run_id"), F.col("event_type").alias("operation"), F.unix_timestamp("ts").alias("timestamp"), F.col("value").alias("seconds"), "user_id", (F.col("event_id") % 2 == 0).alias("cache_hit"))


@query(f"with {_LOG} select run_id, operation, seconds, strftime(to_timestamp(timestamp) at time zone 'UTC', '%Y-%m-%d %H:%M:%S') as timestamp_str from log order by timestamp desc, run_id, operation, seconds limit 10")
def recent_indexing(spark, d):
    return catalog.recent(_log(spark, d), ["run_id", "operation", "seconds"])


@query(f"with {_LOG} select run_id, user_id, cache_hit, seconds, strftime(to_timestamp(timestamp) at time zone 'UTC', '%Y-%m-%d %H:%M:%S') as timestamp_str from log order by timestamp desc, run_id limit 10")
def recent_searches(spark, d):
    return catalog.recent(_log(spark, d), ["run_id", "user_id", "cache_hit", "seconds"])


@query(f"with {_LOG} select operation, count(*) as runs, round(avg(seconds), 6) as mean_s, min(seconds) as min_s, max(seconds) as max_s, round(sum(seconds), 4) as total_s, count(*) filter (cache_hit) as cache_hits from log group by operation")
def bench_summary(spark, d):
    out = catalog.bench_summary(_log(spark, d))
    return out.withColumns({"mean_s": F.round("mean_s", 6), "total_s": F.round("total_s", 4)})


@query(f"with {_LOG}, b as (select *, lag(seconds) over (partition by operation order by timestamp, run_id) as previous from log) select run_id, operation, seconds, previous, round(case when previous > 0 then (previous - seconds) / previous * 100 end, 6) as improvement from b")
def bench_compare(spark, d):
    return catalog.bench_compare(_log(spark, d)).withColumn("improvement", F.round("improvement", 6))


@query(f"with {FILES}, o as (select case when lang = 'es' then 'disallowed' when source = 'src3' then 'excluded' when text is null then 'unreadable' when text = '' then 'empty' else 'indexed' end as outcome, size from files) select outcome, count(*) as files, sum(size)::bigint as bytes from o group by outcome")
def index_stats(spark, d):
    from ..config import IndexSettings

    found = outcomes(files(spark, d), IndexSettings(exclude_patterns=("**/src3/**",)))
    return found.groupBy("outcome").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


_URLS = r"p as (select list_filter(string_split(regexp_replace(url, '^[a-z]+://', ''), '/'), lambda x: x <> '') as w from pages), lv as (select distinct '/' || array_to_string(w[1:i], '/') as path, i::bigint as level from (select w, unnest(range(1, len(w) + 1)) as i from p))"


def _levels(spark, d):
    return levels(table(spark, d, "pages").select(F.regexp_replace("url", "^[a-z]+://", "").alias("path")))


@query(f"with {_URLS} select path, level from lv")
def bfs_levels(spark, d):
    return _levels(spark, d)


@query(f"with {_URLS} select path, level, ceil(row_number() over (partition by level order by path) / 100.0)::bigint as slice from lv")
def bfs_slices(spark, d):
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy("level").orderBy("path"))
    return _levels(spark, d).select("path", "level", F.ceil(nth / 100).cast("long").alias("slice"))


@query()
def html_text_of_pages(spark, d):
    def of(parts):
        for part in parts:
            yield part.map(lambda x: html_text(x.encode()) if x is not None else None)
        give_back()

    of.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    bounded_batches(spark)
    return table(spark, d, "pages").select("page_id", F.pandas_udf(of, "string")("html").alias("text"))


@query()
def extract_text(spark, d):
    """Pages as files of three kinds."""
    kind = F.when(F.col("url").contains("/en/"), ".html").when(F.col("url").contains("/fr/"), ".txt").otherwise(".md")
    found = table(spark, d, "pages").select(F.concat(F.lit("/pages/"), F.col("page_id"), kind).alias("path"), F.lit(1700000000).cast("long").alias("mtime"), F.octet_length("html").cast("long").alias("size"), F.encode("html", "UTF-8").alias("content"))
    return with_text(found, EXTRACTORS).select("path", "file_id", "sha256", "bytes_sha256")


def _written(spark, d, name):
    """Documents as text files, one for each document, in a folder that driver and executors share. Where it is a local path, Python writes them: Hadoop's local
    files start a process for each file, and Spark's partitions make a folder for each."""
    import hashlib
    import os
    import uuid
    from collections import Counter
    from urllib.parse import unquote, urlsplit

    root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    docs = table(spark, d, "documents").select("text", F.col("doc_id").alias("doc"))
    where = urlsplit(root)
    if where.scheme not in ("", "file"):
        docs.repartition("doc").write.partitionBy("doc").text(f"{root}/files")
        return root
    base = f"{unquote(where.path) if where.scheme else root}/files"

    def put(batches):
        seen = Counter()  # of rows that are the same, each has a file of its own
        for batch in batches:
            for text, doc in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                folder, raw = f"{base}/{(doc or 0) // 1000}", (text or "").encode() + b"\n"  # a thousand files a folder, so that listings can be dealt out
                name = f"doc={doc}-{hashlib.sha1(raw).hexdigest()}"
                seen[name] += 1
                os.makedirs(folder, exist_ok=True)
                with open(part := f"{folder}/.{name}-{uuid.uuid4().hex}", "wb") as f:
                    f.write(raw)
                os.replace(part, f"{folder}/{name}-{seen[name]}.txt")  # a task that is run again leaves the same
        yield from ()

    bounded_batches(spark)
    docs.repartition("doc").mapInArrow(put, "done int").write.format("noop").mode("overwrite").save()
    return root


_LINES = "replace(replace(text || chr(10), chr(13) || chr(10), chr(10)), chr(13), chr(10))"


@query(f"select doc_id, strlen(text) + 1 as size, sha256({_LINES}) as sha256 from documents")
def index_incremental(spark, d):
    """The file stream takes the documents in slices; each slice's files are written once, under its number."""
    root = _written(spark, d, "stream")

    def keep(batch, number):
        with_text(batch).select("path", "size", "sha256").write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    slices(spark, f"{root}/files", f"{root}/seen", keep, 400)
    out = spark.read.parquet(f"{root}/out")
    return out.select(F.regexp_extract("path", "doc=([0-9]+)", 1).cast("long").alias("doc_id"), "size", "sha256")


@query(f"with {chunk_sql()} select (select count(*) from files) as total_files, count(*) as total_chunks, count(*) as total_fts_entries, count(distinct path) as unique_paths, (select sum(strlen(text) + 1)::bigint from files) as total_size_bytes, count(*) as total_vectors, 0::bigint as total_errors from chunks")
def index_full(spark, d):
    """A full pass over the documents as files: the totals of the index that it writes."""
    from dataclasses import replace

    from ..config import Settings
    from ..engine import Engine

    root = _written(spark, d, "full")
    settings = Settings(store=f"{root}/store")
    engine = Engine(spark, replace(settings, index=replace(settings.index, exclude_patterns=())))
    engine.index([f"{root}/files"])
    found = engine.status()
    del found["last_indexed"]
    return spark.createDataFrame([tuple(found.values())], ", ".join(f"{k} long" for k in found))


for _old, _new in (("chunks_cut", "chunks"), ("search_hits_of_texts", "search_hits"), ("html_text_of_pages", "html_text")):
    QUERIES[_new] = QUERIES.pop(_old)
    if _old in ORACLE_SQL:
        ORACLE_SQL[_new] = ORACLE_SQL.pop(_old)
