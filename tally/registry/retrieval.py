"""Retrieval queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tally.operators import reports, retrieval, scoring, vector_store
from tally.plans import roles
from tally.registry.sqlroles import roles as R
from tally.sources.scratch import materialize, scratch_path
from tally.sources.store import Store

QUESTION = "història de src3 als anys 80 a fr"
GROUPS, YEARS, PLACES = ["src3"], list(range(1980, 1990)), ["fr"]


def _vectors(s, d):
    return retrieval.vector_columns(roles.table(s, d, "embeddings"))


def _queries(s, d, below):
    return _vectors(s, d).filter(F.col("id") < below).select(F.col("id").alias("query_id"), F.col("vec").alias("qvec"))


def _found(s, d, k=50):
    """The nearest documents of the first vector with what is known of them."""
    return _described(s, d, retrieval.top_k(_vectors(s, d).filter("id > 0"), _queries(s, d, 1), k))


def _described(s, d, top):
    doc = roles.table(s, d, "documents").select(F.col("doc_id"), F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("title"), F.when(F.col("doc_id") % 3 == 0, "history").when(F.col("doc_id") % 3 == 1, "colles").otherwise("technique").alias("category"), F.array("source").alias("groups"), F.array((F.col("doc_id") % 30 + 1970).cast("int")).alias("years"), F.array(F.concat((F.col("doc_id") % 30 + 1970).cast("string"), F.lit("-x"))).alias("year_ranges"), F.array("lang", F.lit("historia"), "source").alias("keywords"), F.array("lang").alias("places"))
    return top.join(doc, top["id"] == doc["doc_id"])


def _reranked_each(s, d):
    """A question about each document whose id is divisible by 50: its group in the eighties, how things are built, or its contest."""
    queries = _vectors(s, d).filter("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("vec").alias("qvec"))
    top = retrieval.top_k_blocks(_vectors(s, d), queries, 51).filter("id <> query_id")
    kind, none = F.floor(F.col("doc_id") / 50) % 3, F.array().cast("array<string>")
    year = F.col("doc_id") % 30 + 1970
    question = F.when(kind == 0, F.concat(F.lit("Història de "), "source", F.lit(" als anys 80 a "), "lang")).when(kind == 1, "Quina és la tècnica i l'estructura dels castells?").otherwise(F.concat(F.lit("El concurs de "), year.cast("string"), F.lit(" i "), "source"))
    asked_years = F.when(kind == 0, F.sequence(F.lit(1980), F.lit(1989))).when(kind == 2, F.array(year.cast("int"))).otherwise(F.array().cast("array<int>"))
    asked = roles.table(s, d, "documents").filter("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), question.alias("question"), F.when(kind == 0, F.array("source")).otherwise(none).alias("asked_groups"), asked_years.alias("asked_years"), F.when(kind == 0, F.array("lang")).otherwise(none).alias("asked_places"))
    return retrieval.rerank_each(_described(s, d, top).join(asked, "query_id"))


def _reranked(s, d, similar=False):
    return retrieval.rerank(_found(s, d), QUESTION, GROUPS, YEARS, PLACES, similar)


def chunk_arrays(s, d):
    """Chunk files, made from the documents, as rows with typed arrays."""
    schema = "struct<chunks: array<struct<id: string, title: string, years: array<int>, colles: array<string>>>>"
    docs = roles.table(s, d, "documents")
    chunk = F.struct(F.concat(F.lit("c"), "doc_id").alias("id"), F.upper("source").alias("title"), F.array((F.col("doc_id") % 50 + 1950).cast("int"), F.lit(2000)).alias("years"), F.array("source", "lang").alias("colles"))
    nested = docs.select(F.to_json(F.struct(F.array(chunk).alias("chunks"))).alias("json"))
    rows = nested.select(F.explode(F.from_json("json", schema)["chunks"]).alias("c")).select("c.*")
    return rows.select("id", "title", F.element_at("years", 1).alias("first_year"), F.size("years").alias("n_years"), F.array_join("colles", ",").alias("colles"))


def doc_assemble(s, d):
    """All kinds of documents as one: (kind, key, group_name, text)."""
    perf = scoring.performances(s, d)
    groups = roles.groups(s, d)
    info = groups.select(F.lit("info").alias("kind"), F.col("group_id").cast("string").alias("key"), "group_name", F.concat(F.lit("code: "), F.col("group_id").cast("string")).alias("text"))
    rank = F.row_number().over(reports.Window.partitionBy("group_id").orderBy(F.desc("total_points"), "event_id"))
    best = scoring.event_totals(perf).withColumn("rank", rank).filter("rank <= 5")
    best = best.select(F.lit("performance").alias("kind"), F.concat_ws("-", F.col("group_id"), F.col("rank")).alias("key"), "group_name", F.expr("concat('Actuació (rank ', rank, ') - ', event_date, ' - ', place, ' - ', event_name, '. Actuació: ', items_done, '. Punts: ', total_points)").alias("text"))
    items = "listagg(concat(item_name, ' (', status, ')'), '; ') WITHIN GROUP (ORDER BY attempt_id)"
    shows = perf.groupBy("event_id", "group_id", "group_name", "date_text", "event_name", "place", "city").agg(F.expr(f"concat(date_text, ' - ', event_name, ' - ', place, ' ', city, '. Castells: ', {items}) AS text"))
    shows = shows.select(F.lit("event").alias("kind"), F.concat_ws("-", F.col("event_id"), F.col("group_id")).alias("key"), "group_name", "text")
    wiki = retrieval.group_texts(roles.group_texts(s, d), groups)
    bench = roles.table(s, d, "benchmark")
    general = bench.select(F.lit("general").alias("kind"), F.col("item_id").cast("string").alias("key"), F.col("text"))
    as_json = F.when(F.col("item_id") % 2 == 0, F.to_json(F.array("text", F.lit("too short")))).otherwise(F.to_json(F.create_map(F.lit("info1"), F.col("text"))))
    contest = retrieval.paragraphs(bench.select(F.col("item_id").alias("id"), as_json.alias("json"))).select(F.lit("contest").alias("kind"), F.concat_ws("-", F.col("id"), F.col("pos")).alias("key"), "text")
    out = info
    for part in (wiki, best, shows, general, contest):
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def hybrid_context(s, d):
    """Questions for years with and without events: the best event, else a document."""
    perf = materialize(scoring.performances(s, d), "hybrid-performances")
    years = perf.select("event_year").distinct()
    questions = years.select(F.col("event_year").alias("qid")).union(years.select(F.col("event_year") + 5)).distinct()
    best = scoring.event_totals(perf).groupBy(F.year("event_date").alias("qid")).agg(F.max_by(F.concat_ws(" ", "event_name", "group_name", F.col("total_points")), F.struct("total_points", (-F.col("event_id")).alias("e"), (-F.col("group_id")).alias("g"))).alias("report"))
    docs = roles.table(s, d, "documents").select((F.col("doc_id") + 2000).cast("int").alias("qid"), F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("docs"))
    return retrieval.hybrid(best, docs, questions)


def group_chunks(s, d):
    g = roles.groups(s, d)
    # a group's three best are cut before they are gathered: its items grow with the tables
    order = Window.partitionBy("group_id").orderBy(F.desc("points"), "item_name")
    items = scoring.performances(s, d).filter("points > 0").select("group_id", "points", "item_name").distinct()
    top = items.withColumn("rn", F.row_number().over(order)).filter("rn <= 3")
    best = top.groupBy("group_id").agg(F.sort_array(F.collect_list(F.struct("rn", "item_name"))).alias("b"))
    facts = F.map_from_arrays(F.array(F.lit("Sobrenom"), F.lit("Creació"), F.lit("Local")), F.array(F.concat(F.lit("the "), F.lower("group_name"), F.lit("[2]")), F.concat(F.lit("19"), F.lpad(F.col("group_id").cast("string"), 2, "0")), F.lit("")))
    joined = g.join(best, "group_id", "left")
    rows = joined.select("group_name", F.concat("group_name", F.lit("  is a [1] group [cal citació]")).alias("description"), F.array(F.lit("## Head"), F.concat(F.lit("More  on "), "group_name")).alias("info"), F.coalesce(F.transform("b", lambda x: x["item_name"]), F.array().cast("array<string>")).alias("best"), facts.alias("facts"))
    return retrieval.group_chunks(rows)


def _rounded(col, alias):
    return F.transform(col, lambda x: F.round(x, 6) + F.lit(0.0)).alias(alias)


#: Of fifty lists: the vectors of the tables are near isotropic, so that most lists hold neighbours.
PROBES = 44


def vector_ivf(s, d):
    """Every row whose id is divisible by 50 against a stored inverted file."""
    store = Store(s, scratch_path(s, "vectors"))
    vector_store.create(store, "vectors", _vectors(s, d))
    queries = _vectors(s, d).filter("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("vec").alias("qvec"))
    return vector_store.search(store, "vectors", queries, 10, PROBES)


def vector_store_written(s, d):
    """Chunks of documents with their vector and what they come from, written in two batches, one of them twice, and read back."""
    store = Store(s, scratch_path(s, "chunks"))
    docs = roles.table(s, d, "documents")
    about = docs.select("doc_id", F.lit("documents").alias("source_table"), F.col("source").alias("category"))
    chunks = retrieval.chunks(docs).join(about, "doc_id").join(_vectors(s, d), F.col("doc_id") == F.col("id"))
    rows = chunks.select((F.col("doc_id") * 100_000 + F.col("chunk_index")).alias("id"), "vec", "source_table", F.col("doc_id").cast("string").alias("source_pk"), "category", "chunk_index", F.col("n_words").alias("chunk_length_words"), F.col("chunk").alias("chunk_text"))
    rows = materialize(rows, "chunk-rows")
    even = F.col("source_pk").cast("long") % 2 == 0
    vector_store.create(store, "chunks", rows.filter(even), lists=16)
    for _ in range(2):
        vector_store.append(store, "chunks", rows.filter(~even), "odd")
    stored = store.read("chunks")
    return stored.select("source_table", "source_pk", "category", "chunk_index", "chunk_length_words", F.md5(F.col("chunk_text").cast("binary")).alias("text_md5"), F.size("vec").alias("dimensions"))


QUERIES = {
    "chunk_table": lambda s, d: retrieval.chunks(roles.table(s, d, "documents")),
    "chunk_arrays": chunk_arrays,
    "doc_assemble": doc_assemble,
    "group_chunks": group_chunks,
    "vector_normalize": lambda s, d: _vectors(s, d).select("id", _rounded(retrieval.normalized(F.transform("vec", lambda x: x * F.col("id"))), "unit")),
    "vector_combine": lambda s, d: _vectors(s, d).alias("a").join(_vectors(s, d).alias("b"), F.col("a.id") + 1 == F.col("b.id")).select("a.id", _rounded(retrieval.combined(F.col("a.vec"), F.col("b.vec")), "unit")),
    "vector_topk": lambda s, d: retrieval.top_k(_vectors(s, d), _queries(s, d, 1), 20),
    "vector_topk_batch": lambda s, d: retrieval.top_k(_vectors(s, d), _queries(s, d, 10), 10),
    "vector_topk_each": lambda s, d: retrieval.top_k_blocks(_vectors(s, d), _vectors(s, d).filter("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("vec").alias("qvec")), 10),
    "vector_raw_floor": lambda s, d: retrieval.above(retrieval.top_k_blocks(_vectors(s, d), _vectors(s, d).filter("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("vec").alias("qvec")), 350).filter("id <> query_id")),
    "vector_ivf": vector_ivf,
    "vector_store": vector_store_written,
    "rerank": _reranked,
    "rerank_each": _reranked_each,
    "context_each": lambda s, d: retrieval.context_each(_reranked_each(s, d), roles.table(s, d, "documents").select("doc_id", "text")),
    "rerank_fuzzy": lambda s, d: _reranked(s, d, similar=True),
    "context_build": lambda s, d: retrieval.context(_reranked(s, d), roles.table(s, d, "documents").select("doc_id", "text")),
    "hybrid_context": hybrid_context,
}

_COS = lambda a, b: f"list_dot_product({a}::DOUBLE[], {b}::DOUBLE[]) / sqrt(list_dot_product({a}::DOUBLE[], {a}::DOUBLE[]) * list_dot_product({b}::DOUBLE[], {b}::DOUBLE[]))"
_TOP = lambda n, k, where="true": f"SELECT q.vec_id AS query_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS('e.embedding', 'q.embedding')} DESC, e.vec_id) AS rank, e.vec_id AS id, round({_COS('e.embedding', 'q.embedding')}, 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id < {n} AND {where} QUALIFY rank <= {k}"
_EACH = lambda k: _TOP(0, k).replace("q.vec_id < 0", "q.vec_id % 50 = 0")
_RERANK = f"""WITH top AS ({_TOP(1, 50, "e.vec_id > 0")}),
f AS (SELECT top.id, score, 'Doc ' || doc_id AS title, CASE doc_id % 3 WHEN 0 THEN 'history' WHEN 1 THEN 'colles' ELSE 'technique' END AS category, source, lang, doc_id % 30 + 1970 AS y FROM top JOIN documents ON doc_id = id),
m AS (SELECT *, contains(lower(source), 'src3') OR contains('src3', lower(source)) AS is_match,
  (SELECT count(*) FROM (SELECT unnest(['història', 'src3', 'als', 'anys']) AS w) WHERE contains(lower(lang), w) OR contains(w, lower(lang)) OR contains('historia', w) OR contains(w, 'historia') OR contains(lower(source), w) OR contains(w, lower(source))) AS k FROM f),
r AS (SELECT id, title, is_match, round(least(1.0, score + CASE WHEN is_match THEN 0.35 ELSE 0 END + CASE WHEN y BETWEEN 1980 AND 1989 THEN 0.2 + 0.1 ELSE 0 END + CASE WHEN k > 1 THEN 0.15 + (least(k, 4) - 1) * 0.15 WHEN k = 1 THEN 0.1 ELSE 0 END + CASE WHEN category = 'history' THEN 0.15 ELSE 0 END + CASE WHEN lang = 'fr' THEN 0.15 ELSE 0 END), 6)::DOUBLE AS score FROM m),
reranked AS (SELECT * FROM r WHERE score >= 0.005) """

_RERANK_EACH = f"""WITH top AS ({_EACH(51)}),
q AS (SELECT doc_id AS query_id, doc_id // 50 % 3 AS kind, source AS qs, lang AS ql, doc_id % 30 + 1970 AS qy FROM documents WHERE doc_id % 50 = 0),
a AS (SELECT query_id, CASE kind WHEN 0 THEN 'Història de ' || qs || ' als anys 80 a ' || ql WHEN 1 THEN 'Quina és la tècnica i l''estructura dels castells?' ELSE 'El concurs de ' || qy || ' i ' || qs END AS question, CASE kind WHEN 0 THEN [lower(qs)] ELSE [] END AS gs, CASE kind WHEN 0 THEN range(1980, 1990) WHEN 2 THEN [qy] ELSE [] END AS ys, CASE kind WHEN 0 THEN [lower(ql)] ELSE [] END AS ps FROM q),
w AS (SELECT *, list_filter(regexp_extract_all(lower(coalesce(question, '')), '[\\p{{L}}\\p{{N}}_]+'), lambda x: len(x) > 2 AND NOT list_contains({list(retrieval.STOP_WORDS)}, x)) AS ws, CASE WHEN contains(lower(question), 'història') THEN 'history' WHEN contains(lower(question), 'tècnic') THEN 'technique' WHEN contains(lower(question), 'concurs') THEN 'concurs' END AS about FROM a),
f AS (SELECT top.query_id, top.id, score, 'Doc ' || doc_id AS title, CASE doc_id % 3 WHEN 0 THEN 'history' WHEN 1 THEN 'colles' ELSE 'technique' END AS category, lower(source) AS source, lower(lang) AS lang, doc_id % 30 + 1970 AS y, gs, ys, ps, ws, about FROM top JOIN documents ON doc_id = id JOIN w ON w.query_id = top.query_id WHERE top.id <> top.query_id),
m AS (SELECT *, len(list_filter(gs, lambda g: contains(source, g) OR contains(g, source))) AS named, len(list_filter(ws, lambda x: contains(lang, x) OR contains(x, lang) OR contains('historia', x) OR contains(x, 'historia') OR contains(source, x) OR contains(x, source))) AS k FROM f),
r AS (SELECT query_id, id, title, named > 0 AS is_match, round(least(1.0, score + named * 0.35 + CASE WHEN list_contains(ys, y) THEN 0.2 + 0.1 ELSE 0 END + CASE WHEN k > 1 THEN 0.15 + (least(k, 4) - 1) * 0.15 WHEN k = 1 THEN 0.1 ELSE 0 END + CASE WHEN category = about THEN 0.15 ELSE 0 END + CASE WHEN list_contains(ps, lang) THEN 0.15 ELSE 0 END - CASE WHEN len(gs) = 0 AND category = 'colles' THEN 0.2 ELSE 0 END), 6)::DOUBLE AS score FROM m),
reranked AS (SELECT * FROM r WHERE score >= 0.005) """

SQL = {
    "chunk_table": r"WITH w AS (SELECT doc_id, regexp_extract_all(text, '[^ \t\n\r\f\x0B]+') AS ws FROM documents), s AS (SELECT doc_id, ws, unnest(CASE WHEN len(ws) <= 200 THEN [0] ELSE range(0, len(ws) - 50, 150) END) AS start FROM w WHERE len(ws) > 0) SELECT doc_id, (start // 150)::INTEGER AS chunk_index, len(ws[start + 1:start + 200])::INTEGER AS n_words, array_to_string(ws[start + 1:start + 200], ' ') AS chunk FROM s",
    "chunk_arrays": "SELECT 'c' || doc_id AS id, upper(source) AS title, (doc_id % 50 + 1950)::INTEGER AS first_year, 2 AS n_years, source || ',' || lang AS colles FROM documents",
    "doc_assemble": R("totals") + ", best AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY total_points DESC, event_id) AS rank FROM totals QUALIFY rank <= 5) SELECT 'info' AS kind, group_id::VARCHAR AS key, group_name, 'code: ' || group_id AS text FROM grp UNION ALL SELECT 'performance', group_id || '-' || rank, group_name, 'Actuació (rank ' || rank || ') - ' || event_date || ' - ' || place || ' - ' || event_name || '. Actuació: ' || items_done || '. Punts: ' || total_points FROM best UNION ALL SELECT 'event', event_id || '-' || group_id, group_name, date_text || ' - ' || event_name || ' - ' || place || ' ' || city || '. Castells: ' || string_agg(item_name || ' (' || status || ')', '; ' ORDER BY attempt_id) FROM perf GROUP BY event_id, group_id, group_name, date_text, event_name, place, city UNION ALL SELECT 'wiki', doc_id::VARCHAR, group_name, coalesce(text, '') FROM documents JOIN grp ON doc_id % 25 = group_id UNION ALL SELECT 'general', item_id::VARCHAR, NULL, text FROM benchmark UNION ALL SELECT 'contest', item_id || '-0', NULL, text FROM benchmark WHERE len(regexp_extract_all(text, '[^ \\t\\n\\r\\f]+')) >= 15",
    "group_chunks": R("perf") + ", b AS (SELECT group_id, array_to_string(list(item_name ORDER BY points DESC, item_name)[1:3], ', ') AS best FROM (SELECT DISTINCT group_id, points, item_name FROM perf WHERE points > 0) GROUP BY 1), g AS (SELECT * FROM grp LEFT JOIN b USING (group_id)) SELECT 'colla_' || lower(group_name) || '_info' AS id, group_name || ' - Informació general' AS title, group_name || ' is a group More on ' || group_name AS text FROM g UNION ALL SELECT 'colla_' || lower(group_name) || '_stats', group_name || ' - Estadístiques i dades', concat_ws(' ', 'Els millors castells de ' || group_name || ' són: ' || best || '.', group_name || ':', 'El sobrenom és the ' || lower(group_name) || '.', 'Va ser creada l''any 19' || lpad(group_id::VARCHAR, 2, '0') || '.') FROM g",
    "vector_normalize": "SELECT vec_id AS id, list_transform(embedding, lambda x: round(x::DOUBLE * vec_id / CASE WHEN vec_id = 0 THEN 1e-9 ELSE sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * vec_id END, 6) + 0.0::DOUBLE) AS unit FROM embeddings",
    "vector_combine": "WITH c AS (SELECT a.vec_id AS id, list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::DOUBLE * 0.2 + z[2]::DOUBLE * 0.8) AS v FROM embeddings a JOIN embeddings b ON a.vec_id + 1 = b.vec_id) SELECT id, list_transform(v, lambda x: round(x / sqrt(list_dot_product(v, v)), 6) + 0.0::DOUBLE) AS unit FROM c",
    "vector_topk": _TOP(1, 20),
    "vector_topk_batch": _TOP(10, 10),
    "vector_topk_each": _EACH(10),
    "vector_store": "WITH w AS (SELECT doc_id, source, regexp_extract_all(text, '[^ \\t\\n\\r\\f\\x0B]+') AS ws FROM documents), s AS (SELECT doc_id, source, ws, unnest(CASE WHEN len(ws) <= 200 THEN [0] ELSE range(0, len(ws) - 50, 150) END) AS start FROM w WHERE len(ws) > 0) SELECT 'documents' AS source_table, doc_id::VARCHAR AS source_pk, source AS category, (start // 150)::INTEGER AS chunk_index, len(ws[start + 1:start + 200])::INTEGER AS chunk_length_words, md5(array_to_string(ws[start + 1:start + 200], ' ')) AS text_md5, len(embedding)::INTEGER AS dimensions FROM s JOIN embeddings ON vec_id = doc_id",
    "vector_raw_floor": f"WITH t AS ({_EACH(350)}) SELECT query_id, id, score FROM t WHERE id <> query_id AND score >= 0.2 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 2",
    "rerank_each": _RERANK_EACH + "SELECT * FROM reranked",
    "context_each": _RERANK_EACH + ", t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY is_match DESC, score DESC, id) AS n FROM reranked QUALIFY n <= 2) SELECT query_id, string_agg('[Document ' || n || ': ' || title || ']' || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY n) AS context, count(*) AS documents FROM t JOIN documents ON doc_id = id GROUP BY query_id",
    "rerank": _RERANK + "SELECT * FROM reranked",
    "context_build": _RERANK + ", t AS (SELECT *, row_number() OVER (ORDER BY is_match DESC, score DESC, id) AS n FROM reranked QUALIFY n <= 2) SELECT string_agg('[Document ' || n || ': ' || title || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY n) AS context, count(*) AS documents FROM t JOIN documents ON doc_id = id",
    "hybrid_context": R("totals") + ", y AS (SELECT DISTINCT year(event_date)::INTEGER AS y FROM ev WHERE event_id IN (SELECT event_id FROM att)), q AS (SELECT y AS qid FROM y UNION SELECT y + 5 FROM y), b AS (SELECT year(event_date)::INTEGER AS qid, event_name || ' ' || group_name || ' ' || total_points AS report FROM totals QUALIFY row_number() OVER (PARTITION BY year(event_date) ORDER BY total_points DESC, event_id, group_id) = 1) SELECT qid, CASE WHEN report IS NOT NULL THEN 'report' WHEN doc_id IS NOT NULL THEN 'documents' ELSE 'none' END AS source, coalesce(report, 'Doc ' || doc_id) AS context FROM q LEFT JOIN b USING (qid) LEFT JOIN documents ON doc_id + 2000 = qid",
}
