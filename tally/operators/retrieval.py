"""Documents, chunks, vectors and their ranking."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tally.functions import fuzzy, parse

CHUNK_WORDS, OVERLAP = 200, 50
TITLE_WEIGHT, TEXT_WEIGHT = 0.2, 0.8
LEAST_NORM = 1e-9
LEAST_PARAGRAPH = 15
#: What a task of the blocked search holds of its best rows.
HELD_ROWS = 1 << 19
#: The boosts of the ranking. Fixed values.
GROUP_BOOST, YEAR_BOOST, MOST_YEARS, RANGE_BOOST, CATEGORY_BOOST, PLACE_BOOST, GROUP_PENALTY = 0.35, 0.2, 3, 0.1, 0.15, 0.15, 0.2
LEAST_SCORE = 0.005
STOP_WORDS = ("el", "la", "els", "les", "un", "una", "de", "del", "a", "amb", "per", "que", "és", "i", "o")
SIMILAR_KEYWORD = 0.7


def chunks(docs: DataFrame, size: int = CHUNK_WORDS, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, chunk_index, n_words, chunk): windows of `size` words that share `overlap`; the last one ends the
    text; a text without words has no chunk."""
    words = F.array_remove(F.split("text", r"[ \t\n\r\f\x0B]+"), "")
    n = F.size("words")
    starts = F.when(n <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), n - overlap - 1, F.lit(size - overlap)))
    each = docs.select("doc_id", words.alias("words")).filter(n > 0).select("doc_id", "words", F.posexplode(starts).alias("chunk_index", "start"))
    part = F.slice("words", F.col("start") + 1, size)
    return each.select("doc_id", "chunk_index", F.size(part).alias("n_words"), F.array_join(part, " ").alias("chunk"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def normalized(v: Column) -> Column:
    """The vector over its length; one of length zero over 1e-9."""
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x.cast("double") / F.when(norm == 0, F.lit(LEAST_NORM)).otherwise(norm))


def combined(title: Column, text: Column) -> Column:
    return normalized(F.zip_with(title, text, lambda x, y: x.cast("double") * TITLE_WEIGHT + y.cast("double") * TEXT_WEIGHT))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def vector_columns(df: DataFrame) -> DataFrame:
    """(id, vec) of a table that calls them by one of several names; vectors may be text; what is none goes."""
    first = lambda *names: next(c for c in names if c in df.columns)
    name = first("embedding", "vector")
    vec = F.from_json(name, "array<double>") if dict(df.dtypes)[name] == "string" else F.col(name)
    return df.select(F.col(first("vec_id", "source_pk", "pk")).alias("id"), vec.alias("vec")).filter("vec IS NOT NULL")


def top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, id, score): the k vectors of largest cosine for each of a few queries (query_id, qvec);
    whether they are sent to all vectors whole is left to Spark's own check of their size, and each task keeps k of them
    before the shuffle. top_k_blocks is for sets that grow."""
    scored = vectors.crossJoin(queries).select("query_id", "id", cosine(F.col("vec"), F.col("qvec")).alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "id", F.round("score", 6).alias("score"))


BLOCK_ROWS = 2048


def query_rows(k: int) -> int:
    """How many queries a block has: so few that the k best of each leave room among the rows that a task holds."""
    return max(1, min(BLOCK_ROWS, HELD_ROWS // (4 * k)))


def _blocks(vectors: DataFrame, id_col: str, vec_col: str, most: int = BLOCK_ROWS) -> DataFrame:
    """vectors of one length as rows of `most` at most: their ids, and their units one after another."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, most):
                batch = whole.slice(at, most)
                ids = batch.column("id").to_numpy().astype(np.int64)
                flat = batch.column("vec").flatten().to_numpy(zero_copy_only=False)
                rows = flat.reshape(len(ids), -1)
                units = rows / np.sqrt((rows * rows).sum(axis=1))[:, None]
                yield pa.RecordBatch.from_pydict({"ids": [ids.tobytes()], "units": [units.tobytes()]})

    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    return rows.mapInArrow(pack, "ids binary, units binary")


def _cut(found: list[tuple], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query, by score and then by id."""
    query, ids, score = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((ids, -score, query))
    q, n = query[order], np.arange(len(order))
    first = np.ones(len(q), bool)
    first[1:] = q[1:] != q[:-1]
    keep = order[n - np.maximum.accumulate(np.where(first, n, 0)) < k]
    return query[keep], ids[keep], score[keep]


def best_of_blocks(k: int) -> Callable:
    """A function for mapInArrow: (query_id, id, score) of the k rows of largest product for each query, of all pairs of blocks
    (ids, units, q_ids, q_units) that a task meets. A task holds HELD_ROWS of them at most: beyond, it cuts them to the best, and gives
    them away if that does not halve them."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch_of = lambda found: pa.RecordBatch.from_pydict(dict(zip(("query_id", "id", "score"), map(pa.array, found))))
        held, n = [], 0
        for batch in batches:
            for i in range(batch.num_rows):  # one pair of blocks at a time, not copied
                ids, units, q_ids, q_units = (batch.column(c)[i].as_buffer() for c in ("ids", "units", "q_ids", "q_units"))
                ids, q_ids = np.frombuffer(ids, np.int64), np.frombuffer(q_ids, np.int64)
                scores = np.frombuffer(q_units).reshape(len(q_ids), -1) @ np.frombuffer(units).reshape(len(ids), -1).T
                least = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(q_ids), -np.inf)
                query, row = np.nonzero(scores >= least[:, None])
                held.append((q_ids[query], ids[row], scores[query, row]))
                n += len(query)
                if n > HELD_ROWS:
                    held = [_cut(held, k)]
                    n = len(held[0][0])
                    if n > HELD_ROWS // 2:
                        yield batch_of(held[0])
                        held, n = [], 0
        if held:
            yield batch_of(_cut(held, k))

    return meet


def top_k_blocks(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """As top_k, for a query set that grows with the table: blocks of queries meet blocks of vectors, each pair by one
    product of matrices. The queries come first, so that a task is through with a block of them when it takes the next, and gives k rows
    for each query, not for each pair of blocks. No side is broadcast whole."""
    asked = _blocks(queries, "query_id", "qvec", query_rows(k)).toDF("q_ids", "q_units")
    found = asked.crossJoin(_blocks(vectors, "id", "vec")).mapInArrow(best_of_blocks(k), "query_id long, id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "id", F.round("score", 6).alias("score"))


def above(found: DataFrame, least: float = 0.2, most: int = 2) -> DataFrame:
    """(query_id, id, score) of the raw retrieval: the best `most` of found whose score is `least` or more."""
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    enough = found.filter(F.col("score") >= least)
    return enough.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= most).select("query_id", "id", "score")


def question_words(question: Column) -> Column:
    """The words of a question that say something."""
    return F.filter(F.regexp_extract_all(F.lower(question), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda w: ~w.isin(*STOP_WORDS) & (F.length(w) > 2))


def about(question: Column) -> Column:
    """The category of documents that a question is about, if it says so."""
    says = lambda *words: reduce(Column.__or__, [F.contains(F.lower(question), F.lit(w)) for w in words])
    return F.when(says("història", "origen"), "history").when(says("tècnic", "estructura"), "technique").when(says("concurs"), "concurs")


def rerank(found: DataFrame, question: str, groups: list[str], years: list[int], places: list[str], similar: bool = False) -> DataFrame:
    """rerank_each() for one question: (id, title, is_match, score)."""
    texts = lambda values: F.lit(list(values)).cast("array<string>")
    asked = {"query_id": F.lit(0), "question": F.lit(question), "asked_groups": texts(groups), "asked_years": F.lit(list(map(int, years))).cast("array<int>"), "asked_places": texts(places)}
    return rerank_each(found.withColumns(asked), similar).drop("query_id")


def rerank_each(found: DataFrame, similar: bool = False) -> DataFrame:
    """(query_id, id, title, is_match, score) of what is found for many questions at once: found (query_id, question, asked_groups,
    asked_years, asked_places, id, score, title, category, groups, years, year_ranges, keywords, places) by score and
    boosts: groups named on either side, years, ranges that name one of them, keywords, the category that the question
    is about and places. At most 1; documents of a named group come first. Null lists are empty ones, a null question says nothing."""
    low = lambda c: F.transform(F.coalesce(c, F.array().cast("array<string>")), F.lower)
    wanted_groups, doc_groups = low(F.col("asked_groups")), low(F.col("groups"))
    named = F.size(F.filter(wanted_groups, lambda g: F.exists(doc_groups, lambda x: F.contains(x, g) | F.contains(g, x))))
    wanted_years = F.coalesce("asked_years", F.array().cast("array<int>"))
    hits = F.size(F.array_intersect(F.coalesce("years", F.array().cast("array<int>")), wanted_years))
    in_range = F.exists(low(F.col("year_ranges")), lambda r: F.exists(wanted_years, lambda y: F.contains(r, y.cast("string"))))
    words, keywords = question_words(F.coalesce("question", F.lit(""))), low(F.col("keywords"))
    alike = lambda w, k: F.contains(k, w) | F.contains(w, k)
    matched = F.size(F.filter(words, lambda w: F.exists(keywords, lambda k: alike(w, k))))
    if similar:
        # the matcher cannot run inside a lambda; pairs of words are scored as rows and joined back
        pairs = found.select("query_id", "id", F.explode(words).alias("w"), keywords.alias("ks")).select("query_id", "id", "w", F.explode("ks").alias("k"))
        close = pairs.filter(alike(F.col("w"), F.col("k")) | (fuzzy.sequence_ratio("w", "k") > SIMILAR_KEYWORD)).groupBy("query_id", "id").agg(F.count_distinct("w").alias("matched"))
        found, matched = found.join(close, ["query_id", "id"], "left"), F.coalesce("matched", F.lit(0))
    by_words = F.when(matched > 1, 0.15 + (F.least(matched, F.lit(4)) - 1) * 0.15).when(matched == 1, 0.1).otherwise(0.0)
    boost = named * GROUP_BOOST + F.least(hits, F.lit(MOST_YEARS)) * YEAR_BOOST + F.when(in_range, RANGE_BOOST).otherwise(0.0) + by_words
    boost = boost + F.when(F.col("category") == about(F.col("question")), CATEGORY_BOOST).otherwise(0.0)
    boost = boost + F.when(F.size(F.array_intersect(low(F.col("places")), low(F.col("asked_places")))) > 0, PLACE_BOOST).otherwise(0.0)
    boost = boost - F.when((F.size(wanted_groups) == 0) & (F.col("category") == "colles"), GROUP_PENALTY).otherwise(0.0)
    scored = found.select("query_id", "id", "title", (named > 0).alias("is_match"), F.round(F.least(F.col("score") + boost, F.lit(1.0)), 6).alias("score"))
    return scored.filter(F.col("score") >= LEAST_SCORE)


def context_each(ranked: DataFrame, texts: DataFrame, k: int = 2) -> DataFrame:
    """(query_id, context, documents): context() for each question of ranked (query_id, id, title, is_match, score)."""
    order = Window.partitionBy("query_id").orderBy(F.desc("is_match"), F.desc("score"), "id")
    top = ranked.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k)
    part = "concat('[Document ', n, ': ', title, ']\n', coalesce(text, ''))"
    return top.join(texts, top["id"] == texts["doc_id"]).groupBy("query_id").agg(F.expr(f"listagg({part}, '\n\n') WITHIN GROUP (ORDER BY n) AS context"), F.count("*").alias("documents"))


def context(ranked: DataFrame, texts: DataFrame, k: int = 2) -> DataFrame:
    """The text that is handed on: the first k documents with their titles, those of a named group first."""
    order = [F.desc("is_match"), F.desc("score"), F.col("id")]
    top = ranked.orderBy(*order).limit(k).withColumn("n", F.row_number().over(Window.orderBy(*order)))
    joined = top.join(texts, top["id"] == texts["doc_id"])
    part = "concat('[Document ', n, ': ', title, ']\n', text)"
    return joined.agg(F.expr(f"listagg({part}, '\n\n') WITHIN GROUP (ORDER BY n) AS context"), F.count("*").alias("documents"))


def hybrid(report: DataFrame, docs: DataFrame, questions: DataFrame) -> DataFrame:
    """(qid, source, context): the report's text for each question, or the documents' where it has none."""
    joined = questions.join(report, "qid", "left").join(docs, "qid", "left")
    return joined.select("qid", F.when(F.col("report").isNotNull(), "report").when(F.col("docs").isNotNull(), "documents").otherwise("none").alias("source"), F.coalesce("report", "docs").alias("context"))


def group_texts(texts: DataFrame, groups: DataFrame) -> DataFrame:
    """(kind, key, group_name, text): texts (text_id, group_id, text) as documents of their groups; a null text is empty."""
    text = F.coalesce("text", F.lit("")).alias("text")
    return texts.join(groups, "group_id").select(F.lit("wiki").alias("kind"), F.col("text_id").cast("string").alias("key"), "group_name", text)


def paragraphs(rows: DataFrame) -> DataFrame:
    """(id, pos, text): paragraphs of at least 15 words of JSON that is a list of texts, of maps, or one map."""
    as_map = "map<string, string>"
    listed = F.from_json("json", "array<string>")
    mapped = F.map_values(F.from_json("json", as_map))
    texts = F.when(F.col("json").startswith("["), listed).otherwise(mapped)
    each = rows.select("id", F.posexplode(texts).alias("pos", "text"))
    return each.filter(F.size(F.array_remove(F.split("text", r"\s+"), "")) >= LEAST_PARAGRAPH)


#: Sentences of a group's facts, in their order. Fixed values.
FACTS = (("Sobrenom", "El sobrenom és {}"), ("Tipus", "És una {}"), ("Color camisa", "El color de camisa és {}"), ("Creació", "Va ser creada l'any {}"), ("Bateig", "El bateig va ser {}"), ("Diada destacada", "La seva diada destacada és {}"), ("Millors castells", "Els seus millors castells són {}"), ("Millor actuació", "La seva millor actuació va ser {}"), ("Concurs", "Al Concurs de Castells: {}"), ("Local", "El local és a {}"), ("Presidència", "La presidència: {}"), ("Cap de colla", "El cap de colla és {}"), ("Lloc web", "Lloc web: {}"), ("Data de dissolució o abolició", "Es va dissoldre l'any {}"))


def group_chunks(groups: DataFrame) -> DataFrame:
    """Two chunks for each group (group_name, description, info, best, facts): what it is, and its best items and
    facts as sentences. Chunks without text go."""
    clean = parse.without_citations
    info = F.array_join(F.transform(F.filter("info", lambda p: ~p.startswith("##") & (p != "")), clean), " ")
    about = F.trim(F.concat_ws(" ", clean(F.col("description")), info))

    def fact(name: str, sentence: str) -> Column:
        value = clean(F.try_element_at("facts", F.lit(name)))
        before, after = sentence.split("{}")
        return F.when(value != "", F.concat(F.lit(before), value, F.lit(after + ".")))

    best = F.when(F.size("best") > 0, F.concat(F.lit("Els millors castells de "), "group_name", F.lit(" són: "), F.array_join("best", ", "), F.lit(".")))
    facts = F.concat_ws(" ", F.concat("group_name", F.lit(":")), *[fact(n, s) for n, s in FACTS])
    stats = F.concat_ws(" ", best, F.when(F.size("facts") > 0, facts))
    one = lambda suffix, title, text: F.struct(parse.slug(F.col("group_name"), suffix).alias("id"), F.concat("group_name", F.lit(f" - {title}")).alias("title"), text.alias("text"))
    both = F.explode(F.array(one("info", "Informació general", about), one("stats", "Estadístiques i dades", stats))).alias("c")
    return groups.select(both).select("c.*").filter("text <> ''")
