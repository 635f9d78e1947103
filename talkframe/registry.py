"""Named queries over the driver tables: which table stands for what, and which operator runs.

Each entry takes (spark, sf_dir) and returns a DataFrame; double columns are rounded to
``topk.SCORE_DIGITS`` decimals for comparison with the SQL oracle (``talkframe.oracle``).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import sparse
from .operators.topk import SCORE_DIGITS
from .tables import table

REGISTRY: dict = {}


def query(name):
    def deco(fn):
        REGISTRY[name] = fn
        return fn
    return deco


def r6(col):
    # "+ 0.0" turns a rounded -0.0 into 0.0 so that equal values hash equally
    return F.round(col, SCORE_DIGITS) + F.lit(0.0)


# ---------------------------------------------------------------- sparse search (2C, 2D)

def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents stand for the transcript chunks (id, text) with lang/source keyword fields."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), "text", "lang", "source")


def bench_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"),
                                                    F.col("text").alias("query"))


def _hits(h: DataFrame) -> DataFrame:
    return h.select("qid", "doc_id", r6(F.col("score")).alias("score"), "rank")


@query("tfidf_search")
def tfidf_search(spark, sf_dir):
    """C1 + E1: benchmark texts against all documents, boost text 3.0, top 10."""
    idx = sparse.fit(corpus(spark, sf_dir), ["text"], ["lang", "source"])
    return _hits(sparse.search(idx, bench_queries(spark, sf_dir), boost_dict={"text": 3.0},
                               num_results=10))


@query("tfidf_search_filtered")
def tfidf_search_filtered(spark, sf_dir):
    """B1: keyword filter lang = 'de' applied before scoring; IDF from the whole corpus."""
    idx = sparse.fit(corpus(spark, sf_dir), ["text"], ["lang", "source"])
    return _hits(sparse.search(idx, bench_queries(spark, sf_dir), filter_dict={"lang": "de"},
                               boost_dict={"text": 3.0}, num_results=10))


def bench_queries_with_source(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("qid"),
                    F.concat_ws(" ", "text", F.concat(F.lit("src"),
                                (F.col("item_id") % 20).cast("string"))).alias("query"))


@query("tfidf_search_multifield")
def tfidf_search_multifield(spark, sf_dir):
    """D3: two text fields, text boosted 3, source with the default boost 1."""
    idx = sparse.fit(corpus(spark, sf_dir), ["text", "source"], ["lang"])
    return _hits(sparse.search(idx, bench_queries_with_source(spark, sf_dir),
                               boost_dict={"text": 3.0}, num_results=10))


@query("tfidf_search_params")
def tfidf_search_params(spark, sf_dir):
    """Vectoriser parameters min_df=2 and sublinear_tf."""
    idx = sparse.fit(corpus(spark, sf_dir), ["text"], [],
                     params={"min_df": 2, "sublinear_tf": True})
    return _hits(sparse.search(idx, bench_queries(spark, sf_dir), num_results=10))


@query("tfidf_idf")
def tfidf_idf(spark, sf_dir):
    """Document frequency and smoothed IDF per term."""
    idx = sparse.fit(corpus(spark, sf_dir), ["text"], [])
    return idx.idf.select("field", "term", "df", r6(F.col("idf")).alias("idf"))


@query("tfidf_postings")
def tfidf_postings(spark, sf_dir):
    """Term frequency, tf*idf weight, document norm and unit weight per posting."""
    idx = sparse.fit(corpus(spark, sf_dir), ["text"], [])
    return idx.postings.select("doc_id", "term", F.col("tf").cast("bigint").alias("tf"),
                               r6(F.col("w")).alias("w"), r6(F.col("norm")).alias("norm"),
                               r6(F.col("wn")).alias("wn"))


@query("tokenize")
def tokenize_docs(spark, sf_dir):
    """H1: the vectoriser's tokens of every whole document, rendered as one string."""
    from .functions.text import tokenize
    d = table(spark, sf_dir, "documents")
    t = d.select("doc_id", tokenize(F.col("text")).alias("toks"))
    return t.select("doc_id", F.size("toks").cast("bigint").alias("n_tokens"),
                    F.array_join("toks", " ").alias("tokens"))


@query("search_with_text")
def search_with_text(spark, sf_dir):
    """Top-5 hits, then the payload text joined to the hits only."""
    idx = sparse.fit(corpus(spark, sf_dir), ["text"], [])
    q = bench_queries(spark, sf_dir)
    hits = sparse.search(idx, q, boost_dict={"text": 3.0}, num_results=5)
    return sparse.attach_text(_hits(hits), idx, max_rows=5 * q.count()).select(
        "qid", "doc_id", "score", "rank", "text")


@query("tfidf_search_two_episodes")
def tfidf_search_two_episodes(spark, sf_dir):
    """D2 + A9: sentences numbered per conversation (an episode each) in one index; the key is
    (conv_id, chunk id), as chunk ids repeat over episodes."""
    from .operators import transcript
    c = transcript.renumber_chunks(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")
    idx = sparse.fit(c, ["text"], [], id_col=["conv_id", "id"])
    return _hits(sparse.search(idx, bench_queries(spark, sf_dir), boost_dict={"text": 3.0}, num_results=5))


# ---------------------------------------------------------------- dense search (2C, 2D, 2J)

HASH_DIMS = 64


def vectors(spark, sf_dir):
    """embeddings stand for the chunk vectors; every vector is also a query (self-search)."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"), "label")


def vector_queries(spark, sf_dir):
    return vectors(spark, sf_dir).withColumnRenamed("doc_id", "qid")


def _dhits(h):
    return h.select("qid", "doc_id", r6(F.col("score")).alias("score"), "rank")


@query("dense_search_exact")
def dense_search_exact(spark, sf_dir):
    """Exact cosine + 1.0 (search-server script score), top 5 of every vector."""
    from .operators import dense
    return _dhits(dense.search(vector_queries(spark, sf_dir), vectors(spark, sf_dir), k=5,
                               metric="cos_plus_one"))


@query("dense_search_distance")
def dense_search_distance(spark, sf_dir):
    """C4 exact path: cosine distance 1 - cos ascending, top 5."""
    from .operators import dense
    return _dhits(dense.search(vector_queries(spark, sf_dir), vectors(spark, sf_dir), k=5,
                               metric="cos_distance"))


@query("vector_truncate_search")
def vector_truncate_search(spark, sf_dir):
    """Vectors cut to their first 32 dimensions, then C2."""
    from .functions.vectors import truncate
    from .operators import dense
    v = vectors(spark, sf_dir).withColumn("vector", truncate("vector", 32))
    q = v.withColumnRenamed("doc_id", "qid")
    return _dhits(dense.search(q, v, k=5, metric="cos_plus_one"))


@query("vector_validate")
def vector_validate(spark, sf_dir):
    """Per vector, accepted for a 64-dimensional index or the reason it is not. Every
    seventh vector is cut short, every eleventh is missing and every thirteenth is zero."""
    from .functions.vectors import validity_reason, truncate
    e = table(spark, sf_dir, "embeddings").withColumn(
        "embedding", F.when(F.col("vec_id") % 7 == 3, truncate("embedding", 60))
        .when(F.col("vec_id") % 11 == 3, F.lit(None))
        .when(F.col("vec_id") % 13 == 3, F.transform("embedding", lambda x: x * F.lit(0.0).cast("float")))
        .otherwise(F.col("embedding")))
    return e.select("vec_id", validity_reason("embedding", 64).alias("reason")).select(
        "vec_id", F.col("reason").isNull().alias("valid"), "reason")


@query("nearest_title_gate")
def nearest_title_gate(spark, sf_dir):
    """C3 + B3 + B9: best other vector of the same label (feed), gated at 0.95."""
    from .operators import dense
    g = dense.nearest_in_feed(vector_queries(spark, sf_dir), vectors(spark, sf_dir), "label",
                              exclude_self=True)
    return g.select("qid", "doc_id", r6(F.col("cos_sim")).alias("cos_sim"), "status",
                    "status_message")


@query("vector_mean_pool")
def vector_mean_pool(spark, sf_dir):
    """Mean vector per label, one row per (label, dimension)."""
    from .operators import dense
    m = dense.mean_pool(table(spark, sf_dir, "embeddings"), "label", "embedding")
    return m.select("label", F.posexplode("vector").alias("dim", "value")).select(
        "label", F.col("dim").cast("bigint").alias("dim"), r6(F.col("value")).alias("value"))


@query("hash_encode")
def hash_encode(spark, sf_dir):
    """J1 default encoder: md5-bucketed token counts of every whole document (non-zero dims)."""
    from .functions.vectors import with_hash_vector
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    v = with_hash_vector(d, "text", "vector", HASH_DIMS, keep=["doc_id"])
    return (v.select("doc_id", F.posexplode_outer("vector").alias("dim", "value"))
             .where(F.col("value") > 0)
             .select("doc_id", F.col("dim").cast("bigint").alias("dim"),
                     F.col("value").cast("double").alias("value")))


@query("dense_search_multifield")
def dense_search_multifield(spark, sf_dir):
    """K2: hashed vectors for text and source, boost text 3, filter lang='en', positives only."""
    from .functions.vectors import with_hash_vector
    from .operators import dense
    d = corpus(spark, sf_dir).withColumnRenamed("id", "doc_id")
    d = with_hash_vector(d, "text", "text", HASH_DIMS, keep=["doc_id", "source", "lang"])
    d = with_hash_vector(d, "source", "source", HASH_DIMS, keep=["doc_id", "text", "lang"])
    q = bench_queries_with_source(spark, sf_dir)
    q = with_hash_vector(q, "query", "text", HASH_DIMS, keep=["qid", "query"])
    q = q.withColumn("source", F.col("text"))
    h = dense.blocked_search(q, d, ["text", "source"], 10, "cosine", boosts=[3.0, 1.0],
                             positive_only=True, filter_dict={"lang": "en"})
    return _dhits(h)


# ---------------------------------------------------------------- evaluation (2C, 2D, 2K)

EVAL_DIMS = 256


def ground_truth(spark, sf_dir, idx):
    """Benchmark passages contained verbatim in documents: (qid, id, question)."""
    from .operators.evaluate import containment_ground_truth
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"),
                                                     F.col("text").alias("question"))
    return containment_ground_truth(items, idx.docs.select("doc_id", "text"))


def tfidf_backend(idx, k=10):
    def run(questions):
        return sparse.search(idx, questions, text_col="question", boost_dict={"text": 3.0},
                             num_results=k)
    return run


def hashed_documents(spark, sf_dir):
    """(id, vector): the documents under the default encoder."""
    from .functions.vectors import with_hash_vector
    return with_hash_vector(corpus(spark, sf_dir).select("id", "text"), "text", "vector", EVAL_DIMS, keep=["id"])


def hashed_questions(questions):
    from .functions.vectors import with_hash_vector
    return with_hash_vector(questions, "question", "vector", EVAL_DIMS, keep=["qid", "question"])


def _eval_setup(spark, sf_dir):
    """The ground truth is read by every backend: build it once and cut its lineage (a
    reliable checkpoint in spark.checkpoint.dir; it holds one row per relevant pair)."""
    from .session import cut_lineage
    idx = sparse.fit(corpus(spark, sf_dir), ["text"], [])
    return idx, cut_lineage(ground_truth(spark, sf_dir, idx))


@query("eval_relevance")
def eval_relevance(spark, sf_dir):
    """Relevance of every TF-IDF hit (top 10) for every ground-truth row."""
    from .operators import evaluate as ev
    idx, gt = _eval_setup(spark, sf_dir)
    questions = gt.select("qid", "question").dropDuplicates(["qid"])
    return ev.relevance(gt, tfidf_backend(idx)(questions))


@query("eval_hit_rate")
def eval_hit_rate(spark, sf_dir):
    """Hit rate of the TF-IDF backend at k=10."""
    from .operators import evaluate as ev
    idx, gt = _eval_setup(spark, sf_dir)
    questions = gt.select("qid", "question").dropDuplicates(["qid"])
    return ev.hit_rate(ev.relevance(gt, tfidf_backend(idx)(questions))).select(
        r6(F.col("hit_rate")).alias("hit_rate"))


@query("eval_mrr")
def eval_mrr(spark, sf_dir):
    """MRR (sum over all relevant positions) of the TF-IDF backend at k=10."""
    from .operators import evaluate as ev
    idx, gt = _eval_setup(spark, sf_dir)
    questions = gt.select("qid", "question").dropDuplicates(["qid"])
    return ev.mrr(ev.relevance(gt, tfidf_backend(idx)(questions))).select(
        r6(F.col("mrr")).alias("mrr"))


@query("eval_report")
def eval_report(spark, sf_dir):
    """One row per backend: TF-IDF k=10, search server k=5, vector store (full search) k=5,
    each created and searched through the one dispatch."""
    from .operators import evaluate as ev
    from .plans import backends
    idx, gt = _eval_setup(spark, sf_dir)
    docs = hashed_documents(spark, sf_dir)
    indexes = {"tfidf": backends.Index("tfidf", sparse=idx),
               "search_server": backends.create_index("search_server", docs),
               "vector_store": backends.create_index("vector_store", docs)}

    def run(name):
        k = 10 if name == "tfidf" else 5
        ask = (lambda q: q) if name == "tfidf" else hashed_questions
        return lambda questions: backends.search(indexes[name], ask(questions), k, query_col="question")
    report = ev.report(gt, {name: run(name) for name in backends.BACKENDS})
    return report.select("backend", r6(F.col("hit_rate")).alias("hit_rate"), r6(F.col("mrr")).alias("mrr"))


# ---------------------------------------------------------------- RAG and ground truth (2H, 2K)

def _rag_hits(spark, sf_dir, k=5):
    idx = sparse.fit(corpus(spark, sf_dir), ["text"], [])
    q = bench_queries(spark, sf_dir)
    hits = sparse.search(idx, q, boost_dict={"text": 3.0}, num_results=k)
    return sparse.attach_text(hits, idx, max_rows=k * q.count())


@query("prompt_render")
def prompt_render(spark, sf_dir):
    """H8 + D10: RAG prompt of every benchmark question over its top-5 TF-IDF hits."""
    from .operators import rag
    return rag.render_prompts(bench_queries(spark, sf_dir), _rag_hits(spark, sf_dir)).select(
        "qid", "prompt")


@query("rag_batch")
def rag_batch(spark, sf_dir):
    """K1: search -> context -> prompt -> default extractive answer -> words."""
    from .plans import backends, rag
    index = backends.Index("tfidf", sparse=sparse.fit(corpus(spark, sf_dir), ["text"], []))
    return rag.answer_words(rag.answer(index, bench_queries(spark, sf_dir), 5))


@query("question_prompt")
def question_prompt_q(spark, sf_dir):
    """H9: question-generation prompt for every whole document."""
    from .operators import rag
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return rag.question_prompts(d)


@query("question_explode")
def question_explode(spark, sf_dir):
    """K5: resume (skip labelled docs) -> default answers -> parse JSON -> one row a question."""
    from .operators import rag
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    done = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    todo = rag.resume(d, done, "id")
    rows, _bad = rag.parse_questions(rag.default_question_answer(todo))
    return rows.select(F.col("id").cast("string").alias("id"), "question")


@query("resume_anti_join")
def resume_anti_join(spark, sf_dir):
    """Documents not yet processed (absent from labels)."""
    from .operators import rag
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return rag.resume(d, table(spark, sf_dir, "labels"), "doc_id")


@query("word_stream")
def word_stream_q(spark, sf_dir):
    """All messages as a stream of 'word ' rows."""
    from .operators import rag
    return rag.word_stream(table(spark, sf_dir, "conversations"), ["conv_id", "turn"], "text")


# ---------------------------------------------------------------- transcripts and chat

@query("sentence_chunks")
def sentence_chunks_q(spark, sf_dir):
    """H4: every whole document split into sentences, with the abbreviations learnt from all of them."""
    from .operators import transcript
    from .operators.sentences import learn_abbreviations
    d = table(spark, sf_dir, "documents")
    return transcript.sentence_chunks(d, "doc_id", "text", learn_abbreviations(d, "text"))


@query("abbreviations")
def abbreviations_q(spark, sf_dir):
    """H4: the words that all turns of the conversations use as abbreviations, with their scores."""
    from .operators import sentences
    found = sentences.abbreviation_scores(sentences.word_uses(table(spark, sf_dir, "conversations"), "text"))
    return found.where(F.col("score") >= sentences.LEAST_SCORE).select("word", "n", "dotted", r6(F.col("score")).alias("score"))


@query("chunk_renumber")
def chunk_renumber(spark, sf_dir):
    """G1 + E3: sentences of all turns of a conversation numbered "1".."N" in turn order."""
    from .operators import transcript
    from .operators.sentences import learn_abbreviations
    c = table(spark, sf_dir, "conversations")
    return transcript.renumber_chunks(c, "conv_id", "turn", "text", learn_abbreviations(c, "text"))


@query("transcript_concat")
def transcript_concat(spark, sf_dir):
    """D9 + F2: turn texts concatenated in turn order with the leading space."""
    from .operators import transcript
    return transcript.concat_transcript(table(spark, sf_dir, "conversations"), "conv_id",
                                        "turn", "text")


@query("chat_pairs")
def chat_pairs_q(spark, sf_dir):
    """Each user turn with the assistant turn that follows (NULL if none), on a log whose turn
    numbers have gaps (doubled)."""
    from .operators import chat
    c = table(spark, sf_dir, "conversations")
    return chat.chat_pairs(c.withColumn("turn", F.col("turn") * 2 + F.when(F.col("turn") > 1, 5).otherwise(0)))


@query("chat_transcript")
def chat_transcript_q(spark, sf_dir):
    """replay of every conversation as 'role: text' lines."""
    from .operators import chat
    return chat.chat_transcript(table(spark, sf_dir, "conversations"))


# ---------------------------------------------------------------- topics (2D, 2E, 2J)

def mentions(spark, sf_dir):
    """events stand for entity mentions: event_type = label, user_id = text, value = score."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("label"),
                    F.col("user_id").cast("string").alias("text"),
                    F.col("value").alias("score"))


@query("entity_extract")
def entity_extract(spark, sf_dir):
    """J2 default + G2: rule-based mentions over every whole document."""
    from .operators import topics
    return topics.extract_entities(table(spark, sf_dir, "documents"), "doc_id", "text")


def phrases(spark, sf_dir):
    """(label, phrase): runs of two to four words near the beginning of every benchmark text stand for the
    user's entities, under three labels."""
    b = table(spark, sf_dir, "benchmark")
    w = F.split("text", r"[ \t\n]+")
    label = F.element_at(F.array(*[F.lit(x) for x in ("Person", "Place", "Work")]), (F.col("item_id") % 3 + 1).cast("int"))
    runs = F.array(*[F.array_join(F.slice(w, at, n), " ") for at, n in ((1, 2), (2, 2), (2, 3), (3, 2), (1, 4), (4, 3))])
    return b.select(label.alias("label"), F.explode(runs).alias("phrase"))


@query("entity_tag")
def entity_tag(spark, sf_dir):
    """J2 + G2 by the user's labels: phrases of the three labels in every whole document, no two of them
    overlapping."""
    from .operators import tagger
    return tagger.tag_phrases(table(spark, sf_dir, "documents"), "doc_id", "text", phrases(spark, sf_dir))


@query("topic_stats")
def topic_stats_q(spark, sf_dir):
    """Total score and count per (label, text)."""
    from .operators import topics
    s = topics.topic_stats(mentions(spark, sf_dir))
    return s.select("label", "text", r6(F.col("total_score")).alias("total_score"), "count")


@query("topic_top_words")
def topic_top_words(spark, sf_dir):
    """E2 + D12: top 15 texts per label by (count, total score), as an ordered list."""
    from .operators import topics
    ranked = topics.rank_in_label(topics.topic_stats(mentions(spark, sf_dir)))
    tw = topics.top_words(ranked)
    return tw.select("label", F.size("words").cast("bigint").alias("n_words"),
                     F.array_join("words", " | ").alias("words"))


@query("topic_pivot")
def topic_pivot(spark, sf_dir):
    """Rank rows x label columns, '' padding."""
    from .operators import topics
    ranked = topics.rank_in_label(topics.topic_stats(mentions(spark, sf_dir)))
    return topics.pivot(ranked)


@query("topic_report")
def topic_report(spark, sf_dir):
    """K6: extraction over every whole document -> stats -> top 15 per label -> pivot."""
    from .operators import topics
    d = table(spark, sf_dir, "documents")
    return topics.report(d, "doc_id", "text", topics.DEFAULT_RULES)


# ---------------------------------------------------------------- URLs, HTML, media, catalogue

@query("url_episode")
def url_episode(spark, sf_dir):
    """H3: podcast id and episode title from every page URL."""
    from .functions.urls import episode_from_url
    p = table(spark, sf_dir, "pages")
    pid, title = episode_from_url(F.col("url"))
    return p.select("page_id", pid.alias("podcast_id"), title.alias("episode_title"))


@query("html_to_text")
def html_to_text_q(spark, sf_dir):
    """H5: every page's HTML as plain text."""
    from .functions.text import html_to_text
    return table(spark, sf_dir, "pages").select("page_id", html_to_text("html").alias("text"))


@query("title_normalize")
def title_normalize_q(spark, sf_dir):
    """H2: normalised form of every whole document text."""
    from .functions.text import title_normalize
    return table(spark, sf_dir, "documents").select(
        "doc_id", title_normalize("text").alias("title"))


def media(spark, sf_dir):
    """orders stand for media files: id o_orderkey, length from the price, path per order."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("media_id"),
                    F.round(F.col("o_totalprice") * 10).cast("bigint").alias("length_ms"),
                    F.concat(F.lit("./audio/"), F.col("o_orderpriority"), F.lit("/episode_"),
                             F.col("o_orderkey").cast("string"), F.lit(".mp3")).alias("path"))


@query("segment_plan")
def segment_plan_q(spark, sf_dir):
    """H11 + H12: four ranges per media file, last one takes the rest, with part names."""
    from .operators.media import segment_plan
    return segment_plan(media(spark, sf_dir), 4)


@query("download_manifest")
def download_manifest_q(spark, sf_dir):
    """A13 + H13: target path per catalogue entry (name 'brand: name.' made safe)."""
    from .operators.media import download_manifest
    p = table(spark, sf_dir, "part").select(
        "p_partkey", F.concat(F.col("p_brand"), F.lit(": "), F.col("p_name"), F.lit("."))
        .alias("podcast_name"))
    return download_manifest(p, "p_partkey", "podcast_name")


def part_catalogue(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("collection_id"),
                    F.col("p_name").alias("collection_name"),
                    F.col("p_brand").alias("artist_name"))


@query("catalog_search")
def catalog_search(spark, sf_dir):
    """B11 + B13: search terms over the part catalogue: whole part names, pieces from inside of them in
    capitals (some begin or end within a word, some have one or two letters) and supplier names."""
    from .operators.catalog import term_search
    p, s = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    name, n = F.col("p_name"), F.col("p_partkey")
    piece = F.upper(F.substring(name, (n % 5 + 1).cast("int"), (n % 7 + 1).cast("int")))
    terms = p.select(F.explode(F.array(name, piece)).alias("term")).unionByName(s.select(F.col("s_name").alias("term")))
    return term_search(terms, part_catalogue(spark, sf_dir), 3)


@query("catalogue_parse")
def catalogue_parse(spark, sf_dir):
    """A3: the part catalogue landed as answers (one JSON document a line, one per size) and read
    back, positions kept."""
    from .session import ensure_checkpoint_dir
    from .sources.files import read_catalogue
    p = table(spark, sf_dir, "part")
    entry = F.struct(F.col("p_partkey").cast("string").alias("collectionId"), F.col("p_name").alias("collectionName"),
                     F.col("p_brand").alias("artistName"), F.col("p_type").alias("feedUrl"))
    answers = p.groupBy("p_size", F.floor(F.col("p_partkey") / 50).alias("page")).agg(F.sort_array(F.collect_list(entry)).alias("results"))
    path = f"{ensure_checkpoint_dir(spark)}/catalogue-{uuid.uuid4().hex[:12]}"
    answers.select(F.size("results").alias("resultCount"), "results").write.json(path)
    return read_catalogue(spark, path)


@query("catalog_lookup")
def catalog_lookup(spark, sf_dir):
    """Every ordering customer's id looked up in answers that list the suppliers of a nation
    with the largest key first; unknown ids fail."""
    from .operators.catalog import lookup
    ids = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("podcast_id"))
    s = table(spark, sf_dir, "supplier")
    cat = s.select(F.col("s_nationkey").cast("long").alias("collection_id"), (-F.col("s_suppkey")).alias("pos"),
                   F.when(F.col("s_suppkey") % 5 != 0, F.col("s_name")).alias("collection_name"),
                   F.concat(F.lit("supplier "), F.col("s_suppkey").cast("string")).alias("artist_name"))
    return lookup(ids, cat)


@query("latest_episode")
def latest_episode(spark, sf_dir):
    """E5: first feed entry (lowest order key) of every customer; none -> Fail. Every customer also
    asks for a podcast that has no feed."""
    from .operators.catalog import latest_entry
    c = table(spark, sf_dir, "customer").select(F.explode(F.array(
        F.col("c_custkey"), -F.col("c_custkey") - 1)).alias("podcast_id"))
    o = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("podcast_id"), F.col("o_orderkey").alias("pos"),
        F.col("o_orderpriority").alias("summary"), r6(F.col("o_totalprice")).alias("price"))
    return latest_entry(c, o, "podcast_id", "pos")


@query("dense_search_ann")
def dense_search_ann(spark, sf_dir):
    """C4 approximate path: 16 quantised cells, 4 probed first, then those whose bounds say that they may
    hold a better hit; distance ascending."""
    from .operators import ann
    index = ann.fit(vectors(spark, sf_dir), n_cells=16)
    return _dhits(ann.search(index, vector_queries(spark, sf_dir), 5, nprobe=4))


@query("ann_recall")
def ann_recall(spark, sf_dir):
    """C4: hits of the approximate index against the full search, and whether it read fewer vectors than
    that: every vector is a query."""
    from .operators import ann, dense
    from .session import cut_lineage
    q, v = vector_queries(spark, sf_dir), vectors(spark, sf_dir)
    index = ann.fit(v, n_cells=16)
    read = cut_lineage(ann.candidates(index, q, 5))
    want = dense.search(q, v, k=5, metric="cos_distance")
    per_query = want.join(read, ["qid", "doc_id"], "left_semi").groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    both = want.groupBy("qid").agg(F.count(F.lit(1)).alias("want")).join(per_query, "qid", "left").agg(
        F.count(F.lit(1)).alias("queries"), (F.sum("n") / F.sum("want") >= 0.95).alias("recall_ok"))
    n = v.count()
    share = read.agg((F.coalesce(F.sum("read"), F.lit(0)) < F.lit(n * n)).alias("reads_less"))
    # two rows become one
    return both.unionByName(share, allowMissingColumns=True).agg(*[F.max(c).alias(c) for c in ("queries", "recall_ok", "reads_less")])
