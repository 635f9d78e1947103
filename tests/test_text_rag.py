from pyspark.sql import functions as F

from talkframe.functions import prompts
from talkframe.functions.text import html_to_text, title_normalize, tokenize
from talkframe.functions.urls import episode_from_url, safe_dir_name
from talkframe.operators import rag

# Hand-written expected prompt (byte for byte).
EXPECTED_TWO_HITS = (
    "You're a podcast chat bot. Answer the QUESTION based on the CONTEXT from the RESULTS "
    "database.\n    Use only the facts from the CONTEXT when answering the QUESTION.\n\n"
    "    QUESTION: what is {x}?\n    \n    CONTEXT: \n    first doc\n\nsecond doc"
)
EXPECTED_NO_HITS = (
    "You're a podcast chat bot. Answer the QUESTION based on the CONTEXT from the RESULTS "
    "database.\n    Use only the facts from the CONTEXT when answering the QUESTION.\n\n"
    "    QUESTION: none\n    \n    CONTEXT:"
)


def test_prompt_byte_exact(spark):
    q = spark.createDataFrame([(1, "what is {x}?"), (2, "none")], "qid long, query string")
    hits = spark.createDataFrame([(1, 2, "second doc"), (1, 1, "first doc")],
                                 "qid long, rank long, text string")
    got = {r.qid: r.prompt for r in rag.render_prompts(q, hits).collect()}
    assert got[1] == EXPECTED_TWO_HITS
    assert got[2] == EXPECTED_NO_HITS


def test_question_prompt_braces(spark):
    df = spark.createDataFrame([("1", "a {b} c")], "id string, text string")
    p = rag.question_prompts(df).first().prompt
    assert "text: a {b} c\n\n" in p
    assert p.endswith('{"questions": ["question1", "question2", ..., "question5"]}')
    assert "from the record. \n\nThe record:" in p


def test_parse_questions_quarantine(spark):
    raw = spark.createDataFrame(
        [("1", '{"questions": ["a?", "b?"]}'), ("2", "not json"), ("3", '{"questions": []}')],
        "id string, raw string")
    rows, bad = rag.parse_questions(raw)
    assert sorted((r.id, r.question) for r in rows.collect()) == [("1", "a?"), ("1", "b?")]
    assert [r.id for r in bad.collect()] == ["2"]


def test_default_questions_spread(spark):
    text = " ".join(f"S{i}." for i in range(12))
    df = spark.createDataFrame([("1", text), ("2", "One. Two.")], "id string, text string")
    rows, _ = rag.parse_questions(rag.default_question_answer(df))
    got = sorted((r.id, r.question) for r in rows.collect())
    # floor(j * 12 / 5) for j < 5 -> 0, 2, 4, 7, 9
    assert [q for i, q in got if i == "1"] == sorted(["S0.", "S2.", "S4.", "S7.", "S9."])
    assert [q for i, q in got if i == "2"] == ["One.", "Two."]


def test_word_stream(spark):
    df = spark.createDataFrame([(1, "  a  b\nc "), (2, "   ")], "qid long, answer string")
    rows = rag.word_stream(df, ["qid"], "answer").orderBy("qid", "pos").collect()
    assert [(r.qid, r.pos, r.word) for r in rows] == [(1, 0, "a "), (1, 1, "b "), (1, 2, "c ")]


def test_resume(spark):
    todo = spark.createDataFrame([("1",), ("2",), ("3",)], "id string")
    done = spark.createDataFrame([("2",), ("2",)], "id string")
    assert sorted(r.id for r in rag.resume(todo, done, "id").collect()) == ["1", "3"]


def test_url_episode(spark):
    url = ("https://podcasts.apple.com/us/podcast/what-if-the-russian-revolution-hadnt-been-"
           "bolshevik/id1682047968?i=1000668755545")
    df = spark.createDataFrame([(url,), ("https://host/only",), (None,)], "url string")
    pid, title = episode_from_url(F.col("url"))
    rows = df.select(pid.alias("p"), title.alias("t")).collect()
    assert (rows[0].p, rows[0].t) == ("1682047968",
                                      "what if the russian revolution hadnt been bolshevik")
    assert rows[1].p == "ly"
    assert rows[2].p is None and rows[2].t is None


def test_safe_dir_name(spark):
    df = spark.createDataFrame([("Hardcore History: Vol. 2",)], "n string")
    assert df.select(safe_dir_name("n")).first()[0] == "Hardcore_History-_Vol_2"


def test_html_to_text(spark):
    html = ('<!DOCTYPE html><html><head><style>p{x:1}</style><script>var t="</p>";</script>'
            '</head><body><!-- c --><p>Tom &amp; Jerry<br/>&quot;A&quot; &middot; B &copy;'
            '<b>bold</body>')
    df = spark.createDataFrame([(html,)], "h string")
    assert df.select(html_to_text("h")).first()[0] == 'Tom & Jerry\n"A" · B ©bold'


def test_title_normalize_and_tokenize(spark):
    df = spark.createDataFrame([("Dr. Who's  NEW-show, v2.0!",)], "t string")
    r = df.select(title_normalize("t").alias("n"), tokenize(F.col("t")).alias("k")).first()
    assert r.n == "dr who s new show v20"
    assert r.k == ["dr", "who", "new", "show", "v2"]
