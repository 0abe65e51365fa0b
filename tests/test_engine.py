import json

import pytest
from pyspark.sql import functions as F

from lorewell.engine import Engine
from lorewell.operators import models
from lorewell.sources import files
from lorewell.streaming.ingest import index_stream

#: Ships, what they carry, and where that comes from.
DOCS = [
    "Heron carries copper.", "Petrel carries salt.", "Copper comes from Varn Mine.", "Varn Mine belongs to Lund Trust.", "Salt comes from Dry Lake.",
    "Iva Korr founded Lund Trust.", "The harbour froze twice.",
]
NEW = ["Tern carries tin.", "Tin comes from Varn Mine.", "the harbour froze twice"]
QUESTIONS = ["What does Heron carry?", "Who founded Lund Trust?", "zzz"]


def state(engine):
    edges = {(r[0], r[1]): r[2] for r in engine.edges().collect()}
    return edges, {r[0] for r in engine.facts().select("content").collect()}, {r[0] for r in engine.chunks().select("hash_id").collect()}


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    engine = Engine(spark, str(tmp_path_factory.mktemp("index")))
    engine.index(DOCS)
    return engine


def test_index_grows_and_shrinks_like_a_rebuild(spark, tmp_path, built):
    first = state(built)
    built.index(DOCS[:3])
    assert state(built) == first
    built.index(NEW)
    whole = Engine(spark, str(tmp_path / "whole"))
    whole.index([*NEW, *DOCS])
    assert state(built) == state(whole)
    built.delete([*NEW, "never seen"])
    assert state(built) == first


def test_retrieve_falls_back_to_dense(built):
    rows = built.retrieve(QUESTIONS, 3).orderBy("query_id", "rank").collect()
    assert {r["query_id"]: r["method"] for r in rows} == {0: "graph", 1: "graph", 2: "dense"}
    assert [r["rank"] for r in rows if r["query_id"] == 1] == [1, 2, 3]
    assert [r["content"] for r in rows if r["query_id"] < 2 and r["rank"] == 1] == [DOCS[0], DOCS[5]]
    assert set(built.seconds) == {"dense", "facts", "pagerank", "other", "total"} and built.usage().count() == 0


def test_rag_qa_scores(spark, built):
    gold = spark.createDataFrame([(0, ["Copper", "ore"])], "query_id long, gold_answers array<string>")
    out, scores = built.rag_qa(QUESTIONS[:1], gold)
    assert out.first()["answer"] == "copper" and out.first()["prompt"].endswith("Thought: ") and scores.first()["F1"] == scores.first()["ExactMatch"] == 1


def test_dense_mode(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "dense"), mode="dense")
    engine.index(DOCS)
    rows = engine.retrieve(["Petrel carries salt"], 2).orderBy("rank").collect()
    assert rows[0]["content"] == DOCS[1] and rows[0]["method"] == "dense" and rows[0]["score"] == 1.0
    engine.delete(DOCS)
    assert engine.chunks().count() == 0 and engine.retrieve(["x"], 2).count() == 0


def test_objects_in_place_of_the_stand_ins(spark, tmp_path):
    class Extractor:
        def extract(self, passage):
            return ["x"], [["Heron", "hauls", "ore"], ["only", "two"]] if "Heron" in passage else []

    class Filter:
        def keep(self, question, facts):
            if "fail" in question:
                raise RuntimeError("down")
            return facts[:1]

    engine = Engine(spark, str(tmp_path / "own"), extractor=Extractor(), fact_filter=Filter())
    engine.index(DOCS[:2])
    assert {r["content"] for r in engine.facts().collect()} == {"('heron', 'hauls', 'ore')"}
    assert {r["method"] for r in engine.retrieve(["who hauls"], 2).collect()} == {"graph"}
    assert {r["method"] for r in engine.retrieve(["fail"], 2).collect()} == {"dense"}


def test_closest_fact_is_kept_once():
    facts = [["a", "likes", "b"], ["c", "owns", "d"]]
    assert models.closest_facts([["a", "like", "b"], ["a", "likes", "b!"], ["c", "own", "d"]], facts) == facts


def scripted(down=()):
    """A chat model that answers by rules; passages and questions that hold a word of ``down`` fail."""

    class Chat:
        model, seed, temperature, parallel = "rules", 7, 0.0, 3

        def infer(self, messages, **options):
            import json

            told, asked = messages[0]["content"], messages[-1]["content"]
            if any(w in asked for w in down):
                raise OSError("down")
            meta = {"prompt_tokens": 10, "completion_tokens": 2, "finish_reason": "stop"}
            if "named_entities" in told:
                return "Sure: " + json.dumps({"named_entities": [asked.split(" ")[0]] * 2}), meta
            if '"triples"' in told:
                words = asked.split("\n")[1].strip(".").split(" ")
                return json.dumps({"triples": [[words[0], " ".join(words[1:-1]), words[-1]], ["only", "two"]]}) [:-1] + ', ["cut', meta | {"finish_reason": "length"}
            if "fact_after_filter" in told:
                fact = json.loads(asked.split("\n")[-1])["fact"][0]
                return "[[ ## fact_after_filter ## ]]\n" + json.dumps({"fact": [[fact[0], fact[1], fact[2] + "s"]]}) + "\n\n[[ ## completed ## ]]", meta
            return "Thought: easy.\nAnswer: " + asked.split("\n")[0].removeprefix("Wikipedia Title: "), meta

    return Chat()


def test_a_chat_model_extracts_filters_and_answers_and_is_asked_once(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "own"), chat=scripted(down=["Petrel"]))
    engine.index(DOCS[:3])
    assert {r["content"] for r in engine.facts().collect()} == {"('heron', 'carries', 'copper')", "('copper', 'comes from varn', 'mine')"}
    assert {r["passage"]: r["error"] for r in engine.openie().where("error is not null").collect()} == {DOCS[1]: "OSError('down')"}
    counts = engine.usage().first()
    assert (counts["phase"], counts["num_calls"], counts["num_failed"], counts["total_prompt_tokens"], counts["num_cache_hit"]) == ("extraction", 5, 1, 40, 0)

    again = Engine(spark, str(tmp_path / "own"), chat=scripted())
    again.index(DOCS[:3])  # the passage that failed is tried again, and only that
    assert again.facts().count() == 3 and again.openie().where("error is not null").count() == 0 and again.usage().first()["num_calls"] == 2
    out, scores = again.rag_qa(QUESTIONS[:1], spark.createDataFrame([(0, ["Heron carries copper"])], "query_id long, gold_answers array<string>"))
    assert out.first()["answer"] == "Heron carries copper." and scores.first()["ExactMatch"] == 1
    assert again.retrieve(QUESTIONS[:1], 2).first()["method"] == "graph"
    hits = {r["phase"]: (r["num_calls"], r["num_cache_hit"]) for r in again.usage().collect()}
    assert hits == {"extraction": (2, 0), "filter": (1, 1), "answers": (1, 0)}

    third = Engine(spark, str(tmp_path / "third"), chat=scripted(down=["Heron", "Salt"]))
    third.take_extractions(again.openie())
    third.index([*DOCS[:3], DOCS[4]])
    assert third.facts().count() == 3 and third.retrieve(QUESTIONS[:1], 1).first()["method"] == "dense"  # a filter that fails keeps none


def test_extractions_of_a_file(spark, tmp_path):
    path = tmp_path / "openie.json"
    path.write_text(json.dumps({"docs": [{"idx": "old", "passage": DOCS[0], "extracted_entities": ["Heron"], "extracted_triples": [["Heron", "hauls", "ore"]]}]}))
    engine = Engine(spark, str(tmp_path / "index"))
    engine.take_extractions(files.openie_json(spark, str(path), engine.config.chunk_prefix))
    engine.index(DOCS[:2])
    assert {r["content"] for r in engine.facts().collect()} == {"('heron', 'hauls', 'ore')", "('petrel', 'carries', 'salt')"}


def test_a_table_survives_a_write_that_breaks_off(spark, tmp_path):
    tables = files.Tables(spark, str(tmp_path / "t"))
    tables.replace("x", spark.range(3))
    read = lambda: sorted(r[0] for r in files.Tables(spark, str(tmp_path / "t")).read("x", "id long").collect())
    assert read() == [0, 1, 2]

    class Broken(files.Tables):
        def _point(self, name, number, version):
            raise RuntimeError("the driver is gone")

    with pytest.raises(RuntimeError):
        Broken(spark, str(tmp_path / "t")).replace("x", spark.range(9))
    assert read() == [0, 1, 2]
    old = tables.read("x", "id long")
    tables.replace("x", old.where("id > 0"))  # from itself
    assert read() == [1, 2] and old.count() == 3
    tables.vacuum("x")
    assert read() == [1, 2] and len(tables._pointers("x")) == 1
    with pytest.raises(RuntimeError, match="another writer"):
        tables._point("x", 2, "f" * 32)
    assert read() == [1, 2]


@pytest.fixture()
def endpoint():
    """An endpoint that is busy at first and then answers, and keeps what it was asked."""
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    class Handler(BaseHTTPRequestHandler):
        asked, busy = [], [503, 429]

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            self.asked.append((self.path, {k.title(): v for k, v in self.headers.items()}, body))
            code = self.busy.pop() if self.busy else 401 if body.get("model") == "secret" else 200
            self.send_response(code)
            self.end_headers()
            if code != 200:
                return
            if self.path.startswith("/chat") or "/deployments/" in self.path:
                reply = {"choices": [{"message": {"content": "hi"}, "finish_reason": "stop"}], "usage": {"prompt_tokens": 3, "completion_tokens": 1}}
            elif self.path.startswith("/embeddings"):
                reply = {"data": [{"embedding": [3.0, 4.0]} for _ in body["input"]]}
            else:
                reply = {"embeddings": [[1.0, 0.0] for _ in body["texts"]]}
            self.wfile.write(json.dumps(reply).encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", Handler
    server.shutdown()


def test_endpoints(endpoint):
    url, seen = endpoint
    chat = models.chat_model("gpt-x", url, api_key="k", backoff=0.0)
    assert chat.infer([{"role": "user", "content": "q"}], schema={"type": "object"}) == ("hi", {"prompt_tokens": 3, "completion_tokens": 1, "finish_reason": "stop"})
    path, headers, body = seen.asked[-1]
    assert len(seen.asked) == 3 and path == "/chat/completions" and headers["Authorization"] == "Bearer k" and body["max_completion_tokens"] == 2048 and "json_schema" in body["response_format"]
    models.chat_model("azure/dep", url, api_key="k", api_version="v1").infer([])
    assert seen.asked[-1][0] == "/openai/deployments/dep/chat/completions?api-version=v1" and seen.asked[-1][1]["Api-Key"] == "k"
    with pytest.raises(OSError):
        models.chat_model("secret", url, backoff=0.0).infer([])
    n = len(seen.asked)
    assert models.embedder("text-embedding-x", url, batch=2).encode(["a", "b\nc", ""]).tolist() == [[0.6, 0.8]] * 3 and len(seen.asked) == n + 2
    assert seen.asked[-2][2]["input"] == ["a", "b c"]
    model = models.embedder("cohere/embed", api_key="k")
    model = models.CohereEmbedder(model.model, url, model.headers)
    model.encode(["a"]), model.encode(["a"], "Given a question")
    assert [x[2]["input_type"] for x in seen.asked[-2:]] == ["search_document", "search_query"]


def test_command_line(spark, tmp_path, monkeypatch):
    from lorewell import cli

    monkeypatch.setenv("OWN_KEY", "k")
    args = cli.parser().parse_args(["--corpus", "c", "--questions", "q", "--root", str(tmp_path / "r"), "--llm", "gpt-x", "--llm-url", "http://host/v1", "--key-from", "OWN_KEY", "--embedding", "text-embedding-x"])
    engine = cli.build(spark, args)
    assert engine.chat.url == "http://host/v1" and engine.chat.headers == engine.embedder.headers == {"Authorization": "Bearer k"}
    (tmp_path / "c.json").write_text(json.dumps([{"title": d, "text": "", "idx": i} for i, d in enumerate(DOCS)]))
    (tmp_path / "q.json").write_text(json.dumps([{"id": "1", "question": QUESTIONS[0], "answer": "copper", "paragraphs": [{"title": DOCS[0], "text": "", "is_supporting": True}]}]))
    cli.main(["--corpus", str(tmp_path / "c.json"), "--questions", str(tmp_path / "q.json"), "--root", str(tmp_path / "r2")])
    cli.main(["--corpus", str(tmp_path / "c.json"), "--questions", str(tmp_path / "q.json"), "--root", str(tmp_path / "r3"), "--openie-mode", "offline"])
    assert Engine(spark, str(tmp_path / "r2")).facts().count() > 0 and Engine(spark, str(tmp_path / "r3")).facts().count() == 0


def test_corpus_and_question_files(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([{"title": "T", "text": "x y", "idx": 0}]))
    (tmp_path / "q.json").write_text(json.dumps([{"id": "1", "question": "q?", "answer": ["a"], "paragraphs": [{"title": "T", "text": "x y", "is_supporting": True}, {"title": "U", "text": "z", "is_supporting": False}]}]))
    assert files.corpus(spark, str(tmp_path / "c.json")).first()["content"] == "T\nx y"
    from lorewell.operators import evaluate

    rows = files.questions(spark, str(tmp_path / "q.json"))
    assert evaluate.gold_docs(rows).first()["gold"] == ["T\nx y"] and evaluate.gold_answers(rows).first()["answers"] == ["a"]


@pytest.mark.parametrize("dataset, body", [("hotpotqa", "One.Two."), ("2wikimultihopqa", "One. Two.")])
def test_question_files_with_supporting_facts(spark, tmp_path, dataset, body):
    context = [["A \"é\"", ["One.", "Two."]], ["B", ["No."]], ["C", ["Three."]]]
    asked = [
        {"id": "1", "question": "q?", "answer": "yes", "supporting_facts": [["A \"é\"", 0], ["A \"é\"", 1], ["C", 0]], "context": context},
        {"id": "2", "question": "q?", "gold_ans": ["[1]", "2"], "answer_aliases": ["zwei"], "supporting_facts": [], "context": context},
        {"id": "3", "question": "q?", "obj": "o", "possible_answers": '["o", "p"]', "o_wiki_title": "O", "o_aliases": "o", "contexts": [{"title": "T", "text": "x", "is_supporting": True}]},
        {"id": "4", "question": "q?", "reference": "[\"r\"]", "paragraphs": [{"title": "P", "paragraph_text": "y"}]},
    ]
    (tmp_path / "q.json").write_text(json.dumps(asked))
    from lorewell.operators import evaluate

    rows = files.questions(spark, str(tmp_path / "q.json"))
    gold = {r["id"]: sorted(r["gold"]) for r in evaluate.gold_docs(rows, evaluate.sentence_separator(dataset)).collect()}
    assert gold == {"1": ["A \"é\"\n" + body, "C\nThree."], "2": [], "3": ["T\nx"], "4": ["P\ny"]}
    answers = {r["id"]: sorted(r["answers"]) for r in evaluate.gold_answers(rows).collect()}
    assert answers == {"1": ["yes"], "2": ["2", "[1]", "zwei"], "3": ["O", '["o", "p"]', "o"], "4": ['["r"]']}


def test_cache_answers_each_key_once(spark):
    calls = spark.createDataFrame([("k1", "a"), ("k1", "a"), ("k2", "b")], "key string, prompt string")
    cache = spark.createDataFrame([("k2", "old", "{}")], "key string, message string, metadata string")
    run = lambda todo: todo.select("key", F.concat(F.lit("new "), "prompt").alias("message"), F.lit("{}").alias("metadata"))
    answers, fresh = files.through_cache(calls, cache, run)
    assert {(r["key"], r["message"], r["cache_hit"]) for r in answers.collect()} == {("k1", "new a", False), ("k2", "old", True)}
    assert [r["key"] for r in fresh.collect()] == ["k1"]


def test_stream_feeds_the_index(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "index"), mode="dense")
    spark.createDataFrame([(d,) for d in DOCS], "content string").write.parquet(str(tmp_path / "in"))
    index_stream(spark, engine, str(tmp_path / "in"), str(tmp_path / "check")).awaitTermination()
    assert engine.chunks().count() == len(DOCS)
