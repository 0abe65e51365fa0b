"""python -m lorewell.cli --corpus corpus.json --questions questions.json --root folder [--mode dense] [--llm NAME --llm-url URL]"""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession, functions as F

from lorewell.engine import Engine
from lorewell.functions.prompts import Prompts
from lorewell.operators import evaluate, models
from lorewell.sources import files

OPENAI = "https://api.openai.com/v1"


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(description="Index a corpus, answer questions and report recall, exact match and F1.")
    for name in ("corpus", "questions", "root"):
        out.add_argument(f"--{name}", required=True)
    out.add_argument("--mode", choices=["graph", "dense"], default="graph")
    out.add_argument("--embedding", default="hashed-words", help="an embedding model by the form of its name")
    out.add_argument("--embedding-url", default=OPENAI)
    out.add_argument("--llm", help="a chat model by the form of its name (azure/..., bedrock/..., Transformers/..., offline/...); without one the offline stand-ins work")
    out.add_argument("--llm-url", default=OPENAI)
    out.add_argument("--key-from", default="OPENAI_API_KEY", help="environment variable that holds the endpoints' key")
    out.add_argument("--prompts", help="folder of Python files that define prompt_template, in place of the engine's own of the same name")
    out.add_argument("--openie-mode", choices=["online", "offline"], default="online", help="offline: only extract and save, without graph and questions")
    out.add_argument("--extractions", help="JSON file of earlier extractions to start from")
    out.add_argument("--dataset", default="", help="name of the question set; hotpotqa joins sentences without a space")
    out.add_argument("--overwrite", action="store_true")
    return out


def build(spark: SparkSession, args: argparse.Namespace) -> Engine:
    """The engine that the arguments describe; no model is reached yet."""
    key = os.environ.get(args.key_from)
    own = lambda name: {"api_key": key} if key and not name.startswith(("bedrock", "Transformers/", "offline/")) else {}
    local = args.embedding == "hashed-words" or args.embedding.startswith("Transformers/") or "contriever" in args.embedding
    keyed = {} if local or "text-embedding" not in args.embedding and "cohere" not in args.embedding else own(args.embedding)
    embedder = models.embedder(args.embedding, args.embedding_url, **keyed)
    chat = models.chat_model(args.llm, args.llm_url, **own(args.llm)) if args.llm else None
    prompts = Prompts.from_directory(args.prompts) if args.prompts else None
    return Engine(spark, args.root, embedder=embedder, mode=args.mode, overwrite=args.overwrite, chat=chat, prompts=prompts)


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("lorewell").getOrCreate()
    engine = build(spark, args)
    corpus = files.corpus(spark, args.corpus)
    if args.extractions:
        engine.take_extractions(files.openie_json(spark, args.extractions, engine.config.chunk_prefix))
    if args.openie_mode == "offline":
        engine.add_chunks(corpus)
        print(engine.extract_only().count(), "passages extracted")
        return
    engine.index(corpus)
    rows = files.questions(spark, args.questions).withColumn("query_id", F.xxhash64("id"))
    ranked = engine.retrieve(rows.select("query_id", "question"))
    gold = evaluate.gold_docs(rows, evaluate.sentence_separator(args.dataset)).join(rows.select("id", "query_id"), "id").select("query_id", "gold")
    engine.recall(ranked, gold)[0].orderBy("k").show()
    answers = evaluate.gold_answers(rows).join(rows.select("id", "query_id"), "id").select("query_id", F.col("answers").alias("gold_answers"))
    out, scores = engine.rag_qa(ranked, answers)
    out.select("question", "answer").show(truncate=False)
    scores.show()
    engine.usage().show()
    print({k: round(v, 3) for k, v in engine.seconds.items()})


if __name__ == "__main__":
    main()
