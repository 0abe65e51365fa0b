"""Schemas of the engine's tables."""

from __future__ import annotations

STORE = "hash_id string, content string, embedding array<float>"
CORPUS = "title string, text string, idx int"
TRIPLES = "array<array<string>>"
OPENIE = "idx string, passage string, extracted_entities array<string>, extracted_triples array<array<string>>, error string"
FACT_EDGES = "src string, dst string, weight double"
NODES = "node_id string, kind string, content string"
EDGES = "src string, dst string, weight double"
RESULT = "query_id long, question string, rank int, hash_id string, content string, score double, method string"
LLM_CACHE = "key string, message string, metadata string"
#: JSON schemas for models that can be held to one.
NER_JSON = {"type": "object", "properties": {"named_entities": {"type": "array", "items": {"type": "string"}}}, "required": ["named_entities"]}
TRIPLE_JSON = {
    "type": "object", "required": ["triples"],
    "properties": {"triples": {"type": "array", "items": {"type": "array", "items": {"type": "string"}, "minItems": 3, "maxItems": 3}}},
}
NER_RESPONSE = "named_entities array<string>"
TRIPLE_RESPONSE = "triples array<array<string>>"
FILTER_RESPONSE = "fact array<array<string>>"
PARAGRAPH = "title string, text string, paragraph_text string, is_supporting boolean, idx int"
QUESTIONS = f"""id string, question string, answer array<string>, answerable boolean,
paragraphs array<struct<title:string,text:string,paragraph_text:string,is_supporting:boolean,idx:int>>,
contexts array<struct<title:string,text:string,is_supporting:boolean>>,
context array<struct<title:string,sentences:array<string>>>,
supporting_titles array<string>,
gold_ans array<string>, reference array<string>, obj array<string>, possible_answers array<string>,
o_wiki_title array<string>, o_aliases array<string>, answer_aliases array<string>"""
#: Fields of question files that ``sources.files.questions`` brings into the form of QUESTIONS: a string or a list of strings,
#: and arrays of mixed types ([title, number], [title, [sentences]]).
STRING_OR_LIST = ("answer", "gold_ans", "reference", "obj", "possible_answers", "o_wiki_title", "o_aliases", "answer_aliases")
MIXED = ("supporting_facts", "context")
