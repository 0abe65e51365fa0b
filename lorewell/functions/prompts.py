"""Prompt templates and query instructions; driver-side resources."""

from __future__ import annotations

import importlib.util
import json
import re
from pathlib import Path
from string import Template

#: Fixed: instructions that embedding models get with a query.
INSTRUCTIONS = {
    "ner_to_node": "Given a phrase, retrieve synonymous or relevant phrases that best match this phrase.",
    "query_to_node": "Given a question, retrieve relevant phrases that are mentioned in this question.",
    "query_to_fact": "Given a question, retrieve relevant triplet facts that matches this question.",
    "query_to_sentence": "Given a question, retrieve relevant sentences that best answer the question.",
    "query_to_passage": "Given a question, retrieve relevant documents that best answer the question.",
}


def instruction(linking: str) -> str:
    return INSTRUCTIONS.get(linking, INSTRUCTIONS["query_to_passage"])


def to_template(text: str, rename: dict[str, str] | None = None, static: dict[str, str] | None = None) -> str:
    """Turn ``{name}`` fields into ``${name}``, renamed or filled in as given."""
    rename, static = rename or {}, static or {}

    def field(m: re.Match) -> str:
        return static[m[1]] if m[1] in static else "${" + rename.get(m[1], m[1]) + "}"

    return re.sub(r"\{(\w+)\}", field, text)

_ENTITIES = """Name the things that the passage is about: people, places, organisations, works, events, dates, numbers with what they count.
Copy each as it is written. Answer with JSON alone: {"named_entities": ["...", "..."]}"""
_TRIPLES = """State what the passage says as triples of subject, relation and object.
Let subject or object be one of the named entities wherever you can, write names out in place of pronouns, and state each thing once.
Answer with JSON alone: {"triples": [["subject", "relation", "object"], ...]}"""
_FILTER = """You get a question and facts in JSON. Keep the facts, four at most, that help to answer it, the most useful first, exactly as they are written.
If none helps, keep none. Answer in this form:

[[ ## fact_after_filter ## ]]
{"fact": [["subject", "relation", "object"], ...]}

[[ ## completed ## ]]"""
_ANSWER = """Answer the question from the passages. First think in a few sentences after "Thought:"; then write "Answer: " and the answer alone, as short as it can be."""
_THOUGHT = """You gather passages step by step. From the passages and your thoughts so far, write the next thought: one sentence that says what you learned or what is missing.
Once the answer is clear, write "So the answer is: " and the answer."""


def default_templates() -> dict[str, list[dict[str, str]]]:
    """The engine's own prompts, each a system text and a user turn with fields."""
    turn = lambda system, user: [{"role": "system", "content": system}, {"role": "user", "content": user}]
    return {
        "entities": turn(_ENTITIES, "${passage}"),
        "triples": turn(_TRIPLES, "Passage:\n${passage}\n\nNamed entities:\n${named_entity_json}"),
        "fact_filter": turn(_FILTER, "[[ ## question ## ]]\n${question}\n\n[[ ## fact_before_filter ## ]]\n${facts}"),
        "answer": turn(_ANSWER, "${prompt_user}"),
        "next_thought": turn(_THOUGHT, "${prompt_user}"),
    }


class Prompts:
    """Templates by name: a text, or a list of chat messages (role, content)."""

    def __init__(self, templates: dict[str, str | list[dict[str, str]]] | None = None):
        self.templates = dict(templates or {})

    @classmethod
    def default(cls) -> Prompts:
        return cls(default_templates())

    def replaced(self, others: Prompts) -> Prompts:
        """These templates, with those of ``others`` in place of ones of the same name."""
        return Prompts(self.templates | others.templates)

    @classmethod
    def from_directory(cls, path: str) -> Prompts:
        """Every Python file of the directory that defines ``prompt_template``."""
        found = {}
        for file in sorted(Path(path).glob("*.py")):
            if file.stem == "__init__":
                continue
            spec = importlib.util.spec_from_file_location(f"prompt_{file.stem}", file)
            module = importlib.util.module_from_spec(spec)
            spec.loader.exec_module(module)
            if not hasattr(module, "prompt_template"):
                raise ValueError(f"{file} defines no prompt_template")
            found[file.stem] = module.prompt_template
        return cls(found)

    @classmethod
    def filter_from_json(cls, path: str, name: str = "fact_filter") -> Prompts:
        """A filter prompt from a JSON file of a system text and question demonstrations."""
        spec = json.loads(Path(path).read_text())
        chat = [{"role": "system", "content": spec["system"]}]
        for demo in spec.get("demos", []):
            chat += [
                {"role": "user", "content": f"[[ ## question ## ]]\n{demo['question']}\n\n[[ ## fact_before_filter ## ]]\n{demo['fact_before_filter']}"},
                {"role": "assistant", "content": f"[[ ## fact_after_filter ## ]]\n{demo['fact_after_filter']}\n\n[[ ## completed ## ]]"},
            ]
        chat.append({"role": "user", "content": "[[ ## question ## ]]\n${question}\n\n[[ ## fact_before_filter ## ]]\n${facts}"})
        return cls({name: chat})

    def names(self) -> list[str]:
        return sorted(self.templates)

    def valid(self, name: str) -> bool:
        return name in self.templates

    def get(self, name: str) -> str | list[dict[str, str]]:
        if name not in self.templates:
            raise KeyError(f"no template {name}; there are {self.names()}")
        return self.templates[name]

    def render(self, name: str, **values: str) -> str | list[dict[str, str]]:
        """Fill in ``${name}`` fields; a missing one is an error."""
        template = self.get(name)

        def fill(text: str) -> str:
            try:
                return Template(text).substitute(values)
            except KeyError as e:
                raise ValueError(f"template {name} needs {e}") from e

        return fill(template) if isinstance(template, str) else [{**m, "content": fill(m["content"])} for m in template]
