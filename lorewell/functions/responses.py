"""Parsing of model responses into typed columns; nothing is ever evaluated as code."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from lorewell import schemas


def _object_with(response: Column, field: str) -> Column:
    """The JSON object that holds ``field`` as a list, out of the text around it."""
    return F.regexp_extract(response, r'(?s)(\{[^{}]*"' + field + r'"\s*:\s*\[.*\][^{}]*\})', 1)


def parse_entities(response: Column) -> Column:
    """Distinct entities of a recognition response in order; an empty list if there is none or it can't be read."""
    found = F.from_json(_object_with(response, "named_entities"), schemas.NER_RESPONSE)["named_entities"]
    return F.array_distinct(F.coalesce(found, F.array().cast("array<string>")))


def parse_triples(response: Column) -> Column:
    """Triples of an extraction response as they stand; an empty list if there are none or they can't be read."""
    found = F.from_json(_object_with(response, "triples"), schemas.TRIPLE_RESPONSE)["triples"]
    return F.coalesce(found, F.array().cast(schemas.TRIPLES))


def parse_json_list(response: Column, field: str, kind: str) -> Column:
    """A list out of a response that is JSON as a whole (guided decoding)."""
    return F.coalesce(F.from_json(response, f"{field} {kind}")[field], F.array().cast(kind))


def parse_filter(response: Column, field: str = "fact_after_filter") -> Column:
    """The facts under the header ``[[ ## field ## ]]`` of a filter response; an empty list if they can't be read."""
    section = F.regexp_extract(response, r"(?s)\[\[ ## " + field + r" ## \]\]\s*(.*?)\s*(?:\[\[ ## |$)", 1)
    double = F.from_json(section, schemas.FILTER_RESPONSE)["fact"]
    single = F.from_json(section, schemas.FILTER_RESPONSE, {"allowSingleQuotes": "true"})["fact"]
    return F.coalesce(double, single, F.array().cast(schemas.TRIPLES))


def valid_triples(triples: Column) -> Column:
    """Triples of three parts, each once, in order, compared as raw text."""
    return F.array_distinct(F.filter(triples, lambda t: F.size(t) == 3))


def repair(text: str) -> str:
    """Close a JSON text that was cut off: drop what follows the last comma, then close what is open."""
    try:
        json.loads(text)
        return text
    except ValueError:
        pass
    comma = text.rfind(",")
    text = text[:comma] if comma >= 0 else text
    open_brackets, quoted, escaped = [], False, False
    for c in text:
        if quoted:
            quoted, escaped = escaped or c != '"', not escaped and c == "\\"
        elif c == '"':
            quoted = True
        elif c in "{[":
            open_brackets.append("}" if c == "{" else "]")
        elif c in "}]" and open_brackets and open_brackets[-1] == c:
            open_brackets.pop()
    return text + "".join(reversed(open_brackets))


def repair_json(response: Column) -> Column:
    @F.arrow_udf(StringType())
    def repair_all(texts: pa.Array) -> pa.Array:
        return pa.array([None if x is None else repair(x) for x in texts.to_pylist()], pa.string())

    return repair_all(response)


def repaired(response: Column, finish_reason: Column) -> Column:
    """Repair a response only where the model was cut off."""
    return F.when(finish_reason == "length", repair_json(response)).otherwise(response)
