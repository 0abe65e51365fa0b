"""Scalar text functions as columns; all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Fixed: the ASCII punctuation that answer normalisation drops.
PUNCTUATION = r"[!-/:-@\[-`{-~]"


def content_key(content: Column, prefix: str = "") -> Column:
    """Content-addressed key: the prefix and the MD5 of the UTF-8 text."""
    return F.concat(F.lit(prefix), F.md5(content.cast("binary")))


def text_processing(text: Column) -> Column:
    """Lower case; every character but ASCII letters, digits and space becomes a space; outer spaces go."""
    return F.trim(F.regexp_replace(F.lower(text), "[^A-Za-z0-9 ]", " "))


def processed_triple(triple: Column) -> Column:
    return F.transform(triple, text_processing)


def alnum_length(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^A-Za-z0-9]", ""))


def normalize_answer(answer: Column) -> Column:
    """Lower case, without punctuation and articles, white space collapsed."""
    plain = F.regexp_replace(F.lower(answer), PUNCTUATION, "")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"\b(a|an|the)\b", " "), r"(?U)\s+", " "))


def fact_content(s: Column, p: Column, o: Column) -> Column:
    """The stored text of a processed triple; its parts never need escaping."""
    return F.format_string("('%s', '%s', '%s')", s, p, o)


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, " +"), lambda t: t != "")


def qa_prompt(docs: Column, question: Column, k: int = 5) -> Column:
    """The user prompt of question answering: the first k passages, then the question."""
    shown = F.transform(F.slice(docs, 1, k), lambda d: F.concat(F.lit("Wikipedia Title: "), d, F.lit("\n\n")))
    return F.concat(F.array_join(shown, ""), F.lit("Question: "), question, F.lit("\nThought: "))


def parse_answer(response: Column) -> Column:
    """What stands between the first ``Answer:`` and the next, stripped; without one the whole response."""
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    return F.coalesce(strip(F.try_element_at(F.split(response, "Answer:"), F.lit(2))), response)


def string_to_bool(text: Column) -> Column:
    low = F.lower(text)
    return (
        F.when(low.isin("yes", "true", "t", "y", "1"), True).when(low.isin("no", "false", "f", "n", "0"), False)
        .otherwise(F.raise_error(F.concat(F.lit("not a truth value: "), text)).cast("boolean"))
    )


def unescape_unicode(text: Column) -> Column:
    r"""Replace ``\uXXXX`` escapes by their characters, where the text is otherwise a legal JSON string."""
    quoted = F.concat(F.lit('{"v":"'), F.regexp_replace(F.replace(text, F.lit('"'), F.lit('\\"')), r"\\(?!u[0-9a-fA-F]{4}|\")", r"\\\\"), F.lit('"}'))
    return F.coalesce(F.from_json(quoted, "v string")["v"], text)


def merge_same_first_line(docs: Column) -> Column:
    """Passages that share their first line become one: the line, then their remainders, in order of first appearance."""
    first = lambda d: F.substring_index(d, "\n", 1)
    rest = lambda d: F.when(F.instr(d, "\n") > 0, F.substring(d, F.instr(d, "\n") + 1, F.length(d))).otherwise(F.lit(""))
    titles = F.array_distinct(F.transform(docs, first))
    return F.transform(titles, lambda t: F.concat(t, F.lit("\n"), F.array_join(F.transform(F.filter(docs, lambda d: first(d) == t), rest), "\n")))
