import numpy as np
import pytest
from pyspark.sql import functions as F

from lorewell.functions import prompts, responses, text as tx, vectors


def column(spark, values, kind, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("x"))).collect()]


def test_text_processing_keeps_inner_spaces(spark):
    assert column(spark, ["Mara  Quill!", " A-b ", "", None, "é1"], "string", tx.text_processing) == ["mara  quill", "a b", "", None, "1"]


def test_content_key_is_md5(spark):
    assert column(spark, ["", "é"], "string", lambda c: tx.content_key(c, "chunk-")) == [
        "chunk-d41d8cd98f00b204e9800998ecf8427e", "chunk-" + __import__("hashlib").md5("é".encode()).hexdigest()
    ]


def test_normalize_answer(spark):
    assert column(spark, ["The  Cat, a dog!", "an apple", "theater"], "string", tx.normalize_answer) == ["cat dog", "apple", "theater"]


def test_parse_answer(spark):
    given = ["x Answer: 1862.\n", "none", "Answer: a Answer: b", None]
    assert column(spark, given, "string", tx.parse_answer) == ["1862.", "none", "a", None]


def test_string_to_bool(spark):
    assert column(spark, ["Yes", "0", "t"], "string", tx.string_to_bool) == [True, False, True]
    with pytest.raises(Exception, match="truth value"):
        column(spark, ["maybe"], "string", tx.string_to_bool)


def test_merge_same_first_line(spark):
    docs = [["T\na", "U\nb", "T\nc"]]
    assert column(spark, docs, "array<string>", tx.merge_same_first_line) == [["T\na\nc", "U\nb"]]


def test_unescape_unicode(spark):
    assert column(spark, [r"café", r"a\b", 'q"'], "string", tx.unescape_unicode) == ["café", r"a\b", 'q"']


def test_parse_entities(spark):
    given = ['Here {"named_entities": ["a", "b", "a"]} ok', "nothing", None]
    assert column(spark, given, "string", responses.parse_entities) == [["a", "b"], [], []]


def test_parse_triples_and_validity(spark):
    given = ['{"triples": [["a","b","c"],["a","b"],["a","b","c"],["a","b","c","d"]]}']
    assert column(spark, given, "string", lambda c: responses.valid_triples(responses.parse_triples(c))) == [[["a", "b", "c"]]]


def test_parse_filter(spark):
    given = ['[[ ## fact_after_filter ## ]]\n{"fact": [["a","b","c"]]}\n\n[[ ## completed ## ]]', "[[ ## fact_after_filter ## ]]\nno", ""]
    assert column(spark, given, "string", responses.parse_filter) == [[["a", "b", "c"]], [], []]


def test_repair():
    assert responses.repair('{"triples": [["a", "b", "c"], ["d", "e') == '{"triples": [["a", "b", "c"], ["d"]]}'
    assert responses.repair('{"a": 1}') == '{"a": 1}'


def test_repair_only_when_cut_off(spark):
    rows = spark.createDataFrame([('{"a": [1, 2', "length"), ('{"a": [1, 2', "stop")], "r string, f string")
    assert [r[0] for r in rows.select(responses.repaired(F.col("r"), F.col("f"))).collect()] == ['{"a": [1]}', '{"a": [1, 2']


def test_vectors(spark):
    assert column(spark, [[3.0, 4.0], [0.0, 0.0]], "array<float>", vectors.l2_normalise) == [[0.6, 0.8], [0.0, 0.0]]
    pooled = vectors.mean_pooling(np.array([[[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]]]), np.array([[1, 1, 0]]))
    assert pooled.tolist() == [[2.0, 3.0]]


def test_prompts(tmp_path):
    (tmp_path / "a.py").write_text('prompt_template = [{"role": "user", "content": "${x}"}]\n')
    found = prompts.Prompts.from_directory(str(tmp_path))
    assert found.names() == ["a"] and found.render("a", x="1") == [{"role": "user", "content": "1"}]
    with pytest.raises(ValueError):
        found.render("a")
    with pytest.raises(KeyError):
        found.get("b")
    assert prompts.to_template("{a} {b}", {"a": "c"}, {"b": "d"}) == "${c} d"
    assert prompts.instruction("nothing") == prompts.instruction("query_to_passage")
