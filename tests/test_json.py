"""Answer decoding on literal cases."""

from pyspark.sql import functions as F
from test_text import values

from patchlens.functions import jsontext as j
from patchlens.operators.answers import BAD_JSON, NO_JSON, parse_responses


def test_flex_int(spark):
    cases = {
        "5": 5, '"10"': 10, '" 7 "': 7, '""': 0, "0": 0, "-3": -3, '"high: 8"': 8, "7.5": 0, '"7.5"': 7, "null": 0, "true": 0, "{}": 0,
        '"0x5"': 5, '"-8 pts"': 8, '"+5"': 5, "7.0": 0, "[1]": 0,
    }
    assert values(spark, cases, lambda v: j.flex_int(F.try_parse_json(v))) == list(cases.values())


def test_extract_json(spark):
    cases = {
        '{"a": 1}': '{"a": 1}', 'Text\n```json\n{"issues": []}\n```\nend {x}': '{"issues": []}', 'Result: {"a": 1}': '{"a": 1}',
        '{"a": {"b": {"c": 1}}} x': '{"a": {"b": {"c": 1}}}', '{"a": "}{ \\" }"} z': '{"a": "}{ \\" }"}', "none": "", "{}": "{}",
        'x {"a": "b" } {': '{"a": "b" }', '{"a": {': '{"a": {', '{"a": "\\\\"} {"b": 1}': '{"a": "\\\\"}', "": "",
    }
    assert values(spark, cases, j.extract_json) == list(cases.values())
    plain = values(spark, ['{"a": "}"} z', '{"a": {', "{}"], lambda v: j.extract_json(v, string_aware=False))
    assert plain == ['{"a": "}', "", "{}"]


def test_strip_comments(spark):
    cases = {
        '{"a": 1}': '{"a": 1}', '{"a": 1 // note\n}': '{"a": 1 \n}', '{/* x\ny */"a": 1}': '{"a": 1}',
        '{"u": "http://x/y"} // z': '{"u": "http://x/y"} ', '{"a": "\\"// no"} /* open': '{"a": "\\"// no"} ',
    }
    assert values(spark, cases, j.strip_json_comments) == list(cases.values())


def test_parse_responses(spark):
    issue = '{"type":"SECURITY","severity":"HIGH","line":4,"title":"t","description":"d","suggestion":"s"}'
    cases = [
        ('{"issues":[%s],"summary":"s","risk_score":8,"recommendation":"APPROVE"}' % issue, "", 1, 8),
        ('```json\n{"issues":[]}\n```', "", 0, 0),
        ('{"issues":[], // c\n"risk_score":1}', "", 0, 1),
        ('{"risk_score":"5"}', "", 0, 5),
        ("nothing", NO_JSON, None, None),
        ('{"issues": [}', BAD_JSON, None, None),
        ('{"issues":[{"line":"42"}]}', BAD_JSON, None, None),
        ('{"issues":[{"line":5},{"line":5.5}]}', BAD_JSON, None, None),
        ('{"issues":[null,{"line":1}],"summary":null}', "", 2, 0),
        ('{"summary":5}', BAD_JSON, None, None),
        ('{"issues":{}}', BAD_JSON, None, None),
        ('{"issues":[],}', BAD_JSON, None, None),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, response string")
    rows = parse_responses(df).orderBy("i").collect()
    got = [(r.error, r.result and len(r.result.issues), r.result and r.result.risk_score) for r in rows]
    assert got == [c[1:] for c in cases]
    assert rows[0].result.issues[0].asDict() == {
        "type": "SECURITY", "severity": "HIGH", "line": 4, "title": "t", "description": "d", "suggestion": "s",
    }


def test_failed_completions_keep_their_error(spark):
    df = spark.createDataFrame([(None, "timeout"), ("{}", "")], "response string, error string")
    assert sorted((r.error, r.result is None) for r in parse_responses(df).collect()) == [("", False), ("timeout", True)]
