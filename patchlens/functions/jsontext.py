"""Getting typed review results out of free-form answers.

All of it is Column expressions: a regular expression cuts the text into strings,
braces and the rest, a fold finds the matching brace, and VARIANT keeps the JSON
type of every value so that strict and lenient decoding can differ by field.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from patchlens.functions.text import col, let, text, trim_space

# Token and comment patterns of the answer format.
JSON_TOKENS = r'"[^"\\]*+(?:\\(?s:.)[^"\\]*+)*+"?|[{}]|[^"{}]+'
BRACE_TOKENS = r"[{}]|[^{}]+"
JSON_COMMENTS = r'("[^"\\]*+(?:\\(?s:.)[^"\\]*+)*+"?)|//[^\n]*|(?s:/\*.*?(?:\*/|\z))'

ISSUE_TEXT_FIELDS = ["type", "severity", "title", "description", "suggestion"]
ISSUE_TYPE = "struct<type:string,severity:string,line:bigint,title:string,description:string,suggestion:string>"
RESULT_TYPE = f"struct<issues:array<{ISSUE_TYPE}>,summary:string,risk_score:bigint,recommendation:string>"


def extract_json(c: Column | str, string_aware: bool = True) -> Column:
    """The text from the first '{' to its matching '}'; '' if there is no '{'.

    Braces inside strings do not count when string_aware, and then text that never
    closes is returned to its end; otherwise they count and it gives ''.
    """
    pattern = F.lit(JSON_TOKENS if string_aware else BRACE_TOKENS)

    def step(acc: Column, token: Column) -> Column:
        depth = acc["depth"] + F.when(token == "{", 1).when(token == "}", -1).otherwise(0)
        at = acc["at"] + F.length(token)
        end = F.when((token == "}") & (depth == 0), at).otherwise(F.lit(0))
        moved = F.struct(depth.alias("depth"), at.alias("at"), end.alias("end"))
        return F.when(acc["end"] > 0, acc).otherwise(moved)

    zero = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end"))

    def to_end(tail: Column) -> Column:
        end = F.aggregate(F.regexp_extract_all(tail, pattern, F.lit(0)), zero, step, lambda acc: acc["end"])
        unclosed = tail if string_aware else F.lit("")
        return let(end, lambda e: F.when(e > 0, F.substr(tail, F.lit(1), e)).otherwise(unclosed))

    def from_start(value: Column) -> Column:
        return F.when(value.contains("{"), let(F.substr(value, F.instr(value, "{")), to_end)).otherwise("")

    return let(text(c), from_start)


def strip_json_comments(c: Column | str) -> Column:
    """Without // and /* */ comments; strings stay as they are, line breaks too."""
    return F.regexp_replace(text(c), JSON_COMMENTS, "$1")


def _kind(value: Column) -> Column:
    """JSON type of a VARIANT; a missing value and a JSON null both read 'VOID'."""
    return F.coalesce(F.schema_of_variant(value), F.lit("VOID"))


def flex_int(value: Column) -> Column:
    """A VARIANT that should be an integer, read leniently.

    Integers as they are; texts by their value or their first number; all else 0.
    """
    kind = _kind(value)
    written = trim_space(F.try_variant_get(value, "$", "string"))
    from_text = F.when(
        written.rlike(r"^[+-]?[0-9]+$"), written.try_cast("bigint")
    ).otherwise(F.regexp_extract(written, "[1-9][0-9]*", 0).try_cast("bigint"))
    return F.coalesce(
        F.when(kind == "BIGINT", F.try_variant_get(value, "$", "bigint")).when(kind == "STRING", from_text), F.lit(0).cast("bigint")
    )


def _field(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f"$.{name}", "variant")


def _is(value: Column, kind: str) -> Column:
    return _kind(value).isin(kind, "VOID")


def _is_object(value: Column) -> Column:
    return _kind(value).startswith("OBJECT") | (_kind(value) == "VOID")


Spec = str | list | dict


def is_typed(value: Column, spec: Spec) -> Column:
    """Whether a VARIANT has the types of the spec, at every depth; missing values and nulls fit all.

    A spec is the name of a JSON type, a list with the spec of its items, or a dict of
    field specs; fields it does not name may be anything.
    """
    if isinstance(spec, str):
        return _is(value, spec)
    if isinstance(spec, list):
        items = F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.array().cast("array<variant>"))
        return (_kind(value).startswith("ARRAY") | (_kind(value) == "VOID")) & F.forall(items, lambda item: is_typed(item, spec[0]))
    def field_fits(name: str, inner: Spec) -> Column:
        return is_typed(_field(value, name), inner) if isinstance(inner, str) else let(_field(value, name), lambda v: is_typed(v, inner))

    return reduce(Column.__and__, (field_fits(*item) for item in spec.items()), _is_object(value))


def plain_schema(spec: Spec) -> str:
    """A regular expression of the schemas, as schema_of_variant prints them, that fit the spec and have no other fields.

    A value of such a schema is_typed, so most values need one look at their schema and none
    at their fields. Items of different types print as VARIANT, which is not in it.
    """
    if isinstance(spec, str):
        return f"(?:{spec}|VOID)"
    if isinstance(spec, list):
        return f"(?:ARRAY<{plain_schema(spec[0])}>|VOID)"
    fields = "|".join(f"{name}: {plain_schema(inner)}" for name, inner in spec.items())
    return f"(?:OBJECT<(?:(?:{fields})(?:, )?)*+>|VOID)"


def object_error(json: Column | str, spec: dict, message: str) -> Column:
    """'' for the text of a JSON object of these types, else the message."""

    def of_kind(value: Column, kind: Column) -> Column:
        plain = kind.rlike(rf"\A{plain_schema(spec)}\z") & (kind != "VOID")
        return F.when(plain, "").when(kind.startswith("OBJECT"), F.when(is_typed(value, spec), "").otherwise(message)).otherwise(message)

    return let(F.try_parse_json(col(json)), lambda v: let(_kind(v), lambda kind: of_kind(v, kind)))


def _issue_is_typed(issue: Column) -> Column:
    ok = _is_object(issue) & _is(_field(issue, "line"), "BIGINT")
    for name in ISSUE_TEXT_FIELDS:
        ok = ok & _is(_field(issue, name), "STRING")
    return ok


def _string_field(value: Column, name: str) -> Column:
    return F.coalesce(F.try_variant_get(value, f"$.{name}", "string"), F.lit(""))


def _issue(value: Column) -> Column:
    return F.struct(
        _string_field(value, "type").alias("type"),
        _string_field(value, "severity").alias("severity"),
        F.coalesce(F.try_variant_get(value, "$.line", "bigint"), F.lit(0).cast("bigint")).alias("line"),
        _string_field(value, "title").alias("title"),
        _string_field(value, "description").alias("description"),
        _string_field(value, "suggestion").alias("suggestion"),
    )


RESULT_SPEC = {"issues": [dict.fromkeys(ISSUE_TEXT_FIELDS, "STRING") | {"line": "BIGINT"}], "summary": "STRING", "recommendation": "STRING"}
ANY_SCALAR = r"[A-Z]+(?:\([0-9,]+\))?"  # of risk_score


def _is_typed_result(value: Column, issues: Column) -> Column:
    plain = rf"\A{plain_schema(RESULT_SPEC | {'risk_score': ANY_SCALAR})}\z"
    return value.isNotNull() & (_kind(value).rlike(plain) | _fields_are_typed(value, issues))


def _fields_are_typed(value: Column, issues: Column) -> Column:
    issues_kind = _kind(_field(value, "issues"))
    return (
        (issues_kind.startswith("ARRAY") | (issues_kind == "VOID"))
        & _is(_field(value, "summary"), "STRING")
        & _is(_field(value, "recommendation"), "STRING")
        & F.forall(issues, _issue_is_typed)
    )


RESULT_FIELDS = ["issues", "summary", "risk_score", "recommendation"]
FIELDS = [*RESULT_FIELDS, *ISSUE_TEXT_FIELDS, "line"]


def fold_field_names(json: Column | str) -> Column:
    """The text with the known field names in lower case, as they may be written in any.

    An unescaped quotation mark cannot stand inside a string, so a name between two of
    them with a colon behind is a field.
    """
    names = "|".join(FIELDS)

    def folded(value: Column, odd: Column, name: str) -> Column:
        # The quotation mark stands first, so that the search passes over all else quickly.
        return let(value, lambda v: F.when(F.array_contains(odd, name), F.regexp_replace(v, rf'"(?<!\\")(?i:{name})"(\s*:)', f'"{name}"$1')).otherwise(v))

    def fold(odd: Column) -> Column:
        """odd: the names in need of it, so that the text is rewritten for those only."""
        return reduce(lambda value, name: folded(value, odd, name), FIELDS, col(json))

    odd = F.transform(F.regexp_extract_all(col(json), F.lit(rf'"(?!(?:{names})")((?i:{names}))"\s*:'), F.lit(1)), F.lower)
    return let(odd, lambda found: F.when(F.size(found) > 0, fold(found)).otherwise(col(json)))


def _last_of_each(json: Column) -> Column:
    """The object as a VARIANT when it repeats fields: of each the last one counts, in issues too."""
    read = F.from_json(json, "struct<" + ",".join(f"{n}:{'array<map<string,variant>>' if n == 'issues' else 'variant'}" for n in RESULT_FIELDS) + ">")

    def issue(fields: Column) -> Column:
        last = lambda n: F.try_element_at(F.filter(F.map_entries(fields), lambda e: e["key"] == n), F.lit(-1))["value"]
        return F.struct(*(last(n).alias(n) for n in [*ISSUE_TEXT_FIELDS, "line"]))

    known = lambda r: F.struct(F.transform(r["issues"], issue).alias("issues"), *(r[n].alias(n) for n in RESULT_FIELDS[1:]))
    return let(read, lambda r: F.to_variant_object(known(r)))


def _issues_are_no_list(json: Column) -> Column:
    return json.rlike(r'(?<!\\)"issues"\s*:\s*(?!\[|null\b)')


def parse_object(json: Column | str) -> Column:
    """A JSON object text as a VARIANT; null when it is none. Only texts with repeated fields are read a second way."""
    repeated = let(F.json_object_keys(col(json)), lambda keys: F.when(keys.isNotNull() & ~_issues_are_no_list(col(json)), _last_of_each(col(json))))
    return let(F.try_parse_json(col(json)), lambda value: F.when(value.isNotNull(), value).otherwise(repeated))


def _result_of(value: Column, issues: Column) -> Column:
    return F.struct(
        F.transform(issues, _issue).alias("issues"),
        _string_field(value, "summary").alias("summary"),
        flex_int(_field(value, "risk_score")).alias("risk_score"),
        _string_field(value, "recommendation").alias("recommendation"),
    ).cast(RESULT_TYPE)


def decode_result(json: Column | str) -> Column:
    """A JSON object text as a review result; null when it is not one.

    One field of another type, at any depth but risk_score, makes the whole text
    invalid; missing fields and nulls become '', 0 and no issues. Field names may be
    written in any case, and of a repeated field the last one counts. The parsed value
    and its issues are bound, so that each text is parsed once.
    """

    def from_value(value: Column) -> Column:
        none = F.array().cast("array<variant>")
        issues = F.coalesce(F.try_variant_get(value, "$.issues", "array<variant>"), none)
        return let(issues, lambda i: F.when(_is_typed_result(value, i), _result_of(value, i)))

    return let(fold_field_names(json), lambda folded: let(parse_object(folded), from_value))
