"""Declarations of Go source files as rows of `elements`.

Every file is handled inside its own row: regular expressions cut it into tokens
and top-level pieces, folds over the tokens find matching brackets. No source text
is shuffled; one row per declaration leaves the job.

Assumes sources laid out by the standard formatter, where top-level declarations
start in column 0. Files that do not fit go to quarantine, not into the index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patchlens.functions.text import is_indexed_source, let, text
from patchlens.session import materialize

# Lexical forms of the language.
GO_TOKENS = (
    r"`[^`]*`?"
    r'|"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"?'
    r"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'?"
    r"|//[^\n]*"
    r"|(?s:/\*.*?(?:\*/|\z))"
    r"|[(){}\[\],;\n]"
    r"|[^`\"'/(){}\[\],;\n]+"
    r"|/"
)
DECLARATION_START = r"(?md)^(?=(?:func|type|const|var)\b)"
NAME = r"[\p{L}_][\p{L}\p{N}_]*"
QUOTED_OR_COMMENT = (
    r"`[^`]*`"
    r'|"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"'
    r"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'"
    r"|//[^\n]*"
    r"|(?s:/\*.*?\*/)"
)
HEADER = r"(?s)\A.*?\{[^\S\n]*(?=\n|//|\z)"  # up to the first line that ends with a brace
WHOLE_BODY = r"(?s)\A.*\n\}"
STRAY_TEXT = r"(?md)^(?!(?:package|import|func|type|const|var)\b|[)}\]]|\w+:)\S"
DOC_GROUP = r"(?s)(?:\A|\n)((?://[^\n]*\n|/\*(?:(?!\*/).)*\*/[ \t]*\n)+)\z"
DIRECTIVE = r"^//(?:[a-z0-9]+:[a-z0-9]|line |extern |export )"

GUARD = chr(0xE000)  # marks line starts inside raw strings and block comments while cutting

ELEMENT_COLUMNS = [
    "type", "name", "package", "file_path", "line", "signature", "doc", "body", "receiver", "imports", "references",
]


def _tokens(source: Column) -> Column:
    return F.regexp_extract_all(source, F.lit(GO_TOKENS), F.lit(0))


def _is_comment(token: Column) -> Column:
    return token.startswith("//") | token.startswith("/*")


def _line_breaks(value: Column) -> Column:
    return F.length(value) - F.length(F.replace(value, F.lit("\n"), F.lit("")))


def _opens(token: Column) -> Column:
    return token.isin("(", "[", "{")


def _closes(token: Column) -> Column:
    return token.isin(")", "]", "}")


def top_level_units(source: Column, tokens: Column) -> Column:
    """Tokens of `source` at bracket depth 0, each bracketed group as one text.

    Ends at a closing bracket without an opening one. The fold keeps offsets only,
    so it is linear in the text.
    """
    zero = F.struct(
        F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("opened"),
        F.array().cast("array<struct<start:int,size:int>>").alias("spans"),
    )

    def step(acc: Column, token: Column) -> Column:
        size = F.length(token)
        depth = acc["depth"] + F.when(_opens(token), 1).when(_closes(token), -1).otherwise(0)
        whole_group = (acc["depth"] == 1) & (depth == 0)
        plain = (acc["depth"] == 0) & (depth == 0)
        span = F.when(whole_group, F.struct(acc["opened"].alias("start"), (acc["at"] + size - acc["opened"]).alias("size"))).otherwise(
            F.struct(acc["at"].alias("start"), size.alias("size"))
        )
        return F.when(acc["depth"] < 0, acc).otherwise(
            F.struct(
                depth.alias("depth"),
                (acc["at"] + size).alias("at"),
                F.when((acc["depth"] == 0) & (depth == 1), acc["at"]).otherwise(acc["opened"]).alias("opened"),
                F.when(whole_group | plain, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"),
            )
        )

    return F.aggregate(
        tokens, zero, step, lambda acc: F.transform(acc["spans"], lambda s: F.substr(source, s["start"] + 1, s["size"]))
    )


def split_units(units: Column) -> Column:
    """array<struct<text, line>>: top-level units cut into specs at line ends and semicolons.

    A line that ends with an operator goes on. Comments are left out; `line` counts
    from 0.
    """
    item = "struct<text:string,line:int>"
    zero = F.struct(
        F.array().cast(f"array<{item}>").alias("done"), F.lit("").alias("text"), F.lit(0).alias("start"), F.lit(0).alias("line")
    )
    close = lambda acc: F.when(
        F.trim(acc["text"]) == "", acc["done"]
    ).otherwise(F.concat(acc["done"], F.array(F.struct(F.btrim(acc["text"], F.lit(" \t\n\r")).alias("text"), acc["start"].alias("line")))))

    def step(acc: Column, unit: Column) -> Column:
        blank = F.trim(F.translate(acc["text"], "\t\r", "  ")) == ""
        goes_on = F.rtrim(acc["text"]).rlike(r"[-+*/%&|^<>=!.,:(]$")
        ends = (unit == ";") | ((unit == "\n") & ~goes_on)
        comment = _is_comment(unit)
        return F.struct(
            F.when(ends, close(acc)).otherwise(acc["done"]).alias("done"),
            F.when(ends, "").when(comment, acc["text"]).when(blank, F.ltrim(F.translate(unit, "\t", " "))).otherwise(F.concat(acc["text"], unit)).alias("text"),
            F.when(blank & ~comment, acc["line"]).otherwise(acc["start"]).alias("start"),
            (acc["line"] + _line_breaks(unit)).alias("line"),
        )

    return F.aggregate(units, zero, step, close)


def _doc_text(before: Column) -> Column:
    """Comment directly above a declaration, without markers, ending in a line break."""
    group = F.regexp_extract(before, DOC_GROUP, 1)
    lines = F.filter(F.split(group, "\n"), lambda line: ~line.rlike(DIRECTIVE))
    plain = F.transform(lines, lambda line: F.regexp_replace(line, r"^// ?|^/\*|\*/[ \t]*$", ""))
    joined = F.regexp_replace(F.array_join(plain, "\n"), r"[ \t\r]+(?=\n|\z)", "")
    joined = F.regexp_replace(F.regexp_replace(joined, r"\A\n+|\n+\z", ""), r"\n{3,}", "\n\n")
    return F.when(joined == "", "").otherwise(F.concat(joined, F.lit("\n")))


def _inside(group: Column) -> Column:
    """Text between the brackets of a group."""
    return F.substr(group, F.lit(2), F.length(group) - 2)


def _entries(group: Column) -> Column:
    """The comma-separated entries between a group's brackets, trimmed, comments left out."""

    def joined(units: Column) -> Column:
        grown = F.aggregate(
            F.filter(units, lambda u: ~_is_comment(u)),
            F.array(F.lit("")),
            lambda acc, u: F.when(u == ",", F.concat(acc, F.array(F.lit("")))).otherwise(
                F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat(F.element_at(acc, -1), u)))
            ),
        )
        return F.filter(F.transform(grown, lambda e: F.btrim(e, F.lit(" \t\n\r"))), lambda e: e != "")

    return let(_inside(group), lambda inner: let(top_level_units(inner, _tokens(inner)), joined))


NAMED_ENTRY = rf"^(?!(?:chan|func|map|struct|interface)\b){NAME}\s+\S"


def _occurrences(value: Column, ch: str) -> Column:
    return F.length(value) - F.length(F.replace(value, F.lit(ch), F.lit("")))


def _plain(piece: Column) -> Column:
    return F.replace(piece, F.lit(GUARD), F.lit(""))


def _guarded(source: Column) -> Column:
    """Source with the line starts inside raw strings and block comments marked."""
    marked = F.array_join(
        F.transform(
            _tokens(source),
            lambda t: F.when(t.startswith("`") | t.startswith("/*"), F.replace(t, F.lit("\n"), F.lit("\n" + GUARD))).otherwise(t),
        ),
        "",
    )
    return F.when(source.contains("`") | source.contains("/*"), marked).otherwise(source)


def _problem(bare: Column) -> Column:
    """Why a file, given without its strings and comments, cannot be read; else null."""
    unlike = F.lit(False)
    for left, right in ("()", "[]", "{}"):
        unlike = unlike | (_occurrences(bare, left) != _occurrences(bare, right))
    return (
        F.when(~bare.rlike(rf"(?m)^package\s+{NAME}"), "no package clause")
        .when(bare.rlike("[\"`']|/\\*"), "open string or comment")
        .when(unlike, "unbalanced brackets")
        .when(bare.rlike(STRAY_TEXT), "text outside declarations")
    )


def read_pieces(files: DataFrame) -> DataFrame:
    """(framework, file_path, problem, package, imports, text, before, line): one row per declaration.

    A file with a problem gives one row with the reason and nothing else. All of a
    file's work is one bound expression below the generator, which also keeps later
    filters from being pushed into it and repeating it.
    """
    piece = "struct<problem:string,package:string,imports:array<string>,text:string,before:string,line:int>"

    def cut(bare: Column, source: Column) -> Column:
        failed = F.array(
            F.struct(
                _problem(bare).alias("problem"), F.lit("").alias("package"), F.array().cast("array<string>").alias("imports"),
                F.lit("").alias("text"), F.lit("").alias("before"), F.lit(0).alias("line"),
            )
        ).cast(f"array<{piece}>")
        package = F.regexp_extract(bare, rf"(?m)^package\s+({NAME})", 1)

        def listed(pieces: Column) -> Column:
            head = F.regexp_replace(F.get(pieces, F.lit(0)), r"(\"[^\"\n]*\"|`[^`\n]*`)|//[^\n]*|(?s:/\*.*?\*/)", "$1")
            imports = F.transform(F.regexp_extract_all(head, F.lit("\"[^\"\\n]*\"|`[^`\\n]*`"), F.lit(0)), lambda t: F.btrim(t, F.lit('"')))
            lines = F.aggregate(
                pieces, F.array(F.lit(1)), lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) + _line_breaks(p)))
            )
            indexes = F.when(F.size(pieces) > 1, F.sequence(F.lit(1), F.size(pieces) - 1)).otherwise(F.array().cast("array<int>"))
            return let(
                F.struct(imports.alias("imports"), lines.alias("lines"), package.alias("package")),
                lambda file: F.transform(
                    indexes,
                    lambda i: F.struct(
                        F.lit(None).cast("string").alias("problem"), file["package"].alias("package"), file["imports"].alias("imports"),
                        F.get(pieces, i).alias("text"), F.get(pieces, i - 1).alias("before"), F.get(file["lines"], i).alias("line"),
                    ),
                ).cast(f"array<{piece}>"),
            )

        return F.when(_problem(bare).isNotNull(), failed).otherwise(let(F.split(_guarded(source), DECLARATION_START), listed))

    source = text("content")
    pieces = let(F.regexp_replace(source, QUOTED_OR_COMMENT, ""), lambda bare: cut(bare, source))
    return files.select("framework", "file_path", F.explode(pieces).alias("p")).select("framework", "file_path", "p.*")


def quarantine(files: DataFrame) -> DataFrame:
    """Files that are left out of the index, with the reason."""
    return read_pieces(files).where("problem IS NOT NULL").select("framework", "file_path", F.col("problem").alias("reason"))


DECLARED = "struct<type:string,name:string,line:int,signature:string,body:string,receiver:string>"


def extract_elements(files: DataFrame, prune: bool = True) -> DataFrame:
    """Declarations of files(framework, file_path, content), in no particular order.

    A declaration whose name cannot be read is left out.
    """
    c = F.col
    if prune:
        files = files.where(is_indexed_source("file_path"))
    pieces = read_pieces(files).where("problem IS NULL")
    declared = F.when(c("text").startswith("func"), _function(c("text"), c("line"))).otherwise(_specs(c("text"), c("line")))
    rows = pieces.select("framework", "file_path", "package", "imports", _doc_text(_plain(c("before"))).alias("doc"), F.explode(declared).alias("d"))
    return rows.where("d.name <> ''").select(
        "framework", "d.type", "d.name", "package", "file_path", "d.line", "d.signature", "doc", "d.body", "d.receiver", "imports",
        F.array().cast("array<string>").alias("references"),
    )


def _named_type(entry: Column) -> Column:
    return F.regexp_extract(entry, rf"(?s)^{NAME}\s+(.*)$", 1)


def _parameter_text(entries: Column) -> Column:
    """Entries with grouped names expanded: `a, b int` gives `a int, b int`."""

    def expanded(e: Column, i: Column) -> Column:
        later = F.filter(F.slice(entries, i + 1, F.size(entries)), lambda x: x.rlike(NAMED_ENTRY))
        kind = _named_type(F.get(later, F.lit(0)))
        return F.when(e.rlike(NAMED_ENTRY), e).otherwise(F.concat(e, F.lit(" "), kind))

    named = F.exists(entries, lambda e: e.rlike(NAMED_ENTRY))
    return F.array_join(F.when(named, F.transform(entries, expanded)).otherwise(entries), ", ")


def _result_text(results: Column) -> Column:
    """One type per result field; grouped names are one field and names are dropped."""

    def shown(types: Column) -> Column:
        return F.when(F.size(types) > 1, F.concat(F.lit(" ("), F.array_join(types, ", "), F.lit(")"))).otherwise(
            F.concat(F.lit(" "), F.array_join(types, ""))
        )

    def from_entries(entries: Column) -> Column:
        fields = F.filter(entries, lambda e: e.rlike(NAMED_ENTRY))
        return let(F.when(F.size(fields) > 0, F.transform(fields, _named_type)).otherwise(entries), shown)

    return (
        F.when(results == "", "")
        .when(results.startswith("("), let(_entries(results), from_entries))
        .otherwise(F.concat(F.lit(" "), results))
    )


def _function(piece: Column, line: Column) -> Column:
    """array<DECLARED> of one function or method.

    Only the header is taken apart. It ends where a line ends with the body's brace,
    or, for a body on the same line, before the first brace group after white space;
    type literals have none before their brace.
    """

    def from_units(units: Column) -> Column:
        at = F.get(
            F.filter(
                F.sequence(F.lit(0), F.size(units)),
                lambda i: (F.get(units, i).startswith("{") & F.get(units, i - 1).rlike(r"\s$")) | (F.get(units, i) == "\n"),
            ),
            F.lit(0),
        )
        head = F.slice(units, F.lit(1), F.coalesce(at, F.size(units)))
        return let(F.filter(head, lambda u: ~_is_comment(u)), from_head)

    def from_head(head: Column) -> Column:
        is_method = (F.trim(F.get(head, F.lit(0))) == "func") & F.coalesce(F.get(head, F.lit(1)).startswith("("), F.lit(False))
        return let(
            F.struct(
                is_method.alias("is_method"),
                F.when(is_method, 2).otherwise(0).alias("name_at"),
                F.when(is_method, F.get(_entries(F.get(head, F.lit(1))), F.lit(0))).otherwise("").alias("receiver_entry"),
            ),
            lambda f: from_parts(head, f),
        )

    def from_parts(head: Column, f: Column) -> Column:
        receiver = F.when(f["receiver_entry"].rlike(NAMED_ENTRY), _named_type(f["receiver_entry"])).otherwise(f["receiver_entry"])
        name = F.regexp_extract(F.get(head, f["name_at"]), rf"({NAME})\s*$", 1)
        params_at = f["name_at"] + 1 + F.when(F.get(head, f["name_at"] + 1).startswith("["), 1).otherwise(0)
        results = F.btrim(F.array_join(F.slice(head, params_at + 2, F.size(head)), ""), F.lit(" \t\r\n"))
        signature = F.concat(
            F.lit("func "), F.when(f["is_method"], F.concat(F.lit("("), receiver, F.lit(") "))).otherwise(""), name,
            F.lit("("), let(_entries(F.get(head, params_at)), _parameter_text), F.lit(")"), let(results, _result_text),
        )
        return F.array(
            F.struct(
                F.when(f["is_method"], "method").otherwise("function").alias("type"), name.alias("name"), line.alias("line"),
                signature.alias("signature"), body.alias("body"), receiver.alias("receiver"),
            )
        ).cast(f"array<{DECLARED}>")

    many_lines = F.regexp_extract(piece, WHOLE_BODY, 0)
    # Strings are matched first, so that a // inside one is not taken for a comment.
    one_line = F.regexp_replace(F.regexp_extract(piece, r"\A[^\n]*", 0), r"(\"(?:[^\"\\]|\\.)*\"|`[^`]*`)|\s*//[^\n]*$", "$1")
    body = _plain(F.when(many_lines != "", many_lines).otherwise(one_line))
    header = F.regexp_extract(piece, HEADER, 0)
    # A brace at a line's end inside the parameters leaves brackets open: take the whole piece then.
    usable = (header != "") & (_occurrences(header, "(") == _occurrences(header, ")"))
    source = let(header, lambda h: F.when(usable, h).otherwise(piece))
    return let(_plain(source), lambda src: let(top_level_units(src, _tokens(src)), from_units))


def _specs(piece: Column, line: Column) -> Column:
    """array<DECLARED> of one type, const or var declaration, single or grouped."""
    keyword = F.regexp_extract(piece, r"^(type|const|var)\b", 1)
    prefix = F.regexp_extract(piece, r"^(?:type|const|var)\b\s*\(?", 0)

    def from_prefix(start: Column) -> Column:
        inner = _plain(F.substr(piece, F.length(start) + 1))
        specs = let(inner, lambda src: let(top_level_units(src, _tokens(src)), split_units))
        first_line = line + _line_breaks(start)
        return let(specs, lambda found: let(
            F.when(start.endswith("("), found).otherwise(F.slice(found, F.lit(1), F.lit(1))),
            lambda kept: F.flatten(F.transform(kept, lambda spec: declared(spec, first_line))),
        ))

    def declared(spec: Column, first_line: Column) -> Column:
        body = spec["text"]
        after_name = F.regexp_replace(body, rf"(?s)^{NAME}(?:\[[^\]]*\](?=\s))?\s*=?\s*", "")
        kind = let(
            after_name,
            lambda rest: F.when(rest.rlike(r"^struct\b"), "struct")
            .when(rest.rlike(r"^interface\b"), "interface")
            .when(rest.startswith("["), "array")
            .when(rest.startswith("map["), "map")
            .when(rest.rlike(r"^(?:<-\s*)?chan\b"), "chan")
            .otherwise("alias"),
        )
        names = F.split(F.regexp_extract(body, rf"^({NAME}(?:\s*,\s*{NAME})*)", 1), r"\s*,\s*")
        at = (first_line + spec["line"]).alias("line")
        receiver = F.lit("").alias("receiver")
        as_type = let(
            F.struct(F.regexp_extract(body, rf"^({NAME})", 1).alias("name"), kind.alias("kind")),
            lambda t: F.array(
                F.struct(
                    F.when(t["kind"].isin("struct", "interface"), t["kind"]).otherwise("type").alias("type"), t["name"].alias("name"), at,
                    F.concat(F.lit("type "), t["name"], F.lit(" "), t["kind"]).alias("signature"), body.alias("body"), receiver,
                )
            ).cast(f"array<{DECLARED}>"),
        )
        as_values = F.transform(
            names,
            lambda name: F.struct(
                keyword.alias("type"), name.alias("name"), at, F.lit("").alias("signature"), body.alias("body"), receiver
            ),
        ).cast(f"array<{DECLARED}>")
        return F.when(keyword == "type", as_type).otherwise(as_values)

    return let(prefix, from_prefix)


def numbered_elements(elements: DataFrame) -> DataFrame:
    """Elements with element_id in the order (framework, file_path, line, name), written once.

    Ids grow with that order and are dense within a range of it; a range-partitioned
    sort gives them, so no task numbers all rows.
    """
    order = ["framework", "file_path", "line", "name"]
    ordered = elements.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(ordered.withColumn("element_id", F.monotonically_increasing_id()), "elements")


def blocks(rows: DataFrame, key: list[str], content: str, start: str = DECLARATION_START) -> DataFrame:
    """Blocks of each text that begin where `start` matches: key + (block_no, line, n_lines, body).

    Text before the first start is block 0 and not returned.
    """
    c = F.col
    cut = rows.select(*key, F.split(text(content), start).alias("pieces"), text(content).alias("_text"))
    lead = F.when(F.regexp_instr("_text", F.lit(start)) == 1, 0).otherwise(1)
    cut = cut.withColumn("lead", F.when(c("_text").rlike(start), lead).otherwise(F.size("pieces"))).withColumn(
        "starts",
        F.aggregate("pieces", F.array(F.lit(1)), lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) + _line_breaks(p)))),
    )
    listed = cut.select(*key, "lead", "starts", F.posexplode("pieces").alias("at", "piece")).where(c("at") >= c("lead"))
    body = F.regexp_replace("piece", r"\n\z", "")
    return listed.select(
        *key,
        (c("at") - c("lead") + 1).cast("bigint").alias("block_no"),
        F.get("starts", c("at")).cast("bigint").alias("line"),
        (_line_breaks(body) + 1).cast("bigint").alias("n_lines"),
        body.alias("body"),
    )
