"""Normalisation of names, types, expressions and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from changegate.constants import ASSET_TYPE_PREFIXES

# Quoted text with doubled quotes inside.  Possessive: the engine takes long text in a loop instead of on its stack.
_SINGLE_QUOTED = r"'[^']*+(?:''[^']*+)*+'"
_DOUBLE_QUOTED = r'"[^"]*+(?:""[^"]*+)*+"'

WHITESPACE = " \t\n\r\f\x0b"

# Type names written differently but meaning the same type.
TYPE_ALIASES = {
    "BIGINT": "BIGINT",
    "BOOL": "BOOLEAN",
    "CHARACTER VARYING": "VARCHAR",
    "DOUBLE PRECISION": "DOUBLE",
    "FLOAT8": "DOUBLE",
    "INT2": "SMALLINT",
    "INT4": "INT",
    "INT8": "BIGINT",
    "INTEGER": "INT",
    "LONG": "BIGINT",
    "NUMERIC": "DECIMAL",
    "STRING": "TEXT",
}
# In this dialect every character type is one unbounded text type.
TEXT_TYPES = ("CHAR", "BPCHAR", "VARCHAR", "TEXT", "STRING", "CHARACTER VARYING")


def strip(value: Column) -> Column:
    return F.btrim(value, F.lit(WHITESPACE))


def blank_to_null(value: Column) -> Column:
    stripped = strip(value)
    return F.when(stripped != "", stripped)


def normalize_identifier(name: Column, quoted: Column | None = None) -> Column:
    """Lower-case unless quoted; a quoted name keeps case and its quotes.

    An empty name gives null, which callers turn into a rejection.
    """
    text = blank_to_null(name)
    plain = F.lower(text)
    if quoted is None:
        return plain
    kept = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(F.coalesce(quoted, F.lit(False)), kept).otherwise(plain)


def canonical_relation(name: Column) -> Column:
    """Dotted relation name with unquoted parts lower-cased, quoted parts kept."""
    parts = F.regexp_extract_all(name, F.lit(rf"({_DOUBLE_QUOTED}|[^.\"]+)"), 1)
    fixed = F.transform(parts, lambda p: F.when(p.startswith('"'), p).otherwise(F.lower(strip(p))))
    return F.array_join(F.filter(fixed, lambda p: p != ""), ".")


def relation_name(node: Column) -> Column:
    """Physical name of a node: the declared one, else its parts joined by dots."""
    terminal = F.coalesce(*[F.when(node[f] != "", node[f]) for f in ("alias", "identifier", "name")])
    parts = F.concat_ws(
        ".",
        F.when(node["database"] != "", node["database"]),
        F.when(node["schema"] != "", node["schema"]),
        terminal,
    )
    return blank_to_null(canonical_relation(F.coalesce(blank_to_null(node["relation_name"]), parts)))


def one_text_type(adapter: Column) -> Column:
    """Whether all character types of an adapter's dialect are one unbounded text type."""
    # Fixed value: the adapter whose dialect has one text type.
    return F.coalesce(F.lower(adapter) == "duckdb", F.lit(False))


def canonical_type(raw: Column, text_types: Column) -> Column:
    """Upper-case type with one spacing style and one name per meaning.

    ``text_types`` folds all character types (with or without length) to TEXT,
    which is right in some dialects only (see ``one_text_type``).
    """
    upper = F.upper(F.regexp_replace(blank_to_null(raw), r"\s+", " "))
    base = F.rtrim(F.regexp_extract(upper, r"^([^(]*)", 1))
    args = F.regexp_extract(upper, r"(\(.*)$", 1)
    args = F.regexp_replace(args, r"\s*,\s*", ", ")
    args = F.regexp_replace(F.regexp_replace(args, r"\(\s+", "("), r"\s+\)", ")")
    aliases = F.create_map(*[F.lit(x) for pair in TYPE_ALIASES.items() for x in pair])
    named = F.coalesce(F.try_element_at(aliases, base), base)
    spelled = F.concat(named, args)
    return F.when(text_types & base.isin(*TEXT_TYPES), F.lit("TEXT")).otherwise(spelled)


def type_fingerprint(raw: Column) -> Column:
    """Whitespace-free lower-case type, used to detect drift of catalog types."""
    return F.lower(F.regexp_replace(raw, r"\s", ""))


def canonical_json_text(value: Column) -> Column:
    """JSON text with sorted keys at all levels and no layout; text that is no JSON stays as it is.

    A variant keeps the fields of an object in the order of their names.
    """
    return F.coalesce(F.to_json(F.try_parse_json(value)), value)


def constraint_kind(constraint: Column) -> Column:
    """Kind of a constraint: the ``type`` of an object's JSON text, or the text itself."""
    stated = F.when(constraint.startswith("{"), F.get_json_object(constraint, "$.type")).otherwise(constraint)
    return F.replace(F.lower(strip(stated)), F.lit(" "), F.lit("_"))


def derive_nullable(nullable: Column, not_null: Column, constraints: Column) -> Column:
    """Nullability: declared, else the opposite of not_null, else a constraint, else unknown.

    ``constraints`` are texts, as for ``constraint_kind``.
    """
    stated = F.exists(constraints, lambda c: F.coalesce(constraint_kind(c) == "not_null", F.lit(False)))
    return F.coalesce(nullable, ~not_null, F.when(stated, F.lit(False)))


def normalize_expression(expression: Column) -> Column:
    """Expression text without layout: case and spacing outside quotes do not count."""
    pieces = F.regexp_extract_all(expression, F.lit(rf"""({_SINGLE_QUOTED}|{_DOUBLE_QUOTED}|[^'"]+)"""), 1)

    def tidy(piece: Column) -> Column:
        spaced = F.lower(F.regexp_replace(piece, r"\s+", " "))
        return F.regexp_replace(spaced, r" ?([(),=<>+*/|-]) ?", "$1")

    quoted = lambda p: p.startswith("'") | p.startswith('"')
    return strip(F.array_join(F.transform(pieces, lambda p: F.when(quoted(p), p).otherwise(tidy(p))), ""))


def expression_fingerprint(expression: Column) -> Column:
    return F.sha2(normalize_expression(blank_to_null(expression)), 256)


def asset_type(urn: Column) -> Column:
    branch = F
    for prefix, kind in ASSET_TYPE_PREFIXES.items():
        branch = branch.when(urn.startswith(prefix), F.lit(kind))
    return branch.otherwise(F.lit("other"))


def valid_urn(urn: Column) -> Column:
    # Fixed value: shape of an entity name.
    return F.coalesce(urn.rlike(r"^urn:li:[A-Za-z][A-Za-z0-9]*:\S+\z"), F.lit(False))


def dataset_name(urn: Column) -> Column:
    """Qualified dataset name between the first and the last comma, percent-decoded."""
    # Fixed value: shape of a dataset name.
    inner = F.regexp_extract(urn, r"^urn:li:dataset:\(([^,]*),(.*),[^,]*\)\z", 2)
    decoded = F.try_url_decode(F.replace(inner, F.lit("+"), F.lit("%2B")))
    return F.when(urn.startswith("urn:li:dataset:("), blank_to_null(F.coalesce(decoded, inner)))


def assertion_fields(fields: Column) -> Column:
    """Distinct lower-case field paths of one assertion; unreadable ones are skipped."""
    usable = F.filter(F.coalesce(fields, F.array().cast("array<string>")), lambda f: F.coalesce(f != "", F.lit(False)))
    return F.array_distinct(F.transform(usable, F.lower))


def posix_path(path: Column) -> Column:
    """Forward slashes, no empty or dot segments, no trailing slash."""
    slashed = F.replace(path, F.lit("\\"), F.lit("/"))
    root = F.when(slashed.rlike("^//[^/]"), "//").when(slashed.startswith("/"), "/").otherwise("")
    parts = F.filter(F.split(slashed, "/"), lambda p: (p != "") & (p != "."))
    joined = F.concat(root, F.array_join(parts, "/"))
    return F.when(joined != "", joined).when(path.isNotNull(), F.lit("."))


def sorted_unique(values: Column) -> Column:
    return F.array_sort(F.array_distinct(values))


def clean_detail(detail: Column) -> Column:
    return blank_to_null(detail)
