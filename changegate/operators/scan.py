"""Content scans and checks of file lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns of the scans.
LOCAL_PATHS = (
    r"/Users/[A-Za-z0-9._-]+/",
    r"/home/[A-Za-z0-9._-]+/",
    r"[A-Za-z]:\\\\Users\\\\[A-Za-z0-9._-]+\\\\",
)
SECRET_SHAPES = (
    r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
    r"\bsk-proj-[A-Za-z0-9_-]{16,}",
    r"\bghp_[A-Za-z0-9]{20,}",
    r"(?i)\b(?:datahub[_-]?pat|dhpat)[_-][A-Za-z0-9_-]{20,}\b",
    r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b",
    r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b",
)
BEARER_VALUE = r"(?i)\bauthorization\b[^\r\n]{0,32}\bbearer[ \t]+([A-Za-z0-9._~+/=-]{16,})"
NAMED_SECRET = (
    r"(?i)(?<![A-Za-z0-9_-])([A-Za-z0-9_-]*?)(?:token|password|api[_-]?key|client[_-]?secret|"
    r"secret[_-]?access[_-]?key)\b[\"']?[ \t]*[:=][ \t]*"
    r"(?:[rubf]{0,2}[\"'])?([A-Za-z0-9_~+/=-]{20,})"
)
# The first alternative consumes the character before the address: the engine would otherwise find the tail of a longer one.
EMAIL = (
    r"(?i)(?:^|[^A-Za-z0-9._%+-])([A-Za-z0-9._%+-]{1,64}@"
    r"[A-Za-z0-9](?:[A-Za-z0-9.-]{0,251}[A-Za-z0-9])?\.[A-Za-z]{2,63})\b"
)
PLACEHOLDERS = (
    "changeme",
    "dummy",
    "example",
    "generated",
    "local",
    "placeholder",
    "redacted",
    "replace",
    "sample",
    "test",
)
ROLE_LOCALS = ("admin", "contact", "info", "no-reply", "noreply", "privacy", "security", "support")
RESERVED_DOMAINS = ("example.com", "example.net", "example.org")
RESERVED_SUFFIXES = (".example", ".invalid", ".localhost", ".test")
STATE_SEGMENTS = ("target", "logs", "__pycache__")
SECRET_SEGMENTS = (".env", "datahub-token", "document-index")
BAD_SUFFIXES = (".duckdb", ".sqlite", ".pyc")
CHECKSUM_LINE = r"^([0-9a-f]{64})  ([^\r\n]+)\z"
PNG_SIGNATURE = "89504E470D0A1A0A"

# Cheap text that must be present (in lower case) before a pattern can match:
# most documents have none, and are then passed over without running the pattern.
_SHAPE_HINTS = (
    ("private key-----",),
    ("sk-proj-",),
    ("ghp_",),
    ("dhpat", "datahub"),
    ("akia", "asia"),
    ("eyj",),
)
_NAME_HINTS = ("token", "password", "apikey", "api_key", "api-key", "secret")

NO_MATCHES = "array<string>"


def _ascii_boundaries(pattern: str) -> str:
    r"""Word boundaries that look at ASCII letters only, as a byte pattern does.

    ``\b`` of the JVM counts accented letters as word characters.
    """
    edge = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
    return pattern.replace(r"\b", edge)


def _any_word(lowered: Column, words: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | lowered.contains(word)
    return hit


def _count(text: Column, pattern: str, hint: Column) -> Column:
    return F.when(hint, F.regexp_count(text, F.lit(_ascii_boundaries(pattern)))).otherwise(0)


def _matches(text: Column, pattern: str, hint: Column, group: int = 1) -> Column:
    found = F.regexp_extract_all(text, F.lit(_ascii_boundaries(pattern)), group)
    return F.when(hint, found).otherwise(F.array().cast(NO_MATCHES))


def _total(counts: list[Column]) -> Column:
    out = counts[0]
    for more in counts[1:]:
        out = out + more
    return out


def _named_values(text: Column, hint: Column) -> Column:
    """Values given to secret names.

    The pattern finds the whole run of letters, digits, ``_`` and ``-`` before a name by one character class, which costs no
    stack however long it is.  The rule for that run is checked here: since its last ``-`` it is empty, or made of parts that
    each end in one ``_``.
    """
    named = F.arrays_zip(_matches(text, NAMED_SECRET, hint, 1).alias("before"), _matches(text, NAMED_SECRET, hint, 2).alias("value"))

    def well_named(pair: Column) -> Column:
        part = F.substring_index(pair["before"], "-", -1)
        return (part == "") | (part.endswith("_") & ~part.startswith("_") & ~part.contains("__"))

    return F.transform(F.filter(named, well_named), lambda pair: pair["value"])


def _real(value: Column) -> Column:
    """Without a placeholder word."""
    return ~_any_word(F.lower(value), PLACEHOLDERS)


def _found(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Per document the lower-case text, and from it the count of secret shapes and the values of names, each found once."""
    lowered = docs.select(F.col(key), F.col(text).alias("_text"), F.lower(text).alias("_lowered"))
    body, low = F.col("_text"), F.col("_lowered")
    shapes = _total([_count(body, p, _any_word(low, h)) for p, h in zip(SECRET_SHAPES, _SHAPE_HINTS, strict=True)])
    valued = F.concat(_matches(body, BEARER_VALUE, _any_word(low, ("bearer",))), _named_values(body, _any_word(low, _NAME_HINTS)))
    return lowered.select(key, "_text", shapes.alias("_shapes"), valued.alias("_valued"))


def local_path_hits(text: Column) -> Column:
    hint = text.contains("/Users/") | text.contains("/home/") | text.contains("Users\\")
    return F.when(hint, _total([F.regexp_count(text, F.lit(p)) for p in LOCAL_PATHS])).otherwise(0)


def _addresses(text: Column) -> Column:
    return _matches(text, EMAIL, text.contains("@"))


def _personal(address: Column) -> Column:
    """Neither of a reserved domain nor a role address."""
    parts = F.split(F.lower(address), "@")
    local, domain = F.element_at(parts, 1), F.element_at(parts, -1)
    reserved = domain.isin(*RESERVED_DOMAINS)
    for name in RESERVED_DOMAINS:
        reserved = reserved | domain.endswith("." + name)
    for suffix in RESERVED_SUFFIXES:
        reserved = reserved | domain.endswith(suffix)
    return ~reserved & ~local.isin(*ROLE_LOCALS)


def scan_secrets(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Raw and kept counts: values that carry a placeholder word are not kept."""
    kept = F.size(F.filter("_valued", _real))
    return _found(docs, key, text).select(
        key, (F.col("_shapes") + F.size("_valued")).alias("raw_hits"), (F.col("_shapes") + kept).alias("kept_hits")
    )


def scan_local_paths(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(key, local_path_hits(F.col(text)).alias("hits"))


def scan_emails(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Raw and kept counts: reserved domains and role addresses are not kept."""
    found = docs.select(key, _addresses(F.col(text)).alias("_mails"))
    return found.select(key, F.size("_mails").alias("raw_hits"), F.size(F.filter("_mails", _personal)).alias("kept_hits"))


def scan_verdict(docs: DataFrame, key: str, text: str) -> DataFrame:
    """First problem of each document in the order path, secret, address; later scans run only where earlier ones find none."""
    lowered = docs.select(F.col(key), F.col(text).alias("_text"), F.lower(text).alias("_lowered"))
    body, low = F.col("_text"), F.col("_lowered")
    seen = lambda pattern, hint: hint & body.rlike(_ascii_boundaries(pattern))
    path = _any_of([body.rlike(p) for p in LOCAL_PATHS])
    shape = _any_of([seen(p, _any_word(low, h)) for p, h in zip(SECRET_SHAPES, _SHAPE_HINTS, strict=True)])
    bearer = F.exists(_matches(body, BEARER_VALUE, _any_word(low, ("bearer",))), _real)
    named = F.exists(_named_values(body, _any_word(low, _NAME_HINTS)), _real)
    problem = (
        F.when((body.contains("/Users/") | body.contains("/home/") | body.contains("Users\\")) & path, "a local absolute path")
        .when(shape | bearer | named, "credential-shaped content")
        .when(F.exists(_addresses(body), _personal), "a personal email-shaped address")
    )
    return lowered.select(key, problem.alias("problem"))


def _any_of(conditions: list[Column]) -> Column:
    out = conditions[0]
    for more in conditions[1:]:
        out = out | more
    return out


def unsafe_paths(
    paths: DataFrame, path: str = "path", extra_segments: tuple[str, ...] = (), allowed: DataFrame | None = None
) -> DataFrame:
    """Paths that must not be published, with the first reason.

    ``extra_segments`` names further folders of local state; ``allowed`` (path)
    restricts to an exact list.
    """
    p = F.col(path)
    parts = F.filter(F.split(p, "/"), lambda s: (s != "") & (s != "."))
    lowered = F.transform(parts, F.lower)
    last = F.element_at(F.concat(F.array(F.lit("")), lowered), -1)
    suffix = F.regexp_extract(last, r"^.*[^.].*(\.[^.]+)$", 1)
    lit_array = lambda values: F.array(*[F.lit(v) for v in values])
    reason = (
        F.when(p.startswith("/"), "absolute")
        .when(p.contains("\\"), "backslash")
        .when(F.array_contains(parts, ".."), "parent_segment")
        .when(F.arrays_overlap(lowered, lit_array((*STATE_SEGMENTS, *extra_segments))), "build_state")
        .when(F.arrays_overlap(lowered, lit_array(SECRET_SEGMENTS)), "secret_state")
        .when(suffix.isin(*BAD_SUFFIXES), "local_database_or_bytecode")
    )
    out = paths.withColumn("reason", reason)
    if allowed is not None:
        listed = allowed.select(F.col("path").alias(path)).distinct().withColumn("_listed", F.lit(True))
        out = out.join(listed, path, "left")
        out = out.withColumn(
            "reason", F.coalesce("reason", F.when(F.col("_listed").isNull(), "not_allowed"))
        ).drop("_listed")
    return out.filter(F.col("reason").isNotNull())


def parse_checksums(lines: DataFrame, line: str = "value") -> DataFrame:
    """Checksum list lines as (line, path, sha256); a malformed line has a null path and checksum."""
    text = F.col(line)
    ok = text.rlike(CHECKSUM_LINE)
    return lines.select(
        text.alias("line"),
        F.when(ok, F.regexp_extract(text, CHECKSUM_LINE, 2)).alias("path"),
        F.when(ok, F.regexp_extract(text, CHECKSUM_LINE, 1)).alias("sha256"),
    )


def verify_checksums(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """A parsed checksum list against existing (path, content): all problems.

    A malformed line is a problem of its own, named by the line; so no file passes because its line could not be read.
    Contents are hashed where they are read; only digests are joined.
    """
    malformed = expected.filter("path is null").select(F.col("line").alias("path"), F.lit("malformed_line").alias("problem"))
    listed = expected.filter("path is not null").groupBy("path").agg(
        F.count(F.lit(1)).alias("n_listed"), F.min("sha256").alias("want")
    )
    body = F.col("content")
    is_png = F.lower("path").endswith(".png")
    signature = F.hex(F.substring(body.cast("binary"), 1, 8))
    present = actual.select(
        "path", F.sha2(body, 256).alias("have"), (is_png & (signature != PNG_SIGNATURE)).alias("bad_png")
    )
    found = present.groupBy("path").agg(
        F.count(F.lit(1)).alias("n_found"), F.min("have").alias("have"), F.bool_or("bad_png").alias("bad_png")
    )
    joined = listed.join(found, "path", "full_outer")
    problem = (
        F.when(F.col("n_found").isNull(), "missing")
        .when(F.col("n_listed").isNull(), "unexpected")
        .when(F.col("n_listed") > 1, "listed_twice")
        .when(F.col("n_found") > 1, "found_twice")
        .when(F.col("bad_png"), "not_png")
        .when(F.col("want") != F.col("have"), "mismatch")
    )
    return joined.select("path", problem.alias("problem")).filter(F.col("problem").isNotNull()).unionByName(malformed)


def required_assets(required: DataFrame, present: DataFrame, exact: bool = False) -> DataFrame:
    """How often each required path occurs, if not exactly once.

    With ``exact`` false a name also matches by its trailing segments.  Every
    name offers its own suffixes as join keys, and only as many as it has
    segments, so the match is an equi join.
    """
    names = present.select("name")
    if not exact:
        suffixes = F.expr("transform(sequence(1, size(split(name, '/'))), i -> substring_index(name, '/', -i))")
        names = names.select(F.explode(suffixes).alias("name"))
    counted = names.groupBy(F.col("name").alias("path")).agg(F.count(F.lit(1)).alias("n"))
    return (
        required.select("path")
        .distinct()
        .join(counted, "path", "left")
        .select("path", F.coalesce("n", F.lit(0)).alias("n_matches"))
        .filter(F.col("n_matches") != 1)
    )
