"""Queries of the content scans and file-list checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from changegate.operators import scan
from changegate.plans.views import table


def q_scan_secrets(spark, sf_dir):
    return scan.scan_secrets(table(spark, sf_dir, "documents"), "doc_id", "text")


def q_scan_emails(spark, sf_dir):
    return scan.scan_emails(table(spark, sf_dir, "documents"), "doc_id", "text")


def q_scan_emails_by_source(spark, sf_dir):
    """The same texts with each reserved domain rewritten to the document's source."""
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.regexp_replace("text", r"@example\.(?:com|org|net)", "@mail.src.io").alias("text")
    )
    return scan.scan_emails(docs, "doc_id", "text")


def _with_paths(spark, sf_dir):
    """Documents that mention the folder of their source, in three notations or none."""
    k = F.col("doc_id") % 4
    note = (
        F.when(k == 0, F.concat(F.lit(" see /home/"), "source", F.lit("/notes")))
        .when(k == 1, F.concat(F.lit(" see /Users/"), "source", F.lit("/a and /Users/"), "source", F.lit("/b")))
        .when(k == 2, F.concat(F.lit(" see C:\\\\Users\\\\"), "source", F.lit("\\\\x")))
        .otherwise(F.concat(F.lit(" see /home/"), "source"))
    )
    return table(spark, sf_dir, "documents").select("doc_id", F.concat("text", note).alias("text"))


def q_scan_local_paths(spark, sf_dir):
    return scan.scan_local_paths(_with_paths(spark, sf_dir), "doc_id", "text")


def _planted(spark, sf_dir):
    """Documents followed by a line built from their own fields, of every shape."""
    k = F.col("doc_id") % 10
    tag = F.sha2(F.col("doc_id").cast("string"), 256)
    up = F.upper(F.substring(tag, 1, 16))
    line = (
        F.when(k == 0, F.concat(F.lit("sk-proj-"), F.substring(tag, 1, 20)))
        .when(k == 1, F.concat(F.lit("AKIA"), up))
        .when(k == 2, F.concat(F.lit("WAREHOUSE_PASSWORD=\""), F.substring(tag, 1, 32), F.lit("\"")))
        .when(k == 3, F.concat(F.lit("client_secret: dummy-"), F.substring(tag, 1, 24)))
        .when(k == 4, F.concat(F.lit("Authorization: Bearer "), F.substring(tag, 1, 30)))
        .when(k == 5, F.concat(F.lit("éeyJ"), F.substring(tag, 1, 12), F.lit("."), F.substring(tag, 13, 12), F.lit("."), F.substring(tag, 25, 12)))
        .when(k == 6, F.concat(F.substring(tag, 1, 6), F.lit("@"), "source", F.lit(".org, info@"), "source", F.lit(".org")))
        .when(k == 7, F.concat(F.lit("see /home/"), "source", F.lit("/x")))
        .when(k == 8, F.concat(F.lit("dhpat-"), F.substring(tag, 1, 24)))
        .otherwise(F.lit("-----BEGIN EC PRIVATE KEY-----"))
    )
    return table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("\n", "text", line).alias("text"))


def q_scan_secret_shapes(spark, sf_dir):
    return scan.scan_secrets(_planted(spark, sf_dir), "doc_id", "text")


def q_scan_long_names(spark, sf_dir):
    """Every document's words as one hyphenated name that is given a value: tens of thousands of parts in the longest."""
    k = F.col("doc_id") % 3
    joined = F.regexp_replace("text", r"[^A-Za-z0-9]+", "-")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat(
            F.when(k == 0, F.lit("__")).otherwise(F.lit("")), joined, F.when(k == 1, F.lit("-_token=")).otherwise(F.lit("-a_token=")),
            F.substring(F.sha2("text", 256), 1, 32),
        ).alias("text"),
    )
    return scan.scan_secrets(docs, "doc_id", "text")


def q_scan_verdict(spark, sf_dir):
    return scan.scan_verdict(_planted(spark, sf_dir), "doc_id", "text")


def _paths(spark, sf_dir):
    k = F.col("page_id") % 11
    tail = F.regexp_replace("url", r"^[a-z]+://", "")
    return table(spark, sf_dir, "pages").select(
        "page_id",
        F.when(k == 0, F.concat(F.lit("/"), tail))
        .when(k == 1, F.concat(F.lit("a\\"), tail))
        .when(k == 2, F.concat(F.lit("a/../"), tail))
        .when(k == 3, F.concat(F.lit("a/Target/"), tail))
        .when(k == 4, F.concat(F.lit(".env/"), tail))
        .when(k == 5, F.concat(tail, F.lit("/db.SQLite")))
        .when(k == 6, F.concat(tail, F.lit("/.pyc")))
        .when(k == 7, F.concat(tail, F.lit("/x.pyc/")))
        .otherwise(tail)
        .alias("path"),
    )


def q_unsafe_paths(spark, sf_dir):
    paths = _paths(spark, sf_dir)
    allowed = paths.filter(F.col("page_id") % 11 < 10).select("path")
    return scan.unsafe_paths(paths, allowed=allowed).select("page_id", "path", "reason")


def _contents(spark, sf_dir):
    """Every document as a file of its source's folder."""
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.concat("source", F.lit("/"), "lang", F.lit("/"), "doc_id", F.lit(".txt")).alias("path"), F.col("text").alias("content")
    )


def q_verify_checksums(spark, sf_dir):
    """A checksum list with damaged, lacking and repeated lines against the documents."""
    files = _contents(spark, sf_dir)
    k = F.col("doc_id") % 13
    digest = F.sha2("content", 256)
    line = F.concat(F.when(k == 1, F.reverse(digest)).otherwise(digest), F.lit("  "), "path")
    lines = files.filter(k != 2).select(
        F.explode(F.when(k == 3, F.array(line, line)).when(k == 4, F.array(F.upper(line))).otherwise(F.array(line))).alias("value")
    )
    return scan.verify_checksums(scan.parse_checksums(lines), files.filter(k != 5).select("path", "content"))


def q_required_assets(spark, sf_dir):
    """File names required of every document, looked for in the files of other sources too."""
    files = _contents(spark, sf_dir)
    required = files.select(F.concat("doc_id", F.lit(".txt")).alias("path")).unionByName(
        files.select(F.concat_ws("/", F.element_at(F.split("path", "/"), 2), F.concat("doc_id", F.lit(".md"))).alias("path"))
    )
    present = files.filter(F.col("doc_id") % 6 != 0).select(F.col("path").alias("name")).unionByName(
        files.filter(F.col("doc_id") % 10 == 1).select(F.concat(F.lit("copy/"), "path").alias("name"))
    )
    return scan.required_assets(required, present)


QUERIES = {
    "scan_secrets": q_scan_secrets,
    "scan_secret_shapes": q_scan_secret_shapes,
    "scan_long_names": q_scan_long_names,
    "scan_local_paths": q_scan_local_paths,
    "scan_emails": q_scan_emails,
    "scan_emails_by_source": q_scan_emails_by_source,
    "scan_verdict": q_scan_verdict,
    "unsafe_paths": q_unsafe_paths,
    "verify_checksums": q_verify_checksums,
    "required_assets": q_required_assets,
}


def _lit(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_PLACEHOLDER = "(" + "|".join(scan.PLACEHOLDERS) + ")"
# The name's prefix as a repeated group, which the oracle's engine takes without a stack.
_NAMED = r"""(?i)\b(?:[A-Za-z0-9]+[_-])*(?:token|password|api[_-]?key|client[_-]?secret|(?:aws[_-])?secret[_-]?access[_-]?key)\b["']?[ \t]*[:=][ \t]*(?:[rubf]{0,2}["'])?([A-Za-z0-9_~+/=-]{20,})"""
_VALUED = f"""list_concat(regexp_extract_all(text, {_lit(scan.BEARER_VALUE)}, 1),
  regexp_extract_all(text, {_lit(_NAMED)}, 1))"""
_SHAPES = " + ".join(f"len(regexp_extract_all(text, {_lit(p)}))" for p in scan.SECRET_SHAPES)
_SECRETS = f"""{_SHAPES} + len({_VALUED}) as raw_hits,
  {_SHAPES} + len(list_filter({_VALUED}, lambda v: not regexp_matches(lower(v), '{_PLACEHOLDER}'))) as kept_hits"""
_MAILS = f"regexp_extract_all(text, {_lit(scan.EMAIL)}, 1)"
_RESERVED = r"@(.*\.)?example\.(com|net|org)$|\.(example|invalid|localhost|test)$|^(admin|contact|info|no-reply|noreply|privacy|security|support)@"
_EMAILS = f"""len({_MAILS}) as raw_hits,
  len(list_filter({_MAILS}, lambda v: not regexp_matches(lower(v), '{_RESERVED}'))) as kept_hits"""
_PATHS = " + ".join(f"len(regexp_extract_all(text, {_lit(p)}))" for p in scan.LOCAL_PATHS)
_NOTED = r"""select doc_id, text || case doc_id % 4 when 0 then ' see /home/' || source || '/notes'
  when 1 then ' see /Users/' || source || '/a and /Users/' || source || '/b'
  when 2 then ' see C:\\Users\\' || source || '\\x' else ' see /home/' || source end as text from documents"""
_PLANTED = """select doc_id, text || chr(10) || case doc_id % 10 when 0 then 'sk-proj-' || substr(h, 1, 20)
  when 1 then 'AKIA' || upper(substr(h, 1, 16)) when 2 then 'WAREHOUSE_PASSWORD="' || substr(h, 1, 32) || '"'
  when 3 then 'client_secret: dummy-' || substr(h, 1, 24) when 4 then 'Authorization: Bearer ' || substr(h, 1, 30)
  when 5 then 'éeyJ' || substr(h, 1, 12) || '.' || substr(h, 13, 12) || '.' || substr(h, 25, 12)
  when 6 then substr(h, 1, 6) || '@' || source || '.org, info@' || source || '.org'
  when 7 then 'see /home/' || source || '/x' when 8 then 'dhpat-' || substr(h, 1, 24)
  else '-----BEGIN EC PRIVATE KEY-----' end as text
  from (select *, sha256(cast(doc_id as varchar)) as h from documents) d"""
_FILES = "select doc_id, lang, source || '/' || lang || '/' || doc_id || '.txt' as path, sha256(text) as h from documents"

ORACLES = {
    "scan_secrets": f"select doc_id, {_SECRETS} from documents",
    "scan_secret_shapes": f"select doc_id, {_SECRETS} from ({_PLANTED}) p",
    "scan_long_names": f"""select doc_id, {_SECRETS} from (select doc_id, case doc_id % 3 when 0 then '__' else '' end
  || regexp_replace(text, '[^A-Za-z0-9]+', '-', 'g') || case doc_id % 3 when 1 then '-_token=' else '-a_token=' end
  || substr(sha256(text), 1, 32) as text from documents) d""",
    "scan_local_paths": f"select doc_id, {_PATHS} as hits from ({_NOTED}) n",
    "scan_emails": f"select doc_id, {_EMAILS} from documents",
    "scan_emails_by_source": f"""select doc_id, {_EMAILS} from (select doc_id,
  regexp_replace(text, '@example\\.(?:com|org|net)', '@mail.src.io', 'g') as text from documents) d""",
    "scan_verdict": f"""select doc_id, case when paths > 0 then 'a local absolute path'
  when secrets > 0 then 'credential-shaped content' when mails > 0 then 'a personal email-shaped address' end as problem
from (select doc_id, {_PATHS} as paths, {_SECRETS.split(' as raw_hits,')[1].replace(' as kept_hits', '')} as secrets,
  {_EMAILS.split(' as raw_hits,')[1].replace(' as kept_hits', '')} as mails from ({_PLANTED}) p) s""",
    "unsafe_paths": r"""
with t as (select page_id, page_id % 11 as k, regexp_replace(url, '^[a-z]+://', '') as tail from pages),
p as (select page_id, k, case k when 0 then '/' || tail when 1 then 'a\' || tail when 2 then 'a/../' || tail
  when 3 then 'a/Target/' || tail when 4 then '.env/' || tail when 5 then tail || '/db.SQLite'
  when 6 then tail || '/.pyc' when 7 then tail || '/x.pyc/' else tail end as path from t)
select page_id, path, reason from (select page_id, path, case k when 0 then 'absolute' when 1 then 'backslash'
  when 2 then 'parent_segment' when 3 then 'build_state' when 4 then 'secret_state'
  when 5 then 'local_database_or_bytecode' when 7 then 'local_database_or_bytecode' else
  case when path not in (select path from p where k < 10) then 'not_allowed' end end as reason from p) r
where reason is not null""",
    "verify_checksums": f"""
with f as ({_FILES})
select upper(h || '  ' || path) as path, 'malformed_line' as problem from f where doc_id % 13 = 4 union all
select path, problem from (select path, case when doc_id % 13 in (2, 4) then 'unexpected' when doc_id % 13 = 5 then 'missing'
  when doc_id % 13 = 3 then 'listed_twice' when doc_id % 13 = 1 and reverse(h) <> h then 'mismatch' end as problem from f) x
where problem is not null""",
    "required_assets": f"""
with f as ({_FILES}), present as (select path as name from f where doc_id % 6 <> 0
  union all select 'copy/' || path from f where doc_id % 10 = 1),
required as (select distinct doc_id || '.txt' as path from f union select distinct lang || '/' || doc_id || '.md' from f),
hit as (select regexp_extract(name, '[^/]*$') as path, count(*) as n from present group by 1)
select r.path, coalesce(h.n, 0) as n_matches from required r left join hit h on h.path = r.path
where coalesce(h.n, 0) <> 1""",
}
