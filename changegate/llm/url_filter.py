"""URL filter: a weighted vocabulary matched by Aho-Corasick, after host and path rules.

The vocabulary has strict and soft terms.  One automaton over all terms finds every occurrence in a single pass over the
lower-cased url, whatever the number of terms.  An occurrence counts only between boundaries: neither neighbour is an ASCII
letter or digit.  A url is blocked by one strict hit or by ``min_soft`` *distinct* soft hits.

Host rules come first: a rule ``host/path`` fits its host and all subdomains of it if the url's path starts with the rule's;
the longest fitting rule decides, and the vocabulary judges only urls that no rule fits.

Defined results: a null url, or one without ``://``, has empty host and path, no rule, and is judged by its text (null: no
hit, allowed).  The empty url is allowed.  Repeated rows and ties are judged row by row.  Extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from changegate.llm.common import arrow_map


@dataclass(frozen=True)
class UrlPolicy:
    """Rules (action, ``host/path``) and vocabulary; terms are lower-case."""

    rules: tuple[tuple[str, str], ...]
    strict: tuple[str, ...]
    soft: tuple[str, ...]
    min_soft: int = 2


# The host rules of the production policy.
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
STRICT = ("xxx", "adult", "porn", "hentai", "casino", "gambling", "viagra", "escort", "warez", "camgirls")
SOFT = (
    "sex", "nude", "poker", "bet", "betting", "slots", "pills", "cheap", "win", "bonus", "dating", "loan", "free",
    "replica", "torrent", "keygen", "hot", "bets", "spam", "ads", "track", "farm",
)
PRODUCTION = UrlPolicy(RULES, STRICT, SOFT)

SCHEMA = "page_id bigint, host string, path string, rule string, verdict string, strict_hits int, soft_hits int"
_UPPER_TO_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def host_and_path(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a url, both empty when it has no ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((i for i in (rest.find("?"), rest.find("#")) if i >= 0), default=len(rest))
    host, slash, path = rest[:end].partition("/")
    return host.translate(_UPPER_TO_LOWER), slash + path


@lru_cache(maxsize=4)
def _rule_index(policy: UrlPolicy) -> dict[str, list[tuple[str, str, str]]]:
    """Per rule host: (path, rule, action), longest path first."""
    index: dict[str, list[tuple[str, str, str]]] = {}
    for action, rule in policy.rules:
        host, slash, path = rule.partition("/")
        index.setdefault(host, []).append((slash + path, rule, action))
    for fits in index.values():
        fits.sort(key=lambda r: -len(r[0]))
    return index


@lru_cache(maxsize=4)
def _longest_host(policy: UrlPolicy) -> int:
    return max(map(len, _rule_index(policy)), default=0)


def fitting_rule(host: str, path: str, policy: UrlPolicy) -> tuple[str, str] | None:
    """(rule, action) of the longest rule that fits, found by walking up the host's parents.

    Parents longer than every rule's host are passed over, so the walk does not grow with the length of the host.
    """
    index, best = _rule_index(policy), None
    beyond = len(host) - _longest_host(policy)
    at = 0 if beyond <= 0 else host.find(".", beyond - 1) + 1 or len(host)
    while at < len(host):
        for start, rule, action in index.get(host[at:], ()):
            if path.startswith(start) and (best is None or len(rule) > len(best[0])):
                best = (rule, action)
        at = host.find(".", at) + 1 or len(host)
    return best


@lru_cache(maxsize=4)
def _automaton(policy: UrlPolicy):
    import ahocorasick

    machine = ahocorasick.Automaton()
    for kind, terms in (("soft", policy.soft), ("strict", policy.strict)):
        for term in terms:
            machine.add_word(term, (kind, term))
    machine.make_automaton()
    return machine


def _inside_word(char: str) -> bool:
    return char.isascii() and char.isalnum()


def vocabulary_hits(url: str | None, policy: UrlPolicy) -> tuple[int, int]:
    """(strict occurrences, distinct soft terms) of a url."""
    text = (url or "").translate(_UPPER_TO_LOWER)
    if not text or not (policy.strict or policy.soft):
        return 0, 0
    strict, soft = 0, set()
    for last, (kind, term) in _automaton(policy).iter(text):
        first = last - len(term) + 1
        if (first and _inside_word(text[first - 1])) or (last + 1 < len(text) and _inside_word(text[last + 1])):
            continue
        if kind == "strict":
            strict += 1
        else:
            soft.add(term)
    return strict, len(soft)


def _judge(batch: pa.RecordBatch, policy: UrlPolicy) -> list:
    out = [[] for _ in range(6)]
    for url in batch.column(1).to_pylist():
        host, path = host_and_path(url)
        strict, soft = vocabulary_hits(url, policy)
        fits = fitting_rule(host, path, policy)
        verdict = fits[1] if fits else "block" if strict or soft >= policy.min_soft else "allow"
        for column, value in zip(out, (host, path, fits and fits[0], verdict, strict, soft), strict=True):
            column.append(value)
    return [batch.column(0), *out]


def judge_urls(pages: DataFrame, policy: UrlPolicy = PRODUCTION, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page with host, path, fitting rule, verdict and the vocabulary's counts.

    Only the two named columns are read; nothing is shuffled.
    """
    narrow = pages.selectExpr(f"cast(`{id_col}` as bigint) as page_id", f"cast(`{url_col}` as string) as url")
    return arrow_map(narrow, _judge, SCHEMA, (policy,))


def oracle_sql(policy: UrlPolicy = PRODUCTION) -> str:
    """DuckDB SQL for the same rows, written with regular expressions instead of an automaton."""

    def count(terms):
        edge = "[^a-z0-9]"
        return " + ".join(f"cast(regexp_matches(low, '(^|{edge}){t}($|{edge})') as int)" for t in terms)

    hosts = " union all ".join(
        f"select '{a}' as action, '{r}' as rule, '{r.partition('/')[0]}' as rhost, '/{r.partition('/')[2]}' as rpath"
        for a, r in policy.rules
    )
    occurrences = " + ".join(
        # The look-ahead edge is rewritten by doubling separators, so that neighbours can share one.
        f"len(regexp_extract_all(wide, '(^|[^a-z0-9]){t}($|[^a-z0-9])'))" for t in policy.strict
    )
    return rf"""
with rules as ({hosts}),
parts as (
  select page_id, url,
         case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest,
         translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low
  from pages),
split as (
  select page_id, low, regexp_replace(low, '([^a-z0-9])', '\1\1', 'g') as wide,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path
  from parts),
numbered as (select *, row_number() over () as n from split),
fits as (
  select n, arg_max(rule, length(rule)) as rule, arg_max(action, length(rule)) as action
  from numbered join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath)
  group by n),
hits as (select n, {occurrences} as strict_hits, {count(policy.soft)} as soft_hits from numbered)
select page_id, host, path, rule,
       coalesce(action, case when strict_hits > 0 or soft_hits >= {policy.min_soft} then 'block' else 'allow' end) as verdict,
       cast(strict_hits as int) as strict_hits, cast(soft_hits as int) as soft_hits
from numbered join hits using (n) left join fits using (n)
"""
