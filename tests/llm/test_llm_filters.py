"""URL filter, quality rules, HTML extraction and toxicity."""

import html
import itertools
import re
import zlib

import duckdb
import numpy as np
import pytest
from cases import TEXTS, as_set, documents

from changegate.llm import html_text, quality, queries, toxicity, url_filter

URLS = [
    (1, "https://a.Example.ORG/es/x"), (2, "http://example.org/en/12?q"), (3, "http://example.org/en/2"), (4, "http://shop.com/fr/1"),
    (5, "http://shop.com/de/"), (6, "http://notexample.net/de/"), (7, None), (8, ""), (9, "no scheme casino"), (10, "http://best-casino.net/"),
    (11, "http://mycasino.net/"), (12, "http://a.net/free/bonus"), (13, "http://a.net/free-free"), (14, "http://org"), (15, "http://org/"),
    (16, "x://h#/p://casino"), (17, "http://a.com?u=/fr/"), (18, "http://badcom/fr/"), (5, "http://shop.com/de/"), (None, "http://q.org/"),
    (19, "http://x.net/" + "free-" * 50_000 + "casino"), (20, "http://casino.casino.net/"),
]


def pages(spark, urls=URLS):
    return spark.createDataFrame([(i, u, None, "x") for i, u in urls], "page_id bigint, url string, html string, verdict string")


def test_urls_against_brute_force(spark):
    got = as_set(url_filter.judge_urls(pages(spark)))
    want = []
    for i, url in URLS:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host, path = re.match(r"([^/?#]*)([^?#]*)", rest).groups()
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [
            (r, a) for a, r in url_filter.RULES
            if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])
        ]
        rule = max(fits, key=lambda f: len(f[0]), default=(None, None))
        low = re.sub("[A-Z]", lambda m: m[0].lower(), url or "")
        hits = lambda t: len(re.findall(rf"(?<![a-z0-9]){t}(?![a-z0-9])", low))
        strict, soft = sum(map(hits, url_filter.STRICT)), sum(hits(t) > 0 for t in url_filter.SOFT)
        verdict = rule[1] or ("block" if strict or soft >= 2 else "allow")
        want.append((i, host, path, rule[0], verdict, strict, soft))
    assert got == sorted(want, key=repr)
    assert url_filter.judge_urls(pages(spark, [])).count() == 0


def test_rules_of_long_hosts():
    """A host of many labels costs no more than its last few, and fits the same rules."""
    policy = url_filter.UrlPolicy((("block", "a.b/"), ("allow", "b/"), ("block", "x.a.b/p")), (), ())
    labels = "l." * 500_000
    assert url_filter.fitting_rule(labels + "x.a.b", "/p1", policy) == ("x.a.b/p", "block")
    assert url_filter.fitting_rule(labels + "xa.b", "/p", policy) == ("b/", "allow")
    assert url_filter.fitting_rule("n" * 1_000_000 + ".a.b", "/", policy) == ("a.b/", "block")
    assert url_filter.fitting_rule("n" * 1_000_000, "/", policy) is None and url_filter.fitting_rule("", "/", policy) is None
    for host in ("a.b", ".a.b", "b", "a.b.", "..b", "ba.b", "x.a.b", "a.b.c", "."):
        parents = [host.split(".", k)[-1] for k in range(host.count(".") + 1)]
        fits = [r for _, r in policy.rules if r.partition("/")[0] in parents and "/q".startswith("/" + r.partition("/")[2])]
        best = max(fits, key=len, default=None)
        assert (url_filter.fitting_rule(host, "/q", policy) or (None,))[0] == best, host


def test_url_oracle_on_awkward_rows(spark):
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, url varchar)")
    con.executemany("insert into pages values (?, ?)", URLS)
    got = con.execute(url_filter.oracle_sql())
    names = [d[0] for d in got.description]
    assert sorted(got.fetchall(), key=repr) == as_set(url_filter.judge_urls(pages(spark)), *names)


QUALITY_SQL = r"""
with words as (select doc_id, rn, w, i from (
  select doc_id, rn, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as w, generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) as i
  from docs)),
grams as (select a.rn, a.i, a.w || ' ' || b.w || ' ' || c.w as g from words a join words b on a.rn = b.rn and b.i = a.i + 1 join words c on a.rn = c.rn and c.i = a.i + 2),
twice as (select rn, g from grams group by all having count(*) > 1),
covered as (select distinct rn, i + d as i from grams join twice using (rn, g), range(3) t(d)),
lines as (select rn, line from (select rn, unnest(string_split(text, chr(10))) as line from docs) where regexp_matches(line, '[^\x20\x09-\x0D]'))
select doc_id, (select count(*) from words w where w.rn = docs.rn) as n_words,
  (select coalesce(sum(length(w)), 0)::bigint from words w where w.rn = docs.rn) as word_chars,
  coalesce(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')), 0) as n_symbols,
  (select count(*) - count(distinct line) from lines l where l.rn = docs.rn) as n_dup_lines,
  (select count(*) from covered c where c.rn = docs.rn) as n_repeat_words
from docs
"""


def base_columns(rows):
    con = duckdb.connect()
    con.execute("create table docs (rn int, doc_id bigint, text varchar)")
    con.executemany("insert into docs values (?, ?, ?)", [(n, i, t) for n, (i, t) in enumerate(rows)])
    return sorted(con.execute(QUALITY_SQL).fetchall(), key=repr)


BASE = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_base_columns_against_sql(spark):
    sf_dir = "/root/testdata/sf0.001"
    given = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    judged = queries.QUERIES["op5_quality_rules"](spark, sf_dir)
    assert as_set(judged, *BASE) == base_columns(given)
    for r in judged.collect():
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["base_failed"] == failed and r["kept"] == (not failed and r["quality"] >= 0.5)


def test_quality_of_awkward_rows(spark):
    judged = quality.judge_documents(documents(spark))
    assert as_set(judged, *BASE) == base_columns(TEXTS)
    assert quality.judge_documents(documents(spark, [])).count() == 0
    kept = quality.keep_good(documents(spark))
    assert kept.columns == documents(spark).columns
    assert as_set(kept, "doc_id") == as_set(judged.filter("kept"), "doc_id")
    assert quality.keep_good(documents(spark, [])).count() == 0


def test_estimation_equals_a_row_by_row_version():
    rng = np.random.default_rng(3)
    codes = rng.choice(3 ** len(quality.RULES), 40)
    counts = rng.integers(1, 30, 40)
    rows = np.repeat(codes, counts)
    a, b = quality.estimate(codes, counts), quality.estimate(rows, np.ones(len(rows)))
    assert np.allclose(a.good_on_good, b.good_on_good) and np.allclose(a.bad_on_bad, b.bad_on_bad) and np.isclose(a.prior, b.prior)


def test_quality_agrees_with_held_labels(spark):
    sf_dir = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").selectExpr("doc_id", "quality as label")
    rows = queries.QUERIES["op5_quality_rules"](spark, sf_dir).filter("not base_failed").join(labels, "doc_id").collect()
    right = sum(r["kept"] == bool(r["label"]) for r in rows)
    assert right / len(rows) > 0.97
    assert sum(not r["kept"] and r["label"] == 1 for r in rows) / len(rows) < 0.01


PAGE = """<!doctype html><html><head><title>t</title><style>p{}</style></head><body><h1>Head</h1><p>One <b>two</b>
three<p>Next&nbsp;&amp; more<ul><li>a<li>b<ol start=3><li>x<li>y</ol><li></ul><table><tr><th>Name<th>Qty<tr><td>Apples<td>3
<tr><td rowspan=2>Long name<td>12<tr><td>z</table><pre>
 keep   this
  x</pre><div hidden>no</div><p style="display: none">no</p><span style="visibility:hidden">no<b style='visibility:visible'>yes</b></span>
<details><summary>S</summary>no</details><details open><summary>T</summary>shown</details>a<br><br>b 1 < 2 <a title="x > y">link</a>
<script>if(a<b)"</p>"</script><!-- no --><textarea>
box</textarea>end <unfinished"""

SEEN = """Head

One two three

Next & more

- a
- b
  3. x
  4. y
-

Name       Qty
Apples     3
Long name  12
           z

 keep   this
  x

yes
S
T
shown
a

b 1 < 2 link
box
end"""


def test_page_layout():
    assert html_text.visible_text(PAGE) == SEEN


@pytest.mark.parametrize(
    "page",
    ["<div>" * 50_000 + "x", "<b>" * 20_000 + "</i>" * 20_000 + "x", "<table><tr><td>" * 1000 + "x", "<ul><li>" * 5_000 + "x", "<a '\">" * 9_000 + "x",
     "<p>x" * 30_000, "</p>" * 9_000 + "x", "<li>" * 9_000 + "x", "<td>x<tr>x</table>x", "<svg>no</svg>x<!-- x", "x<![CDATA[ a ]]>", "&#x110000;&bogus;x"],
)
def test_broken_markup_is_rendered(page):
    assert "x" in html_text.visible_text(page)


def test_drawings_formulas_maps_and_wide_cells():
    page = """<svg><title>no</title><desc>no</desc><defs><text>no</text></defs><text>SVGT</text><style>no</style></svg>
      <p><math><mi>MATHX</mi><annotation>no</annotation></math></p><map name="m"><p><a href="/">MAPLINK</a></p></map>"""
    text = "\n".join(html_text.render(html_text.parse(page)))
    assert [w for w in ("SVGT", "MATHX", "MAPLINK") if w in text] == ["SVGT", "MATHX", "MAPLINK"] and "no" not in text.split()
    wide = html_text.render(html_text.parse(f"<table><tr><td>{'w' * 80}<td>one<tr><td>short<td>two</table>"))
    assert [line.index(w) for line, w in zip(wide, ("one", "two"), strict=True)] == [82, 82]
    deep = html_text.render(html_text.parse("<ul><li>" * 30 + "end"))
    assert deep[-1].strip().endswith("end") and len(deep[-1]) - len(deep[-1].lstrip()) >= 2 * 29
    # One enormous cell beside many rows does not multiply.
    large = html_text.render(html_text.parse("<table><tr><td>" + "w" * 100_000 + "<td>x" + "<tr><td>a<td>b" * 2_000 + "</table>"))
    assert sum(map(len, large)) < 400_000 and large[1].split() == ["a", "b"]


def test_all_words_of_real_pages_are_kept(spark):
    sf_dir = "/root/testdata/sf0.001"
    given = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = queries.QUERIES["op6_html_text"](spark, sf_dir).collect()
    assert len(rows) == len(given)
    for r in rows:
        body = re.sub(r"<!--.*?-->", "", given[r["page_id"]].split("</head>")[-1], flags=re.S)
        want = html.unescape(re.sub(r"<[^>]*>", " ", body)).split()
        assert sorted("".join(want)) == sorted("".join(re.sub(r"(?m)^- ", "", r["text"]).split()))


def test_pages_with_awkward_rows(spark):
    rows = [(1, None), (2, ""), (None, "<p>a"), (3, "<p>a"), (3, "<p>a")]
    df = spark.createDataFrame([(i, None, h, "x") for i, h in rows], "page_id bigint, url string, html string, text string")
    assert as_set(html_text.extract_text(df)) == sorted([(1, "", 0, 0), (2, "", 0, 0), (None, "a", 1, 1), (3, "a", 1, 1), (3, "a", 1, 1)], key=repr)
    assert html_text.extract_text(df.limit(0)).count() == 0


def test_marginals_equal_the_sum_over_all_taggings():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 9):
        unary, starts = rng.normal(size=n) * 2, np.arange(n) % 4 == 0
        step, begin = np.exp(rng.normal(size=(2, 2))), np.array([0.7, 0.3])
        mass = np.zeros((n, 2))
        for tags in itertools.product((0, 1), repeat=n):
            weight = np.prod([np.exp(unary[i] * t) * (begin[t] if starts[i] else step[tags[i - 1], t]) for i, t in enumerate(tags)])
            for i, t in enumerate(tags):
                mass[i, t] += weight
        odds, _ = toxicity.marginals(unary, starts, step, begin)
        assert np.allclose(odds, np.log(mass[:, 1] / mass[:, 0]))


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def test_toxicity_on_held_out_labels(spark):
    sf_dir = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    scored = queries.QUERIES["op8_toxicity"](spark, sf_dir)
    assert scored.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    rows = scored.join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["predicted"] == r["toxic"] for r in held) / len(held) > 0.93
    assert sum(r["predicted"] and not r["toxic"] for r in rows) / len(rows) < 0.03


def test_toxicity_of_awkward_rows(spark):
    plain = " ".join(f"word{i}" for i in range(30))
    ids = [i for i in range(1000, 1200) if zlib.crc32(str(i).encode()) % 5][:80]
    texts = TEXTS + [(i, f"{plain} {i} vile{i % 7} creature{i % 3} {plain}" if i % 2 else f"{plain} {i} kind{i % 7}") for i in ids]
    labels = labelled(spark, [(i, 1, i % 2) for i in ids] + [(None, 1, 1), (ids[0], None, None), (0, 1, 0), (0, 1, 0)])
    rows = toxicity.score_documents(documents(spark, texts), labels).collect()
    assert len(rows) == len(texts) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    by_id = {r["doc_id"]: r["predicted"] for r in rows}
    assert all(by_id[i] == i % 2 for i in ids) and by_id[1] == by_id[2] == by_id[4] == 0
    model = toxicity.train(documents(spark, texts), labels)
    spans = toxicity.toxic_spans(documents(spark, texts), model).collect()
    whole = dict(texts)
    assert spans and all(whole[r["doc_id"]][r["start"] : r["end"]] == r["span"] and "vile" in r["span"] for r in spans)
    kept = toxicity.keep_clean(documents(spark, texts), labels)
    assert kept.columns == documents(spark).columns and kept.count() == sum(not r["predicted"] for r in rows)


def test_toxicity_without_labels_scores_zero(spark):
    none = labelled(spark, [])
    assert {r["score"] for r in toxicity.score_documents(documents(spark), none).collect()} == {0.0}
    assert toxicity.keep_clean(documents(spark), none).count() == len(TEXTS)
    assert toxicity.score_documents(documents(spark, []), none).count() == 0


def test_toxicity_learns_beside_long_and_repeated_rows(spark):
    """A text longer than the whole bound first in order, one that many rows repeat, and an id of many texts cost no other row."""
    texts = {i: (f"number {i * 7} nincompoop {i * i} zounds {i * 3}" if i % 4 == 0 else f"river {i} runs {i * i} miles by calm houses") for i in range(1, 400)}
    order = sorted((i for i in texts if zlib.crc32(str(i).encode()) % 5), key=lambda i: zlib.crc32(str(i).encode()))
    first = order[0]
    for long_id in order[:3]:
        texts[long_id] = " ".join(f"calm{k % 50}" for k in range(6_000))
    clean = {i: i % 4 == 0 and i not in order[:3] for i in texts}
    labels = spark.createDataFrame([(i, 0, int(x)) for i, x in clean.items()], "doc_id bigint, quality int, toxic int")
    rows = [*texts.items(), *[(order[4], texts[order[4]])] * 500, *[(order[5], f"{texts[order[5]]} and {k}") for k in range(500)]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert len(texts[first]) > 30_000
    model = toxicity.train(docs, labels, max_bytes=30_000)
    assert model.usable
    rude, calm = toxicity._scores(["you nincompoop there", "a calm river and some houses"], model)
    assert rude >= 0.5 > calm
    sample = toxicity.labelled_sample(docs, labels, "doc_id", "text", 400, 30_000).collect()
    assert sum(len(r["data"]) * r["copies"] for r in sample) <= 30_000 and sum(r["copies"] for r in sample) <= 1_000
    assert {r["_toxic"] for r in sample} == {True, False} and min(len(r["data"]) for r in sample) > 10


def test_common_length_of_texts():
    assert toxicity.common_length([5, 9, 7], [1, 1, 1], 21) == 9
    assert toxicity.common_length([5, 900, 700], [1, 1, 1], 25) == 10
    assert toxicity.common_length([10, 2], [3, 2], 19) == 5
    assert toxicity.common_length([], [], 10) == 0


def test_toxicity_scores_a_large_batch_in_slices(monkeypatch):
    clean = ["the river runs by the old mill and some houses near it", "a calm day with bread and tea at the table"] * 60
    rude = ["you utter nincompoop of a town", "what a nincompoop you are today", "nincompoop go away from the mill"] * 40
    model = toxicity.learn([f"{t} {i}" for i, t in enumerate(clean + rude)], [False] * len(clean) + [True] * len(rude))
    texts = ["", *rude[:3], "", *clean[:40], rude[0] * 30, ""]
    whole = [s for t in texts for s in model.score(model.tag([toxicity.words_of(t)]))]
    held, tag = [], toxicity.ToxicityModel.tag
    monkeypatch.setattr(toxicity, "SLICE_CHARS", 200)
    monkeypatch.setattr(toxicity.ToxicityModel, "tag", lambda self, some: held.append(some) or tag(self, some))
    assert toxicity._scores(texts, model) == pytest.approx(whole)
    assert max(sum(len(" ".join(words)) for words in some) for some in held if len(some) > 1) <= 200
    assert toxicity._scores([], model) == []
