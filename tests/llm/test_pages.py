"""URL filter, line dedup, mixing, and the pipeline; SQL twins of all operators that have one."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from gridspark.llm import linededup, mixing, scratch, tokens, urlfilter
from gridspark.llm import queries as Q

from . import brute

PAGES = "page_id long, url string, html string"
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def frame(spark, rows, schema=PAGES):
    df = spark.createDataFrame(rows, schema)
    clash = "host path rule verdict lines kept hashes n h trust distrust kind s a b total row id t key domain whole cut room rest tokens n_copies capacity budget w c".split()
    return df.withColumns({c: F.lit(c) for c in clash})


# --- URL filter ---

URLS = [
    ("http://A.b.NET/x", "a.b.net", "/x", "net/", "block"), ("http://net", "net", "", None, "allow"), ("https://x.example.net/en/1?q#f", "x.example.net", "/en/1", "example.net/en/", "allow"),
    ("https://x.example.net/enx", "x.example.net", "/enx", "net/", "block"), ("s://example.com/de/", "example.com", "/de/", "example.com/de/", "block"), ("s://notexample.com/de/", "notexample.com", "/de/", None, "allow"),
    ("s://a.org/fr/?x", "a.org", "/fr/", "org/fr/", "allow"), ("s://a.org?x/fr/", "a.org", "", None, "allow"), ("no scheme a.net/", "", "", None, "allow"), (None, "", "", None, "allow"),
    ("s://k.net:80/x", "k.net:80", "/x", None, "allow"), ("://É.net/#", "É.net", "/", "net/", "block"), ("s://", "", "", None, "allow"), ("a://b.net/c://d", "b.net", "/c://d", "net/", "block"),
]


def test_rules(spark):
    rows = [(i, u[0], None) for i, u in enumerate(URLS)]
    got = urlfilter.judge(frame(spark, rows)).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in got] == [u[1:] for u in URLS]
    assert urlfilter.judge(frame(spark, [])).count() == 0


def walk(pages, rounds, damping):
    """The same walk with dictionaries: pages (host, verdict of a rule, hosts linked)."""
    count, t, d, edges = defaultdict(int), defaultdict(float), defaultdict(float), defaultdict(int)
    for host, ruled, links in pages:
        count[host] += 1
        t[host] += ruled == "allow"
        d[host] += ruled == "block"
        for b in set(links) - {host}:
            edges[host, b] += 1
    out = []
    for seed, ends in ((t, edges), (d, {(b, a): n for (a, b), n in edges.items()})):
        base = {h: (1 - damping) * seed[h] / count[h] for h in count}
        total = defaultdict(int)
        for (a, _), n in ends.items():
            total[a] += n
        score = dict(base)
        for _ in range(rounds):
            new = defaultdict(float, base)
            for (a, b), n in ends.items():
                new[b] += damping * score.get(a, 0.0) * n / total[a]
            score = new
        out.append(score)
    return out


def linked_pages():
    r = random.Random(5)
    hosts = [f"h{i}.com" for i in range(12)] + ["bad.net", "good.org"]
    pages, rows = [], []
    for i in range(150):
        host = r.choice(hosts)
        url = f"http://{host}/{'fr/' if host == 'good.org' else ''}{i}"
        links = [r.choice(hosts if host != "good.org" else hosts[:4]) for _ in range(r.randrange(3))]
        html = "".join(f'<A HREF="//{x.upper()}/p">x</A> <a href=\'http://{x}?q\'>' for x in links) + '<a href="/own">'
        pages.append((host, {"bad.net": "block", "good.org": "allow"}.get(host), links))
        rows.append((i, url, html))
    return pages, rows


def pagerank(pages, kind, damping, rounds=600):
    """Personalised PageRank as it is defined: seeds that sum to one, the rank of hosts without a way out goes back to them."""
    count, seed, edges = defaultdict(int), defaultdict(float), defaultdict(int)
    for host, ruled, links in pages:
        count[host] += 1
        seed[host] += ruled == kind
        for b in set(links) - {host}:
            edges[(host, b) if kind == "allow" else (b, host)] += 1
    s = {h: seed[h] / count[h] for h in count}
    s = {h: v / sum(s.values()) for h, v in s.items()}
    total = defaultdict(int)
    for (a, _), n in edges.items():
        total[a] += n
    rank = dict(s)
    for _ in range(rounds):
        new = defaultdict(float)
        lost = sum(v for h, v in rank.items() if not total[h])
        for h in s:
            new[h] = (1 - damping + damping * lost) * s[h]
        for (a, b), n in edges.items():
            new[b] += damping * rank.get(a, 0.0) * n / total[a]
        rank = new
    return rank


def test_ranks_are_personalised_pagerank(spark):
    pages, rows = linked_pages()
    pages, rows = [*pages, ("end.com", None, ["h1.com"])], [*rows, (900, "http://end.com/", '<a href="//h1.com">')]  # nothing links here
    df = frame(spark, rows)
    scores = urlfilter.host_scores(urlfilter.with_rules(df.select("page_id", "url")), urlfilter.host_edges(df), 160)
    trust, distrust = (pagerank(pages, kind, urlfilter.DAMPING) for kind in ("allow", "block"))
    got = urlfilter.ranks(scores).collect()
    assert sum(r.trust for r in got) == pytest.approx(1) and sum(r.distrust for r in got) == pytest.approx(1)
    for r in got:
        assert r.trust == pytest.approx(trust[r.host], abs=1e-9) and r.distrust == pytest.approx(distrust[r.host], abs=1e-9)


def test_verdicts_over_links_equal_the_sql(spark):
    """The given tables have no links between hosts; these have, so the walk decides here."""
    _, rows = linked_pages()
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, url varchar, html varchar)")
    con.executemany("insert into pages values (?, ?, ?)", rows)
    want = con.sql(Q.OP7_SQL).project("page_id, host, path, rule, verdict").fetchall()
    got = [tuple(r) for r in urlfilter.judge(frame(spark, rows)).select("page_id", "host", "path", "rule", "verdict").collect()]
    assert sorted(got) == sorted(want) and {"block", "allow"} <= {r[4] for r in got if r[3] is None}


def test_scores_equal_a_plain_walk(spark):
    pages, rows = linked_pages()
    df = frame(spark, rows)
    rounds = 12
    got = urlfilter.host_scores(urlfilter.with_rules(df.select("page_id", "url")), urlfilter.host_edges(df), rounds).collect()
    trust, distrust = walk(pages, rounds, urlfilter.DAMPING)
    for x in got:
        assert x.trust == pytest.approx(trust.get(x.host, 0.0)) and x.distrust == pytest.approx(distrust.get(x.host, 0.0))
    verdicts = {r.host: r.verdict for r in urlfilter.judge(df).collect() if r.rule is None}
    trust, distrust = walk(pages, 400, urlfilter.DAMPING)  # verdicts are those of the whole walk
    floor = urlfilter.FLOOR * (1 - urlfilter.DAMPING)
    want = {h: "block" if distrust[h] > trust.get(h, 0) and distrust[h] > floor else "allow" for h in verdicts}
    assert verdicts == want and "block" in want.values()


def test_walk_goes_on_until_no_verdict_can_change(spark):
    pairs = [(f"h{i}.com", f"h{i ^ 1}.com") for i in range(10)]
    rows = [(i, f"http://{a}/x", f'<a href="//{b}/"><a href="//bad.net/">') for i, (a, b) in enumerate(pairs)] + [(99, "http://bad.net/x", "")]
    pages = [(a, None, [b, "bad.net"]) for a, b in pairs] + [("bad.net", "block", [])]
    floor = urlfilter.FLOOR * (1 - urlfilter.DAMPING)
    assert walk(pages, 12, urlfilter.DAMPING)[1]["h0.com"] < floor < walk(pages, 200, urlfilter.DAMPING)[1]["h0.com"]
    assert {r.verdict for r in urlfilter.judge(frame(spark, rows)).collect()} == {"block"}


# --- line dedup ---


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_boilerplate_goes_and_rare_lines_stay(spark, monkeypatch, limit):
    monkeypatch.setattr(linededup, "MAX_BROADCAST", limit)
    html = lambda i, extra="": f"<html><script>var x='<p>';</script><!-- {i} --><nav><a href='/'>Home</a> <b>News</b></nav>\n<p>own {i}</p><p>own {i}</p>{extra}</html>"
    rows = [(i, "http://S.example.com/x", html(i, "<p>twice</p>" if i < 2 else "")) for i in range(10)]
    rows += [(20, "http://two.com/", html(20)), (21, "http://two.com/", html(21)), (30, None, html(30)), (31, "nothing", html(31)), (32, "x", html(32)), (33, "http://s.example.com", None), (0, rows[0][1], rows[0][2])]
    got = {}
    for r in linededup.drop_boilerplate(frame(spark, rows)).collect():
        got.setdefault(r.page_id, []).append((r.host, r.n_lines, r.n_dropped, r.kept))
    assert got[5] == [("s.example.com", 3, 1, "own 5\nown 5")]
    assert got[0] == [("s.example.com", 4, 1, "own 0\nown 0\ntwice")] * 2
    assert got[20] == [("two.com", 3, 0, "Home News\nown 20\nown 20")] and got[33] == [("s.example.com", 0, 0, "")]
    assert [got[i][0][2] for i in (30, 31, 32)] == [0, 0, 0]
    assert linededup.drop_boilerplate(frame(spark, [])).count() == 0


def test_unclosed_scripts_hide_the_rest_and_take_linear_time(spark):
    rows = [(1, "http://a.com", "<p>seen</p><script>x<p>not</p>"), (2, "http://a.com", "<p>seen</p><!-- <p>not</p>"), (3, "http://b.com", "<p>x</p>" + "<script" * 60_000)]
    got = {r.page_id: r.kept for r in linededup.drop_boilerplate(frame(spark, rows)).collect()}
    assert got == {1: "seen", 2: "seen", 3: "x"}
    assert {r.kept for r in linededup.drop_boilerplate(frame(spark, rows[:2]), min_pages=1).collect()} == {""}


# --- mixing ---

DOCS = "doc_id long, text string, lang string, source string"


def documents(n=300, seed=2):
    r = random.Random(seed)
    out = []
    for i in range(n):
        source = "src0" if i % 3 == 0 else f"src{r.randrange(12)}"
        out.append((i, " ".join(["x"] * r.randrange(0, 30)), r.choice(["en", "de", "fr", None]), r.choice([source, source, source, None, "blog"])))
    return out


def plain_mix(rows, mix):
    doc = []
    for d, text, lang, source in rows:
        digits = "".join(c for c in (source or "")[3:] if c.isdigit())
        domain = mixing.DOMAINS[int(digits) % 4] if digits else "other"
        doc.append((d, len((text or "").split()), (domain, lang or "", source or ""), text))
    size = defaultdict(int)
    for _, n, leaf, _ in doc:
        size[leaf] += n
    total = sum(size.values())
    cap = {k: v * mix.epochs for k, v in size.items()}
    budget = {(): min(total * mix.share[0] // mix.share[1], total * mix.epochs)}
    for depth, level in enumerate(mixing.LEVELS):
        for parent in {k[:depth] for k in cap}:
            below = {k[: depth + 1] for k in cap if k[:depth] == parent}
            capacity = {k: sum(v for leaf, v in cap.items() if leaf[: depth + 1] == k) for k in below}
            weight = {k: getattr(mix, level).get(k[-1], 1) for k in below}
            budget |= brute.water(capacity, weight, budget[parent])
    out = defaultdict(list)
    for leaf in cap:
        b, t = budget[leaf], size[leaf]
        whole = b // t if t else 0
        rest = b - whole * t
        mine = sorted((hashlib.md5(f"{mix.seed}:{whole}:{d}".encode()).hexdigest(), d, n) for d, n, x, _ in doc if x == leaf)
        upto = 0
        for _, d, n in mine:
            upto += n
            out[d].append(whole + int(not t or (rest > 0 and upto <= rest)))
    return dict(out)


MIXES = [mixing.PRODUCTION, mixing.Mix(domain={"web": 50}, share=(3, 1), epochs=3, seed=1), mixing.Mix(lang={"de": 9}, source={"src0": 7, "src4": 100}, share=(9, 10), epochs=1), mixing.Mix(share=(0, 1))]


@pytest.mark.parametrize("mix", MIXES)
def test_mixing_equals_plain_budgets(spark, mix):
    rows = documents()
    got = {r.doc_id: [r.n_copies] for r in mixing.copies(frame(spark, rows, DOCS), mix).select("row.doc_id", "n_copies").collect()}
    assert got == plain_mix(rows, mix)


def test_mixed_documents_come_as_often_as_they_should(spark):
    rows = documents(60)
    df = frame(spark, rows, DOCS)
    mix = MIXES[1]
    got = mixing.mix_documents(df, mix)
    assert got.columns == df.columns
    count = defaultdict(int)
    for r in got.collect():
        count[r.doc_id] += 1
        assert r.row == "row" and r.tokens == "tokens"
    assert dict(count) == {d: c[0] for d, c in plain_mix(rows, mix).items() if c[0]}


def test_mixing_of_odd_rows(spark):
    rows = [(1, None, None, None), (1, "a b", "en", "src1"), (1, "a b", "en", "src1"), (None, "c d e f", "en", "src1"), (2, "", "en", "src2")]
    got = mixing.copies(frame(spark, rows, DOCS)).select("row.*", F.col("n_copies").alias("n_taken")).collect()
    assert len(got) == 5 and len({r.n_taken for r in got if r.text == "a b"}) == 1
    assert mixing.copies(frame(spark, [], DOCS)).count() == 0


def test_budgets_are_spent_and_capped(spark):
    leaves = spark.createDataFrame([("web", "en", "a", 1000), ("web", "de", "b", 10), ("books", "en", "c", 500)], "domain string, lang string, source string, tokens long")
    got = {r.source: r.budget for r in mixing.budgets(leaves, mixing.Mix(share=(1, 1), epochs=1)).collect()}
    assert got == {"a": 1000, "b": 10, "c": 500}
    half = {r.source: r.budget for r in mixing.budgets(leaves, mixing.Mix(share=(1, 2), epochs=1)).collect()}
    assert half == {"a": 367, "b": 10, "c": 377}


# --- pipeline and registry ---


def test_pipeline_stages(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, SF), "stage")
        assert docs.columns == columns
        counts.append(docs.count())
    assert len(names) == 5 and counts[0] >= counts[1] > counts[2] >= counts[3] > counts[4] > 0
    kept = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
    want = brute.tokens(kept, tokens.Vocabulary(tokens.vocabulary_path()).tokenizer)
    got = sorted(map(tuple, corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()))
    assert [r[2:] for r in got] == [r[2:] for r in want] and [r[1] for r in got] == [r[1] for r in want]


def test_pipeline_drops_what_each_stage_should(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()}
    assert kept == {d for d, _, c in brute.simhash(rows) if d == c}
    clean = {r.doc_id for r in corpus_pipeline.remove_benchmarks(spark, docs, SF).collect()}
    assert clean == {r[0] for r in brute.contamination(rows, bench) if not r[5]}
    speech = {r.doc_id for r in corpus_pipeline.identify_language(spark, docs, SF).collect()}
    assert {d for d, t in rows if not any(map(str.isalpha, t or ""))}.isdisjoint(speech) and len(speech) > 0.95 * len(rows)


def test_pipeline_of_nothing(spark, tmp_path):
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_every_operator_is_registered():
    got = entry.queries()
    assert [sum(n.startswith(f"op{k}_") for n in got) for k in range(1, 11)] == [1] * 10 and "pipeline" in got


def _plain(rows):
    return sorted(map(repr, [tuple(round(v, 6) + 0.0 if isinstance(v, float) else v for v in r) for r in rows]))


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_operator_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = Q.queries()[name](spark, SF)
    columns = sorted(df.columns)
    want = con.sql(Q.oracle_sql()[name])
    assert columns == sorted(want.columns)
    assert _plain(df.select(*columns).collect()) == _plain(want.project(", ".join(columns)).fetchall())


def test_scratch_folder_is_the_sessions(spark):
    df = scratch.table(spark.range(5).withColumn("x", F.lit("a")), "t")
    assert all(f.startswith(spark.conf.get("spark.checkpoint.dir")) for f in df.inputFiles()) and df.count() == 5
    scratch.drop(df)
    with pytest.raises(Exception):
        df.count()
