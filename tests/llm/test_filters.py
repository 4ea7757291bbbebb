"""URL filter, language, pages and decontamination."""

from __future__ import annotations

import html
import inspect
import itertools
import math
import random
import re
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from fathomic.llm import bloom_cascade as bc
from fathomic.llm import langid, pagediff, queries, tiling


def oracle(spark, sf, urls=None):
    db = duckdb.connect()
    if urls is None:
        db.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    else:
        db.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
        db.executemany("INSERT INTO pages VALUES (?, ?)", urls)
    return sorted(db.execute(f"SELECT page_id, host, path, rule, verdict FROM ({queries.OP7_SQL})").fetchall(), key=str)


def test_url_filter_equals_sql(spark, sf):
    got = sorted((tuple(r) for r in queries.op7_url_filter(spark, sf).select("page_id", "host", "path", "rule", "verdict").collect()), key=str)
    assert got == oracle(spark, sf)


def test_url_filter_awkward(spark):
    urls = ["http://EXAMPLE.com/en/7", "http://a.example.com/en/8", "x.net/de/1", None, "", "http://net/de/", "http://b.example.net/de/80?x", "https://xnet/de/", "ftp://org#/es/", "http://casino-win.example.com", "http://m.ads-track.example.com/fr/", "://", "http://a.org/es/x://y", "http://com/en/\nq", "a://b://c.net/de/"]
    rows = [(k % 13, u) for k, u in enumerate(urls)]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit(1) for c in ("host", "path", "key", "rule", "best")})
    got = sorted((tuple(r) for r in bc.judge(df).collect()), key=str)
    want = oracle(spark, None, [(k, u) for k, u in enumerate(urls)])
    assert [r[1:] for r in sorted(got, key=lambda r: str(r[1:]))] == [r[1:] for r in sorted(want, key=lambda r: str(r[1:]))]
    assert bc.judge(df.limit(0)).collect() == []


@pytest.mark.parametrize("rate", [0.5, 0.05])
def test_cascade_is_exact(spark, rate):
    universe = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.filter("key LIKE '%7'")
    levels = bc.build(listed, universe, rate)
    assert len(levels) > 1
    got = {r["key"] for r in universe.filter(bc.member(F.col("key"), levels)).collect()}
    assert got == {r["key"] for r in listed.collect()}
    assert bc.build(listed.limit(0), universe) == []


def test_url_filter_runs_in_the_jvm(spark, sf):
    plan = queries.op7_url_filter(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Join", plan)


def test_language_held_out(spark, docs, awkward, empty):
    train = docs.filter(~langid.held_out("doc_id"))
    model = langid.learn(train)
    out = langid.predict(docs.select("doc_id", "text", "lang", langid.held_out("doc_id").alias("held")), model, ["doc_id", "lang", "held"]).collect()
    held = [r for r in out if r["held"]]
    assert sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.9
    assert all(0 <= r["score"] <= 1 for r in out)
    odd = langid.predict(awkward, model, ["doc_id"]).collect()
    assert {r["doc_id"] for r in odd if r["lang_pred"] == "und"} == {2, 3, 4}
    assert all(r["rejected"] for r in odd if r["lang_pred"] == "und")
    assert langid.predict(empty, langid.learn(empty), ["doc_id"]).collect() == []
    assert {r["lang_pred"] for r in langid.predict(awkward, None, ["doc_id"]).collect()} == {"und"}


def _plain_vector(text, buckets):
    """Shares of the hashed runs of two to four bytes that touch a letter and hold edges only at their ends."""
    raw = [b if 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in text.encode()]
    counts = {}
    for n in (2, 3, 4):
        for k in range(len(raw) - n + 1):
            run = raw[k : k + n]
            if all(b == 32 for b in run) or 32 in run[1:-1]:
                continue
            key = 0
            for b in run:
                key = key * 256 + b
            h = key ^ ((n * 0xD6E8FEB86659FD93 + 0x2545F4914F6CDD1D) % 2**64)
            h = (h ^ h >> 32) * 0xD6E8FEB86659FD93 % 2**64
            h = (h ^ h >> 29) * 0x9FB21C651E98DF25 % 2**64
            h ^= h >> 32
            counts[h % buckets] = counts.get(h % buckets, 0) + 1
    total = sum(counts.values())
    return {k: c / total for k, c in counts.items()}


def test_language_equals_a_plain_computation(docs):
    """Features, softmax, temperature and rejection, recomputed row by row in plain Python."""
    model = langid.learn(docs.filter(~langid.held_out("doc_id")))
    got = langid.predict(docs, model, ["doc_id", "text"]).collect()
    for r in got:
        if not any(c.isalpha() for c in r["text"] or ""):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
            continue
        shares = _plain_vector(r["text"], len(model.table))
        logits = [sum(x * float(model.table[k][j]) for k, x in shares.items()) + float(model.bias[j]) for j in range(len(model.labels))]
        top = max(logits)
        e = [math.exp((z - top) / model.temperature) for z in logits]
        best = max(range(len(e)), key=e.__getitem__)
        score = e[best] / sum(e)
        assert r["lang_pred"] == model.labels[best]
        assert abs(r["score"] - score) < 1e-5
        assert r["rejected"] == (r["score"] < model.reject_below)


def test_language_samples_all_languages_in_one_pass(spark, docs):
    many = docs.unionByName(docs.withColumn("lang", F.concat("lang", F.lit("-x"))))
    tracker = spark.sparkContext._jsc.sc().statusTracker()
    counts, labels = [], []
    for df in (docs, many):
        before = len(tracker.getJobIdsForGroup(None))
        labels.append(len(langid.learn(df, sample=50).labels))
        counts.append(len(tracker.getJobIdsForGroup(None)) - before)
    assert counts[0] == counts[1]
    assert labels[1] == 2 * labels[0]


def test_rejected_rows_go_whatever_the_columns_are_called(awkward, docs):
    model = langid.learn(docs)
    df = awkward.withColumns({c: F.lit("clash") for c in ("score", "lang_pred", "rejected", "__text", "rank")})
    kept = langid.keep_known(df, model)
    assert kept.columns == df.columns
    odd = langid.predict(df, model, ["doc_id", "score"]).filter("NOT rejected")
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in odd.collect())


def test_training_is_not_shortened():
    assert langid.SAMPLE >= 1500
    assert inspect.signature(langid.fit).parameters["epochs"].default >= 8


def test_pages_give_their_articles(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    source = {r["page_id"]: r["html"] for r in pages.collect()}
    out = pagediff.extract(pages).collect()
    assert len(out) == len(source)
    for r in out:
        body = re.search(r"<article>(.*?)(?:</article>|$)", source[r["page_id"]], re.DOTALL)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>?", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert r["text"] == "\n".join(b for b in blocks if b)
        assert r["n_chars"] == len(r["text"])


def lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_alignment_is_a_longest_common_subsequence():
    rng = random.Random(9)
    for _ in range(300):
        a, b = (["abcd"[rng.randrange(4)] for _ in range(rng.randrange(12))] for _ in range(2))
        pairs = sorted(pagediff._common(a, b))
        assert len(pairs) == lcs(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in itertools.pairwise(pairs))


def test_alignment_of_long_pages_is_a_longest_common_subsequence():
    rng = random.Random(10)
    a, b = (["abcdefgh"[rng.randrange(8)] for _ in range(2100)] for _ in range(2))
    pairs = sorted(pagediff._common(a, b))
    assert len(pairs) == lcs(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in itertools.pairwise(pairs))


TEMPLATE = "<html><head><title>t</title></head><body><div>Site name</div>{}<div>All rights &amp; more</div></body></html>"


def test_differencing_removes_the_hosts_template(spark):
    rows = [(k, f"http://h.test/p/{k}", TEMPLATE.format(f"<p>Own text {k}<p>More&nbsp; of <b>it</b> {k}</p>")) for k in range(5)]
    rows += [(9, "http://other.test/p/1", TEMPLATE.format("<p>Alone</p>")), (10, None, None), (11, "http://h.test/p/9", ""), (12, "http://h.test/p/8", "<form>f</form><p>x<script>y</p></script>z<!-- <p>c --><div class='cookie-notice'>n</div><aside>s</aside><ul id=comments><li>c</ul><p>unclosed")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("q") for c in ("host", "path", "bucket", "lines", "text")})
    out = {r["page_id"]: r["text"] for r in pagediff.extract(df).collect()}
    for k in range(5):
        assert out[k] == f"Own text {k}\nMore of it {k}"
    assert out[9] == "Site name\nAlone\nAll rights & more"
    assert out[10] == out[11] == ""
    assert out[12] == "xz\nunclosed"
    assert pagediff.extract(df.limit(0)).collect() == []


def test_unmarked_copies_keep_their_text(spark):
    def page(k):
        return TEMPLATE.format(f"<p>Own text {k}</p><p>More {k}</p>")

    rows = [(1, "http://h.test/a", page(1)), (2, "http://h.test/a?s=2", page(1)), (3, "http://h.test/b", page(3)), (3, "http://h.test/b", page(3)), (None, "http://h.test/b", page(3))]
    rows += [(10 + k, f"http://mirror.test/{k}", page(7)) for k in range(3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = sorted((r["page_id"] or 0, r["text"]) for r in pagediff.extract(df).collect())
    one, three = "Own text 1\nMore 1", "Own text 3\nMore 3"
    assert out[:5] == [(0, three), (1, one), (2, one), (3, three), (3, three)]
    assert {t for _, t in out[5:]} == {"Site name\nOwn text 7\nMore 7\nAll rights & more"}


def test_neighbours_are_the_nearest_pages_that_differ(spark):
    """Runs of copies longer than a bucket, in hosts of many and of few pages, against a search over all rows."""
    rng = random.Random(11)
    rows, k = [], 0
    for host, sizes in (("a", [3, 1, 150, 2, 1]), ("b", [1]), ("c", [200]), ("d", [1, 90, 1]), ("e", [1] * 60)):
        for run in sizes:
            body = "".join(f"<p>line {rng.randrange(6)}</p>" for _ in range(4)) + f"<p>{k}</p>"
            for _ in range(run):
                rows.append((k, f"http://{host}.test/{k:06}", TEMPLATE.format(body)))
                k += 1
    got = {r["page_id"]: r["text"] for r in pagediff.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    found = [(r[1].split("/")[2], pagediff.lines(r[2])) for r in rows]
    for i, (host, own) in enumerate(found):
        sides = (range(i - 1, -1, -1), range(i + 1, len(found)))
        near = [next((found[j][1] for j in side if found[j] != (host, own)), None) for side in sides]
        hosts = [next((found[j][0] for j in side if found[j] != (host, own)), None) for side in sides]
        assert got[i] == pagediff.difference(own, [x for x, h in zip(near, hosts, strict=True) if h == host])


def tiles_by_search(item, doc, least):
    """Greedy string tiling by looking at every pair of places."""
    a, b = [False] * len(item), [False] * len(doc)
    covered = 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n] and not a[i + n] and not b[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return covered
        for k in range(n):
            a[i + k] = b[j + k] = True
        covered += n


def test_tiling_equals_brute_force(spark):
    rng = random.Random(8)
    items, docs = [], []
    for k in range(12):
        words = [f"w{rng.randrange(40)}" for _ in range(rng.choice((2, 4, 9, 25)))]
        items.append((k, " ".join(words)))
    for d in range(60):
        _, text = rng.choice(items)
        words = text.split()
        cut = rng.randrange(len(words) + 1)
        parts = [words[cut:], [f"x{rng.randrange(9)}"], words[:cut]] if rng.random() < 0.6 else [words]
        noise = [f"w{rng.randrange(40)}" for _ in range(20)]
        docs.append((d, " ".join([*noise[:10], *[w for p in parts for w in p], *noise[10:]])))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for d, t in docs:
        for i, q in items:
            item = q.split()
            covered = tiles_by_search(item, t.split(), min(5, len(item)))
            if covered >= 0.8 * len(item):
                want.add((d, i, covered))
    got = {(r["doc_id"], r["item_id"], r["covered"]) for r in tiling.contaminated(df, bench).collect()}
    assert got == want
    small = {(r["doc_id"], r["item_id"], r["covered"]) for r in tiling.contaminated(df, bench, block_bytes=40).collect()}
    assert small == want
    bad = {d for d, _, _ in want}
    assert {r["doc_id"] for r in tiling.clean(df, bench).collect()} == {d for d, _ in docs} - bad
    one = tiling.clean(df, bench, block_bytes=40)
    assert {r["doc_id"] for r in one.collect()} == {d for d, _ in docs} - bad
    assert one._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    twice = bench.unionByName(bench.withColumn("item_id", F.col("item_id") + 100))
    doubled = {(r["doc_id"], r["item_id"] % 100, r["covered"]) for r in tiling.contaminated(df, twice).collect()}
    assert doubled == want


def test_a_stock_phrase_of_many_items_calls_no_tiling(monkeypatch):
    import numpy as np
    import pyarrow as pa

    phrase = "this is a stock phrase of many items"
    texts = [f"{phrase} " + " ".join(f"own{k}x{j}" for j in range(30)) for k in range(300)]
    block = tiling.Block(list(range(300)), texts, 5, 0.8)
    calls = []
    monkeypatch.setattr(tiling, "tile", lambda *a: calls.append(a) or [])
    docs = [f"a text with {phrase} in it", texts[7]]
    words, first = tiling.words_of(*tiling.buffers(pa.array(docs)))
    hits = [(r, k) for r, k, _, _ in block.hits(words, first)]
    assert hits == [(1, 7)]
    assert len(calls) == 1
    assert np.isin(block.seeds[0][:3], block.tables[0][1]).sum() == 0


def test_decontamination_awkward(spark, awkward, empty):
    bench = spark.createDataFrame([(1, "alpha BETA, gamma delta second line here"), (2, None), (3, ""), (4, "...")], "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"]) for r in tiling.contaminated(awkward, bench).collect())
    assert got == [(1, 1), (6, 1), (6, 1)]
    assert tiling.clean(awkward, bench).count() == awkward.count() - 3
    assert tiling.contaminated(empty, bench).collect() == []
    assert tiling.clean(awkward, bench.limit(0)).count() == awkward.count()


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<p>a</p><svg/><p>b</p>", "a\nb"),
        ("<p>a</p><svg><path d=x><text>no</text><p>b</p>", "a\nb"),
        ('<p class=x">one</p><p>two</p>', "one\ntwo"),
        ("<p title=it's>one</p><p>two</p>", "one\ntwo"),
        ('<article><p>x</p><div class="related-work"><p>kept</p></div><div class=comments>no</div></article>', "x\nkept"),
        ("<head><title>t<b></title><p>text", "text"),
        ("<p>&am<b></b>p;</p>", "&amp;"),
        ("a<!-->b<!-- c -->d", "abd"),
        ("<b><nav>no</b>no</nav>yes", "yes"),
        ("a < b &amp; c&lt;d", "a < b & c<d"),
    ],
)
def test_tokens_follow_the_standard(page, want):
    assert "\n".join(t for t, _ in pagediff.lines(page)) == want


def test_unclosed_tags_take_linear_time():
    for page in ("<b>" * 40_000 + "</i>" * 40_000, "<b><p></p>" * 20_000, "<p><b>" * 20_000 + "</p>" * 20_000):
        start = time.process_time()
        pagediff.lines(page)
        assert time.process_time() - start < 3


def test_template_lines_within_articles_go_by_their_neighbours(spark, sf):
    """Real pages of one host with a template put into their articles: without neighbours it stays."""
    pages = [r for r in spark.read.parquet(f"{sf.replace('0.001', '0.01')}/pages.parquet").collect() if "</article>" in (r["html"] or "")][:12]
    tail = "<p>Share this page</p><p>Write to us</p>"
    made = [(k, f"http://one.test/{k:02}", r["html"].replace("</article>", tail + "</article>")) for k, r in enumerate(pages)]
    want = ["\n".join(t for t, _ in pagediff.lines(r["html"])) for r in pages]
    df = spark.createDataFrame(made, "page_id long, url string, html string")
    together = {r["page_id"]: r["text"] for r in pagediff.extract(df).collect()}
    inner = range(1, len(pages) - 1)
    assert [together[k] for k in inner] == [want[k] for k in inner]
    alone = spark.createDataFrame([(k, f"http://h{k}.test/", h) for k, _, h in made], "page_id long, url string, html string")
    assert all(r["text"] == f"{want[r['page_id']]}\nShare this page\nWrite to us" for r in pagediff.extract(alone).collect())


def test_pages_without_marks_are_told_by_their_neighbours(spark, sf):
    """The same pages with their article, menu and footer unmarked, under the template of one host."""
    pages = [r for r in spark.read.parquet(f"{sf.replace('0.001', '0.01')}/pages.parquet").collect() if "</article>" in (r["html"] or "")][:12]
    bodies = [re.search(r"<article>(.*)</article>", r["html"], re.DOTALL)[1] for r in pages]
    want = ["\n".join(t for t, _ in pagediff.lines(b)) for b in bodies]
    made = [(k, f"http://one.test/{k:02}", TEMPLATE.format(f"<div><a href=/>Start</a> | News</div><div>{b}</div><div>About us</div>")) for k, b in enumerate(bodies)]
    together = pagediff.extract(spark.createDataFrame(made, "page_id long, url string, html string"))
    assert {r["page_id"]: r["text"] for r in together.collect()} == dict(enumerate(want))
    alone = pagediff.extract(spark.createDataFrame([(k, f"http://h{k}.test/", h) for k, _, h in made], "page_id long, url string, html string"))
    assert {r["page_id"]: r["text"] for r in alone.collect()} == {k: f"Site name\nStart | News\n{w}\nAbout us\nAll rights & more" for k, w in enumerate(want)}


def test_near_copies_and_quotes_keep_their_text():
    body = [(f"line {k} of the text", False) for k in range(30)]
    other = [*body[:-1], ("another end", False)]
    assert pagediff.difference(body, [other, other]).count("\n") == 29
    marked = [(f"own {k}", True) for k in range(4)]
    quoted = [*marked[:2], ("all quote this", True), *marked[2:]]
    pages = [[(f"{c}{k}", True) for k in range(2)] + [("all quote this", True)] + [(f"{c}{k}", True) for k in range(2, 4)] for c in "ab"]
    assert "all quote this" in pagediff.difference(quoted, pages)


def test_buckets_do_not_change_the_text(spark, monkeypatch):
    """Runs of equal pages over many buckets, and hosts cut by bounds."""
    rng = random.Random(4)
    rows = []
    for k in range(160):
        own = "same" if 40 <= k < 90 else f"own {rng.randrange(6) if k < 40 else k} text"
        rows.append((k, f"http://h{k // 120}.test/{k // 2:03}", TEMPLATE.format(f"<p>{own}</p><p>{own} more of it</p>" + "<!-- x -->" * rng.randrange(9))))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = []
    for size in (1 << 30, 700, 60):
        monkeypatch.setattr(pagediff, "_BUCKET_BYTES", size)
        monkeypatch.setattr(pagediff, "partitions", lambda _: 1 if size > 700 else 8)
        got.append(sorted((r["page_id"], r["text"]) for r in pagediff.extract(df).collect()))
    assert got[0] == got[1] == got[2]
