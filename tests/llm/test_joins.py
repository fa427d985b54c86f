"""Jaccard join, nearest neighbours, page extraction and url rules against brute force."""

import itertools
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from twinsift.llm import jaccard, siteextract, urlrules, vptree


def slow_components(rows):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    members = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        members[find(i)].append(doc_id)
    return [(rows[i][0], len(sets[i]), min((d for d in members[find(i)] if d is not None), default=None))
            for i in range(len(rows))]


def near_copies():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    bases = [[rng.choice(words) for _ in range(rng.randint(3, 80))] for _ in range(15)]
    passage = [rng.choice(words) for _ in range(40)]
    rows = []
    for i in range(350):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((i, " ".join(w + passage if rng.random() < 0.2 else w)))
    hot = [" ".join(words[:100])] * 40
    rows += [(400 + i, t) for i, t in enumerate(hot)]
    return rows + [(600, None), (601, ""), (602, "  \n"), (603, "One TWO"), (604, "one two"),
                   (604, "one two"), (None, "ONE two"), (None, "nobody else says this line at all"),
                   (605, "x" * 20_000), (606, "a b c d e"), (607, "a b c d e f")]


@pytest.mark.parametrize("part,lookups,frequent", [(64, 512, 24), (2, 3, 4)])
def test_jaccard_components(spark, monkeypatch, part, lookups, frequent):
    for name, value in (("PART", part), ("LOOKUPS", lookups), ("FREQUENT", frequent)):
        monkeypatch.setattr(jaccard, name, value)
    rows = near_copies()
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, n int").repartition(3)
    got = [(r[0], r[1], r[2]) for r in jaccard.jaccard_components(docs).collect()]
    assert sorted(got, key=str) == sorted(slow_components(rows), key=str)


def test_jaccard_without_groups(spark, monkeypatch):
    """The matrix alone finds every link: no class joins a leader first."""
    monkeypatch.setattr(jaccard, "ROUNDS", 0)
    rows = near_copies()[:150]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in jaccard.jaccard_components(docs).collect()]
    assert sorted(got, key=str) == sorted(slow_components(rows), key=str)


def test_keep_one(spark):
    docs = spark.createDataFrame([(2, "a b c d e f", "k"), (1, "a b c d e f", "k"), (3, "z", "k"), (4, None, "k"),
                                  (None, "a b c d e f", "k")], "doc_id long, text string, component_id string")
    out = jaccard.keep_one(docs)
    assert out.columns == docs.columns
    assert sorted([r["doc_id"] for r in out.collect()], key=str) == [1, 3, 4, None]
    assert jaccard.keep_one(docs.limit(0)).count() == 0


def test_keep_one_row(spark):
    """Repeated and null ids leave one row of a group as well."""
    text, near = " ".join(f"w{i}" for i in range(40)), " ".join(f"w{i}" for i in range(1, 40))
    rows = ([(1, text, "k")] * 5 + [(1, near, "k"), (1, "another text of the same id", "k"), (2, text, "k")]
            + [(None, text, "k")] * 5 + [(None, "only null ids say this", "k")] * 4
            + [(3, "one of two", "a"), (3, "one of two", "b"), (4, None, "k"), (None, "", "k")])
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string").repartition(4)
    out = jaccard.keep_one_row(docs)
    assert out.columns == docs.columns and out.schema == docs.schema
    got = sorted((tuple(r) for r in out.collect()), key=str)
    group, rest = [g for g in got if g[1] in (text, near)], [g for g in got if g[1] not in (text, near)]
    assert len(group) == 1 and group[0][0] == 1
    assert [r[:2] for r in rest] == sorted([
        (1, "another text of the same id"), (3, "one of two"), (4, None), (None, ""),
        (None, "only null ids say this")], key=str)
    assert jaccard.keep_one_row(docs.limit(0)).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    rows = jaccard.components(spark.createDataFrame(edges, "a long, b long")).collect()
    root = {r["node"]: r["root"] for r in rows}
    assert root == {i: 0 for i in range(1, 61)} | {i: 100 for i in range(101, 160)}


def slow_search(vectors, every, k):
    first = {}
    for vec_id, v in vectors:
        good = vec_id is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)
        if good:
            first[vec_id] = min(first.get(vec_id, v), v)
    out = []
    for q in sorted(first):
        if q % every == 0:
            near = sorted((float(np.sqrt(((np.array(first[q]) - np.array(v)) ** 2).sum())), i)
                          for i, v in first.items() if i != q and len(v) == len(first[q]))[:k]
            out += [(q, r, i, d) for r, (d, i) in enumerate(near, 1)]
    return out


def vectors():
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(8, 12))
    rows = [(i, (centers[i % 8] + 0.3 * rng.normal(size=12)).tolist()) for i in range(700)]
    rows += [(700 + i, rows[3][1]) for i in range(120)]          # one very common vector
    rows += [(900, None), (910, [0.0] * 12), (920, [None] + [1.0] * 11), (930, [math.nan] + [1.0] * 11),
             (940, [math.inf] + [1.0] * 11), (950, [1.0, 2.0]), (960, [1.0, 2.5]), (950, [0.5, 2.0]),
             (None, [1.0] * 12), (970, [])]
    return rows


@pytest.mark.parametrize("shard_rows", [8192, 100])
def test_search_is_exact_with_factor_one(spark, shard_rows):
    rows = vectors()
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, rank string")
    got = sorted(tuple(r) for r in vptree.search(df, every=10, shard_rows=shard_rows).collect())
    want = slow_search(rows, 10, 10)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], atol=1e-12)
    assert vptree.search(df.limit(0)).count() == 0


def test_relaxed_search_recalls(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r["vec_id"], [float(x) for x in r["embedding"]]) for r in df.collect()]
    want = {(q, i) for q, _, i, _ in slow_search(rows, 10, 10)}
    got = {(r["query_id"], r["vec_id"]) for r in vptree.search(df, every=10, factor=1.1).collect()}
    assert len(got & want) / len(want) >= 0.9


PAGES = [
    ("<p>a<b>c<p>d &amp; &lt;x&gt;<br>e", "ac\nd & <x> e"),
    ('<div class="ad">x</div>y', "y"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
    ("<p>x</p>text <i>in</i>line<div>k</div> tail", "x\ntext inline\nk\ntail"),
    ('<nav>n</nav><article><h1>T</h1><div id="comments"><p>c</p></div><p>m  \n n</p></article><aside>z</aside>',
     "T\nm n"),
    ("a < b and c > d", "a < b and c > d"),
    ("<!-- x", ""), ("", ""), (None, ""),
    ("<script>var a='</p>';</script><style>p{}</style><form>f</form><p>q</p><footer>w", "q"),
    ("<ul><li>one<li>two</ul>", "one\ntwo"),
    ("<p>" + "word " * 20_000 + "</p>", ("word " * 20_000).strip()),
    ('<p title="a>b">c</p><p class="lead">d', "c\nd"),
    ("<div class='cookie-notice'>k</div><main><p>v</p></main>", "v"),
]


def test_extraction_of_single_pages(spark):
    rows = [(i, None if i % 2 else f"https://h{i}.org/x", h, "c") for i, (h, _) in enumerate(PAGES)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in siteextract.extract(df).collect()}
    for i, (_, want) in enumerate(PAGES):
        assert got[i]["text"] == want and got[i]["n_chars"] == len(want) and got[i]["url"] == rows[i][1]
    assert siteextract.extract(df.limit(0)).count() == 0


def test_style_tree_removes_what_repeats(spark):
    """Blocks without a telling tag or class go when they say the same on a host's pages."""
    page = ("<body><div class=x1><p>Same words</p><p>on each page</p></div>"
            "<div class=x2><p>Own text {i}</p><p>more {i}</p></div></body>")
    rows = [(i, "http://a.org/1", page.format(i=i)) for i in range(30)] + [(99, "http://b.org/1", page.format(i=99))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in siteextract.extract(df).collect()}
    assert got[5] == "Own text 5\nmore 5"
    assert got[99] == "Same words\non each page\nOwn text 99\nmore 99"    # alone on its host
    tree = {(r["host"], r["path"]): r for r in siteextract.style_tree(df).collect()}
    assert tree["a.org", "/body/div.x1/p"]["content"] < 0.2 < tree["a.org", "/body/div.x2/p"]["content"]


@pytest.mark.parametrize("tag", ["div", "b", "article", "ul", "p"])
def test_deep_nesting(tag):
    deep = f"<{tag}>" * 10_000 + "core" + f"</{tag}>" * 10_000
    assert siteextract.main_text(f"<p>a</p>{deep}<p>b</p>").replace("\n", " ").split() == ["a", "core", "b"]
    assert siteextract.main_text("<div class=widget>" * 5_000 + "core " * 300).split() == ["core"] * 300
    assert siteextract.main_text("</i>" * 5_000 + "x" + "<div>" * 5_000 + "</i>" * 5_000 + "y") == "x\ny"
    paths = {known[0] for known in siteextract.page_features(deep)}
    assert max(map(len, paths)) <= 2 * siteextract.LONG_PATH + 40


def slow_tree(pages):
    """Entropies of one host's paths, from the texts and layouts of each page."""
    shapes, texts = defaultdict(list), defaultdict(list)
    for page in pages:
        found = defaultdict(set)
        for path, _, _, kind, feature in siteextract.page_features(page):
            found[path, kind].add(feature)
        for (path, kind), values in found.items():
            (shapes if kind == "shape" else texts)[path] += values
    out = {}
    for path, seen in shapes.items():
        m = len(seen)
        p = [seen.count(x) / m for x in set(seen)]
        presentation = -sum(x * math.log(x, m) for x in p) if m >= 4 else 1.0
        said = texts[path]
        content = None
        if said:
            content = 1 - sum(math.log(said.count(x)) / math.log(m) for x in said) / len(said) if m >= 4 else 1.0
        out[path] = (m, presentation, content, sum(map(len, said)))
    return out


def test_entropies_equal_plain_ones(spark):
    rng = random.Random(2)
    pages = ["<body>" + "".join(f"<div class=c{rng.randint(0, 3)}><p>t{rng.randint(0, 9)}</p>x</div>" * rng.randint(0, 2)
                                for _ in range(4)) + f"<i>{rng.randint(0, 1)}</i></body>" for _ in range(40)]
    df = spark.createDataFrame([(i, "http://a.org/", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    got = {r["path"]: (r["pages"], r["presentation"], r["content"], r["chars"]) for r in siteextract.style_tree(df).collect()}
    want = slow_tree(pages)
    assert got.keys() == want.keys()
    for path, (m, presentation, content, chars) in want.items():
        assert got[path][0] == m and got[path][3] == chars
        assert got[path][1] == pytest.approx(presentation, abs=1e-9)
        assert (got[path][2] is None) == (content is None) and (content is None or got[path][2] == pytest.approx(content))


def test_tree_alone_finds_the_article_of_the_given_pages(spark):
    """Without names, menus, adverts and footers of all hosts fall below their threshold."""
    df = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    low = {r["host"]: r["removed"] for r in siteextract.low_branches(siteextract.style_tree(df)).collect()}
    rows = df.withColumn("host", siteextract.host_of(df.url)).collect()
    for host in {r["host"] for r in rows}:
        assert {"/html/body/nav", "/html/body/div.ad", "/html/body/footer"} <= set(low[host])
    for r in rows[::25]:
        removed = frozenset(low[r["host"]])
        assert siteextract.main_text(r["html"], removed, names=False) == siteextract.main_text(r["html"])


def test_rare_elements_keep_their_containers(spark):
    """Page-specific classes are summed up under their parents and do not make a host's rows grow."""
    page = "<body><div class=m><div class=id-{c}><p>Own text {i} of this page</p></div></div><div class=n>Menu one two</div></body>"
    rows = [(i, "http://a.org/", page.format(i=i, c=chr(97 + i // 26) + chr(97 + i % 26))) for i in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    tree = siteextract.style_tree(df)
    kept = siteextract.frequent_tree(tree)
    assert tree.count() > 100 and sorted(r["path"] for r in kept.collect()) == ["/body", "/body/div.m", "/body/div.n"]
    got = {r["page_id"]: r["text"] for r in siteextract.extract(df).collect()}
    assert got == {i: f"Own text {i} of this page" for i in range(60)}


MAIN = " ".join(f"main{i}" for i in range(60))


@pytest.mark.parametrize("page,want", [
    # text outside of <article> is not lost
    (f"<div><p>{MAIN}</p></div><article>teaser</article>", MAIN + "\nteaser"),
    (f"<main><article>a</article></main><div>{MAIN}</div>", "a\n" + MAIN),
    # a part of a class name is no name
    *[(f"<div class='{c}'><p>{MAIN}</p></div><p>x</p>", MAIN + "\nx") for c in (
        "container no-sidebar", "page has-sidebar", "article-header", "post comments-open")],
    # a wrapper stays with its article, other noise goes
    *[(f"<{w}><article>{MAIN}</article><div class=ad>y</div></{w.split()[0]}><p>x</p>", MAIN + "\nx")
      for w in ("div class=widget", "form", "div role=search", "div class=menu id=sidebar")],
    (f"<div class=widget><div class=search><article>{MAIN}</article></div></div>", MAIN),
    (f"<div class=widget><p>{MAIN}</p></div><p>x</p>", MAIN + "\nx"),
    (f"<p>{MAIN}</p><aside><article>teaser</article></aside><div class=related><article>t</article></div>", MAIN),
    (f"<p>{MAIN}</p><div id=comments>{MAIN} {MAIN}</div>", MAIN),
    *[(f"<p>{MAIN}</p><div class='{c}'>y</div>", MAIN) for c in (
        "nav-menu", "site_footer", "ad ad-0", "sidebar-left", "post-comments", "related-posts", "side-bar")],
])
def test_names_are_evidence(page, want):
    assert siteextract.main_text(page) == want


def test_importance_decides_over_the_whole_page(spark):
    """Text beside an article goes where it repeats and stays where it does not."""
    page = "<div class=x1><p>Same words here</p></div><article>Teaser {i}</article><div class=x2><p>Own text {i}</p></div>"
    df = spark.createDataFrame([(i, "http://a.org/1", page.format(i=i)) for i in range(30)],
                               "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in siteextract.extract(df).collect()}
    assert got[5] == "Teaser 5\nOwn text 5"


def test_extraction_of_given_pages(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    pages = {r["page_id"]: r["html"] for r in df.collect()}
    for r in siteextract.extract(df).collect():
        page = pages[r["page_id"]]
        body = page[page.index("<article>") + 9:].partition("</article>")[0]
        words = siteextract.plain(siteextract.re.sub(r"<[^>]*>", " ", body)).split()
        assert r["text"].split() == words


def test_url_rules(spark):
    urls = ["https://a.example.org/es/1", "http://example.org/en/1x", "http://EXAMPLE.org/en/2", "http://x.com/fr/1",
            "http://x.com/de/9?u=1", "http://xcom/de/1", "http://y.net/de/1", None, "no url", "http://x.com",
            "://z.com/de/#f", "http://y.com/en/1"]
    df = spark.createDataFrame([(i, u, "q") for i, u in enumerate(urls)] + [(4, urls[4], "q")],
                               "page_id long, url string, verdict string")
    rows = urlrules.judge_urls(df).collect()
    got = {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in rows}
    assert len(rows) == 13
    assert got[0] == ("a.example.org", "/es/1", "example.org/es/")
    assert got[1] == ("example.org", "/en/1x", "example.org/en/1")
    assert got[2] == ("example.org", "/en/2", "org/")
    assert got[3] == ("x.com", "/fr/1", "com/fr/") and got[4] == ("x.com", "/de/9", "com/de/")
    assert got[5][2] is None and got[6][2] is None
    assert got[7] == ("", "", None) and got[8] == ("", "", None)
    assert got[9] == ("x.com", "", None) and got[10] == ("z.com", "/de/", "com/de/")
    verdict = {r["page_id"]: r["verdict"] for r in rows}
    assert [verdict[i] for i in (0, 1, 2, 3, 4, 7)] == ["block", "block", "allow", "allow", "block", "allow"]
    assert urlrules.judge_urls(df.limit(0)).count() == 0


def test_url_tokens_of_the_whole_url(spark):
    urls = ["http://a.b.org/x/y1/deep/view.PHP/page-12.html?id=3&utm_source=f;k#z?no=1", "http://b.org/.x/v1.2?", None]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    url = df["url"]
    got = [r[0] for r in df.select(urlrules.url_tokens(
        urlrules.host_of(url), urlrules.path_of(url), urlrules.query_of(url))).collect()]
    assert set(got[0]) == {
        "domain=org", "domain=b.org", "label=a", "label=b", "label=org", "path1=x", "path2=y0", "path3=deep",
        "path4=view.PHP", "path5=page-0.html", "ending=php", "ending=html", "query=id", "query=utm_source", "query=k"}
    assert set(got[1]) == {"domain=org", "domain=b.org", "label=b", "label=org", "path1=.x", "path2=v0.0"}
    assert got[2] == []


@pytest.mark.parametrize("tail", ["a/b/spam/{i}", "a/b{i}.spam", "a/{i}?spam={i}"])
def test_url_rules_beyond_the_second_segment(spark, tail):
    """Only a deeper segment, an ending or a query key tells blocked urls from allowed ones."""
    good = tail.replace("spam", "fine")
    urls = [f"http://{h}.com/{t}".format(i=i) for i in range(40) for h, t in (("bad", tail), ("good", good))]
    asked = ["http://new.net/" + tail.format(i=7), "http://new.net/" + good.format(i=7)]
    df = spark.createDataFrame(list(enumerate(urls + asked)), "page_id long, url string")
    rules = (("block", "bad.com", "/"), ("allow", "good.com", "/"))
    verdict = {r["page_id"]: r["verdict"] for r in urlrules.judge_urls(df, rules=rules).collect()}
    assert verdict[len(urls)] == "block" and verdict[len(urls) + 1] == "allow"


def slow_rules(transactions, support, confidence):
    counts = defaultdict(int)
    for items in transactions:
        for size in range(1, len(items) + 1):
            for part in itertools.combinations(sorted(items), size):
                counts[frozenset(part)] += 1
    block = urlrules.VERDICT_ITEM + urlrules.BLOCK
    found = []
    for items, n in counts.items():
        rest = items - {block}
        if block in items and rest and n >= math.ceil(support * len(transactions)) and n / counts[rest] >= confidence:
            found.append(rest)
    return {r for r in found if not any(o < r for o in found)}


def test_mining_equals_brute_force(spark):
    rng = random.Random(8)
    rows = [sorted({f"t{rng.randint(0, 7)}" for _ in range(5)}) for _ in range(300)]
    rows = [r + [urlrules.VERDICT_ITEM + ("block" if {"t1", "t2"} <= set(r) or "t5" in r and rng.random() < .95
                                          else "allow")] for r in rows]
    # t8 and t9 stand in the same rows as t1 and t5.
    rows = [r + ["t8"] * ("t1" in r) + ["t9"] * ("t5" in r) for r in rows]
    mined = urlrules.mine(spark.createDataFrame([(r,) for r in rows], "items array<string>"), 0.05, 0.9)
    rules, sizes = defaultdict(lambda: defaultdict(set)), {}
    for r in mined.collect():
        rules[r["rule"]][r["item"]].add(r["token"])
        sizes[r["rule"]] = r["items"]
    assert all(len(items) == sizes[rule] for rule, items in rules.items())
    found = {frozenset(c) for items in rules.values() for c in itertools.product(*items.values())}
    assert {r for r in found if not any(o < r for o in found)} == slow_rules(rows, 0.05, 0.9)
    plain = [[x for x in r if not x.startswith(urlrules.VERDICT_ITEM)] for r in rows]
    lists = spark.createDataFrame([(i, -i, r) for i, r in enumerate(plain)], "k1 long, k2 long, tokens array<string>")
    hit = {r["k1"] for r in urlrules.matched(lists, mined).collect()}
    assert hit == {i for i, r in enumerate(plain) if any(rule <= set(r) for rule in found)}


@pytest.mark.parametrize("shapes", [1, 12])
def test_long_paths_are_mined_quickly(spark, shapes):
    """Half of the labelled urls share a path of 30 segments, and some only its first ones."""
    long = [f"s{i}" for i in range(30)]
    urls = [f"http://h{i % 7}.bad.com/{'/'.join(long[:30 - i % shapes])}/p{i}" for i in range(300)]
    urls += [f"http://h{i % 7}.good.com/a/{i}" for i in range(300)]
    asked = ["http://new.net/" + "/".join(long), "http://new.net/a/1", "http://new.net/s0/q"]
    df = spark.createDataFrame(list(enumerate(urls + asked)), "page_id long, url string")
    rules = (("block", "bad.com", "/"), ("allow", "good.com", "/"))
    verdict = {r["page_id"]: r["verdict"] for r in urlrules.judge_urls(df, rules=rules).collect()}
    assert [verdict[600 + i] for i in range(3)] == ["block", "allow", "block"]


def test_shards_bound_each_other(spark):
    """A query passes through every shard once, and far shards send only what is near enough."""
    rng = np.random.default_rng(5)
    vectors = [(int(i), [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(1500, 6)).round(1))]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got = {}
    for r in vptree.search(df, every=50, k=7, shard_rows=100).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    x = np.array([v for _, v in vectors])
    for q in range(0, 1500, 50):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        want = sorted((d[i], i) for i in range(1500) if i != q)[:7]
        assert [(r, v) for r, v, _ in sorted(got[q])] == [(r + 1, i) for r, (_, i) in enumerate(want)]
        assert np.allclose([s for *_, s in sorted(got[q])], [w for w, _ in want], rtol=0, atol=1e-12)
    tree = vptree.Tree(x)
    near = tree.nearest(np.arange(1500), x[0], 0, 7, 1.0)
    assert tree.nearest(np.arange(1500), x[0], 0, 7, 1.0, near[2][0]) == [n for n in near if n[0] <= near[2][0]]
