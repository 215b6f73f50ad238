"""The operators on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, and against brute force."""

import hashlib
import re
import textwrap
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from screenguard.llm import ann, components, htmltext, langid, licenses, mixing, phrases, pieces, sharding, simhash, toxicity
from screenguard.llm.common import remainder

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, id int, size string, fp string, row string"
ODD = [None, "", " \t\n", "a", "word " * 40_000, "x" * 100_000, "ünï — “çödé” 日本語 😀", "same text here", "same text here"]


def docs(spark, texts, ids=None, lang="en", source=None):
    ids = ids or range(len(texts))
    rows = [(i, t, lang, source(k) if callable(source) else source, None, 0.5, 1, "x", "y", "z") for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, DOCS)


def odd(spark):
    """All the awkward texts, a row twice, and a null id."""
    return docs(spark, [*ODD, "again", "again", "no id"], [*range(len(ODD)), 50, 50, None], source="s")


def empty(spark):
    return spark.createDataFrame([], DOCS)


# ---- op1 ------------------------------------------------------------------------------


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, score double, rank int")


def test_nearest_equals_brute_force(spark):
    x = np.random.default_rng(0).standard_normal((600, 24)).astype(np.float32)
    x[50:60] = x[40]
    v = vectors(spark, [(i, r.tolist(), 0, 0.0, 0) for i, r in enumerate(x)])
    got = {}
    for r in ann.nearest(v, v.where("vec_id % 20 = 0"), 20, block=128).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    y, same = x.astype(float), 0
    for q in range(0, 600, 20):
        s = y @ y[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(600), -np.round(s, 9)))[:20]
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, 21))
        same += len(set(want) & {m[1] for m in mine})
        assert all(abs(m[2] - s[m[1]]) < 1e-9 for m in mine)
    assert same / 600 >= 0.99
    ties = [m[1] for m in sorted(got[40])[:10]]
    assert ties == list(range(50, 60))


def test_nearest_leaves_out_bad_vectors(spark):
    v = vectors(spark, [(0, [1.0, 0.0], 0, 0.0, 0), (1, None, 0, 0.0, 0), (2, [0.0, 0.0], 0, 0.0, 0), (3, [float("nan"), 1.0], 0, 0.0, 0), (4, [1.0, None], 0, 0.0, 0), (5, [2.0, 0.0], 0, 0.0, 0), (6, [1.0], 0, 0.0, 0), (None, [1.0, 1.0], 0, 0.0, 0), (7, [float("inf"), 0.0], 0, 0.0, 0)])
    assert [tuple(r) for r in ann.nearest(v, v.where("vec_id % 20 = 0")).collect()] == [(0, 1, 5, 2.0)]
    none = vectors(spark, [])
    assert ann.nearest(none, none).count() == 0


def test_error_bounds_hold():
    rng = np.random.default_rng(1)
    x, q = rng.standard_normal((2000, 64)), rng.standard_normal((20, 64))
    rot = ann.rotation(64)
    block = ann.Block(np.arange(2000), x, *ann.encode(x, rot), rot)
    est, bound = block.estimate(q)
    assert (np.abs(est - q @ x.T) <= bound).mean() > 0.995 and np.allclose(rot @ rot.T, np.eye(64))
    # the same from unpacked signs: only the query's rounding differs
    signs = np.where((x / np.linalg.norm(x, axis=1)[:, None]) @ rot > 0, 1.0, -1.0)
    assert np.abs(est - (q @ rot) @ signs.T * block.scale).max() < 0.05 * np.abs(est).max()


@pytest.mark.parametrize("dim", [3, 64, 100])
def test_codes_of_any_length(dim):
    rng = np.random.default_rng(3)
    x, q = rng.standard_normal((500, dim)), rng.standard_normal((5, dim))
    block = ann.Block(np.arange(500), x, *ann.encode(x, ann.rotation(dim)), ann.rotation(dim))
    for who, at, score in ann.search_block(block, np.arange(1000, 1005), q, 10):
        for i in range(5):
            want = np.argsort(-(x @ q[i]))[:10]
            assert len(set(at[who == 1000 + i]) & set(want)) >= 9


def test_repeated_query_ids(spark):
    v = vectors(spark, [(0, [1.0, 0.0], 0, 0.0, 0), (0, [0.0, 1.0], 0, 0.0, 0), (3, [2.0, 1.0], 0, 0.0, 0), (3, [2.0, 1.0], 0, 0.0, 0), (4, [1.0, 3.0], 0, 0.0, 0)])
    got = sorted(map(tuple, ann.nearest(v, v.where("vec_id = 0")).collect()))
    assert got == [(0, 1, 4, 3.0), (0, 2, 3, 1.0), (0, 3, 3, 1.0)]


# ---- op2 ------------------------------------------------------------------------------


def test_mix_near_targets(spark):
    rng = np.random.default_rng(2)
    texts = ["w " * int(n) for n in rng.integers(0, 60, 400)]
    d = docs(spark, texts, source=lambda k: None if k % 10 == 0 else f"s{k % 3 if k % 2 else 0}")
    a, b = (sorted(map(tuple, mixing.mix(d, ranges=16).collect()), key=repr) for _ in range(2))
    assert a == b and len(a) == 400
    rows = mixing.mix(d, ranges=16).collect()
    by = {}
    for r in rows:
        assert r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
        by.setdefault(r["source"], []).append(r)
    for part in by.values():
        assert abs(sum(r["taken"] for r in part) - part[0]["target"]) <= 30
        assert part[0]["target"] <= 2 * part[0]["source_size"] + 1e-6
    assert sum(p[0]["target"] for p in by.values()) == pytest.approx(1.5 * sum(r["size"] for r in rows))
    copied = mixing.mixed_rows(d, ranges=16)
    assert copied.columns == d.columns and copied.count() == sum(r["copies"] for r in rows)


def test_pareto_sampling_is_unequal(spark):
    """Over seeds, documents are drawn about as often as their inclusion probabilities say, larger ones more often."""
    rng = np.random.default_rng(14)
    sizes = rng.integers(1, 400, 120)
    d = docs(spark, ["w " * int(n) for n in sizes], source=lambda k: "a" if k < 100 else "b")
    times, p = np.zeros(120), None
    for seed in range(15):
        rows = sorted(mixing.mix(d, weights=(2, 1), share=0.4, seed=seed, ranges=8).collect())
        times += [r["copies"] for r in rows]
        p = np.array([r["p"] for r in rows])
        for name, part in (("a", rows[:100]), ("b", rows[100:])):
            assert abs(sum(r["taken"] for r in part) - part[0]["target"]) < 400, name
            assert sum(r["p"] * r["size"] for r in part) == pytest.approx(part[0]["target"])
    assert 0 < p.min() < 0.5 * p.max() and np.corrcoef(times / 15, p)[0, 1] > 0.75
    assert abs((times / 15 - p).mean()) < 0.05 and np.abs(times / 15 - p).max() < 0.55


def test_targets_fill_up(spark):
    d = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 500), (None, 4)], "source string, size bigint")
    got = {r["source"]: r["target"] for r in mixing.source_targets(d).collect()}
    assert got["a"] == 20 and got[None] == 8 and sum(got.values()) == pytest.approx(1.5 * 1514)
    assert got["c"] == 1000 and got["b"] == pytest.approx(2271 - 1028)  # what c can't take goes on to b


def test_mix_odd_rows(spark):
    assert mixing.mix(odd(spark)).count() == 12 and mixing.mix(empty(spark)).count() == 0
    assert mixing.mixed_rows(empty(spark)).count() == 0
    plan = mixing.mix(odd(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    sizes = {r["doc_id"]: r["size"] for r in mixing.mix(odd(spark)).collect()}
    assert sizes[0] == sizes[1] == sizes[2] == 0 and sizes[4] == 40_000 and sizes[5] == 1


# ---- op3 ------------------------------------------------------------------------------


def test_shards_fit(spark):
    d = docs(spark, ["t" * (i % 900) for i in range(3000)]).select("doc_id", "text")
    got = sharding.shard(d, F.octet_length("text"), limit=20_000).collect()
    assert len(got) == 3000 and max(r["shard_bytes"] for r in got) <= 20_000
    names = {r["shard"]: r["depth"] for r in got}
    assert all(len(n) == k for n, k in names.items())
    assert not any(a != b and b.startswith(a) for a in names for b in names)
    total = {}
    for r in got:
        total[r["shard"]] = total.get(r["shard"], 0) + r["bytes"]
    assert all(total[r["shard"]] == r["shard_bytes"] for r in got)
    for n in names:  # only buckets that were too large split
        if n:
            assert sum(b for m, b in total.items() if m.startswith(n[:-1])) > 20_000


def test_shards_with_clashing_names(spark):
    d = spark.createDataFrame([(i, "t" * (i % 900), "a", "b", 7, "c", "d", "e") for i in range(3000)], "doc_id bigint, text string, bits string, prefix string, bytes int, shard string, __shard_bits string, total string")
    got = sharding.shard(d, F.octet_length("text"), limit=20_000)
    assert got.columns == ["doc_id", "text", "bits", "prefix", "__shard_bits", "total", "shard", "depth", "bytes", "shard_bytes"]
    rows = got.collect()
    assert len(rows) == 3000 and max(r["shard_bytes"] for r in rows) <= 20_000 and all((r["bits"], r["prefix"], r["total"], r["bytes"]) == ("a", "b", "e", len(r["text"])) for r in rows)
    assert sharding.shard(odd(spark), F.octet_length("text"), limit=50_000).count() == 12


def test_shards_of_one_key(spark):
    rows = [(7, "a" * 100)] * 300 + [(8, "b" * 5000)] + [(None, None)] * 5
    got = sharding.shard(spark.createDataFrame(rows, "doc_id bigint, text string"), F.octet_length("text"), limit=1000).collect()
    assert len(got) == 306
    for r in got:
        assert r["shard_bytes"] <= 1000 or r["shard_bytes"] == 5000 == r["bytes"]
    assert sharding.shard(empty(spark).select("doc_id", "text"), F.octet_length("text")).count() == 0


# ---- op4, op5 -------------------------------------------------------------------------


def made_up(spark, n=500):
    rng = np.random.default_rng(4)
    syl = {"aa": "ka la ma na pa ra".split(), "bb": "zin zor zul zek zap zid".split()}
    rows = []
    for i in range(n):
        lang = "ab"[i % 2] * 2
        words = ["".join(rng.choice(syl[lang], 3)) for _ in range(60)]
        toxic = int(rng.random() < 0.3)
        if toxic:
            words[10] = rng.choice(["jerk", "grumbla", "grumble", "grumblix"])
        rows.append((i, " ".join(words), lang, "s", toxic))
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, toxic int")


def test_language(spark):
    d = made_up(spark)
    model = langid.fit(d, remainder("id", 3) != 1)
    got = {r["id"]: r for r in langid.identify(d, model).collect()}
    lang = {r["doc_id"]: r["lang"] for r in d.collect()}
    held = [i for i in lang if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([got[i]["lang_pred"] == lang[i] for i in held]) > 0.98
    assert np.mean([got[i]["rejected"] for i in held]) < 0.05
    bad = {r["id"]: r for r in langid.identify(docs(spark, [None, "", "12 34 !?", "kalama"]), model).collect()}
    assert [bad[i]["lang_pred"] for i in range(4)] == ["und"] * 3 + ["aa"] and [bad[i]["score"] for i in range(3)] == [0, 0, 0]
    assert langid.identify(odd(spark), model).count() == 12
    kept = langid.keep_identified(odd(spark), model)
    assert kept.columns == odd(spark).columns and kept.where("text is null").count() == 0
    assert langid.fit(empty(spark), F.lit(True)) is None and langid.identify(odd(spark), None).where("lang_pred = 'und'").count() == 12
    assert langid.identify(empty(spark), model).count() == 0
    long = langid.identify(docs(spark, ["kalama " * 30_000]), model).first()
    assert long["lang_pred"] == "aa"


def test_subwords_of_a_text_alone_and_among_others():
    texts = ["one two", "", "Three, FOUR", "12", "é"]
    grams, letter = langid.subwords(texts)
    for i, t in enumerate(texts):
        alone, one = langid.subwords([t])
        assert all((h[e[i] : e[i + 1]] == a).all() for (h, e), (a, _) in zip(grams, alone, strict=True)) and letter[i] == one[0]


def test_toxicity(spark):
    d = made_up(spark, 900)
    labels = d.select("doc_id", "toxic")
    model = toxicity.fit(d.drop("toxic"), labels, remainder("id", 5) != 0)
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    got = {r["id"]: r for r in toxicity.score(d, model).collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i]["predicted"] == truth[i] for i in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got.values())
    assert toxicity.score(docs(spark, ["kalama grumblod nalama"]), model).first()["predicted"] == 1
    assert toxicity.score(odd(spark), model).where("score between 0 and 1").count() == 12
    assert toxicity.fit(d, labels.where("toxic = 0"), F.lit(True)) is None and toxicity.score(odd(spark), None).count() == 12
    assert toxicity.score(empty(spark), model).count() == 0 and toxicity.keep_clean(odd(spark), model).columns == odd(spark).columns


def test_language_brute_force():
    """A text's mean table row, n-gram by n-gram."""
    rng = np.random.default_rng(15)
    table = rng.standard_normal((256, 3)).astype(np.float32)
    for text in ("Ab cd", "é", "one two three", "12", "", "a1b"):
        rows = []
        low = text.lower()
        for n in langid.GRAMS:
            for i in range(-1, len(low) - n + 2):
                gram = [(ord(low[j]) if 0 <= j < len(low) and low[j].isalpha() else 0) for j in range(i, i + n)]
                # letters throughout, but for a space before the first or after the last
                if all(gram[1:-1]) and (gram[0] or gram[-1]):
                    h = n
                    for c in gram:
                        m = c * 2654435761 % (1 << 32)
                        h = (h ^ m ^ (m >> 15)) * 16777619 % (1 << 32)
                    rows.append(table[(h ^ (h >> 16)) & 255])
        mean, _ = langid._per_text(table, [text])
        assert np.allclose(mean[0], np.mean(rows, 0) if rows else 0, atol=1e-6), text


def test_no_model_keeps_all(spark):
    assert langid.keep_identified(odd(spark), None).count() == 12 and toxicity.keep_clean(odd(spark), None).count() == 12


def test_language_of_few_rows(spark):
    for n in (1, 2, 6):
        model = langid.fit(made_up(spark, n), F.lit(True))
        assert langid.identify(odd(spark), model).where("score between 0 and 1").count() == 12


def test_later_copies():
    y = np.array([0, 0, 1, 0, 1, 0])
    keys = [[1, 2, 3], [1, 2, 9], [1, 2, 3], [1, 8, 7], [1, 2, 4], [5, 6, 3]]
    assert toxicity.later_copies([10, 11, 12, 13, 14, 15], y, keys) == [11, 14]
    assert toxicity.later_copies([], np.array([]), []) == []


def test_features_by_hand():
    lex = toxicity.Lexicon({"jerk": 1, "silly": 2}, {"grumb": 1})
    x = dict(zip(toxicity.FEATURES, toxicity.Analyser(lex).features("You JERK! a silly grumbler and j3rk, hmmm ok"), strict=True))
    assert x["strong"] == pytest.approx(2 / 9) and x["weak"] == pytest.approx(1 / 9) and x["strong count"] == 2 and x["hidden"] == pytest.approx(1 / 9)
    assert x["you"] == pytest.approx(1 / 9) and x["near you"] == pytest.approx(2 / 3) and x["shouted"] == pytest.approx(1 / 9) and x["repeated"] == pytest.approx(1 / 9)
    assert x["bangs"] == pytest.approx(1 / 9) and x["broken"] == pytest.approx(1 / 9) and x["capitals"] == pytest.approx(5 / 33)


def test_trees_by_hand():
    """One split: the leaf values are those of the logistic loss's Newton step."""
    x, y = np.array([[0.0], [0.0], [1.0], [1.0]]), np.array([0.0, 0, 1, 1])
    got = toxicity.Boosted(trees=1, depth=1).fit(x, y).raw(np.array([[0.0], [1.0]]))
    assert np.allclose(got, [-0.2 * 1 / 1.5, 0.2 * 1 / 1.5])


def test_isotonic():
    at, value = toxicity.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 1, 0, 1]), np.ones(4))
    assert value.tolist() == [0, 0, 0.5, 0.5, 1, 1] and at.tolist() == [1, 1, 2, 3, 4, 4]


# ---- op6 ------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><div id="cookie-notice"><p>We use cookies, yes, many, many of them, here.</p></div>
<nav><ul><li><a href=x>Home</a></ul></nav><div class="page"><div class="content"><h1>Ti&amp;tle</h1><p>First,&nbsp; para
 graph <b>bold<p>Second <a href=y>link</a> &#65;&eacute;.<br>more<ul><li>one<li>two</ul></div><aside>side</aside><div class="comments-list"><p>I like it, a lot, really, very, very, very much.</div></div>
<form>mail</form><script>var a="<p>no</p>";</script><footer>&copy; me</footer></body></html>"""


def test_main_text():
    assert htmltext.main_text(PAGE) == "Ti&tle\nFirst, para graph bold\nSecond link Aé. more\none\ntwo"
    for x in (None, "", "<", "<p", '<a "', "<!-- x", "<script>", "</p>", "&", "<a href='" * 500):
        assert htmltext.main_text(x) in ("", "<", "&")
    assert htmltext.main_text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    assert htmltext.main_text("plain text") == "plain text"


THREE = "<p>One long paragraph, with commas, and more, that says a lot of things about it all, over and over.</p>" * 3
KEPT = "\n".join(["One long paragraph, with commas, and more, that says a lot of things about it all, over and over."] * 3)


@pytest.mark.parametrize("attr", ['class="layout has-sidebar"', 'class="post with-comments"', 'id="notice-board-article"', 'class="widget"', 'class="no-ads"', 'id="main-content"'])
def test_a_name_doesnt_outvote_the_text(attr):
    furniture = '<div class="cookie-notice"><p>We use cookies, many of them.</p></div><div class="comments"><p>First, I say, first!</p></div>'
    assert htmltext.main_text(f"<body>{furniture}<div {attr}>{THREE}</div></body>") == KEPT


def test_all_of_an_article_is_kept():
    inner = '<p class="dialog">Said A.</p><label>A label.</label><ul><li><a href=a>Link one</a><li><a href=b>Link two</a></ul>'
    assert htmltext.main_text(f"<article>{THREE}{inner}</article>") == KEPT + "\nSaid A.\nA label.\nLink one\nLink two"
    for tag in ("div", "section"):
        assert htmltext.main_text(f"<div><{tag}>{THREE}</{tag}><{tag}><p>The end.</p></{tag}></div>") == KEPT + "\nThe end."
    long_comments = '<div class="comments">' + "<p>What a page, I say, what a page, indeed, really, it is.</p>" * 20 + "</div>"
    assert htmltext.main_text(f"<body><article>{THREE}</article>{long_comments}</body>") == htmltext.main_text(f"<article>{THREE}{long_comments}</article>") == KEPT


def test_main_text_against_a_plain_walker():
    """Pages put together from known parts: an independent parser collects the article's blocks."""
    import html
    from html.parser import HTMLParser

    class Walker(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.depth, self.blocks = 0, []

        def handle_starttag(self, tag, attrs):
            if ("data-keep", "1") in attrs:
                self.depth = 1
            elif self.depth and tag in ("p", "h2", "li", "div"):
                self.blocks.append("")

        def handle_endtag(self, tag):
            if tag == "article" or tag == "main":
                self.depth = 0

        def handle_data(self, data):
            if self.depth and self.blocks:
                self.blocks[-1] += data

    rng = np.random.default_rng(16)
    word = lambda: "".join(rng.choice(list("abcdefgé&<"), rng.integers(1, 9)))
    words = lambda n: html.escape(", ".join(word() for _ in range(n)))
    for _ in range(60):
        body = "".join(rng.choice([f"<p>{words(20)}</p>", f"<h2>{words(3)}</h2>", f"<ul><li>{words(8)}</li><li>{words(9)}</li></ul>", f"<p>{words(5)} <b>{words(2)}</b>\n {words(4)}</p>", f"<div><p>{words(30)}</p></div>"]) for _ in range(rng.integers(2, 9)))
        tag = rng.choice(["article", "main"])
        rest = [f"<nav><a href=x>{words(3)}</a></nav>", f"<div class='sidebar'><p>{words(12)}</p></div>", f"<footer>{words(6)}</footer>", f"<div id=comments><p>{words(40)}</p></div>", "<script>if (a < b) { '</p>' }</script>", f"<form><p>{words(9)}</p></form>"]
        rng.shuffle(rest)
        page = f"<html><body>{''.join(rest[:3])}<{tag} data-keep=1>{body}</{tag}>{''.join(rest[3:])}</body></html>"
        walker = Walker()
        walker.feed(page.replace("<script>if (a < b) { '</p>' }</script>", ""))
        assert htmltext.main_text(page) == "\n".join(t for t in (" ".join(b.split()) for b in walker.blocks) if t), page


def test_extract(spark):
    rows = [(1, "u", PAGE, "clash"), (1, "u", PAGE, "clash"), (2, None, None, "x"), (3, "v", "", None), (4, "v", "<p>" + "long " * 50_000, None)]
    got = htmltext.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string, text string"))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    got = got.collect()
    assert len(got) == 5 and {r["page_id"]: r["n_chars"] for r in got} == {1: len(htmltext.main_text(PAGE)), 2: 0, 3: 0, 4: 249_999}
    assert htmltext.extract(spark.createDataFrame([], "page_id bigint, html string")).count() == 0


# ---- op7 ------------------------------------------------------------------------------


def test_licenses(spark):
    found = {n: t for n, ts in licenses.TEMPLATES.items() for t in ts}
    for name, ts in licenses.TEMPLATES.items():
        for t in ts:
            got = licenses.scan_text("Some words before.\n" + t.replace("{}", "2024 A. Nobody") + "\nand after, with a licence to speak.")
            assert [g["license"] for g in got] == [name], t
            assert not got[0]["missing"] and not got[0]["added"] and got[0]["reduction"] > 0 and got[0]["start"] == 19
    assert found and licenses.scan_text("permission to land was given, without warranty") == []
    near = licenses.scan_text("Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.")
    assert near[0]["license"] == "ISC" and near[0]["missing"] == ["or"]
    assert licenses.scan_text("Licensed under CC BY 4.0.")[0]["license"] == "CC-BY-4.0" and licenses.scan_text("Licensed under CC BY-NC 4.0.")[0]["license"] == "CC-BY-NC-4.0"
    assert licenses.scan_text("word " * 20_000 + "Released under the MIT License. " + "word " * 20_000)[0]["license"] == "MIT"
    assert licenses.scan(odd(spark)).where("size(notices) = 0").count() == 12 and licenses.scan(empty(spark)).count() == 0


def test_licenses_are_told_apart():
    found = lambda text: [n["license"] for n in licenses.scan_text(text)]
    gpl = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
    assert found(gpl.format("Affero General Public", 3)) == ["AGPL-3.0"] and found(gpl.format("General Public", 3)) == ["GPL-3.0"]
    assert found(gpl.format("Affero General Public", 7)) == []
    assert found("MIT. Released under the MIT License. Licensed under the Apache License, Version 2.0.") == ["MIT", "Apache-2.0"]
    assert found("# SPDX-License-Identifier: MIT") == ["MIT"] and found("// SPDX-License-Identifier: GPL-3.0-or-later") == ["GPL-3.0"]
    assert found("This is not released under the MIT License.") == [] and found("It isn't licensed under CC BY 4.0.") == []
    two, three = licenses.TEMPLATES["BSD-2-Clause"][1], licenses.TEMPLATES["BSD-3-Clause"][2]
    assert found(two) == ["BSD-2-Clause"] and found(three) == ["BSD-3-Clause"] and found(licenses.TEMPLATES["BSD"][0]) == ["BSD"]


def test_the_greatest_reduction_wins():
    # an exact but shorter template inside a longer one that is short of a word
    for name, k in (("BSD-2-Clause", 1), ("BSD-3-Clause", 2), ("MIT", 3)):
        text = licenses.TEMPLATES[name][k]
        got = licenses.scan_text("Some words before. " + text.replace(" PURPOSE", "", 1) + " And after.")
        assert [(g["license"], g["missing"], g["start"]) for g in got] == [(name, ["purpose"], 19)] and got[0]["end"] > len(text)
    # of two templates that fit one block, the one that saves more bytes
    rank = lambda text, i: licenses.judge(" ".join(w.lower() for w in licenses._TOKEN.findall(text)), i)[2]
    at = {(n, t): i for i, (n, t, _, _) in enumerate(licenses._templates())}
    whole, opening = licenses.TEMPLATES["BSD-2-Clause"][1], licenses.TEMPLATES["BSD"][0]
    assert rank(whole, at["BSD-2-Clause", whole])[0] > rank(whole, at["BSD", opening])[0] > 0


def test_the_compression_of_a_block_loses_no_notice():
    """Every template with words left out or put in, among other words: whatever its wording confirms also saves bytes."""
    rng = np.random.default_rng(4)
    for i, (_, _, template, _) in enumerate(licenses._templates()):
        for _ in range(20):
            words = [w if w != "{}" else "2024 nobody" for w in template]
            for _ in range(int(rng.integers(0, 1 + len(words) // 10))):
                at = int(rng.integers(len(words)))
                words[at : at + 1] = [[], [words[at], "other"]][int(rng.integers(2))]
            block = " ".join([*rng.choice(["some", "text", "before", "license", "copyright"], rng.integers(0, 6)), *words, *rng.choice(["and", "after", "warranty"], rng.integers(0, 6))])
            equal, _, added = licenses.differences(block.split(), template)
            if equal >= licenses.EQUAL and len(added) <= licenses._extra(template):
                assert licenses.saved(block, i)[0] > 0, block


def test_spans_against_all_windows():
    """Every stretch of words of a text against every template, by edit operations alone."""
    from difflib import SequenceMatcher

    rng = np.random.default_rng(18)
    plain = "the word of one and all that stands in any text about license copyright permission software terms".split()
    short = {n: [t for t in ts if len(t.split()) < 12 and "{}" not in t] for n, ts in licenses.TEMPLATES.items()}
    short = [(n, t) for n, ts in short.items() for t in ts]
    for k in range(40):
        parts, want = [], []
        for _ in range(4):
            parts.append(" ".join(rng.choice(plain, rng.integers(3, 25))))
            n, t = short[rng.integers(len(short))]
            parts.append(t)
            want.append(n)
        text = " ".join([*parts, "and so on"])
        words = [w.lower() for w in licenses._TOKEN.findall(text)]
        slow = set()
        for n, t in short:
            tw = [w.lower() for w in licenses._TOKEN.findall(t)]
            for i in range(len(words) - len(tw) + 1):
                if SequenceMatcher(None, tw, words[i : i + len(tw)], autojunk=False).ratio() == 1:
                    slow.add((n, i))
        got = licenses.scan_text(text)
        assert {g["license"] for g in got} <= {n for n, _ in slow} and [g["license"] for g in got if not g["missing"]] == want, text


def test_licenses_over_several_lines():
    for name, ts in licenses.TEMPLATES.items():
        for t in ts:
            t = t.replace("{}", "2024 A. Nobody")
            for sign in ("", "# ", " * ", "// "):
                body = "\n".join(sign + line for line in textwrap.wrap(t, 70))
                got = licenses.scan_text(f"import this\n\n{body}\n\ndef f(): pass\n")
                assert [g["license"] for g in got] == [name] and not got[0]["missing"] and not got[0]["added"], (t, sign)
                assert got[0]["start"] == 13 + len(sign)
            narrow = licenses.scan_text("\n".join(t.split()))
            assert [g["license"] for g in narrow] == [name] and not narrow[0]["missing"]


def test_licenses_in_long_lines():
    for name, ts in licenses.TEMPLATES.items():
        for t in ts:
            t = t.replace("{}", "2024 A. Nobody")
            got = licenses.scan_text("word " * 10_000 + t + " word" * 10_000)
            assert [g["license"] for g in got] == [name] and not got[0]["missing"] and got[0]["start"] == 50_000, t
    mit, isc = licenses.TEMPLATES["MIT"][1], licenses.TEMPLATES["ISC"][0]
    for between in (" ", " and also ", " word" * 3000 + " "):
        assert [g["license"] for g in licenses.scan_text(mit + between + isc + between + mit)] == ["MIT", "ISC", "MIT"]
        assert [g["license"] for g in licenses.scan_text(between.join([isc] * 3))] == ["ISC"] * 3


# ---- op8 ------------------------------------------------------------------------------


def slow_fingerprint(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    sh = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << i for i in range(64) if 2 * sum(x >> i & 1 for x in h) > len(h))


def test_fingerprints(spark):
    d = odd(spark)
    want = {r["doc_id"]: slow_fingerprint(r["text"], 3) for r in d.collect()}
    got = simhash.fingerprints(d).select("id", simhash.hex16(F.col("fp")).alias("f")).collect()
    assert len(got) == 12 and all(int(r["f"], 16) == want[r["id"]] and len(r["f"]) == 16 for r in got)
    h = spark.createDataFrame([("a b c",)], "t string").select(F.xxhash64("t")).first()[0]
    assert h % (1 << 64) == simhash.shingle_hashes("A b  c", 3)[0]


def naive_groups(fps, limit):
    left, out = list(range(len(fps))), list(range(len(fps)))
    for i in left:
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= limit:
                a, b = sorted((out[i], out[j]))
                out = [a if x == b else x for x in out]
    return out


def test_links_give_the_components_of_all_pairs(spark):
    rng = np.random.default_rng(8)
    fps = [int(x) for x in rng.integers(0, 1 << 63, 150)]
    for _ in range(350):
        fps.append(fps[rng.integers(len(fps))] ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))))
    fps = sorted(set(fps) | {0, 1, 3, (1 << 64) - 1})
    want = naive_groups(fps, 2)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    for part_rows in (16, 16_384):
        links = simhash.hamming_links(spark.createDataFrame([(x,) for x in signed], "fp long"), 2, part_rows)
        root = dict(zip(signed, signed, strict=True)) | {r["node"]: r["component"] for r in components.connected_components(links).collect()}
        groups = {}
        for s, w in zip(signed, want, strict=True):
            assert groups.setdefault(root[s], w) == w
        assert len(groups) == len(set(want))


def test_components(spark):
    e = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (7, 7), (None, 3), (200, 300)]
    got = dict(map(tuple, components.connected_components(spark.createDataFrame(e, "u long, v long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, 200: 200, 300: 200}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_groups(spark):
    got = {}
    for r in simhash.simhash_groups(odd(spark)).collect():
        got.setdefault(r["id"], []).append(r["component"])
    assert got[0] == got[1] == got[2] == [0] and got[7] == got[8] == [7] and got[50] == [50, 50]
    assert simhash.simhash_groups(empty(spark)).count() == 0


def test_near_duplicates(spark):
    rng = np.random.default_rng(9)
    vocab = [f"w{i}" for i in range(500)]
    base = [list(rng.choice(vocab, 200)) for _ in range(20)]
    texts, group = [], []
    for g, words in enumerate(base):
        for k in range(4):
            w = words[:]
            if k > 1:
                w[int(rng.integers(200))] = "changed"
            texts.append(" ".join(w))
            group.append(g)
    shared = " ".join(base[0][:60])
    texts.append(shared + " " + " ".join(rng.choice(vocab, 200)))
    group.append(20)
    d = docs(spark, [*texts, texts[5], None, ""], [*range(len(texts)), 5, 900, 901])
    kept = simhash.deduplicate(d)
    assert kept.columns == d.columns
    ids = sorted(r["doc_id"] for r in kept.collect())
    assert ids == [4 * g for g in range(20)] + [80, 900]
    assert simhash.deduplicate(empty(spark)).count() == 0


def spread_copies(n, words=1500, seed=11):
    """A base and ``n`` copies, each like the base by about 0.82 and like each other by about 0.68."""
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in rng.integers(0, 5000, words)]
    texts = []
    for k in range(n):
        w = base[:]
        for i in rng.choice(words // 5, words // 50, replace=False):
            w[5 * i + 2] = f"c{k}x{i}"
        texts.append(" ".join(w))
    return [*texts, " ".join(base)]


def test_copies_that_are_only_like_their_base(spark):
    texts = spread_copies(300)
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    ratio = [len(x & sets[-1]) / len(x | sets[-1]) for x in sets[:-1]]
    assert 0.8 <= min(ratio) and max(ratio) < 0.84
    assert max(len(sets[0] & x) / len(sets[0] | x) for x in sets[1:-1]) < 0.75
    assert simhash.deduplicate(docs(spark, texts)).count() <= 30


def test_copies_of_which_one_repeats_a_line(spark):
    words = spread_copies(0, 400)[0]
    line = "this line stands on every page of the book"
    texts = [f"{words} {line}", f"{words} {' '.join([line] * 400)}"]
    h = [simhash.shingle_hashes(t, 5) for t in texts]
    assert len(set(h[0]) & set(h[1])) / len(set(h[0]) | set(h[1])) > 0.9 and (simhash.majority_bits(h[0]) ^ simhash.majority_bits(h[1])).bit_count() >= 20
    assert [r["doc_id"] for r in simhash.deduplicate(docs(spark, texts)).collect()] == [0]


def test_links_of_a_cell_are_those_of_all_pairs():
    texts = [*spread_copies(60, 300), *spread_copies(5, 300, 12), *spread_copies(0, 300, 13), *spread_copies(0, 300, 14)]
    rows = np.stack([np.frombuffer(simhash.sketch(simhash.shingle_hashes(t, 5)), np.uint8) for t in texts])
    u, v = simhash.linked(rows, 0.8)
    least = simhash.ALIKE + 0.8 * (1 - simhash.ALIKE)
    want = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            some = (rows[a] | rows[b]) != 0
            if ((rows[a] == rows[b]) & some).sum() >= least * some.sum():
                want = [want[b] if x == want[a] else x for x in want]
    got = list(range(len(rows)))
    for a, b in zip(u.tolist(), v.tolist(), strict=True):
        assert got[a] != got[b]
        got = [got[b] if x == got[a] else x for x in got]
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want)) < 30


def test_near_pairs_are_all_pairs_within_the_limit():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 40, np.uint64)
    fp = np.concatenate([base, *(base ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for _ in range(8)), base[:3]])
    for limit in (0, 2, simhash.reach(0.8)):
        got = [p for a, b in simhash.near_pairs(fp, limit) for p in zip(a.tolist(), b.tolist(), strict=True)]
        apart = np.bitwise_count(fp[:, None] ^ fp[None, :])
        assert sorted(got) == [(a, b) for a in range(len(fp)) for b in range(a + 1, len(fp)) if apart[a, b] <= limit]


def test_links_of_a_cell_come_through_the_fingerprints(monkeypatch):
    texts = [*spread_copies(60, 300), *spread_copies(5, 300, 12), *spread_copies(0, 300, 13), *spread_copies(0, 300, 14)]
    h = [np.unique(simhash.shingle_hashes(t, 5)) for t in texts]
    rows = np.stack([np.frombuffer(simhash.sketch(x), np.uint8) for x in h])
    fp = np.array([simhash.majority_bits(x) for x in h], np.uint64)

    def groups(u, v):
        out = list(range(len(rows)))
        for a, b in zip(u.tolist(), v.tolist(), strict=True):
            assert out[a] != out[b]
            out = [out[b] if x == out[a] else x for x in out]
        return {frozenset(i for i, y in enumerate(out) if y == x) for x in out}

    want, asked = groups(*simhash.linked(rows, 0.8)), []
    plain = simhash.near_pairs
    monkeypatch.setattr(simhash, "near_pairs", lambda fp, limit: asked.extend(plain(fp, limit)) or asked)
    assert groups(*simhash.linked(rows, 0.8, fp)) == want and sum(len(a) for a, _ in asked) >= len(rows) - len(want)
    # nothing is lost where the index gives nothing
    monkeypatch.setattr(simhash, "near_pairs", lambda fp, limit: ())
    assert groups(*simhash.linked(rows, 0.8, fp)) == want


def test_the_index_finds_copies_that_share_no_key(spark, monkeypatch):
    monkeypatch.setattr(simhash, "band_keys", lambda h: [int(h.sum() >> np.uint64(1))])
    words = [spread_copies(0, 2000, seed)[0].split() for seed in range(6)]
    texts = [" ".join(w) for w in words] + [" ".join([*w[:1000], "other", *w[1001:]]) for w in words]
    fp = [simhash.majority_bits(np.unique(simhash.shingle_hashes(t, 5))) for t in texts]
    near = [i for i in range(6) if (fp[i] ^ fp[i + 6]).bit_count() <= simhash.BITS]
    kept = {r["doc_id"] for r in simhash.deduplicate(docs(spark, texts)).collect()}
    assert len(near) >= 3 and kept == set(range(12)) - {i + 6 for i in near}


def borderline(n_groups=60, words=220, seed=21):
    """Texts in chains around a similarity of 0.8: groups of a base and four copies with more and more words changed."""
    rng = np.random.default_rng(seed)
    texts = []
    for g in range(n_groups):
        base = [f"w{i}" for i in rng.integers(0, 4000, words)]
        texts.append(" ".join(base))
        for k in range(4):
            w = base[:]
            for i in rng.choice(words, 2 + 2 * k, replace=False):
                w[i] = f"c{g}x{k}x{i}"
            texts.append(" ".join(w))
    return texts


@pytest.mark.parametrize("parts", ["1", "8", "64"])
def test_near_duplicates_near_the_limit_equal_brute_force(spark, parts):
    texts = borderline()
    sets = [set(simhash.shingle_hashes(t, 5).tolist()) for t in texts]
    pairs = [(a, b, len(sets[a] & sets[b]) / len(sets[a] | sets[b])) for a in range(len(texts)) for b in range(a - a % 5, a)]

    def groups(least):
        out = list(range(len(texts)))
        for a, b, j in pairs:
            if j >= least:
                out = [out[b] if x == out[a] else x for x in out]
        return out

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        kept = {r["doc_id"] for r in simhash.deduplicate(docs(spark, texts)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    # whatever links at 0.82 must be one, whatever does not at 0.78 must stay apart
    assert all(sum(i in kept for i, g in enumerate(groups(0.82)) if g == x) <= 1 for x in set(groups(0.82)))
    assert all(any(i in kept for i, g in enumerate(groups(0.78)) if g == x) for x in set(groups(0.78)))
    exact = groups(0.8)
    wrong = sum(sum(i in kept for i, g in enumerate(exact) if g == x) != 1 for x in set(exact))
    assert wrong <= 0.05 * len(set(exact))
    test_near_duplicates_near_the_limit_equal_brute_force.kept.append(kept)
    assert all(k == kept for k in test_near_duplicates_near_the_limit_equal_brute_force.kept)


test_near_duplicates_near_the_limit_equal_brute_force.kept = []


# ---- op9 ------------------------------------------------------------------------------


def test_phrases_dont_depend_on_the_offset():
    rng = np.random.default_rng(10)
    text = "".join(rng.choice(list("abcdefghij "), 5000))
    a, b, c = phrases.sketches([text, "something else in front " + text, "".join(rng.choice(list("abcdefghij "), 5000))])
    assert phrases.likeness(a, b) > 0.8 and phrases.likeness(a, c) < 0.1 and phrases.likeness(a, a) == 1
    assert (phrases.sketches([text])[0] == a).all() and (phrases.from_hex(phrases.fingerprint(a)) == a).all()
    assert all(len(s) for s in phrases.sketches(["a", "aa", "a" * 70_000, "ab" * 5000, "é😀"])) and len(phrases.sketches(["", ""])[0]) == 0


M64 = (1 << 64) - 1


def slow_mix(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & M64
    x ^= x >> 27
    x = (x * 0x94D049BB133111EB) & M64
    return x ^ (x >> 31)


def slow_labels(sym):
    for _ in range(4):
        new = []
        for i, x in enumerate(sym):
            d = (x ^ sym[i - 1]) if i else (x | 1)
            low = (d & -d).bit_length() - 1
            new.append(2 * low + (x >> low & 1))
        sym = new
    return sym


def slow_sketch(text, names=64):
    """Parse one text symbol by symbol; sort all its names."""
    sym, ranks, level, size = [ord(c) for c in text], set(), 0, [1] * len(text)
    while sym:
        run_sym, run_size, i = [], [], 0
        while i < len(sym):
            j = i
            while j < len(sym) and sym[j] == sym[i]:
                j += 1
            n = j - i
            x = sym[i] if n == 1 else sym[i] + (min(n, 1023) << 21) if level == 0 else slow_mix((sym[i] + n * 0x9E3779B97F4A7C15) & M64)
            run_sym.append(x)
            run_size.append(sum(size[i:j]))
            i = j
        lab = slow_labels(run_sym)
        cuts = [i for i in range(len(lab)) if i == 0 or 0 < i < len(lab) - 1 and lab[i] > lab[i - 1] and lab[i] >= lab[i + 1]]
        sym, size = [], []
        for a, b in zip(cuts, [*cuts[1:], len(lab)], strict=True):
            part = sum(int(phrases._PLACES[k % 64]) * x for k, x in enumerate(run_sym[a:b]))
            sym.append(slow_mix((part + (b - a) * 0x9E3779B97F4A7C15) & M64))
            size.append(sum(run_size[a:b]))
        for x, n in zip(sym, size, strict=True):
            w = max(n >> 3, 1) if level == 0 and len(sym) > 1 else n
            ranks.add(slow_mix((x + 0x9E3779B97F4A7C15) & M64) // w)
        level += 1
        if len(sym) == 1:
            break
    return [r >> 16 for r in sorted(ranks)[:names]]


def test_sketches_equal_a_naive_parse(sf):
    import pyarrow.parquet as pq

    rng = np.random.default_rng(12)
    line = "the same line of words, over and over again; "
    texts = [t or "" for t in ODD] + [line * 50, line * 2000, "ab" * 3000, "".join(rng.choice(list("abc "), 255)), "".join(rng.choice(list("abc "), 256))]
    texts += [t for t in pq.read_table(f"{sf}/documents.parquet")["text"].to_pylist()[:60] if t]
    for text, got in zip(texts, phrases.sketches(texts), strict=True):
        assert got.tolist() == slow_sketch(text), text[:50]


def test_repeats_and_lengths_dont_change_the_likeness():
    line = "a line of words that stands on every page of some book, which has many pages"
    a, b = phrases.sketches(["\n".join([line] * 50), "\n".join([line] * 5000)])
    assert phrases.likeness(a, b) > 0.7
    rng = np.random.default_rng(13)
    likes = []
    for n in (200, 254, 255, 256, 300):
        texts = ["".join(rng.choice(list("abcdefgh ,"), n)) for _ in range(40)]
        s = phrases.sketches([x for t in texts for x in (t, t + "x")])
        likes.append(np.mean([phrases.likeness(s[i], s[i + 1]) for i in range(0, 80, 2)]))
    assert max(likes) - min(likes) < 0.05 and min(likes) > 0.85


def test_with_next(spark):
    d = docs(spark, [*ODD, "no id"], [*range(len(ODD)), None])
    got = {r["doc_id"]: r for r in phrases.with_next(d).collect()}
    texts = ["no id", *[t or "" for t in ODD]]
    assert len(got) == len(texts)
    for k, i in enumerate([None, *range(len(ODD))]):
        t, u = texts[k], texts[(k + 1) % len(texts)]
        half = len(t) // 2
        edit = t[: len(t) - half] + u[:half]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(edit.encode()).hexdigest()
        assert got[i]["fingerprint"] == phrases.fingerprint(phrases.sketches([t])[0]) and got[i]["edited_fingerprint"] == phrases.fingerprint(phrases.sketches([edit])[0])
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
    assert got[7]["near_next"] == 1 and got[7]["fingerprint"] == got[8]["fingerprint"]
    one = phrases.with_next(docs(spark, ["single text"])).first()
    assert one["near_next"] == 1
    assert phrases.with_next(empty(spark)).count() == 0 and phrases.with_next(odd(spark)).count() == 12
    assert phrases.fingerprints(odd(spark)).count() == 12


# ---- op10 -----------------------------------------------------------------------------


def slow_path(unit, model, known={}):  # noqa: B006
    """Viterbi by hand: best total score, ties to the longer last piece, unknown characters as bytes."""
    if id(model) not in known:
        known[id(model)] = model, {p: (i, x) for p, i, x in model.pieces}, model.longest, model.unknown_score
    _, table, longest, unknown = known[id(model)]
    best, back = [0.0], [(0, 0)]
    for end in range(1, len(unit) + 1):
        top = None
        for start in range(max(0, end - longest), end):
            i, x = table.get(unit[start:end], (-1, unknown) if end - start == 1 else (None, 0))
            if i is not None and (top is None or best[start] + x > top[0]):
                top = best[start] + x, (start, i)
        best.append(top[0])
        back.append(top[1])
    out, end = [], len(unit)
    while end:
        start, i = back[end]
        out += [i] if i >= 0 else [model.bytes_from + b for b in reversed(unit[start:end].encode())]
        end = start
    return out[::-1]


def test_long_units_are_folded_like_short_ones(spark):
    rng = np.random.default_rng(6)
    made = ["▁" + "".join(rng.choice(list("etaoinshrdlu"), n)) for n in (1, 62, 63, 64, 65, 78, 79, 126, 127, 128, 191, 192, 1000, 6000)]
    made += ["é" * 70 + "x" * 100, "日" * 300, "☃" * 130, "e" * 5000]
    model = pieces.load()
    found = spark.createDataFrame([(u, 1, len(u)) for u in made], "unit string, n long, size long")
    got = {r["unit"]: list(r["ids"]) for r in pieces.segment(found, model).collect()}
    assert len(got) == len(made) and all(got[u] == slow_path(u, model) for u in made)


def test_scores_of_a_merge_model(spark, sf):
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    d = spark.read.parquet(f"{sf}/documents.parquet").where("text is not null").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in d.collect()}
    tokens = {i: len(library.encode(t)) for i, t in texts.items()}
    zipf = sum(r["n_tokens"] for r in pieces.encode(d).collect())
    ranks = sum(r["n_tokens"] for r in pieces.encode(d, pieces.load(scores="file")).collect())
    assert abs(zipf / sum(tokens.values()) - 1) < 0.02 < ranks / sum(tokens.values()) - 1


def test_pieces(spark, tmp_path):
    import public_tokenizers
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read())
    proto.trainer_spec.model_type = 1
    for p in proto.pieces:
        p.score = max(p.score, -40_000)  # the library adds in single precision
    (tmp_path / "m.model").write_bytes(proto.SerializeToString())
    library, model = sentencepiece.SentencePieceProcessor(model_file=str(tmp_path / "m.model")), pieces.load(str(tmp_path / "m.model"))
    texts = ["Hello  wörld\nzü \t x", "the cat, the “dog” 1.2.3 x² m²", None, "", "   ", "日本語 😀 ok", "a" * 3000, "same", "same", "tail " * 5000]
    d = docs(spark, texts)
    for frequent in (1000, 3):
        got = {r["id"]: r for r in pieces.encode(d, model, frequent=frequent).collect()}
        assert len(got) == len(texts)
        for i, t in enumerate(texts):
            assert list(got[i]["ids"]) == library.encode(t or "") and got[i]["roundtrip"] and got[i]["n_tokens"] == len(got[i]["ids"])
    plain = pieces.load()
    assert pieces.encode(odd(spark), plain).where("roundtrip").count() == 12 and pieces.encode(empty(spark), plain).count() == 0
    for frequent in (1000, 3, 0):
        for r in pieces.encode(d.repartition(3), plain, frequent=frequent).collect():
            assert list(r["ids"]) == [i for u in pieces.units(texts[r["id"]]) for i in slow_path(u, plain)]


def test_slices_dont_depend_on_batches():
    import pyarrow as pa

    rng = np.random.default_rng(22)
    sizes = rng.choice([0, 10, 400_000, 1_500_000, 5_000_000], 60, p=[0.2, 0.4, 0.3, 0.07, 0.03])
    whole = pa.table({"part": np.full(60, 7), "id": np.arange(60), "text": ["x" * int(n) for n in sizes]}).combine_chunks()
    want = None
    for n in (60, 1, 7, 13):
        got = [(key, b["id"].to_pylist()) for key, b in pieces._slices(iter(whole.to_batches(n)))]
        assert sum((ids for _, ids in got), []) == list(range(60)) and len({key for key, _ in got}) == len(got)
        assert all(len(ids) == 1 or sum(sizes[i] for i in ids) <= pieces.PORTION for _, ids in got)
        assert want in (None, got)
        want = got
    assert list(pieces._slices(iter([]))) == []


def test_pieces_must_not_cross_units(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as pb

    import public_tokenizers

    proto = pb.ModelProto()
    proto.ParseFromString(open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read())
    proto.pieces[300].piece = "a▁b"
    (tmp_path / "m.model").write_bytes(proto.SerializeToString())
    with pytest.raises(ValueError):
        pieces.load(str(tmp_path / "m.model"))
