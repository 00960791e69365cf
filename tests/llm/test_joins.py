"""Joins, searches and page operators against brute force."""

import html
import math
import random
import re
import zlib

import numpy as np
import pytest

from trackweave.llm import ann, common, html_extract, line_dedup, ngram_join, url_filter
from trackweave.llm.queries import URL_RULES

DOC_SCHEMA = "doc_id long, text string, n_chars long, kept string, component_id string"


def made(seed, groups=12, copies=6):
    """Documents with exact and near copies, shared lines, short lines and blanks."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["the", "of", "and"] * 30
    shared = " ".join(rng.choices(words, k=60))
    out = []
    for _ in range(groups):
        lines = [" ".join(rng.choices(words, k=rng.choice([1, 2, 3, 8, 15, 40]))) for _ in range(rng.randint(1, 6))] + [shared] * rng.randint(0, 1)
        for _ in range(rng.randint(1, copies)):
            own = [" ".join(w if rng.random() > rng.choice([0, 0, 0.01, 0.04]) else rng.choice(words) for w in x.split()) for x in lines]
            out.append("\n".join(own))
    out += [None, "", "   ", "one", "one", "ONE", "a b", "Solo line here", "Solo line here", "a a a\na\na  a a a", "a", "\n\n", " ".join(words * 20)]
    rng.shuffle(out)
    return [(k, t, len(t or ""), "x", "y") for k, t in enumerate(out)]


def brute_lines(rows):
    seen, kept = [], {}
    for k, text, *_ in sorted(rows, key=lambda r: r[0]):
        if text is None:
            continue
        gone = []
        for i, line in enumerate(text.split("\n")):
            words = {w for w in line.lower().split(" ") if w}
            if not words:
                continue
            if any(5 * len(words & s) >= 4 * len(words | s) for s in seen):
                gone.append(i)
            seen.append(words)
        kept[k] = gone
    return kept


@pytest.mark.parametrize("hot", [1, 128])
def test_line_dedup(spark, monkeypatch, hot):
    monkeypatch.setattr(line_dedup, "HOT", hot)
    rows = made(hot)
    docs = spark.createDataFrame(rows, DOC_SCHEMA)
    want = brute_lines(rows)
    got = {r["doc_id"]: sorted(r["removed"]) for r in line_dedup.removed_lines(docs).collect()}
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}
    assert len(got) == len(rows)
    kept = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs).collect()}
    for k, text, *_ in rows:
        lines = None if text is None else [x for i, x in enumerate(text.split("\n")) if i not in want[k]]
        if lines == []:
            assert k not in kept
        else:
            assert kept[k]["text"] == (None if text is None else "\n".join(lines)) and kept[k]["kept"] == "x"
            assert kept[k]["n_chars"] == len(kept[k]["text"] or "")


def test_line_dedup_edges(spark):
    docs = spark.createDataFrame([(None, "some line here now"), (1, "some line here now\nother text"), (1, "some line here now\nother text"), (None, None)], "doc_id long, text string")
    rows = line_dedup.dedup_lines(docs).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in rows), key=repr) == sorted([(1, "some line here now\nother text")] * 2 + [(None, None)], key=repr)
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0 and line_dedup.removed_lines(docs.limit(0)).count() == 0


def test_lines_of_any_length(spark):
    """Lines of one or two words and lines without plain spaces take part."""
    space = "\t\x0b\r\x85\xa0\u2003\u3000"
    texts = ["Les.\nAnd ornd.\n一二三四五六七八\na\tb\tc\n", "les.\nand  ornd.\n一二三四五六七八\nc b a\n", "a\xa0b\u3000c\nnew\none\n \n\t\n", "one\rone\nOther\n" + "u" * 500, "u" * 500, None, ""]
    rows = [(k, t) for k, t in enumerate(texts)]
    want = brute_lines([(k, t and re.sub(f"[{space}]", " ", t)) for k, t in rows])
    got = {r["doc_id"]: sorted(r["removed"]) for r in line_dedup.removed_lines_of_any_length(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want | {5: []}
    assert got[1] == [0, 1, 2, 3] and got[2] == [0] and got[3] == [0] and got[4] == [0]


def test_lines_that_share_their_rare_words_alone(spark, monkeypatch):
    """Lines with the same rare words that differ in common ones are no candidates, so their pairs are not verified."""
    rng, verified, counted = random.Random(3), line_dedup._verified, []
    common = [f"c{i}" for i in range(40)]
    lines = [" ".join([f"r{i}" for i in range(24)] + rng.sample(common, 16)) for _ in range(60)]
    rows = [(k, x) for k, x in enumerate([*lines, lines[7], "\n".join(" ".join(rng.sample(common, 2)) for _ in range(2000))])]

    def noted(pairs, *more):
        counted.append(pairs.count())
        return verified(pairs, *more)

    monkeypatch.setattr(line_dedup, "_verified", noted)
    got = {r["doc_id"]: sorted(r["removed"]) for r in line_dedup.removed_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_lines(rows)
    assert sum(counted) < 300  # of 1770 pairs of lines


WORDS = re.compile("[^\x20\x09-\x0d]+")


def brute_components(rows, width, num, den):
    sets = []
    for k, text, *_ in rows:
        w = WORDS.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    of = list(range(len(rows)))

    def root(x):
        while of[x] != x:
            x = of[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and den * len(a & sets[j]) >= num * len(a | sets[j]):
                x, y = root(i), root(j)
                of[max(x, y)] = min(x, y)
    return [(rows[i][0], len(sets[i]), rows[root(i)][0]) for i in range(len(rows))]


@pytest.mark.parametrize(("width", "num", "den", "small"), [(4, 85, 100, 16), (5, 4, 5, 2)])
def test_near_duplicates(spark, monkeypatch, width, num, den, small):
    common.ensure_importable(spark)
    monkeypatch.setattr(ngram_join, "SMALL_CELL", small)
    rows = made(width, groups=8, copies=12)
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, DOC_SCHEMA), width, num, den).collect()
    assert sorted(tuple(r) for r in got) == sorted(brute_components(rows, width, num, den))


def test_words_of_one_structure_are_told_apart():
    """Complementary Thue-Morse words, which polynomials modulo a power of two can't tell apart."""
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    assert ngram_join.shingles(word, 4).tolist() != ngram_join.shingles(other, 4).tolist()
    assert not set(ngram_join.shingles(f"x {word} y z w", 4).tolist()) & set(ngram_join.shingles(f"x {other} y z", 4).tolist())


@pytest.mark.parametrize("width", [1, 4, 5])
def test_shingles_of_texts_hashed_together(monkeypatch, width):
    monkeypatch.setattr(ngram_join, "TOGETHER", 100)
    rng = random.Random(width)
    texts = ["".join(rng.choices("ab AB\t\n\x0b é\x00x", k=rng.randint(0, 60))) for _ in range(500)] + [None, "", " ", "long " * 200_000, "a" * 100_000]
    for text, found in zip(texts, ngram_join.all_shingles(texts, width), strict=True):
        words = WORDS.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
        assert len(found) == (len({tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))}) if words else 0)


def test_star_of_near_copies(spark):
    """Copies that are linked to their original and not to each other, with a chain at the end."""
    rng = random.Random(3)
    base = [f"b{i}" for i in range(150)]
    texts = [" ".join(base)]
    for k in range(60):
        own = base[:]
        for j in rng.sample(range(150), 2):
            own[j] = f"c{k}_{j}"
        texts.append(" ".join(own))
    rng.shuffle(texts)
    rows = [(k, t) for k, t in enumerate(texts)]
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, 100).collect()
    assert sorted(tuple(r) for r in got) == sorted(brute_components(rows, 4, 85, 100))


def test_distances_to_different_pivots_are_not_compared(spark, monkeypatch):
    """a and b are linked; in their only cell a is measured against the first pivot alone and b against the second alone."""
    common.ensure_importable(spark)
    monkeypatch.setattr(ngram_join, "SMALL_CELL", 2)
    s = [f"s{k}" for k in range(1, 19)]
    p, q = [f"p{k}" for k in range(7)], [f"q{k}" for k in range(17)]
    texts = [["a", "x", *s], ["b", "x", *s], ["a", "x", "s1", *s[2:12], *p], ["b", "x", "s1", *q]]
    for k in range(400):  # these make words common, so that the order of words and pivots is as wanted
        texts.append([f"f{k}_{j}" for j in range(60)] + s[2:] + p + q * (k < 100) + ["s2"] * (k < 10) + ["s1"] * (k < 6))
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 1, 85, 100).collect()}
    assert [got[k] for k in range(4)] == [0, 0, 2, 3]
    assert got == {k: k if k != 1 else 0 for k in range(len(rows))}


def test_near_duplicate_edges(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (7, "a b c d e f"), (7, "other words stand in this one"), (9, "A b c d e f"), (8, None), (None, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(docs).collect()), key=repr)
    assert got == sorted([(None, 2, 7), (7, 2, 7), (7, 2, 7), (9, 2, 7), (8, 0, 8), (None, 0, None)], key=repr)
    assert ngram_join.near_duplicates(docs.limit(0)).count() == 0


def test_drop_near_duplicates_keeps_one_of_each(spark):
    rows = made(9)
    docs = spark.createDataFrame(rows, DOC_SCHEMA)
    kept = ngram_join.drop_near_duplicates(docs)
    want = sorted(k for k, n, c in brute_components(rows, 5, 4, 5) if k == c)
    assert sorted(r["doc_id"] for r in kept.collect()) == want and kept.columns == docs.columns
    text = "one two three four five six"
    odd = spark.createDataFrame([(3, text), (3, text), (None, text), (None, "nine ten"), (None, "nine ten"), (3, "other words"), (None, None), (None, "")], "doc_id long, text string")
    left = sorted(((r["doc_id"], r["text"]) for r in ngram_join.drop_near_duplicates(odd).collect()), key=repr)
    assert left == sorted([(3, text), (3, "other words"), (None, "nine ten"), (None, None), (None, "")], key=repr)


def brute_nearest(rows, every, k):
    usable = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = set()
    for i, v in usable:
        if i % every:
            continue
        a, near = np.array(v), []
        for j, w in usable:
            if j != i and len(w) == len(v):
                b = np.array(w)
                near.append((-float((a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum()))), j))
        out |= {(i, r + 1, j, round(-s, 9)) for r, (s, j) in enumerate(sorted(near)[:k])}
    return out


def test_nearest(spark):
    common.ensure_importable(spark)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(5, 8))
    rows = [(k, [float(x) for x in np.float32(centres[k % 5] + 0.3 * rng.normal(size=8))]) for k in range(400)]
    rows += [(k, rows[7][1]) for k in range(400, 700)]
    rows += [(1000, None), (1050, [0.0] * 8), (1100, [1.0, None] * 4), (1150, [float("nan")] * 8), (None, rows[0][1]), (1200, [1.0, 2.0]), (1250, [2.0, 1.0]), (50, rows[50][1])]
    vectors = spark.createDataFrame([(i, v, 0, 1) for i, v in rows], "vec_id long, embedding array<double>, rank int, dim int")
    got = {(r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in ann.nearest(vectors, shard_rows=64).collect()}
    assert got == brute_nearest(rows, 50, 5)
    assert ann.nearest(vectors.limit(0)).count() == 0


def test_ties_of_multiples(spark):
    """Multiples of one vector are at one distance; the smaller ids come first, in whatever shard they are."""
    common.ensure_importable(spark)
    rng = np.random.default_rng(4)
    rows = [(0, [1.0, 2.0, 3.0])] + [(989 + k, [2.0**e * x for x in (1.0, 2.0, 3.0)]) for k, e in enumerate(rng.permutation(12).tolist())]
    rows += [(k, [float(x) for x in rng.normal(size=3)]) for k in range(1, 300) if k % 50]
    rows += [(2000 + k, [0.0, 3.0 * 2.0**k, -2.0 * 2.0**k]) for k in range(150)] + [(1500, [0.0, 0.0, 1e-200]), (1550, [0.0, 0.0, 1e200])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for shard_rows in (16, 4096):
        got = {}
        for r in ann.nearest(vectors, shard_rows=shard_rows).collect():
            got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
        assert [got[0][k][0] for k in range(1, 6)] == [989, 990, 991, 992, 993] and got[0][1][1] == got[0][5][1]
        assert [got[2050][k][0] for k in range(1, 6)] == [2000, 2001, 2002, 2003, 2004]
        assert got[1500][1] == (1550, 1.0)


def test_relaxed_search_keeps_recall():
    rng = np.random.default_rng(2)
    points = rng.normal(size=(3000, 16))
    points /= np.linalg.norm(points, axis=1)[:, None]
    tree = ann.VantagePointTree(points)
    want = np.argsort(-(points[:100] @ points.T), axis=1)[:, :5]
    for factor, least in ((1.0, 1.0), (1.3, 0.9)):
        found, _ = tree.search(points[:100], 5, factor)
        assert np.mean([len(set(a) & set(b)) / 5 for a, b in zip(found, want, strict=True)]) >= least


def test_hosts_paths_and_rules(spark):
    common.ensure_importable(spark)
    urls = [None, "", "no scheme", "http://A.Example.ORG/es/1?x#y", "https://example.org/en/12", "https://example.org", "http://sub.x.com/fr/", "http://x.com/de/9", "http://com/fr/a", "http://y.net/es/3?u=http://b/c",
            "http://notcom/fr/", "x://h#/p", "http://é.org/É/\n", "http://a.com/en/1"]
    rows = [(k, u, "v", "s") for k, u in enumerate([*urls, urls[3]])]
    pages = spark.createDataFrame([*rows, (None, "http://q.org/", "v", "s")], "page_id long, url string, verdict string, score string")
    got = url_filter.judge_urls(pages, URL_RULES).collect()
    assert len(got) == len(rows) + 1
    for r in got:
        url = "http://q.org/" if r["page_id"] is None else rows[r["page_id"]][1]
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
        rule = url_filter.allowed(host, path, URL_RULES)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule and rule[0] + rule[1])
        assert r["verdict"] == rule[2] if rule else r["verdict"] in ("allow", "block")
    assert url_filter.judge_urls(pages.limit(0), URL_RULES).count() == 0
    assert {r["verdict"] for r in url_filter.judge_urls(pages, []).collect()} == {"allow"}


def test_url_models_tell_classes_apart(spark):
    rng = random.Random(5)
    good = [f"http://{rng.choice(['news', 'wiki', 'docs'])}{rng.randint(1, 99)}.org/articles/{rng.randint(1, 999)}" for _ in range(400)]
    bad = [f"http://{rng.choice(['cheap', 'casino', 'pills'])}{rng.randint(1, 99)}.com/de/win-{rng.randint(1, 999)}" for _ in range(400)]
    asked = [(u.replace(".org", ".net").replace(".com", ".net"), k) for us, k in ((good, "allow"), (bad, "block")) for u in us[:50]]
    pages = spark.createDataFrame([(k, u) for k, u in enumerate([*good, *bad, *[u for u, _ in asked]])], "page_id long, url string")
    rows = url_filter.judge_urls(pages, [("org", "/", "allow"), ("com", "/de/", "block")]).where("rule is null").collect()
    assert sum(r["verdict"] == asked[r["page_id"] - 800][1] for r in rows) >= 95


def test_url_counts_are_exact(spark):
    """Every context and gram has a count of its own, also beyond 32,768 of them."""
    common.ensure_importable(spark)
    rng = random.Random(6)
    texts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789-/", k=60)) for _ in range(1500)]
    want = {}
    for i, t in enumerate(texts):
        line = b"\2" * 4 + t.encode() + b"\3"
        for at in range(4, len(line)):
            for k in range(5):
                for table, seen in enumerate((line[at - k : at], line[at - k : at + 1])):
                    want.setdefault((table, k, seen), [0, 0])[i % 2] += 1
    keys, counts = url_filter.count_model(spark.createDataFrame([(t, i % 2) for i, t in enumerate(texts)], "text string, cls int"))
    assert len(keys) == len(want) > 1 << 15
    assert sorted(map(tuple, counts.T.tolist())) == sorted(map(tuple, want.values()))


@pytest.mark.parametrize("bits", [2, 12])
def test_url_scores_equal_a_plain_model(spark, monkeypatch, bits):
    """Blocks of four URLs and of all; among them a very long URL, repeated ones and non-ASCII."""
    common.ensure_importable(spark)
    monkeypatch.setattr(url_filter, "BLOCK_BITS", bits)
    rng = random.Random(8)
    words = ["news", "wiki", "é", "pills", "a-1", "中文"]
    urls = [f"http://{rng.choice(words)}.{rng.choice(['org', 'com', 'net'])}/{rng.choice(['de', 'fr', 'x'])}/{'/'.join(rng.choices(words, k=3))}" for _ in range(120)]
    urls += [urls[0], "http://long.net/" + "ab/" * 20_000, "http://long.org/" + "cd/" * 20_000, None, "x"]
    rules = [("org", "/", "allow"), ("com", "/", "block")]
    got = url_filter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(3), rules).collect()
    texts = {r["page_id"]: r["host"] + r["path"] for r in got}
    seen = [{}, {}]
    for r in got:
        if r["rule"] and zlib.crc32(texts[r["page_id"]].encode()) % 5:
            line = b"\2" * 4 + texts[r["page_id"]].encode() + b"\3"
            for at in range(4, len(line)):
                for k in range(5):
                    for key in ((k, line[at - k : at]), (k, line[at - k : at + 1], "gram")):
                        mine = seen[r["verdict"] == "allow"]
                        mine[key] = mine.get(key, 0) + 1

    def plain(text):
        line, total = b"\2" * 4 + text.encode() + b"\3", 0.0
        for at in range(4, len(line)):
            p = [1 / 256, 1 / 256]
            for k in range(5):
                p = [(seen[c].get((k, line[at - k : at + 1], "gram"), 0) + 2.0 * p[c]) / (seen[c].get((k, line[at - k : at]), 0) + 2.0) for c in (0, 1)]
            total += math.log(p[1]) - math.log(p[0])
        return total / (len(line) - 4)

    assert len(got) == len(urls)
    for r in got:
        assert r["score"] == pytest.approx(plain(texts[r["page_id"]]), abs=1e-9)
    allowed = [r["score"] for r in got if not r["rule"] and r["verdict"] == "allow"]
    assert min(allowed, default=math.inf) > max((r["score"] for r in got if not r["rule"] and r["verdict"] == "block"), default=-math.inf)


def brute_article(source):
    m = re.search(r"<article>(.*?)(</article>|\Z)", source, re.S)
    body = re.sub(r"<[^>]*(>|\Z)", "", re.sub(r"</?(p|h1|br)\b[^>]*(>|\Z)", " ", m[1])) if m else ""
    return " ".join(html.unescape(body).split())


def test_pages(spark):
    common.ensure_importable(spark)
    pages = common.read_table(spark, "/root/testdata/sf0.001", "pages")
    got = {r["page_id"]: r for r in html_extract.extract_text(pages).collect()}
    for r in pages.collect():
        assert got[r["page_id"]]["text"] == brute_article(r["html"]) and got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"])


def test_site_styles_find_unnamed_furniture(spark):
    rng = random.Random(8)
    words = [f"word{i}" for i in range(500)]
    rows = []
    for k in range(40):
        text = " ".join(rng.choices(words, k=30))
        rows.append((k, f"http://site.example/{k}", f"<html><body><div class=x1>Home News Weather Contact us today</div><div class=x2><p>{text}</p><p>{text[::-1]}</p></div><div class=x3><span>All rights of Site</span></div></body></html>", "c"))
    rows.append((99, "http://other.example/1", "<html><body><div class=x1>Only here</div></body></html>", "c"))
    got = {r["page_id"]: r["text"] for r in html_extract.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    for k, _, source, _ in rows[:-1]:
        assert got[k] == " ".join(re.findall(r"<p>(.*?)</p>", source))
    assert got[99] == "Only here"


@pytest.mark.parametrize(("source", "want"), [
    (None, ""), ("", ""), ("plain &lt;b&gt; 1 < 2", "plain <b> 1 < 2"), ("<p>a<b>b</b>c<br>d<p>e", "abc d e"), ("<script>var a='<p>no</p>'</script>yes", "yes"), ("<style>x", ""), ("a<!-- b --> c <!-- d", "a c"),
    ("<nav>n</nav><main><article><header><h1>T</h1></header>x<aside>s</aside></article><section id=comments><p>c</p></section></main><footer>f</footer>", "T x"),
    ("<div class='cookie-notice'>c</div><div class=sidebar>s</div><div hidden>h</div><form>q<input></form><p>text&nbsp;&amp; more", "text & more"), ("<p>cut &am", "cut &am"), ("<p>t</p><a href='x", "t"),
    ("<ul><li>one<li>two</ul>", "one two"), ("<p>" + "long " * 50_000, ("long " * 50_000).strip())])
def test_markup(source, want):
    assert html_extract.Page(source or "").text({}) == want


@pytest.mark.parametrize(("source", "want"), [
    ("<html><head><title>T</title><meta charset=utf-8><body><p>a<p>b</body></html>", "a b"), ("<head><link href=x><p>a</p><div>b</div>", "a b"), ("<head><title>T</title>a <b>c</b>", "a c"),
    ("<head><title>T</title></head><body>a", "a"), ("<article>so <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</article>", "so x=1 holds")])
def test_open_heads_and_formulas(source, want):
    assert html_extract.Page(source).text({}) == want


def test_page_edges(spark):
    pages = spark.createDataFrame([(1, None, None, "x"), (1, "u", "<p>t", "x"), (None, "http://h/", "", "x")], "page_id long, url string, html string, n_chars string")
    rows = html_extract.extract_text(pages).collect()
    assert sorted(((r["page_id"], r["text"], r["n_chars"]) for r in rows), key=repr) == sorted([(1, "", 0), (1, "t", 1), (None, "", 0)], key=repr)
    assert html_extract.extract_text(pages.limit(0)).count() == 0
