"""Article text, exact centroids and repaired conversations against plain versions."""

import hashlib
import itertools
import zlib

import numpy as np
import pytest

from tracklens.llm import article, centroids, dialogues

PAGE = """<!DOCTYPE html><html><head><title>Not this</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><h1 class="site-title">Site</h1></header><nav><ul><li><a href=/a>A</a></li></ul></nav><div class="cookie-notice"><p>We use cookies, all of them, always, on each page, for ever.</p></div>
<div class="wrap"><div id="content"><h1>The &amp; title</h1><p>First <b>para</b>graph,
 with   commas, and&nbsp;some more words to read.<br>Second line &lt;kept&gt;.<p>Unclosed paragraph, which ends by itself, here.
<ul><li>An item of the article that has some length, too.</li></ul><div class="ad"><p>Buy, buy, buy, buy, buy, buy now!</p></div><form><p>Your name, please</p></form>
<ul><li><a href=/1>more one</a></li><li><a href=/2>more two</a></li><li><a href=/3>more three</a></li></ul></div>
<div class="sidebar"><p>Side, side, side, and side again, with commas, many of them.</p></div></div>
<section class="comments"><article><p>I disagree, loudly, and at length, for many, many reasons, all wrong.</p></article></section><!-- <p>hidden, hidden</p> --><footer>Foot</footer></body></html>"""
WANTED = "The & title First paragraph, with commas, and some more words to read. Second line <kept>. Unclosed paragraph, which ends by itself, here. An item of the article that has some length, too."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (PAGE, WANTED), (None, ""), ("", ""), ("   \n ", ""), ("only text, no tags", "only text, no tags"), ("<p>a<p>b", "a b"), ("<nav>menu</nav>", ""), ("<script>never ends <p>x</p>", ""),
        ("<article><p>cut in a ta</p><p>g <a hre", "cut in a ta g"), ("<article><p>a < b and a <3 c</p></article>", "a < b and a <3 c"), ("<div class='menu'><p>Only this, no more.</p></div>", "Only this, no more."),
        ("<div><p title='open>x</p><p>Long enough to be read, surely.</p></div>", "x Long enough to be read, surely."), ("<P>Upper&eacute;</P>", "Upperé"), ("<article><h1>T</h1><p>x</p></article><footer>f", "T x"),
        ("<article><div class='post-content'><p>One, two.</p></div><div class='post-footer'>meta</div></article>", "One, two."),
        ("<article><header><h1>Title</h1></header><section><p>One.</p></section><section><p>Two.</p></section></article><div role=complementary><p>aside, aside</p></div>", "Title One. Two."),
        ("<html><head><title>t</title><p>No body, no end of the head.", "No body, no end of the head."), ("<!--><p>Seen, <!-- <p>not -->read</p>", "Seen, read"),
        ("<article><p>Read <span class='ad'>buy <b>now</b></span>this <span hidden>not</span><button>Share</button>and <svg><text>x</text></svg>that.</p></article>", "Read this and that."),
        ("<div class='elementor-widget-text-editor'><p>A widget, of text, that is read.</p></div><div class='widget'><p>A widget, of links, that isn't.</p></div>", "A widget, of text, that is read."),
        ("<div class='menu'><nav><p>Links, links, more links.</p></nav><p>Only this, no more.</p></div>", "Only this, no more."),
        ("<div class='page-with-menu'><p>A page, with a menu, somewhere.</p></div>", "A page, with a menu, somewhere."),
        ("<table><tr><td><p>Cell, one, with words enough<td><p>Cell, two, with words enough</table>", "Cell, one, with words enough Cell, two, with words enough"),
    ],
)
def test_main_text(page, text):
    assert article.main_text(page) == text


def test_article_of_any_size_and_nesting():
    many = "".join(f"<p>Paragraph {k}, of words, and more.</p>" for k in range(30_000))
    assert article.main_text(f"<nav>x</nav><article>{many}</article>").count("Paragraph") == 30_000
    assert article.main_text("<div>" * 50_000 + "deep, deep down, words" + "</div>" * 50_000) == "deep, deep down, words"
    assert article.main_text("<div><p>before it, some words</p>" + "<a '" * 50_001 + "<p>after</p>").startswith("before it")
    assert article.main_text("<p><b>" * 5_000 + "x").endswith("x")


def test_extract_articles(spark):
    rows = [(1, "u", PAGE, "mine", 9), (1, "u", PAGE, "mine", 9), (2, None, None, None, None), (None, "u", "<p>a, b</p>", "", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, `a.b` int")
    found = article.extract_articles(pages)
    assert found.columns == ["page_id", "url", "a.b", "text", "n_chars"]
    got = sorted(tuple(r) for r in found.collect() if r[0] == 1) + [tuple(r) for r in found.collect() if r[0] != 1]
    assert got[0] == got[1] == (1, "u", 9, WANTED, len(WANTED)) and (2, None, None, "", 0) in got and (None, "u", 1, "a, b", 4) in got
    assert article.extract_articles(pages.limit(0)).count() == 0


def plain_clusters(rows, clusters, rounds, scale, dim):
    from fractions import Fraction

    kept = [(i, [int((Fraction(x) * scale).__floor__()) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    cs = [v for _, v in order[:clusters]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    near = lambda v: min((far(v, c), k) for k, c in enumerate(cs))
    for _ in range(rounds):
        held = [[] for _ in cs]
        for _, v in kept:
            held[near(v)[1]].append(v)
        cs = [[sum(col) // len(h) for col in zip(*h, strict=True)] if h else c for h, c in zip(held, cs, strict=True)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    each = {k: sum(d for _, c, d in found if c == k) for k in range(len(cs))}
    fit = lambda x: x if x < 1 << 63 else None
    return sorted(((i, c, fit(d), fit(each[c]), fit(sum(each.values())), hashlib.sha256(",".join(map(str, cs[c])).encode()).hexdigest()) for i, c, d in found), key=str)


@pytest.mark.parametrize("size", [1.0, 1e6, 1e9, 1e30])
def test_clusters(spark, size):
    r = np.random.default_rng(5)
    rows = [(k, [float(x) for x in r.normal(size=4) * size]) for k in range(120)] + [(7, None), (8, [1.0]), (9, [1.0, None, 0.0, 0.0]), (10, [float("nan")] * 4), (11, [float("inf")] * 4), (None, [0.0] * 4)]
    rows += [(500, [0.5 * size] * 4)] * 50 + [(501, [0.0] * 4), (502, [-0.0] * 4)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, id int").repartition(3)
    found, _ = centroids.cluster(df, clusters=9, rounds=3, dim=4)
    assert sorted((tuple(x) for x in found.collect()), key=str) == plain_clusters(rows, 9, 3, 256, 4)


def test_few_or_no_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 1)], "vec_id long, embedding array<double>, label int")
    found, _ = centroids.cluster(df, clusters=9, dim=2)
    assert [tuple(r)[:5] for r in found.collect()] == [(1, 0, 0, 0, 0)]
    assert centroids.cluster(df.limit(0))[0].count() == 0 and centroids.cluster(df)[0].count() == 0


def test_distances_are_exact_whatever_they_take():
    r = np.random.default_rng(1)
    for most in (1 << 20, 1 << 24, 1 << 29, 1 << 40):
        values, cs = r.integers(-most, most, (30, 8)), r.integers(-most, most, (5, 8))
        block = centroids.Block(np.arange(30), np.ones(30, bool), values, centroids._above(max(sum(int(x) ** 2 for x in v) for v in values)))
        want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, c, strict=True)) for c in cs] for v in values]
        assert [[int(x) for x in row] for row in centroids.distances(block, cs)] == want


KEEPS = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
NEXT = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}


def plain_repair(rows):
    """Every conversation by a table of least (cost, edits, lines) over all states, relaxed until nothing changes."""
    out = {}
    for conv in {r[0] for r in rows}:
        left = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            shown = lambda x: " " if x is None else x
            fate = zlib.crc32(f"{shown(conv)}:{shown(turn)}".encode()) % 20
            role, text = shown(role), shown(text)
            if fate == 1:
                text = ""
            if fate == 2:
                text = "".join(c for c in text if c not in ".!?")
            if fate == 4:
                role = "user"
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            left += [(turn is not None, turn or 0, role, digest, text)] * {0: 0, 3: 2}.get(fate, 1)
        left.sort()
        seen, faults = set(), []
        for _, _, role, _, text in left:
            spoken = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not spoken else "duplicate" if (role, text) in seen else "truncated" if spoken[-1] not in ".!?" else "")
            seen.add((role, text))
        best = {0: (0, "", ())}
        for k in range(len(left) + 1):
            for _ in range(3):
                for s in list(best):
                    c, e, lines = best[s]
                    role, t = NEXT[s]
                    best[t] = min(best.get(t, (1 << 60,)), (c + 3, e + "I", (*lines, f"{role}:")))
            if k == len(left):
                break
            role, text, fault, after = left[k][2], left[k][4], faults[k], {}
            put = lambda s, x: after.__setitem__(s, min(after.get(s, (1 << 60,)), x))  # noqa: E731, B023
            for s, (c, e, lines) in best.items():
                put(s, (c + 4, e + "D", lines))
                if fault not in ("blank", "duplicate"):
                    charge = 3 if fault == "truncated" else 0
                    if role[:1] in KEEPS[s]:
                        put(KEEPS[s][role[:1]], (c + charge, e + "K", (*lines, f"{role}:{text}")))
                    put(NEXT[s][1], (c + charge + 3, e + "R", (*lines, f"{NEXT[s][0]}:{text}")))
            best = after
        cost, audit, lines = min(best[s] for s in (0, 3) if s in best)
        turns = {x[1] for x in left if x[0]}
        initials = [x[2][:1] for x in left]
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


@pytest.fixture(scope="module")
def talk():
    r = np.random.default_rng(3)
    texts = ["Yes.", "No!", "cut off", "a  ", "", " \n", None, "Long. " * 30, "é?", "what ?\n", "Yes."]
    roles = ["user", "assistant", "system", "tool", None, "", "user", "assistant", "user"]
    rows = []
    for conv in range(150):
        role = ["system"] * (conv % 3 == 0) + ["user", "assistant"] * 6
        for turn in range(int(r.integers(0, 12))):
            odd = r.random() < 0.3
            rows.append((conv, turn if r.random() < 0.95 else None, roles[r.integers(9)] if odd else role[turn], texts[r.integers(11)] if odd else f"Text {conv} {turn}."))
    rows += [(None, 1, "user", "Hi."), (None, 2, "assistant", "Hi.")] + [(900, 5, "user", "same.")] * 40 + [(901, None, None, None)] * 3 + [(902, 10**12 * k, "assistant", f"T{k % 7}.") for k in range(30)]
    return rows


@pytest.mark.parametrize("limit", [256, 2])
def test_repair(spark, talk, monkeypatch, limit):
    big = [(5000, k, ["user", "assistant", "tool", "system"][(k * k) % 4], ["Fine.", "cut", f"T{k}!", f"t{k}", ""][(k * 7) % 5]) for k in range(400)]
    monkeypatch.setattr(dialogues, "SEGMENT_ROWS", limit)
    df = spark.createDataFrame([(*r, "x") for r in talk + big], "conv_id long, turn long, role string, text string, conv string").repartition(5)
    found = {r["conv_id"]: tuple(r)[1:] for r in dialogues.repair_conversations(df).collect()}
    assert found == plain_repair(talk + big)


def test_no_conversations(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert dialogues.repair_conversations(none).count() == 0
    dropped = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    one = spark.createDataFrame([(dropped, 0, "user", "Hi.")], none.schema)
    assert [tuple(r) for r in dialogues.repair_conversations(one).collect()] == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_texts_of_six_megabytes(spark):
    """One such text, its copy and a short one through the operators that read whole texts."""
    from tracklens.llm import ctw, minhash, packing, toxicity

    long = " ".join(f"w{x}" for x in np.random.default_rng(8).integers(0, 90_000, 1_000_000))
    assert len(long) > 6_000_000
    rows = [(1, long, "en"), (2, long + " tail", "en"), (3, "a short one , you idiot", "en")] + [(10 + k, f"plain text {k} " + ("you idiot" if k % 2 else "and more"), "en") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs).collect()}
    words = long.split()
    assert found[1] == (len({tuple(words[k : k + 5]) for k in range(len(words) - 4)}), 1) and found[2][1] == 1 and found[3][1] == 3
    pieces = packing.pack(docs.where("doc_id = 1")).select("start", "length", "doc_tokens").collect()
    assert sum(r["length"] for r in pieces) == pieces[0]["doc_tokens"] > 1_000_000
    labels = spark.createDataFrame([(10 + k, k % 2) for k in range(40)], "doc_id long, toxic int")
    scores = {r["doc_id"]: r["score"] for r in toxicity.score_corpus(docs, labels).collect()}
    assert len(scores) == 43 and all(0 <= s <= 1 for s in scores.values()) and scores[3] > scores[10]
    from pyspark.sql import functions as F

    scored = {r["doc_id"]: (r["n_tokens"], r["score"]) for r in ctw.score(docs.where("doc_id <> 2"), F.col("doc_id") != 1).collect()}
    assert scored[1][0] == len(words) + 1 and -1e9 < scored[1][1] < 0


def test_one_vector_many_times(spark):
    from tracklens.llm import ann

    r = np.random.default_rng(1)
    same = [float(x) for x in r.normal(size=8)]
    rows = [(k, same) for k in range(3000)] + [(3000 + k, [float(x) for x in r.normal(size=8)]) for k in range(300)] + [(7, same)] * 50
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    found = {(x["query_id"], x["rank"]): x["vec_id"] for x in ann.nearest(df, df.where("vec_id in (0, 50)")).collect()}
    assert [found[0, k] for k in range(1, 6)] == [1, 2, 3, 4, 5] and [found[50, k] for k in range(1, 6)] == [0, 1, 2, 3, 4]
