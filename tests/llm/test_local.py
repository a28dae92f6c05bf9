"""The operators' own parts, held against brute force without Spark."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from appendlake.llm import _common as C
from appendlake.llm import decontaminate as D
from appendlake.llm import docstats as S
from appendlake.llm import html_extract as H
from appendlake.llm import language_id as L
from appendlake.llm import minhash_dedup as M
from appendlake.llm import mixing
from appendlake.llm import quality_classifier as B
from appendlake.llm import quality_rules as Q
from appendlake.llm import substring_dedup as U
from appendlake.llm import warc as W

texts = st.lists(st.one_of(st.none(), st.text(alphabet="ab é\n\t #|.", max_size=60)), min_size=1, max_size=6)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@given(texts)
@settings(max_examples=150, deadline=None)
def test_words_and_base_counts(batch):
    done = 0
    for c in C.chunks(pa.array(batch, pa.string()), 40):
        h, base = c.hashes(), S.features(c)[0]
        for i in range(c.lo, c.hi):
            text, w = batch[i] or "", words(batch[i])
            own = h[c.first[i - c.lo] : c.first[i - c.lo + 1]]
            assert len(own) == len(w) and len(set(own.tolist())) == len(set(w))
            three = Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
            again = {j + t for j in range(len(w) - 2) if three[tuple(w[j : j + 3])] > 1 for t in range(3)}
            lines = [x for x in text.split("\n") if words(x)]
            assert base[i - c.lo].tolist() == [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again)]
            done += 1
    assert done == len(batch)


@given(texts)
@settings(max_examples=60, deadline=None)
def test_shingles(batch):
    for c in C.chunks(pa.array(batch, pa.string())):
        s, d, at = C.shingles(c.hashes(), c.first, 5)
        for i, text in enumerate(batch):
            w = words(text)
            want = [tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))] if w else []
            assert len(set(s[d == i].tolist())) == len(set(want)) and (d == i).sum() == len(want)
        assert (np.diff(at) > 0).all()


def test_bag_minhash_is_unbiased_and_consistent():
    rng = np.random.default_rng(0)
    items = rng.integers(0, 2**63, 150).astype(np.uint64)
    w1 = rng.integers(1, 60, 150)
    w2 = np.maximum(1, w1 - rng.integers(0, 20, 150))
    true = np.minimum(w1, w2).sum() / np.maximum(w1, w2).sum()
    sig = M.bag_minhash(np.repeat([0, 1], 150), np.tile(items, 2), np.concatenate([w1, w2]), 2, 8000)
    assert abs((sig[0] == sig[1]).mean() - true) < 0.02
    alone = M.bag_minhash(np.zeros(150, np.int64), items, w1, 1, 8000)
    assert (alone[0] == sig[0]).all()  # whatever else is in the batch
    assert np.isinf(M.bag_minhash(np.zeros(0, np.int64), items[:0], w1[:0], 1).view(float)).all()


def test_trees_are_monotone_and_flat():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 3))
    y = ((x[:, 0] < 0.3) & (x[:, 1] ** 2 < 1) ^ (rng.random(1500) < 0.05)).astype(int)
    m = Q.BoostedTrees(x, y, [-1, 0, 0], trees=30)
    assert ((m.probability(x) >= 0.5) == y).mean() > 0.9
    base = rng.normal(size=(200, 3))
    more = base.copy()
    more[:, 0] += np.abs(rng.normal(size=200))
    assert (m.probability(more) <= m.probability(base) + 1e-12).all()
    # Flattened arrays score as walking each tree does.
    for row in base[:20]:
        total = m.start
        for t in range(30):
            at = 0
            while at < 2**m.depth - 1:
                at = 2 * at + 1 + (row[m.feature[t, at]] > m.cut[t, at])
            total += m.value[t, at]
        assert abs(m.probability(row[None])[0] - 1 / (1 + np.exp(-total))) < 1e-12
    assert (Q.BoostedTrees(x, np.ones(1500, int), [0, 0, 0]).probability(x) > 0.99).all()


def test_bradley_terry_ranks():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(800, 4))
    y = (x[:, 0] - 0.5 * x[:, 1] > -0.8).astype(int)
    m = B.BradleyTerry(x, y, pairs=5000)
    s = m.score(x)
    assert ((s >= B.CUT) == y).mean() > 0.97 and 0 <= s.min() and s.max() <= 1
    assert (B.BradleyTerry(x, np.ones(800, int)).score(x) == 1).all() and (B.BradleyTerry(x[:0], y[:0]).score(x) == 1).all()


def test_chain_against_quadratic_search():
    rnd = random.Random(4)
    for _ in range(150):
        n = rnd.randint(2, 25)
        pairs = sorted({(rnd.randint(0, 60), rnd.randint(0, 60)) for _ in range(n)})
        x, y = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
        best = [0.0] * len(x)
        for i in range(len(x)):
            gains = [best[j] - U.GAP * (x[i] - x[j] + y[i] - y[j]) for j in range(i) if x[j] < x[i] and y[j] < y[i]]
            best[i] = U.SEED + max([0.0, *gains])
        made = U.chain(x, y)
        score = lambda c: sum(U.SEED - (U.GAP * (c[0][i] - c[0][i - 1] + c[1][i] - c[1][i - 1]) if i else 0) for i in range(len(c[0])))
        assert max(map(score, made)) == pytest.approx(max(best))
        assert all((np.diff(c[0]) > 0).all() and (np.diff(c[1]) > 0).all() for c in made)


def test_winnowing_guarantee():
    rng = np.random.default_rng(5)
    s = rng.integers(0, 50, 400).astype(np.uint64)
    doc = np.sort(rng.integers(0, 4, 400))
    keep = set(U.winnow(s, doc).tolist())
    for i in range(400 - U.SPAN + 1):
        if doc[i] == doc[i + U.SPAN - 1]:
            w = s[i : i + U.SPAN]
            assert i + int(np.argmin(w)) in keep
    for d in np.unique(doc):
        assert any(doc[k] == d for k in keep)


def test_align():
    a = np.arange(100, 160, dtype=np.uint32)
    b = np.concatenate([np.arange(60, 70), a[:30], [7], a[31:], np.arange(5)]).astype(np.uint32)
    got = U.align(a, b, np.array([3, 40]), np.array([13, 50]))
    assert got[:4] == (0, 60, 10, 70) and got[4] == pytest.approx(59 / 60)
    assert U.align(a, b, np.array([3]), np.array([14])) is None


def test_common_share_is_lcs():
    rnd = random.Random(6)
    for _ in range(100):
        a, b = ([rnd.randint(0, 5) for _ in range(rnd.randint(1, 20))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, p in enumerate(a):
            for j, q in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if p == q else max(t[i][j + 1], t[i + 1][j])
        x, y = np.array(a, np.uint64), np.array(b, np.uint64)
        assert D._common_share(x, y) == pytest.approx(t[-1][-1] / len(a)) and U._lcs(x, y) == t[-1][-1]
    assert D._common_share(np.zeros(0, np.uint64), np.ones(1, np.uint64)) == 1


def test_gathered_sums():
    rng = np.random.default_rng(7)
    table, rows, at = rng.normal(size=(9, 3)), rng.integers(0, 9, 40), np.sort(rng.integers(0, 6, 40))
    want = np.zeros((6, 3))
    np.add.at(want, at, table[rows])
    assert np.allclose(D._gathered(table, rows, at, 6), want) and D._gathered(table, rows[:0], at[:0], 2).shape == (2, 3)


def test_minimum_cut():
    rnd = random.Random(8)
    for _ in range(200):
        n = rnd.randint(1, 9)
        net = [rnd.uniform(-3, 3) for _ in range(n)]
        edges = [(a, b, rnd.uniform(0, 2)) for a in range(n) for b in range(a + 1, n) if rnd.random() < 0.5]
        cost = lambda on: sum(-v for v, o in zip(net, on, strict=True) if o) + sum(w for a, b, w in edges if on[a] != on[b])  # noqa: B023, E731
        assert cost(H.cut(net, edges)) == pytest.approx(min(cost([m >> i & 1 == 1 for i in range(n)]) for m in range(2**n)))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><div id="cookie-banner">We use cookies <button>OK</button></div>
<header><h1>Site</h1><ul><li><a href=/>Home</a><li><a href=/b>Blog</a></ul></header><div class="wrapper"><div class="content"><h1>Real title</h1><p>First para with some <b>bo</b>ld text,
and&nbsp;more words here.<p>Second &amp; third, 5 < 6 and so on. This is a long paragraph of content.</p><div class="ad">Buy now!</div><p>Last one. It has a <a href=x>link</a>.</p>
<form>Email <input><button>Go</button></form></div><aside>Related stuff</aside></div><section id="comments"><h2>Comments</h2><article class="comment"><p>Nice post! I really liked this one, thanks for
writing.</p></article></section><footer>(c) 2020</footer><script>var x="<p>no</p>"</script></body></html>"""


def test_main_text():
    w = H.train(np.zeros((0, H.FEATURES)), np.zeros(0))
    assert H.main_text(PAGE, w) == "Real title First para with some bold text, and more words here. Second & third, 5 < 6 and so on. This is a long paragraph of content. Last one. It has a link."
    page = '<nav>Menu</nav><article><h1>A &lt;b&gt;</h1><p>one<br>two<p>three<script>x</p></script></article><div class="ad">Ad</div>'
    assert H.main_text(page, w) == "A <b> one two three"
    assert [H.main_text(p, w) for p in (None, "", "<!-- no end", "<script>x", "<p></p>")] == [""] * 5
    assert H.main_text("<article>" + "<p>word word word word.</p>" * 3000 + "</article>", w).count("word.") == 3000
    assert H.main_text("<article>" + "<div>" * 3000 + "deep text", w) == "deep text"
    with_form = "<form id=f><div><h1>Title of it</h1><p>A long enough paragraph, with words.</p></div></form>"
    assert "paragraph" in H.main_text(with_form, w)


def test_unclosed_skipped_elements_end_with_their_parent():
    w = np.array(H.FIXED)
    assert H.main_text("<div><button>Go</div><article><p>Some text of it.</p></article>", w) == "Some text of it."
    assert H.main_text("<select><option>a<article><p>Some text of it.</p></article>", w) == "Some text of it."
    assert H.main_text("<article><p>Where <math><mi>x</mi></math> is set.</p></article>", w) == "Where x is set."


def stripped(page):
    """Without the tags and names that mark a landmark."""
    page = re.sub(r"<(/?)(article|main|nav|aside|footer|header|form|section|menu|dialog)\b[^>]*>", r"<\1div>", page)
    return re.sub(r"\s(class|id|role)=(\"[^\"]*\"|'[^']*'|[^\s>]+)", "", page)


def test_the_cut_decides():
    """Costs that are made unsure: the cut changes labels, and nearly all of these changes are right."""
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist()
    rows, truth = [], []
    for page in pages[:120]:
        own = H.blocks(page)
        marks = [H.landmark(b.element)[0] for b in own]
        rows.append(H.features(own, marks))
        truth += [float(m > 0) for m in marks]
    w = H.train(np.concatenate(rows), np.array(truth))
    rng, whole, changed, better, right, n = np.random.default_rng(3), 0, 0, 0, 0, 0
    for page in pages[120:]:
        own, bare = H.blocks(page), H.blocks(stripped(page))
        want = [H.landmark(b.element)[0] > 0 for b in own]
        assert H.labels(own, w) == want and len(own) == len(bare)
        whole += H.labels(bare, w) == want
        net, edges = H.graph(bare, w)
        net = [v + x for v, x in zip(net, rng.normal(0, 2.5, len(net)), strict=True)]
        got = H.cut(net, edges)
        moved = [i for i, v in enumerate(net) if (v > 0) != got[i]]
        changed, better, right, n = changed + len(moved), better + sum(got[i] == want[i] for i in moved), right + sum(g == x for g, x in zip(got, want, strict=True)), n + len(got)
    assert whole >= 0.97 * (len(pages) - 120)  # pages without any landmark
    assert changed >= 0.02 * n and better >= 0.75 * changed and right >= 0.9 * n, (changed, better, right, n)


def test_languages_in_two_steps():
    rnd = random.Random(9)
    vocabulary = {"en": "the and with that this", "de": "der und mit nicht schon", "fr": "le avec pour dans être", "es": "el los para como año", "xx": "zq qz qqz zzq"}
    make = lambda lang: " ".join(rnd.choice(vocabulary[lang].split()) for _ in range(30))
    langs = [lang for lang in vocabulary for _ in range(60)]
    feats = lambda ts: np.concatenate([L.features(c) for c in C.chunks(pa.array(ts), folded=True)])
    m = L.Languages(feats([make(x) for x in langs]), langs)
    assert m.families == ["germanic", "romance", "xx"] and len(m.pairs) == 2
    at, score = m.predict(feats([make(x) for x in langs]))
    assert (np.array(m.langs)[at] == langs).mean() > 0.98 and score.min() >= 0 and score.max() <= 1
    one = L.Languages(feats(["abc"]), ["yy"])
    assert one.predict(feats(["anything"]))[0].tolist() == [0]
    assert L._lettered(pa.array(["12 ²", None, "", "é", "x"])).tolist() == [False, False, False, True, True]


@given(st.lists(st.lists(st.integers(0, 9)), max_size=9))
def test_loser_tree(runs):
    runs = [sorted(r) for r in runs]
    assert list(W.loser_tree(runs)) == sorted(x for r in runs for x in r)


def test_parse_is_by_length_alone():
    block = b"a\r\n\r\nWARC/1.1\r\n\r\n"
    one = b"WARC/1.1\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(block), block)
    stream = one * 3
    for size in (1, 7, 1000):
        got = list(W.parse(iter([stream[i : i + size] for i in range(0, len(stream), size)])))
        assert [g[2] for g in got] == [block] * 3 and [g[0] for g in got] == [0, len(one), 2 * len(one)]
    with pytest.raises(ValueError):
        list(W.parse(iter([stream[:-1]])))


def test_records_end_however_payloads_do():
    """Payloads that end in 0 to 4 CRLFs, each in a file of its own, as Spark's text reader cuts them."""
    for tail in range(5):
        block = b"HTTP/1.1 200 OK\r\n\r\n" + b"<p>hi</p>" + b"\r\n" * tail
        whole = (b"WARC/1.1\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(block), block)).decode()
        cut = whole.split("\r\n\r\n")
        cut = cut[:-1] if not cut[-1] else cut  # nothing tells whether a delimiter stood at the end
        got = list(W.parse(iter([("" if i == 0 else "\r\n\r\n").encode() + x.encode() for i, x in enumerate(cut)]), open_end=True))
        assert [g[2] for g in got] == [block], tail


def test_url_keys():
    assert W.url_key("https://www.B.example.com/Q?b=1&a=2#f") == W.url_key("http://b.example.com/q?a=2&b=1") == "com,example,b)/q?a=2&b=1"
    assert W.url_key(None) == "" and W.url_key("http://[bad")


def test_unit_is_sql():
    assert "md5" in mixing.unit("'a'")


def test_align_goes_on_over_edits():
    """Passages of 50 to 100 words with an edit at every position: the span is that between the outermost equal words."""
    rng = np.random.default_rng(8)
    for n in (50, 60, 100):
        for at in range(n):
            a = rng.integers(1 << 20, 1 << 30, n + 40).astype(np.uint32)
            b = rng.integers(1 << 20, 1 << 30, n + 50).astype(np.uint32)
            b[30 : 30 + n] = a[20 : 20 + n]
            b[30 + at] = 7
            seed = n // 2 if abs(at - n // 2 - 2) > 8 else n // 4
            got = U.align(a, b, np.array([20 + seed]), np.array([30 + seed]))
            same = [i for i in range(n) if i != at]
            assert got[:4] == (20 + same[0], 21 + same[-1], 30 + same[0], 31 + same[-1])
            assert got[4] == pytest.approx(len(same) / (same[-1] - same[0] + 1))


def test_alignment_of_merged_matches_equals_that_of_single_ones(monkeypatch):
    rng = np.random.default_rng(5)
    single = lambda a, b, xs, ys: [(i, j, U.SEED) for i, j in zip(xs.tolist(), ys.tolist(), strict=True)]
    seen = 0
    for vocabulary in (3, 8, 50, 5000) * 40:
        a = rng.integers(0, vocabulary, 200).astype(np.uint32)
        b = np.concatenate([rng.integers(0, vocabulary, 20).astype(np.uint32), np.delete(a, rng.integers(0, 200, 6))])
        b[rng.integers(0, len(b), 8)] = rng.integers(0, vocabulary, 8)
        at = {}
        for j in range(len(b) - U.SEED + 1):
            at.setdefault(b[j : j + U.SEED].tobytes(), j)
        found = [(i, at[w]) for i in range(len(a) - U.SEED + 1) if (w := a[i : i + U.SEED].tobytes()) in at]
        if not found:
            continue
        for xs, ys in U.chain(*np.array(found).T):
            merged = U.align(a, b, xs, ys)
            with monkeypatch.context() as m:
                m.setattr(U, "_blocks", single)
                assert U.align(a, b, xs, ys) == merged
            seen += merged is not None
    assert seen > 100
