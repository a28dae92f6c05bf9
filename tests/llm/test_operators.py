"""The operators on Spark: edge cases, clashing columns, and brute force on a small fixture."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from appendlake.llm import _common as C
from appendlake.llm import decontaminate, docstats, html_extract, language_id, license_scan, minhash_dedup, mixing, quality_classifier, quality_rules, registry, substring_dedup, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, node string, k int, score string"
PASSAGE = " ".join(f"w{i * 7919 % 1009}x" for i in range(70))


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def odd(spark):
    """Rows with nulls in any column, empty and long texts, ties, repeats, and extra columns with names that the operators use."""
    long = " ".join(f"l{i * 31 % 7001}" for i in range(30_000))
    near = PASSAGE.split()
    near[40] = "other"
    rows = [
        (1, PASSAGE, "en", "a"), (2, PASSAGE, "en", None), (2, PASSAGE, "en", None), (3, " ".join(near), "en", "a"), (4, None, None, "a"), (5, "", "en", "b"), (6, " \n\t", "de", "b"), (7, "", None, "b"),
        (None, PASSAGE, "en", "a"), (None, None, None, None), (8, long, "en", "a"), (9, "intro words here " + long, "en", "c"), (10, "one two", "fr", "c"), (11, "one two", "fr", "c"), (12, "été à la carte " * 12, "fr", "c"),
    ]
    return spark.createDataFrame([(i, t, g, s, len(t or ""), "x", 1, "y") for i, t, g, s in rows], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def empty(spark, df):
    return spark.createDataFrame([], df.schema)


def brute_classes(rows):
    bags = [Counter(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if (w := words(t)) else Counter() for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (_, s) in enumerate(rows):
        for j in range(i):
            t = rows[j][1]
            both = sum((bags[i] & bags[j]).values())
            if s is not None and t is not None and (s == t or (both and both >= 0.8 * (bags[i].total() + bags[j].total() - both))):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    named = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        named[find(i)].append(d)
    return sorted(((d, min((x for x in named[find(i)] if x is not None), default=None)) for i, (d, _) in enumerate(rows)), key=str)


def test_near_duplicates(spark, docs, odd):
    for df in (docs, odd):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        got = minhash_dedup.NearDuplicates(spark, df).classes().collect()
        assert sorted(((r.doc_id, r.class_id) for r in got), key=str) == brute_classes(rows)
    kept = minhash_dedup.keep_one(spark, odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [1, 4, 5, 6, 8, 10, 12]
    assert minhash_dedup.keep_one(spark, empty(spark, odd)).count() == 0


def test_near_duplicates_of_a_large_group(spark):
    """Variants of one text in chains and stars, and outsiders that share buckets with them: no link is lost."""
    import random

    rnd, base, rows = random.Random(1), [f"b{i}" for i in range(60)], []
    for i in range(70):
        w = list(base)
        for _ in range(rnd.choice([0, 1, 1, 2, 3, 5])):
            w[rnd.randrange(60)] = f"e{rnd.randrange(400)}"
        rows.append((i, " ".join(w)))
    got = minhash_dedup.NearDuplicates(spark, spark.createDataFrame(rows, "doc_id long, text string")).classes().collect()
    assert sorted(((r.doc_id, r.class_id) for r in got), key=str) == brute_classes(rows)


def test_near_duplicates_of_two_thousand_variants(spark):
    """A group of which most pairs are near the similarity: classes are those of all pairs."""
    import random

    rnd, base, rows = random.Random(2), [f"b{i}" for i in range(80)], []
    for i in range(2000):
        w = list(base)
        for _ in range(rnd.choice([0, 1, 2, 2, 3, 4])):
            w[rnd.randrange(80)] = f"e{rnd.randrange(10_000)}"
        rows.append((i, " ".join(w)))
    got = dict((r.doc_id, r.class_id) for r in minhash_dedup.NearDuplicates(spark, spark.createDataFrame(rows, "doc_id long, text string")).classes().collect())
    # All pairs at once: the bags are sets here, and their overlaps a product of incidence vectors.
    import numpy as np

    names = {}
    at = [[names.setdefault(tuple(w[j : j + 5]), len(names)) for j in range(76)] for w in (t.split() for _, t in rows)]
    x = np.zeros((2000, len(names)), np.float32)
    for i, a in enumerate(at):
        x[i, a] = 1
    both = x @ x.T
    linked, label = both >= 0.8 * (152 - both) - 1e-3, np.arange(2000)
    while True:
        new = np.array([label[linked[i]].min() for i in range(2000)])
        if (new == label).all():
            break
        label = new
    assert [got[i] for i in range(2000)] == label.tolist()


def test_keep_one_goes_by_text(spark):
    """Rows that share an id but not a text, rows without one, and copies under several ids: each different text stays once."""
    far = " ".join(f"z{i}" for i in range(70))
    other = " ".join(f"y{i}" for i in range(70))
    rows = [(5, PASSAGE, {"a": 1}), (5, far, None), (3, PASSAGE, None), (None, other, None), (None, other, {"b": 2}), (None, far + " more", None), (7, None, None), (7, None, None), (8, "x", {"q": 1}), (8, "x", {"p": 1})]
    df = spark.createDataFrame(rows, "doc_id int, text string, node map<string,int>")
    kept = minhash_dedup.keep_one(spark, df)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text, r.node) for r in kept.collect()), key=str) == sorted([(3, PASSAGE, None), (5, far, None), (None, other, {"b": 2}), (7, None, None), (7, None, None), (8, "x", {"p": 1})], key=str)


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (200, 200)]
    got = C.components(C.Scratch(spark, "t"), spark.createDataFrame(chain, "a long, b long"), "cc").collect()
    assert {(r.node, r.comp) for r in got} == {(i, 0) for i in range(41)} | {(i, 100) for i in (100, 101, 102)}


def test_substring(spark, docs, odd):
    got, _ = substring_dedup.spans(C.Scratch(spark, "t"), substring_dedup._keyed(docs))
    covered = defaultdict(set)
    for r in substring_dedup.passages(got).collect():
        covered[r.k].update(range(r.a, r.b))
    seen, want = {}, defaultdict(set)
    for r in docs.orderBy("doc_id").collect():
        w = words(r.text)
        own = set()
        for j in range(len(w) - 59):
            x = tuple(w[j : j + 60])
            if x in seen:
                want[r.doc_id].update(range(j, j + 60))
            own.add(x)
        seen.update(dict.fromkeys(own - seen.keys(), r.doc_id))
    assert want
    for d, at in want.items():
        assert len(at - covered[d]) <= 0.02 * len(at)
    cut = substring_dedup.cut_repeats(spark, odd)
    assert cut.columns == odd.columns
    out = sorted(((r.doc_id, r.text, r.n_chars) for r in cut.collect()), key=str)
    by = defaultdict(list)
    for d, t, n in out:
        by[d].append(t)
        assert t is None or n == len(t)
    assert by[1] == [] and by[2] == [] and by[3] == []  # the row with a null id comes first
    assert by[None] and PASSAGE in by[None] and by[9] == ["intro words here "] and len(words(by[8][0])) == 30_000 and by[5] == [""] and by[4] == [None]
    assert substring_dedup.cut_repeats(spark, empty(spark, odd)).count() == 0


def test_leaks(spark, docs, odd):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(spark, docs, bench).collect()}
    want, maybe = set(), set()
    items = [(r.item_id, decontaminate._folded(r.text)) for r in bench.collect()]
    for r in docs.collect():
        w = decontaminate._folded(r.text)
        for i, item in items:
            runs = any((w[j : j + len(item)] == item).all() for j in range(len(w) - len(item) + 1))
            if runs:
                want.add((r.doc_id, i))
            elif decontaminate._common_share(item, w) >= decontaminate.COMMON:
                maybe.add((r.doc_id, i))
    assert want and len(got & want) >= 0.9 * len(want) and want <= got and got <= want | maybe
    b = spark.createDataFrame([(1, "some words of it. " + " ".join(PASSAGE.split()[5:45]), "x"), (2, None, "x"), (3, "", None), (4, "!!", None)], "item_id long, text string, node string")
    kept = decontaminate.drop_leaks(spark, odd, b)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.where("doc_id is not null").collect()} == {4, 5, 6, 7, 8, 9, 10, 11, 12}
    assert decontaminate.drop_leaks(spark, odd, b.where("item_id > 1")).count() == odd.count()
    assert decontaminate.drop_leaks(spark, empty(spark, odd), b).count() == 0


def test_leaks_go_by_text(spark):
    item = " ".join(PASSAGE.split()[5:45])
    rows = [(None, PASSAGE), (None, "clean words here"), (None, None), (5, PASSAGE), (5, "other clean words"), (6, "more"), (5, PASSAGE)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = decontaminate.drop_leaks(spark, df, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(None, "clean words here"), (None, None), (5, "other clean words"), (6, "more")], key=str)
    assert decontaminate.leaks(spark, df, df.selectExpr("doc_id as item_id", "text").limit(0)).count() == 0


def test_reworded_leaks(spark, docs):
    """Items of 10 to 60 words with every 8th word changed, each put into a document: most are found."""
    import random

    rnd, n = random.Random(6), 300
    texts = [r.text.split() for r in docs.where("n_chars > 600").orderBy("doc_id").collect()]
    vocabulary = [w for t in texts for w in t]
    items = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(10, 60)))) for i in range(n)]
    edit = lambda item: " ".join(w if j % 8 != 3 else f"new{j}" for j, w in enumerate(item.split()))
    hosts = [(i, " ".join([*texts[i % len(texts)][:60], edit(item), *texts[i % len(texts)][60:120]])) for i, item in items]
    got = decontaminate.leaks(spark, spark.createDataFrame(hosts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    found = {r.doc_id for r in got.where("doc_id = item_id").select("doc_id").collect()}
    last = lambda item: decontaminate._folded(item)
    want = {i for (i, item), (_, host) in zip(items, hosts, strict=True) if decontaminate._common_share(last(item), last(host)) >= decontaminate.COMMON}
    assert len(found & want) >= 0.9 * len(want) and len(want) > 0.9 * n


def test_paraphrased_leak(spark, docs):
    item = docs.where("n_chars > 600 and lang = 'en'").orderBy("doc_id").first().text.split()[:40]
    changed = [w if i % 9 else "reworded" for i, w in enumerate(item)]
    text = " ".join(["before"] * 20 + changed + ["after"] * 30)
    some = docs.limit(60).select("doc_id", "text").unionByName(spark.createDataFrame([(9_999, text)], "doc_id long, text string"))
    b = spark.createDataFrame([(1, " ".join(item), " ".join(item[-6:]))], "item_id long, text string, answer string")
    assert (9_999, 1) in {(r.doc_id, r.item_id) for r in decontaminate.leaks(spark, some, b).collect()}
    b = b.withColumn("answer", F.lit("an answer that is not there at all"))
    assert 9_999 not in {r.doc_id for r in decontaminate.leaks(spark, some, b).collect()}


def test_quality(spark, docs, labels, odd):
    held = lambda d: zlib.crc32(str(d if d is not None else "null").encode()) % 5 == 0
    rows = registry.QUERIES["op9_quality_classifier"](spark, SF).join(labels, "doc_id").collect()
    assert all(r.held_out == held(r.doc_id) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    test = [r for r in rows if r.held_out]
    assert sum(r.predicted == r.quality for r in test) >= 0.8 * len(test)
    rules = registry.QUERIES["op2_quality_rules"](spark, SF).collect()
    assert len(rules) == docs.count() and not any(r.kept and r.base_failed for r in rules) and sum(r.kept for r in rules) > 0.7 * len(rules)
    for bad in (labels.limit(0), spark.createDataFrame([(None, None), (1, 1)], "doc_id long, quality int")):
        kept = quality_classifier.keep_good(spark, odd, bad)
        assert kept.count() == odd.count() and kept.columns == odd.columns
        judged = quality_rules.judge(odd, quality_rules.fit(odd, bad)).collect()
        assert len(judged) == odd.count() and {r.doc_id for r in judged if r.kept} == {r.doc_id for r in judged if r.n_words == 70} == {None, 1, 2, 3}
    # The verdict against walking each tree over the same statistics, and against the labels of the fold that isn't learnt from.
    trees = quality_rules.fit(docs, labels)
    by_id = {r.doc_id: r for r in rules}
    import numpy as np
    import pyarrow as pa

    for r in docs.orderBy("doc_id").limit(60).collect():
        c = next(C.chunks(pa.array([r.text], pa.string())))
        base, x = docstats.features(c)
        total = trees.start
        for t in range(len(trees.cut)):
            at = 0
            while at < 2**trees.depth - 1:
                at = 2 * at + 1 + (x[0, trees.feature[t, at]] > trees.cut[t, at])
            total += trees.value[t, at]
        bad = base[0, 0] < 50 or 100 * base[0, 4] > 50 * base[0, 0]
        assert by_id[r.doc_id].base_failed == bad and by_id[r.doc_id].kept == (not bad and 1 / (1 + np.exp(-total)) >= quality_rules.VERDICT)
    known = [(r, by_id[r.doc_id].kept) for r in labels.collect() if held(r.doc_id) and not by_id[r.doc_id].base_failed]
    assert sum(k == (r.quality == 1) for r, k in known) >= 0.8 * len(known)
    assert quality_rules.judge(empty(spark, odd), trees).count() == 0
    model = quality_classifier.fit(docs, labels)
    # Scores against the model's own formula, text by text.
    scores = {r.doc_id: r.score for r in registry.QUERIES["op9_quality_classifier"](spark, SF).collect()}
    for r in docs.orderBy("doc_id").limit(60).collect():
        x = np.clip(docstats.features(next(C.chunks(pa.array([r.text], pa.string()))))[1][0], model.low, model.high)
        raw = [*x, *(max(v - k, 0) for row in model.knots for v, k in zip(x, row, strict=True))]
        worth = sum((v - m) / s * w for v, m, s, w in zip(raw, model.mean, model.std, model.w, strict=True))
        assert scores[r.doc_id] == pytest.approx(1 / (1 + np.exp(-(3 * (worth - model.cut) / model.scale + np.log(3 / 7)))), abs=1e-9)
    assert quality_classifier.keep_good(spark, empty(spark, odd), labels).count() == 0
    assert quality_classifier.scored(odd.select("doc_id", "text"), model, "doc_id long", ["doc_id"]).count() == odd.count()


def test_quality_learns_from_all_labels(spark, tmp_path, monkeypatch):
    """21,000 labelled documents, of which the 200 of a rare kind, told by digits alone, hash beyond the first 20,000: fitted sums are those of all rows in memory."""
    import numpy as np

    ids = [r.id for r in spark.range(26_000).where("crc32(cast(cast(id as string) as binary)) % 5 <> 0").orderBy(F.xxhash64("id"), "id").collect()]
    assert len(ids) > 20_200
    rows = [(i, f"plain words of text {'and 12345 digits' if k >= len(ids) - 200 else 'and nothing else'} here {'word ' * (i % 7)}", int(k < len(ids) - 200)) for k, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    monkeypatch.setattr(C, "shared_dir", lambda _: str(tmp_path))
    model = quality_classifier.fit(df, df)
    assert model.trained
    _, x, y = docstats.labelled(df, df, "quality", len(rows))
    assert ((model.score(x) >= quality_classifier.CUT) == y).all() and len(y) == len(rows)
    want = quality_classifier.BradleyTerry(x, y)
    assert (model.low == want.low).all() and (model.knots == want.knots).all() and np.allclose(model.mean, want.mean)
    assert np.allclose(want.knots, np.quantile(x, quality_classifier.HINGES, axis=0, method="lower"), rtol=1e-5)


def test_labels_repeat(spark, docs):
    many = spark.createDataFrame([(r.doc_id, q) for r in docs.limit(5).collect() for q in (1, 0, None)], "doc_id long, quality int")
    _, _, y = docstats.labelled(docs.unionByName(docs), many, "quality")
    assert len(y) <= 5 and not y.any()


def test_languages(spark, docs, odd):
    got = registry.QUERIES["op5_language_id"](spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.95 * len(got)
    # Each prediction against the two steps done one text at a time.
    import pyarrow as pa

    model = language_id.fit(docs)
    by_id = {r.doc_id: r.lang_pred for r in language_id.identify(docs, model).collect()}
    for r in docs.orderBy("doc_id").limit(40).collect():
        if by_id[r.doc_id] == "und":
            continue
        x = language_id.features(next(C.chunks(pa.array([r.text]), folded=True)))[0]
        value = lambda w: float(x @ w[:-1] + w[-1])  # noqa: B023, E731
        family = max(range(len(model.families)), key=lambda g: value(model.family[g]))
        votes = Counter({i: 0 for i in model.members[family]})
        for (a, b), w in model.pairs.items():
            if a in votes:
                votes[a if value(w) > 0 else b] += 1
        best = max(votes.values())
        assert by_id[r.doc_id] in {model.langs[i] for i, n in votes.items() if n == best}
    assert language_id.identify(empty(spark, odd), model).count() == 0 and language_id.fit(empty(spark, odd)).langs == []
    many = spark.range(12_000).selectExpr("id as doc_id", "concat('word number ', id) as text", "if(id % 100 < 99, 'en', 'de') as lang")
    plan = language_id.fit(many)
    assert plan.langs == ["de", "en"]
    model = language_id.fit(odd)
    rows = language_id.identify(odd, model).collect()
    assert len(rows) == odd.count()
    assert all((r.lang_pred == "und") == (r.doc_id in (4, 5, 6, 7)) for r in rows if r.doc_id is not None)
    assert language_id.identify(odd, language_id.fit(odd.where("lang is null"))).where("lang_pred <> 'und'").count() == 0


def test_licenses(spark, odd):
    mit = license_scan._MIT
    texts = [
        mit, "Copyright (c) 2020 Some One\n\n" + mit.upper().replace('"', "''"), "MIT License\n\nCopyright 2021-2023 A. B.\n(c) 2024 C\n\n" + mit.replace("\n", "\n * "), mit + " and more", None, "", "?!",
        "text\nReleased under the MIT Licence.\nAll rights reserved", license_scan._BSD_HEAD + license_scan._BSD_TAIL.replace("HOLDER ", "OWNER "),
    ]
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id int, text string, digest string")
    got = {r.doc_id: r for r in license_scan.scan(spark, df).collect()}
    assert [got[i].license for i in range(9)] == ["MIT", "MIT", "MIT", None, None, None, None, None, "BSD-2-Clause"]
    assert got[4].digest is None and got[5].digest == got[6].digest == hashlib.sha256(b"").hexdigest() and got[7].notices == "LicenseRef-all-rights-reserved,MIT"
    assert license_scan.scan(spark, empty(spark, odd)).count() == 0 and license_scan.scan(spark, odd).count() == odd.count()
    own = spark.createDataFrame([("X", "one two"), ("A", "One, two!"), (None, "x"), ("B", None)], "license string, text string")
    assert {r.license for r in license_scan.scan(spark, odd, own, own).where("doc_id in (10, 11)").collect()} == {"A"}
    plan = license_scan.scan(spark, df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    got = registry.QUERIES[name](spark, SF).toPandas()
    want = con.sql(registry.ORACLE_SQL[name]).df()
    rows = lambda f: sorted(map(str, f[sorted(f.columns)].astype(object).where(f[sorted(f.columns)].notna(), None).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


def test_licence_spellings_may_follow_each_other(spark):
    texts = ["licence licence sub license\nsub-licence", "license license sublicense\nsublicense", "licence, Licences (owner) owner", "license licenses holder holder", "whilst per-cent\npercent x"]
    got = [r.digest for r in license_scan.scan(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).orderBy("doc_id").collect()]
    assert got[0] == hashlib.sha256(b"license license sublicense sublicense").hexdigest() and got[2] == got[3] and got[4] == hashlib.sha256(b"while per cent per cent x").hexdigest()


def test_mixing_keeps_clashing_columns(spark):
    df = spark.createDataFrame([(i, "a", f"t {i}", 77, "k") for i in range(50)], "doc_id long, source string, text string, copy int, SHUFFLE_KEY string")
    out = mixing.replicate(df)
    assert out.columns == [*df.columns, "copy_", "shuffle_key_"] and {r.copy for r in out.collect()} == {77}


def test_mixing(spark, odd):
    weights = spark.createDataFrame([("a", 1.0), ("a", 1.0), (None, 1.0), ("c", 0.0), ("new", 5.0)], "source string, weight double")
    rate = {r.source: r.rate for r in mixing.rates(odd, weights).collect()}
    size = Counter()
    for r in odd.collect():
        size[r.source] += len(r.text or "")
    total = size["a"] + size[None]
    assert rate["a"] == pytest.approx(2 / 3 * total / size["a"]) and rate[None] == pytest.approx(1 / 3 * total / size[None]) and rate["c"] == 0 and "b" not in rate
    out = mixing.replicate(odd, weights)
    assert out.columns == [*odd.columns, "copy", "shuffle_key"]
    rows = out.collect()
    assert [r.shuffle_key for r in rows] == sorted(r.shuffle_key for r in rows) and {r.source for r in rows} <= {"a", None}
    assert rows == mixing.replicate(odd.repartition(3), weights).collect() or sorted(map(str, rows)) == sorted(map(str, mixing.replicate(odd.repartition(3), weights).collect()))
    assert mixing.replicate(empty(spark, odd)).count() == 0
    # The numbers are Poisson: mean and variance of many draws at a rate beyond one step.
    many = spark.range(4000).selectExpr("id as doc_id", "1 as one").withColumn("r", F.lit(11.5)).withColumn("n", mixing._count("r", 1))
    mean, var = many.agg(F.avg("n"), F.var_samp("n")).first()
    assert abs(mean - 11.5) < 0.25 and abs(var - 11.5) < 1.2


def test_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in registry.QUERIES["op8_html_extract"](spark, SF).collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S).group(1)
        inner = re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1|br|div|ul|li)[^>]*>", " ", inner))
        import html

        want = " ".join(html.unescape(inner).split())
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want) and got[r.page_id].url == r.url
    odd = spark.createDataFrame([(1, None, None, "t"), (1, None, None, "t"), (None, "u", "<p>x", "t"), (2, "u", "", "t")], "page_id long, url string, html string, text string")
    assert sorted(((r.page_id, r.n_chars) for r in html_extract.extract(odd, html_extract.fit(odd)).collect()), key=str)[:3] == [(1, 0), (1, 0), (2, 0)]
    assert html_extract.extract(odd.limit(0), html_extract.fit(odd.limit(0))).count() == 0


def test_archives(spark):
    big = "é" * 700
    rows = [
        (1, "http://a/", "x\r\n\r\n"), (2, None, None), (None, "u", "\r\n\r\n\r\n"), (4, "http://WWW.b.com/Q?b=1&a=2#f", "WARC/1.1\r\nContent-Length: 5\r\n\r\n" * 3 + "\r\n"), (5, "v\r\n w", "\r\n"), (6, "v", big), (7, "v", big),
        (7, "v", big), (None, "v", big), (8, "q", ""), (9, "q", "y" * 999), (10, "q", "y" * 999), (11, "q", "z" * 1000), (12, "q", "z" * 1000),
    ]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, digest string")
    for n in (1, 5):
        s = C.Scratch(spark, "t")
        warc.write_archives(spark, pages.repartition(n), f"{s.root}/a")
        got = warc.index(s, warc.read_archives(spark, f"{s.root}/a")).orderBy("position").collect()
        assert [r.position for r in got] == list(range(len(rows)))
        assert [(r.urlkey, r.ts) for r in got] == sorted((r.urlkey, r.ts) for r in got)
        want = []
        for p, _, h in rows:
            raw = (h or "").encode()
            top = max((q for q, _, g in rows if q is not None and (g or "").encode() == raw), default=None)
            again = len(raw) >= 1000 and p != top
            want.append((p, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", top if again else None))
        assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == sorted(want, key=str)
    for tail in range(5):  # a file of its own each
        s = C.Scratch(spark, "t")
        one = spark.createDataFrame([(1, "u", "<p>hi</p>" + "\r\n" * tail)], "page_id long, url string, html string")
        warc.write_archives(spark, one, f"{s.root}/a")
        assert [r.payload_bytes for r in warc.read_archives(spark, f"{s.root}/a").collect()] == [9 + 2 * tail]
    s = C.Scratch(spark, "t")
    warc.write_archives(spark, pages.limit(0), f"{s.root}/a")
    assert warc.index(s, warc.read_archives(spark, f"{s.root}/a")).count() == 0


def test_substring_fetches_more_words(spark):
    """A run of equal words, then 120 words without a common seed of which four in five are equal: further than PAD."""
    first = [f"p{i}" for i in range(160)]
    second = [f"q{i}" if i >= 40 and i % 5 == 1 else w for i, w in enumerate(first)]
    frame = lambda x: " ".join([*(f"{x}a{i}" for i in range(30)), *(first if x == "x" else second), *(f"{x}b{i}" for i in range(30))])
    df = spark.createDataFrame([(1, frame("x")), (2, frame("y"))], "doc_id long, text string")
    got, _ = substring_dedup.spans(C.Scratch(spark, "t"), substring_dedup._keyed(df))
    assert [(r.k, r.a, r.b, r.src) for r in substring_dedup.passages(got).collect()] == [(2, 30, 190, 1)]


def test_substring_of_frequent_lines(spark):
    """Passages in two documents made of lines that earlier documents have one by one: each passage is found."""
    rows, want, n = [], {}, 1000
    for t in range(40):
        lines = [" ".join(f"t{t}l{i}w{j}" for j in range(15)) for i in range(4)]
        rows += [(t * 4 + i, f"{line} other{t * 4 + i}") for i, line in enumerate(lines)]
        rows += [(n, " ".join([f"a{n}", *lines, f"b{n}"])), (n + 1, " ".join([f"a{n + 1}", *lines, f"b{n + 1}"]))]
        want[n + 1] = (1, 61)
        n += 2
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got, _ = substring_dedup.spans(C.Scratch(spark, "t"), substring_dedup._keyed(df))
    found = {r.k: (r.a, r.b) for r in substring_dedup.passages(got).collect()}
    assert {k: found.get(k) for k in want} == want


def test_substring_of_scattered_parts(spark):
    """Passages of 50 words in two documents, all parts of which earlier documents have: each is found, and whole."""
    import random

    rnd, rows, want, n = random.Random(3), [], {}, 100_000
    for t in range(20):
        w = [f"t{t}w{i}" for i in range(50)]
        short, wide = ([w[i : i + size] for i in range(0, 51 - size, 3)] for size in (14, 20))
        rnd.shuffle(wide)
        rows += [(t * 100 + i, " ".join([f"a{t}n{i}", *part, f"b{t}n{i}"])) for i, part in enumerate(short + wide)]
        rows += [(n, " ".join([f"c{n}", *w, f"d{n}"])), (n + 1, " ".join([f"c{n + 1}", *w, f"d{n + 1}"]))]
        want[n + 1] = (1, 51)
        n += 2
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got, _ = substring_dedup.spans(C.Scratch(spark, "t"), substring_dedup._keyed(df))
    found = {r.k: (r.a, r.b) for r in substring_dedup.passages(got).collect()}
    assert {k: found.get(k) for k in want} == want


def test_substring_of_a_chain_with_a_gap(spark):
    """Two passages of 60 words, 20 other words between them in one document and 60 in the other: one chain, of which the parts agree."""
    w = [f"w{i}" for i in range(120)]
    rows = [(1, " ".join([*w[:60], *(f"a{i}" for i in range(20)), *w[60:]])), (2, " ".join([*w[:60], *(f"b{i}" for i in range(60)), *w[60:]]))]
    got, _ = substring_dedup.spans(C.Scratch(spark, "t"), substring_dedup._keyed(spark.createDataFrame(rows, "doc_id long, text string")))
    assert sorted((r.k, r.a, r.b) for r in substring_dedup.passages(got).collect()) == [(2, 0, 60), (2, 120, 180)]


def test_substring_of_edited_passages(spark):
    """Passages of 60 words with every 10th or every 7th word changed."""
    rows, n = [], 100
    for t in range(n):
        w = [f"t{t}w{i}" for i in range(60)]
        step = 10 if t % 2 else 7
        edited = [f"e{t}w{i}" if i % step == step - 1 else x for i, x in enumerate(w)]
        rows += [(t, " ".join([*(f"a{t}x{i}" for i in range(20)), *w])), (n + t, " ".join([*(f"b{t}x{i}" for i in range(20)), *edited]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got, _ = substring_dedup.spans(C.Scratch(spark, "t"), substring_dedup._keyed(df))
    found = {r.k for r in substring_dedup.passages(got).collect()}
    assert found <= set(range(n, 2 * n)) and len(found) >= 0.95 * n


def test_directions_come_from_all_documents(spark, docs):
    """A'A against a plain sum over all passages of 600 documents, and the same however they are partitioned."""
    import numpy as np

    many = docs.unionByName(docs).unionByName(docs).select("text")
    block = decontaminate.Benchmark([(r.item_id, r.text, None) for r in spark.read.parquet(f"{SF}/benchmark.parquet").limit(6).collect()])
    idf = np.linspace(1, 2, block.columns)
    want = Counter()
    for r in many.collect():
        at = block.column[decontaminate._features(decontaminate._folded(r.text))]
        for lo in range(0, len(at), decontaminate.WINDOW):
            row = {f: n * idf[f] for f, n in Counter(x for x in at[lo : lo + decontaminate.WINDOW].tolist() if x >= 0).items()}
            square = sum(v * v for v in row.values())
            for f, v in row.items():
                for g, u in row.items():
                    if f <= g:
                        want[f, g] += v * u / square
    sums = [{(r.f, r.g): r.n for r in decontaminate.moments(many.repartition(n), [block], [idf]).collect()} for n in (1, 7)]
    assert sums[0] == sums[1] and sums[0].keys() == want.keys()
    assert all(sums[0][k] / decontaminate.UNIT == pytest.approx(v, abs=1e-5) for k, v in want.items())


def test_leaks_of_many_short_items(spark, docs):
    """More short items than one block has directions for, each copied word for word into a document."""
    import random

    rnd, n = random.Random(4), 1000
    texts = [r.text.split() for r in docs.where("n_chars > 600").orderBy("doc_id").collect()]
    vocabulary = [w for t in texts for w in t]
    items = [(i, " ".join(rnd.choice(vocabulary) for _ in range(8))) for i in range(n)]
    hosts = [(i, " ".join([*texts[i % len(texts)][:60], item, *texts[i % len(texts)][60:120]])) for i, item in items]
    got = decontaminate.leaks(spark, spark.createDataFrame(hosts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert got.where("doc_id = item_id").select("doc_id").distinct().count() >= 0.95 * n
