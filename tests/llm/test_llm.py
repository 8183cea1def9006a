"""Operators of corpusfreq.llm against brute force, and on nulls, empty, long and repeated rows, empty tables and clashing names."""

import base64
import hashlib
import random
import zlib

import duckdb
import harness
import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from corpusfreq.llm import decontamination, embeddings, htmltext, language_id, lines, minhash, mixing, quality, queries, sampling, toxicity, warc

EXTRA = "doc_id long, text string, lang string, source string, n_chars long, id long, row string, h string, bits string, score double, component string, mix_slot string, _cut string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, ties, and clashing extra columns."""
    long = " ".join(random.Random(1).choices("alpha beta gamma delta epsilon zeta eta theta".split(), k=60_000))
    text = "the quick brown fox jumps over the lazy dog and then it goes home to sleep well"
    rows = [(1, text, "en", "a"), (2, text, "en", "a"), (2, text, "en", "a"), (3, None, "en", None), (4, "", None, "b"), (5, " \n\t ", "de", "b"), (6, long, "en", "a"),
            (7, long + " x", "en", "a"), (None, text, "en", "a"), (8, "!!! 123 ???", "en", "c"), (9, "einmal", None, "c"), (10, "ß퟿𝟘 İ", "de", None)]
    return spark.createDataFrame([(*r, None, 7, "r", "h", None, 0.5, "c", "s", None) for r in rows], EXTRA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], EXTRA)


@pytest.fixture(scope="module")
def con():
    return harness.connect(SF)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, con, name):
    assert harness.difference(queries.queries()[name](spark, SF), con, queries.oracle_sql()[name]) is None


def docs_of():
    return duckdb.sql(f"SELECT d.*, quality, toxic FROM '{SF}/documents.parquet' d LEFT JOIN '{SF}/labels.parquet' USING (doc_id) ORDER BY doc_id").fetchall()


# 8

def test_code_lengths_are_those_of_the_trees():
    sample = {"a": ["abracadabra"], "b": ["banana band"]}
    model = language_id.train(sample)

    def bits(own, text):
        counts = {}
        for t in own:
            t = b"\n\n\n" + t.encode()
            for i in range(3, len(t)):
                for k in range(4):
                    counts.setdefault((k, t[i - k : i]), {}).setdefault(t[i], 0)
                    counts[k, t[i - k : i]][t[i]] += 1
        total, text = 0.0, b"\n\n\n" + text
        for i in range(3, len(text)):
            for k in (3, 2, 1, 0):
                seen = counts.get((k, text[i - k : i]))
                if not seen:
                    continue
                n, kinds = sum(seen.values()), len(seen)
                if text[i] in seen:
                    total -= np.log2(seen[text[i]] / (n + kinds))
                    break
                total -= np.log2(kinds / (n + kinds))
            else:
                total += 8
        return total

    texts = [b"abra", b"bandana", b"zzz", b"x" * 300_000 + b"abra", b""]
    got = model.code_lengths(texts)
    for t, row in zip(texts, got):
        assert np.allclose(row, [bits(sample[k], t) for k in ("a", "b")], rtol=1e-5)


def test_language_held_out(spark):
    rows = queries.op8_language_id(spark, SF).collect()
    truth = {r[0]: r[2] for r in docs_of()}
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97


def test_language_edges(odd, nothing):
    model = language_id.fit(odd)
    got = language_id.identify(odd, model).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got}
    assert all(by[k].lang_pred == "und" and by[k].score == 0 for k in (3, 4, 5, 8)) and by[1].lang_pred == "en"
    assert language_id.identify(nothing, language_id.fit(nothing)).count() == 0
    assert language_id.identify(odd, language_id.fit(nothing)).filter("lang_pred <> 'und'").count() == 0
    assert language_id.keep_identified(odd, model).columns == odd.columns


def test_letters_are_those_of_category_l(spark):
    model = language_id.train({"de": ["das ist ein text"], "en": ["this is a text"]})
    assert language_id.predict(model, ["²½", "Ⅷ①", "123 !?", "x"])[0][:3] == ["und"] * 3


def test_hash_tables():
    keys = np.random.default_rng(2).choice(10**9, 5000, replace=False).astype(np.int64)
    table = language_id._Table(keys)
    assert (table.find(keys) == np.arange(5000)).all() and (table.find(keys + 10**9) == -1).all()


def test_samples_are_bounded(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    classes = docs.select("doc_id", F.when(F.col("doc_id") % 50 == 0, "rare").otherwise("hot").alias("c"))
    got = sampling.bounded_rows(docs, classes, "doc_id", "text", "c", 300, 10).groupBy("_class").count().collect()
    assert {r["_class"]: r["count"] for r in got} == {"rare": 300, "hot": 300}


# 4 and 6

def test_classifiers_held_out(spark):
    rows = docs_of()
    words = "idiot moron scum clown loser trash stupid worthless".split()
    rng = random.Random(5)
    clean = [r[1] for r in rows if len(r[1]) < 5000]
    texts = [t if k % 4 else t + " " + " ".join(rng.sample(words, 3)) for k, t in enumerate(clean * 3)]
    truth = [int(k % 4 == 0) for k in range(len(texts))]
    cut = len(texts) * 2 // 3
    model = toxicity.train(texts[:cut], truth[:cut], ["en"] * cut)
    got = np.array([model.score(t) >= toxicity.THRESHOLD for t in texts[cut:]])
    assert (got == np.array(truth[cut:])).mean() > 0.9


@pytest.mark.parametrize("name, module, label, bound", [("op4_toxicity", toxicity, "toxic", 0.7), ("op6_quality", quality, "quality", 0.5)])
def test_classifier_queries(spark, name, module, label, bound):
    """Every row of the query against a model that is trained here from the rows that its contract allows, one text at a time; labels rank well on held-out rows."""
    sf = SF.replace("0.001", "0.01")
    rows = {r.doc_id: r for r in queries.queries()[name](spark, sf).collect()}
    docs = duckdb.sql(f"SELECT doc_id, text, quality, toxic, lang FROM '{sf}/documents.parquet' LEFT JOIN '{sf}/labels.parquet' USING (doc_id)").fetchall()
    held = {d[0]: zlib.crc32(str(d[0]).encode()) % 3 == 1 for d in docs}
    known = sorted((d for d in docs if not held[d[0]] and d[1] and len(d[1]) <= 20_000), key=lambda d: str(d[0]))
    if name == "op4_toxicity":
        known = [d for d in known if d[3] is not None]
        model = toxicity.train([d[1] for d in known], [d[3] for d in known], [d[4] for d in known])
        score = model.score
    else:
        free = [d[1] for d in sorted(docs, key=lambda d: str(d[0])) if d[1] and len(d[1]) <= 20_000]
        model = quality.train([d[1] for d in known if d[2] == 1], free)
        score = lambda t: model.scores([t])[0]
    assert len(rows) == len(docs) and set(rows[docs[0][0]].asDict()) == {"doc_id", "held_out", "score", "predicted"}
    for d in docs:
        r = rows[d[0]]
        assert abs(r.score - score(d[1])) < 1e-4 and r.held_out == held[d[0]] and r.predicted == int(r.score >= bound)
    col = 3 if label == "toxic" else 2
    one, zero = ([rows[d[0]].score for d in docs if held[d[0]] and d[col] == v] for v in (1, 0))
    assert np.mean([[a > b for b in zero] for a in one]) > 0.9


def test_quality_grams():
    a = quality.grams("The cat sat on the mat. " * 3)
    assert a.shape == (quality.TABLE,) and (quality.grams(None) == 0).all()
    assert np.allclose(a, quality.grams("THE CAT SAT ON THE MAT. " * 3))
    pick = np.full(quality.TABLE, 2)
    some = np.flatnonzero(a)[:2]
    pick[some] = [0, 1]
    assert np.allclose(quality.grams("The cat sat on the mat. " * 3, pick, 2), a[some])


def test_pooling_in_slices_is_exact(monkeypatch):
    model = toxicity.train(["a b c d"] * 8 + ["x y z w"] * 8, [0] * 8 + [1] * 8, ["en"] * 16)
    ids = np.random.default_rng(1).integers(0, len(model.index) + 1, 5000).astype(np.int32)
    whole = model.pooled(ids)
    monkeypatch.setattr(toxicity, "_POSITIONS", 97)
    assert np.allclose(whole, model.pooled(ids))


def test_classifier_edges(spark, odd, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 0, 1), (6, None, None), (None, 1, 1), (9, 1, 0)], "doc_id long, quality int, toxic int")
    for module in (toxicity, quality):
        model = module.fit(odd, labels)
        got = module.score(odd, model).collect()
        assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
        assert module.score(nothing, model).count() == 0
        none = module.fit(nothing, labels.limit(0))
        assert module.score(odd, none).count() == odd.count()


def test_prior():
    rng = np.random.default_rng(3)
    pos, neg = rng.normal(3, 1, 4000), rng.normal(-3, 1, 4000)
    assert abs(quality.estimate_prior(pos, np.concatenate([pos[:2800], neg[:1200]])) - 0.7) < 0.05


# 7

def test_estimate_follows_similarity(spark):
    rng = random.Random(2)
    base = [str(rng.random()) for _ in range(800)]
    other = base[:700] + [str(rng.random()) for _ in range(100)]
    rows = minhash.sketches(spark.createDataFrame([(1, " ".join(base)), (2, " ".join(other))], "doc_id int, text string"), "doc_id", "text", 1)
    est = rows.alias("a").join(rows.alias("b"), F.col("a.id") < F.col("b.id")).select(minhash.estimate(F.col("a.bits"), F.col("b.bits"))).first()[0]
    assert abs(est - 700 / 900) < 0.12


def test_components_of_chains_and_copies(spark):
    """Chains of near copies whose ends don't resemble each other, and a large group of copies, against brute force."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    texts, base = [], [word() for _ in range(60)]
    for _ in range(12):
        texts.append(" ".join(base))
        base = base[2:] + [word(), word()]
    texts += [" ".join(word() for _ in range(40))] * 30
    common = [word() for _ in range(50)]
    texts += [" ".join([*common, word()]) for _ in range(40)] + ["A b", "a B", "a", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w)} if len(w) == 1 else set(zip(w, w[1:])))
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    want = {i: (len(sets[i]), root(i), root(i) == i) for i in range(len(texts))}
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.components(docs, shingle=2).collect()}
    assert got == want


def test_templates_share_keys_but_no_links(spark, monkeypatch):
    """Pages of one template, alike by 0.5 to 0.75, with some near copies among them, whose keys go by rare shingles."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghij", k=7))
    template = [word() for _ in range(120)]
    texts = [template + [word() for _ in range(50)] for _ in range(120)]
    texts += [t[:-2] + [word()] for t in texts[:30]]
    sets = [set(zip(t, t[1:])) for t in texts]
    links = {(i, j) for i in range(len(texts)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    up = list(range(len(texts)))
    for i, j in sorted(links):
        up[i] = min(up[i], up[j])
    monkeypatch.setattr(minhash, "PAIRWISE", 3)
    whole, asked = minhash.rare_partners, []
    monkeypatch.setattr(minhash, "rare_partners", lambda *a: asked.append(whole(*a)) or asked[-1])
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in minhash.components(docs, shingle=2).collect()} == dict(enumerate(up)) and len(links) >= 30
    assert asked and asked[0].count() < 0.1 * len(texts) ** 2  # the template's shingles bring no pairs


def test_verify_across_slices(spark):
    """More pairs than a slice holds, whose hub changes within slices and goes on across them."""
    texts = [" ".join(f"w{(i * 7) % 50 + k}" for k in range(40)) for i in range(60)]
    pairs = [(i, j) for j in range(60) for i in range(j)]
    sets = [set(zip(t.split(), t.split()[1:])) for t in texts]
    want = {(i, j) for i, j in pairs if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = minhash.verify(spark.createDataFrame(pairs, "u long, v long").coalesce(1), docs, 2, 80).collect()
    assert {(r.u, r.v) for r in got} == want and len(got) == len(want) and 0 < len(want) < len(pairs)


def test_minhash_edges(odd, nothing):
    got = minhash.components(odd).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got}
    assert by[2].component_id == 1 and by[7].component_id == 6 and by[3].n_shingles == 0 and by[None].kept
    assert minhash.components(nothing).count() == 0


# 9

def test_embedding_edges(spark):
    v = [1.0, 2.0, 3.0, 4.0]
    rows = [(1, v), (2, [2 * x for x in v]), (3, None), (4, [0.0] * 4), (5, [1.0, None, 0.0, 0.0]), (6, [float("nan")] * 4), (7, [float("inf"), 0.0, 0.0, 0.0]), (8, [-x for x in v]), (9, [1.0, 2.0]), (10, v), (None, v)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got[1] == (2, 1, True) and got[2] == (2, 1, False) and got[10] == (2, 1, False)
    assert all(got[k] == (0, k, True) for k in (3, 4, 5, 6, 7, 8, 9))
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_vectors_of_every_length(spark):
    """Each length is joined apart, whatever its share; repeated rows count as other vectors; both component types."""
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.1]), (3, [1.0, 0.0, 0.0]), (4, [1.0, 0.1, 0.0]), (5, [0.0, 1.0, 0.0]), (6, [5.0]), (7, [7.0]), (8, []), (9, [1.0, 2.0, 0.0]), (5, [0.0, 1.0, 0.0])]
    for kind in ("float", "double"):
        got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")).collect())
        assert got == [(1, 1, 1, True), (2, 1, 1, False), (3, 1, 3, True), (4, 1, 3, False), (5, 1, 5, True), (5, 1, 5, True), (6, 1, 6, True), (7, 1, 6, False), (8, 0, 8, True), (9, 0, 9, True)]


def test_axes_are_a_rotation():
    x = np.random.default_rng(1).normal(size=(500, 13)) * np.arange(1, 14)
    turn = embeddings.principal(x, 4)
    assert np.allclose(turn @ turn.T, np.eye(13))


def test_embedding_chunks(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 12))
    x[100:200] = x[:100] + rng.normal(size=(100, 12)) * 0.25
    x[250:] = x[0] + rng.normal(size=(50, 12)) * 0.1
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.9) & ~np.eye(300, dtype=bool)
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(spark.createDataFrame([(k, v) for k, v in enumerate(x.tolist())], "vec_id long, embedding array<double>"), chunk=40).collect()}
    assert [got[k] for k in range(300)] == near.sum(1).tolist()


# 5

def distance(item, text):
    """Least edits between the item and any passage of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_passages_against_edit_distance():
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdetion", k=rng.randint(2, 7))) for _ in range(60)]
    items = [(k, " ".join(rng.choices(words, k=rng.randint(8, 25)))) for k in range(8)]
    index = decontamination.Index(items)
    for _ in range(150):
        k, item = rng.choice(items)
        chars = list(item)
        for _ in range(rng.randint(0, len(item) // 6)):
            p = rng.randrange(len(chars))
            chars[p : p + 1] = rng.choice([[], [rng.choice("abcxyz")], [chars[p], rng.choice("abcxyz")]])
        text = " ".join(rng.choices(words, k=30)) + ". " + "".join(chars).upper() + " - " + " ".join(rng.choices(words, k=30))
        norm = "".join(map(chr, decontamination.normal(text)))
        got = {x[0]: x[3] for x in index.find(text)}
        for n, t in items:
            d = distance(t, norm)
            assert got.get(n) == (d if d <= index.edits[n] else None)


def test_any_character_separates_and_short_items_keep_their_budget():
    index = decontamination.Index([(1, "alpha beta gamma delta"), (2, "short one ok"), (3, "𝐀lpha 𐐀bc long enough item")])
    assert index.find("x alpha😀beta😀GAMMA😀delta y") == [(1, 2, 24, 0)]
    assert index.edits[2] == 1 and index.find("shurt one ok yes")[0][::3] == (2, 1) and index.find("shurt one ko yes") == []
    assert index.find("see 𝐀lpha 𐐨bc long enough item")[0][::3] == (3, 0)  # lower case beyond the first plane
    rng = random.Random(3)
    for n in range(10, 40):
        item = "".join(rng.choices("abcdefghijklmnop", k=n))
        chars = list(item)
        for p in rng.sample(range(n), n // 10):
            chars[p] = "z"
        assert [x[0] for x in decontamination.Index([(7, item)]).find("some words " + "".join(chars) + " more")] == [7]


def test_contamination_query(spark):
    docs, items = docs_of(), duckdb.sql(f"SELECT * FROM '{SF}/benchmark.parquet'").fetchall()
    want = {(d[0], i) for d in docs for i, t in items if t in d[1]}
    got = {(r.doc_id, r.item_id) for r in queries.op5_decontamination(spark, SF).collect()}
    assert want and want <= got


def test_contamination_edges(spark, odd, nothing):
    items = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog"), (2, None), (3, ""), (4, "fox"), (None, "einmal"), (1, "quick brown fox jumps over the lazy dog")], "item_id int, text string")
    got = sorted((str(r.doc_id), str(r.item_id), r.start, r.end, r.edits) for r in decontamination.passages(odd, items).collect())
    assert ("1", "1", 4, 43, 0) in got and ("9", "None", 0, 6, 0) in got and sum(x[0] == "2" for x in got) == 4
    assert decontamination.passages(nothing, items).count() == 0 and decontamination.passages(odd, items.limit(0)).count() == 0
    assert {r.doc_id for r in decontamination.drop_contaminated(odd, items).collect()} == {3, 4, 5, 6, 7, 8, 10}


# 10

def test_patience_finds_moved_blocks():
    a = [(0, 1, 6), (1, 2, 6), (2, 3, 6), (3, 9, 20)]
    b = [(0, 9), (1, 5), (2, 1), (3, 2), (4, 3)]
    assert lines.common_blocks(a, b, 10) == {0, 1, 2, 3}
    assert lines.common_blocks([(0, 1, 3), (1, 2, 12)], [(0, 2), (1, 1)], 10) == {1}
    assert lines.patience([1, 2, 3], [1, 9, 3]) == [(0, 0), (2, 2)]


def test_lines_against_brute_force(spark):
    docs = {r[0]: r[1] for r in docs_of()}
    first = {}
    for d in sorted(docs):
        for x in docs[d].split("\n"):
            first.setdefault(x, d)
    got = {r.doc_id: r.text for r in queries.op10_line_dedup(spark, SF).collect()}
    seen = {}
    for d in sorted(got):
        for x in got[d].split("\n"):
            if len(x.split()) >= lines.MIN_WORDS:
                assert first[x] == d and seen.setdefault(x, d) == d  # long lines stand in their first document only
    for d, t in docs.items():
        kept = got[d].split("\n") if got[d] else []
        assert all(x in t.split("\n") for x in kept)
        assert all(x in kept for x in t.split("\n") if first[x] == d and x.strip())


def test_repeated_lines_take_time_in_proportion():
    import time

    began = time.time()
    n = 50_000
    assert len(lines.common_blocks([(k, 7, 10) for k in range(n)], [(0, 7)], 10)) == n
    assert len(lines.common_blocks([(k, k % 2, 6) for k in range(n)], [(k, 1 - k % 2) for k in range(n)], 10)) == n
    assert time.time() - began < 4


def test_line_edges(odd, nothing, spark):
    out = lines.remove_duplicate_lines(odd, length_col="n_chars")
    by = {}
    for r in out.collect():
        by.setdefault(r.doc_id, []).append(r.text)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert by[1][0].startswith("the quick") and by[2] == ["", ""] and by[3] == [None] and by[4] == [""] and by[None][0].startswith("the quick")
    assert lines.remove_duplicate_lines(nothing).count() == 0


def blocks_of_all_pairs(docs, least=10):
    """doc -> line numbers in runs of lines of at least `least` words that stand as a run in any earlier document."""
    out = {}
    for d, rows in docs.items():
        words, out[d] = [len(x.split()) for x in rows], set()
        for e in (e for e in docs if e < d):
            for s in range(len(rows)):
                for t in range(len(docs[e])):
                    k = 0
                    while s + k < len(rows) and t + k < len(docs[e]) and rows[s + k] == docs[e][t + k]:
                        k += 1
                    if sum(words[s:s + k]) >= least:
                        out[d] |= set(range(s, s + k))
    return out


def test_blocks_of_short_lines_against_all_pairs(spark):
    rng = random.Random(5)
    pool = [" ".join(f"{c}{k}" for k in range(n)) for c, n in zip("abcdefghijkl", (1, 2, 3, 4, 5, 6, 7, 8, 9, 9, 10, 12))]
    docs = {1: pool[3:5] + ["x"], 2: ["y", *pool[5:6]], 3: ["p", *pool[3:6], "q"], 4: ["r", *pool[3:6], "s"]}  # each line of the block first stands elsewhere
    docs |= {5: ["u", pool[10], "v"], 6: ["w", pool[10], pool[0]], 7: ["z", pool[10], pool[0], "t"]}  # a block that ends in a short line
    docs |= {d: rng.choices(pool, k=rng.randint(1, 9)) for d in range(8, 120)}
    want = blocks_of_all_pairs(docs)
    assert want[4] == {1, 2, 3} and want[7] == {1, 2}
    table = spark.createDataFrame([(d, "\n".join(x)) for d, x in docs.items()], "doc_id long, text string")
    assert {r.doc_id: set(r.cut) for r in lines.duplicate_lines(table).collect()} == {d: x for d, x in want.items() if x}


def test_blocks_that_the_alignment_places_elsewhere():
    x, y, z, v = (1, 5), (2, 5), (3, 5), (4, 5)
    later, earlier = [(k, *a) for k, a in enumerate([x, y, x])], [(k, a[0]) for k, a in enumerate([x, z, x, y, v])]
    assert lines.common_blocks(later, earlier, 10) == {0, 1}


def test_passages_of_tiny_lines_and_with_blank_lines(spark):
    verse = [f"word{k}" for k in range(12)]
    talk = ["Who is there?", "It is me.", "Come in then.", "Thank you very much."]
    rows = [(1, "\n".join(["first", *verse])), (2, "\n".join(["second", *verse, "end"])),
            (3, "\n\n".join(["He knocked.", *talk])), (4, "\n \n\n".join([*talk, "They sat down."])), (5, "\n\n".join(talk) + "\n"),
            (6, "\n\n".join(["one two three", "four five six"])), (7, "\n".join(["one two three", "four five six"]))]
    out = lines.remove_duplicate_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: r.text for r in out.collect()}
    assert got[2] == "second\nend" and got[4].split() == ["They", "sat", "down."] and got[5] == ""
    assert all(got[k] == t for k, t in rows if k in (1, 3, 6, 7))


# 1

def test_deviation_is_below_one_block(spark):
    shares = [9, 5, 3, 1, 1]
    slots = [r.s for r in mixing.cycle(spark, shares).orderBy("slot").collect()]
    assert len(slots) == sum(shares)
    for s, n in enumerate(shares):
        given = np.concatenate([[0], np.cumsum([x == s for x in slots * 3])])
        assert np.abs(given - np.arange(len(given)) * n / sum(shares)).max() < 1


def test_cycles_of_any_length(spark, monkeypatch):
    """Segments and the count of places from the rows give what one layout gives."""
    whole = sorted(map(tuple, mixing.cycle(spark, [90, 50, 31, 7]).collect()))
    assert whole == sorted(map(tuple, mixing.cycle(spark, [90, 50, 31, 7], segment=50).collect())) and len(whole) == 178
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"))
    shares = {"s0": 5, "s1": 3, "s2": 1}
    want = sorted(map(tuple, mixing.mix(docs, shares, block_rows=3).collect()))
    monkeypatch.setattr(mixing, "MAX_CELLS", 2)
    assert want == sorted(map(tuple, mixing.mix(docs, shares, block_rows=3).collect())) and len(want) == 400


def test_mix_edges(odd, nothing):
    got = mixing.mix(odd, {"a": 3, "b": 2}, block_rows=1)
    rows = got.collect()
    assert len(rows) == odd.count() and sorted(r.mix_position for r in rows) == list(range(len(rows)))
    assert set(got.columns) == {*odd.columns, "mix_position", "mix_index"}
    assert mixing.mix(nothing, {"a": 3}).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(odd, {"a": 0})


def test_mix_is_native(spark):
    plan = queries.op1_mixing(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


# 2

def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "u", "same"), (2, None, "same"), (3, "v", None), (4, "w", ""), (5, "x\r\ny", "é" * 200_000), (6, "z", "a\r\n\r\nb"), (None, "n", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.archive(pages.repartition(3), str(tmp_path / "a"), "page_id", "url", "html")
    got = {r.record_id: r for r in warc.read(spark, str(tmp_path / "a")).collect()}
    assert got["urn:row:1"].warc_type == "revisit" and got["urn:row:1"].refers_to == "urn:row:2" and got["urn:row:2"].warc_type == "response"
    assert got["urn:row:3"].refers_to == "urn:row:4" and got["urn:row:4"].payload_length == 0
    for i, _, t in rows:
        r = got[f"urn:row:{'' if i is None else i}"]
        body = (t or "").encode()
        assert r.payload_length == len(body) and r.payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert r.warc_type == "revisit" or bytes(r.payload) == body
    only = warc.read(spark, str(tmp_path / "a"), payload="none").filter("warc_type = 'revisit' AND target_uri = 'u'")
    assert [r.record_id for r in only.collect()] == ["urn:row:1"] and "Filter (" not in only._jdf.queryExecution().executedPlan().toString()
    warc.archive(pages.limit(0), str(tmp_path / "b"), "page_id", "url", "html")
    assert warc.read(spark, str(tmp_path / "b")).count() == 0


def test_warc_query(spark):
    pages = duckdb.sql(f"SELECT page_id, html FROM '{SF}/pages.parquet'").fetchall()
    top = {}
    for k, h in pages:
        top[h or ""] = max(k, top.get(h or "", k))
    want = {k: (len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), *(("response", None) if top[h or ""] == k else ("revisit", top[h or ""]))) for k, h in pages}
    got = queries.op2_warc(spark, SF).collect()
    assert len(got) == len(pages) and {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == want


@pytest.mark.parametrize("most", [50_000, 0])
def test_warc_repeated_rows(spark, tmp_path, monkeypatch, most):
    """Equal rows, and equal ids with other payloads, are records of their own; the plan for many digests gives the same."""
    monkeypatch.setattr(warc, "BROADCAST_ROWS", most)
    rows = [(1, "u", "same"), (1, "u", "same"), (1, "u", "other"), (2, "u", "same"), (None, "u", "same"), (3, "u", "alone")]
    warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "a"), "page_id", "url", "html")
    got = sorted((r.record_id, r.warc_type, r.refers_to or "") for r in warc.read(spark, str(tmp_path / "a")).collect())
    assert got == [("urn:row:", "response", "")] + [("urn:row:1", "response", "")] + [("urn:row:1", "revisit", "urn:row:2")] * 2 + [("urn:row:2", "response", ""), ("urn:row:3", "response", "")]


def test_files_of_lost_attempts_are_not_read(spark, tmp_path):
    import shutil

    pages = spark.createDataFrame([(1, "u", "a"), (2, "u", "b")], "page_id long, url string, html string")
    warc.archive(pages.coalesce(1), str(tmp_path / "a"), "page_id", "url", "html")
    one = next((tmp_path / "a").glob("*.warc.gz"))
    shutil.copy(one, tmp_path / "a" / "left-0003.warc.gz")
    assert warc.read(spark, str(tmp_path / "a")).count() == 2
    shutil.rmtree(tmp_path / "a" / warc.MANIFEST)
    assert warc.read(spark, str(tmp_path / "a")).count() == 4  # archives of others have no manifest


def _archive():
    return [warc.record(k, f"r{n}", "u", (b"x%d" % n) * 200_000 if k == "response" else warc._Sized(9), "S", "r0", "d") for n, k in enumerate(["response", "revisit", "response", "response"])]


def test_unwanted_payloads_are_passed_over():
    import gzip
    import io

    made = _archive()
    told = b"".join(map(warc.member, made))
    assert gzip.decompress(told) == b"".join(made)
    for data, packed in ((told, True), (b"".join(made), False), (b"".join(map(gzip.compress, made)), True), (gzip.compress(b"".join(made)), True), (told + bytes(99), True)):
        every = list(warc.records(io.BytesIO(data), packed))
        assert len(every) == 4 and list(warc.records(io.BytesIO(data), packed, lambda h: h["record_id"] == "r2")) == [every[2]]
        assert [r["offset"] for r in warc.records(io.BytesIO(data), packed, payload="none")] == [r["offset"] for r in every]
    stream = warc._Bytes(io.BytesIO(told), True)
    for r in made:
        head = stream.until(b"\r\n\r\n")
        if b"revisit" in head:  # small enough to be inflated with its header
            assert not stream.leave(0)
            stream.take(len(r) - len(head), False)
        else:
            assert stream.leave(len(r) - len(head) - 4)
    assert stream.inflated < len(b"".join(made)) and not stream._more()


def test_cut_off_archives_are_errors():
    import io

    told = b"".join(map(warc.member, _archive()))
    for cut in (len(told) - 3, len(told) - 30, len(told) // 2, 5):
        for how in ({}, {"payload": "none"}, {"wanted": lambda h: False}):
            with pytest.raises((EOFError, ValueError)):
                list(warc.records(io.BytesIO(told[:cut]), True, **how))
    with pytest.raises(EOFError):
        list(warc.records(io.BytesIO(_archive()[0][:900]), False))


# 3

def test_html():
    page = """<html><head><title>t</title><style>p{}</style></head><body><nav><a href=1>Menu</a></nav><div class="cookie-notice">We use cookies here</div><article><h1>A &amp; B</h1><p>One
      two<br>three<script>var x = "</p>";</script></p><p>Short.<div class=ad>Buy now</div><form><p>Sign up</p></form><section id="comments"><p>First!</p></section></article><aside>More</aside><footer>&copy; x</footer>"""
    assert htmltext.main_text(page) == "A & B\nOne two three\nShort."
    for t in (None, "", "<", "<p", "<!-- x", "<script>x", "&", "</p></div>"):
        assert isinstance(htmltext.main_text(t), str)
    assert htmltext.main_text("<p>1 < 2") == "1 < 2"


LINE = "The old line ran for forty years along the coast and nobody thought that it would ever close until the bridge fell into the river that winter"


@pytest.mark.parametrize("page, want", [
    (f"<div class=story><h1>Lines</h1><p>{LINE}</p><p>{LINE}</p><p>{LINE}</p><p>End.</p></div><article><h3>Teaser</h3><p>Read this too now</p><a href=1>more</a></article>", ["Lines", LINE, LINE, LINE, "End."]),
    (f"<article><h1>A</h1><section class=legal><p>{LINE}</p><p>{LINE}</p></section></article>", ["A", LINE, LINE]),
    (f"<article><h1>A</h1><p>{LINE}</p><div class=notice-board-history><p>{LINE}</p></div></article>", ["A", LINE, LINE]),
    (f"<article><p>{LINE}</p><p>{LINE}</p><section id=comments><p>{LINE} indeed</p></section></article>", [LINE, LINE]),
    (f"<p><a href=1>Home</a> <a href=2>News</a></p><p>{LINE}</p><p>Short one.</p><p>{LINE}</p><p>&copy; 2001 us</p>", [LINE, "Short one.", LINE]),
    (f"<article><svg class=icon /><p>{LINE}</p><object-view><p>{LINE}</p></object-view><noscript><p>{LINE}</p></article>", [LINE] * 3),
    (f"<article><p>{LINE}</p><form><p>{LINE}</p></form></article><aside><p>{LINE}</p></aside>", [LINE]),
])
def test_html_layouts(page, want):
    assert htmltext.main_text(page).split("\n") == want


def test_html_tree_is_carried_by_words():
    """Words, their neighbours' words and link densities make most of the splits; fresh pages of the labelled kind are told apart."""
    used, todo = [], [htmltext.tree()]
    while todo:
        if isinstance(node := todo.pop(), tuple):
            used.append(htmltext.FEATURES[node[0]])
            todo += node[2:]
    text = {"words", "words_before", "words_after", "near", "link_density", "density_before", "density_after"}
    assert text <= set(used) and np.mean([u in text for u in used]) > 0.6
    good = []
    for k in range(90_000, 90_060):
        found = htmltext.blocks(htmltext._Draw(k).page())
        good += [htmltext.is_content(row, htmltext.tree()) == (b.label == "y") for b, row in zip(found, htmltext.features(found))]
    assert np.mean(good) > 0.95


def test_html_depth_and_stray_tags_take_time_in_proportion():
    import time

    began = time.time()
    for page in ("<div>" * 20_000 + "word", "<b>" * 20_000 + "</i>" * 20_000, "<svg>" * 20_000 + "x", "<p>" + "<i>" * 5000 + "a" + "</b>" * 5000, "<ul>" + "<li>x" * 20_000):
        htmltext.main_text(page)
    assert time.time() - began < 20


def test_html_query(spark):
    import html
    import re

    rows = duckdb.sql(f"SELECT page_id, html FROM '{SF}/pages.parquet'").fetchall()
    got = {r.page_id: r.text for r in queries.op3_html_text(spark, SF).collect()}
    for k, h in rows:
        body = re.search("<article>(.*?)</article>", h, re.S)[1]
        parts = (" ".join(html.unescape(re.sub("<[^>]+>", "", x)).split()) for x in re.split("</?h1>|</?p>|<br>", body))
        assert got[k] == "\n".join(x for x in parts if x)


def test_html_edges(spark):
    rows = [(1, "u", None, "t"), (2, None, "", "t"), (2, None, "", "t"), (None, "x", "<p>word</p>", None)]
    out = htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    assert [(r.page_id, r.text, r.n_chars) for r in out.orderBy("page_id").collect()] == [(None, "word", 4), (1, "", 0), (2, "", 0), (2, "", 0)]
    assert htmltext.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# pipeline

def test_pipeline(spark):
    """Each stage's rows against a brute-force version from that stage's own input."""
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    index = decontamination.Index(duckdb.sql(f"SELECT * FROM '{SF}/benchmark.parquet'").fetchall())

    def language(rows):
        model = language_id.fit(spark.read.parquet(f"{SF}/documents.parquet"), keep=language_id.training_rows())
        langs, scores = language_id.predict(model, [r.text for r in rows])
        return {r.doc_id: r.text for r, x, y in zip(rows, langs, scores) if x != "und" and y >= P.LEAST_LANGUAGE_SCORE}

    def line(rows):
        of = {r.doc_id: [(n, x) for n, x in enumerate(r.text.split("\n")) if x.strip()] for r in sorted(rows, key=lambda r: r.doc_id)}
        cut = blocks_of_all_pairs({d: [x for _, x in own] for d, own in of.items()}, lines.MIN_WORDS)
        out = {}
        for r in rows:
            gone = {of[r.doc_id][k][0] for k in cut[r.doc_id]}
            text = "\n".join(x for n, x in enumerate(r.text.split("\n")) if n not in gone)
            if text.strip():
                out[r.doc_id] = text
        return out

    def near(rows):
        sets = {r.doc_id: (lambda w: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())(r.text.lower().split()) for r in rows}
        up = {d: d for d in sets}

        def root(x):
            while up[x] != x:
                x = up[x]
            return x

        for a in sets:
            for b in sets:
                if a < b and sets[a] and (both := len(sets[a] & sets[b])) and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = root(a), root(b)
                    up[max(x, y)] = min(x, y)
        return {r.doc_id: r.text for r in rows if root(r.doc_id) == r.doc_id}

    brute = [language, line, near, lambda rows: {r.doc_id: r.text for r in rows if not index.find(r.text)}, lambda rows: {r.doc_id: r.text for r in rows}]
    for k, (_, stage) in enumerate(P.STAGES):
        rows = docs.collect()
        docs = stage(spark, docs, SF).cache()
        got = docs.collect()
        assert len(got) == len({r.doc_id for r in got}) and {r.doc_id: r.text for r in got} == brute[k](rows)
        assert k + 1 == len(P.STAGES) or docs.columns == names
    assert sorted({r.mix_position for r in got}) == list(range(len({r.mix_position for r in got})))


def test_pipeline_rewrites_lines_once(spark):
    """The filter on the new text doesn't have it made again, in a second Python worker of each task."""
    import corpus_pipeline as P

    for docs in (P.dedup_lines(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF), lines.remove_duplicate_lines(spark.read.parquet(f"{SF}/documents.parquet")).filter("length(text) > 3")):
        assert docs._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1


def test_pipeline_edges(spark, odd, nothing):
    """Null, empty, blank, very long and repeated rows, null ids and clashing columns go through all stages; so does an empty table."""
    import corpus_pipeline as P

    for docs in (odd, nothing):
        given = docs.columns
        for k, (_, stage) in enumerate(P.STAGES):
            docs = stage(spark, docs, SF).cache()
            assert k + 1 == len(P.STAGES) or docs.columns == given
        ids = [r.doc_id for r in docs.collect()]
        assert not {3, 4, 5, 8} & set(ids)
