import itertools
import math
import random
import unicodedata
from collections import Counter

import duckdb
import harness
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusfreq import catalog, session
from corpusfreq.functions import addresses, python_text
from corpusfreq.functions import text as T
from corpusfreq.operators import cues, dedup, evaluation, frequency, lookup, sampling
from corpusfreq.operators.graph import connected_components
from corpusfreq.plans import stages, tokenizers
from corpusfreq.sources import files
from corpusfreq.streaming import events


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


def test_tokens(spark):
    got = one(spark, "The court's a learning-place; and he is 1.", T.tokens)
    assert " ".join(got) == "The court ' s a learning - place and he is <num>"


@pytest.mark.parametrize("before, after", [(["3.5"], ["<num>", ".", "<num>"]), (["1", "2"], ["<num>"]), (["a1b"], ["a", "<num>", "b"]), (["1", ",", "2"], ["<num>", ",", "<num>"]), (["1", "", "2"], ["<num>", "", "<num>"]), ([], [])])
def test_replace_numbers(spark, before, after):
    assert one(spark, before, T.replace_numbers, "array<string>") == after


def test_word_filter(spark):
    got = [one(spark, x, T.is_word) for x in ("a", "{", "'", "-", "〜", "a1", "♪")]
    assert got == [True, True, False, False, False, False, False]


def test_cut_long():
    cut = python_text.cut_long
    assert cut("XXXyyyZZZ", 3) == ["XXX", "yyy", "ZZZ"]
    assert cut("XXX yyy\nZ", 3) == ["XXX", "yyy", "Z"]
    assert cut("XX\nyy zz\nUUUw", 3) == ["XX", "yy", "zz", "UUU", "w"]
    assert cut("XX\n\nyy\n\nzz\n\nUUU. w", 3) == ["XX\n\nyy\n\nzz\n\nUUU. w"]
    assert cut("UUU.", 3) == ["UUU."]


def test_addresses(spark):
    assert one(spark, "foo.日本 x", addresses.mask).split() == ["<web>", "x"]
    assert one(spark, "フーバー.コム漢", addresses.mask) == "フーバー.コム漢"
    assert one(spark, "see a.com/x?y=1. or me@b.org", addresses.found) == ["a.com/x?y=1", "me@b.org"]
    assert one(spark, "ends.It starts", addresses.found) == []
    assert one(spark, None, addresses.mask) is None


def test_t_pvalue():
    assert abs(python_text.student_two_sided(2.0, 10) - 0.07338803) < 1e-7
    assert abs(python_text.student_two_sided(0.5, 3) - 0.6514) < 1e-4
    assert python_text.student_two_sided(0.0, 5) == 1.0


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 460)]
    up = {}

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    want = {x: root(x) for e in edges if e[0] != e[1] for x in e}
    got = connected_components(spark.createDataFrame(edges, "u long, v long"))
    assert {r.id: r.component for r in got.collect()} == want
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_greedy_removal(spark):
    pairs = spark.createDataFrame([(1, 0, 1.0), (2, 1, 1.0), (3, 1, 1.0), (3, 2, 1.0), (5, 4, 1.0)], "i long, j long, sim double")
    assert sorted(r.doc for r in dedup.greedy(pairs).collect()) == [1, 3, 5]
    rng = random.Random(8)
    some = sorted({(max(a, b), min(a, b)) for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range(90)) if a != b} | {(k + 1, k) for k in range(100, 115)})
    gone = set()
    for i in sorted({i for i, _ in some}):
        if any(j not in gone for x, j in some if x == i):
            gone.add(i)
    assert {r.doc for r in dedup.greedy(spark.createDataFrame(some, "i long, j long")).collect()} == gone
    assert dedup.greedy(pairs.limit(0)).count() == 0


def test_copies_cost_no_pairs(spark):
    """2,000 equal documents and a near copy: one class, few pairs, the first stays."""
    body = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(k, body) for k in range(2000)] + [(2000, body + " w0"), (2001, "else"), (2002, "")], "doc long, text string")
    found = dedup.search(docs, "doc", T.tokens(F.col("text")))
    assert found.pairs.count() == 1 and found.classes.count() == 2002
    assert {r.doc for r in dedup.removed(found).collect()} == set(range(1, 2001))


def test_counts(spark):
    docs = spark.createDataFrame([(1, "deabcdabcaba", ""), (2, "abc", "")], "doc int, text string, ch string")
    grain = frequency.words(docs, "doc", F.split("text", ""), "ch")
    got = {r.word: (r["count"], r.videos, r.channels) for r in frequency.word_counts(grain).collect()}
    assert got == {"a": (5, 2, 2), "b": (4, 2, 2), "c": (3, 2, 2), "d": (2, 1, 1), "e": (1, 1, 1)}


def test_negative_difference_fails(spark):
    a, b = (spark.createDataFrame([("x", n)], "word string, count long") for n in (1, 2))
    with pytest.raises(Exception, match="negative count"):
        frequency.counter_difference(a, b).collect()


def test_distance(spark):
    rows = spark.createDataFrame([("p", "a", 1), ("q", "b", 1), ("p", "c", 1), ("q", "c", 1)], "corpus string, word string, count long")
    got = {(r.a, r.b): r.distance for r in evaluation.js_distance(rows).collect()}
    assert got["p", "p"] == 0 and abs(got["p", "q"] - (0.5 * 0.6931471805599453) ** 0.5) < 1e-9


def test_slices(spark):
    rows = spark.createDataFrame([(k,) for k in range(20)], "id int")
    assert sorted(r.id for r in sampling.ordered_slice(rows, "id", 3, 7).collect()) == [3, 4, 5, 6]
    assert sampling.ordered_slice(rows, "id", 25).count() == 0
    assert {r.id: r.pos for r in sampling.position(rows, "id").collect()} == {k: k for k in range(20)}
    assert sorted(r.id for r in sampling.ordered_slice(rows, "id", None, 3).collect()) == [0, 1, 2]
    assert sampling.ordered_slice(rows, "id", 5, 5).count() == 0 and sampling.ordered_slice(rows, "id").count() == 20 and sampling.ordered_slice(rows, "id", 18).count() == 2


def test_positions_of_wide_rows(spark):
    """Every row keeps its place whatever else is kept with it; ties and nulls take neighbouring places."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    ids = sorted(r.doc_id for r in docs.select("doc_id").collect())
    got = {r.doc_id: r.pos for r in sampling.position(docs, "doc_id").select("doc_id", "pos", F.length("text")).collect()}
    assert got == {k: n for n, k in enumerate(ids)}
    wide = spark.range(600_000).select((F.col("id") * 7 % 600_000).alias("id"), F.repeat(F.lit("x"), 256).alias("body"))
    out = sampling.position(wide, "id").agg(F.count("*"), F.count_if(F.col("id") != F.col("pos")), F.sum(F.length("body"))).first()
    assert tuple(out) == (600_000, 0, 600_000 * 256)
    ties = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (0, "d")], "k int, pos string")
    assert sorted(r.pos for r in sampling.position(ties, "k").collect()) == [0, 1, 2, 3]


def test_list_order(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "id string, v int")
    assert [r.v for r in sampling.in_list_order(rows, "id", ["c", "a"]).orderBy("place").collect()] == [3, 1]
    with pytest.raises(KeyError):
        sampling.in_list_order(rows, "id", ["z"])


def test_constant_groups_have_no_correlation(spark):
    rows = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 3.0), ("b", 1.0, 2.0), ("b", 2.0, 4.0), ("c", 1.0, 1.0), ("b", None, 9.0)], "g string, x double, y double")
    got = {r.g: r.r for r in evaluation.correlation(rows, ["g"], "x", "y").collect()}
    assert got["a"] is None and got["c"] is None and abs(got["b"] - 1) < 1e-9
    assert {r.g: r.r for r in evaluation.metrics(rows, ["g"], "y", "x").collect()}["a"] is None


def test_literal_cases(spark):
    one = lambda rows, f, kind="string": [r[0] for r in spark.createDataFrame([(k, x) for k, x in enumerate(rows)], "k int, t string").orderBy("k").select(f(F.col("t"))).collect()]
    assert one(["a～b", "～", "~", None], T.tilde_map) == ["a〜b", "〜", "~", None]
    assert one(["It’s me. It’s ‘you and me’.", "It′s an a′, it can′t be b′. Countries′ names.", "‘It’s an apostrophe.’"], python_text.smart_apostrophe) == [
        "It's me. It's ‘you and me’.", "It's an a′, it can't be b′. Countries' names.", "‘It's an apostrophe.’"]
    assert one(["<c.red>a</c> <b>b</b>", "<v Bob>hi &amp;lt; &lt;x&gt;</v>", "<00:01.000>t&nbsp;u", "<lang en>x</lang> 1 < 2", "<u.>q</u>"], T.markup_to_text) == ["a b", "hi &lt; <x>", "t u", "x 1 < 2", "q"]
    assert one(["<ruby>漢字<rp>(</rp><rt>かんじ</rt><rp>)</rp></ruby>です", "a<rt>x</rt><rp>(</rp>b", "<ruby x><rb>base</rb><rt a>r</rt></ruby>", "xyz"], T.strip_ruby) == ["漢字です", "ab", "base", "xyz"]
    lines = ["01:02:03.001 --> 9999:01:59.001", "00:01:59.999 --> 59:34.567", "00:01.0000 --> 00:02.000", "00:60.000 --> 00:61.000", "0:01.000 --> 00:02.000", " 00:01.000 --> 00:02.000", "00:01,000 --> 00:02,000", "00:01.500 --> 00:02.000 align:start"]
    assert one(lines, cues.timing) == [(3723.001, 35996519.001), (119.999, 3574.567), None, None, None, None, None, (1.5, 2.0)]
    assert one(["[ __ ] Email foo@bar.com and @foo_bar. www.foo.com[engine starts]"], lambda c: F.array_join(addresses.tokens_with_addresses(c, T.split_words), " ")) == ["[____] Email <email> and <handle> . <web> [engine_starts]"]
    assert one(["[ __ ]", "[music ♪]", "@a.b", "x@y.com", "http://a.com/x@y", "a.com/b@c.com"], addresses.kind) == ["censored", "cc_desc", "handle", "email", "web", "web"]


def test_scrolling(spark):
    rows = [(1, 0.0, 1.0, "A"), (2, 1.0, 2.0, " A\nB "), (3, 2.0, 3.0, "B\nC"), (4, 3.0, 4.0, "C"), (5, 5.0, 6.0, "X"), (6, 6.0, 7.0, "X"), (7, 7.0, 8.0, " \n"), (8, 7.0, 9.0, "Y")]
    out = cues.clean_cues(spark.createDataFrame(rows, "idx int, start double, end double, text string").withColumn("video_id", F.lit(1)))
    assert [(r.kind, "|".join(r.emitted)) for r in out.orderBy("idx").collect()] == [
        ("other", "A"), ("scroll", "B"), ("scroll", "C"), ("scroll", ""), ("delay", "|X"), ("repeat", ""), ("empty", ""), ("other", "Y")]


def test_student_p_by_integration(spark):
    from math import gamma, pi, sqrt

    for t, df in ((0.5, 3), (2.1, 10), (-1.7, 40), (3.0, 5)):
        c = gamma((df + 1) / 2) / (sqrt(df * pi) * gamma(df / 2))
        n = 20_000
        area = sum(c * (1 + ((k + 0.5) / n * abs(t)) ** 2 / df) ** (-(df + 1) / 2) for k in range(n)) * abs(t) / n
        assert abs(python_text.student_two_sided(t, df) - (1 - 2 * area)) < 1e-6
    for xy, xz, yz, n, t in ((0.7, 0.6, 0.5, 100, 1.4495), (0.5, 0.5, 1.0, 50, None)):
        got = spark.range(1).select(evaluation.steiger(F.lit(xy), F.lit(xz), F.lit(yz), F.lit(n))).first()[0]
        assert got is None if t is None else abs(got - t) < 0.2


def test_tagged_numbers(spark):
    rows = spark.createDataFrame([([("a1", "N"), ("22", "X"), ("", "E"), ("b", "V")],)], "l array<struct<token: string, pos: string>>")
    assert [tuple(x) for x in rows.select(T.replace_tagged_numbers(F.col("l"))).first()[0]] == [("a", "N"), ("<num>", "NUM"), ("", "E"), ("b", "V")]


def test_partitions_do_not_matter(spark):
    docs = spark.createDataFrame([(k, " ".join(random.Random(k % 7).choices("abcdefgh", k=40))) for k in range(40)], "doc long, text string")
    got = [sorted(map(tuple, dedup.similar_pairs(dedup.tfidf(docs.repartition(n), "doc", T.tokens(F.col("text")))).select("i", "j").collect())) for n in (1, 7)]
    assert got[0] == got[1] and (7, 0) in got[0]


def test_choice():
    assert tokenizers.choose("en", "regex") == "regex"
    for bad in (("ja", "regex"), ("es", "treebank"), ("en", "regex", "lemma"), ("en", "regex", "surface", True)):
        with pytest.raises(ValueError):
            tokenizers.choose(*bad)


def test_stages(spark, tmp_path):
    vtt = "WEBVTT\n\n" + "".join(f"00:{k:02d}.000 --> 00:{k:02d}.900\nline {w} of <b>it</b>\n\n" for k, w in enumerate(["one", "two", "three", "four"]))
    for name, body in (("a", vtt), ("b", vtt.replace("one", "1")), ("c", vtt), ("d", "WEBVTT\n\n00:01.000 --> 00:02.000\nx\n")):
        (tmp_path / f"{name}.vtt").write_text(body)
    (tmp_path / "list.csv").write_text("videoid,sub,auto,channelid,categories,duration\na,True,False,k,Music,9\nb,True,False,,Music,9\nc,True,False,k,Music,9\nd,True,False,k,Music,9\na,True,False,z,Music,9\n")
    stages.run(spark, str(tmp_path), str(tmp_path / "list.csv"), "en", str(tmp_path / "out"))
    funnel = {r.reason: r.files for r in spark.read.parquet(str(tmp_path / "out/funnel")).collect()}
    assert funnel == {"valid": 3, "short": 1}
    left = {r.video_id for r in spark.read.parquet(str(tmp_path / "out/unique")).collect()}
    assert "a" in left and "c" not in left
    freq, total = files.read_frequencies(spark, str(tmp_path / "out/frequencies"), total_row="[TOTAL]")
    assert total.first().tokens == sum(r["count"] for r in freq.collect())


def test_codecs(spark, tmp_path):
    import lzma
    import zipfile

    body = "# c\nword\tcount\na\t3\nA\t2\nb\t1\n"
    (tmp_path / "f.tsv.xz").write_bytes(lzma.compress(body.encode()))
    with zipfile.ZipFile(tmp_path / "f.zip", "w") as z:
        z.writestr("f.tsv", body)
        z.writestr("d/x.txt", "hello")
    words, total = files.read_frequencies(spark, str(tmp_path / "f.tsv.xz"), ["word", "count"], to_lower=True)
    assert {r.word: r["count"] for r in words.collect()} == {"a": 5, "b": 1} and tuple(total.first()) == (6, 2)
    words, _ = files.read_frequencies(spark, str(tmp_path / "f.zip"), ["word", "count"], member="f.tsv")
    assert words.count() == 3
    assert [tuple(r) for r in files.read_zip(spark, str(tmp_path)).collect()] == [("x", "hello")]
    (tmp_path / "g.hk").write_bytes("1.0 2.0 B: 这<noise>%呵\n#x\n\n3.0 4.0 A: {cough}嘛".encode("gbk"))
    got = files.read_files(spark, str(tmp_path), ".hk", encoding="gbk").select(files.conversation_text(F.col("text"))).first()[0]
    assert got == "这呵\n嘛"


def test_streaming(spark, tmp_path):
    from conftest import SF

    static = spark.read.parquet(f"{SF}/events.parquet")
    static.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(static.schema).parquet(str(tmp_path / "in"))
    q = events.windowed_counts(stream, "ts", "event_type").writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    want = static.groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").start.alias("start"), "event_type").agg(F.count("*").alias("n"))
    got = spark.table("w")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_scroll_matches_sequential_rule(spark):
    from corpusfreq.operators import cues

    rng = random.Random(4)
    rows = []
    for v in range(40):
        at = 0.0
        for k in range(25):
            text = "\n".join(rng.choice("AB ") for _ in range(rng.randint(0, 3)))
            start = at + rng.choice([0, 0, 0, 1.0])
            at = start + 1
            rows.append((v, k, start, at, text))

    def rule(own):
        end = said = None
        for _, k, s, e, t in own:
            t = t.strip()
            if not t:
                yield k, "empty", []
                continue
            kind, out = "other", [t]
            if said is not None:
                last = t.rsplit("\n", 1)
                if s > end:
                    kind, out = "delay", ["", t]
                elif t == said:
                    kind, out = "repeat", []
                elif last[0] in (said.split("\n", 1)[-1], said):
                    kind, out = "scroll", last[1:]
            end, said = e, t
            yield k, kind, out

    want = {(v, k): (kind, out) for v, own in itertools.groupby(rows, key=lambda r: r[0]) for k, kind, out in rule(list(own))}
    df = spark.createDataFrame(rows, "video_id int, idx int, start double, end double, text string")
    assert {(r.video_id, r.idx): (r.kind, r.emitted) for r in cues.clean_cues(df).collect()} == want


def test_treebank():
    assert python_text.treebank('They\'ll say "it cannot (yet) cost $3.50, don\'t they?" Mr. Smith\'s dog ran.') == [
        "They", "'ll", "say", "``", "it", "can", "not", "(", "yet", ")", "cost", "$", "3.50", ",", "do", "n't", "they", "?", "''", "Mr.", "Smith", "'s", "dog", "ran", "."]
    assert python_text.treebank("wait... I'm gonna go--now; 10:30 a:b") == ["wait", "...", "I", "'m", "gon", "na", "go", "--", "now", ";", "10:30", "a", ":", "b"]
    assert python_text.treebank("") == []


def test_unknown_models_are_errors():
    with pytest.raises(LookupError):
        tokenizers.tokenizer("mecab")
    assert tokenizers.tokenizer("mecab", fallback=True) is T.tokens


def test_options():
    o = stages.options(stages.parser().parse_args(["--data", "d", "--output", "o", "--tokenize", "--ngram-max", "2", "--no-categories"]))
    assert o.steps == ["tokenize"] and o.ngrams == (1, 2) and not o.categories and o.filter_tokens
    with pytest.raises(ValueError):
        stages.Options(steps=["frequencies", "tokenize"])
    with pytest.raises(ValueError):
        stages.options(stages.parser().parse_args(["--data", "d", "--output", "o", "--lang", "es", "--tokenization", "treebank"]))


def test_tokenize_stage(spark, tmp_path):
    docs = spark.createDataFrame([("a", "Hello there.\nMail x@y.com now. Bye!\n\nNew part"), ("b", ""), ("c", None)], "video_id string, text string")
    assert [(r.video_id, r.line) for r in stages.tokenize(docs, "en").orderBy("video_id", "n").collect()] == [("a", "hello there"), ("a", "mail <email> now"), ("a", "bye"), ("a", "new part")]
    docs.write.parquet(str(tmp_path / "unique"))
    stages.run(spark, "unused", None, "en", str(tmp_path), stages.Options(steps=["tokenize"]))
    assert [r.value for r in spark.read.text(str(tmp_path / "tokenized")).collect()] == ["hello there", "mail <email> now", "bye", "new part"]


def test_frequency_stage_without_list_in_all_norms(spark, tmp_path):
    spark.createDataFrame([("a", "The the Cat ﬁne"), ("b", "the dog 12")], "video_id string, text string").write.parquet(str(tmp_path / "unique"))
    stages.run(spark, "unused", None, "en", str(tmp_path), stages.Options(steps=["frequencies"], norms=True))
    got = {n: {r.word: (r["count"], r.videos) for r in spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / f"frequencies-{n}")).collect()} for n in frequency.NORMS}
    assert got["lower"]["the"] == ("3", "2") and got["none"]["The"] == ("1", "1") and got["nfkc"]["fine"] == ("1", "1") and got["none"]["[TOTAL]"] == ("7", "2")


def test_categories_and_slices(spark, tmp_path):
    vtt = "WEBVTT\n\n" + "".join(f"00:{k:02d}.000 --> 00:{k:02d}.900\nline {w} of it\n\n" for k, w in enumerate(["one", "two", "three", "four"]))
    for n in "abc":
        (tmp_path / f"{n}.vtt").write_text(vtt + f"00:59.000 --> 00:59.900\n{n * 9} {n * 8} {n * 7}\n")
    (tmp_path / "list.csv").write_text("videoid,sub,auto,channelid,categories,duration\n" + "".join(f"{n},True,False,k,{c},9\n" for n, c in (("a", "Music"), ("b", "Gaming"), ("c", "Music"))))
    o = stages.Options(steps=["clean"], limit_categories=["Music"], start=1)
    stages.run(spark, str(tmp_path), str(tmp_path / "list.csv"), "en", str(tmp_path / "out"), o)
    assert [r.video_id for r in spark.read.parquet(str(tmp_path / "out/clean")).collect()] == ["c"]


def test_xz_and_file_sinks(spark, tmp_path):
    import lzma
    import zipfile

    counts = spark.createDataFrame([(f"w{k:03d}", k) for k in range(300)], "word string, count long")
    files.write_frequencies(counts, spark.createDataFrame([("[TOTAL]", 44850)], "word string, count long"), str(tmp_path / "f"), "xz")
    lines = [x for p in sorted((tmp_path / "f").glob("part-*.tsv.xz")) for x in lzma.decompress(p.read_bytes()).decode().splitlines()]
    assert lines[0] == "word\tcount" and lines[1] == "w299\t299" and lines[-1] == "[TOTAL]\t44850" and len(lines) == 302
    docs = spark.createDataFrame([("a", "x"), ("b", None)], "doc_id string, text string")
    files.write_files(docs, str(tmp_path / "docs"))
    assert (tmp_path / "docs/a.txt").read_text() == "x" and (tmp_path / "docs/b.txt").read_text() == "" and len(list((tmp_path / "docs").iterdir())) == 2
    files.write_files(docs.coalesce(1), str(tmp_path / "zip"), archive=True)
    assert zipfile.ZipFile(next((tmp_path / "zip").iterdir())).read("a.txt") == b"x"
    assert {r.doc_id: r.text for r in files.read_zip(spark, str(tmp_path / "zip")).collect()} == {"a": "x", "b": ""}


def test_gold_variants(spark, tmp_path):
    import lzma

    def gold(name, text, file="x.csv"):
        (tmp_path / file).write_bytes(lzma.compress(text.encode()) if file.endswith("xz") else text.encode())
        return {r.word: r.gold for r in files.read_gold_named(spark, name, str(tmp_path / file)).collect()}

    assert gold("ldt-en", "Word,I_Mean_RT\na,\"1,000.5\"\nB,3\nc,#\n") == {"a": 1000.5}
    assert gold("ldt-zh", "word,RT,lexicality\na,1,1\nb,2,0\nc,,1\n") == {"a": 1.0}
    assert gold("familiarity-zh", "WORD\tFAM_M\na\t1\n# x\nb\t\n", "x.tsv.xz") == {"a": 1.0}
    assert gold("familiarity-en-paivio", "WORD  FAM\nABLE   3.5\nX  NA\n", "x.txt") == {"able": 3.5}
    assert gold("familiarity-en-glasgow", "Words,FAM\nWords,M\nshell,5\nshell (sea),4\n") == {"shell": 5.0}
    assert gold("familiarity-ja-amano", "表記,文字単語親密度\na,-1\nb,2\nb,4\n") == {"b": 3.0}
    (tmp_path / "c.tsv").write_text("id\tcontext\ttarget\tcomplexity\n1\ta \"b\tb c\t0.5\n2\tx\ty\t\n")
    assert [tuple(r) for r in files.read_complexity(spark, str(tmp_path / "c.tsv")).collect()] == [("1", 'a "b', "b c", 0.5)]


def test_registry(spark, tmp_path):
    (tmp_path / "l.tsv").write_text("word\tcount\na\t3\nb\t1\n")
    entries = files.registry({("SUBTLEX", "en"): (str(tmp_path / "l.tsv"), {}), ("CSJ", "ja"): (str(tmp_path / "l.tsv"), {})})
    assert [e["name"] for e in entries] == ["CSJ", "SUBTLEX"] and len({n for n, _ in files.CORPORA}) == 18
    assert files.load_corpora(spark, entries).count() == 4 and files.corpora(spark, entries).count() == 2
    with pytest.raises(ValueError):
        files.registry({("Nothing", "en"): ("x", {})})


def test_annotations_and_references(spark):
    rows = spark.createDataFrame([("a", "b"), ("b", ""), (None, "a")], "x string, y string")
    assert evaluation.checked_annotations(rows, ["x", "y"], ["a", "b", ""], 3) is rows
    for bad in (dict(labels=["a", ""], size=3), dict(labels=["a", "b", ""], size=4)):
        with pytest.raises(ValueError):
            evaluation.checked_annotations(rows, ["x", "y"], **bad)
    assert evaluation.concatenated(rows, ["x", "y"]).count() == 6
    one = spark.createDataFrame([("g", 1, 1.0), ("g", 2, 2.0), ("h", 1, 1.0), ("h", 2, 5.0)], "g string, k int, x double")
    two = one.filter("NOT (g = 'h' AND k = 2)").withColumn("x", -F.col("x"))
    got = {r.g: (r.r, r.n, r.n_reference) for r in evaluation.reference_correlation(one, two, ["g"], "k", "x").collect()}
    assert abs(got["g"][0] + 1) < 1e-9 and got["h"] == (None, 2, 1)
    assert evaluation.reference_correlation(one.filter("g = 'g'"), two.filter("g = 'g'"), [], "k", "x").count() == 1


def test_line_options(spark):
    rows = spark.createDataFrame([(1, 0, ["", "a  b"])], "video_id int, idx int, emitted array<string>")
    assert [r.line for r in cues.lines_of(rows, "video_id", ["idx"], new_lines=True).orderBy("pos").collect()] == ["\n", "a b\n"]
    assert [r.line for r in cues.lines_of(rows, "video_id", ["idx"], delays=False, normalize=False).collect()] == ["a  b"]


def test_stores(spark, tmp_path):
    for n in "ab":
        (tmp_path / f"{n}.txt").write_text(n * 3)
    got = files.read_store(spark, str(tmp_path), names=["b.txt"])
    assert [tuple(r) for r in got.collect()] == [("b", "bbb")]
    with pytest.raises(FileNotFoundError):
        files.read_store(spark, str(tmp_path), names=["z.txt"])
    files.read_store(spark, str(tmp_path)).write.parquet(str(tmp_path / "d.parquet"))
    assert files.read_store(spark, str(tmp_path / "d.parquet")).count() == 2


def test_outliers_and_order(spark):
    sizes = spark.createDataFrame([("en", 100), ("de", 1000)], "lang string, tokens long")
    r = spark.createDataFrame([("en", 0.5), ("de", 0.1)], "lang string, r double")
    assert [x.lang for x in evaluation.size_correlation(sizes, r, ["lang"], [("de",)]).collect()] == ["en"]
    with pytest.raises(KeyError):
        evaluation.size_correlation(sizes, r, ["lang"], [("fr",)])
    rows = spark.createDataFrame([("x",), ("CSJ",), ("GINI",)], "name string")
    assert [x.name for x in files.in_registry_order(rows, ["GINI", "CSJ"]).collect()] == ["GINI", "CSJ", "x"]


def test_scratch_tables_can_be_dropped(spark):
    from corpusfreq import session

    df, path = session.materialize(spark.range(3), "t")
    assert df.count() == 3 and path in session._MADE
    session.clear(spark)
    assert not session._MADE
    assert session.spread(spark.range(0, 10, 1, 1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_candidates_are_few(spark, monkeypatch):
    """Documents that share one rare word but little else aren't written as pairs; copies with a word more are found."""
    rows = [(k, " ".join([f"own{k}", f"shared{k % 3}", *(f"w{i}" for i in range(20))] + [f"w{i}" for i in range(20)] * 4)) for k in range(300)]
    rows += [(1000 + k, rows[k][1] + " more") for k in range(0, 300, 30)]
    docs = spark.createDataFrame(rows, "doc long, text string")
    written, real = [], dedup.materialize
    monkeypatch.setattr(dedup, "materialize", lambda df, label: (written.append((label, (out := real(df, label))[0].count())), out)[1])
    got = {(r.i, r.j) for r in dedup.search(docs, "doc", F.split("text", " ")).expanded().collect()}
    assert sum(n for label, n in written if label == "candidates") < 2000
    texts = {k: t.split(" ") for k, t in rows}
    df = Counter(t for x in texts.values() for t in set(x))
    vectors = {}
    for k, x in texts.items():
        raw = {t: n * (math.log((1 + len(rows)) / (1 + df[t])) + 1) for t, n in Counter(x).items()}
        vectors[k] = {t: v / math.sqrt(sum(u * u for u in raw.values())) for t, v in raw.items()}
    want = {(i, j) for i in vectors for j in vectors if j < i and sum(v * vectors[j].get(t, 0) for t, v in vectors[i].items()) >= 0.95}
    assert got == want and want
    again = {(r.i, r.j) for r in dedup.similar_pairs(dedup.tfidf(docs, "doc", F.split("text", " "))).collect()}
    assert again == want


def test_repeated_ids_are_one_document(spark):
    docs = spark.createDataFrame([(1, "a b c"), (1, "a d"), (2, "a a b c d"), (3, "e f"), (4, None), (5, "")], "doc long, text string")
    assert [tuple(r) for r in dedup.search(docs, "doc", T.tokens(F.col("text"))).expanded().select("i", "j").collect()] == [(2, 1)]


MAILS = ["write a@b.com, A@B.COM or c@d.org.", "to x.in@a.com see http://a.com/x@y.com?", "a@b.comedy a@b.com.org x@a.com.b@c.com", "foo.com@bar.com @h x@@y@é-ü.com -@-a.com a@b-.com q+1@1.2.3.com", "[say a@b.com] _@中国.com a@b.com@c.com a@b.comc@d.com",
         "x" * 5000 + "@" + "a." * 90 + "com", "", None]


@pytest.mark.parametrize("name", ["pii_emails", "address_log"])
def test_odd_mails_as_in_sql(spark, tmp_path, name):
    spark.createDataFrame(list(enumerate(MAILS)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert harness.difference(catalog.queries()[name](spark, str(tmp_path)), con, catalog.oracle_sql()[name]) is None


def test_gate_lets_all_addresses_pass(spark):
    texts = ["see a.com.", "a.de", "go to x.ORG!", "www.中国.中国", "a.公司 b", "[ __ ]", "【よ】", "@me", "a@b.org", "ends.It goes. On", "a. com", "1.5"]
    rows = spark.createDataFrame([(t,) for t in texts], "x string").select(F.regexp_extract_all("x", F.lit(addresses.ANY), F.lit(0)).alias("all"), addresses.found(F.col("x")).alias("found"), F.col("x").rlike(addresses.GATE).alias("gate")).collect()
    assert [r.found for r in rows] == [r.all for r in rows]
    assert [r.gate for r in rows][-3:] == [False] * 3


def test_only_slices_of_a_batch_become_objects(monkeypatch):
    monkeypatch.setattr(python_text, "SLICE", 10)
    texts = pa.array(["abc def", None, "", "x" * 50, "a b", "c d", "e f", "g h i"])[1:]
    assert all(len(s) == 1 or sum(len(x or "") for x in s.to_pylist()) <= 10 for s in python_text._slices(texts))
    assert python_text.in_slices(str.split, texts, pa.list_(pa.string())).to_pylist() == [x if x is None else x.split() for x in texts.to_pylist()]
    assert python_text.in_slices(str.upper, pa.array([], pa.string()), pa.string()).to_pylist() == []


def test_nfkc_of_distinct_words(spark):
    rows = spark.createDataFrame([("ﬁx",), ("a",), (None,), ("ﬁx",), ("Ａ",), ("é",), ("",)], "x string").coalesce(1)
    assert [r[0] for r in rows.select(python_text.nfkc(F.col("x"))).collect()] == ["fix", "a", None, "fix", "A", "é", ""]


def test_mean_log_joins_rare_words_only(spark, monkeypatch):
    monkeypatch.setattr(lookup, "FREQUENT", 2)
    written, real = [], lookup.materialize
    monkeypatch.setattr(lookup, "materialize", lambda df, label: (written.append((out := real(df, label))[0].count()), out)[1])
    texts = {1: "a b a c d d".split(), 2: "a b b e".split(), 3: ["z"], 4: ["a", "b"]}
    tokens = spark.createDataFrame([(k, w) for k, ws in texts.items() for w in ws], "doc long, word string")
    n = {"a": 9, "b": 8, "c": 2, "d": 1, "e": 3}
    freq = spark.createDataFrame(list(n.items()), "word string, count long")
    got = {r.doc: (round(r.x, 9), r.nt) for r in lookup.mean_log(tokens, freq, ["doc"]).collect()}
    assert got == {k: (round(sum(math.log10((n.get(w, 0) + 1) / (sum(n.values()) + len(n))) for w in ws) / len(ws), 9), len(ws)) for k, ws in texts.items()}
    assert written == [7]  # a row a document for a and b, one for each other word of a document


def test_ngram_norms_against_brute_force(spark):
    rows = [(1, "a b a b c"), (1, "c a"), (2, "a b"), (3, None), (4, "x"), (5, "")]
    got = {r.doc: (r.n_terms, round(r.norm, 6)) for r in dedup.norms(spark.createDataFrame(rows, "d long, text string"), "d", T.tokens(F.col("text")), 1, 2).collect()}
    counts: dict[int, Counter] = {}
    for k, t in rows:
        w = (t or "").split()
        counts.setdefault(k, Counter()).update([*w, *map(" ".join, zip(w, w[1:]))])
    df = Counter(t for c in counts.values() for t in c)
    want = {k: (len(c), round(math.sqrt(sum((n * (math.log((1 + len(rows)) / (1 + df[t])) + 1)) ** 2 for t, n in c.items())), 6)) for k, c in counts.items() if c}
    assert got == want


def test_grain_and_totals_move_texts_not_tokens(spark):
    docs = spark.createDataFrame([(1, "s", "a B b"), (1, "s", "a"), (2, "", "a"), (3, None, "c"), (4, "t", None)], "doc long, source string, text string")
    grain = frequency.words(docs, "doc", T.matches(F.col("text")), "source", form=lambda t: F.lower(T.as_token(t)))
    plan = grain._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "REPARTITION" in plan
    assert sorted((r.doc, r.word, r.n) for r in grain.collect()) == [(1, "a", 2), (1, "b", 2), (2, "a", 1), (3, "c", 1)]
    assert [(r.word, r["count"], r.videos, r.channels) for r in frequency.word_counts(grain).orderBy("word").collect()] == [("a", 3, 2, 2), ("b", 2, 1, 1), ("c", 1, 1, 1)]
    assert tuple(frequency.totals(grain, docs, "doc", "source").select("count", "videos", "channels").first()) == (6, 3, 4)


def test_tokens_as_before(spark):
    long = rf"[a-zA-Z_{T.WAVE}{T.WORD}&&[^{T.DIGIT}]]++|['\\-]|[{T.DIGIT}]++".replace("\\\\", "\\")
    texts = ["".join(map(chr, range(1, 0x250))), "été_1², a-b 'c' 12③x 日本語〜é2Ⅷ ٣ [x] {y} `z` ~", "❶⑴⒈🄀 á", "\x00a\x7fb"]
    rows = spark.createDataFrame([(t,) for t in texts], "x string").select(F.regexp_extract_all("x", F.lit(long), F.lit(0)).alias("a"), T.matches(F.col("x")).alias("b"), F.regexp_count("x", F.lit(T.TOKEN)).alias("n")).collect()
    assert [r.a for r in rows] == [r.b for r in rows] and [len(r.a) for r in rows] == [r.n for r in rows]


def test_normal_forms_are_counted_in_one_pass(spark):
    docs = spark.createDataFrame([(1, "s", "x", "The the ﬁx fix"), (1, "s", "x", "the"), (2, "s", "y", "THE Fix"), (3, None, "x", "ﬁX the"), (4, "t", "y", "fix Ａ a")], "doc long, source string, cat string, text string")
    before = set(session._MADE)
    grain = frequency.words(docs, "doc", F.split("text", " "), "source", "cat")
    out = frequency.norm_counts(grain, ["x", "y"])
    assert set(session._MADE) == before  # nothing is written between
    forms = {"none": str, "lower": str.lower, "nfkc": lambda w: unicodedata.normalize("NFKC", w), "nfkc-lower": lambda w: unicodedata.normalize("NFKC", w).lower()}
    want = {}
    for r in docs.collect():
        for w in r.text.split(" "):
            for norm, f in forms.items():
                x = want.setdefault((norm, f(w)), [0, set(), set(), Counter()])
                x[0] += 1
                x[1].add(r.doc), x[2].add(r.source or r.doc), x[3].update([r["cat"]])
    got = {(r.norm, r.word): (r["count"], r.videos, r.channels, r["count:x"], r["count:y"]) for r in out.collect()}
    assert got == {k: (n, len(d), len(c), by["x"], by["y"]) for k, (n, d, c, by) in want.items()}
    some = frequency.norm_counts(grain, forms=["lower", "nfkc"])
    assert {(r.norm, r.word): r["count"] for r in some.collect()} == {k: v[0] for k, v in want.items() if k[0] in ("lower", "nfkc")}


def test_tagged_numbers_only_where_there_are_digits(spark):
    rows = [["a", "b"], ["a1b", "<num>"], ["x", "<num>", "<num>"], ["", "y²", "3"], [], None]
    docs = spark.createDataFrame([(r,) for r in rows], "t array<string>").select(F.transform("t", lambda t: F.struct(t.alias("token"), F.lit("X").alias("pos"))).alias("t"))
    got = [None if r[0] is None else [(x.token, x.pos) for x in r[0]] for r in docs.select(T.replace_tagged_numbers(F.col("t"))).collect()]
    n = ("<num>", "NUM")
    assert got == [[("a", "X"), ("b", "X")], [("a", "X"), n, ("b", "X"), n], [("x", "X"), n], [("", "X"), ("y", "X"), n], [], None]
    plan = docs.select(T.replace_tagged_numbers(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN RLIKE(array_join(" in plan


def test_weights_with_rare_terms_joined(spark, monkeypatch):
    monkeypatch.setattr(dedup, "FREQUENT", 2)
    rows = [(1, "a b a"), (1, "c"), (2, "a d B"), (3, None), (4, "b c")]
    out = dedup.tfidf(spark.createDataFrame(rows, "d long, text string"), "d", T.matches(F.col("text")), F.lower)
    assert "LeftOuter" in out._jdf.queryExecution().executedPlan().toString()
    counts = {1: Counter("aabc"), 2: Counter("adb"), 4: Counter("bc")}
    df = Counter(t for c in counts.values() for t in c)
    raw = {(k, t): n * (math.log((1 + len(rows)) / (1 + df[t])) + 1) for k, c in counts.items() for t, n in c.items()}
    want = {(k, t): (df[t], round(v / math.sqrt(sum(u * u for (j, _), u in raw.items() if j == k)), 9)) for (k, t), v in raw.items()}
    assert {(r.doc, r.term): (r.df, round(r.weight, 9)) for r in out.collect()} == want
