"""Fill-in-the-middle, collocations and toxicity against brute force."""

import hashlib
import math
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from furrow.llm import collocations, fim, langid, quality, toxicity

# 12: fill in the middle


def fim_by_hand(doc_id, text, unit="codepoint"):
    text = text or ""
    if unit == "codepoint":
        at = list(range(len(text)))
    else:
        at = [i for i in range(len(text)) if i == 0 or (text[i] not in " \t\n\v\f\r" and text[i - 1] in " \t\n\v\f\r")]
    n, at = len(at), [*at, len(text)]
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    d = [int(h[k : k + 8], 16) for k in (0, 8, 16, 24)]
    if not text or any(s in text for s in fim.SENTINELS) or d[2] % 100 >= 90:
        return n, "plain", None, None, text
    i, j = sorted((d[0] % (n + 1), d[1] % (n + 1)))
    a, b, z = text[: at[i]], text[at[i] : at[j]], text[at[j] :]
    if d[3] % 100 < 20:
        return n, "spm", i, j - i, f"<S>{z}<P>{a}<M>{b}"
    return n, "psm", i, j - i, f"<P>{a}<S>{z}<M>{b}"


@pytest.mark.parametrize("unit", fim.UNITS)
def test_cuts_equal_cutting_by_hand_and_texts_come_back(spark, unit):
    rng = np.random.default_rng(5)
    letters = list("abcdeé\n ß中😀 <>PSM\t")
    texts = ["".join(rng.choice(letters, n)) for n in [*range(40), 5000, 70_000, 300_000]]
    texts += [None, "", "has <P> inside", "a<S", "́́", "   lead", "x" * 30_000, texts[-2], texts[-2]]
    rows = [(i if i % 7 else None, t, "kept", 1, 2) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, _text string, form int, c0 int")
    got = fim.transform(df, unit=unit).withColumn("back", fim.restore(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(rows)
    seen = Counter((r.doc_id, r.text, r.n_units, r.form, r.prefix_units, r.middle_units, r.output) for r in got)
    assert seen == Counter((i, t, *fim_by_hand(i, t, unit)) for i, t, *_ in rows)
    assert all(r.back == (r.text or "") and r._text == "kept" and r.c0 == 2 for r in got)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_chunks_cover_a_text_and_copies_are_counted_once():
    rng = np.random.default_rng(6)
    shared = bytes(rng.integers(97, 123, 40_000, dtype=np.uint8))
    first, second = b"one beginning " * 30 + shared, b"another " * 77 + shared
    for data in (first, second, b"", b"a", b"a" * 100_000, shared * 120):
        ends = fim.ends_of_chunks(data)
        sizes = np.diff([0, *ends])
        assert (ends[-1] if ends else 0) == len(data) and all(0 < s <= fim.MOST for s in sizes)
        assert all(s >= fim.LEAST for s in sizes[:-1])
    # Boundaries agree inside the shared passage, so its chunks are found again.
    tails = [{len(d) - e for e in fim.ends_of_chunks(d)} for d in (first, second)]
    assert len(tails[0] & tails[1]) > 0.7 * min(map(len, tails))
    counter = fim.Counter()
    counter.summaries(first)
    assert counter.found == 0
    counter.summaries(second)
    assert counter.found > 20
    small = fim.Counter(memo_bytes=10_000)
    assert small.summaries(first) == counter.summaries(first) and small.held <= 10_000


def test_empty_table_of_texts_to_cut(spark):
    out = fim.transform(spark.createDataFrame([], "doc_id bigint, text string"))
    assert out.count() == 0 and out.columns == ["doc_id", "text", "n_units", "form", "prefix_units", "middle_units", "output"]
    with pytest.raises(ValueError):
        fim.transform(spark.createDataFrame([], "doc_id bigint, text string"), unit="line")


# 13: collocations


def phrases_by_hand(rows, least, top=None, longest=4):
    counts, sizes = {}, Counter()
    for lang, text in rows:
        lang = lang or "und"
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = re.findall("[^ \t]+", piece)
            sizes[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(w[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        cands = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in cands.items():
            inside = any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in cands.items())
            if not inside:
                score, _, left, right = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                kept.append((" ".join(p), a, left, right, sizes[lang], score))
        kept.sort(key=lambda r: (-r[5], -r[1], r[0].encode()))
        out += [(lang, i + 1, *r) for i, r in enumerate(kept[:top])]
    return sorted(out)


def some_texts(n=300):
    rng = np.random.default_rng(8)
    words = ["a", "b", "The", "the", "ça", "中文", "x-y", "q r", "zz", "0"]
    rows = []
    for i in range(n):
        w = rng.choice(words, int(rng.integers(0, 40)), p=[0.3, 0.2, 0.1, 0.1, 0.1, 0.05, 0.05, 0.04, 0.03, 0.03])
        rows.append((["en", "fr", None, "und"][i % 4], "".join(x + [" ", "  ", "\t", ".", ", ", "\n"][int(rng.integers(0, 6) * (rng.random() < 0.4))] for x in w)))
    return rows + [("en", None), ("en", ""), ("en", "the same line again and again. " * 50), ("de", "only once here"), *rows[:5]]


@pytest.mark.parametrize("bits", [1 << 27, 1 << 15])
def test_collocations_equal_counting_by_hand(spark, bits):
    rows = some_texts()
    df = spark.createDataFrame([(*r, "x") for r in rows], "lang string, text string, word string").repartition(5)
    for least, top, longest in ((3, None, 4), (10, 4, 4), (5, None, 2)):
        got = collocations.collocations(df, min_count=least, top=top, filter_bits=bits, max_words=longest).collect()
        assert sorted(map(tuple, got)) == phrases_by_hand(rows, least, top, longest)


def test_stripes_hold_exact_prefix_totals_whatever_the_filter_lets_through(spark):
    rows = some_texts(80)
    df = spark.createDataFrame(rows, "lang string, text string")
    everything = np.full((1 << 15) // 8, 255, np.uint8)
    got = collocations.stripes(df, [1], everything, 0, min_count=2).groupBy("lang", "w1").agg(F.sum("total").alias("f"), F.sum(F.size("next")).alias("e"))
    words = collocations.count_words(df, 0)
    assert not words.where("clash").count()
    named = got.join(words.withColumnRenamed("h", "w1"), ["lang", "w1"])
    assert named.where("f = n").count() == words.count() == named.count()
    assert got.where("w1 = 0").agg(F.sum("f")).first()[0] == words.agg(F.sum("n")).first()[0]


def test_long_texts_are_cut_into_blocks_between_pieces(monkeypatch):
    monkeypatch.setattr(collocations, "BLOCK", 64)
    text = "Some words, then more words; and a piece without end " + "long " * 60 + ". done\nNew line"
    batch = pa.RecordBatch.from_arrays([pa.array(["en", "fr", "en"]), pa.array([text.encode(), b"x y", b"A b"])], names=["lang", "t"])
    blocks = list(collocations._blocks([batch, batch]))
    pieces = lambda data: Counter(p for p in re.split(rb"[.,;:!?\n-\r]", data) if p.strip())
    for lang, want in (("en", text.lower().encode() + b"\na b"), ("fr", b"x y")):
        found = Counter()
        for own, data in blocks:
            found += pieces(data) if own == lang else Counter()
        assert found == pieces(want + b"\n" + want)


def test_collocations_of_an_empty_table(spark):
    out = collocations.collocations(spark.createDataFrame([], "lang string, text string"))
    assert out.count() == 0 and out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


# 11: toxicity


def kernel_by_hand(a, b):
    def vector(word):
        c = [27, *toxicity.codes(word), 27]
        v = Counter()
        for i in combinations(range(len(c)), toxicity.ORDER):
            if i[-1] - i[0] < toxicity.SPAN:
                v[tuple(c[k] for k in i)] += toxicity.DECAY ** (i[-1] - i[0] - toxicity.ORDER + 1)
        return v

    x, y = vector(a), vector(b)
    norm = math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
    return sum(v * y[k] for k, v in x.items()) / norm if norm else 0.0


def test_kernel_equals_enumerating_subsequences():
    words = ["idiot", "idxiot", "iidiot", "clown", "a", "", "ab", "réeux", "aaaaaaa", "worthless", "中文字符"]
    got = toxicity.kernel(words, words)
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            assert abs(got[i, j] - kernel_by_hand(a, b)) < 1e-9, (a, b)


def test_folded_weights_equal_the_kernel_with_every_landmark():
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefgh"), int(n))) for n in rng.integers(2, 10, 200)]
    model = toxicity.machine(words[:20], words, np.where(rng.random(200) < 0.3, 1.0, -1.0), np.ones(200))
    want = toxicity.kernel(words, list(model.landmarks)) @ model.alphas + model.offset
    assert np.allclose(model.values(words), want)


def test_products_equal_the_feature_vectors():
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdeé"), int(n))) for n in rng.integers(0, 21, 500)]
    weights = rng.normal(size=toxicity.BUCKETS)
    row, key, value = toxicity.features(words)
    assert np.allclose(toxicity.products(words, weights), np.bincount(row, value * weights[key], minlength=len(words)))


def test_sampled_labels_are_whole_while_they_fit_and_bounded_beyond(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic")).unionByName(spark.createDataFrame([(1, None), (9999, 1)], "doc_id bigint, toxic int"))
    assert toxicity.labelled_sample(docs, labels).count() == 3000
    few = toxicity.labelled_sample(docs, labels, fit_rows=200).groupBy("toxic").count().collect()
    assert all(120 < r["count"] < 300 for r in few) and len(few) == 2


def test_spaced_and_marked_letters_are_read_as_words():
    assert "stupid" in toxicity.tokens_of("you s t u p i d one") and "idiot" in toxicity.words_of_token("i.d-i*o.t")
    assert toxicity.words_of_token("st*upid!") == ["stupid"] or "stupid" in toxicity.words_of_token("st*upid!")
    assert "idiot" in toxicity.words_of_token("1d10t") and toxicity.words_of_token("!!") == []
    assert {"well", "known", "wellknown"} == set(toxicity.words_of_token("well-known"))
    assert all(len(w) <= toxicity.LONGEST for w in toxicity.words_of_token("z" * 500))


@pytest.fixture(scope="module")
def judged(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "toxic")
    held_out = langid.remainder("doc_id", 5) == 0
    model = toxicity.fit(toxicity.labelled_sample(docs.where(~held_out), labels))
    return model, docs.withColumn("held_out", held_out).join(labels, "doc_id")


def test_held_out_insults_are_found_and_clean_texts_left_alone(judged):
    model, docs = judged
    got = toxicity.score(docs, model, sentences=True).toPandas()
    english = got[(got["lang"] == "en")]
    assert (english[english["toxic"] == 1]["predicted"] == 1).mean() > 0.85
    assert got[got["toxic"] == 0]["predicted"].mean() < 0.02
    assert got["score"].between(0, 1).all() and ((got["score"] >= 0.5) == (got["predicted"] == 1)).all()
    found = got[(got["predicted"] == 1) & got["toxic_sentence"].notna()]
    assert len(found) and all(w in s.lower() for w, s in zip(found["toxic_word"], found["toxic_sentence"], strict=True))


def test_toxicity_of_odd_rows(spark, judged):
    model, _ = judged
    texts = [None, "", "  \n", "123 ...", "you idiot", "you idiot", "you i.d.i.o.t!", "a s t u p i d thing", "the " * 200_000 + "idiot " + "of " * 200_000]
    df = spark.createDataFrame([(i, t, 5, "s") for i, t in enumerate(texts)], "doc_id bigint, text string, score int, i0 string")
    got = toxicity.score(df, model).orderBy("doc_id").toPandas()
    assert list(got.columns) == ["doc_id", "i0", "score", "predicted", "toxic_word"]
    assert got["score"][:4].nunique() == 1 and got["score"][0] < 0.1 and got["toxic_word"][:4].isna().all()
    assert got["predicted"].tolist()[4:] == [1] * 5 and got["score"][4] == got["score"][5]
    # A text counts as its most toxic word, however long it is.
    assert got["score"][8] == got["score"][4]
    assert toxicity.score(df.limit(0), model).count() == 0


def test_training_without_both_labels(spark):
    rows = [("a bad text", 1), ("another", 1), (None, 0), ("x", None)]
    df = spark.createDataFrame(rows, "text string, toxic int")
    one, none = toxicity.fit(df), toxicity.fit(df.limit(0))
    assert [r.score for r in toxicity.score(df, one).collect()] == [1.0] * 4
    assert [r.score for r in toxicity.score(df, none).collect()] == [0.0] * 4
    few = spark.createDataFrame([("only a", 1), ("only b", 0), ("", 1), ("", 0)], "text string, toxic int")
    assert toxicity.score(few, toxicity.fit(few)).where("score BETWEEN 0 AND 1").count() == 4


# 9: the limit of a host's lines


def test_footers_stay_removed_when_copies_join_the_host(spark):
    footer = "all rights reserved by the host"
    rows = [(i, "h", " ".join(f"d{i}w{k}" for k in range(60)) + "\n" + footer) for i in range(60)]
    copies = [(1000 + i, "h", "one other text " + " ".join(f"c{k}" for k in range(60))) for i in range(7000)]
    for extra in ([], copies):
        df = spark.createDataFrame(rows + extra, "doc_id bigint, source string, text string")
        got = quality.line_rules(df, max_docs=50).where("doc_id < 1000").agg(F.sum("n_removed_lines"), F.count_if("kept")).first()
        assert tuple(got) == (60, 60)
        assert quality.line_rules(df, max_docs=60).where("n_removed_lines > 0").isEmpty()


def test_names_of_the_caller_come_through_the_line_rules(spark):
    names = "_t _hashed _gone _removed _w _h1 _h3 _lines _sorted _row _host h".split()
    df = spark.createDataFrame([(1, "h", "a b c\n" * 3, *range(len(names)))], ["doc_id", "source", "text", *names])
    row = quality.line_rules(df).first()
    assert [row[n] for n in names] == list(range(len(names)))
    assert quality.kept_documents(df).columns == df.columns
    assert quality.line_rules(df.withColumnRenamed("doc_id", "_id").withColumnRenamed("source", "_s"), host="_s", id_col="_id").first()["_id"] == 1
