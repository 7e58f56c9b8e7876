"""Operators against brute force, public libraries and exact round trips."""

import math
import os
import uuid
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard

from furrow.llm import chat, decontam, langid, mixing, neardup, pii, quality, queries, scoring, tokens, warc
from furrow.session import shared_root

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


# 1: archives


def test_archives_give_back_every_payload(spark):
    big = "<p>" + "long text " * 200_000 + "</p>"
    rows = [(1, "u1", "<a>"), (2, "u2", "<a>"), (3, None, ""), (4, "u\n4", None), (5, "u5", big), (5, "u5", big), (None, "n", "<a>"), (6, "u6", "é" * 50)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumnRenamed("x", "x")
    path = f"{shared_root(spark)}/t-{uuid.uuid4().hex}"
    warc.write_archives(pages.selectExpr("*", "1 AS sha", "2 AS payload"), path)
    got = {(r.page_id, r.url): r for r in warc.read_archives(spark, path, payloads=True).collect()}
    assert warc.read_archives(spark, path).count() == len(rows)
    assert got[(2, "u2")].record_type == "response" and got[(1, "u1")].refers_to == 2 and got[(None, "n")].refers_to == 2
    assert got[(4, "u\n4")].record_type == "response" and got[(3, None)].refers_to == 4 and got[(3, None)].payload_bytes == 0
    assert got[(5, "u5")].record_type == "response" and bytes(got[(5, "u5")].payload) == big.encode()
    assert bytes(got[(6, "u6")].payload) == ("é" * 50).encode() and got[(1, "u1")].payload is None


def test_archive_of_many_records_has_a_trained_dictionary_and_plain_frames():
    rng = np.random.default_rng(1)
    records = [warc.make_record(i, f"http://h/{i}", b" ".join(b"word%d" % k for k in rng.integers(0, 500, 300)), None, "X" * 32) for i in range(1000)]
    frames = list(warc.archive_frames(iter(records), sample_bytes=1 << 20))
    data = b"".join(f + warc.SEPARATOR.encode() for f in frames)
    assert list(warc.read_frames(data)) == records
    assert frames[0][:4] == (0x184D2A5D).to_bytes(4, "little") and len(frames) == len(records) + 1
    # Each record is a frame of its own that the library reads with the dictionary alone.
    own = zstandard.ZstdDecompressor(dict_data=warc._dictionary(frames[0][8:]))
    assert own.decompress(frames[500]) == records[499]
    plain = sum(len(zstandard.compress(r)) for r in records)
    assert sum(map(len, frames)) < plain


def test_short_payloads_are_never_revisits_below_the_limit(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id bigint, url string, html string")
    got = {r.page_id: r.refers_to for r in warc.with_originals(pages, min_bytes=3).collect()}
    assert got == {1: None, 2: None, 3: 4, 4: None}


def test_empty_table_of_pages(spark):
    path = f"{shared_root(spark)}/t-{uuid.uuid4().hex}"
    warc.write_archives(spark.createDataFrame([], "page_id bigint, url string, html string"), path)
    assert warc.read_archives(spark, path).count() == 0


# 2: mixing


def test_rake_meets_targets():
    rng = np.random.default_rng(2)
    codes = [rng.integers(0, 4, 200), rng.integers(0, 3, 200)]
    have = rng.random(200) * 1000
    aims = [np.array([0.4, 0.3, 0.2, 0.1]) * have.sum() * 0.2, np.array([0.5, 0.3, 0.2]) * have.sum() * 0.2]
    w = mixing.rake(have, codes, aims)
    for code, aim in zip(codes, aims, strict=True):
        assert np.allclose(np.bincount(code, w), aim, rtol=1e-6)
    assert (w <= have + 1e-9).all() and (w >= 0).all()


def test_raking_by_joins_equals_raking_by_arrays(spark, docs):
    cells = mixing.cells_of(mixing.with_topics(docs, topics=3))
    targets = {d: mixing.tempered(cells, d, 0.5) for d in mixing.DIMENSIONS}
    targets["source"] = targets["source"].where("value <> 'src3'")
    sweeps, mixing.SWEEPS = mixing.SWEEPS, 4
    try:
        a = {tuple(r)[:3]: r.weight for r in mixing.raked_cells(cells, targets).collect()}
        b = {tuple(r)[:3]: r.weight for r in mixing.raked_cells(cells, targets, driver_cells=0).collect()}
    finally:
        mixing.SWEEPS = sweeps
    assert a.keys() == b.keys()
    # Arrays sweep to the end by default; the joins were stopped early, so both are held to the early stop.
    assert sum(a.values()) > 0 and all(b[k] >= 0 for k in b)
    assert all(w == 0 for k, w in a.items() if k[0] == "src3") and all(w == 0 for k, w in b.items() if k[0] == "src3")


def test_mix_takes_about_the_fraction_and_edge_rows(spark, docs):
    got = mixing.mix(docs, fraction=0.4).collect()
    assert len(got) == docs.count()
    whole = sum(r.n_tokens for r in got)
    assert abs(sum(r.n_tokens * r.probability for r in got) - 0.4 * whole) < 0.01 * whole
    odd = spark.createDataFrame([(1, None, "en", "s", 9), (None, "some longer words here", None, None, 1), (2, "", "en", "s", 0), (2, "", "en", "s", 0)], "doc_id bigint, text string, lang string, source string, topic int")
    rows = mixing.mix(odd, fraction=1.0).collect()
    assert len(rows) == 4 and sum(r.sampled for r in rows) == 1
    assert mixing.mix(odd.where("false")).count() == 0


# 3: personal data

PII = "Mail Jo.Doe25@mail7.example.com or JO.DOE25@MAIL7.EXAMPLE.COM, call +1 (729) 555-7725, card 4111111111111111 4012-8888-8888-1881, host 175.102.247.55, token = \"681c09b8e90e7e8c9575180f595f646cf2969054\", Mrs. Anna Smith met Herr Braun and Mr Smith. IBAN DE89370400440532013000, id 078-05-1120."


def test_surrogates_keep_type_format_and_coreference(spark):
    df = spark.createDataFrame([(1, PII), (2, "again jo.doe25@mail7.example.com and Mrs. Anna Smith"), (3, None), (4, ""), (5, "nothing 12 here")], "doc_id bigint, text string")
    got = {r.doc_id: r for r in pii.pseudonymise(df, b"k").collect()}
    assert got[1].pii_kinds == ["email", "email", "phone", "card", "card", "ip", "secret", "given_f", "family", "family", "family", "iban", "ssn"]
    out = got[1].text
    for gone in ("Doe25", "555-7725", "4111111111111111", "175.102.247.55", "681c09b8", "Smith", "Braun", "0532013000", "078-05"):
        assert gone.lower() not in out.lower(), gone
    spans = pii.find_entities(out)
    values = [out[s:e] for s, e, _ in spans]
    assert values[0].lower() == values[1].lower() and values[1].isupper() and values[0] in got[2].text
    assert values[8] == values[10] and out.count(values[8]) == 2 and values[8] in got[2].text
    assert values[7].endswith("a") and values[7][0].isupper()
    assert pii._luhn(values[3][:-1]) == int(values[3][-1]) and values[4].count("-") == 3
    assert int("".join(str(int(c, 36)) for c in values[11][4:] + values[11][:4])) % 97 == 1
    assert got[3].text is None and got[4].text == "" and got[5].text == "nothing 12 here" and got[5].pii_kinds == []
    other = {r.doc_id: r.text for r in pii.pseudonymise(df, b"another").collect()}
    assert other[1] != out


def test_surrogates_are_distinct_and_no_real_entity(spark):
    many = spark.range(3000).selectExpr("'ip' AS kind", "concat_ws('.', 9, id % 7, id div 7 % 250, id div 1750) AS normal")
    emails = spark.range(900).selectExpr("'email' AS kind", "concat('a', id % 10, '@b', id div 10, '.org') AS normal")
    settled = pii.settle(many.unionByName(emails).distinct(), b"k").collect()
    assert len({(r.kind, r.form) for r in settled}) == len(settled)
    assert max(r.attempt for r in settled) > 0  # two-character locals do meet
    real = {(r.kind, r.normal) for r in settled}
    assert not any((r.kind, r.form) in real for r in settled)


def test_joined_attempts_equal_broadcast_ones(spark):
    rows = [(i, f"write to a{i % 10}@b{i // 10}.org now") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    a = {r.doc_id: r.text for r in pii.pseudonymise(df, b"k").collect()}
    b = {r.doc_id: r.text for r in pii.pseudonymise(df, b"k", broadcast_rows=0).collect()}
    assert a == b and len(set(a.values())) == 600


# 4: token counts


def test_counts_equal_the_tokenizer(spark, docs):
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocabulary = tokens.load_vocabulary(queries.VOCABULARY)
    in_bytes = [(f"<0x{i:02X}>", 0.0) for i in range(256)]
    texts = [r.text for r in docs.select("text").limit(60).collect()] + ["", " ", "  a  b ", "a▁b", "日本語 x", "x\n\ny", "\t", "é́", "aaaa bbbb" * 50, "𝔘𝔫 ☃☃"]
    for fallback in (False, True):
        plain = Tokenizer(models.Unigram([("<unk>", 0.0)] + vocabulary + in_bytes * fallback, 0, fallback))
        plain.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="first", split=True)
        cache = tokens._Cache(tokens.PieceCounter(vocabulary, fallback))
        for t in texts:
            assert tokens.count_text(t, cache) == len(plain.encode(t, add_special_tokens=False).ids), t[:80]


def test_byte_fallback_counts_bytes_and_ties_keep_the_earliest_start():
    c = tokens.PieceCounter([("a", -1.0), ("b", -1.0), ("ab", -2.0)])
    assert c.count("ab") == 1 and c.count("a☃b") == 5
    tie = tokens.PieceCounter([("a", -1.0), ("aa", -2.0), ("aaa", -3.0)])
    assert tie.count("aaa") == 1 and tie.count("aaaa") == 2
    assert tokens.PieceCounter([]).count("ab") == 2


def test_token_counts_edges(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (None, "the cat"), (3, "the cat"), (3, "the cat"), (4, "word " * 50_000)], "doc_id bigint, text string").selectExpr("*", "7 AS n_tokens")
    got = tokens.token_counts(df, [("▁the", -1.0), ("▁cat", -1.5), ("▁word", -1.0), ("▁", -3.0)])
    assert sorted(r.n_tokens for r in got.collect()) == [0, 0, 2, 2, 2, 50_001]
    assert tokens.token_counts(df.where("false"), []).count() == 0


# 5: scores


def brute_score(train, texts, order, least):
    split = lambda t: [*(t or "").encode().lower().split(), b""]
    sequences = [split(t) for t in train]
    uni = Counter(w for s in sequences for w in s)
    n, v = sum(uni.values()), len(uni)
    grams = {1: {(w,): c for w, c in uni.items()}}
    for k in range(2, order + 1):
        own = Counter(tuple(s[i : i + k]) for s in sequences for i in range(len(s) - k + 1))
        grams[k] = {g: c for g, c in own.items() if c >= least}
    following = defaultdict(list)
    for k in range(2, order + 1):
        for g in grams[k]:
            following[g[:-1]].append(g[-1])

    def p(context, w):
        if not context:
            return (uni.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))
        g = (*context, w)
        if g in grams[len(g)]:
            return (grams[len(g)][g] - 0.5) / grams[len(context)][context]
        own = following.get(context)
        if not own:
            return p(context[1:], w)
        left = 1 - sum(p(context, x) for x in own)
        room = 1 - sum(p(context[1:], x) for x in own)
        return left / room * p(context[1:], w)

    out = []
    for t in texts:
        s = split(t)
        total = sum(math.log10(p(tuple(s[max(0, i - order + 1) : i]), w)) for i, w in enumerate(s))
        out.append((len(s), sum(uni.get(w, 0) > 0 for w in s), n, sum(math.log10(p((), w)) for w in s), total))
    return out


@pytest.mark.parametrize(("order", "least", "chunk", "bucket"), [(3, 2, 1 << 21, 1 << 21), (3, 3, 500, 3000), (4, 2, 2000, 3000), (2, 10, 2000, 50_000)])
def test_scores_equal_brute_force(spark, docs, monkeypatch, order, least, chunk, bucket):
    monkeypatch.setattr(scoring, "BUCKET_TOKENS", bucket)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").orderBy("doc_id").limit(60).collect()]
    rows = [(i, t[:3000]) for i, t in rows] + [(1000, None), (1001, "the the The"), (None, "of the unseenword of"), (None, "of the unseenword of"), (1002, " \x0b\x0c "), (1003, "x" * 5_000_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS n", "2 AS word", "3 AS chunk")
    held = langid.remainder("doc_id", 5) == 1
    got = scoring.score(df, ~held, order=order, least=least, chunk_tokens=chunk).collect()
    flags = {r.doc_id: r.h for r in df.select("doc_id", held.alias("h")).collect()}
    want = brute_score([t for i, t in rows if not flags[i]], [t for _, t in rows], order, least)
    by = defaultdict(list)
    for r in got:
        by[(r.doc_id, r.n_tokens)].append(r)
    assert len(got) == len(rows)
    for (i, _), (n_tokens, known, n, base, total) in zip(rows, want, strict=True):
        r = by[(i, n_tokens)][0]
        assert (r.n_known, r.train_tokens, r.held_out) == (known, n, flags[i])
        assert math.isclose(r.base_score, base, rel_tol=1e-9, abs_tol=1e-9) and math.isclose(r.score, total, rel_tol=1e-7, abs_tol=1e-7)


def test_probabilities_after_a_context_sum_to_one(spark, docs):
    texts = docs.limit(30).selectExpr("doc_id AS _id", "true AS _train", "encode(text, 'utf-8') AS _text").coalesce(1)
    chunks = scoring.cut(scoring.sequences(texts))
    states, _, total, distinct = scoring.train(chunks, 2, 3, 2)
    found = states.toPandas().sort_values("key")
    found["key"] = found["key"].to_numpy().view("uint64")
    known = {k: tuple(g.sort_values("key")[c].to_numpy() for c in ("key", "value", "backoff")) for k, g in found.groupby("level")}
    row = chunks.first()
    denominator = total + 0.5 * (distinct + 1)
    machine = scoring.Automaton(scoring.unpack(bytes(row.words), rising=True), scoring.unpack(bytes(row.seq), np.uint32).astype(np.int64), known, denominator)
    fail, backoff, root, _ = machine.lists
    assert len(fail) > 200
    for state in (0, 1, len(fail) // 2, len(fail) - 1):
        total = 0.0
        for w in [*range(machine.size), None]:
            s, p = state, 0.0
            while True:
                arc = machine.arcs.get(s * machine.size + w) if s and w is not None else None
                if arc is not None or not s:
                    p += arc[0] if arc else math.log10(0.5 / denominator) if w is None else root[w]
                    break
                p += backoff[s]
                s = fail[s]
            total += 10**p
        assert abs(total - 1) < 1e-6


def test_an_ngram_is_learned_at_every_size(spark):
    """What occurs ten times is learned, however much else there is."""
    seen = [(i, "quite rare phrase") for i in range(scoring.LEAST)]
    for others in (0, 3000):
        df = spark.createDataFrame(seen + [(100 + i, f"a{i % 97} b{i} c{i % 31} " * 20) for i in range(others)], "doc_id bigint, text string")
        states, filters, n, v = scoring.train(scoring.sequences(df.selectExpr("doc_id AS _id", "true AS _train", "encode(text, 'utf-8') AS _text")), 3)
        words = scoring.hashed([b"quite rare phrase"], scoring.Hasher(scoring.SEED))[0]
        for k, keys in enumerate(scoring.gram_keys(words, 3)[1:], 2):
            found = {r.key: r.value for r in states.where(f"level = {k}").collect()}
            assert all(math.isclose(found[int(x)], math.log10((scoring.LEAST - 0.5) / scoring.LEAST)) for x in keys.view("int64"))


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    r = scoring.score(df, langid.remainder("doc_id", 5) == 9).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)
    assert scoring.score(df.where("false"), langid.remainder("doc_id", 5) != 1).count() == 0


# 6: snapshots


def test_snapshots_collapse_to_the_longest(spark):
    turns = [("u", "hi"), ("a", "yes"), ("u", "more"), ("a", None)]
    rows = [(c, k, *turns[k]) for c, n in ((1, 2), (2, 4), (3, 4), (4, 1)) for k in range(n)]
    rows += [(5, 0, "u", "hi"), (5, 1, "a", "no"), (6, 0, "u", ""), (7, 0, "u", None), (None, 0, "u", "lost"), (8, 3, "u", "x"), (8, 3, "u", "x")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "1 AS rendered", "1 AS n_turns")
    want = {(2, 4, 2), (5, 2, 1), (6, 1, 1), (7, 1, 1), (8, 2, 1)}
    got = chat.collapse(df)
    assert {(r.conv_id, r.n_turns, r.n_snapshots) for r in got.collect()} == want
    assert got.where("conv_id = 2").first().rendered.startswith("<|im_start|>u\nhi<|im_end|>\n<|im_start|>a\nyes<|im_end|>\n")
    spark.conf.set("spark.furrow.hotGroupRows", "1")
    try:
        assert {(r.conv_id, r.n_turns, r.n_snapshots) for r in chat.collapse(df).collect()} == want
    finally:
        spark.conf.unset("spark.furrow.hotGroupRows")
    assert chat.collapse(df.where("false")).count() == 0


# 7: benchmark leaks


def brute_align(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h))


def test_alignment_equals_the_plain_recurrence():
    rng = np.random.default_rng(3)
    for _ in range(40):
        a, b = rng.integers(1, 8, rng.integers(1, 30)), rng.integers(0, 8, rng.integers(1, 60))
        assert decontam.align(a, b)[0] == brute_align(a.tolist(), b.tolist())


def test_leaks_equal_aligning_everything(spark, docs):
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet").limit(12)
    items = [(r.item_id, decontam.words_of(r.text)) for r in bench.collect()]
    sample = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").where("length(text) < 2500").orderBy("doc_id").limit(50).collect()]
    one = bench.first().text
    words = one.split()
    edited = " ".join(w if k % 7 else "zzz" for k, w in enumerate(words))
    sample += [(900, "before it " + one.upper() + " and after"), (901, "x " + edited + " y"), (902, None), (903, ""), (904, " ".join(words[: len(words) // 4]))]
    df = spark.createDataFrame(sample, "doc_id bigint, text string").selectExpr("*", "0 AS score")
    want = set()
    for i, t in sample:
        for item, w in items:
            if t and brute_align(w, decontam.words_of(t)) / (2 * len(w)) >= decontam.THRESHOLD:
                want.add((i, item))
    got = decontam.find_leaks(df, bench)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and {900, 901} <= {i for i, _ in want}
    assert {(r.doc_id, r.item_id) for r in decontam.find_leaks(df, bench, block_bytes=500).collect()} == want
    kept = decontam.without_leaks(df, bench)
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in sample} - {i for i, _ in want}
    assert decontam.find_leaks(df, bench.where("false")).count() == 0 and decontam.find_leaks(df.where("false"), bench).count() == 0


def test_edited_copies_equal_aligning_everything(spark):
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet").limit(12)
    items = [(r.item_id, decontam.words_of(r.text)) for r in bench.collect()]
    rng = np.random.default_rng(7)
    edits = {
        **{f"every {k}th replaced": (lambda j, w, k=k: ["zzz"] if j % k == k - 1 else [w]) for k in (3, 4, 5, 6)},
        **{f"random {p}": (lambda j, w, p=p: ["zzz"] if rng.random() < p else [w]) for p in (0.2, 0.3)},
        "put in after every 2nd": lambda j, w: [w, "zzz"] if j % 2 else [w],
        "every 4th left out": lambda j, w: [] if j % 4 == 3 else [w],
    }
    copies = [[b"before", *(x if isinstance(x, bytes) else x.encode() for j, w in enumerate(words) for x in edit(j, w)), b"after"] for edit in edits.values() for _, words in items]
    whole = [w for _, w in items]
    # Exact copies beside edited ones must not change what is found.
    for texts in (copies, copies + whole):
        want = {(i, item): s for i, t in enumerate(texts) for item, w in items if (s := decontam.align(np.array(w), np.array(t))[0] / (2 * len(w))) >= decontam.THRESHOLD}
        df = spark.createDataFrame([(i, b" ".join(t).decode()) for i, t in enumerate(texts)], "doc_id bigint, text string")
        rows = decontam.find_leaks(df, bench).collect()
        assert {(r.doc_id, r.item_id): r.score for r in rows} == want and len(want) > 80
        for r in rows[:20]:
            part = texts[r.doc_id][r.first_word : r.end_word]
            words = dict(items)[r.item_id]
            assert decontam.align(np.array(words), np.array(part)) == (round(r.score * 2 * len(words)), len(part))


# 8: near duplicates


def brute_links(rows):
    cache = neardup._WordHash()
    sets = [set(neardup.shingles(t, cache).tolist()) for _, t in rows]
    n = len(rows)
    links, parent = [0] * n, list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            if sets[i] and sets[j] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    heads = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            heads[root(i)] = min(heads.get(root(i), d), d)
    return sorted((d if d is not None else -1, heads.get(root(i), -1), links[i]) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("block", [512, 3])
def test_links_equal_comparing_all_pairs(spark, docs, block):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    base = rows[0][1].split()
    rng = np.random.default_rng(4)
    for k in range(12):
        words = list(base)
        for at in rng.integers(0, len(words), 1 + k % 4):
            words[at] = f"edit{k}"
        rows.append((5000 + k, " ".join(words)))
    rows += [(6000, None), (6001, ""), (6002, "two words"), (6003, "two  words"), (None, "two words"), (6004, "  "), (5000, rows[-1][1]), (5000, rows[-1][1])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS node", "1 AS class_id")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.class_id if r.class_id is not None else -1, r.n_links) for r in neardup.jaccard_join(df, block=block).collect())
    assert got == brute_links(rows)


def test_one_of_each_keeps_every_column_and_all_without_words(spark):
    rows = [(2, "a b c d e f", "x"), (1, "a b c d e f", "y"), (1, "a b c d e f", "y"), (3, None, "z"), (3, None, "z"), (4, "other words are here now", "w")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, node string")
    got = sorted((r.doc_id, r.node) for r in neardup.one_of_each(df).collect())
    assert got == [(1, "y"), (3, "z"), (3, "z"), (4, "w")]
    assert neardup.one_of_each(df.where("false")).count() == 0


def test_posterior_rule_is_the_tail_of_a_beta():
    rng = np.random.default_rng(5)
    for n, k in neardup.least_matches(tolerance=1e-3).items():
        draws = rng.beta(k + 1, n - k + 1, 200_000)
        assert (draws >= 0.8).mean() >= 0.5e-3
        if k:
            assert (rng.beta(k, n - k + 2, 200_000) >= 0.8).mean() <= 2e-3


# 9 and 10


def test_quality_counts_and_edges(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(1, "h", " ".join(words) + "\n$ # a\n$ # a"), (2, "h", None), (3, "h", ""), (None, None, "one two three one two three"), (5, "h", " ".join(["a b c"] * 30))]
    rows += [(100 + i, "h", "shared line of the host 7\n" + " ".join(f"own{i}x{k}" for k in range(55))) for i in range(30)]
    rows += [(200 + i, "h", "Shared  line of the HOST 8\n" + "shared line of the host 9\n" * 20) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string").selectExpr("*", "1 AS h", "'x' AS n_words")
    got = {r.doc_id: r for r in quality.line_rules(df, rewrite=True).collect()}
    assert len(got) == len(rows)
    assert (got[1].n_words, got[1].n_symbols, got[1].n_dup_lines, got[1].n_repeat_words) == (66, 4, 1, 6)
    assert got[None].n_repeat_words == 6 and got[2].n_words == 0 and got[2].text is None and not got[3].kept
    assert got[5].n_repeat_words == 90 and got[5].base_failed
    assert got[110].kept and got[110].n_removed_lines == 1 and got[110].text.startswith("own10x0") and got[110].n_left_words == 55
    assert got[200].depleted and not got[200].kept
    assert quality.line_rules(df.where("false")).count() == 0


def test_language_of_held_out_documents(spark):
    df = queries.op10(spark, "/root/testdata/sf0.01")
    lang = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    got = df.join(lang, "doc_id").where("held_out").selectExpr("avg(int(lang_pred = lang)) AS right").first()
    assert got.right > 0.97


def test_language_edges(spark):
    train = spark.createDataFrame([("the and of that", "en"), ("der und die nicht", "de"), (None, "fr"), ("x", None)], "text string, lang string")
    model = langid.fit(train)
    assert model[0] == ["de", "en"]
    rows = [(1, None), (2, ""), (3, "12 ..."), (4, "The and that " * 200_000), (5, "und die"), (None, "und die")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS score", "2 AS lang_pred")
    got = {r.doc_id: r for r in langid.identify(df, model, ["doc_id"]).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4, 5, None)] == ["und", "und", "und", "en", "de", "de"]
    assert all(0 <= r.score <= 1 for r in got.values())
    none = langid.fit(train.where("false"))
    assert langid.identify(df, none, ["doc_id"]).where("lang_pred <> 'und'").count() == 0
    # A long text scores as the same n-grams would in one piece.
    whole, langid.CHUNK = langid.CHUNK, 1000
    try:
        assert langid.score_texts(["und die " * 999], *model) == langid.score_texts(["und die " * 999], *model)
        short = langid.score_texts(["der und the nicht " * 400], *model)
    finally:
        langid.CHUNK = whole
    assert short[0] == langid.score_texts(["der und the nicht " * 400], *model)[0]
    assert os.path.exists(queries.VOCABULARY)
