"""Each operator as a query over its whole table, with its SQL where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow.llm import chat, collocations, decontam, fim, langid, mixing, neardup, pii, quality, scoring, tokens, toxicity, warc
from furrow.session import shared_root

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# Where the vocabulary of the token count lies, and the key of the surrogates.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
# Documents of a host that may share a line.
HOST_LIMIT = 20
PII_KEY = b"rotate this key for each release"


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/furrow/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


OP1 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages),
g AS (SELECT sha, max(page_id) AS last FROM p GROUP BY sha HAVING count(*) > 1)
SELECT page_id, cast(strlen(html) AS bigint) AS payload_bytes,
  array_to_string(list_transform(range(0, 8), lambda g: array_to_string(list_transform(range(0, 4),
    lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + ((('0x' || substr(p.sha, cast(1 + g * 5 AS bigint), 5))::bigint >> cast(15 - 5 * k AS integer)) & 31), 1)), '')), '') AS payload_digest,
  CASE WHEN last IS NOT NULL AND page_id IS DISTINCT FROM last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM p LEFT JOIN g USING (sha)"""


@query("op1_warc_dictionary_writer", OP1)
def op1(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch(spark, "warc")
    warc.write_archives(table(spark, sf, "pages"), path)
    return warc.read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op2_mixture_weights")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "source", "lang")
    return mixing.mix(docs).select("doc_id", "source", "lang", "topic", "n_tokens", "probability", "sampled")


@query("op3_pii_surrogates")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, PII_KEY).withColumn("n_entities", F.size("pii_kinds").cast("bigint"))


@query("op4_viterbi_token_counts")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf, "documents"), tokens.load_vocabulary(VOCABULARY))


@query("op5_backoff_automaton")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.score(table(spark, sf, "documents"), langid.remainder("doc_id", 5) != 1)


OP6 = """
WITH c AS (SELECT conv_id, count(*) AS n_turns,
    list(struct_pack(t := turn, r := role, x := text) ORDER BY turn, role, text) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
k AS (SELECT conv_id, n_turns, md5(array_to_string(list_transform(turns, lambda t: md5(t.r) || md5(t.x)), '')) AS whole,
    list_transform(turns, lambda t: md5(t.r) || md5(t.x)) AS steps,
    array_to_string(list_transform(turns, lambda t: '<|im_start|>' || t.r || chr(10) || t.x || '<|im_end|>' || chr(10)), '') AS rendered FROM c),
p AS (SELECT DISTINCT i AS n, md5(array_to_string(steps[1:i], '')) AS h
  FROM (SELECT steps, unnest(range(1, n_turns)) AS i FROM k)),
e AS (SELECT n_turns, whole, min(conv_id) AS conv_id, count(*) AS n_snapshots FROM k GROUP BY ALL)
SELECT e.conv_id, e.n_turns, e.n_snapshots, k.rendered FROM e JOIN k USING (conv_id)
WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.n = e.n_turns AND p.h = e.whole)"""


@query("op6_snapshot_collapse", OP6)
def op6(spark: SparkSession, sf: str) -> DataFrame:
    return chat.collapse(table(spark, sf, "conversations"))


@query("op7_benchmark_leaks")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op8_jaccard_join")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.jaccard_join(table(spark, sf, "documents"))


OP9 = """
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, text AS raw,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents),
g AS (SELECT doc_id, i, w[i:i+2] AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
g2 AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS n FROM g),
rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g2 WHERE n > 1) GROUP BY doc_id),
b AS (SELECT d.doc_id, source, raw, cast(len(w) AS bigint) AS n_words,
    cast(length(array_to_string(w, '')) AS bigint) AS word_chars,
    cast(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS bigint) AS n_symbols,
    cast(len(lines) - len(list_distinct(lines)) AS bigint) AS n_dup_lines,
    cast(coalesce(n_repeat_words, 0) AS bigint) AS n_repeat_words FROM d LEFT JOIN rep USING (doc_id)),
l AS (SELECT doc_id, source, raw, unnest(list_transform(lines, lambda x: struct_pack(
    k := trim(regexp_replace(regexp_replace(lower(x), '[0-9]', '0', 'g'), '[\\x20\\x09-\\x0D]+', ' ', 'g')),
    n := len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+'))))) AS u FROM d),
f AS (SELECT source, u.k AS k FROM l GROUP BY ALL HAVING count(DISTINCT raw) > 20),
gone AS (SELECT doc_id, count(*) AS c, sum(u.n) AS n FROM l JOIN f ON f.source = l.source AND f.k = l.u.k GROUP BY doc_id),
v AS (SELECT b.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    cast(coalesce(gone.c, 0) AS bigint) AS n_removed_lines,
    cast(n_words - coalesce(gone.n, 0) AS bigint) AS n_left_words FROM b LEFT JOIN gone USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND n_left_words >= 50 AND n_left_words >= 0.5 * n_words AS kept, n_removed_lines, n_left_words
FROM v"""


@query("op9_quality_lines", OP9)
def op9(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "source", "text")
    names = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept n_removed_lines n_left_words"
    return quality.line_rules(docs, max_docs=HOST_LIMIT).select(*names.split())


@query("op10_language_id")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    held_out = langid.remainder("doc_id", 4) == 2
    model = langid.fit(docs.where(~held_out))
    return langid.identify(docs.select("doc_id", "text", held_out.alias("held_out")), model, ["doc_id", "held_out"])


@query("op11_toxicity")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    held_out = langid.remainder("doc_id", 5) == 0
    labels = table(spark, sf, "labels").select("doc_id", "toxic")
    model = toxicity.fit(toxicity.labelled_sample(docs.where(~held_out), labels))
    return toxicity.score(docs.select("doc_id", "text", held_out.alias("held_out")), model)


OP12 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(cast(doc_id AS varchar), '')) AS h FROM documents),
g AS (SELECT doc_id, text, cast(length(text) AS bigint) AS n, ('0x' || substr(h, 1, 8))::bigint AS h1, ('0x' || substr(h, 9, 8))::bigint AS h2,
    ('0x' || substr(h, 17, 8))::bigint AS h3, ('0x' || substr(h, 25, 8))::bigint AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS i, greatest(h1 % (n + 1), h2 % (n + 1)) AS j,
    CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g),
p AS (SELECT *, substr(text, 1, i) AS a, substr(text, i + 1, j - i) AS b, substr(text, j + 1) AS z FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN i END AS prefix_chars, CASE WHEN form <> 'plain' THEN j - i END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || b ELSE '<S>' || z || '<P>' || a || '<M>' || b END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p"""


@query("op12_fill_in_middle", OP12)
def op12(spark: SparkSession, sf: str) -> DataFrame:
    docs = fim.transform(table(spark, sf, "documents").select("doc_id", "text"))
    return docs.select(
        "doc_id",
        F.col("n_units").alias("n"),
        "form",
        F.col("prefix_units").alias("prefix_chars"),
        F.col("middle_units").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fim.restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


OP13 = """
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
n AS (SELECT lang, cast(sum(len(w)) AS bigint) AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, w[i:i + k - 1] AS g FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i
    FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, k, g, cast(count(*) AS bigint) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
m AS (SELECT lang, s, max(f) AS m FROM (SELECT lang, f, unnest([g[1:k - 1], g[2:k]]) AS s FROM f WHERE k >= 3) GROUP BY ALL),
c AS (SELECT f.lang, g, f AS a, k FROM f LEFT JOIN m ON m.lang = f.lang AND m.s = g WHERE k >= 2 AND (m IS NULL OR 100 * m < 80 * f)),
u AS (SELECT lang, g, a, i, g[1:i] AS x, g[i + 1:k] AS y FROM (SELECT *, unnest(range(1, k)) AS i FROM c)),
s AS (SELECT u.lang, u.g, u.a, i, b.f AS l, e.f AS r, cast((2000000::hugeint * u.a) // (b.f::hugeint + e.f) AS bigint) AS score
  FROM u JOIN f b ON b.lang = u.lang AND b.g = x JOIN f e ON e.lang = u.lang AND e.g = y),
t AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, score FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, i) = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM t)
SELECT lang, rank, phrase, a, l, r, n, score FROM o JOIN n USING (lang) WHERE rank <= 2000"""


@query("op13_collocations", OP13)
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return collocations.collocations(table(spark, sf, "documents").select("lang", "text"))
