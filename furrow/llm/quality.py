"""Quality rules: word and repetition rules, and lines shared by many documents of a host.

Only DataFrame functions are used. Texts stay in their rows; what is shuffled are line
hashes and one narrow row per document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.operators.groups import attach

SPACE = r"[ \t-\r]+"
SYMBOLS = r"[^#*$%&|<>]+"
MIN_WORDS = 50
# A line is boilerplate of its host in more than so many documents, whatever the host's size.
MAX_DOCS = 20
# A document is depleted when fewer words than MIN_WORDS or than this share of them are left.
MIN_LEFT = 0.5


def words_of(text: Column) -> Column:
    """Runs of characters other than space and U+0009 to U+000D; none for a null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def normal_line(line: Column) -> Column:
    """Line for comparison between documents: lower case, single spaces, digits as zeros."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]", "0"), SPACE, " "))


def line_hashes(text: Column) -> Column:
    """Hash and word count of each line that holds a word."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
    return F.transform(lines, lambda x: F.struct(F.xxhash64(normal_line(x)).alias("h"), F.size(words_of(x)).alias("n")))


def base_rules(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed.

    A null or empty text has no words and fails. Windows of three words are compared by
    64-bit hashes inside one text. Columns of these names in the input are replaced.
    """
    raw = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(raw, "\n"), lambda x: x.rlike(r"[^ \t-\r]"))
    own = "_w _h1 _h3 _sorted _lines".split()
    df = docs.withColumns({"_w": words_of(F.col(text)), "_lines": lines})
    df = df.withColumns({"n_words": F.size("_w").cast("bigint"), "_h1": F.transform("_w", lambda x: F.xxhash64(x))})
    later = F.slice("_h1", 1, F.greatest(F.size("_h1") - 2, F.lit(0)))
    window = F.transform(later, lambda x, i: F.xxhash64(x, F.get("_h1", i + 1), F.get("_h1", i + 2)))
    df = df.withColumn("_h3", window)
    # Most texts repeat no window: only the others pay for places.
    df = df.withColumn(
        "_sorted",
        F.when(
            F.size(F.array_distinct("_h3")) < F.size("_h3"),
            F.sort_array(F.transform("_h3", lambda x, i: F.struct(x.alias("h"), i.alias("i")))),
        ),
    )
    at = F.col("_sorted")
    twice = F.filter(
        at,
        lambda x, i: F.coalesce(x.h == F.get(at, i + 1).h, F.lit(False)) | F.coalesce((i > 0) & (x.h == F.get(at, i - 1).h), F.lit(False)),
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x.i, x.i + 1, x.i + 2)))))
    df = df.withColumns(
        {
            "word_chars": F.length(F.concat_ws("", "_w")).cast("bigint"),
            "n_symbols": F.length(F.regexp_replace(raw, SYMBOLS, "")).cast("bigint"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
            "n_repeat_words": F.when(at.isNotNull(), covered).otherwise(0).cast("bigint"),
        }
    ).drop(*own)
    return df.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def common_lines(docs: DataFrame, host: str, text: str, max_docs: int) -> DataFrame:
    """(_host, h) of lines in more documents of a host than allowed.

    Documents of one host with the same text count once: exact copies are the business of
    de-duplication, and must not turn their own lines into boilerplate. The limit is a fixed
    count of the same units, so that neither copies nor other documents of the host change
    what is removed. Counts are combined before the shuffle, so a line in a third of all
    documents is one row per task.
    """
    lines = docs.select(
        F.col(host).alias("_host"),
        F.xxhash64(text).alias("_t"),
        F.explode(F.array_distinct(F.transform(line_hashes(F.col(text)), lambda x: x.h))).alias("h"),
    )
    return lines.distinct().groupBy("_host", "h").agg(F.count("*").alias("_n")).where(F.col("_n") > max_docs).select("_host", "h")


# Stands before a caller's names that begin with an underscore while the rules run.
_ASIDE = "\u00b7"


def _aside(docs: DataFrame) -> DataFrame:
    return docs.withColumnsRenamed({c: _ASIDE + c for c in docs.columns if c.startswith("_")})


def _back(docs: DataFrame) -> DataFrame:
    return docs.withColumnsRenamed({c: c[1:] for c in docs.columns if c.startswith(_ASIDE + "_")})


def line_rules(
    docs: DataFrame,
    host: str = "source",
    id_col: str = "doc_id",
    text: str = "text",
    max_docs: int = MAX_DOCS,
    min_left: float = MIN_LEFT,
    rewrite: bool = False,
) -> DataFrame:
    """Base rules, then removal of a host's boilerplate lines and rejection of what is depleted.

    Adds n_left_words, n_removed_lines, depleted and kept to the columns of base_rules; with
    ``rewrite`` the text loses its removed lines. Null ids and hosts are values like others,
    repeated rows get the same verdict, a null text is rejected and stays null, an empty
    table gives no row. Other columns pass through, whatever their names, unless they have a
    name that is added.
    """
    docs = _aside(docs)
    id_col, host, text = (_ASIDE + c if c.startswith("_") else c for c in (id_col, host, text))
    common = common_lines(docs, host, text, max_docs)
    keyed = docs.withColumns({"_t": F.xxhash64(text), "_hashed": line_hashes(F.col(text))})
    hits = keyed.select(F.col(id_col).alias("_id"), F.col(host).alias("_host"), "_t", F.explode(F.array_distinct(F.transform("_hashed", lambda x: x.h))).alias("h"))
    hits = attach(hits, common.withColumn("_hit", F.lit(True)), ["_host", "h"], "left").where("_hit")
    removed = hits.groupBy(F.col("_id").alias(id_col), F.col("_host").alias(host), "_t").agg(F.collect_set("h").alias("_removed"))
    scored = base_rules(keyed, text)
    scored = scored if rewrite else scored.drop(text)
    df = attach(scored, removed, [id_col, host, "_t"])
    gone = F.filter("_hashed", lambda x: F.coalesce(F.array_contains("_removed", x.h), F.lit(False)))
    df = df.withColumn("_gone", F.when(F.col("_removed").isNotNull(), gone).otherwise(F.array()))
    left = F.col("n_words") - F.aggregate("_gone", F.lit(0), lambda a, x: a + x.n)
    df = df.withColumns({"n_removed_lines": F.size("_gone").cast("bigint"), "n_left_words": left.cast("bigint")})
    df = df.withColumn("depleted", (F.col("n_left_words") < MIN_WORDS) | (F.col("n_left_words") < min_left * F.col("n_words")))
    df = df.withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))
    if rewrite:
        still = F.filter(F.split(text, "\n"), lambda x: ~F.coalesce(F.array_contains("_removed", F.xxhash64(normal_line(x))), F.lit(False)))
        df = df.withColumn(text, F.when(F.col("n_removed_lines") > 0, F.array_join(still, "\n")).otherwise(F.col(text)))
    return _back(df.drop("_t", "_hashed", "_removed", "_gone"))


def kept_documents(docs: DataFrame, **parameters) -> DataFrame:
    """Rows of ``docs`` that the rules keep, without their removed lines.

    The row number stands between the verdict and the filter: else the optimiser would move
    the filter below the rules and repeat their expressions inside it many times over.
    """
    judged = _aside(line_rules(docs, rewrite=True, **parameters)).withColumn("_row", F.monotonically_increasing_id())
    return _back(judged.where("kept AND _row >= 0").drop("_row")).select(*[F.col(f"`{c}`") for c in docs.columns])
