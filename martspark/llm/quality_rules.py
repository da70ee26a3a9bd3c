"""Quality rules: base counts and the divergence of a document from its language's references.

Everything is a column expression. Per language two references are computed from
all documents: the share of each character class, and the shares of the language's
``COMMON_WORDS`` most frequent words beside all other words. A document is
compared with its language by the Jensen-Shannon distance (base 2, between 0 and 1)
of both histograms. Each comparison has a minimum-length guard: a short document
is not judged by a histogram it cannot fill, and a language seen in fewer than
``MIN_REFERENCE_WORDS`` words judges nobody. A language in which no word is common has the
empty list of them: only its character reference tells documents apart.

Defined results: a missing text counts as empty (no words, base rule failed); a
missing language is the language of the empty name; rows with equal or missing ids
are judged one by one; repeated rows weigh as often as they occur in the
references; an empty table gives an empty result. Other columns are carried
through or left out, whatever their names. Repeated three-word windows of a text
are found by 64-bit hashes of its windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martspark.llm.common import ROW, packed, unpacked
from martspark.session import written

COMMON_WORDS = 16
COMMON_WORD_SHARE = 1000  # a common word makes up at least one word in so many, so candidates are as few at most
MIN_REFERENCE_WORDS = 1000
MIN_WORDS = 50
MIN_WORDS_FOR_CHARS = 50
MIN_WORDS_FOR_WORDS = 100
MAX_CHAR_DISTANCE = 0.30
MAX_WORD_DISTANCE = 0.30
MAX_REPEAT_PERCENT = 50
BROADCAST_LANGUAGES = 20_000  # a reference is under 2 KB, so this many are under 40 MB

VERDICT = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance",
           "word_distance"]

SEPARATOR = r"[\x20\x09-\x0D]+"
SEPARATORS = " \t\n\x0b\f\r"
# Character classes in the order in which they are taken out of the text; what is left is the last class.
CLASSES = [r"[a-z]+", SEPARATOR, r"[A-Z]+", r"[.,;:!?'\"()-]+", r"[#*$%&|<>]+", r"[0-9]+"]
SPACES, SYMBOLS = 1, 4


def words_of(text: Column) -> Column:
    """The text's words; none for an empty text."""
    inner = F.btrim(text, F.lit(SEPARATORS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SEPARATOR))


def with_class_counts(df: DataFrame) -> DataFrame:
    """Add ``class_counts``: code points of ``text`` per character class."""
    df = df.withColumn("left0", F.col("text"))
    for k, pattern in enumerate(CLASSES):
        df = df.withColumn(f"left{k + 1}", F.regexp_replace(f"left{k}", pattern, ""))
    sizes = [F.length(f"left{k}") for k in range(len(CLASSES) + 1)]
    counts = [a - b for a, b in zip(sizes, sizes[1:])] + [sizes[-1]]
    return df.withColumn("class_counts", F.array(*(c.cast("long") for c in counts))).drop(
        *(f"left{k}" for k in range(len(CLASSES) + 1)))


def _few(per_language: DataFrame) -> DataFrame:
    """A written table with a row per language, to be sent to all tasks if it is small.

    Beyond that it takes part in a plain join, whose skewed languages Spark splits at run time.
    """
    return F.broadcast(per_language) if per_language.count() <= BROADCAST_LANGUAGES else per_language


def references(texts: DataFrame) -> DataFrame:
    """``lang, common, word_shares, class_shares`` per language of ``texts(lang, text)``.

    Words are combined before the shuffle, so a language with most of the rows
    sends a few counts per task.
    """
    words = texts.select("lang", F.explode(words_of(F.col("text"))).alias("word"))
    counts = written(words.groupBy("lang", "word").agg(F.count("*").alias("n")), "word-counts")
    totals = _few(written(counts.groupBy("lang").agg(F.sum("n").alias("n_words")), "language-totals"))
    frequent = counts.join(totals, "lang").filter(F.col("n") * COMMON_WORD_SHARE >= F.col("n_words"))
    listed = frequent.groupBy("lang").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("minus_n"), "word"))).alias("by_count"))
    top = F.slice("by_count", 1, COMMON_WORDS)
    n_other = F.col("n_words") + F.aggregate(top, F.lit(0).cast("long"), lambda s, x: s + x["minus_n"])
    words_side = totals.join(listed, "lang", "left").withColumn(
        "by_count", F.coalesce("by_count", F.array().cast("array<struct<minus_n:bigint,word:string>>"))).select(
        "lang", "n_words", F.transform(top, lambda x: x["word"]).alias("common"),
        F.transform(F.concat(F.transform(top, lambda x: -x["minus_n"]), F.array(n_other)),
                    lambda n: n / F.col("n_words")).alias("word_shares"))
    classes = with_class_counts(texts).groupBy("lang").agg(
        *(F.sum(F.col("class_counts")[k]).alias(f"c{k}") for k in range(len(CLASSES) + 1)))
    sums = [F.col(f"c{k}") for k in range(len(CLASSES) + 1)]
    whole = sum(sums[1:], sums[0])
    chars_side = classes.select("lang", F.array(*(F.coalesce(c / whole, F.lit(0.0)) for c in sums)).alias("class_shares"))
    return words_side.filter(F.col("n_words") >= MIN_REFERENCE_WORDS).join(chars_side, "lang").drop("n_words")


def jensen_shannon(counts: Column, shares: Column) -> Column:
    """Distance of a histogram of counts from reference shares; null for an empty histogram."""
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda s, x: s + x)
    p_shares = F.transform(counts, lambda n: n / F.nullif(total, F.lit(0)))

    def part(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(F.lit(0.0))

    parts = F.zip_with(p_shares, shares, lambda p, q: part(p, q) + part(q, p))
    halves = F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / 2
    return F.sqrt(F.greatest(halves, F.lit(0.0)))


def with_base_counts(df: DataFrame) -> DataFrame:
    """Add the base counts of ``text`` to rows that have ``text`` and ``class_counts``."""
    df = df.withColumn("words", words_of(F.col("text"))).withColumn("n_words", F.size("words").cast("long"))
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("lines", lines).withColumn(
        "n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")).drop("lines")
    df = df.withColumns({
        "word_chars": F.length("text").cast("long") - F.col("class_counts")[SPACES],
        "n_symbols": F.col("class_counts")[SYMBOLS],
        "hashes": F.when(F.col("n_words") >= 3, F.transform(
            F.sequence(F.lit(0), (F.col("n_words") - 3).cast("int")),
            lambda i: F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)))),
    })
    # Only texts with some window twice go on: sort windows by hash, keep the places of equal neighbours.
    df = df.withColumn("windows", F.when(
        F.size("hashes") > F.size(F.array_distinct("hashes")),
        F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("at"))))))
    df = df.withColumn("places", F.sort_array(F.transform(
        F.filter("windows", lambda w, i: (w["h"] == F.get("windows", i - 1)["h"]).eqNullSafe(True)
                 | (w["h"] == F.get("windows", i + 1)["h"]).eqNullSafe(True)), lambda w: w["at"])))
    covered = F.aggregate(
        "places", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
        lambda s, at: F.struct((s["n"] + F.least(at - s["last"], F.lit(3))).alias("n"), at.alias("last")), lambda s: s["n"])
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("hashes", "windows", "places")


def judged(docs: DataFrame, refs: DataFrame | None = None) -> DataFrame:
    """Each row of ``docs`` as ``_row`` with its counts, distances, ``base_failed`` and ``kept``.

    ``refs`` default to the references of ``docs`` itself.
    """
    texts = {"text": F.coalesce(F.col("text").cast("string"), F.lit("")), "lang": F.coalesce(F.col("lang").cast("string"), F.lit(""))}
    if refs is None:
        refs = _few(written(references(docs.select(*(c.alias(n) for n, c in texts.items()))), "references"))
    rows = with_base_counts(with_class_counts(packed(docs, **texts))).join(refs, "lang", "left")
    found = F.transform("words", lambda w: F.array_position("common", w))
    rows = rows.withColumn("found", F.filter(found, lambda k: k > 0)).withColumn("word_counts", F.concat(
        F.transform("common", lambda _, at: F.size(F.filter("found", lambda f: f == at + 1)).cast("long")),
        F.array(F.col("n_words") - F.size("found"))))
    rows = rows.withColumns({
        "char_distance": jensen_shannon(F.col("class_counts"), F.col("class_shares")),
        "word_distance": jensen_shannon(F.col("word_counts"), F.col("word_shares")),
        "base_failed": (F.col("n_words") < MIN_WORDS) | (
            100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
    })
    strange = ((F.col("n_words") >= MIN_WORDS_FOR_CHARS) & (F.col("char_distance") > MAX_CHAR_DISTANCE)) | (
        (F.col("n_words") >= MIN_WORDS_FOR_WORDS) & (F.col("word_distance") > MAX_WORD_DISTANCE))
    rows = rows.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(strange, F.lit(False)))
    # A row number is never negative, but its expression may be evaluated only once per row: the optimizer leaves
    # the verdict as it stands, instead of unfolding it into every filter and column above.
    verdict = F.when(F.monotonically_increasing_id() >= 0, F.struct(*VERDICT))
    return rows.select(ROW, verdict.alias("_verdict")).select(ROW, *(F.col(f"_verdict.{name}").alias(name) for name in VERDICT))


def quality_verdicts(docs: DataFrame) -> DataFrame:
    """``doc_id``, counts and verdict per row of ``docs(doc_id, text, lang)``."""
    return judged(docs).select(F.col(f"{ROW}.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines",
                               "n_repeat_words", "base_failed", "kept", F.round("char_distance", 4).alias("char_distance"),
                               F.round("word_distance", 4).alias("word_distance"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows that pass, with their own columns."""
    return unpacked(judged(docs).filter("kept"), docs.columns)
