"""Registered queries of the training-data operators and, where SQL can express them, their checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from martspark.llm.bpe import default_tokenizer
from martspark.llm.chat_format import formatted, read_back, with_probe
from martspark.llm.collocations import collocations
from martspark.llm.decontaminate import contaminated
from martspark.llm.edit_counts import edited_counts, redactions, token_trees
from martspark.llm.filter_audit import filter_audit
from martspark.llm.html_text import extracted
from martspark.llm.line_dedup import without_repeats
from martspark.llm.mixing import mix
from martspark.llm.quality_rules import quality_verdicts
from martspark.llm.secret_scan import secret_findings
from martspark.llm.simhash import near_duplicates
from martspark.llm.token_files import token_digests
from martspark.llm.warc import archived
from martspark.session import ship_package, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, folder)

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op2_token_files")
def op2_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Token files of all documents, digested per document from the files."""
    return token_digests(table(spark, folder, "documents"), default_tokenizer())


@query("op5_simhash_near_duplicates")
def op5_simhash_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return near_duplicates(table(spark, folder, "documents")).select("doc_id", "fingerprint", "component_id", "n_rows")


OP3_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang FROM documents),
w AS (SELECT *, [x FOR x IN regexp_split_to_array(text, '[\x20\x09-\x0D]+') IF x <> ''] AS words FROM d),
k AS (SELECT *, [CAST(length(regexp_replace(text, p, '', 'g')) AS BIGINT)
                 FOR p IN ['[^a-z]+', '[^\x20\x09-\x0D]+', '[^A-Z]+', '[^.,;:!?''"()-]+', '[^#*$%&|<>]+', '[^0-9]+']] AS k6
      FROM w),
c AS (SELECT *, list_append(k6, CAST(length(text) - list_sum(k6) AS BIGINT)) AS classes FROM k),
counts AS (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(words) AS word FROM w) GROUP BY ALL),
totals AS (SELECT lang, sum(n) AS n_words FROM counts GROUP BY lang HAVING sum(n) >= 1000),
ranked AS (SELECT lang, word, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS r
           FROM counts JOIN totals USING (lang) WHERE n * 1000 >= n_words),
word_refs AS (SELECT lang, list(word ORDER BY r) AS common, list(n ORDER BY r) AS ns FROM ranked WHERE r <= 16 GROUP BY lang),
class_refs AS (SELECT lang, list(CAST(s AS DOUBLE) ORDER BY j) AS cs FROM (
                 SELECT lang, j, sum(classes[j]) AS s FROM c, range(1, 8) AS t(j) GROUP BY ALL) GROUP BY lang),
refs AS (SELECT lang, coalesce(common, []) AS common,
                [x / n_words FOR x IN list_append(coalesce(ns, []), n_words - coalesce(list_sum(ns), 0))] AS word_q,
                [x / list_sum(cs) FOR x IN cs] AS class_q
         FROM totals LEFT JOIN word_refs USING (lang) JOIN class_refs USING (lang)),
spots AS (SELECT DISTINCT doc_id, pos + s AS pos FROM (
            SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, win) AS n FROM (
              SELECT doc_id, pos, list_slice(words, pos, pos + 2) AS win
              FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS pos FROM w WHERE len(words) >= 3))),
            (VALUES (0), (1), (2)) AS t(s) WHERE n > 1),
rep AS (SELECT doc_id, count(*) AS n_rep FROM spots GROUP BY doc_id),
f AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, length(text) - classes[2] AS word_chars, classes[5] AS n_symbols,
             CAST(len(good) - len(list_distinct(good)) AS BIGINT) AS n_dup_lines, coalesce(n_rep, 0) AS n_repeat_words,
             [x / nullif(length(text), 0) FOR x IN classes] AS class_p, class_q, word_q,
             [len([x FOR x IN words IF x = y]) / nullif(len(words), 0) FOR y IN common] AS common_p,
      FROM (SELECT *, [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS good FROM c)
      LEFT JOIN rep USING (doc_id) LEFT JOIN refs USING (lang)),
g AS (SELECT *, list_append(common_p, 1 - coalesce(list_sum(common_p), 0)) AS word_p FROM f),
j AS (SELECT *, [CASE WHEN class_p[i] > 0 THEN class_p[i] * log2(2 * class_p[i] / (class_p[i] + class_q[i])) ELSE 0 END
                 + CASE WHEN class_q[i] > 0 THEN class_q[i] * log2(2 * class_q[i] / (class_p[i] + class_q[i])) ELSE 0 END
                 FOR i IN range(1, len(class_q) + 1)] AS cj,
             [CASE WHEN word_p[i] > 1e-12 THEN word_p[i] * log2(2 * word_p[i] / (word_p[i] + word_q[i])) ELSE 0 END
                 + CASE WHEN word_q[i] > 0 THEN word_q[i] * log2(2 * word_q[i] / (word_p[i] + word_q[i])) ELSE 0 END
                 FOR i IN range(1, len(word_q) + 1)] AS wj FROM g),
v AS (SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
             n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
             CASE WHEN len(class_p) > 0 AND class_p[1] IS NOT NULL THEN sqrt(greatest(list_sum(cj) / 2, 0.0)) END AS cd,
             CASE WHEN n_words > 0 THEN sqrt(greatest(list_sum(wj) / 2, 0.0)) END AS wd FROM j)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce((n_words >= 50 AND cd > 0.30) OR (n_words >= 100 AND wd > 0.30), false) AS kept,
       round(cd, 4) AS char_distance, round(wd, 4) AS word_distance
FROM v"""


@query("op3_quality_rules", OP3_SQL)
def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Base counts, divergences and verdict of every document."""
    return quality_verdicts(table(spark, folder, "documents"))


@query("op7_mixing_weights")
def op7_mixing_weights(spark: SparkSession, folder: str) -> DataFrame:
    """Calibrated factor, probability and decision of every document."""
    return mix(table(spark, folder, "documents"))


@query("op8_benchmark_windows")
def op8_benchmark_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Best window per document and benchmark item that occurs in it."""
    return contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


OP1_SQL = r"""
WITH l AS (
  SELECT doc_id, nr - 1 AS pos, line, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS bare
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS nr
        FROM documents)),
w AS (SELECT doc_id, pos, lead(pos, 1) OVER o AS pos2, lead(pos, 2) OVER o AS pos3,
             bare || chr(10) || lead(bare, 1) OVER o || chr(10) || lead(bare, 2) OVER o AS win
      FROM l WHERE bare <> '' AND doc_id IS NOT NULL WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS place FROM w WHERE win IS NOT NULL),
gone AS (SELECT DISTINCT doc_id, unnest([pos, pos2, pos3]) AS pos FROM ranked WHERE place > 1),
marked AS (SELECT l.*, gone.pos IS NOT NULL AS removed FROM l LEFT JOIN gone USING (doc_id, pos))
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT removed), '') AS text,
       count(*) AS n_lines, CAST(count(*) FILTER (removed) AS BIGINT) AS n_removed
FROM marked GROUP BY doc_id"""


@query("op1_line_dedup", OP1_SQL)
def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """All documents without lines of windows that occur earlier in the corpus."""
    return without_repeats(table(spark, folder, "documents"))


@query("op4_warc_salvage")
def op4_warc_salvage(spark: SparkSession, folder: str) -> DataFrame:
    """All pages written to archives and read back by the salvage reader."""
    return archived(table(spark, folder, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op6_edit_aware_counts")
def op6_edit_aware_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Token counts of all documents before and after personal data and keys are redacted."""
    trees = written(token_trees(table(spark, folder, "documents"), default_tokenizer()), "token-trees")
    return edited_counts(trees, default_tokenizer(), rule=redactions)


@query("op10_main_text")
def op10_main_text(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of all pages."""
    return extracted(table(spark, folder, "pages"))


@query("op9_secret_scan")
def op9_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Findings of all documents with the forest's verdict."""
    return secret_findings(table(spark, folder, "documents"))


OP11_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, [x FOR x IN string_split_regex(text, '[\x20\x09-\x0D]+') IF x <> ''] AS words,
             min(doc_id) OVER (PARTITION BY text) AS lowest FROM t),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
             {'A': len(words) < 200,
              'B': 100 * len(list_distinct(words)) < 50 * len(words),
              'C': 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 2 * length(text),
              'D': regexp_matches(text, '[#$%&*|]'),
              'E': coalesce(doc_id > lowest, false)} AS x
      FROM w LEFT JOIN l USING (doc_id)),
m AS (SELECT part, concat(CASE WHEN x.A THEN 'A' ELSE '' END, CASE WHEN x.B THEN 'B' ELSE '' END,
                          CASE WHEN x.C THEN 'C' ELSE '' END, CASE WHEN x.D THEN 'D' ELSE '' END,
                          CASE WHEN x.E THEN 'E' ELSE '' END) AS failed,
             count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM d GROUP BY ALL),
c AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT concat(a.f, b.f, c3.f, d4.f, e.f) AS filter_order FROM c a, c b, c c3, c d4, c e
      WHERE len(list_distinct([a.f, b.f, c3.f, d4.f, e.f])) = 5),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS f, substr(filter_order, 1, step - 1) AS earlier
      FROM o, range(1, 6) AS r(step)),
j AS (SELECT part, filter_order, step, f, n, good, toxic, contains(failed, f) AS fails, failed = f AS alone,
             NOT regexp_matches(failed, concat('[_', earlier, ']')) AS here FROM s, m),
g AS (SELECT part, filter_order, step, f,
             sum(CASE WHEN here AND NOT fails THEN n ELSE 0 END) AS kept,
             sum(CASE WHEN here AND fails THEN n ELSE 0 END) AS removed,
             sum(CASE WHEN fails AND NOT here THEN n ELSE 0 END) AS redundant,
             sum(CASE WHEN alone THEN n ELSE 0 END) AS unique_fails,
             sum(CASE WHEN here AND fails THEN good ELSE 0 END) AS good_lost,
             sum(CASE WHEN here AND fails THEN toxic ELSE 0 END) AS toxic_lost FROM j GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM g"""


@query("op11_filter_audit", OP11_SQL)
def op11_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    """What every order of five filters keeps and removes at each step, per source."""
    return filter_audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


OP12_SQL = r"""
WITH p AS (SELECT lang, [x FOR x IN string_split_regex(piece, '[\x20\x09]+') IF x <> ''] AS w FROM (
             SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text,
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
             FROM documents WHERE text IS NOT NULL)),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
f AS (SELECT lang, k, phrase, count(*) AS a FROM (
        SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase FROM (
          SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM p, (VALUES (1), (2), (3)) AS t(k)))
      GROUP BY ALL HAVING count(*) >= 10),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1),
cuts AS (SELECT c.lang, c.phrase, c.a, j, l.a AS l, r.a AS r,
                CAST(1000000 * CAST(c.a AS HUGEINT) * c.a // (CAST(l.a AS HUGEINT) * r.a) AS BIGINT) AS score
         FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c
         JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(list_slice(c.ws, 1, j), ' ')
         JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(list_slice(c.ws, j + 1, c.k), ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
longer AS (SELECT lang, phrase, max(a) AS longest FROM (
             SELECT lang, a, array_to_string(list_slice(ws, j, j + 1), ' ') AS phrase FROM c, (VALUES (1), (2)) AS t(j) WHERE k = 3)
           GROUP BY ALL),
kept AS (SELECT best.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
         FROM best LEFT JOIN longer USING (lang, phrase) WHERE longest IS NULL OR 100 * longest < 50 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM kept JOIN total USING (lang) WHERE rank <= 2000"""


@query("op12_collocations", OP12_SQL)
def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """The first 2,000 phrases of each language by their weakest cut."""
    return collocations(table(spark, folder, "documents"))


OP13_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, n, r, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS x(n, r)),
e AS (SELECT *, regexp_replace(text, '<(~*)\|', '<~\1|', 'g') AS safe,
             regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(~*)\|', '<~\1|', 'g') AS safe_role,
             row_number() OVER w - 1 AS nr, lag(role) OVER w AS before, lead(role) OVER w IS NULL AS is_last
      FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
c AS (SELECT *, CASE WHEN nr = 0 THEN role IN ('system', 'user')
                     WHEN before = 'system' THEN role = 'user' AND nr = 1
                     WHEN before IN ('user', 'tool') THEN role = 'assistant'
                     WHEN before = 'assistant' THEN role IN ('user', 'tool') ELSE false END AS fits FROM e)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY nr)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY nr) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('<|im_start|>') + length(safe_role) + 1 + length(safe) + length('<|im_end|>') + 1) AS BIGINT)
         AS formatted_chars,
       coalesce(bool_and(fits), false) AND bool_or(is_last AND role = 'assistant') AS valid,
       coalesce(min(nr) FILTER (NOT fits), CASE WHEN NOT bool_or(is_last AND role = 'assistant') THEN count(*) END) AS first_error
FROM c GROUP BY conv_id"""


@query("op13_chat_format", OP13_SQL)
def op13_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations and the probe formatted, and digested from the formatted text and its mask."""
    return read_back(formatted(with_probe(table(spark, folder, "conversations"))))
