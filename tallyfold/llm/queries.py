"""The registered queries of this subpackage, with DuckDB SQL where SQL can say the same."""

from __future__ import annotations

import importlib.util
import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, language_id, lexical_search, license_scan, line_dedup, mixing, piece_codec, quality_rules, simhash, spelling, suffix_dedup, token_counts, toxicity
from .common import read

PIECE_MODEL = os.environ.get("TALLYFOLD_PIECE_MODEL", "")
WORD_TOKENIZER = os.environ.get("TALLYFOLD_WORD_TOKENIZER", "")


def piece_model() -> str:
    """Path of the SentencePiece model: TALLYFOLD_PIECE_MODEL, else the public tokenizers' folder."""
    return PIECE_MODEL or tokenizer_file("piece_bpe_32k.model")


def word_tokenizer() -> str:
    """Path of the word tokenizer: TALLYFOLD_WORD_TOKENIZER, else the public tokenizers' folder."""
    return WORD_TOKENIZER or tokenizer_file("word_bpe_49k.json")


def tokenizer_file(name: str) -> str:
    if importlib.util.find_spec("public_tokenizers"):
        import public_tokenizers

        return public_tokenizers.path(name)
    return f"/opt/tokenizers/{name}"


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(read(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op2_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.piece_digests(read(spark, sf_dir, "documents"), piece_model())


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents"), digest_all=True)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(read(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(read(spark, sf_dir, "documents"), passages=True).drop("kept")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(read(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(read(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score", "entropy", "rejected")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted", "offending")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rules")
    return quality_rules.quality_rules(read(spark, sf_dir, "documents")).select(*columns)


def lose_letters(id_: Column, run: Column) -> Column:
    """run without one of its code points where 97 divides the crc32 of `<id>:<run>`: misspellings to be found."""
    h = F.crc32(F.concat(id_, F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    rest = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))
    return F.when(h % 97 == 0, rest).otherwise(run)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(spelling.word_counts(read(spark, sf_dir, "documents"), lose_letters))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.lexical_search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"), word_tokenizer())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_piece_codec": op2_piece_codec,
    "op3_mix_sources": op3_mix_sources,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_license_scan": op5_license_scan,
    "op6_line_dedup": op6_line_dedup,
    "op7_simhash": op7_simhash,
    "op8_language_id": op8_language_id,
    "op9_toxicity": op9_toxicity,
    "op10_quality_rules": op10_quality_rules,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_lexical_search": op12_lexical_search,
    "op13_token_counts": op13_token_counts,
}

_STOP_LIST = ", ".join(f"'{w}'" for w in quality_rules.STOP_FORMS)
_RULE_BOUNDS = {r.name: r for r in quality_rules.RULES}

ORACLE_SQL: dict[str, str] = {
    "op1_suffix_dedup": """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT rid, doc_id, unnest(range(0, greatest(len(h) // 2 - 49, 0))) AS i,
             unnest(list_transform(range(0, greatest(len(h) // 2 - 49, 0)), lambda k: md5(substr(h, 2 * k + 1, 100)))) AS w FROM d),
f AS (SELECT rid, doc_id, i, min(doc_id) OVER (PARTITION BY w) AS first FROM s),
r AS (SELECT rid, i, i - coalesce(lag(i) OVER (PARTITION BY rid ORDER BY i), -100) > 50 AS opens FROM f WHERE first < doc_id),
g AS (SELECT rid, i, sum(opens::INT) OVER (PARTITION BY rid ORDER BY i) AS span FROM r),
p AS (SELECT rid, min(i) AS a, max(i) + 50 AS b FROM g GROUP BY rid, span),
k AS (SELECT rid, a, b, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS before FROM p),
o AS (SELECT k.rid, count(*) AS n_spans, sum(b - a)::BIGINT AS n_removed, max(b) AS last, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head
      FROM k JOIN d USING (rid) GROUP BY k.rid)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN o USING (rid)
""",
    "op3_mix_sources": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         -ln((('0x' || substr(md5('42:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
         / greatest(0.1, coalesce(length(regexp_replace(coalesce(text, ''), '[0-9#*$%&|<>{}\[\]\\^~=+_@]+', '', 'g'))::DOUBLE / nullif(length(coalesce(text, '')), 0), 0.1)) AS k
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rn FROM d GROUP BY source),
w AS (SELECT *, CASE (rn - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS wt, 2.0::DOUBLE * source_size AS cap FROM s),
o AS (SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS total, row_number() OVER (ORDER BY cap / wt, rn) AS pos FROM w),
l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / (sum(wt) OVER () - coalesce(sum(wt) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lam FROM o),
f AS (SELECT min_by(lam, pos) AS level FROM l WHERE cap / wt > lam),
t AS (SELECT source, source_size, CASE WHEN level IS NULL OR cap / wt <= level THEN cap ELSE level * wt END AS target FROM l, f),
e AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size)::BIGINT END AS epochs FROM t),
p AS (SELECT d.*, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS budget,
             sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS start
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (size * (epochs + CASE WHEN start + size / 2.0 <= budget THEN 1 ELSE 0 END))::BIGINT AS taken FROM p
""",
    "op4_exact_dedup": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
""",
    "op10_quality_rules": rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
pos AS (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3),
g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, ws[i], ws[i + 1], ws[i + 2]) AS c FROM pos),
r AS (SELECT rid, count(DISTINCT j)::BIGINT AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM g WHERE c >= 2) GROUP BY rid),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
             len(lines) AS n_lines, len(list_filter(ws, lambda x: x IN ({_STOP_LIST}))) AS n_stop
      FROM w LEFT JOIN r USING (rid)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
             array_to_string(list_filter([
               CASE WHEN word_chars / nullif(n_words, 0)::DOUBLE < {_RULE_BOUNDS["mean_word_chars"].low} OR word_chars / nullif(n_words, 0)::DOUBLE > {_RULE_BOUNDS["mean_word_chars"].high} THEN 'mean_word_chars' END,
               CASE WHEN n_symbols / nullif(n_words, 0)::DOUBLE > {_RULE_BOUNDS["symbols_per_word"].high} THEN 'symbols_per_word' END,
               CASE WHEN n_stop / nullif(n_words, 0)::DOUBLE < {_RULE_BOUNDS["stop_word_share"].low} THEN 'stop_word_share' END,
               CASE WHEN n_dup_lines / nullif(n_lines, 0)::DOUBLE > {_RULE_BOUNDS["duplicate_line_share"].high} THEN 'duplicate_line_share' END,
               CASE WHEN n_repeat_words / nullif(n_words, 0)::DOUBLE > {_RULE_BOUNDS["repeated_word_share"].high} THEN 'repeated_word_share' END
             ], lambda x: x IS NOT NULL), ',') AS failed_rules FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed_rules = '' AS kept, failed_rules FROM v
""",
    "op11_spelling_variants": r"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce(list_prepend(i, range(0, 8)), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(0, 256) r(i)),
runs AS (SELECT coalesce(doc_id::VARCHAR, 'null') AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
g AS (SELECT id, run, count(*) AS c, hex(encode(id || ':' || run)) AS x FROM runs GROUP BY id, run),
h AS (SELECT run, c, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, len(x) // 2), lambda k: ('0x' || substr(x, 2 * k + 1, 2))::BIGINT)), lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1])), 4294967295) AS h FROM g, crc),
w AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(c)::BIGINT AS n FROM h GROUP BY 1),
v AS (SELECT word, n FROM w WHERE n >= 3 AND length(word) >= 5),
dl AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS key FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS (SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM dl a JOIN dl b ON a.key = b.key AND a.i = b.i AND a.word <> b.word
      UNION SELECT a.word, a.n, b.word, b.n FROM v a JOIN dl b ON a.word = b.key
      UNION SELECT b.word, b.n, a.word, a.n FROM v a JOIN dl b ON a.word = b.key),
f AS (SELECT word, n, count(*) AS n_near, max(other_n) AS best_n FROM p GROUP BY word, n),
o AS (SELECT f.word, min(p.other) AS form FROM f JOIN p ON p.word = f.word AND p.other_n = f.best_n WHERE f.best_n >= 2 * f.n GROUP BY f.word),
r AS (SELECT word, form AS root FROM o UNION ALL SELECT r.word, o.form FROM r JOIN o ON o.word = r.root),
e AS (SELECT r.word, r.root FROM r LEFT JOIN o ON o.word = r.root WHERE o.word IS NULL)
SELECT v.word, o.form, coalesce(e.root, v.word) AS root, v.n, coalesce(f.n_near, 0)::BIGINT AS n_near, CASE WHEN o.form IS NOT NULL THEN f.best_n END AS form_n
FROM v LEFT JOIN f ON f.word = v.word LEFT JOIN o ON o.word = v.word LEFT JOIN e ON e.word = v.word
""",
    "op12_lexical_search": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
s AS (SELECT count(*) FILTER (len(ts) > 0)::BIGINT AS big_n, sum(len(ts))::BIGINT AS big_l FROM d),
qt AS (SELECT item_id, term, count(*)::BIGINT AS repeats FROM (
         SELECT item_id, text, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY item_id, term),
p AS (SELECT rid, term, count(*)::BIGINT AS tf FROM (SELECT rid, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM qt) GROUP BY rid, term),
w AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*)::BIGINT AS df FROM p GROUP BY term), s),
m AS (SELECT rid, doc_id, 100 - 25 + ((25 * len(ts)::BIGINT * big_n) // big_l) AS m FROM d, s WHERE len(ts) > 0),
c AS (SELECT item_id, rid, sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
      FROM qt JOIN w USING (term) JOIN p USING (term) JOIN m USING (rid) GROUP BY item_id, rid),
k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, rid)::INT AS rank, doc_id, score FROM c JOIN m USING (rid) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 20
""",
}
