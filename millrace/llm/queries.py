"""The registered queries of this subpackage, and their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The production tokenizer; its folder is the installed package of public vocabularies."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import KEY, pseudonymised

    return pseudonymised(_table(spark, sf_dir, "documents"), spark.conf.get("spark.millrace.pii.key", KEY))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan

    return scan(_table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix, taken_words

    return taken_words(*mix(_table(spark, sf_dir, "documents")))


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .htmltext import extracted

    return extracted(_table(spark, sf_dir, "pages"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_rules

    return quality_rules(_table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linededup import dedup_lines, digest

    return digest(dedup_lines(_table(spark, sf_dir, "documents")))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngramjoin import near_groups

    return near_groups(_table(spark, sf_dir, "documents"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokenbin import digest, write_tokens

    return digest(write_tokens(_table(spark, sf_dir, "documents"), tokenizer_path()))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


#: ASCII blanks as SQL text, for trimming.
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _quality_sql() -> str:
    """Word and line measures, and the characters covered by repeated n-grams of each length."""
    from .quality import COVERAGE, LINE_COVERAGE, MIN_WORDS, REPEAT_PERCENT, REPEAT_WINDOW

    tables, columns, joins, rules = [], [], [], [f"dup_line_share <= {LINE_COVERAGE}"]
    for n in sorted({REPEAT_WINDOW, *COVERAGE}):
        gram = " || chr(0) || ".join(f"lead(w, {k}) OVER p" if k else "w" for k in range(n))
        tables.append(
            f"""g{n} AS (SELECT doc_id, i, {gram} AS g FROM w WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
d{n} AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g{n} WHERE g IS NOT NULL) WHERE c > 1),
c{n} AS (SELECT doc_id, count(*) AS words, sum(length(w)) AS chars FROM w WHERE EXISTS (SELECT 1 FROM (SELECT doc_id, i + unnest(range({n})) AS i FROM d{n}) e WHERE e.doc_id = w.doc_id AND e.i = w.i) GROUP BY doc_id)"""
        )
        joins.append(f"LEFT JOIN c{n} USING (doc_id)")
        if n in COVERAGE:
            columns.append(f"CAST(coalesce(c{n}.chars, 0) AS DOUBLE) / greatest(word_chars, 1) AS dup_{n}gram_share")
            rules.append(f"dup_{n}gram_share <= {COVERAGE[n]}")
    return f"""WITH w AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents)),
a AS (SELECT doc_id, count(*) AS n_words, sum(length(w)) AS word_chars FROM w GROUP BY doc_id),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
ll AS (SELECT doc_id, length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS chars, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dl AS (SELECT doc_id, count(*) AS n_dup_lines, sum(chars) AS chars FROM ll WHERE n > 1 GROUP BY doc_id),
{", ".join(tables)},
m AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars, CAST(length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(c{REPEAT_WINDOW}.words, 0) AS n_repeat_words, CAST(coalesce(dl.chars, 0) AS DOUBLE) / greatest(coalesce(word_chars, 0), 1) AS dup_line_share, {", ".join(columns).replace("word_chars, 1", "coalesce(word_chars, 0), 1")}
  FROM documents LEFT JOIN a USING (doc_id) LEFT JOIN dl USING (doc_id) {" ".join(joins)}),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND {" AND ".join(rules)} AS kept FROM b"""


def _line_dedup_sql() -> str:
    key = f"translate(trim(line, {_BLANKS}), '{_UPPER}', '{_LOWER}')"
    return f"""WITH l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
k AS (SELECT doc_id, i, line, {key} AS key FROM l),
often AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k.*, last IS NOT NULL AND doc_id < last AS lost FROM k LEFT JOIN often USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE lost) AS BIGINT) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT lost), '')) AS kept_sha256 FROM j GROUP BY doc_id"""


def _ngram_join_sql() -> str:
    """Exact similarities from shared five-word runs; groups by following links."""
    return """WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '(?:[a-z0-9]|[^\x00-\x7F])+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
sets AS (SELECT doc_id, md5(string_agg(g, chr(0) ORDER BY g)) AS m FROM s GROUP BY doc_id), firsts AS (SELECT m, min(doc_id) AS set_id FROM sets GROUP BY m),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.8 * (x.n + y.n - c)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, least(d.doc_id, coalesce((SELECT min(b) FROM reach WHERE a = d.doc_id), d.doc_id)) AS class_id, (SELECT count(*) FROM links WHERE a = d.doc_id) AS n_links,
  coalesce((SELECT set_id FROM sets JOIN firsts USING (m) WHERE sets.doc_id = d.doc_id), d.doc_id) AS set_id FROM documents d"""


def oracle_sql() -> dict[str, str]:
    return {"op7_quality_rules": _quality_sql(), "op8_line_dedup": _line_dedup_sql(), "op9_ngram_join": _ngram_join_sql()}
