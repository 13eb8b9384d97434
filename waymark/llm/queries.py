"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from waymark.llm.hash_sql import CRC_TABLE, crc
from waymark.llm.session import prepare
from waymark.session import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            prepare(spark)
            return fn(spark, folder)

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_pii")
def op1(spark, folder):
    """Personal data in every document."""
    from waymark.llm.pii import find_pii, pii_report

    return pii_report(find_pii(read_table(spark, folder, "documents"), keep=["doc_id"]))


@query("op3_secrets")
def op3(spark, folder):
    """Secrets in every document."""
    from waymark.llm.secrets import find_secrets, secret_report

    return secret_report(find_secrets(read_table(spark, folder, "documents")))


URL_SQL = r"""
WITH cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(rest, length(regexp_extract(rest, '^([^/?#]*)', 1)) + 1), '^([^?#]*)', 1) AS path FROM cut),
rules(verdict, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
fits AS (SELECT page_id, verdict, h || p AS rule, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC, length(h) DESC) AS k
  FROM split JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT s.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM split s LEFT JOIN fits f ON f.page_id = s.page_id AND k = 1
"""


@query("op4_urls", URL_SQL)
def op4(spark, folder):
    """The verdict on every page's URL."""
    from waymark.llm.urls import judge_urls

    return judge_urls(read_table(spark, folder, "pages").select("page_id", "url")).drop("url")


@query("op2_toxicity")
def op2(spark, folder):
    """A toxicity score for every document."""
    from waymark.llm.toxicity import score_toxicity

    return score_toxicity(read_table(spark, folder, "documents"), read_table(spark, folder, "labels"), keep=["doc_id"])


def license_sql() -> str:
    """Base phrases and template languages as SQL over the normalised words."""
    from waymark.llm.licenses import PHRASES, TEMPLATES, template_regex

    wide = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    places = " || ".join(
        f"list_transform(list_filter(range(len(w)), lambda i: {' AND '.join(f"w[i+{k}]='{x}'" for k, x in enumerate(p.split(' '), 1))}), lambda i: {{'at': i, 'label': '{label}'}})" for p, label in PHRASES
    )
    accepted = ", ".join(f"CASE WHEN regexp_matches(t, '{template_regex(text)}') THEN '{label}' END" for label, text in TEMPLATES)
    return f"""
    WITH a AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{wide}') AS w FROM documents),
    b AS (SELECT doc_id, w, {places} AS places, ' ' || array_to_string(w, ' ') || ' ' AS t FROM a),
    c AS (SELECT doc_id, len(w) AS n_words, places, list_sort(list_distinct(list_transform(places, lambda p: p.label))) AS own, list_distinct(list_filter([{accepted}], lambda x: x IS NOT NULL)) AS more FROM b)
    SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base, CAST(list_min(list_transform(places, lambda p: p.at)) AS BIGINT) AS first_word, CAST(list_max(list_transform(places, lambda p: p.at)) AS BIGINT) AS last_word,
      array_to_string(own, ',') AS base_labels, array_to_string(list_sort(list_distinct(own || more)), ',') AS labels, CASE WHEN len(more) > 0 THEN 1.0 WHEN len(own) > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score FROM c"""


@query("op5_licenses", license_sql())
def op5(spark, folder):
    """License wording in every document."""
    from waymark.llm.licenses import find_licenses

    return find_licenses(read_table(spark, folder, "documents"), keep=["doc_id"]).drop("matches")


@query("op6_minhash")
def op6(spark, folder):
    """The near-duplicate class of every document."""
    from waymark.llm.minhash import classes

    return classes(read_table(spark, folder, "documents"))


@query("op7_decontamination")
def op7(spark, folder):
    """Every document into which a benchmark item leaks, and the item."""
    from waymark.llm.decontaminate import find_leaks

    return find_leaks(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"))


@query("op8_embeddings")
def op8(spark, folder):
    """The near-duplicate component and link count of every vector."""
    from waymark.llm.vectors import near_vectors

    return near_vectors(read_table(spark, folder, "embeddings"))


@query("op10_shards")
def op10(spark, folder):
    """Every document's token ids in training order, written as shards and read back."""
    from waymark.llm.shards import shard_report

    return shard_report(read_table(spark, folder, "documents"))


@query("op9_pieces")
def op9(spark, folder):
    """Piece ids of every document, as a digest, and whether they decode to its text."""
    from waymark.llm.pieces import load_pieces, piece_report

    return piece_report(read_table(spark, folder, "documents"), load_pieces())


LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def resampling_sql() -> str:
    """Features counted per distinct run of words; each distinct run is hashed once."""

    def runs(table: str) -> str:
        more = " || ".join(f"list_transform(range(1, len(w) - {k - 1} + 1), lambda i: array_to_string(w[i:i + {k - 1}], ' '))" for k in (1, 2, 3))
        return f"SELECT *, unnest({more}) AS feature FROM (SELECT *, regexp_extract_all({LOW}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {table})"

    return f"""
    WITH {CRC_TABLE},
    d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
    wide AS (SELECT r, len(regexp_extract_all({LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS n FROM d),
    own AS MATERIALIZED (SELECT r, feature, count(*) AS n FROM ({runs("d")}) GROUP BY ALL),
    other AS MATERIALIZED (SELECT feature, count(*) AS n FROM ({runs("benchmark")}) GROUP BY ALL),
    every AS MATERIALIZED (SELECT feature, {crc("feature")} % 10000 AS bucket FROM (SELECT feature FROM own UNION SELECT feature FROM other), crc_table),
    s AS MATERIALIZED (SELECT bucket, sum(n) AS n FROM own JOIN every USING (feature) GROUP BY ALL),
    t AS MATERIALIZED (SELECT bucket, sum(n) AS n FROM other JOIN every USING (feature) GROUP BY ALL),
    sums AS (SELECT (SELECT coalesce(sum(n), 0) FROM s)::DOUBLE AS s_all, (SELECT coalesce(sum(n), 0) FROM t)::DOUBLE AS t_all),
    gains AS MATERIALIZED (SELECT bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (s_all + 10000) / ((s.n + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket), sums),
    sides AS (SELECT r, sum(n * gain)::BIGINT AS weight, sum(n)::BIGINT AS n_features FROM own JOIN every USING (feature) JOIN gains USING (bucket) GROUP BY r),
    drawn AS (SELECT r, doc_id, wide.n AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight, ('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d JOIN wide USING (r) LEFT JOIN sides USING (r)),
    scored AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM drawn),
    placed AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST, n_features) AS place, count(*) OVER () AS fit FROM scored WHERE n_words >= 20)
    SELECT doc_id, n_features, weight, score, CASE WHEN place <= 5 * fit // 100 THEN place END AS rank FROM scored LEFT JOIN placed USING (r)"""


def spelling_sql() -> str:
    """Near words through equal words after one deletion: at the same place on both sides, or on one side only."""
    return f"""
    WITH RECURSIVE {CRC_TABLE},
    runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all({LOW}, '[a-zÀ-ÿ]+')) AS w FROM documents),
    hashed AS (SELECT w, n, {crc("id || ':' || w")} AS h FROM (SELECT id, w, count(*) AS n FROM runs WHERE length(w) >= 5 GROUP BY ALL), crc_table),
    dropped AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM hashed),
    words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM dropped WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
    cuts AS MATERIALIZED (SELECT word, n, k, substr(word, 1, k - 1) || substr(word, k + 1) AS cut FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS k FROM words)),
    near AS (
      SELECT a.word, b.word AS other, b.n AS m FROM cuts a JOIN cuts b ON a.k = b.k AND a.cut = b.cut AND a.word <> b.word
      UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.cut = b.word
      UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.cut = b.word),
    best AS (SELECT word, count(*) AS n_near, arg_min(other, (-m, other)) AS other, max(m) AS m FROM near GROUP BY word),
    forms AS MATERIALIZED (SELECT w.word, w.n, CASE WHEN m >= 2 * w.n THEN other END AS form, CASE WHEN m >= 2 * w.n THEN m END AS form_n, coalesce(n_near, 0)::BIGINT AS n_near FROM words w LEFT JOIN best USING (word)),
    chain(word, root) AS (SELECT word, word FROM forms UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL)
    SELECT f.word, f.n, f.form, f.form_n, c.root, f.n_near FROM forms f JOIN chain c ON c.word = f.word JOIN forms last ON last.word = c.root WHERE last.form IS NULL"""


@query("op11_resampling", resampling_sql())
def op11(spark, folder):
    """Weight and draw of every document towards the benchmark's texts."""
    from waymark.llm.resampling import resample

    return resample(read_table(spark, folder, "documents"), read_table(spark, folder, "benchmark"), keep=["doc_id"])


@query("op12_spelling", spelling_sql())
def op12(spark, folder):
    """Near words, form and root of every word of the documents."""
    from waymark.llm.spelling import spelling_variants

    return spelling_variants(read_table(spark, folder, "documents"))


@query("op13_neighbours")
def op13(spark, folder):
    """The five nearest vectors of every fiftieth."""
    from pyspark.sql import functions as F

    from waymark.llm.neighbours import nearest

    return nearest(read_table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
