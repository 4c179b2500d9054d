"""The registered queries: each runs one operator over whole tables of a data folder.

``QUERIES`` maps a name to a function of (session, folder); ``ORACLE`` maps the names that
plain SQL can express to that SQL. Doubles are rounded to six digits on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalcheck.functions import columns, scoring, text, vectors
from signalcheck.functions.lexicons import EMOTION_WORDS, LEMMAS, NEGATIVE_WORDS, POSITIVE_WORDS, STOP_WORDS
from signalcheck.operators import anomaly, autoencoder, evidence, features, profile, verify, vote
from signalcheck.operators.dbscan import dbscan_noise
from signalcheck.operators.quantile import flag_above_quantile
from signalcheck.plans import feedback, pipeline
from signalcheck.session import materialize, new_table_path
from signalcheck.sources import posts, verdicts
from signalcheck.sources.csv_ranges import read_csv_ranges

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

RADIUS = 1.16
LANGUAGES = ("de", "en", "es", "fr")
#: Every column of numbers of lineitem; the queries find them by type, the SQL names them.
MEASURES = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


def query(sql: str | None = None):
    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def measures(spark: SparkSession, folder: str) -> tuple[DataFrame, list[str]]:
    lines = table(spark, folder, "lineitem")
    return lines, columns.numeric_columns(lines)


def wide(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table with long texts, spread over all cores."""
    return posts.spread(table(spark, folder, name))


def r6(column: Column) -> Column:
    return F.round(column, 6)


# ---- SQL fragments shared by the oracles ----


def quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def sql_clean(value: str) -> str:
    for pattern in (text.URL_PATTERN, text.TAG_PATTERN, text.SPECIAL_PATTERN):
        value = f"regexp_replace({value}, '{pattern}', '', 'g')"
    return value


def sql_tokens(value: str) -> str:
    return rf"list_filter(regexp_split_to_array({sql_clean(value)}, '\s+'), lambda w: w <> '')"


def sql_countable(value: str) -> str:
    return f"list_filter({sql_tokens(value)}, lambda w: length(w) >= 2)"


def sql_terms(value: str) -> str:
    return f"list_distinct(list_filter({sql_countable(f'lower({value})')}, lambda w: w NOT IN ({quoted(STOP_WORDS)})))"


SQL_TERM_COUNTS = f"""
term_counts AS (
  SELECT doc_id, term, count(*) AS n
  FROM (SELECT doc_id, unnest({sql_countable("lower(text)")}) AS term FROM documents)
  GROUP BY doc_id, term)"""

SQL_VERDICTS = """
stated AS (
  SELECT lower(text) AS claim,
         CASE WHEN toxic = 1 THEN 'False' WHEN quality = 1 THEN 'True' WHEN lang = 'en' THEN 'Unclear' ELSE 'bogus' END AS verdict
  FROM documents JOIN labels USING (doc_id)),
verdicts AS (SELECT DISTINCT claim, verdict FROM stated)"""

SQL_EVIDENCE = f"""
claims AS (SELECT DISTINCT text AS claim FROM conversations WHERE role = 'user'),
asked AS (SELECT claim, {sql_terms("claim")} AS terms FROM claims),
asked_terms AS (
  SELECT claim, unnest(terms) AS term, len(terms) AS n, greatest(ceil(len(terms) * 0.4::DOUBLE - 1e-9), 1) AS need FROM asked),
known_terms AS (SELECT doc_id, unnest({sql_terms("text")}) AS term FROM documents),
scored AS (
  SELECT claim, doc_id, n, count(*) AS shared FROM asked_terms JOIN known_terms USING (term)
  GROUP BY claim, doc_id, n, need HAVING count(*) >= need),
ranked AS (SELECT *, row_number() OVER (PARTITION BY claim ORDER BY shared DESC, doc_id) AS rank FROM scored)"""

SQL_CHECKED = """
checked AS (
  SELECT c.claim,
         CASE WHEN shared IS NULL THEN 'Unclear' WHEN shared / n >= 0.8 THEN 'True' WHEN shared / n >= 0.65 THEN 'Partially True'
              WHEN shared / n >= 0.5 THEN 'Partially False' ELSE 'False' END AS verdict
  FROM claims c LEFT JOIN (SELECT * FROM ranked WHERE rank = 1) r ON c.claim = r.claim)"""


# ---- Frames shared by the queries ----


def labelled_documents(spark: SparkSession, folder: str) -> DataFrame:
    return wide(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")


def tokens_of(value: str = "text") -> Column:
    return text.tokenize(text.clean_text(F.lower(F.col(value))))


def document_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return wide(spark, folder, "documents").select("doc_id", "lang", "n_chars", tokens_of().alias("tokens"))


def stated_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """Verdicts that the labels stand for, one row per labelled document."""
    verdict = (
        F.when(F.col("toxic") == 1, "False")
        .when(F.col("quality") == 1, "True")
        .when(F.col("lang") == "en", "Unclear")
        .otherwise("bogus")
    )
    rows = wide(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id")
    return rows.select(F.lower("text").alias("claim"), verdict.alias("verdict"))


def user_claims(spark: SparkSession, folder: str) -> DataFrame:
    said = table(spark, folder, "conversations").filter("role = 'user'")
    return said.select("conv_id", "turn", F.col("text").alias("claim"))


def embedding_vectors(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    return rows.select("vec_id", "label", array_to_vector("embedding").alias("features"))


def document_features(spark: SparkSession, folder: str, only: DataFrame | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """Counts of all terms and a two-number size vector per document, both as ML vectors; and the term dictionary.

    With ``only`` the documents named there have vectors; the dictionary is that of all documents.
    """
    tokens = materialize(document_tokens(spark, folder), "document-tokens")
    counts = materialize(features.term_counts(tokens, "doc_id", "tokens"), "term-counts")
    ids = features.term_ids(counts)
    if only is not None:
        keys = only.select("doc_id").distinct()
        tokens, counts = tokens.join(keys, "doc_id", "left_semi"), counts.join(keys, "doc_id", "left_semi")
    size = F.array(F.col("n_chars").cast("double"), F.size("tokens").cast("double"))
    found = {
        "dtm": features.term_vectors(counts, ids, tokens, "doc_id"),
        "size": tokens.select("doc_id", array_to_vector(size).alias("features")),
    }
    return found, ids


def feature_cells(rows: DataFrame, ids: DataFrame, *keep: str) -> DataFrame:
    """Every stored cell of feature rows: the kept columns, the feature's name or place, its value."""
    cells = features.vector_cells(rows, *keep)
    terms = features.named_cells(cells.filter("feature_name = 'dtm'"), ids, *keep)
    places = cells.filter("feature_name <> 'dtm'").select(*keep, F.col("_at").cast("string").alias("feature"), "_value")
    return terms.withColumnRenamed("term", "feature").unionByName(places).withColumnRenamed("_value", "value")


# ---- Scans, sinks, preview ----


@query("SELECT doc_id, text, lang, source, n_chars FROM documents")
def scan_csv_roundtrip(spark, folder):
    documents = table(spark, folder, "documents")
    path = new_table_path(spark, "documents-csv")
    posts.write_csv(documents, path)
    return posts.read_csv(spark, path, documents.schema)


@query("""SELECT doc_id, text || chr(10) || '"' || source || '",' AS text, lang FROM documents""")
def scan_csv_ranges(spark, folder):
    """Texts with line breaks and quotes, columns in another order than the schema's, read by byte ranges."""
    documents = table(spark, folder, "documents").select("doc_id", "text", "lang", "source")
    quoted = F.concat("text", F.lit('\n"'), "source", F.lit('",')).alias("text")
    path = new_table_path(spark, "documents-csv")
    posts.write_csv(documents.select("source", "lang", quoted, "doc_id"), path)
    return read_csv_ranges(spark, path, documents.drop("source").schema)


@query(f"WITH {SQL_VERDICTS} SELECT claim, verdict FROM stated")
def verdict_scan(spark, folder):
    path = new_table_path(spark, "verdicts")
    verdicts.append_verdicts(stated_verdicts(spark, folder), path)
    return verdicts.read_verdicts(spark, path)


@query("SELECT doc_id, lang, source, n_chars FROM documents ORDER BY doc_id LIMIT 5")
def preview_head(spark, folder):
    return posts.preview(table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id")


def _sql_per_column(measure: str) -> str:
    types = {
        "doc_id": "bigint",
        "text": "string",
        "lang": "string",
        "source": "string",
        "n_chars": "bigint",
        "quality": "int",
        "toxic": "int",
    }
    rows = "documents LEFT JOIN labels USING (doc_id)"
    return " UNION ALL ".join("SELECT " + measure.format(c=c, t=t) + f" FROM {rows}" for c, t in types.items())


@query(_sql_per_column("'{c}' AS column_name, count({c}) AS non_null, '{t}' AS dtype"))
def profile_info(spark, folder):
    return posts.schema_report(labelled_documents(spark, folder))


# ---- Projections and casts ----


@query(
    """SELECT event_id, CAST(event_id AS VARCHAR) AS event_text, CAST(user_id AS INTEGER) AS user_number,
         CAST(trunc(value) AS BIGINT) AS whole, TRY_CAST(event_type AS BIGINT) AS type_number,
         TRY_CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k
       FROM events"""
)
def cast_types(spark, folder):
    events = table(spark, folder, "events").select(
        "event_id",
        F.col("event_id").alias("event_text"),
        F.col("user_id").alias("user_number"),
        F.col("value").alias("whole"),
        F.col("event_type").alias("type_number"),
        F.regexp_extract("props", "[0-9]+", 0).alias("k"),
    )
    kinds = {"event_text": "string", "user_number": "int", "whole": "bigint", "type_number": "bigint", "k": "bigint"}
    return columns.cast_columns(events, kinds)


@query("SELECT doc_id, quality <> 0 AS quality, toxic <> 0 AS toxic FROM labels")
def cast_flags(spark, folder):
    return columns.cast_columns(table(spark, folder, "labels"), {"quality": "boolean", "toxic": "boolean"})


@query("SELECT doc_id, source, dense_rank() OVER (ORDER BY source) - 1 AS code FROM documents")
def category_codes(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id", "source")
    return columns.category_codes(rows, "source", "doc_id", "code").select("doc_id", "source", "code")


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS parsed, CAST(hour(ts) AS INTEGER) AS hour FROM events")
def parse_timestamp(spark, folder):
    written = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    parsed = table(spark, folder, "events").select("event_id", columns.parse_timestamp(written).alias("t"))
    return parsed.select("event_id", F.date_format("t", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("parsed"), F.hour("t").alias("hour"))


@query(
    """SELECT event_id, CASE WHEN value >= 200 THEN floor(value) * 1000 WHEN value >= 100 THEN floor(value) * 1000000
                             ELSE floor(value) END AS number
       FROM events"""
)
def parse_suffix_number(spark, folder):
    whole = F.floor("value").cast("string")
    written = (
        F.when(F.col("value") >= 200, F.concat(whole, F.lit("K")))
        .when(F.col("value") >= 100, F.concat(whole, F.lit("M")))
        .otherwise(whole)
    )
    return table(spark, folder, "events").select("event_id", columns.parse_suffix_number(written).alias("number"))


@query("SELECT doc_id, lower(text) AS text, lower(lang) AS lang, lower(source) AS source FROM documents")
def lower_columns(spark, folder):
    names = ["text", "lang", "source"]
    return text.lower_columns(wide(spark, folder, "documents").select("doc_id", *names), names)


@query(f"SELECT page_id, regexp_replace(concat('x ', url, ' y'), '{text.URL_PATTERN}', '', 'g') AS stripped FROM pages")
def strip_urls(spark, folder):
    inside = F.concat(F.lit("x "), F.col("url"), F.lit(" y"))
    return wide(spark, folder, "pages").select("page_id", text.strip_urls(inside).alias("stripped"))


@query(f"SELECT page_id, regexp_replace(html, '{text.TAG_PATTERN}', '', 'g') AS stripped FROM pages")
def strip_html(spark, folder):
    return wide(spark, folder, "pages").select("page_id", text.strip_tags(F.col("html")).alias("stripped"))


@query(f"SELECT doc_id, {sql_clean('lower(text)')} AS cleaned FROM documents")
def clean_text(spark, folder):
    return wide(spark, folder, "documents").select("doc_id", text.clean_text(F.lower("text")).alias("cleaned"))


@query(
    "SELECT doc_id, lang AS Original_lang, "
    + ", ".join(f"lang = '{v}' AS lang_{v}" for v in LANGUAGES)
    + " FROM documents"
)
def one_hot(spark, folder):
    return columns.one_hot(table(spark, folder, "documents").select("doc_id", "lang"), "lang").drop("lang")


# ---- Tokens ----


@query(f"SELECT doc_id, len(t) AS n_tokens, array_to_string(t, ' ') AS tokens FROM (SELECT doc_id, {sql_tokens('lower(text)')} AS t FROM documents)")
def tokenize(spark, folder):
    rows = document_tokens(spark, folder)
    return rows.select("doc_id", F.size("tokens").cast("bigint").alias("n_tokens"), text.token_string(F.col("tokens")).alias("tokens"))


SQL_LEMMATIZED = f"""
words AS (
  SELECT doc_id, unnest(t) AS token, generate_subscripts(t, 1) AS pos
  FROM (SELECT doc_id, {sql_tokens("lower(text)")} AS t FROM documents)),
lemmas(token, lemma) AS (VALUES {", ".join(f"('{w}', '{lemma}')" for w, lemma in LEMMAS.items())}),
lemmatized AS (
  SELECT doc_id, pos, coalesce(lemma, token) AS token FROM words LEFT JOIN lemmas USING (token))"""


@query(
    f"""WITH {SQL_LEMMATIZED}
    SELECT doc_id, coalesce(string_agg(token, ' ' ORDER BY pos), '') AS lemmas
    FROM documents LEFT JOIN lemmatized USING (doc_id) GROUP BY doc_id"""
)
def lemmatize(spark, folder):
    rows = document_tokens(spark, folder)
    return rows.select("doc_id", text.token_string(text.lemmatize(F.col("tokens"))).alias("lemmas"))


@query(
    f"""WITH {SQL_LEMMATIZED}
    SELECT doc_id, coalesce(string_agg(token, ' ' ORDER BY pos), '') AS lemmas
    FROM documents LEFT JOIN lemmatized USING (doc_id) GROUP BY doc_id"""
)
def lemmatize_by_table(spark, folder):
    lemmas = spark.createDataFrame(list(LEMMAS.items()), "token string, lemma string")
    rows = text.lemmatize_by_table(document_tokens(spark, folder), "doc_id", "tokens", lemmas)
    return rows.select("doc_id", text.token_string(F.col("tokens")).alias("lemmas"))


@query(
    f"""WITH {SQL_LEMMATIZED},
    kept AS (SELECT * FROM lemmatized WHERE token NOT IN ({quoted(STOP_WORDS)}))
    SELECT doc_id, coalesce(string_agg(token, ' ' ORDER BY pos), '') AS kept
    FROM documents LEFT JOIN kept USING (doc_id) GROUP BY doc_id"""
)
def remove_stopwords(spark, folder):
    kept = text.drop_stop_words(text.lemmatize(F.col("tokens")))
    return document_tokens(spark, folder).select("doc_id", text.token_string(kept).alias("kept"))


@query()
def stem_tokens(spark, folder):
    rows = document_tokens(spark, folder)
    return rows.select("doc_id", text.token_string(text.stem_tokens(F.col("tokens"))).alias("stems"))


@query(f"SELECT doc_id, array_to_string({sql_countable('lower(text)')}, ' ') AS token_string FROM documents")
def token_string(spark, folder):
    rows = document_tokens(spark, folder)
    return rows.select("doc_id", text.token_string(text.countable(F.col("tokens"))).alias("token_string"))


# ---- Features ----


@query(f"WITH {SQL_TERM_COUNTS} SELECT doc_id, term, n FROM term_counts")
def term_counts(spark, folder):
    return features.term_counts(document_tokens(spark, folder), "doc_id", "tokens")


@query(
    f"""WITH {SQL_TERM_COUNTS},
    df AS (SELECT term, count(*) AS df FROM term_counts GROUP BY term),
    total AS (SELECT count(DISTINCT doc_id) AS docs FROM term_counts),
    raw AS (SELECT doc_id, term, n * (ln((1 + docs) / (1 + df)) + 1) AS raw FROM term_counts JOIN df USING (term), total),
    lengths AS (SELECT doc_id, sqrt(sum(raw * raw)) AS length FROM raw GROUP BY doc_id)
    SELECT doc_id, term, round(raw / length, 6) AS weight FROM raw JOIN lengths USING (doc_id)"""
)
def tfidf_weights(spark, folder):
    counts = materialize(features.term_counts(document_tokens(spark, folder), "doc_id", "tokens"), "term-counts")
    return features.tfidf(counts, "doc_id").select("doc_id", "term", r6(F.col("weight")).alias("weight"))


@query(f"WITH {SQL_TERM_COUNTS} SELECT doc_id, term, n FROM term_counts")
def dtm_vectors(spark, folder):
    found, ids = document_features(spark, folder)
    cells = features.named_cells(features.vector_cells(found["dtm"], "doc_id"), ids, "doc_id")
    return cells.select("doc_id", "term", F.col("_value").cast("bigint").alias("n"))


@query()
def embed_batch(spark, folder):
    rows = wide(spark, folder, "documents").select("doc_id", text.clean_text(F.lower("text")).alias("cleaned"))
    embedded = scoring.embed(rows, "cleaned", "embedding", scoring.hashed_words_embedder())
    return embedded.select("doc_id", "embedding")


SQL_LONG = "long_documents AS (SELECT * FROM documents WHERE n_chars > (SELECT quantile_cont(n_chars, 0.95) FROM documents))"


def _sql_feature_cells(source: str, keep: str) -> str:
    names = f"SELECT {keep.format('dtm')}"
    sizes = f"SELECT {keep.format('size')}"
    return f"""{names}, term AS feature, n::DOUBLE AS value FROM {source} JOIN term_counts USING (doc_id)
    UNION ALL {sizes}, '0', n_chars::DOUBLE FROM {source}
    UNION ALL {sizes}, '1', len({sql_tokens("lower(text)")})::DOUBLE FROM {source}"""


@query(f"""WITH {SQL_TERM_COUNTS}, {SQL_LONG} {_sql_feature_cells("long_documents", "doc_id, '{}' AS feature_name")}""")
def suspect_features(spark, folder):
    flagged = flag_above_quantile(table(spark, folder, "documents").select("doc_id", "n_chars"), "n_chars")
    flagged = materialize(flagged.filter("is_anomaly"), "suspects")
    path = new_table_path(spark, "suspect-features")
    found, ids = document_features(spark, folder, flagged)
    rows = features.suspect_features(found, flagged, "doc_id")
    features.store_suspect_features(rows, path)
    stored = spark.read.schema(rows.schema).parquet(path)
    return feature_cells(stored, ids, "doc_id", "feature_name")


# ---- Scores per text ----


def _sql_hits(words) -> str:
    return f"len(list_filter(t, lambda w: w IN ({quoted(words)})))"


@query(
    f"""WITH toks AS (SELECT doc_id, text, {sql_tokens("lower(text)")} AS t FROM documents),
    hits AS (SELECT doc_id, text, {_sql_hits(POSITIVE_WORDS)} AS up, {_sql_hits(NEGATIVE_WORDS)} AS down FROM toks),
    bal AS (SELECT *, CASE WHEN up + down = 0 THEN 0.0 ELSE (up - down) / (up + down) END AS b FROM hits)
    SELECT doc_id,
      CASE WHEN trim(text) = '' THEN 'neutral' WHEN b >= 0.6 THEN '5 stars' WHEN b >= 0.2 THEN '4 stars'
           WHEN b > -0.2 THEN '3 stars' WHEN b > -0.6 THEN '2 stars' ELSE '1 star' END AS label,
      CASE WHEN trim(text) = '' OR up + down = 0 THEN 0.0 ELSE round(greatest(up, down) / (up + down), 6) END::DOUBLE AS score
    FROM bal"""
)
def sentiment_lexicon(spark, folder):
    scored = wide(spark, folder, "documents").select("doc_id", scoring.sentiment_by_words(F.col("text")).alias("scores"))
    label, score = scoring.top_score(F.col("scores"))
    return scored.select("doc_id", label.alias("label"), r6(score).alias("score"))


SQL_EMOTIONS = f"""
toks AS (SELECT doc_id, text, {sql_tokens("lower(text)")} AS t FROM documents),
hits AS (SELECT doc_id, text, label, n FROM (
  {" UNION ALL ".join(f"SELECT doc_id, text, '{label}' AS label, {_sql_hits(words)} AS n FROM toks" for label, words in EMOTION_WORDS.items())})),
totals AS (SELECT doc_id, sum(n) AS total FROM hits GROUP BY doc_id),
emotions AS (
  SELECT doc_id, label, n / total AS score FROM hits JOIN totals USING (doc_id) WHERE total > 0 AND trim(text) <> ''
  UNION ALL
  SELECT doc_id, 'neutral', CASE WHEN trim(text) = '' THEN 0.0 ELSE 1.0 END FROM documents JOIN totals USING (doc_id)
  WHERE total = 0 OR trim(text) = ''),
placed AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, label) AS place FROM emotions)"""


@query(f"WITH {SQL_EMOTIONS} SELECT doc_id, label, round(score, 6) AS score, place FROM placed")
def emotion_lexicon(spark, folder):
    scored = wide(spark, folder, "documents").select("doc_id", scoring.emotions_by_words(F.col("text")).alias("scores"))
    rows = scored.select("doc_id", F.posexplode_outer("scores").alias("pos", "s"))
    return rows.select("doc_id", "s.label", r6(F.col("s.score")).alias("score"), (F.col("pos") + 1).cast("bigint").alias("place"))


@query(f"WITH {SQL_EMOTIONS} SELECT doc_id, label, round(score, 6) AS score FROM placed WHERE place = 1")
def top_score_fields(spark, folder):
    scored = wide(spark, folder, "documents").select("doc_id", scoring.emotions_by_words(F.col("text")).alias("scores"))
    label, score = scoring.top_score(F.col("scores"))
    return scored.select("doc_id", label.alias("label"), r6(score).alias("score"))


def _length_scorer():
    """A tiny model for the batch operator: long or short, by number of words."""
    return lambda texts: [[{"label": "long" if len(t.split()) > 100 else "short", "score": 1.0}] for t in texts]


@query(
    r"""SELECT doc_id, CASE WHEN regexp_full_match(text, '\s*') THEN 'neutral'
          WHEN len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) > 100 THEN 'long' ELSE 'short' END AS label
        FROM documents"""
)
def score_with_model(spark, folder):
    rows = wide(spark, folder, "documents").select("doc_id", "text")
    scored = scoring.score_with_model(rows, "text", "scores", _length_scorer)
    return scored.select("doc_id", scoring.top_score(F.col("scores"))[0].alias("label"))


# ---- Profile ----


@query(_sql_per_column("'{c}' AS column_name, count(*) - count({c}) AS n_null"))
def null_counts(spark, folder):
    return profile.null_counts(labelled_documents(spark, folder))


def _sql_each(names, body: str) -> str:
    return " UNION ALL ".join(body.format(c=c) for c in names)


@query(
    _sql_each(
        MEASURES,
        """SELECT '{c}' AS column_name, count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std,
             min({c}) AS min, round(quantile_cont({c}::DOUBLE, 0.25), 6) AS q25, round(quantile_cont({c}::DOUBLE, 0.5), 6) AS q50,
             round(quantile_cont({c}::DOUBLE, 0.75), 6) AS q75, max({c}) AS max FROM lineitem""",
    )
)
def describe_numeric(spark, folder):
    stats = profile.describe(*measures(spark, folder))
    return stats.withColumns({c: r6(F.col(c)) for c in ("mean", "std", "q25", "q50", "q75")})


SQL_RANGES = "ranges AS (" + _sql_each(MEASURES, "SELECT '{c}' AS column_name, min({c}) AS lo, max({c}) AS hi FROM lineitem") + ")"
SQL_LONG_MEASURES = "long AS (" + _sql_each(MEASURES, "SELECT '{c}' AS column_name, {c} AS v FROM lineitem") + ")"


@query(
    f"""WITH {SQL_RANGES}, {SQL_LONG_MEASURES},
    found AS (
      SELECT column_name, least(floor((v - lo) / ((hi - lo) / 50)), 49)::INTEGER AS bin, count(*) AS n
      FROM long JOIN ranges USING (column_name) GROUP BY 1, 2),
    grid AS (SELECT column_name, lo, (hi - lo) / 50 AS w, unnest(range(50))::INTEGER AS bin FROM ranges)
    SELECT column_name, bin, round(lo + bin * w, 6) AS bin_start, coalesce(n, 0) AS n
    FROM grid LEFT JOIN found USING (column_name, bin)"""
)
def histogram_50(spark, folder):
    bins = profile.histogram(*measures(spark, folder))
    return bins.withColumn("bin_start", r6(F.col("bin_start")))


BOXED = ("value", "user_id")
SQL_FENCES = (
    "quartiles AS ("
    + _sql_each(
        BOXED,
        """SELECT '{c}' AS column_name, quantile_cont({c}::DOUBLE, 0.25) AS q25, quantile_cont({c}::DOUBLE, 0.5) AS q50,
             quantile_cont({c}::DOUBLE, 0.75) AS q75 FROM events""",
    )
    + "), long AS ("
    + _sql_each(BOXED, "SELECT event_id, '{c}' AS column_name, {c}::DOUBLE AS v FROM events")
    + """), placed AS (
      SELECT *, v < q25 - 1.5 * (q75 - q25) OR v > q75 + 1.5 * (q75 - q25) AS is_out FROM long JOIN quartiles USING (column_name))"""
)


@query(
    f"""WITH {SQL_FENCES}
    SELECT column_name, round(q25, 6) AS q25, round(q50, 6) AS q50, round(q75, 6) AS q75,
           min(v) FILTER (NOT is_out) AS whisker_low, max(v) FILTER (NOT is_out) AS whisker_high, count(*) FILTER (is_out) AS n_outliers
    FROM placed GROUP BY column_name, q25, q50, q75"""
)
def box_stats(spark, folder):
    stats = profile.box_stats(table(spark, folder, "events"), BOXED)
    return stats.withColumns({c: r6(F.col(c)) for c in ("q25", "q50", "q75")})


@query(f"WITH {SQL_FENCES} SELECT event_id, column_name, v AS value FROM placed WHERE is_out")
def box_outliers(spark, folder):
    return profile.box_outliers(table(spark, folder, "events"), BOXED, "event_id")


def _sql_corr(by: str | None) -> str:
    head, tail = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    cells = [(a, b, "max(1.0::DOUBLE)" if a == b else f"round(corr({a}, {b}), 6)") for a in MEASURES for b in MEASURES]
    return " UNION ALL ".join(f"SELECT {head}'{a}' AS x, '{b}' AS y, {r} AS corr FROM lineitem{tail}" for a, b, r in cells)


@query(_sql_corr(None))
def corr_matrix(spark, folder):
    matrix = profile.correlation_matrix(*measures(spark, folder))
    return matrix.withColumn("corr", r6(F.col("corr")))


@query(_sql_corr("l_returnflag"))
def corr_by_class(spark, folder):
    matrix = profile.correlation_matrix(*measures(spark, folder), "l_returnflag")
    return matrix.withColumn("corr", r6(F.col("corr")))


@query(
    """SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS "l_linestatus_F", count(*) FILTER (l_linestatus = 'O') AS "l_linestatus_O"
       FROM lineitem GROUP BY l_returnflag"""
)
def crosstab(spark, folder):
    return profile.crosstab(table(spark, folder, "lineitem"), "l_returnflag", "l_linestatus")


def _sql_pairs(by: str | None) -> str:
    keep = f"{by}, " if by else ""
    place = "least(floor(({c} - (SELECT min({c}) FROM lineitem)) / (((SELECT max({c}) FROM lineitem) - (SELECT min({c}) FROM lineitem)) / 50)), 49)::INTEGER"
    pairs = [(a, b) for i, a in enumerate(MEASURES) for b in MEASURES[i + 1 :]]
    rows = " UNION ALL ".join(
        f"SELECT {keep}'{a}' AS x, '{b}' AS y, {place.format(c=a)} AS bin_x, {place.format(c=b)} AS bin_y FROM lineitem" for a, b in pairs
    )
    return f"SELECT {keep}x, y, bin_x, bin_y, count(*) AS n FROM ({rows}) GROUP BY ALL"


@query(_sql_pairs(None))
def pair_bins(spark, folder):
    return profile.pair_bins(*measures(spark, folder))


@query(_sql_pairs("l_returnflag"))
def pair_bins_by_class(spark, folder):
    return profile.pair_bins(*measures(spark, folder), by="l_returnflag")


# ---- Anomaly flags ----


@query("SELECT event_id, value FROM events WHERE value > (SELECT quantile_cont(value, 0.95) FROM events)")
def percentile_flag(spark, folder):
    events = table(spark, folder, "events").select("event_id", "value")
    return flag_above_quantile(events, "value").filter("is_anomaly").drop("is_anomaly")


@query(
    """WITH cells AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
    centres AS (SELECT label, i, avg(v) AS c FROM cells GROUP BY label, i)
    SELECT vec_id, label, round(sqrt(sum((v - c) * (v - c))), 6) AS distance
    FROM cells JOIN centres USING (label, i) GROUP BY vec_id, label"""
)
def centroid_distance(spark, folder):
    rows = embedding_vectors(spark, folder)
    centres = anomaly.mean_vectors(rows, "features", "label")
    plain = rows.select("vec_id", "label", vector_to_array("features").alias("x"))
    scored = anomaly.centroid_distance(plain, "vec_id", "x", "label", centres)
    return scored.withColumn("distance", r6(F.col("distance")))


@query()
def kmeans_anomaly(spark, folder):
    return anomaly.kmeans_anomaly(embedding_vectors(spark, folder), "vec_id")


@query()
def kmeans_anomaly_terms(spark, folder):
    counts = features.fold_vectors(document_features(spark, folder)[0]["dtm"], "doc_id")
    return anomaly.kmeans_anomaly(counts, "doc_id", sparse=True)


@query(
    f"""WITH near AS (
      SELECT a.vec_id AS i, b.vec_id AS j FROM embeddings a, embeddings b
      WHERE list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) <= {RADIUS}),
    core AS (SELECT i FROM near GROUP BY i HAVING count(*) >= 5)
    SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT near.i FROM near JOIN core ON near.j = core.i)"""
)
def dbscan_noise_vectors(spark, folder):
    return dbscan_noise(table(spark, folder, "embeddings"), "vec_id", "embedding", eps=RADIUS)


SQL_NOISE = f"""
bags AS (SELECT doc_id, list_sort({sql_countable("lower(text)")}) AS bag FROM documents),
noise AS (SELECT doc_id FROM bags WHERE bag IN (SELECT bag FROM bags GROUP BY bag HAVING count(*) < 5))"""


@query(f"WITH {SQL_NOISE} SELECT doc_id FROM noise")
def duplicate_noise(spark, folder):
    return anomaly.duplicate_noise(document_tokens(spark, folder), "doc_id", anomaly.bag_of_terms(F.col("tokens")))


@query()
def autoencoder_anomaly(spark, folder):
    flags, _ = autoencoder.autoencoder_anomaly(embedding_vectors(spark, folder), "vec_id", 64)
    return flags


@query()
def classifier_vote(spark, folder):
    counts = features.fold_vectors(document_features(spark, folder)[0]["dtm"], "doc_id")
    labels = wide(spark, folder, "documents").select("doc_id", F.col("lang").alias("label_text"))
    return vote.vote_anomaly(counts.join(labels, "doc_id"), "doc_id")


@query(
    """SELECT doc_id, ('0x' || substr(md5(doc_id::VARCHAR || '-42'), 1, 8))::BIGINT / 4294967296 < 0.2::DOUBLE AS is_test FROM documents"""
)
def train_test_split(spark, folder):
    return vote.train_test_split(table(spark, folder, "documents").select("doc_id"), "doc_id")


SQL_FLAGS = f"""
sizes AS (SELECT doc_id, n_chars, len({sql_terms("text")}) AS n_terms FROM documents),
flags AS (
  SELECT doc_id, 'long_text' AS detector FROM sizes WHERE n_chars > (SELECT quantile_cont(n_chars, 0.95) FROM sizes)
  UNION ALL SELECT doc_id, 'many_terms' FROM sizes WHERE n_terms > (SELECT quantile_cont(n_terms, 0.95) FROM sizes)
  UNION ALL SELECT doc_id, 'rare_text' FROM noise)"""


def document_flags(spark: SparkSession, folder: str) -> DataFrame:
    documents = wide(spark, folder, "documents")
    sizes = documents.select("doc_id", "n_chars", F.size(evidence.terms_of(F.col("text"))).alias("n_terms"))
    sizes = materialize(sizes, "document-sizes")
    rare = anomaly.duplicate_noise(document_tokens(spark, folder), "doc_id", anomaly.bag_of_terms(F.col("tokens")))
    flags = {
        "long_text": flag_above_quantile(sizes, "n_chars"),
        "many_terms": flag_above_quantile(sizes, "n_terms"),
        "rare_text": rare,
    }
    return anomaly.union_flags(flags, "doc_id")


@query(
    f"""WITH {SQL_NOISE}, {SQL_FLAGS}
    SELECT doc_id, string_agg(detector, ',' ORDER BY detector) AS detectors, count(*) AS n_detectors FROM flags GROUP BY doc_id"""
)
def union_suspects(spark, folder):
    return anomaly.union_suspects(document_flags(spark, folder), "doc_id")


@query(f"WITH {SQL_LONG} SELECT doc_id, lang, source, n_chars FROM long_documents")
def suspects(spark, folder):
    documents = table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars")
    flagged = flag_above_quantile(documents.select("doc_id", "n_chars"), "n_chars").filter("is_anomaly")
    return anomaly.select_suspects(documents, flagged, "doc_id")


# ---- Verification ----


@query(f"WITH {SQL_EVIDENCE} SELECT claim, doc_id, shared, round(shared / n, 6) AS share, rank FROM ranked WHERE rank <= 3")
def evidence_topk(spark, folder):
    ranked = evidence.rank_evidence(user_claims(spark, folder), wide(spark, folder, "documents"), "doc_id", "text")
    return ranked.withColumns({"share": r6(F.col("share")), "rank": F.col("rank").cast("bigint")})


@query(f"WITH known AS (SELECT doc_id, unnest({sql_terms('text')}) AS term FROM documents) SELECT term, count(*) AS df FROM known GROUP BY term")
def evidence_index(spark, folder):
    """Documents by language, one after the other, into one stored index."""
    documents = wide(spark, folder, "documents")
    index = evidence.EvidenceIndex(spark, new_table_path(spark, "evidence-index"), "doc_id")
    for german in (True, False):
        index.add(documents.filter((F.col("lang") == "de") == F.lit(german)), "text")
    index.add(documents, "text")  # nothing new
    return index.frequency()


def _sql_entities(value: str) -> str:
    for entity, character in evidence.ENTITIES.items():
        value = "replace({}, '{}', '{}')".format(value, entity, character.replace("'", "''"))
    return value


@query(
    f"""SELECT page_id, array_to_string(list_transform(regexp_extract_all(html, '(?s)<li\\b[^>]*>(.*?)</li>', 1),
          lambda b: {_sql_entities("regexp_replace(b, '(?s)<.*?>', '', 'g')")}), ' ') AS found FROM pages"""
)
def html_text(spark, folder):
    return wide(spark, folder, "pages").select("page_id", evidence.result_blocks(F.col("html")).alias("found"))


@query(
    f"""WITH {SQL_EVIDENCE},
    best AS (SELECT claim, string_agg(text, ' ' ORDER BY rank) AS evidence FROM ranked JOIN documents USING (doc_id) WHERE rank <= 3 GROUP BY claim)
    SELECT claim, 'Claim: ' || claim || chr(10) || 'Evidence: ' || coalesce(evidence, '') || chr(10) || 'Is this claim supported?' AS prompt
    FROM claims LEFT JOIN best USING (claim)"""
)
def build_prompt(spark, folder):
    claims, documents = user_claims(spark, folder).select("claim").distinct(), wide(spark, folder, "documents")
    ranked = evidence.rank_evidence(claims, documents, "doc_id", "text")
    found = evidence.join_evidence(ranked, documents, "doc_id", "text", claims, spark.sparkContext.defaultParallelism)
    return found.select("claim", verify.build_prompt(F.col("claim"), F.col("evidence")).alias("prompt"))


@query(f"WITH {SQL_EVIDENCE}, {SQL_CHECKED} SELECT claim, verdict FROM checked")
def verify_claims(spark, folder):
    return verify.check_by_overlap(user_claims(spark, folder), wide(spark, folder, "documents"), "doc_id", "text")


def _evidence_reader():
    """A tiny verifier: a claim is supported when some evidence follows it in the prompt."""

    def answer(prompts):
        return ["The answer is True." if "\nEvidence: \n" not in p else "I find nothing, so Unclear." for p in prompts]

    return answer


@query(
    f"""WITH {SQL_EVIDENCE}
    SELECT claim, CASE WHEN claim IN (SELECT claim FROM ranked) THEN 'True' ELSE 'Unclear' END AS verdict, NULL::VARCHAR AS error FROM claims"""
)
def verify_with_model(spark, folder):
    return verify.check_with_model(user_claims(spark, folder), wide(spark, folder, "documents"), "doc_id", "text", _evidence_reader)


@query(
    f"""WITH {SQL_VERDICTS} SELECT claim, verdict FROM stated"""
)
def normalize_verdict(spark, folder):
    rows = stated_verdicts(spark, folder)
    spoken = F.when(F.col("verdict") == "bogus", F.lit("  bogus ")).otherwise(F.concat(F.lit("I say: "), "verdict", F.lit(".\n")))
    return rows.select("claim", verify.normalize_verdict(spoken).alias("verdict"))


@query(
    f"""WITH {SQL_EVIDENCE}, {SQL_CHECKED}
    SELECT conv_id, turn, verdict FROM conversations c JOIN checked ON c.text = checked.claim WHERE role = 'user'"""
)
def incremental_verify(spark, folder):
    claims, documents = user_claims(spark, folder), wide(spark, folder, "documents")
    rows = claims.withColumn("row", F.concat_ws("-", "conv_id", "turn"))
    path = new_table_path(spark, "verdicts")
    index = evidence.EvidenceIndex.of(documents, "doc_id", "text")

    def check(new: DataFrame) -> DataFrame:
        return verify.check_by_overlap(new, index, "doc_id", "text")

    # Opening turns arrive first; the second run finds them done and checks the rest.
    verify.incremental_verify(rows.filter("turn = 0"), "row", path, check)
    return verify.incremental_verify(rows, "row", path, check).select("conv_id", "turn", "verdict")


# ---- Feedback ----

SQL_LABELLED = """
mapped AS (
  SELECT claim, verdict, CASE WHEN verdict IN ('False', 'Partially False') THEN 1 ELSE 0 END AS label
  FROM verdicts WHERE verdict IN ('False', 'Partially False', 'True', 'Partially True', 'Unclear')),
verified AS (SELECT doc_id, n_chars, text, label FROM documents JOIN mapped ON lower(text) = claim)"""


@query(f"WITH {SQL_VERDICTS}, {SQL_LABELLED} SELECT claim, verdict, label FROM mapped")
def map_verdict_label(spark, folder):
    return feedback.label_verdicts(stated_verdicts(spark, folder).distinct())


@query(f"WITH {SQL_VERDICTS} SELECT doc_id, n_chars, verdict FROM documents JOIN verdicts ON lower(text) = claim")
def join_verdict_features(spark, folder):
    rows = wide(spark, folder, "documents").select("doc_id", "n_chars", F.lower("text").alias("claim"))
    return verify.attach_verdicts(rows, stated_verdicts(spark, folder), "doc_id", "inner", every=True).select("doc_id", "n_chars", "verdict")


def document_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Stored training labels of the verified documents."""
    claims = wide(spark, folder, "documents").select("doc_id", F.lower("text").alias("claim"))
    return materialize(feedback.training_labels(stated_verdicts(spark, folder), claims, "doc_id"), "training-labels")


@query(f"""WITH {SQL_VERDICTS}, {SQL_LABELLED}, {SQL_TERM_COUNTS} {_sql_feature_cells("verified", "doc_id, '{}' AS feature_name, label")}""")
def training_set(spark, folder):
    labels = document_labels(spark, folder)
    found, ids = document_features(spark, folder, labels)
    training = features.suspect_features(found, labels, "doc_id").join(labels, "doc_id")
    return feature_cells(training, ids, "doc_id", "feature_name", "label")


@query(
    """SELECT vec_id, generate_subscripts(embedding, 1)::INTEGER - 1 AS place, greatest(unnest(embedding)::DOUBLE, 0.0::DOUBLE) AS value FROM embeddings"""
)
def clip_features(spark, folder):
    clipped = vectors.clip_negative(F.col("embedding").cast("array<double>"))
    return table(spark, folder, "embeddings").select("vec_id", F.posexplode(clipped).alias("place", "value"))


def training_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Verified documents with counts of all terms and hashed word vectors."""
    labels = document_labels(spark, folder)
    verified = wide(spark, folder, "documents").join(labels, "doc_id", "left_semi")
    embedded = scoring.embed(verified.select("doc_id", text.clean_text(F.lower("text")).alias("cleaned")), "cleaned", "v", scoring.hashed_words_embedder())
    found = {
        "dtm": document_features(spark, folder, labels)[0]["dtm"],
        "bert": embedded.select("doc_id", array_to_vector("v").alias("features")),
    }
    rows = features.suspect_features(found, labels, "doc_id")
    return materialize(rows.join(labels, "doc_id"), "training-set")


@query()
def retrain_scores(spark, folder):
    return feedback.retrain_classifiers(training_rows(spark, folder), "doc_id")


@query()
def autoencoder_refresh(spark, folder):
    return feedback.refresh_autoencoders(training_rows(spark, folder), "doc_id")[0]


@query()
def model_accuracy(spark, folder):
    rows = embedding_vectors(spark, folder).withColumn("label_text", F.col("label").cast("string")).drop("label")
    return vote.held_out_accuracy(rows, "vec_id", signed=True)


# ---- The whole run ----


def documents_as_posts(spark: SparkSession, folder: str) -> DataFrame:
    rows = labelled_documents(spark, folder)
    return rows.select(
        F.col("doc_id").alias("Tweet ID"),
        F.col("source").alias("Name"),
        F.col("source").alias("UserName"),
        F.col("text").alias("Tweets"),
        F.col("lang").alias("Disaster"),
        F.col("lang").alias("Tags"),
        F.lit("").alias("Tweet Link"),
        F.col("n_chars").cast("string").alias("Likes"),
        (F.col("quality") == 1).alias("Verified"),
    )


@query()
def pipeline_suspects(spark, folder):
    config = pipeline.PipelineConfig(
        verdict_path=new_table_path(spark, "verdicts"), evidence=table(spark, folder, "benchmark")
    )
    return pipeline.run(documents_as_posts(spark, folder), config)["suspects"]


@query(
    f"""WITH {SQL_TERM_COUNTS},
    totals AS (SELECT doc_id, sum(n) AS terms, max(n) AS top FROM term_counts GROUP BY doc_id)
    SELECT doc_id, round(top / terms, 6) AS repetition FROM totals
    WHERE top / terms > (SELECT quantile_cont(top / terms, 0.95) FROM totals)"""
)
def repetitive_documents(spark, folder):
    """The flagship: clean, tokenise, count, score, and cut at the exact 95th percentile."""
    counts = features.term_counts(document_tokens(spark, folder), "doc_id", "tokens")
    scored = counts.groupBy("doc_id").agg((F.max("n") / F.sum("n")).alias("repetition"))
    flagged = flag_above_quantile(materialize(scored, "repetition"), "repetition").filter("is_anomaly")
    return flagged.select("doc_id", r6(F.col("repetition")).alias("repetition"))
