"""Queries over the driver's tables, one per operator, and SQL twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    language_id,
    order_minhash,
    packing,
    resampling,
    sharding,
    substring_dedup,
    suffix_dedup,
    syncmers,
    toxicity,
    url_filters,
    vector_codes,
    wavelet,
    winnowing,
)
from .tables import let_workers_import, materialize, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(name: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            let_workers_import(spark)
            return build(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


@query("op1_best_fit_packing")
def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), tokenizer_path(), 2048, 0)


@query("op8_wavelet_token_files")
def wavelet_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = wavelet.shard_folder(spark)
    written = materialize(wavelet.write_shards(read(spark, sf_dir, "documents"), tokenizer_path(), folder, end_id=2))
    return wavelet.read_shards(spark, folder, written)


#: 13-word windows of items against documents; DuckDB has no shared word hash, so strings are joined.
WINNOWING_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
item_windows AS (
  SELECT item, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM (
    SELECT item, w, least(len(w), 13) AS n, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM (
    SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, d.n, i, item FROM doc_windows d JOIN item_windows USING (n, s)),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM words LEFT JOIN places USING (doc_id) LEFT JOIN found USING (doc_id)
"""


@query("op9_winnowing_decontamination", WINNOWING_SQL)
def winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnowing.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), window=13, k=7)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


#: Word windows of 50, each with the least document it starts in.
SUBSTRING_SQL = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, i, md5_number(array_to_string(w[i:i + 49], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM words WHERE len(w) >= 50)),
firsts AS (SELECT h, min(doc_id) AS first FROM windows GROUP BY h HAVING min(doc_id) < max(doc_id)),
gone AS (
  SELECT doc_id, list(DISTINCT p) AS places FROM (
    SELECT doc_id, unnest(range(i, i + 50)) AS p FROM windows JOIN firsts USING (h) WHERE first < doc_id) GROUP BY doc_id),
kept AS (
  SELECT doc_id, coalesce(len(places), 0) AS n_removed, CAST(len(w) AS BIGINT) AS n_words,
         CASE WHEN places IS NULL THEN w
              ELSE list_select(w, list_filter(range(1, len(w) + 1), lambda x: NOT list_contains(places, x))) END AS w
  FROM words LEFT JOIN gone USING (doc_id))
SELECT doc_id, n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(coalesce(array_to_string(w, ' '), '')) AS kept_sha256 FROM kept
"""


@query("op4_countmin_substring_dedup", SUBSTRING_SQL)
def countmin_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.without_repeats(read(spark, sf_dir, "documents"), window=50, text=False)


@query("op2_suffix_array_dedup")
def suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(read(spark, sf_dir, "documents"), length=200, keep="none", body=False)


@query("op6_order_minhash")
def order_minhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = order_minhash.near_duplicates(read(spark, sf_dir, "documents"), similarity=0.8, size=5)
    return found.select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))


@query("op5_language_id")
def language_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_id.identify(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "held_out", "lang_pred", "score")


@query("op10_label_propagation_sharding")
def label_propagation_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(sharding.sized(read(spark, sf_dir, "documents")), shards=40, law="rows")


@query("op3_syncmer_fingerprints")
def syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.compare_with_edits(read(spark, sf_dir, "documents"))


def _number(text: str) -> str:
    """SQL for a number fixed by a text: the first 32 bits of its MD5."""
    return f"cast(conv(substring(md5({text}), 1, 8), 16, 10) as bigint)"


def dated_entries(pages: DataFrame) -> DataFrame:
    """Lists with a history for the hosts, domains and paths that ``pages`` has.

    Entries are added, removed and added again on days of 2024 fixed by a hash of the value.
    """
    host = url_filters.host_of(F.col("url"))
    first = F.concat(host, F.lit("/"), F.regexp_extract("url", r"^[^/]*//[^/?#]*/([^/?#]+)", 1))
    values = (
        pages.select(F.lit("host").alias("kind"), host.alias("value"))
        .unionByName(pages.select(F.lit("domain").alias("kind"), F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1).alias("value")))
        .unionByName(pages.filter(first.rlike("/.")).select(F.lit("prefix").alias("kind"), first.alias("value")))
        .filter("value is not null and value <> ''")
        .distinct()
        .withColumn("n", F.expr(_number("concat(kind, ':', value)")))
    )
    added = F.expr("date_add(date'2024-01-01', cast(n % 300 as int))")
    removed = F.date_add(added, (F.lit(20) + F.expr("n div 300") % 60).cast("int"))
    block = values.filter("n % 3 <> 0").withColumn("list", F.concat(F.lit("block-"), "kind"))
    allow = values.filter("kind = 'host' and n % 11 = 3").withColumn("list", F.lit("allow"))
    both = block.unionByName(allow)
    key = ["list", "kind", "value"]
    return (
        both.select(*key, F.lit("add").alias("action"), added.alias("day"))
        .unionByName(both.filter("n % 4 < 3").select(*key, F.lit("remove").alias("action"), removed.alias("day")))
        .unionByName(both.filter("n % 4 = 1").select(*key, F.lit("add").alias("action"), F.date_add(removed, 15).alias("day")))
    )


#: The same entries and captures, judged by a plain range join.
URL_SQL = r"""
WITH captures AS (
  SELECT page_id, url, nullif(rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '.'), '') AS host,
         DATE '2024-01-01' + CAST(CAST('0x' || substring(md5(CAST(page_id AS VARCHAR) || ':' || url), 1, 8) AS BIGINT) % 366 AS INTEGER) AS day,
         list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), '/'), lambda x: x <> '') AS parts
  FROM pages),
kinds AS (
  SELECT 'host' AS kind, host AS value FROM captures UNION
  SELECT 'domain', regexp_extract(host, '([^.]+\.[^.]+)$', 1) FROM captures UNION
  SELECT 'prefix', host || '/' || regexp_extract(url, '^[^/]*//[^/?#]*/([^/?#]+)', 1) FROM captures
  WHERE regexp_extract(url, '^[^/]*//[^/?#]*/([^/?#]+)', 1) <> ''),
numbered AS (
  SELECT kind, value, CAST('0x' || substring(md5(kind || ':' || value), 1, 8) AS BIGINT) AS n
  FROM kinds WHERE value IS NOT NULL AND value <> ''),
listed AS (
  SELECT 'block-' || kind AS list, * FROM numbered WHERE n % 3 <> 0 UNION ALL
  SELECT 'allow', * FROM numbered WHERE kind = 'host' AND n % 11 = 3),
dated AS (
  SELECT *, DATE '2024-01-01' + CAST(n % 300 AS INTEGER) AS added,
         DATE '2024-01-01' + CAST(n % 300 + 20 + (n // 300) % 60 AS INTEGER) AS removed FROM listed),
spans AS (
  SELECT list, kind, value, added AS f, CASE WHEN n % 4 < 3 THEN removed END AS t FROM dated UNION ALL
  SELECT list, kind, value, removed + 15, NULL FROM dated WHERE n % 4 = 1),
keys AS (
  SELECT page_id, day, 'host' AS kind, host AS value FROM captures WHERE host IS NOT NULL UNION ALL
  SELECT page_id, day, 'domain', array_to_string(labels[i:], '.') FROM (
    SELECT page_id, day, string_split(host, '.') AS labels, unnest(range(1, len(string_split(host, '.')) + 1)) AS i FROM captures WHERE host IS NOT NULL) UNION ALL
  SELECT page_id, day, 'prefix', host || '/' || array_to_string(parts[:i], '/') FROM (
    SELECT page_id, day, host, parts, unnest(range(1, len(parts) + 1)) AS i FROM captures WHERE host IS NOT NULL)),
hits AS (
  SELECT page_id, string_agg(DISTINCT list, ',' ORDER BY list) AS active
  FROM keys JOIN spans USING (kind, value) WHERE day >= f AND (t IS NULL OR day < t) GROUP BY page_id)
SELECT page_id, host, strftime(day, '%Y-%m-%d') AS fetched, coalesce(active, '') AS active,
       coalesce(active, '') <> '' AND NOT contains(coalesce(active, ''), 'allow') AS blocked
FROM captures LEFT JOIN hits USING (page_id)
"""


@query("op7_temporal_url_filters", URL_SQL)
def temporal_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    fetched = F.expr(f"date_add(date'2024-01-01', cast({_number("concat(page_id, ':', url)")} % 366 as int))")
    found = url_filters.judge(pages.withColumn("day", fetched), dated_entries(pages))
    return found.select(
        "page_id",
        "host",
        F.date_format("day", "yyyy-MM-dd").alias("fetched"),
        F.array_join("active", ",").alias("active"),
        "blocked",
    )


def vector_codes_sql(width: int = 16, parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Lloyd rounds over all pairs of parts and entries, one pair of WITH tables a round."""
    places = range(width)
    columns = ", ".join(f"v[{width} * part + {i + 1}] AS c{i}" for i in places)
    names = ", ".join(f"c{i}" for i in places)
    distance = " + ".join(f"(p.c{i} - b.c{i}) * (p.c{i} - b.c{i})" for i in places)
    mean = ", ".join(f"coalesce((s{i} - ((s{i} % n) + n) % n) // n, b.c{i}) AS c{i}" for i in places)
    steps = [
        f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pieces AS MATERIALIZED (SELECT vec_id, label, part, {columns} FROM kept, (SELECT unnest(range({parts})) AS part)),
book0 AS MATERIALIZED (
  SELECT part, entry, {names} FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry FROM pieces) WHERE entry < {entries})"""
    ]
    for n in range(rounds + 1):
        steps.append(
            f"""owner{n} AS MATERIALIZED (
  SELECT vec_id, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d
  FROM (SELECT vec_id, part, entry, {distance} AS d FROM pieces p JOIN book{n} b USING (part)) GROUP BY vec_id, part)"""
        )
        if n < rounds:
            totals = ", ".join(f"CAST(sum(c{i}) AS BIGINT) AS s{i}" for i in places)
            steps.append(
                f"""book{n + 1} AS MATERIALIZED (
  SELECT part, entry, {mean} FROM book{n} b LEFT JOIN (
    SELECT part, entry, count(*) AS n, {totals} FROM pieces JOIN owner{n} USING (vec_id, part) GROUP BY part, entry) USING (part, entry))"""
            )
    entry_text = " || ',' || ".join(f"CAST(c{i} AS VARCHAR)" for i in places)
    steps.append(
        f"""codes AS (
  SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM owner{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg({entry_text}, ',' ORDER BY part, entry)) FROM book{rounds}) AS codebooks_sha256
FROM codes JOIN kept USING (vec_id)"""
    )
    return ",\n".join(steps)


@query("op11_dual_tree_codes", vector_codes_sql())
def dual_tree_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = vector_codes.compress(read(spark, sf_dir, "embeddings"), parts=4, entries=256, rounds=4, scale=1024)
    digest = F.lit(vector_codes.books_sha256(books))
    return codes.select("vec_id", "code", "error", "label_error", digest.alias("codebooks_sha256"))


@query("op12_levenshtein_toxicity")
def levenshtein_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), at=0.7)


#: CRC-32 byte by byte over the distinct words; scores, cut and ranks by one sort.
RESAMPLING_SQL = r"""
WITH step AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, CAST(range(8) AS BIGINT[])),
           lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(CAST(range(256) AS BIGINT[])) AS i))),
texts AS (
  SELECT 'd' AS side, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents UNION ALL
  SELECT 'b', NULL, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
words AS MATERIALIZED (SELECT side, doc_id, word, count(*) AS n FROM (SELECT side, doc_id, unnest(w) AS word FROM texts) GROUP BY ALL),
buckets AS MATERIALIZED (
  SELECT word, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
           list_transform(range(len(hex(encode(word))) // 2), lambda i: CAST('0x' || substr(hex(encode(word)), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))),
           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), CAST(4294967295 AS BIGINT)) % 10000 AS bucket
  FROM (SELECT DISTINCT word FROM words), step),
counts AS (
  SELECT bucket, coalesce(sum(n) FILTER (side = 'd'), 0) AS s, coalesce(sum(n) FILTER (side = 'b'), 0) AS t
  FROM words JOIN buckets USING (word) GROUP BY bucket),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * CAST((SELECT sum(s) FROM counts) + 10000 AS DOUBLE)
         / (CAST(s + 1 AS DOUBLE) * CAST((SELECT sum(t) FROM counts) + 10000 AS DOUBLE)))) AS BIGINT) AS gain FROM counts),
weights AS (
  SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS total
  FROM words JOIN buckets USING (word) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY doc_id),
scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features,
         coalesce((total - ((total % n_features) + n_features) % n_features) // n_features, 0) AS weight,
         CAST('0x' || substr(sha256('2024:' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) AS h
  FROM documents LEFT JOIN weights USING (doc_id)),
noisy AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score FROM scored),
ranks AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS able FROM noisy WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * able // 100 THEN place END AS rank FROM noisy LEFT JOIN ranks USING (doc_id)
"""


@query("op13_bisection_resampling", RESAMPLING_SQL)
def bisection_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resampling.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), percent=10, least_words=20)
    return found.select("doc_id", "n_features", "weight", "score", "rank")
