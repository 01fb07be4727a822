"""The registered queries of this subpackage, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, embdedup, langid, licenses, neardup, packing, pii, quality, resample, runs, shards, urlfilter
from .common import id_crc, table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.sharded(table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    return chat.digest(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own))


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = pii.key_of(spark, pii.PUBLIC_KEY)
    return pii.replace_entities(table(spark, sf_dir, "documents"), key, "n_entities").select("doc_id", "text", "n_entities")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(table(spark, sf_dir, "documents"))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embdedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: host, path, verdict
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judged(table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "host string, path string, verdict string"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "item_id")


def repeating(docs: DataFrame) -> DataFrame:
    """doc_id and text, with a periodic end in the texts that the hash of their id chooses: g chooses its begin, period and number of periods."""
    h = id_crc()
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), 0)
    some = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("w"), F.floor(h / 10).alias("g")).withColumn("n", F.nullif(F.size("w"), F.lit(0)))  # without words: null, as nothing is divided by it
    some = some.withColumn("a", (F.col("g") % F.col("n")).cast("int")).withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    end = F.slice(F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int"))), F.lit(1), F.col("n") - F.col("a"))
    text = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), end), " ")
    return some.select("doc_id", F.when(F.col("n") > 0, text).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.collapsed(repeating(table(spark, sf_dir, "documents")))
    stronger = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]
    best = F.reduce("runs", F.get("runs", F.lit(0)), lambda x, y: F.when(stronger(y, x), y).otherwise(x))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"))
    exponent = F.floor(1000 * F.col("b.length") / F.col("b.period"))
    return out.select("doc_id", "n_runs", "b.start", "b.length", "b.period", exponent.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_language_id": op3_language_id,
    "op4_embedding_near_dedup": op4_embedding_near_dedup,
    "op5_license_scan": op5_license_scan,
    "op6_decontamination": op6_decontamination,
    "op7_sharding": op7_sharding,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_chat_format": op9_chat_format,
    "op10_pii_surrogates": op10_pii_surrogates,
    "op11_url_filter": op11_url_filter,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_periodic_runs": op13_periodic_runs,
}

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_WORDS = r"list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
_CHAT = chat.Template()
_HEADS = "|".join([chat.MARK, *("".join(x if x.isalnum() else "\\" + x for x in c) for c in _CHAT.controls())])
_AROUND = "CASE role " + " ".join(f"WHEN '{r}' THEN {len(b) + len(_CHAT.after[r])}" for r, b in _CHAT.before.items())

#: CRC-32 by its table: `crc(x)` is the checksum of a list of bytes.
_CRC_TABLE = "crcs AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS ct)"


def _crc(data: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295, {data}), lambda c, b: xor(ct[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)"


def _sql_bytes(text: str) -> str:
    return f"list_transform(range(1, 2 * strlen({text}), 2), lambda i: CAST(16 * (strpos('0123456789ABCDEF', substr(hex({text}), i, 1)) - 1) + strpos('0123456789ABCDEF', substr(hex({text}), i + 1, 1)) - 1 AS BIGINT))"


_GRAMS = r"""(
            SELECT doc_id, w, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) || list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS f
            FROM (SELECT %s AS doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM %s)
        )"""

SQL: dict[str, str] = {
    "op11_url_filter": r"""
        WITH rules(h, p, v) AS (
            VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
        ), u AS (
            SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages
        ), best AS (
            SELECT host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v
            FROM (SELECT DISTINCT host, path FROM u) JOIN rules ON (host = h OR host LIKE '%.' || h) AND starts_with(path, p) GROUP BY host, path
        )
        SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM u LEFT JOIN best USING (host, path)
    """,
    "op13_periodic_runs": rf"""
        WITH {_CRC_TABLE}, d AS (
            SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w, {_crc("list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))")} AS h FROM documents, crcs
        ), a AS (
            SELECT *, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d
        ), p AS (
            SELECT *, 1 + (len(w) - a) // (3 + (h // 10) % 8) AS p FROM a
        ), docs AS (
            SELECT doc_id, CASE WHEN a IS NULL THEN w ELSE list_transform(range(len(w)), lambda i: w[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END]) END AS w FROM p
        ), words AS (
            SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i, len(w) AS n FROM docs
        ), same AS (
            SELECT x.doc_id, y.i - x.i AS period, x.i, x.i - row_number() OVER (PARTITION BY x.doc_id, y.i - x.i ORDER BY x.i) AS island
            FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
        ), stretches AS (
            SELECT doc_id, period, min(i) AS start, count(*) + period AS length FROM same GROUP BY doc_id, period, island HAVING count(*) + period >= greatest(6, 4 * period)
        ), runs AS (
            SELECT doc_id, start, length, min(period) AS period FROM stretches GROUP BY doc_id, start, length
        ), listed AS (
            SELECT doc_id, count(*) AS n, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY doc_id
        ), best AS (
            SELECT doc_id, start, length, period FROM runs WINDOW ranks AS (PARTITION BY doc_id ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) QUALIFY row_number() OVER ranks = 1
        ), dropped AS (
            SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs
        ), kept AS (
            SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id
        )
        SELECT doc_id, coalesce(n, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
        FROM docs LEFT JOIN listed USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
    """,
    "op12_importance_resampling": rf"""
        WITH {_CRC_TABLE}, own AS {_GRAMS % ("doc_id", "documents")}, target AS {_GRAMS % ("item_id", "benchmark")}, known AS (
            SELECT f, {_crc(_sql_bytes("f"))} % 10000 AS b FROM (SELECT DISTINCT f FROM own UNION SELECT DISTINCT f FROM target), crcs
        ), s AS (
            SELECT b, count(*) AS s FROM own JOIN known USING (f) GROUP BY b
        ), t AS (
            SELECT b, count(*) AS t FROM target JOIN known USING (f) GROUP BY b
        ), gains AS (
            SELECT b, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * ((SELECT sum(s) FROM s)::DOUBLE + 10000) / ((coalesce(s, 0) + 1.0::DOUBLE) * (coalesce((SELECT sum(t) FROM t), 0)::DOUBLE + 10000)))) AS BIGINT) AS gain FROM s FULL JOIN t USING (b)
        ), weights AS (
            SELECT doc_id, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM own JOIN known USING (f) JOIN gains USING (b) GROUP BY doc_id
        ), scored AS (
            SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, CAST('0x' || substr(sha256('42:' || doc_id), 1, 8) AS BIGINT) AS h FROM documents LEFT JOIN weights USING (doc_id)
        ), noisy AS (
            SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM scored
        ), ranks AS (
            SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM noisy WHERE n_features >= 57
        )
        SELECT doc_id, n_features, weight, score, CASE WHEN r <= 5 * n // 100 THEN r END AS rank FROM noisy LEFT JOIN ranks USING (doc_id)
    """,
    "op6_decontamination": f"""
        WITH d AS (
            SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM (SELECT doc_id, {_WORDS} AS w FROM documents)
        ), items AS (
            SELECT min(item_id) AS item_id, w FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) >= 8 GROUP BY w
        ), i AS (
            SELECT item_id, len(w) AS n, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM items
        ), same AS (
            SELECT doc_id, item_id, n, d.p - i.p AS shift, i.p AS p FROM d JOIN i USING (word)
        ), enough AS (
            SELECT doc_id, item_id, shift FROM same GROUP BY doc_id, item_id, shift, n HAVING count(*) >= ceil(least(n, 13) * 0.8)
        ), windows AS (
            SELECT *, count(*) OVER (PARTITION BY doc_id, item_id, shift ORDER BY p RANGE BETWEEN 12 PRECEDING AND CURRENT ROW) AS c
            FROM same SEMI JOIN enough USING (doc_id, item_id, shift)
        ), best AS (
            SELECT doc_id, item_id, shift, CAST(ceil(least(n, 13) * 0.8) AS INT) AS needed, max(c) AS matched FROM windows GROUP BY doc_id, item_id, shift, n
        )
        SELECT doc_id, item_id, CAST(shift AS INT) AS at, CAST(matched AS INT) AS matched, needed FROM best WHERE matched >= needed
        QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matched DESC, shift) = 1
    """,
    "op9_chat_format": f"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
        )
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            CAST(sum(length(text) + len(regexp_extract_all(text, '{_HEADS}')) + {_AROUND} ELSE {len(_CHAT.other_before) - 6 + len(_CHAT.other_after)} + length(role) + len(regexp_extract_all(role, '{_HEADS}|\\]')) END) AS BIGINT) AS formatted_chars
        FROM t GROUP BY conv_id
    """,
    "op4_embedding_near_dedup": """
        WITH RECURSIVE usable AS (
            SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
            WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda v: v IS NULL OR isnan(v) OR isinf(v))) = 0
                AND len(list_filter(embedding, lambda v: v <> 0)) > 0
        ), links AS (
            SELECT x.vec_id AS a, y.vec_id AS b FROM usable x JOIN usable y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
            WHERE list_cosine_similarity(x.e, y.e) >= 0.93
        ), reach(vec_id, node) AS (
            SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON reach.node = links.a
        ), tops AS (
            SELECT vec_id, min(node) AS component_id FROM reach GROUP BY vec_id
        ), counts AS (
            SELECT a, count(*) AS n FROM links GROUP BY a
        )
        SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
        FROM embeddings JOIN tops USING (vec_id) LEFT JOIN counts ON a = vec_id
    """,
    "op2_minhash_near_dedup": rf"""
        WITH RECURSIVE words AS (
            SELECT doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
        ), sets AS (
            SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM words
        ), items AS (
            SELECT doc_id, len(g) AS n, unnest(g) AS h FROM sets
        ), links AS (
            SELECT x.doc_id AS a, y.doc_id AS b FROM items x JOIN items y ON x.h = y.h AND x.doc_id <> y.doc_id
            GROUP BY x.doc_id, y.doc_id HAVING 100 * count(*) >= 75 * (max(x.n) + max(y.n) - count(*))
        ), reach(doc_id, node) AS (
            SELECT doc_id, doc_id FROM sets UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.node = links.a
        ), tops AS (
            SELECT doc_id, min(node) AS component_id FROM reach GROUP BY doc_id
        )
        SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN tops USING (doc_id)
    """,
}
