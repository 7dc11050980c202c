"""One query per operator over the whole ``documents`` table, with SQL where SQL can express it."""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evcat.llm import conversations, jaccard, language, licenses, mixing, ppm, quality, ranking, repeats, token_counts, token_ids, toxicity, winnow
from evcat.llm.folders import new_folder, read, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

WORD = "[^\\x20\\x09-\\x0D]+"


def remainder(by: int):
    """crc32 of the id as text, modulo ``by``; null for a null id."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(by))


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return register


@query()
def op2_token_ids(spark, sf_dir):
    """Ids written in ascending doc_id order and read back from the files."""
    folder = new_folder(spark, "ids")
    token_ids.write_token_ids(read(spark, sf_dir), folder, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_ids.read_token_ids(spark, folder)


@query()
def op4_token_counts(spark, sf_dir):
    counted = read(spark, sf_dir).select("doc_id", token_counts.count_tokens(F.col("text"), public_tokenizers.path("byte_bpe_50k.json")).alias("c"))
    return counted.select("doc_id", "c.n_words", "c.n_tokens")


@query(
    f"""WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS size FROM documents),
    s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1.0::DOUBLE AS w FROM d GROUP BY source),
    r AS (SELECT *, source_size * 3 AS cap, coalesce(sum(source_size * 3) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
        sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS onward, sum(source_size) OVER () AS total
        FROM s WINDOW o AS (ORDER BY source_size * 3 / w, source NULLS LAST)),
    t AS (SELECT source, source_size, least(cap::DOUBLE, w * max((total - before)::DOUBLE / onward) OVER ()) AS target FROM r),
    u AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
        ('0x' || substr(md5('{mixing.SEED}:' || doc_id), 1, 13))::BIGINT::DOUBLE / 4503599627370496 AS draw FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
    SELECT doc_id, size, source_size, target, (size * (floor(rate)::BIGINT + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM u"""
)
def op5_mix(spark, sf_dir):
    docs = read(spark, sf_dir).select("doc_id", "text", "source")
    mixed = mixing.mix_sources(docs, F.regexp_count("text", F.lit(WORD)))
    return mixed.select("doc.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query()
def op6_quality(spark, sf_dir):
    judged = read(spark, sf_dir).select("doc_id", quality.quality(F.col("text")).alias("q"))
    return judged.select("doc_id", "q.*")


@query()
def op7_language(spark, sf_dir):
    docs = read(spark, sf_dir).select("doc_id", "text", "lang")
    held_out = F.coalesce(remainder(4) == 2, F.lit(False))
    dictionaries = language.learn(docs.filter(~held_out))
    named = docs.select("doc_id", held_out.alias("held_out"), language.identify(F.col("text"), dictionaries).alias("l"))
    return named.select("doc_id", "held_out", F.col("l.lang").alias("lang_pred"), "l.score", "l.rejected")


ALNUM = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    f"""WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all({_LOWERED}, '{ALNUM}') AS w FROM documents),
    b AS (SELECT item_id, regexp_extract_all({_LOWERED}, '{ALNUM}') AS w FROM benchmark),
    iw AS (SELECT DISTINCT item_id, least(len(w), 13) AS m, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS span
        FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM b WHERE len(w) > 0)),
    dw AS (SELECT doc_id, i, m, array_to_string(w[i : i + m - 1], ' ') AS span
        FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM iw) WHERE len(w) >= m)),
    h AS (SELECT DISTINCT doc_id, i, m, item_id FROM dw JOIN iw USING (m, span)),
    c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM h) GROUP BY doc_id),
    n AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
        FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
    SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
        coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)"""
)
def op10_decontaminate(spark, sf_dir):
    docs = read(spark, sf_dir).select("doc_id", "text")
    found = winnow.contamination(docs, read(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc.doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), digest.alias("items_sha256"), "contaminated")


@query(
    f"""WITH d AS MATERIALIZED (SELECT doc_id, coalesce(regexp_extract_all(text, '{WORD}'), []) AS w FROM documents),
    s AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS h FROM (SELECT *, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
    g AS (SELECT DISTINCT s.doc_id, unnest(range(i, i + 50)) AS p FROM s JOIN (SELECT h, min(doc_id) AS first FROM s GROUP BY h) f ON s.h = f.h AND f.first < s.doc_id),
    k AS (SELECT d.doc_id, u.p, d.w[u.p] AS word FROM d, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS p) u ANTI JOIN g ON g.doc_id = d.doc_id AND g.p = u.p),
    t AS (SELECT doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY p) AS kept FROM k GROUP BY doc_id)
    SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n_kept, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN t USING (doc_id)"""
)
def op1_repeats(spark, sf_dir):
    return repeats.remove_repeats(read(spark, sf_dir).select("doc_id", "text"))


@query(
    f"""WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, regexp_extract_all({_LOWERED}, '{WORD}') AS w FROM documents),
    s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g
        FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
    n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    l AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id JOIN n nx ON nx.doc_id = x.doc_id
        JOIN n ny ON ny.doc_id = y.doc_id GROUP BY x.doc_id, y.doc_id, nx.n, ny.n HAVING 100 * count(*) >= 75 * (nx.n + ny.n - count(*))),
    r AS (SELECT doc_id, doc_id AS reached FROM d UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.reached)
    SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(reached) AS component_id FROM d JOIN r USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY d.doc_id"""
)
def op8_jaccard(spark, sf_dir):
    return jaccard.similar_groups(read(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


@query()
def op3_lm_scores(spark, sf_dir):
    return ppm.lm_scores(read(spark, sf_dir).select("doc_id", "text"), remainder(7) == 2)


@query()
def op9_licenses(spark, sf_dir):
    found = read(spark, sf_dir).select("doc_id", licenses.scan(F.col("text")).alias("l"))
    return found.select("doc_id", *[F.col(f"l.{c}") for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")])


TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


@query(
    f"""WITH d AS MATERIALIZED (SELECT doc_id, regexp_extract_all({_LOWERED}, '{TERM}') AS w FROM documents),
    q AS (SELECT item_id, t, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all({_LOWERED}, '{TERM}')) AS t FROM benchmark) GROUP BY ALL),
    s AS (SELECT count(*) AS nd, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0),
    f AS MATERIALIZED (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
    k AS (SELECT t, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM f, s GROUP BY t, nd),
    v AS (SELECT doc_id, t, weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * nd) // l))) AS v FROM f JOIN k USING (t), s),
    r AS (SELECT item_id, doc_id, sum(times * v)::BIGINT AS score FROM q JOIN v USING (t) GROUP BY ALL HAVING sum(times * v) > 0)
    SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r) WHERE rank <= 10"""
)
def op12_ranked(spark, sf_dir):
    return ranking.ranked_search(read(spark, sf_dir).select("doc_id", "text"), read(spark, sf_dir, "benchmark"))


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with faults put in by a hash of id and turn: rows left out, emptied, without stops, repeated, or given to the user."""
    space = F.lit(" ")
    named = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")])
    fault = F.crc32(named.cast("binary")) % 20
    text, role = F.coalesce("text", space), F.coalesce("role", space)
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    given = rows.filter(fault != 0).select("conv_id", "turn", F.when(fault == 4, "user").otherwise(role).alias("role"), text.alias("text"), fault.alias("fault"))
    times = F.when(F.col("fault") == 3, 2).otherwise(1)
    return given.withColumn("copy", F.explode(F.sequence(F.lit(1), times))).drop("fault", "copy")


@query()
def op13_repair(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    faulty = damaged(rows)
    reports = written(conversations.repair_reports(faulty), "reports")
    hashed = conversations.repaired_digests(faulty, reports).withColumnRenamed("conv", "_conv")
    ids = rows.select("conv_id").distinct()
    found = reports.join(hashed, F.col("conv").eqNullSafe(F.col("_conv"))).drop("_conv")
    whole = ids.join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return whole.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


@query()
def op11_toxicity(spark, sf_dir):
    docs, labels = read(spark, sf_dir).select("doc_id", "text"), read(spark, sf_dir, "labels").select("doc_id", "toxic")
    held_out = F.coalesce(remainder(5) == 0, F.lit(False))
    model = toxicity.learn(docs, labels.filter(~held_out))
    scored = docs.select("doc_id", held_out.alias("held_out"), toxicity.toxicity(F.col("text"), model).alias("t"))
    return scored.select("doc_id", "held_out", "t.score", "t.predicted", F.size("t.spans").cast("bigint").alias("n_spans"))
