"""The queries over the driver's tables and, where SQL can say the same, their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack, pieces

    cut = pieces(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), spaced=True, end_id=2, capacity=1024, cache_words=1_600_000)
    return pack(cut, capacity=1024)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import language_id

    return language_id(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    mixed = mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, max_epochs=2.0)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import crc32, read_token_files, write_token_files

    manifest = write_token_files(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=1, spaced=False)
    return read_token_files(manifest, crc32, "ids_crc32 long")


def op3_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import deduplicated

    return deduplicated(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_gone")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)


#: Dated changes of three lists: list, kind, pattern, action, day.
LIST_CHANGES = [
    ("spam", "domain", "spam-farm.example.org", "block", "2024-01-10"),
    ("spam", "domain", "spam-farm.example.org", "remove", "2024-09-01"),
    ("spam", "domain", "spam-farm.example.org", "block", "2024-11-15"),
    ("spam", "domain", "cheap-pills.example.com", "block", "2024-02-15"),
    ("spam", "host", "www.cheap-pills.example.com", "allow", "2024-08-01"),
    ("spam", "domain", "free-bets.example.com", "block", "2024-05-01"),
    ("ads", "domain", "ads-track.example.org", "block", "2024-03-01"),
    ("ads", "host", "m.ads-track.example.org", "allow", "2024-03-20"),
    ("ads", "prefix", "tionsh.example.net/fr", "block", "2024-04-01"),
    ("ads", "prefix", "tionsh.example.net/fr", "remove", "2024-10-01"),
    ("ads", "domain", "example.net", "block", "2024-12-20"),
    ("editors", "domain", "tionsh.example.net", "allow", "2024-12-24"),
]


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages carry no time of their own: page p counts as fetched p mod 366 days into 2024."""
    from .url_filter import judge

    changes = spark.createDataFrame(LIST_CHANGES, "list string, kind string, pattern string, action string, day string")
    changes = changes.select("list", "kind", "pattern", "action", F.col("day").cast("date").alias("at"))
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(366)).cast("int"))
    captures = table(spark, sf_dir, "pages").select("page_id", "url", day.alias("fetched_at"))
    return judge(captures, changes)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tampering lower-cases A-Z of a third of the texts, by the crc32 of doc_id."""
    from .merkle import folded, leaf_of, manifest, siblings

    docs = table(spark, sf_dir, "documents")
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    struck = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    shown = F.when(struck, leaf_of([F.col(c) for c in ("doc_id", "source", "lang", "n_chars")] + [low]))
    rows = manifest(docs, carry={"shown": shown})
    rows = rows.withColumn("folded_root", folded(F.coalesce("shown", "leaf"), F.col("path")))
    proof = F.sha2(siblings(F.col("path")), 256).alias("proof_sha256")
    return rows.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof, "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import stored
    from .sharding import sharded

    text = F.coalesce("text", F.lit(""))
    narrow = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text).alias("text_crc32"))
    placed = sharded(stored(narrow, "rows"), ties=("size", "text_crc32"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where vec_id is divisible by 7 the label moves on by one, so that near rows of another label exist."""
    from .hard_negatives import hard_negatives

    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_exact_dedup,
        op2_best_fit_packing,
        op3_quality_resampling,
        op4_line_dedup,
        op5_language_id,
        op6_mixing,
        op7_near_dedup,
        op8_nearest_vectors,
        op9_token_files,
        op10_url_filter,
        op11_merkle_manifest,
        op12_feistel_shards,
        op13_hard_negatives,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": """
        WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
        g AS (SELECT x, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY x)
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(x) AS text_sha256 FROM d JOIN g USING (x)""",
    "op6_mixing": r"""
        WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                          md5('7:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS k FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w
              FROM d GROUP BY source),
        o AS (SELECT *, 2.0::DOUBLE * source_size AS cap, coalesce(sum(2.0::DOUBLE * source_size) OVER before, 0) AS held, sum(w) OVER after AS free,
                     1.5::DOUBLE * sum(source_size) OVER () AS budget, row_number() OVER before AS k
              FROM s WHERE source_size > 0
              WINDOW before AS (ORDER BY 2.0::DOUBLE * source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                     after AS (ORDER BY 2.0::DOUBLE * source_size / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
        level AS (SELECT arg_min((budget - held) / free, k) FILTER ((budget - held) / free * w < cap) AS x FROM o),
        t AS (SELECT s.source, s.source_size, CASE WHEN s.source_size > 0 THEN least(2.0::DOUBLE * s.source_size, s.w * coalesce(level.x, 'inf'::DOUBLE)) ELSE 0.0 END AS target
              FROM s, level),
        p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
        r AS (SELECT d.doc_id, d.size, p.source_size, p.target, p.whole, round(p.target)::BIGINT - p.whole * p.source_size AS rest,
                     coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto
              FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
        SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(size, rest - upto)))::BIGINT AS taken FROM r""",
}

ORACLE_SQL["op10_url_filter"] = (
    "WITH c(list, kind, pattern, action, day) AS (VALUES "
    + ", ".join(str(x) for x in LIST_CHANGES)
    + r"""),
        i AS (SELECT list, kind, pattern, action, day::DATE AS a, lead(day::DATE) OVER (PARTITION BY list, kind, pattern ORDER BY day::DATE) AS b FROM c),
        p AS (SELECT page_id, url, ('2024-01-01'::DATE + (page_id % 366)::INT) AS fetched_at,
                     regexp_extract(lower(url), '^[a-z]+://([^/?#:]+)', 1) AS host,
                     regexp_extract(lower(url), '^[a-z]+://([^?#]+)', 1) || '/' AS whole FROM pages),
        m AS (SELECT p.page_id, i.list, i.kind, i.pattern, i.action
              FROM p JOIN i ON i.action <> 'remove' AND p.fetched_at >= i.a AND (i.b IS NULL OR p.fetched_at < i.b)
               AND CASE i.kind WHEN 'host' THEN p.host = i.pattern WHEN 'domain' THEN p.host = i.pattern OR ends_with(p.host, '.' || i.pattern)
                   ELSE starts_with(p.whole, i.pattern || '/') END),
        r AS (SELECT *, count(*) OVER (PARTITION BY page_id) AS n, row_number() OVER (PARTITION BY page_id ORDER BY
                     CASE kind WHEN 'prefix' THEN 3 WHEN 'host' THEN 2 ELSE 1 END DESC, length(pattern) DESC, action = 'allow' DESC, list DESC) AS k FROM m)
        SELECT p.page_id, p.url, p.fetched_at, coalesce(r.action, 'none') AS decision, r.list, r.kind, r.pattern, coalesce(r.n, 0) AS n_active
        FROM p LEFT JOIN r ON r.page_id = p.page_id AND r.k = 1"""
)


def crc32_step(c: str, b: str) -> str:
    """SQL: the crc32 state after a byte. The table of 256 states is the xor of those of its bits."""
    x = f"xor({c}, {b})"
    terms = []
    for bit in range(8):
        k = 1 << bit
        for _ in range(8):
            k = (k >> 1) ^ (0xEDB88320 if k & 1 else 0)
        terms.append(f"(({x} >> {bit}) & 1) * {k}")
    out = f"({c} >> 8)"
    for t in terms:
        out = f"xor({out}, {t})"
    return out


def crc32_sql(text: str) -> str:
    """SQL: the unsigned crc32 of a text's UTF-8 bytes."""
    listed = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)"
    return f"xor(list_reduce({listed}, lambda c, b: {crc32_step('c', 'b')}, 4294967295::BIGINT), 4294967295::BIGINT)"


def tree_sql(name: str, source: str) -> str:
    """SQL: the levels of runs of eight over source (g, i, node, n)."""
    return f"""{name}(level, g, i, node, n) AS (
            SELECT 0, g, i, node, n FROM {source}
            UNION ALL
            SELECT level + 1, g, i // 8, sha256(string_agg(node, '' ORDER BY i)), (any_value(n) + 7) // 8 FROM {name} WHERE n > 1 GROUP BY level, g, i // 8)"""


def field_sql(c: str) -> str:
    return f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"


_low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_head = " || ".join(field_sql(c) for c in ("doc_id", "source", "lang", "n_chars"))

ORACLE_SQL["op11_merkle_manifest"] = f"""
        WITH RECURSIVE d AS (SELECT doc_id, lang, sha256({_head} || {field_sql('text')}) AS leaf,
                   CASE WHEN {crc32_sql('doc_id::VARCHAR')} % 3 = 0 THEN sha256({_head} || {field_sql(_low)}) END AS shown FROM documents),
        b AS (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
                     count(*) OVER (PARTITION BY lang) AS n FROM d),
        b0 AS (SELECT g, i, leaf AS node, n FROM b),
        {tree_sql('low', 'b0')},
        subs AS (SELECT 0::BIGINT AS g, g AS i, node, count(*) OVER () AS n FROM low WHERE n = 1),
        {tree_sql('up', 'subs')},
        tops AS (SELECT node AS root FROM up WHERE n = 1),
        steps AS (SELECT 0 AS tree, * FROM low WHERE n > 1 UNION ALL SELECT 1, * FROM up WHERE n > 1),
        sides AS (SELECT tree, level, g, i, coalesce(string_agg(node, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
                         coalesce(string_agg(node, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
                  FROM steps WINDOW w AS (PARTITION BY tree, level, g, i // 8 ORDER BY i)),
        path AS (SELECT b.g AS bg, b.i AS bi, list({{'before': s.before, 'after': s.after}} ORDER BY s.tree, s.level) AS steps
                 FROM b JOIN sides s ON (s.tree = 0 AND s.g = b.g AND s.i = b.i // (8::BIGINT ** s.level)::BIGINT) OR (s.tree = 1 AND s.i = b.g // (8::BIGINT ** s.level)::BIGINT)
                 GROUP BY b.g, b.i),
        folds(bg, bi, k, node, steps) AS (
            SELECT b.g, b.i, 1, coalesce(b.shown, b.leaf), coalesce(p.steps, []) FROM b LEFT JOIN path p ON p.bg = b.g AND p.bi = b.i
            UNION ALL
            SELECT bg, bi, k + 1, sha256(steps[k].before || node || steps[k].after), steps FROM folds WHERE k <= len(steps))
        SELECT b.doc_id, b.leaf, subs.node AS subroot, tops.root, sha256(array_to_string(list_transform(f.steps, lambda s: s.before || s.after), '')) AS proof_sha256,
               f.node AS folded_root, f.node = tops.root AS verified
        FROM b JOIN folds f ON f.bg = b.g AND f.bi = b.i AND f.k > len(f.steps) JOIN subs ON subs.i = b.g CROSS JOIN tops"""


def feistel_sql(x: str, source: str) -> str:
    """SQL: row, n, h and x permuted once; h is half the width."""
    from .sharding import FIRST, LOW, SECOND, SEED, round_keys

    sql = f"(SELECT rn, n, h, {x} >> h AS a, {x} & ((1::BIGINT << h) - 1) AS b FROM {source})"
    for key in round_keys(SEED):
        mixed = f"((xor(b, {key}) * {FIRST}))"
        mixed = f"((xor({mixed}, {mixed} >> 29) & {LOW}) * {SECOND})"
        sql = f"(SELECT rn, n, h, b AS a, xor(a, xor({mixed}, {mixed} >> 32) & ((1::BIGINT << h) - 1)) AS b FROM {sql})"
    return f"SELECT rn, n, h, (a << h) | b AS x FROM {sql}"


ORACLE_SQL["op12_feistel_shards"] = f"""
        WITH RECURSIVE d AS (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT + 8 AS size, {crc32_sql("coalesce(text, '')")} AS text_crc32 FROM documents),
        r AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST) - 1 AS rn, count(*) OVER () AS n FROM d),
        z AS (SELECT rn, n, greatest(1, (length(bin(greatest(n - 1, 1))) + 1) // 2) AS h FROM r),
        w(rn, n, h, x) AS ({feistel_sql('rn', 'z')} UNION ALL {feistel_sql('x', '(SELECT * FROM w WHERE x >= n)')})
        SELECT doc_id, size, text_crc32, 'rows' AS law, (x % 24)::INT AS shard, x // 24 AS slot, NULL::INT AS grown_shard, r.rn AS row_number
        FROM r JOIN w ON r.rn = w.rn AND w.x < w.n"""

ORACLE_SQL["op13_hard_negatives"] = """
        WITH e AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                          list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
                   FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.r AS ar, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
              FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.r <> b.r),
        p AS (SELECT *, row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id) AS pk FROM s WHERE same QUALIFY pk <= 5)
        SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.ar, p.pk ORDER BY n.score DESC, n.vec_id)::INT AS rank, n.vec_id AS negative_id,
               p.score AS positive_score, n.score AS negative_score
        FROM p JOIN s n ON n.ar = p.ar AND NOT n.same AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
        QUALIFY rank <= 5"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
