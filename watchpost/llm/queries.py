"""The queries of this package over the given tables, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from watchpost.llm import (
    bestfit, decontaminate, licenses, lines, merkle, minhash, negatives, phrases, quality, simhash, substrings,
    tokenfile, tokens, warc,
)
from watchpost.llm.base import scratch, ship, table

#: Vocabulary files of the contracts, and the ids they append.
BYTE_VOCABULARY, BYTE_END = tokens.public("byte_bpe_50k.json"), 2
WORD_VOCABULARY, WORD_END = tokens.public("word_bpe_49k.json"), 0


def _joined(column: str) -> Column:
    return F.array_join(F.array_sort(F.transform(column, lambda x: x.cast("string"))), ",")


def _places(column: str) -> Column:
    """Blocks as text: section.paragraph.block, one after another."""
    return F.array_join(F.transform(column, lambda x: F.concat_ws(".", x["section"], x["paragraph"], x["block"])), ",")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.drop_boilerplate(table(spark, sf_dir, "documents"))
    return kept.select(
        "doc_id", "source", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(_joined("item_ids"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
        "longest_match",
    )


def op4_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicate(table(spark, sf_dir, "documents")).drop("kept")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    return warc.fields(warc.read(spark, path)).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tokens")
    tokenfile.write(table(spark, sf_dir, "documents"), path, BYTE_VOCABULARY, BYTE_END)
    return tokenfile.documents(tokenfile.read(spark, path)).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score",
    )


def op9_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merkle.compared(table(spark, sf_dir, "documents"))
    return found.drop("edited_sections", "edited_blocks", "new_blocks")


def op9_merkle_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merkle.compared(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "fingerprint", "edited_fingerprint", _places("edited_blocks").alias("edited_blocks"),
        _places("new_blocks").alias("new_blocks"),
    )


def op10_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = bestfit.pack_documents(table(spark, sf_dir, "documents"), WORD_VOCABULARY, WORD_END)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(vectors.withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def _shipped(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return fn(spark, sf_dir)

    run.__name__ = fn.__name__
    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    fn.__name__: _shipped(fn)
    for fn in (
        op1_simhash, op2_line_dedup, op3_decontaminate, op4_suffix_array, op5_warc, op6_quality, op7_token_file,
        op8_licenses, op9_merkle, op9_merkle_edits, op10_best_fit, op11_collocations, op12_hard_negatives,
        op13_minhash, pipeline,
    )
}

_BARE = "trim(x, chr(32) || chr(9) || chr(13))"


def _sql_blocks(p: str) -> str:
    """DuckDB: the blocks of a paragraph of the Merkle tree."""
    return f"CASE WHEN {p} = '' THEN [''] ELSE regexp_extract_all({p}, '(?s).{{1,{merkle.BLOCK}}}') END"


def _sql_root(text: str) -> str:
    block = f"list_transform({_sql_blocks('p')}, lambda b: sha256(b))"
    paragraph = f"list_transform(string_split(s, chr(10)), lambda p: sha256('p' || array_to_string({block}, '')))"
    section = f"sha256('s' || array_to_string({paragraph}, ''))"
    sections = f"list_transform(string_split({text}, chr(10) || chr(10)), lambda s: {section})"
    return f"sha256('d' || array_to_string({sections}, ''))"


def _sql_leaves(text: str) -> str:
    paragraphs = f"flatten(list_transform(string_split(s, chr(10)), lambda p: {_sql_blocks('p')}))"
    return f"list_distinct(flatten(list_transform(string_split({text}, chr(10) || chr(10)), lambda s: {paragraphs})))"


def _sql_likeness(a: str, b: str) -> str:
    return f"2.0::DOUBLE * len(list_intersect({a}, {b})) / (len({a}) + len({b}))"


ORACLE: dict[str, str] = {
    "op2_line_dedup": f"""
        WITH pages AS (SELECT DISTINCT source, text FROM documents WHERE text IS NOT NULL),
        total AS (SELECT source, count(*) AS pages FROM pages GROUP BY source),
        own AS (
            SELECT source, unnest(list_distinct(list_filter(
                list_transform(string_split(text, chr(10)), lambda x: {_BARE}), lambda x: x <> ''))) AS line
            FROM pages),
        often AS (
            SELECT o.source, list(o.line) AS lines FROM (
                SELECT source, line, count(*) AS n FROM own GROUP BY source, line) o
            JOIN total t ON o.source IS NOT DISTINCT FROM t.source
            WHERE o.n >= {lines.MIN_PAGES} AND o.n > {lines.MAX_RATIO}::DOUBLE * t.pages GROUP BY o.source),
        cut AS (
            SELECT d.doc_id, d.source, d.text, string_split(d.text, chr(10)) AS every,
                list_filter(string_split(d.text, chr(10)), lambda x:
                    {_BARE} = '' OR NOT list_contains(coalesce(o.lines, []), {_BARE})) AS kept
            FROM documents d LEFT JOIN often o ON d.source IS NOT DISTINCT FROM o.source)
        SELECT doc_id, source,
            coalesce(len(list_filter(every, lambda x: {_BARE} <> '')), 0)::BIGINT AS n_lines,
            coalesce(len(every) - len(kept), 0)::BIGINT AS n_dropped,
            sha256(coalesce(array_to_string(kept, chr(10)), '')) AS kept_sha256
        FROM cut""",
    "op3_decontaminate": r"""
        WITH d AS (
            SELECT doc_id, list_filter(regexp_split_to_array(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
        b AS (
            SELECT item_id, list_filter(regexp_split_to_array(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
        window_ AS (
            SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p:p + 9], ' ') AS g
            FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS p FROM b WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT n FROM window_),
        place AS (
            SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS g
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)),
        hit AS (SELECT doc_id, item_id, p, place.n FROM place JOIN window_ USING (n, g)),
        word AS (
            SELECT doc_id, count(DISTINCT q) AS n_hit
            FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT doc_id, p, n FROM hit))
            GROUP BY doc_id),
        item AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
            FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id),
        -- A verbatim match is a run of successive windows of one item.
        own AS (
            SELECT item_id, unnest(range(1, greatest(len(w) - 8, 2))) AS q, w FROM b WHERE len(w) > 0),
        aligned AS (
            SELECT h.doc_id, h.item_id, h.p, h.n, o.q FROM hit h JOIN own o ON h.item_id = o.item_id
            JOIN place l ON l.doc_id = h.doc_id AND l.p = h.p AND l.n = h.n
                AND l.g = array_to_string(o.w[o.q:o.q + 9], ' ')),
        run AS (
            SELECT doc_id, n, p - row_number() OVER (PARTITION BY doc_id, item_id, p - q ORDER BY p) AS r,
                item_id, p - q AS diagonal FROM aligned),
        longest AS (
            SELECT doc_id, max(len_) AS longest_match FROM (
                SELECT doc_id, count(*) + max(n) - 1 AS len_ FROM run GROUP BY doc_id, item_id, diagonal, r)
            GROUP BY doc_id)
        SELECT d.doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
            coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
            coalesce(n_hit, 0) > 0 AS contaminated, coalesce(longest_match, 0)::BIGINT AS longest_match
        FROM d LEFT JOIN word USING (doc_id) LEFT JOIN item USING (doc_id) LEFT JOIN longest USING (doc_id)""",
    "op4_suffix_array": """
        WITH d AS (
            SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n
            FROM documents),
        string_ AS (
            SELECT doc_id, i, substr(h, 2 * i + 1, 200) AS s
            FROM (SELECT doc_id, h, unnest(range(0, greatest(n - 99, 0))) AS i FROM d)),
        again AS (
            SELECT doc_id, i FROM string_
            QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1),
        run AS (
            SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM (
                SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (
                    SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100
                        THEN 0 ELSE 1 END AS new FROM again))
            GROUP BY doc_id, g),
        gap AS (
            SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p FROM run),
        cut AS (
            SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans,
                string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) || max(substr(h, 2 * last + 1)) AS kept
            FROM (SELECT gap.*, h, max(b) OVER (PARTITION BY gap.doc_id) AS last FROM gap JOIN d USING (doc_id))
            GROUP BY doc_id)
        SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
            coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
        FROM d LEFT JOIN cut USING (doc_id)""",
    "op5_warc": """
        WITH p AS (
            SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
        q AS (
            SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha256(payload) AS payload_digest,
                min(page_id) OVER (PARTITION BY sha256(payload)) AS first FROM p)
        SELECT page_id, payload_bytes, payload_digest,
            CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
        FROM q""",
    "op9_merkle": f"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id DESC) AS pos,
                count(*) OVER () AS n FROM documents),
        e AS (
            SELECT d.doc_id, d.text, x.text AS other, substr(d.text, 1, length(d.text) - length(d.text) // 3)
                || substr(x.text, 1, length(d.text) // 3) AS edited
            FROM d JOIN d x ON x.pos = d.pos % d.n + 1),
        f AS (
            SELECT *, {_sql_leaves("text")} AS a, {_sql_leaves("edited")} AS b, {_sql_leaves("other")} AS c FROM e)
        SELECT doc_id, length(text)::BIGINT AS n_chars, sha256(edited) AS edited_sha256,
            {_sql_root("text")} AS fingerprint, {_sql_root("edited")} AS edited_fingerprint,
            {_sql_likeness("a", "b")} AS near_edited, {_sql_likeness("a", "c")} AS near_next
        FROM f""",
    "op11_collocations": r"""
        WITH piece AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
        own AS (
            SELECT lang, list_filter(regexp_split_to_array(p, '[ \t]+'), lambda x: x <> '') AS w FROM piece),
        gram AS (
            SELECT lang, size, phrase, count(*) AS f FROM (
                SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase FROM (
                    SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i
                    FROM own, (SELECT unnest([1, 2, 3]) AS size) WHERE len(w) >= size))
            GROUP BY ALL),
        total AS (SELECT lang, sum(f) AS n FROM gram WHERE size = 1 GROUP BY lang),
        candidate AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM gram
            WHERE size >= 2 AND f >= 10),
        cut AS (
            SELECT c.lang, c.phrase, c.size, c.a, k, x.f AS l, y.f AS r,
                1000000::HUGEINT * c.a * c.a // (x.f::HUGEINT * y.f) AS score
            FROM (SELECT *, unnest(range(1, size)) AS k FROM candidate) c
            JOIN gram x ON x.lang = c.lang AND x.size = k AND x.phrase = array_to_string(w[1:k], ' ')
            JOIN gram y ON y.lang = c.lang AND y.size = c.size - k AND y.phrase = array_to_string(w[k + 1:], ' ')),
        best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        inside AS (
            SELECT lang, phrase, max(a) AS longest FROM (
                SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase
                FROM candidate WHERE size = 3) GROUP BY ALL),
        ranked AS (
            SELECT b.lang, b.phrase, b.a, b.l, b.r, n, b.score, row_number() OVER (
                PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank
            FROM best b JOIN total USING (lang) LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase
            WHERE longest IS NULL OR 100 * longest < 50 * b.a)
        SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000""",
}
