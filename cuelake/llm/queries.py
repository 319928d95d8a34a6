"""The registered query of each operator, with its production parameters, and SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.llm import disclosure, embeddings, langid, lexical, lines, media, packing, phrases, pieces, quality, simhash, urlrules, warc
from cuelake.llm.common import write_shared


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo parts."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = pieces.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(joined, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs, words=4, radius=4).select("doc_id", "fingerprint", "component_id")


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(_fold("doc_id", 3) == 1, F.lit(False))
    model = langid.fit(docs.where(~held))
    told = langid.identify_documents(docs.select("doc_id", "text"), model)
    return told.select("doc_id", held.alias("held_out"), "lang_pred", "score", "ambiguous")


def op4_urlrules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return urlrules.filter_urls(pages).select("page_id", "host", "path", "rule", "verdict")


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"), cosine=0.98)


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = media.media_column(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    cuts = F.array_join(F.transform("clips", lambda c: F.round(c["end_s"] * media.FPS).cast("int").cast("string")), ",")
    return kept.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat(F.size("clips").cast("string"), F.lit(":"), F.sha1(cuts.cast("binary"))).alias("feature"),
    )


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_archives(_table(spark, sf_dir, "pages").select("page_id", "url", "html"), min_bytes=0)
    stored = spark.read.schema("name string, content binary").parquet(write_shared(archives, "warc"))
    return warc.read_archives(stored).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "block_ok", "payload_ok")


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = lines.drop_shared_lines(docs, min_docs=10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels")
    held = F.coalesce(_fold("doc_id", 5) == 0, F.lit(False))
    forest = quality.fit(docs, labels.where(~held))
    scored = quality.score_documents(docs, forest)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), max_tokens=4096, end_id=1)


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark").select("item_id", "text")
    return lexical.rank_documents(docs, items, top=10)


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("text", "lang")
    return phrases.collocations(docs, max_words=3, least=10, share=50, top=2000)


def op13_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = disclosure.personal_data(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    counts = [of(kind).alias(f"n_{kind}") for kind in disclosure.KINDS[:-1]]
    base = F.filter("spans", lambda s: s["kind"] != "term")
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_simhash": op2_simhash,
    "op3_langid": op3_langid,
    "op4_urlrules": op4_urlrules,
    "op5_embeddings": op5_embeddings,
    "op6_media": op6_media,
    "op7_warc": op7_warc,
    "op8_lines": op8_lines,
    "op9_quality": op9_quality,
    "op10_packing": op10_packing,
    "op11_lexical": op11_lexical,
    "op12_phrases": op12_phrases,
    "op13_disclosure": op13_disclosure,
}

ORACLE_SQL: dict[str, str] = {
    "op8_lines": r"""
        WITH rows AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        flat AS (SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM rows),
        keyed AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM flat),
        shared AS (SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10),
        told AS (SELECT keyed.*, shared.k IS NOT NULL AS lost FROM keyed LEFT JOIN shared USING (k))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
        FROM told GROUP BY r, doc_id
    """,
    "op11_lexical": r"""
        WITH doc AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents WHERE text IS NOT NULL),
        sized AS (SELECT r, doc_id, terms, len(terms) AS n FROM doc WHERE len(terms) > 0),
        total AS (SELECT count(*) AS texts, CAST(sum(n) AS BIGINT) AS words FROM sized),
        flat AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
        asked AS (SELECT item_id, term, count(*) AS times FROM flat GROUP BY item_id, term),
        held AS (SELECT r, unnest(terms) AS term FROM sized),
        counted AS (SELECT r, term, count(*) AS tf FROM held WHERE term IN (SELECT term FROM asked) GROUP BY r, term),
        weight AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(texts) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM counted, total GROUP BY term),
        scored AS (SELECT item_id, r, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * texts) // words)))) AS BIGINT) AS score
                   FROM asked JOIN counted USING (term) JOIN weight USING (term) JOIN sized USING (r), total GROUP BY item_id, r),
        ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score
                   FROM scored JOIN sized USING (r) WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
    """,
    "op12_phrases": r"""
        WITH cut AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                            'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        piece AS (SELECT row_number() OVER () AS p, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM cut),
        word AS (SELECT lang, p, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM piece),
        gram AS (SELECT lang, w AS w1, lead(w) OVER x AS w2, lead(w, 2) OVER x AS w3 FROM word WINDOW x AS (PARTITION BY p ORDER BY i)),
        f1 AS (SELECT lang, w1, count(*) AS f FROM gram GROUP BY ALL),
        f2 AS (SELECT lang, w1, w2, count(*) AS f FROM gram WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
        f3 AS (SELECT lang, w1, w2, w3, count(*) AS f FROM gram WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
        total AS (SELECT lang, count(*) AS n FROM gram GROUP BY lang),
        scored AS (
            SELECT lang, w1, w2, NULL AS w3, f2.f AS a, x.f AS l, y.f AS r, 1 AS k, w1 || ' ' || w2 AS phrase
            FROM f2 JOIN f1 x USING (lang, w1) JOIN (SELECT lang, w1 AS w2, f FROM f1) y USING (lang, w2)
            UNION ALL SELECT lang, w1, w2, w3, f3.f, x.f, y.f, 1, w1 || ' ' || w2 || ' ' || w3
            FROM f3 JOIN f1 x USING (lang, w1) JOIN (SELECT lang, w1 AS w2, w2 AS w3, f FROM f2) y USING (lang, w2, w3)
            UNION ALL SELECT lang, w1, w2, w3, f3.f, x.f, y.f, 2, w1 || ' ' || w2 || ' ' || w3
            FROM f3 JOIN f2 x USING (lang, w1, w2) JOIN (SELECT lang, w1 AS w3, f FROM f1) y USING (lang, w3)),
        told AS (SELECT *, CAST((CAST(1000000 AS HUGEINT) * a * a) // (CAST(l AS HUGEINT) * r) AS BIGINT) AS score FROM scored),
        best AS (SELECT * FROM told QUALIFY row_number() OVER (PARTITION BY lang, w1, w2, w3 ORDER BY score, k) = 1),
        longer AS (SELECT lang, w1, w2, f FROM f3 UNION ALL SELECT lang, w2, w3, f FROM f3),
        most AS (SELECT lang, w1, w2, max(f) AS f FROM longer GROUP BY ALL),
        kept AS (SELECT best.* FROM best LEFT JOIN most ON best.w3 IS NULL AND best.lang = most.lang AND best.w1 = most.w1 AND best.w2 = most.w2
                 WHERE most.f IS NULL OR 100 * most.f < 50 * best.a),
        ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score FROM kept)
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
    """,
    "op5_embeddings": """
        WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
        sound AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                  AND len(list_filter(e, lambda x: x <> 0)) > 0),
        link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.label = b.label AND a.vec_id <> b.vec_id
                 WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
        reach AS (SELECT vec_id, vec_id AS root FROM v UNION SELECT link.a, reach.root FROM reach JOIN link ON link.b = reach.vec_id),
        n AS (SELECT a, count(*) AS n_links FROM link GROUP BY a),
        c AS (SELECT vec_id, min(root) AS component_id FROM reach GROUP BY vec_id)
        SELECT v.vec_id, coalesce(n_links, 0) AS n_links, component_id, v.vec_id = component_id AS kept
        FROM v JOIN c USING (vec_id) LEFT JOIN n ON n.a = v.vec_id
    """,
    "op7_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages),
        d AS (SELECT page_id, strlen(body) AS payload_bytes, max(page_id) OVER (PARTITION BY body) AS last,
                     list_transform(range(0, 32), lambda i: 16 * (strpos('0123456789abcdef', substr(hex, CAST(i * 5 // 4 AS INT) + 1, 1)) - 1)
                         + strpos('0123456789abcdef', substr(hex, CAST(i * 5 // 4 AS INT) + 2, 1)) - 1) AS pairs FROM p)
        SELECT page_id, payload_bytes,
               array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   CAST((pairs[i + 1] >> CAST(3 - i * 5 % 4 AS INT)) & 31 AS INT) + 1, 1)), '') AS payload_digest,
               CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to,
               true AS block_ok, true AS payload_ok FROM d
    """,
}
