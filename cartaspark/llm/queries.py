"""The registered queries of the corpus operators: thin readers of whole tables with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import decontaminate, exactdedup, htmltext, jaccard, langid, licences, linededup, merkle, packing, quality, spelling, tokencounts
from .sharding import ShardedTable
from .shared import shared_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
VOCABULARY, BYTE_VOCABULARY = "word_bpe_49k.json", "byte_bpe_50k.json"
CAPACITY = 2048
TOKEN_LIMIT = 1024
ARRIVALS = 8
GOOD_FROM = 0.3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = VOCABULARY) -> str:
    """The path of a public vocabulary; the same on every executor, as the package is installed there."""
    import public_tokenizers

    return public_tokenizers.path(name)


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo `by`."""
    return F.crc32(doc_id.cast("string")) % by


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive in ARRIVALS parts in the order of their ids (those without an id first); each is appended and compacted.

    One row per document, read back from the store, with the shard that holds it.
    """
    docs = table(spark, sf_dir, "documents")
    store = ShardedTable(spark, f"{shared_folder(spark)}/sharding-{uuid.uuid4().hex}", target_bytes=64 << 20, keep_versions=1)
    lo, hi = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    cuts = [lo + (hi - lo + 1) * k // ARRIVALS for k in range(1, ARRIVALS)] if lo is not None else []
    key = F.col("doc_id")
    for start, end in zip([None, *cuts], [*cuts, None], strict=True):
        part = F.lit(True) if start is None else key >= start
        part = part if end is None else part & (key < end)
        store.append(docs.where(part | key.isNull() if start is None else part))
        store.compact()
    version = store.version()
    place = F.element_at(F.split(F.col("_metadata.file_path"), "/data/"), -1)
    found = store.read() if store.manifest()["runs"] else docs.limit(0)
    return found.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("text_sha256"), place.alias("shard"), F.col("_metadata.file_size").alias("shard_bytes"), F.lit(version).cast("long").alias("version"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), k=5, threshold=80)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary(), CAPACITY, 0)


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")).where(remainder(F.col("doc_id"), 5) != 0)
    scored = quality.score(docs, quality.fit(docs, labels))
    return scored.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= GOOD_FROM, 1).otherwise(0).alias("predicted"))


def language_model(docs: DataFrame) -> langid.LanguageFilters:
    return langid.fit(docs.where(remainder(F.col("doc_id"), 3) != 1))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, language_model(docs))
    return found.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exactdedup.exact_dedup(table(spark, sf_dir, "documents"), keep="largest")
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.dedup_lines(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("kept_sha256"))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.count_words(table(spark, sf_dir, "documents"), damage=199)
    return spelling.variants(words.where((F.length("word") >= 6) & (F.col("n") >= 5)), ratio=5)


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tokencounts.count_tokens(table(spark, sf_dir, "documents"), vocabulary(BYTE_VOCABULARY))
    return found.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record's proof, held against the root after the texts of a fifth of the records have been lower-cased."""
    docs = table(spark, sf_dir, "documents")
    tampered = {"text": F.translate("text", UPPER, LOWER)}
    now = F.when(remainder(F.col("doc_id"), 5) == 0, merkle.leaf_digest(*(tampered.get(c, F.col(c)) for c in merkle.FIELDS)))
    found = merkle.Manifest(docs, now).proofs()
    found = found.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("path")), 256).alias("proof_sha256"), merkle.fold(F.coalesce("now", "leaf"), F.col("path")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (op1_sharding, op2_ngram_jaccard, op3_best_fit_packing, op4_html_extraction, op5_quality_classifier, op6_language_id, op7_exact_dedup, op8_license_scans, op9_line_dedup, op10_benchmark_decontamination, op11_spelling_variants, op12_token_counts, op13_merkle_manifest)
    }


def _merkle_sql(levels: int = 7) -> str:
    """Levels of all source trees, then of the tree of subroots; a level beyond a tree's root changes nothing, and `levels` of them hold 16 ** levels leaves."""
    fields = " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in merkle.FIELDS)
    crc = _crc32_sql("hex(encode(doc_id::VARCHAR))")
    tampered = fields.replace("text::VARCHAR", f"translate(text, '{UPPER}', '{LOWER}')")
    steps = [f"""
            doc AS (SELECT doc_id, coalesce('s' || source, '') AS tree, sha256({fields}) AS leaf, CASE WHEN doc_id IS NOT NULL AND {crc} % 5 = 0 THEN sha256({tampered}) END AS now FROM documents),
            s_0 AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS size FROM doc),
            sn_0 AS (SELECT tree, idx, size, leaf AS digest FROM s_0)"""]

    def climb(name: str) -> None:
        for k in range(levels):
            run = "PARTITION BY tree, idx // 16 ORDER BY idx ROWS BETWEEN"
            steps.append(f"""{name}p_{k} AS (SELECT tree, idx, size, coalesce(string_agg(digest, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(digest, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}n_{k})""")
            steps.append(f"""{name}n_{k + 1} AS (SELECT tree, idx // 16 AS idx, (size + 15) // 16 AS size, CASE WHEN size = 1 THEN min(digest) ELSE sha256(string_agg(digest, '' ORDER BY idx)) END AS digest FROM {name}n_{k} GROUP BY tree, idx // 16, size)""")

    climb("s")
    steps.append(f"tn_0 AS (SELECT '' AS tree, tree AS source, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS size, digest FROM sn_{levels})")
    climb("t")
    steps.append("d_0 AS (SELECT doc_id, leaf, tree, idx, '' AS proof, coalesce(now, leaf) AS acc FROM s_0)")
    for k in range(2 * levels):
        name = "s" if k < levels else "t"
        steps.append(f"""d_{k + 1} AS (SELECT d.doc_id, d.leaf, d.tree, d.idx // 16 AS idx, proof || l || r AS proof, CASE WHEN size = 1 THEN acc ELSE sha256(l || acc || r) END AS acc FROM {f"d_{k}" if k != levels else "e"} d JOIN {name}p_{k % levels} p ON p.idx = d.idx AND p.tree = {"d.tree" if name == "s" else "''"})""")
        if k == levels - 1:
            steps.append(f"e AS (SELECT d.doc_id, d.leaf, d.tree, t.idx, d.proof, d.acc FROM d_{levels} d JOIN tn_0 t ON t.source = d.tree)")
    return f"""
            WITH {", ".join(steps)}
            SELECT doc_id, leaf, n.digest AS subroot, t.digest AS root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = t.digest AS verified
            FROM d_{2 * levels} d JOIN sn_{levels} n ON n.tree = d.tree, tn_{levels} t"""


def _crc32_sql(hexes: str) -> str:
    """CRC-32 of bytes that are given as a hex text: bit by bit, by the polynomial 0xEDB88320."""
    octets = f"list_transform(range(1, 1 + length({hexes}) // 2), lambda i: ('0x' || substr({hexes}, 2 * i - 1, 2))::BIGINT)"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, k: xor(x >> 1, (x & 1) * 3988292384))))"


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the queries that SQL can express; the others are tested against brute force."""
    strip = r"regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')"
    return {
        "op2_ngram_jaccard": rf"""
            WITH RECURSIVE w AS (
                SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS ws FROM documents
            ), s AS (
                SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w
            ), n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n, sh FROM s),
            c AS (SELECT list_sort(sh) AS key, n, min(doc_id) AS class_id FROM n WHERE n > 0 GROUP BY ALL),
            t AS (SELECT class_id AS id, n, unnest(key) AS g FROM c),
            l AS (
                SELECT a.id AS a, b.id AS b FROM t a JOIN t b ON a.g = b.g AND a.id < b.id
                GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
            ), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
            r AS (SELECT class_id AS id, class_id AS comp FROM c UNION SELECT e.b, r.comp FROM r JOIN e ON e.a = r.id WHERE r.comp < e.b),
            m AS (SELECT id, min(comp) AS comp FROM r GROUP BY id),
            x AS (SELECT n.doc_id, n.n, coalesce(c.class_id, n.doc_id) AS class_id FROM n LEFT JOIN c ON c.key = list_sort(n.sh) AND n.n > 0)
            SELECT x.doc_id, x.n AS n_shingles, coalesce(m.comp, x.class_id) AS component_id, x.class_id FROM x LEFT JOIN m ON m.id = x.class_id""",
        "op7_exact_dedup": """
            WITH g AS (SELECT coalesce(text, '') AS t, max(doc_id) AS keep_id, count(*) AS n FROM documents GROUP BY 1)
            SELECT d.doc_id, g.keep_id, g.n AS group_size, d.doc_id = g.keep_id AS kept, sha256(g.t) AS text_sha256
            FROM documents d JOIN g ON g.t = coalesce(d.text, '')""",
        "op9_line_dedup": rf"""
            WITH l AS (SELECT row, doc_id, i, ls[i] AS line, len(ls) AS n FROM (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents) q, unnest(range(1, len(ls) + 1)) u(i)),
            k AS (SELECT *, translate({strip}, '{UPPER}', '{LOWER}') AS key FROM l),
            hot AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT row) >= 10),
            f AS (SELECT k.*, hot.key IS NOT NULL AS gone FROM k LEFT JOIN hot ON hot.key = k.key)
            SELECT doc_id, CAST(max(n) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
                sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
            FROM f GROUP BY row, doc_id""",
        "op11_spelling_variants": rf"""
            WITH RECURSIVE r AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents),
            d AS (SELECT doc_id, run, count(*) AS n, hex(encode(doc_id || ':' || run)) AS hexes FROM r GROUP BY ALL),
            h AS (SELECT run, n, CASE WHEN doc_id IS NOT NULL THEN {_crc32_sql("hexes")} END AS h FROM d),
            v AS (SELECT n, CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM h),
            w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM v WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
            x AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM w, unnest(range(1, length(word) + 1)) u(i)),
            e AS (
                SELECT a.word AS a, b.word AS b FROM x a JOIN x b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
                UNION SELECT x.word, w.word FROM x JOIN w ON w.word = x.rest UNION SELECT w.word, x.word FROM x JOIN w ON w.word = x.rest
            ), k AS (SELECT e.a AS word, count(*) AS n_near, max(w.n) AS best_n FROM e JOIN w ON w.word = e.b GROUP BY e.a),
            g AS (SELECT k.word, min(w.word) AS best FROM k JOIN e ON e.a = k.word JOIN w ON w.word = e.b AND w.n = k.best_n GROUP BY k.word),
            f AS (
                SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 5 * w.n THEN best END AS form, CASE WHEN best_n >= 5 * w.n THEN best_n END AS form_n
                FROM w LEFT JOIN k ON k.word = w.word LEFT JOIN g ON g.word = w.word
            ), p AS (SELECT word, word AS at FROM f UNION ALL SELECT p.word, f.form FROM p JOIN f ON f.word = p.at WHERE f.form IS NOT NULL)
            SELECT f.word, f.form, p.at AS root, f.n, f.n_near, f.form_n FROM f JOIN p ON p.word = f.word JOIN f l ON l.word = p.at AND l.form IS NULL""",
        "op13_merkle_manifest": _merkle_sql(),
    }
