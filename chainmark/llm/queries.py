"""The registered queries of this subpackage, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, contamination, licenses, mixing, neardup, phrases, pii, sharding, substrings, templates, topk, toxicity, warc
from .work import table


def op1_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.dedup_substrings(table(spark, sf_dir, "documents"), with_text=False)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(table(spark, sf_dir, "embeddings"))
    return topk.search(vectors, vectors.where("vec_id % 20 = 0"), 20)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination.annotate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("doc.doc_id", *[c for c in found.columns if c != "doc"])


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = templates.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc.doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.classify(docs, model, keep=["doc_id"]).select("doc.doc_id", "held_out", "score", "predicted")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    strict = F.filter("spans", lambda s: s["strict"])
    kinds = F.transform(strict, lambda s: s["kind"])
    counts = [F.size(F.array_compact(F.transform(kinds, pii.same(kind)))).cast("long").alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.digest(strict), 256).alias("base_sha256"), pii.digest(F.col("spans")).alias("spans"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files below their source and language: source/lang/doc_id."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("unknown")), F.coalesce(F.col("doc_id").cast("string"), F.lit("unknown")))
    found = licenses.scan(docs.select(path.alias("path"), "text"))
    return found.select(F.substring_index("path", "/", -1).try_cast("long").alias("doc_id"), "license", "origin", "cosine", "n_headers")


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(table(spark, sf_dir, "documents"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shard(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select("doc.doc_id", *[c for c in found.columns if c != "doc"])


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = alignment.alignment(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select("doc.doc_id", *[c for c in found.columns if c != "doc"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substrings": op1_substrings,
    "op2_topk": op2_topk,
    "op3_mixing": op3_mixing,
    "op4_decontamination": op4_decontamination,
    "op5_lines": op5_lines,
    "op6_toxicity": op6_toxicity,
    "op7_pii": op7_pii,
    "op8_licenses": op8_licenses,
    "op9_neardup": op9_neardup,
    "op10_warc": op10_warc,
    "op11_phrases": op11_phrases,
    "op12_sharding": op12_sharding,
    "op13_alignment": op13_alignment,
}

_TEMPLATES = ", ".join("({}, '{}', '{}')".format(n, i, t.replace("'", "''")) for n, (i, t) in enumerate(licenses.TEMPLATES))
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL: dict[str, str] = {
    "op1_substrings": r"""
        WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        cut AS (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM docs WHERE len(w) >= 13),
        windows AS (SELECT r, doc_id, i, array_to_string(w[i : i + 12], ' ') AS s FROM cut),
        first AS (SELECT s, min(doc_id) AS source FROM windows GROUP BY s),
        gone AS (SELECT DISTINCT r, p FROM (SELECT r, unnest(range(i, i + 13)) AS p FROM windows JOIN first USING (s) WHERE source < doc_id)),
        word AS (SELECT r, p, w[p] AS x FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS p FROM docs)),
        kept AS (SELECT r, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (r, p) GROUP BY r),
        n AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM docs LEFT JOIN kept USING (r) LEFT JOIN n USING (r)""",
    "op2_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM s QUALIFY rank <= 20""",
    "op4_decontamination": r"""
        WITH docs AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        items AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
        cut AS (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM items WHERE len(w) > 0),
        windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS words FROM cut),
        spread AS (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n),
        found AS (SELECT r, i, s.n, item_id FROM (SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS words FROM spread) s JOIN windows USING (n, words)),
        covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM found) GROUP BY r),
        named AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM found GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
            sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM docs LEFT JOIN covered USING (r) LEFT JOIN named USING (r)""",
    "op5_lines": r"""
        WITH docs AS (SELECT row_number() OVER () AS r, doc_id, md5(text) AS h, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words, string_split(text, chr(10)) AS l FROM documents),
        even AS (SELECT r, doc_id, h, words, l, list_transform(l, lambda x: regexp_replace(trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g')), '[^ ]*[0-9][^ ]*', '<*>', 'g')) AS m FROM docs),
        each AS (SELECT r, doc_id, h, words, m, unnest(m) AS line, unnest(range(1, len(m) + 1)) AS p FROM even),
        cut AS (SELECT *, string_split(line, ' ') AS w, len(w) AS n, w[1:4] AS lead, hash(m) AS shape FROM each WHERE line <> '' AND len(string_split(line, ' ')) >= 3),
        distinct_ AS (SELECT DISTINCT n, lead, line, w FROM cut WHERE n > 4),
        wide AS (SELECT n, lead, count(*) AS of FROM distinct_ GROUP BY ALL HAVING count(*) > 1),
        tokens AS (SELECT n, lead, of, unnest(w) AS token, unnest(range(1, n + 1)) AS p FROM distinct_ JOIN wide USING (n, lead)),
        constant AS (SELECT n, lead, p, token FROM tokens GROUP BY n, lead, of, p, token HAVING 2 * count(*) > of),
        sized AS (SELECT n, lead, count(*) AS c FROM constant GROUP BY ALL),
        fits AS (
            SELECT d.n, d.lead, d.line FROM distinct_ d JOIN sized s USING (n, lead) JOIN constant k USING (n, lead)
            WHERE 4 * s.c >= 3 * d.n GROUP BY d.n, d.lead, d.line, s.c HAVING count(*) FILTER (d.w[k.p] = k.token) = s.c),
        named AS (
            SELECT c.r, c.doc_id, c.h, c.p, c.shape, c.words, c.n AS size, substring(md5(CASE WHEN f.line IS NULL THEN 'L' || c.line ELSE 'G' || c.n || ' ' || array_to_string(c.lead, ' ') END), 1, 16) AS t
            FROM cut c LEFT JOIN fits f USING (n, lead, line)),
        counted AS (SELECT t, count(DISTINCT shape) AS n, min(doc_id) AS first FROM named GROUP BY t HAVING count(DISTINCT shape) >= 3),
        hits AS (SELECT DISTINCT doc_id, h, p, shape, words, size, t, n FROM named JOIN counted USING (t)),
        whole AS (SELECT doc_id, h, max(words) AS words, sum(size) AS inside, first(t ORDER BY n, t) AS rarest FROM hits GROUP BY doc_id, h),
        copies AS (SELECT doc_id, h, rarest FROM whole WHERE 4 * inside >= 3 * words),
        votes AS (
            SELECT x.t, c.rarest, count(*) AS n FROM hits x JOIN (SELECT DISTINCT rarest AS t FROM copies) USING (t) JOIN copies c ON x.doc_id IS NOT DISTINCT FROM c.doc_id AND x.h = c.h GROUP BY ALL),
        called AS (SELECT t AS rarest, first(rarest ORDER BY n DESC, rarest DESC) AS name FROM votes GROUP BY t),
        member AS (SELECT doc_id, h, name FROM copies JOIN called USING (rarest)),
        units AS (SELECT DISTINCT t, name, CASE WHEN name IS NULL THEN shape END AS shape FROM hits LEFT JOIN member USING (doc_id, h)),
        often AS (SELECT t, first FROM (SELECT t FROM units GROUP BY t HAVING count(*) >= 3) JOIN counted USING (t)),
        gone AS (SELECT DISTINCT r, p FROM named JOIN often USING (t) WHERE doc_id <> first),
        word AS (SELECT r, unnest(l) AS x, unnest(range(1, len(l) + 1)) AS p FROM docs),
        kept AS (SELECT r, string_agg(x, chr(10) ORDER BY p) AS text FROM word ANTI JOIN gone USING (r, p) GROUP BY r),
        n AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
        SELECT doc_id, coalesce(len(l), 0) AS n_lines, coalesce(n, 0) AS n_dropped, sha256(coalesce(text, '')) AS kept_sha256
        FROM docs LEFT JOIN kept USING (r) LEFT JOIN n USING (r)""",
    "op8_licenses": rf"""
        WITH docs AS (
            SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, coalesce(source, 'unknown') AS source, coalesce(lang, 'unknown') AS lang FROM documents),
        lines AS (
            SELECT r, text, 'line' AS kind, unnest(string_split(text, chr(10))) AS unit, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS p FROM docs
            UNION ALL SELECT r, text, 'block', unnest(regexp_split_to_array(text, '{licenses.BREAK}')), unnest(range(-len(regexp_split_to_array(text, '{licenses.BREAK}')), 0)) FROM docs),
        units AS (SELECT r, p, text, kind, regexp_extract_all({_LOWER.format("unit")}, '{licenses.TERM}') AS w FROM lines WHERE regexp_matches(unit, '{licenses.SIGNAL}') AND (kind = 'line' OR contains(unit, chr(10)))),
        known AS (SELECT template, license, regexp_extract_all({_LOWER.format("t")}, '{licenses.TERM}') AS w FROM (VALUES {_TEMPLATES}) AS x(template, license, t)),
        n AS (SELECT count(*) AS n FROM units),
        each AS (SELECT r, p, term, count(*) AS tf FROM (SELECT r, p, unnest(w) AS term FROM units) GROUP BY ALL),
        idf AS (SELECT term, ln((max(n) + 1.0) / (count(*) + 1.0)) + 1.0 AS idf FROM each, n GROUP BY term),
        unseen AS (SELECT ln(n + 1.0) + 1.0 AS u FROM n),
        a0 AS (SELECT r, p, term, tf * idf AS w FROM each JOIN idf USING (term)),
        a AS (SELECT *, sqrt(sum(w * w) OVER (PARTITION BY r, p)) AS norm FROM a0),
        b0 AS (SELECT template, license, term, count(*) * coalesce(max(idf), max(u)) AS w FROM (SELECT template, license, unnest(w) AS term FROM known) LEFT JOIN idf USING (term), unseen GROUP BY ALL),
        b AS (SELECT *, sqrt(sum(w * w) OVER (PARTITION BY template)) AS norm FROM b0),
        dots AS (SELECT r, p, template, license, round(sum(a.w / a.norm * b.w / b.norm), 4) AS cosine FROM a JOIN b USING (term) GROUP BY ALL HAVING cosine >= {licenses.MIN_COSINE}),
        best AS (SELECT * FROM dots QUALIFY row_number() OVER (PARTITION BY r, p ORDER BY cosine DESC, license) = 1),
        kinds AS (
            SELECT r, kind, first(license ORDER BY cosine DESC, license) AS license, max(cosine) AS cosine, count(*) AS n, sum(len(w)) AS inside,
                max(len(regexp_extract_all({_LOWER.format("text")}, '{licenses.TERM}'))) AS words
            FROM best JOIN units USING (r, p) GROUP BY r, kind),
        own AS (SELECT r, first(license ORDER BY cosine DESC, license) AS license, max(cosine) AS cosine, max(n) AS n_headers, 2 * max(inside) >= max(words) AS is_file FROM kinds GROUP BY r),
        dirs AS (SELECT source, lang, first(license ORDER BY cosine DESC, license) AS inherited FROM own JOIN docs USING (r) WHERE is_file GROUP BY ALL)
        SELECT doc_id, coalesce(license, inherited) AS license,
            CASE WHEN license IS NOT NULL THEN CASE WHEN is_file THEN 'file' ELSE 'header' END WHEN inherited IS NOT NULL THEN 'inherited' END AS origin,
            cosine, coalesce(n_headers, 0) AS n_headers
        FROM docs LEFT JOIN own USING (r) LEFT JOIN dirs USING (source, lang)""",
    "op9_neardup": r"""
        WITH RECURSIVE docs AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        cut AS (SELECT r, w, least(len(w), 5) AS n, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM docs WHERE len(w) > 0),
        sets AS (SELECT DISTINCT r, array_to_string(w[i : i + n - 1], ' ') AS s FROM cut),
        sizes AS (SELECT r, count(*) AS n FROM sets GROUP BY r),
        common AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM sets a JOIN sets b USING (s) WHERE a.r <> b.r GROUP BY ALL),
        links AS (SELECT p.doc_id AS a, q.doc_id AS b FROM common JOIN sizes x ON x.r = a JOIN sizes y ON y.r = b JOIN docs p ON p.r = a JOIN docs q ON q.r = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM docs UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
        least_ AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, component_id = doc_id AS kept
        FROM docs JOIN least_ USING (doc_id) LEFT JOIN sizes USING (r)""",
    "op10_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body, strlen(coalesce(html, '')) AS n FROM pages),
        d AS (SELECT page_id, n, sha1(body) AS digest FROM p),
        m AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS stored FROM d)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
            CASE WHEN n >= 1000 AND page_id <> stored THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN n >= 1000 AND page_id <> stored THEN stored END AS refers_to
        FROM m""",
    "op11_phrases": rf"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM documents),
        every AS (
            SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS phrase
            FROM pieces, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k),
        f AS (SELECT lang, k, phrase, count(*) AS f FROM every GROUP BY ALL),
        totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
        candidates AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 30),
        places AS (SELECT *, unnest(range(1, k)) AS cut FROM candidates),
        cuts AS (
            SELECT p.lang, p.phrase, p.a, cut, x.f AS l, y.f AS r, CAST((2000000::HUGEINT * p.a) // (x.f::HUGEINT + y.f) AS BIGINT) AS score
            FROM places p JOIN f x ON x.lang = p.lang AND x.phrase = array_to_string(w[1:cut], ' ') JOIN f y ON y.lang = p.lang AND y.phrase = array_to_string(w[cut + 1:], ' ')),
        weakest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
        inside AS (
            SELECT DISTINCT c.lang, array_to_string(c.w[i : i + s - 1], ' ') AS phrase, c.a FROM candidates c, (SELECT unnest([1, 2, 3]) AS i), (SELECT unnest([2, 3]) AS s) WHERE s < k AND i + s <= k + 1),
        kept AS (SELECT * FROM weakest x WHERE NOT EXISTS (SELECT 1 FROM inside y WHERE y.lang = x.lang AND y.phrase = x.phrase AND 100 * y.a >= 80 * x.a))
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
        FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000""",
}
