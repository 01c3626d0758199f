"""The operators over whole tables, and SQL that says the same."""

from __future__ import annotations

import os

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventweir.llm import (
    bpe,
    decontaminate,
    hard_negatives,
    line_dedup,
    ngram_join,
    quality,
    quotations,
    secret_scan,
    spelling,
    spot_signatures,
    token_counts,
    toxicity,
    warc,
)
from eventweir.llm.text import session
from eventweir.session import scratch_path, written_table

QUERIES = {}
ORACLES = {}


class Tables:
    """Reads the given tables of one scale by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(os.path.join(self.sf_dir, f"{name}.parquet"))


def query(name: str, sql: str | None = None):
    """Register ``function(spark, table)``."""

    def register(function):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(session(spark), Tables(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def sha256_of(text):
    return F.sha2(F.coalesce(text, F.lit("")), 256)


BLANK_CLASS = r"[\x20\x09-\x0D]"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@query(
    "op1_ngram_join",
    rf"""
    WITH RECURSIVE docs AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    shingles AS (
        SELECT DISTINCT doc_id, unnest(
            CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))
                 WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
        FROM docs),
    sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
    common AS (
        SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
        FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
    links AS (
        SELECT a, b FROM common JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)),
    ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reached(doc_id, other) AS (
        SELECT doc_id, doc_id FROM docs
        UNION SELECT reached.doc_id, ways.b FROM reached JOIN ways ON reached.other = ways.a)
    SELECT reached.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id
    FROM reached LEFT JOIN sizes ON reached.doc_id = sizes.doc_id GROUP BY reached.doc_id""",
)
def op1(spark, table):
    """The near-duplicate component of every document."""
    found = ngram_join.components(table("documents"), ngram_join.Join(k=5, similarity=80))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


@query(
    "op2_line_dedup",
    rf"""
    WITH lines AS (
        SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line_no
        FROM documents),
    keyed AS (
        SELECT *, translate(regexp_replace(line, '^{BLANK_CLASS}+|{BLANK_CLASS}+$', '', 'g'), '{UPPER}', '{LOWER}') AS key
        FROM lines),
    frequent AS (
        SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
    marked AS (
        SELECT doc_id, line_no, line, key IN (SELECT key FROM frequent) AS gone FROM keyed)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT gone), '')) AS kept_sha256
    FROM marked GROUP BY doc_id""",
)
def op2(spark, table):
    """Documents without the lines that ten or more documents hold."""
    kept = line_dedup.dedup_lines(table("documents").select("doc_id", "text"), min_docs=10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", sha256_of(F.col("text")).alias("kept_sha256"))


@query("op6_bpe")
def op6(spark, table):
    """Every text encoded and decoded again."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    coded = bpe.decode(bpe.encode(table("documents").select("doc_id", "text"), path), path)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(ids, 256).alias("ids_sha256"),
        sha256_of(F.col("text")).alias("decoded_sha256"),
    )


@query(
    "op7_warc",
    """
    WITH digested AS (
        SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS hexes FROM pages),
    firsts AS (SELECT *, min(page_id) OVER (PARTITION BY hexes) AS first_id FROM digested)
    SELECT page_id, payload_bytes,
           array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((
               (CAST('0x' || substr(hexes, 5 * (i // 4) + 1, 5) AS BIGINT) >> (5 * (3 - i % 4))) & 31) + 1 AS INTEGER), 1)), '') AS payload_digest,
           CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
    FROM firsts
    """,
)
def op7(spark, table):
    """A WARC record per page, equal payloads as revisits, read back from the archives."""
    pages = warc.with_digest(table("pages").select("page_id", "url", "html"))
    path = scratch_path(spark, "archives")
    warc.write_archives(warc.resolve_revisits(pages, min_bytes=0), path)
    found = warc.follow_revisits(warc.read_archives(spark, path))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query(
    "op3_decontaminate",
    rf"""
    WITH docs AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
    items AS (
        SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w
        FROM benchmark),
    windows AS (
        SELECT item, least(len(w), 10) AS n, unnest(list_transform(generate_series(1, greatest(len(w) - 9, 1)), lambda i: w[i : i + 9])) AS win
        FROM items WHERE len(w) > 0),
    sizes AS (SELECT DISTINCT n FROM windows),
    places AS (
        SELECT doc_id, n, unnest(generate_series(1, len(w) - n + 1)) AS start,
               unnest(list_transform(generate_series(1, len(w) - n + 1), lambda i: w[i : i + n - 1])) AS win
        FROM docs JOIN sizes ON len(w) >= n),
    found AS (
        SELECT doc_id, start, p.n, item FROM places p JOIN windows v ON p.n = v.n AND p.win = v.win),
    hit AS (
        SELECT doc_id, count(DISTINCT pos) AS n_hit
        FROM (SELECT doc_id, unnest(generate_series(start, start + n - 1)) AS pos FROM found) GROUP BY doc_id),
    named AS (
        SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM found GROUP BY doc_id)
    SELECT docs.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM docs LEFT JOIN hit ON docs.doc_id = hit.doc_id LEFT JOIN named ON docs.doc_id = named.doc_id""",
)
def op3(spark, table):
    """Documents with words of benchmark items, by windows of ten words."""
    found = decontaminate.contamination(table("documents").select("doc_id", "text"), table("benchmark"), size=10)
    items = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", items.alias("items_sha256"), "contaminated")


@query("op9_token_counts")
def op9(spark, table):
    """Tokens of every line of every document, from one encoding of the whole text."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return token_counts.count_sections(table("documents").select("doc_id", "text"), path, rule="most")


@query("op10_secret_scan")
def op10(spark, table):
    """Secrets of every document, from one pass over its bytes."""
    found = secret_scan.scan(table("documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"].isin([rule.kind for rule in secret_scan.BASE]))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[count(rule.kind) for rule in secret_scan.BASE],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


@query("op4_spot_signatures")
def op4(spark, table):
    """Fingerprints of all documents and of their edited texts, and how alike they are."""
    found = spot_signatures.fingerprints(table("documents"))
    return found.select(
        "doc_id",
        "n_chars",
        sha256_of(F.col("edited")).alias("edited_sha256"),
        spot_signatures.as_text(F.col("found")).alias("fingerprint"),
        spot_signatures.as_text(F.col("edited_found")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


@query(
    "op5_quotations",
    rf"""
    WITH RECURSIVE quoted AS (
        SELECT m.*, CASE WHEN m.turn % 3 >= 1 THEN a.text END AS one, CASE WHEN m.turn % 3 >= 2 THEN b.text END AS two
        FROM conversations m LEFT JOIN conversations a ON a.conv_id = m.conv_id AND a.turn = m.turn - 1
        LEFT JOIN conversations b ON b.conv_id = m.conv_id AND b.turn = m.turn - 2),
    normal AS (
        SELECT conv_id, turn, list_transform(string_split(text, chr(10)), lambda l:
            trim(regexp_replace(translate(l, '{UPPER}', '{LOWER}'), '[ 	-
]+', ' ', 'g'))) AS lines FROM conversations),
    wholes AS (
        SELECT conv_id, turn, lines, array_to_string(list_filter(lines, lambda l: l <> ''), chr(10)) AS whole,
               string_split_regex(array_to_string(lines, chr(10)), '

+') AS blocks FROM normal),
    units AS (
        SELECT DISTINCT conv_id, turn, trim(unnest(list_concat([whole], blocks, lines)), chr(10)) AS unit FROM wholes),
    passages AS (
        SELECT conv_id, turn + 1 AS turn, 1 AS level, whole FROM wholes WHERE (turn + 1) % 3 >= 1 AND whole <> ''
        UNION ALL SELECT conv_id, turn + 2, 2, whole FROM wholes WHERE (turn + 2) % 3 >= 2 AND whole <> ''),
    links AS (
        SELECT p.conv_id, p.turn, level, min(u.turn) AS original
        FROM passages p JOIN conversations m ON m.conv_id = p.conv_id AND m.turn = p.turn
        LEFT JOIN units u ON u.conv_id = p.conv_id AND u.turn < p.turn AND u.unit = p.whole GROUP BY ALL),
    counts AS (
        SELECT conv_id, turn, count(*) AS n_passages, count(original) AS n_linked, arg_min(original, level) AS reply_to FROM links GROUP BY ALL),
    steps AS (
        SELECT conv_id, turn, reply_to AS root FROM counts WHERE reply_to IS NOT NULL
        UNION ALL SELECT s.conv_id, s.turn, c.reply_to FROM steps s JOIN counts c ON c.conv_id = s.conv_id AND c.turn = s.root WHERE c.reply_to IS NOT NULL),
    threads AS (SELECT conv_id, turn, min(root) AS thread FROM steps GROUP BY ALL)
    SELECT q.conv_id, q.turn, q.role,
           concat_ws(chr(10), '>> ' || replace(two, chr(10), chr(10) || '>> '), '> ' || replace(one, chr(10), chr(10) || '> '), q.text) AS text,
           q.text AS own_text, c.reply_to, coalesce(t.thread, q.turn) AS thread,
           coalesce(c.n_passages, 0) AS n_passages, coalesce(c.n_linked, 0) AS n_linked
    FROM quoted q LEFT JOIN counts c USING (conv_id, turn) LEFT JOIN threads t USING (conv_id, turn)
    """,
)
def op5(spark, table):
    """All conversations in reply order, without quotes.

    The table quotes nothing, so each turn first gets its ``turn % 3``
    predecessors as quotes of as many levels."""
    return quotations.conversations(written_table(quotations.with_quotes(table("conversations")), "quoting"))


@query("op8_toxicity")
def op8(spark, table):
    """The probability of being toxic, learnt from the labels that are not held out."""
    docs = table("documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.train(docs, table("labels")))
    return scored.select(
        "doc_id",
        toxicity.is_held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


@query(
    "op11_hard_negatives",
    """
    WITH usable AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
               list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
        FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (
        SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
               CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
        FROM usable a JOIN usable b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
    positives AS (
        SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
    SELECT p.anchor_id, positive_id,
           CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY n.score DESC, n.other_id) AS INTEGER) AS rank,
           n.other_id AS negative_id, positive_score, n.score AS negative_score
    FROM positives p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT n.same
     AND 30 * positive_score <= 100 * n.score AND 100 * n.score <= 90 * positive_score
    QUALIFY rank <= 10""",
)
def op11(spark, table):
    """Hard negatives for every anchor and positive, a hundredth of the rows against all."""
    rows = table("embeddings")
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = hard_negatives.mine(rows.withColumn("label", noisy), F.col("vec_id") % 100 == 0)
    return found.drop("anchor_row")


#: The table of the checksum that crc32 takes a byte at a time.
CRC_TABLE = """
    crc_bits AS (
        SELECT i, 0 AS step, i::BIGINT AS c FROM range(256) t(i)
        UNION ALL SELECT i, step + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc_bits WHERE step < 8),
    crc_table AS (SELECT list(c ORDER BY i) AS t FROM crc_bits WHERE step = 8)"""


@query(
    "op12_spelling_variants",
    f"""
    WITH RECURSIVE {CRC_TABLE},
    runs AS (
        SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
               unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[a-z\u00C0-\u00FF]+')) AS run
        FROM documents),
    counted AS (SELECT id, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY ALL),
    coded AS (SELECT id, run, n, hex(encode(id || ':' || run)) AS h FROM counted),
    checked AS (
        SELECT run, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(h) // 2), lambda i:
                   CAST('0x' || h[2 * i + 1 : 2 * i + 2] AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS crc
        FROM coded, crc_table),
    spoilt AS (
        SELECT CASE WHEN crc % 31 = 0 THEN run[1 : crc % length(run)] || run[crc % length(run) + 2 :] ELSE run END AS word, n FROM checked),
    words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spoilt WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
    places AS (SELECT word, n, unnest(range(0, length(word))) AS i FROM words),
    shortened AS (SELECT word, n, i, word[1 : i] || word[i + 2 :] AS rest FROM places),
    pairs AS (
        SELECT a.word AS a, b.word AS b FROM shortened a JOIN shortened b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
        UNION SELECT a.word, b.word FROM shortened a JOIN words b ON a.rest = b.word
        UNION SELECT b.word, a.word FROM shortened a JOIN words b ON a.rest = b.word),
    near AS (
        SELECT a, count(*) AS n_near, first(b ORDER BY n DESC, b) AS form, max(n) AS form_n FROM pairs JOIN words ON b = word GROUP BY a),
    formed AS (
        SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * n THEN form END AS form,
               CASE WHEN form_n >= 10 * n THEN form_n END AS form_n
        FROM words LEFT JOIN near ON word = a),
    ways(word, root) AS (
        SELECT word, word FROM words
        UNION ALL SELECT ways.word, formed.form FROM ways JOIN formed ON ways.root = formed.word AND formed.form IS NOT NULL)
    SELECT formed.word, formed.form, ways.root, formed.n, formed.n_near, formed.form_n
    FROM formed JOIN ways ON formed.word = ways.word
    JOIN formed r ON ways.root = r.word AND r.form IS NULL""",
)
def op12(spark, table):
    """Words with the more frequent spelling that each is a variant of."""
    how = spelling.Spelling(min_chars=7, min_count=2, times=10, spoil=31)
    return spelling.variants(table("documents").select("doc_id", "text"), how)


@query("op13_quality")
def op13(spark, table):
    """Documents that rules, weighed by how they agree, hold to be good."""

    def base_failed():
        return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)

    judged = quality.judge(table("documents").select("doc_id", "text"), must=lambda: ~base_failed())
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select("doc_id", *base, base_failed().alias("base_failed"), "kept", "quality")


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark, table):
    """The stages of the corpus pipeline, one after the other."""
    return corpus_pipeline.run(spark, table.sf_dir)
