"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import byte_bpe
from quire.llm.arrow_tokens import read_tokens, write_tokens
from quire.llm.chat_format import format_examples, read_back
from quire.llm.common import documents
from quire.llm.exact_dedup import exact_groups
from quire.llm.fill_in_middle import fill_in_middle, restored
from quire.llm.html_extract import extract_pages
from quire.llm.jaccard_join import join_documents
from quire.llm.language_id import identify
from quire.llm.matroska import media_table, read_media
from quire.llm.merkle_manifest import folded, prove, siblings
from quire.llm.mixing import mix
from quire.llm.sentencepiece_bpe import decode, encode
from quire.llm.suffix_dedup import remove_repeats


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and the remaining text (where a cut parts a character, its remains become U+FFFD)."""
    told = remove_repeats(documents(spark, sf_dir))
    return told.withColumn("text", F.make_valid_utf8(F.col("kept").cast("string"))).drop("kept")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql("select -1L as conv_id, turn, role, :said as text from values (0L, 'user'), (1L, 'assistant') as t(turn, role)", {"said": said})
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return read_back(format_examples(turns.unionByName(extra)))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids with merge-dropout, and the text that they decode to."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    told = decode(encode(docs, model), model)
    ids_text = F.to_binary(F.array_join("ids", ","), F.lit("utf-8"))
    return told.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.crc32(ids_text).alias("ids_crc32"), F.sha2("decoded", 256).alias("decoded_sha256"), (F.col("decoded") == F.col("text")).alias("lossless"))


def op5_arrow_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_tokens(write_tokens(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json")))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies")


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source of op7's mix: its documents, words and target, and whether the words taken come near it."""
    told = mix(documents(spark, sf_dir)).withColumn("taken", F.col("copies") * F.col("size"))
    sums = told.groupBy("source").agg(F.count("*").alias("n_docs"), F.max("source_size").alias("source_size"), F.max("target").alias("target"), F.sum("taken").alias("taken"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"))
    near = F.abs(F.col("taken") - F.col("target")) <= 0.005 * F.col("target") + 4 * F.coalesce("least", F.lit(0))
    return sums.select("source", "n_docs", "source_size", F.round("target", 3).alias("target"), near.alias("near"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_documents(documents(spark, sf_dir), 4, 85).select("doc_id", "n_shingles", "component_id")


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op10_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_media(media_table(documents(spark, sf_dir)))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_in_middle(documents(spark, sf_dir))
    digests = [F.sha2(text.cast("binary"), 256).alias(name) for name, text in (("output_sha256", F.col("output")), ("restored_sha256", restored(F.col("output"), F.col("form"))))]
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's proof, and the root that it gives for the document as found: half of them have lost their line ends."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    found = {"text": F.when(tampered, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))}
    told = prove(documents(spark, sf_dir), found=found).withColumn("folded_root", folded(F.col("found"), F.col("path")))
    proof = F.sha2(siblings(F.col("path")).cast("binary"), 256).alias("proof_sha256")
    return told.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", proof, "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    told = byte_bpe.decode(byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN).drop("text"), ranks)
    ids_text = F.array_join("ids", ",").cast("binary")
    return told.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids_text, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_chat_format": op3_chat_format,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_arrow_tokens": op5_arrow_tokens,
    "op6_language_id": op6_language_id,
    "op7_mixing": op7_mixing,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_html_extract": op9_html_extract,
    "op10_matroska": op10_matroska,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_byte_bpe": op13_byte_bpe,
    "mixing_targets": mixing_targets,
}

ORACLES: dict[str, str] = {
    "op2_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
             g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.text) AS text_sha256
        FROM d JOIN g USING (text)""",
    "op3_chat_format": """
        WITH c AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
        n AS (
            SELECT *, length(text) + len(regexp_extract_all(text, '[\\\\<\\[]')) + length(role) + len(regexp_extract_all(role, '[\\\\<\\[]')) + 20 AS chars,
                   row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n_turns
            FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
        e AS (
            SELECT conv_id, sum(so_far) AS formatted_chars FROM (
                SELECT conv_id, role, k, n_turns, sum(chars) OVER (PARTITION BY conv_id ORDER BY k) AS so_far FROM n)
            WHERE role = 'assistant' OR k = n_turns GROUP BY conv_id)
        SELECT n.conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(any_value(e.formatted_chars) AS BIGINT) AS formatted_chars
        FROM n JOIN e ON n.conv_id IS NOT DISTINCT FROM e.conv_id GROUP BY n.conv_id""",
    "mixing_targets": """
        WITH d AS (SELECT source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
        s AS (SELECT source, count(*) AS n_docs, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
        w AS (SELECT *, [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)]::DOUBLE AS weight FROM s),
        f AS (SELECT *, 2.0 * source_size / weight AS full_at FROM w),
        l AS (SELECT *, row_number() OVER o AS place,
                     (1.5 * sum(source_size) OVER () - 2.0 * coalesce(sum(source_size) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                     / sum(weight) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
              FROM f WINDOW o AS (ORDER BY full_at, source NULLS LAST)),
        x AS (SELECT arg_min(level, place) AS share FROM l WHERE level <= full_at)
        SELECT source, n_docs, source_size, round(least(2.0 * source_size, weight * share)::DOUBLE, 3) AS target, true AS near FROM l, x""",
    "op8_jaccard_join": """
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN [array_to_string(w[i:i+3], ' ') FOR i IN range(1, len(w) - 2)]
                                                WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM w),
        n AS (SELECT w.doc_id, count(s.sh) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * common >= 85 * (x.n + y.n - common)),
        r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
        SELECT n.doc_id, n.n AS n_shingles, min(r.b) AS component_id FROM n JOIN r ON r.a = n.doc_id GROUP BY 1, 2""",
    "op11_fill_in_middle": """
        WITH u AS (
            SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
                   sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
        n AS (
            SELECT doc_id, text, u, CAST(len(u) AS BIGINT) AS n, ('0x' || h[1:8])::UBIGINT % (len(u) + 1) AS c1, ('0x' || h[9:16])::UBIGINT % (len(u) + 1) AS c2,
                   ('0x' || h[17:24])::UBIGINT % 100 AS c3, ('0x' || h[25:32])::UBIGINT % 100 AS c4 FROM u),
        p AS (
            SELECT *, least(c1, c2)::BIGINT AS a, greatest(c1, c2)::BIGINT AS b,
                   CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR c3 >= 90 THEN 'plain' WHEN c4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM n),
        x AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM p)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
               sha256(text) AS restored_sha256 FROM x""",
    "op12_merkle_manifest": """
        WITH RECURSIVE f AS (
            SELECT doc_id, source, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
                   || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head, text,
                   CASE WHEN xor(list_reduce(flatten([[ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0] FOR c IN string_split(CAST(doc_id AS VARCHAR), '')]),
                                             lambda r, x: xor(xor(r, x) >> 1, 3988292384 * (xor(r, x) & 1)), 4294967295), 4294967295) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS now FROM documents),
        h AS (
            SELECT doc_id, coalesce('=' || source, '') AS g, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(now) || ':' || now, '-')) AS found FROM f),
        l AS (
            SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, found) - 1 AS place, count(*) OVER (PARTITION BY g) AS n FROM h),
        t AS (
            SELECT g, 0 AS level, place, leaf AS h, n FROM l
            UNION ALL SELECT g, level + 1, place // 3, sha256(string_agg(h, '' ORDER BY place)), (any_value(n) + 2) // 3 FROM t WHERE n > 1 GROUP BY g, level, place // 3),
        s AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS place, count(*) OVER () AS n FROM t WHERE n = 1),
        o AS (
            SELECT 0 AS level, place, subroot AS h, n FROM s
            UNION ALL SELECT level + 1, place // 3, sha256(string_agg(h, '' ORDER BY place)), (any_value(n) + 2) // 3 FROM o WHERE n > 1 GROUP BY level, place // 3),
        k AS (
            SELECT g, level, place // 3 AS parent, list(h ORDER BY place) AS kids FROM t WHERE n > 1 GROUP BY ALL
            UNION ALL SELECT NULL, level, place // 3, list(h ORDER BY place) FROM o WHERE n > 1 GROUP BY ALL),
        a AS (
            SELECT g, g AS at, 0 AS level, place, place AS key, '' AS sib, found AS fold FROM l
            UNION ALL
            SELECT a.g, a.at, a.level + 1, a.place // 3, a.key, a.sib || array_to_string(k.kids[1:a.place % 3], '') || array_to_string(k.kids[a.place % 3 + 2:], ''),
                   sha256(array_to_string(k.kids[1:a.place % 3], '') || a.fold || array_to_string(k.kids[a.place % 3 + 2:], ''))
            FROM a JOIN k ON k.g = a.at AND k.level = a.level AND k.parent = a.place // 3),
        b AS (
            SELECT a.g, 0 AS level, s.place, a.key, a.sib, a.fold FROM (SELECT *, row_number() OVER (PARTITION BY g, key ORDER BY level DESC) AS last FROM a) a JOIN s USING (g) WHERE last = 1
            UNION ALL
            SELECT b.g, b.level + 1, b.place // 3, b.key, b.sib || array_to_string(k.kids[1:b.place % 3], '') || array_to_string(k.kids[b.place % 3 + 2:], ''),
                   sha256(array_to_string(k.kids[1:b.place % 3], '') || b.fold || array_to_string(k.kids[b.place % 3 + 2:], ''))
            FROM b JOIN k ON k.g IS NULL AND k.level = b.level AND k.parent = b.place // 3),
        e AS (SELECT *, row_number() OVER (PARTITION BY g, key ORDER BY level DESC) AS last FROM b)
        SELECT l.doc_id, l.leaf, s.subroot, r.h AS root, sha256(e.sib) AS proof_sha256, e.fold AS folded_root, e.fold = r.h AS verified
        FROM l JOIN e ON e.g = l.g AND e.key = l.place AND e.last = 1 JOIN s ON s.g = l.g, (SELECT h FROM o WHERE n = 1) r""",
}
