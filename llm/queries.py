"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from llm import toxicity
from llm.decontamination import contained
from llm.fill_in_middle import fill_in_middle, restored
from llm.fingerprints import edited_fingerprints
from llm.html_text import main_text
from llm.line_dedup import dedup_lines
from llm.mixing import mix
from llm.near_duplicates import near_duplicates
from llm.registry import query, table
from llm.secrets import BASE, joined_spans, ledgered_report
from llm.simhash_near import simhash_groups
from llm.substring_dedup import remove_repeats
from llm.token_counts import token_counts
from llm.vector_codes import vector_codes


@query("op5_minhash_near_dedup")
def op5(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


@query("op9_substring_dedup")
def op9(spark, sf_dir):
    out = remove_repeats(table(spark, sf_dir, "documents"), width=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query("op2_line_dedup")
def op2(spark, sf_dir):
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


@query("op1_mixing")
def op1(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents"))


#: Containment of five-word shingles, counted in full.
CONTAINED_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
s AS (SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS shingle
      FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM (SELECT item_id, w, least(5, len(w)) AS k FROM i WHERE len(w) > 0))),
n AS (SELECT item_id, count(*) AS n_item FROM s GROUP BY item_id),
t AS (SELECT DISTINCT doc_id, k, array_to_string(w[p:p + k - 1], ' ') AS shingle
      FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM s) WHERE len(w) >= k))
SELECT doc_id, item_id, n_item, count(*) AS n_shared FROM s JOIN t USING (k, shingle) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n_item HAVING 100 * count(*) >= 80 * n_item"""


@query("op3_decontamination", CONTAINED_SQL)
def op3(spark, sf_dir):
    return contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op10_secret_scan")
def op10(spark, sf_dir):
    out, _, _ = ledgered_report(table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda x: x["kind"].isin(*BASE))

    def number(kind: str):
        return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [number(kind) for kind in BASE]
    return out.select("doc_id", *counts, F.sha2(joined_spans(base), 256).alias("base_sha256"), joined_spans(F.col("found")).alias("spans"))


@query("op7_document_fingerprints")
def op7(spark, sf_dir):
    return edited_fingerprints(table(spark, sf_dir, "documents"))


def held_out(key: str = "doc_id"):
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))


def toxicity_scores(spark, sf_dir, docs):
    labels = table(spark, sf_dir, "labels").where(~held_out())
    return toxicity.score(docs, toxicity.fit(table(spark, sf_dir, "documents"), labels))


@query("op8_toxicity")
def op8(spark, sf_dir):
    out = toxicity_scores(spark, sf_dir, table(spark, sf_dir, "documents"))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")


@query("op4_html_extraction")
def op4(spark, sf_dir):
    return main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


@query("op6_token_counts")
def op6(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents"))


#: The same cuts on lists of tokens.
MIDDLE_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w, sha256('1:' || doc_id) AS s FROM documents),
h AS (SELECT doc_id, text, w, len(w) AS n, ('0x' || substr(s, 1, 8))::BIGINT AS h1, ('0x' || substr(s, 9, 8))::BIGINT AS h2,
             ('0x' || substr(s, 17, 8))::BIGINT AS h3, ('0x' || substr(s, 25, 8))::BIGINT AS h4 FROM t),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM h),
p AS (SELECT doc_id, n, text,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                  WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
             array_to_string(list_slice(w, 1, a), '') AS prefix, array_to_string(list_slice(w, a + 1, b), '') AS middle,
             array_to_string(list_slice(w, b + 1, n), '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256 FROM p"""


@query("op11_fill_in_middle", MIDDLE_SQL)
def op11(spark, sf_dir):
    out = fill_in_middle(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


@query("op12_simhash_near_dedup")
def op12(spark, sf_dir):
    return simhash_groups(table(spark, sf_dir, "documents"))


#: A round of the codebooks: nearest entries, then the floors of their means; ``b`` is the codebook before, ``c`` the one after.
_ROUND_SQL = """
m{b} AS (SELECT r, part, any_value(q) AS q, min({{'d': list_sum([(y - z[i]) * (y - z[i]) FOR y, i IN q])::BIGINT, 'e': entry}}) AS best
         FROM p JOIN c{b} USING (part) GROUP BY r, part),
s{b} AS (SELECT part, entry, list(floor(total / n)::BIGINT ORDER BY i) AS new FROM (
           SELECT part, best.e AS entry, i, sum(q[i])::DOUBLE AS total, count(*) AS n FROM m{b}, (SELECT unnest(range(1, w + 1)) AS i FROM d) GROUP BY ALL) GROUP BY part, entry),
c{c} AS (SELECT part, entry, coalesce(new, z) AS z FROM c{b} LEFT JOIN s{b} USING (part, entry)),"""

CODES_SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, label, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS x FROM embeddings
           WHERE len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
d AS (SELECT max(len(x)) // 16 AS w FROM v),
p AS (SELECT r, part, list_slice(x, part * w + 1, part * w + w) AS q FROM v, d, (SELECT unnest(range(16)) AS part)),
c0 AS (SELECT part, k - 1 AS entry, q AS z FROM (SELECT r, row_number() OVER (ORDER BY vec_id, x) AS k FROM v) JOIN p USING (r) WHERE k <= 64),""" + "".join(
    _ROUND_SQL.format(b=k, c=k + 1) for k in range(2)) + """
f AS (SELECT r, part, min({'d': list_sum([(y - z[i]) * (y - z[i]) FOR y, i IN q])::BIGINT, 'e': entry}) AS best FROM p JOIN c2 USING (part) GROUP BY r, part),
g AS (SELECT r, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM f GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       sha256((SELECT string_agg(array_to_string(z, ','), ',' ORDER BY part, entry) FROM c2)) AS codebooks_sha256 FROM g JOIN v USING (r)"""


@query("op13_vector_codes", CODES_SQL)
def op13(spark, sf_dir):
    return vector_codes(table(spark, sf_dir, "embeddings"))
