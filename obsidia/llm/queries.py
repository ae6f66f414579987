"""The registered queries of the corpus operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsidia.llm import chat, codes, common, languages, middle, packing, pieces, rules, simhash, subword, suffixes, tokens, topk

#: Appended to each document's ids.
END_ID = 1


def tokenizer_path(name: str) -> str:
    """Where a vocabulary file lies: in the folder OBSIDIA_TOKENIZERS if that is set, else where the public package has it."""
    if folder := os.environ.get("OBSIDIA_TOKENIZERS"):
        return f"{folder}/{name}"
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = tokens.write_records(common.documents(spark, sf_dir), common.scratch(spark, "records"), tokenizer_path("word_bpe_49k.json"), END_ID)
    return tokens.read_records(manifest, with_ids=False)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Besides what goes, the bytes in repeats of 250 or more: about 50 words of short ones."""
    return suffixes.digests(common.documents(spark, sf_dir), 400, shorter=250)


def op3_simhash_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(common.documents(spark, sf_dir), width=4, radius=4)


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subword.classify(common.documents(spark, sf_dir), _labels(spark, sf_dir), "toxic", subword.TOXICITY, 0.5)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subword.classify(common.documents(spark, sf_dir), _labels(spark, sf_dir), "quality", subword.QUALITY, 0.3)


def op6_uniform_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), 10)


def op7_concat_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"), END_ID, 2048, with_ids=False)


def op8_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans as text, so that any engine compares them alike."""
    found = chat.preferences(*chat.swapped(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    shown = [F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"], s["end"])), ",").alias(c) for c in ("chosen_spans", "rejected_spans")]
    return found.select("pair_id", "prompt_turns", "prompt", "chosen", "rejected", *shown)


def op9_weak_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(common.documents(spark, sf_dir))


def op10_prefix_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_decode(common.documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"), digests=True)


def op11_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    return languages.identify(docs, languages.fit(docs))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return middle.digests(common.documents(spark, sf_dir))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.with_labels(*codes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_token_records, op2_suffix_dedup, op3_simhash_ball, op4_toxicity, op5_quality, op6_uniform_threshold, op7_concat_cut, op8_preferences, op9_weak_rules, op10_prefix_table, op11_language_crf, op12_fill_in_middle, op13_vector_codes)
    return {f.__name__: f for f in found}


_OP6 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0))) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

_OP8 = r"""
WITH a AS (SELECT conv_id AS conv, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos,
    coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv, max_by(text, pos) AS last_text, max(pos) AS last_at FROM a WHERE role = 'assistant' GROUP BY conv),
n AS (SELECT conv, last_at, coalesce(lead(conv) OVER (ORDER BY conv), min(conv) OVER ()) AS next FROM l),
p AS (SELECT n.conv, n.last_at, o.last_text AS other FROM n JOIN l o ON o.conv = n.next WHERE n.next <> n.conv),
t AS (SELECT a.conv AS pair_id, a.pos, a.role, a.text AS c, CASE WHEN a.pos = p.last_at THEN p.other ELSE a.text END AS r, p.last_at FROM a JOIN p ON a.conv = p.conv WHERE a.pos <= p.last_at),
s AS (SELECT pair_id, coalesce(min(CASE WHEN c <> r THEN pos END), max(pos) + 1) AS split FROM t GROUP BY pair_id),
x AS (SELECT t.*, s.split, '<|' || role || '|>' || chr(10) || c || chr(10) || '<|end|>' || chr(10) AS cs, '<|' || role || '|>' || chr(10) || r || chr(10) || '<|end|>' || chr(10) AS rs FROM t JOIN s USING (pair_id)),
y AS (SELECT *, CASE WHEN pos >= split THEN coalesce(sum(CASE WHEN pos >= split THEN length(cs) END) OVER w, 0) - length(cs) END AS cb,
    CASE WHEN pos >= split THEN coalesce(sum(CASE WHEN pos >= split THEN length(rs) END) OVER w, 0) - length(rs) END AS rb FROM x WINDOW w AS (PARTITION BY pair_id ORDER BY pos))
SELECT pair_id, CAST(max(split) AS BIGINT) AS prompt_turns,
  coalesce(string_agg(CASE WHEN pos < split THEN cs END, '' ORDER BY pos), '') AS prompt,
  coalesce(string_agg(CASE WHEN pos >= split THEN cs END, '' ORDER BY pos), '') AS chosen,
  coalesce(string_agg(CASE WHEN pos >= split THEN rs END, '' ORDER BY pos), '') AS rejected,
  coalesce(string_agg(CASE WHEN pos >= split AND role = 'assistant' THEN CAST(cb + 5 + length(role) AS VARCHAR) || '-' || CAST(cb + 5 + length(role) + length(c) AS VARCHAR) END, ',' ORDER BY pos), '') AS chosen_spans,
  coalesce(string_agg(CASE WHEN pos >= split AND role = 'assistant' THEN CAST(rb + 5 + length(role) AS VARCHAR) || '-' || CAST(rb + 5 + length(role) + length(r) AS VARCHAR) END, ',' ORDER BY pos), '') AS rejected_spans
FROM y GROUP BY pair_id
"""


_OP12 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS units, list_transform(range(4), lambda i: CAST('0x' || substr(h, 1 + 8 * i, 8) AS BIGINT)) AS r FROM d),
c AS (SELECT *, len(units) AS n, least(r[1] % (len(units) + 1), r[2] % (len(units) + 1)) AS a, greatest(r[1] % (len(units) + 1), r[2] % (len(units) + 1)) AS b FROM u),
p AS (SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR r[3] % 100 >= 100 THEN 'plain' WHEN r[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p
"""


def _op13() -> str:
    """A round after the other: each vector's nearest entry of each part, then the entries' floors of means."""
    far = "list_sum(list_transform(list_zip(v.x, b.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    coded = "SELECT v.vec_id, v.label, v.part, min(struct_pack(far := CAST({far} AS BIGINT), entry := b.entry)) AS best FROM v JOIN b{i} b ON v.part = b.part GROUP BY ALL"
    moved = """m{i} AS MATERIALIZED (SELECT part, entry, list(x ORDER BY d) AS x FROM (SELECT v.part, c.best.entry AS entry, d, CAST(floor(sum(v.x[d]) / count(*)) AS BIGINT) AS x
        FROM c{i} c JOIN v ON v.vec_id = c.vec_id AND v.part = c.part, range(1, 1 + len(v.x)) t(d) GROUP BY ALL) GROUP BY ALL),
      b{n} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM b{i} b LEFT JOIN m{i} m ON m.part = b.part AND m.entry = b.entry)"""
    steps = [f"c{i} AS MATERIALIZED ({coded.format(far=far, i=i)})" + (f", {moved.format(i=i, n=i + 1)}" if i < 2 else "") for i in range(3)]
    return f"""
WITH w AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
v AS MATERIALIZED (SELECT vec_id, label, part, x[part * len(x) // 16 + 1:(part + 1) * len(x) // 16] AS x FROM w, range(16) t(part)),
b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x FROM v QUALIFY row_number() OVER (PARTITION BY part ORDER BY vec_id) <= 64),
{", ".join(steps)},
e AS (SELECT vec_id, label, string_agg(lpad(printf('%x', best.entry), 2, '0'), '' ORDER BY part) AS code, CAST(sum(best.far) AS BIGINT) AS error FROM c2 GROUP BY ALL),
k AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, d)) AS h FROM (SELECT part, entry, unnest(x) AS x, unnest(range(len(x))) AS d FROM b2))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, k.h AS codebooks_sha256 FROM e, k
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_uniform_threshold": _OP6, "op8_preferences": _OP8, "op12_fill_in_middle": _OP12, "op13_vector_codes": _op13()}
