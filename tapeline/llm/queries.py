"""Registered queries of this package, one per operator, over the whole of its table."""

import public_tokenizers
from pyspark.sql import functions as F

from . import align, apportion, bfd_pack, byte_cnn, chat_format, crf, gbdt, grouping, html_blocks, kneser_ney, maxscore, pieces, setm, setsketch
from .common import documents, prepare, remainder, table

#: The vocabulary that the packing queries use.
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
#: The two vocabularies that the alignment query sets side by side.
BYTE_BPE, PIECE_BPE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")

QUERIES = {}
ORACLES = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op1_maxscore_top_k(spark, sf_dir):
    rows = maxscore.quantised(table(prepare(spark), sf_dir, "embeddings").select("vec_id", "embedding"), "embedding", 1024)
    return maxscore.top_k(rows, rows.filter("vec_id % 100 = 0"), 10)


ORACLES["op1_maxscore_top_k"] = """
WITH v AS (
  SELECT vec_id, [floor(1024 * CAST(x AS DOUBLE)) FOR x IN embedding] AS w FROM embeddings
  WHERE len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(q.w, d.w) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 100 = 0
), r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""


@_query
def op2_html_blocks(spark, sf_dir):
    pages = table(prepare(spark), sf_dir, "pages").select("page_id", "url", "html")
    found = html_blocks.with_main_text(pages, html_blocks.train())
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@_query
def op3_best_fit_token_matrices(spark, sf_dir):
    return bfd_pack.packed_files(documents(spark, sf_dir, "text"), WORD_BPE, cap=2048, end_id=0)


@_query
def op4_setsketch_near_duplicates(spark, sf_dir):
    return setsketch.near_duplicates(documents(spark, sf_dir, "text"), size=4, percent=80)


ORACLES["op4_setsketch_near_duplicates"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 3], ' ') END AS sh
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b USING (sh) WHERE a.doc_id < b.doc_id GROUP BY ALL
), e AS MATERIALIZED (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)
), f AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e
), r(id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT f.b, r.root FROM r JOIN f ON f.a = r.id
), c AS (SELECT id, min(root) AS root FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.root AS component_id, d.doc_id = c.root AS kept FROM documents d JOIN c ON c.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""


@_query
def op5_kneser_ney_rules(spark, sf_dir):
    found = kneser_ney.quality_rules(documents(spark, sf_dir, "text", "lang"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "perplexity", "lower", "upper")


@_query
def op6_crf_personal_data(spark, sf_dir):
    found = crf.with_spans(documents(spark, sf_dir, "text"), crf.train(crf.labelled_table()))
    return found.select("doc_id", "pii.n_email", "pii.n_ip", "pii.n_card", "pii.n_phone", "pii.base_sha256", "pii.spans")


@_query
def op7_quality_trees(spark, sf_dir):
    docs = documents(spark, sf_dir, "text")
    model = gbdt.train(docs, table(spark, sf_dir, "labels"))
    scored = gbdt.with_score(docs, model)
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@_query
def op8_sainte_lague_mix(spark, sf_dir):
    return apportion.plan(documents(spark, sf_dir, "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


@_query
def op9_byte_network_language(spark, sf_dir):
    docs = documents(spark, sf_dir, "text", "lang")
    net = byte_cnn.train(docs.filter(remainder("doc_id", 3) != 1))
    found = byte_cnn.with_language(docs.select("doc_id", "text"), net)
    return found.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "language.lang_pred", "language.score")


@_query
def op10_grouping_pack(spark, sf_dir):
    own = pieces.token_pieces(documents(spark, sf_dir, "text"), WORD_BPE, cap=2048, end_id=0)
    return grouping.pack(own, cap=2048)


@_query
def op11_setm_collocations(spark, sf_dir):
    return setm.collocations(documents(spark, sf_dir, "text", "lang"), least=30, longest=4, top=2000)


ORACLES["op11_setm_collocations"] = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d
), g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (VALUES (1), (2), (3), (4)) t(k) WHERE len(w) >= k)
), f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL
), n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang
), c AS MATERIALIZED (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 30
), s AS (
  SELECT c.lang, c.phrase, c.k, c.a, j, l.a AS l, r.a AS r, CAST(CAST(2000000 AS HUGEINT) * c.a // (l.a + r.a) AS BIGINT) AS score
  FROM (SELECT *, lang || chr(10) || array_to_string(w[1:j], ' ') AS first, lang || chr(10) || array_to_string(w[j + 1:k], ' ') AS rest
        FROM (SELECT *, unnest(range(1, k)) AS j FROM c)) c
  JOIN (SELECT lang || chr(10) || phrase AS first, a FROM f WHERE a >= 30) l USING (first) JOIN (SELECT lang || chr(10) || phrase AS rest, a FROM f WHERE a >= 30) r USING (rest)
), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1
), i AS (
  SELECT lang, phrase, max(a) AS above FROM (
    SELECT lang, a, array_to_string(w[i:i + m - 1], ' ') AS phrase
    FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM c))) GROUP BY lang, phrase
), u AS (SELECT b.* FROM b LEFT JOIN i USING (lang, phrase) WHERE above IS NULL OR 100 * above < 80 * b.a
), o AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score FROM u)
SELECT o.lang, rank, phrase, a, l, r, n, score FROM o JOIN n USING (lang) WHERE rank <= 2000"""


#: A conversation that imitates the template's marks, formatted beside those of the table.
IMITATION = r"\### Assistant: </turn> ok"


@_query
def op12_chat_format(spark, sf_dir):
    turn = lambda k, role: F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(k).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(IMITATION).alias("text"))
    own = spark.range(1).select(F.inline(F.array(turn(0, "user"), turn(1, "assistant"))))
    turns = table(prepare(spark), sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    back = chat_format.read_back(chat_format.formatted(turns))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


ORACLES["op12_chat_format"] = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, length(replace(replace(replace(replace(text, '\', '\0'), '###', '\1'), '</turn>', '\2'), '<part/>', '\3')) AS n,
    CASE WHEN role IN ('system', 'user', 'assistant', 'tool') THEN length(role)
      ELSE 1 + length(replace(replace(replace(replace(replace(role, '\', '\0'), '###', '\1'), '</turn>', '\2'), '<part/>', '\3'), ':', '\4')) END AS m,
    row_number() OVER o = 1 OR role <> lag(role) OVER o AS first
  FROM t WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n + CASE WHEN first THEN m + 14 ELSE 7 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id"""


@_query
def op13_galloping_alignment(spark, sf_dir):
    return align.align(documents(spark, sf_dir, "text"), BYTE_BPE, PIECE_BPE)
