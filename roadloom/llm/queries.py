"""One query for each operator, over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from roadloom.llm import alignment, binary, bpe, chat, dedup, hamming, jaccard, langid, lengths, lexical, maintext, mixing, sharding
from roadloom.llm.store import shared_folder, stored, table

WORD_BPE, BYTE_BPE, PIECE_BPE, END = "word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model", 2


def op1_hamming_topk(spark, sf_dir):
    """The 10 nearest of every vector whose id is divisible by 100."""
    rows = table(spark, sf_dir, "embeddings")
    return hamming.top_k(rows, rows.where("vec_id % 100 = 0"), dims=64, k=10)


def op2_ngram_jaccard(spark, sf_dir):
    found = jaccard.components_of(table(spark, sf_dir, "documents"), k=4, percent=85)
    return found.select("doc_id", "n_shingles", "component_id")


def op3_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op4_exact_dedup(spark, sf_dir):
    return dedup.copies(table(spark, sf_dir, "documents")).drop("row_tag")


def op5_bpe(spark, sf_dir):
    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op6_chat_format(spark, sf_dir):
    both = "</s>[INST] ok [/INST]"
    planted = spark.sql(f"SELECT -1L conv_id, t turn, r role, '{both}' text FROM VALUES (0L, 'user'), (1L, 'assistant') AS v(t, r)")
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(planted)
    read = chat.read_back(chat.format_chats(chats))
    said = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op7_token_counts(spark, sf_dir):
    """The histogram of lengths, with what the usual context limits keep and where the quantiles are."""
    counts = lengths.counted(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))
    return lengths.histogram(counts, limits=[1 << i for i in range(7, 21)], shares=[0.0, 0.25, 0.5, 0.75, 0.9, 0.99, 0.999, 1.0])


def op8_binary_tokens(spark, sf_dir):
    import uuid

    path = f"{shared_folder(spark)}/ids-{uuid.uuid4().hex}"
    binary.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path(BYTE_BPE), END)
    return binary.read(spark, path, with_ids=False).drop("ids")


def op9_main_text(spark, sf_dir):
    return maintext.extract(table(spark, sf_dir, "pages"))


def op10_source_mix(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_alignment(spark, sf_dir):
    return alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), public_tokenizers.path(PIECE_BPE))


def op12_virtual_slots(spark, sf_dir):
    """8 shards under the law `bytes`: the first map deals the slots in turn, the second is edited by the bytes in each slot."""
    import uuid

    found = stored(sharding.records(table(spark, sf_dir, "documents")), "records")
    maps = f"{shared_folder(spark)}/slot-map-{uuid.uuid4().hex}"
    sharding.save(sharding.first_map(spark, 8), maps)
    sharding.save(sharding.rebalanced(sharding.load(spark, maps), sharding.loads(found), 8), maps)
    rows = sharding.assigned(found, sharding.load(spark, maps))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")


def op13_lexical_search(spark, sf_dir):
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op1_hamming_topk, op2_ngram_jaccard, op3_language_id, op4_exact_dedup, op5_bpe, op6_chat_format, op7_token_counts, op8_binary_tokens, op9_main_text, op10_source_mix, op11_alignment, op12_virtual_slots, op13_lexical_search)}

_WHITE = r"[\x20\x09-\x0D]"
ORACLE = {
    "op1_hamming_topk": """
        WITH codes AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: x >= 0) AS c FROM embeddings),
        pairs AS (SELECT q.vec_id AS query_id, r.vec_id AS neighbor_id,
                         list_sum(list_transform(list_zip(q.c, r.c), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END))::BIGINT AS distance
                  FROM codes q JOIN codes r ON q.vec_id % 100 = 0 AND q.vec_id <> r.vec_id)
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id)::INTEGER AS rank, neighbor_id, distance
        FROM pairs QUALIFY rank <= 10""",
    "op2_ngram_jaccard": r"""
        WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                 ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM words),
        each AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
        pairs AS (SELECT a.doc_id AS x, b.doc_id AS y FROM each a JOIN each b ON a.g = b.g AND a.doc_id <> b.doc_id
                  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
        reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, p.y FROM reach r JOIN pairs p ON r.y = p.x)
        SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r.y) AS component_id FROM sets s JOIN reach r ON s.doc_id = r.x GROUP BY s.doc_id, s.s""",
    "op4_exact_dedup": rf"""
        WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS points, sha256(regexp_replace(coalesce(text, ''), '{_WHITE}', '', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
               doc_id = first_value(doc_id) OVER w AS kept, text_sha256
        FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id)""",
    "op6_chat_format": r"""
        WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                      UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
        cut AS (SELECT *, contains(text, '</s>') OR regexp_matches(text, '[<\[]\\+/?(s>|INST\]|ROLE\])') AS bad_text,
                       contains(role, '</s>') OR contains(role, '[/ROLE]') OR regexp_matches(role, '[<\[]\\+/?(s>|INST\]|ROLE\])') AS bad_role FROM rows),
        sized AS (SELECT *, length(role) + length(text) + 9 + 7 + 4
                         + CASE WHEN bad_text THEN len(regexp_extract_all(text, '[<\[]\\*/?(?:s>|INST\]|ROLE\])')) ELSE 0 END
                         + CASE WHEN bad_role THEN len(regexp_extract_all(role, '[<\[]\\*/?(?:s>|INST\]|ROLE\])')) ELSE 0 END AS chars FROM cut),
        made AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
                        coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss, sum(chars)::BIGINT AS formatted_chars
                 FROM sized GROUP BY conv_id)
        SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM made""",
    "op13_lexical_search": r"""
        WITH low AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS big, 'abcdefghijklmnopqrstuvwxyz' AS small),
        d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), big, small), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents, low),
        q AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), big, small), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark), low),
        asked AS (SELECT item_id, term, count(*) AS times FROM q GROUP BY ALL),
        whole AS (SELECT count(*) FILTER (len(terms) > 0) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d),
        cells AS (SELECT row, doc_id, len(terms) AS n, term, count(*) AS tf FROM (SELECT row, doc_id, terms, unnest(terms) AS term FROM d) GROUP BY row, doc_id, terms, term),
        known AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM cells, whole GROUP BY term, n_docs),
        gains AS (SELECT row, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))) AS gain FROM cells JOIN known USING (term), whole),
        scores AS (SELECT item_id, row, doc_id, sum(times * gain)::BIGINT AS score FROM asked JOIN gains USING (term) GROUP BY item_id, row, doc_id)
        SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
        FROM scores WHERE score > 0 QUALIFY rank <= 10""",
}
