"""Registered queries, one per operator."""

from __future__ import annotations

from .registry import ORACLES, QUERIES, query, table  # noqa: F401


@query("op8_token_counts")
def op8_token_counts(spark, sf_dir):
    import public_tokenizers

    from .token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op10_best_fit_packing")
def op10_best_fit_packing(spark, sf_dir):
    import public_tokenizers

    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
hexed AS (
  SELECT page_id, body, sha1(encode(body)) AS sha, min(page_id) OVER (PARTITION BY sha1(encode(body))) AS first_id FROM p
),
bits AS (
  SELECT *, list_transform(range(0, 32), lambda i: (
      ('0x' || substr(sha || '00', 1 + (5 * i // 4)::INT, 2))::INT >> (8 - 5 - (5 * i % 4))::INT) & 31) AS digits
  FROM hexed
)
SELECT page_id, octet_length(encode(body))::BIGINT AS payload_bytes,
  array_to_string(list_transform(digits, lambda d: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', d + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM bits
"""


@query("op4_warc", OP4_SQL)
def op4_warc(spark, sf_dir):
    from pyspark.sql import functions as F

    from .warc import archive_folder, read_archives, write_archives

    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.col("html").cast("binary").alias("payload"))
    manifest = write_archives(pages, archive_folder(spark))
    return read_archives(manifest, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
),
e AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '###', '#\##'), '</turn>', '<\/turn>') AS esc,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS prev FROM t
),
g AS (
  SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum(length(CASE role WHEN 'system' THEN '### System: ' WHEN 'user' THEN '### User: ' ELSE '### Assistant: ' END)
        + length(esc) + length(' </turn>' || chr(10)))::BIGINT AS formatted_chars,
    bool_and(CASE role WHEN 'system' THEN prev IS NULL WHEN 'user' THEN prev IS NULL OR prev IN ('system', 'assistant')
             WHEN 'assistant' THEN coalesce(prev = 'user', false) ELSE false END)
      AND last(role ORDER BY turn, role, text) = 'assistant' AS is_valid
  FROM e GROUP BY conv_id
)
SELECT conv_id, n_turns, turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars, is_valid FROM g
"""


@query("op3_chat_format", OP3_SQL)
def op3_chat_format(spark, sf_dir):
    from .chat import digest, format_conversations

    said = r"\### Assistant: </turn> ok"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return digest(format_conversations(turns))


@query("op7_nearest_neighbours")
def op7_nearest_neighbours(spark, sf_dir):
    from .nearest import nearest

    return nearest(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 50 == 0)


@query("op9_near_duplicates")
def op9_near_duplicates(spark, sf_dir):
    from .near_dup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


@query("op5_language_id")
def op5_language_id(spark, sf_dir):
    from .language import identify_documents

    return identify_documents(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score", "spans")


@query("op1_decontamination")
def op1_decontamination(spark, sf_dir):
    from .decontaminate import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op6_quality")
def op6_quality(spark, sf_dir):
    from .quality import score_quality

    return score_quality(table(spark, sf_dir, "documents"))


@query("op2_secret_scan")
def op2_secret_scan(spark, sf_dir):
    from pyspark.sql import functions as F

    from .secrets import scan

    found = scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "word_at", F.sha2("value", 256).alias("value_sha256"), "probability", "is_secret")


OP11_SQL = r"""
WITH RECURSIVE runs AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents
),
low AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS n FROM runs GROUP BY ALL
),
-- Bytes of the UTF-8 text; behind each byte eight steps of the checksum, marked by -1.
steps AS (
  SELECT w, n, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || w, ''), lambda c: CASE
      WHEN unicode(c) < 128 THEN [unicode(c), -1, -1, -1, -1, -1, -1, -1, -1]::BIGINT[]
      ELSE [192 + (unicode(c) >> 6), -1, -1, -1, -1, -1, -1, -1, -1, 128 + (unicode(c) & 63), -1, -1, -1, -1, -1, -1, -1, -1]::BIGINT[] END)) AS s
  FROM low
),
sums AS (
  SELECT w, n, xor(list_reduce(list_prepend(4294967295::BIGINT, s), lambda c, x: CASE
      WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295) AS h FROM steps
),
typed AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, n FROM sums
),
vocab AS (SELECT word, sum(n)::BIGINT AS n FROM typed WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
-- Every word without each of its code points in turn.
less AS (SELECT word, n, p, substr(word, 1, p::INT) || substr(word, p::INT + 2) AS part FROM (SELECT *, unnest(range(length(word))) AS p FROM vocab)),
pairs AS (
  SELECT a.word, b.word AS other, b.n AS m FROM less a JOIN less b ON a.part = b.part AND a.p = b.p AND a.word <> b.word
  UNION SELECT a.word, v.word, v.n FROM less a JOIN vocab v ON a.part = v.word
  UNION SELECT v.word, a.word, a.n FROM less a JOIN vocab v ON a.part = v.word
),
near AS (SELECT word, count(*) AS n_near, min((-m, other)) AS best FROM pairs GROUP BY word),
forms AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best[1] >= 2 * v.n THEN best[2] END AS form,
    CASE WHEN -best[1] >= 2 * v.n THEN -best[1] END AS form_n FROM vocab v LEFT JOIN near USING (word)
),
walk AS (
  SELECT word, word AS at FROM forms
  UNION ALL SELECT walk.word, forms.form FROM walk JOIN forms ON walk.at = forms.word WHERE forms.form IS NOT NULL
)
SELECT f.word, f.form, r.root, f.n, f.n_near::BIGINT AS n_near, f.form_n::BIGINT AS form_n
FROM forms f JOIN (SELECT walk.word, walk.at AS root FROM walk JOIN forms ON walk.at = forms.word WHERE forms.form IS NULL) r USING (word)
"""


@query("op11_spelling_variants", OP11_SQL)
def op11_spelling_variants(spark, sf_dir):
    from .variants import spelling_variants, vocabulary

    return spelling_variants(vocabulary(table(spark, sf_dir, "documents")))


# Steps of a checksum over ASCII text: each byte, then eight shifts, marked by -1.
_CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split({0}, ''),
    lambda c: [unicode(c), -1, -1, -1, -1, -1, -1, -1, -1]::BIGINT[]))),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295)"""


def _least(*options: str) -> str:
    return f"list_sort([{', '.join(options)}])[1]"


def _paid(cost: str, initials: str, rest: str) -> str:
    return f"{{'c': {rest}.c + {cost}, 's': '{initials}' || {rest}.s}}"


def _row_sql(q: int) -> str:
    """Cheapest edits from the row on, from state q (start, behind system, user, assistant), if the row itself comes first."""
    behind = (2, 2, 3, 2)[q]
    kept = {0: [("s", 1), ("u", 2)], 1: [("u", 2)], 2: [("a", 3)], 3: [("u", 2)]}[q]
    keep = [_paid(f"(CASE WHEN NOT gone AND initial = '{c}' THEN cut ELSE 1000000 END)", "K", f"v{k}") for c, k in kept]
    rerole = _paid("(CASE WHEN gone THEN 1000000 ELSE 2 + cut END)", "R", f"v{behind}")
    return _least(_paid("3", "D", f"v{q}"), rerole, *keep)


OP12_SQL = f"""
WITH RECURSIVE ids AS (SELECT DISTINCT conv_id, coalesce(conv_id::VARCHAR, ' ') AS conv FROM conversations),
hashed AS (
  SELECT coalesce(conv_id::VARCHAR, ' ') AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_CRC32.format("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind FROM conversations
),
damaged AS (
  SELECT conv, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM hashed WHERE kind <> 0
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, left(text, 256), md5(text)) AS i,
    left(role, 1) AS initial, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM damaged
),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv, role, text ORDER BY i) AS nth, lag(initial) OVER (PARTITION BY conv ORDER BY i) AS before FROM placed),
marked AS (
  SELECT *, body = '' AS blank, body <> '' AND nth > 1 AS duplicate, body <> '' AND nth = 1 AND right(body, 1) NOT IN ('.', '!', '?') AS truncated,
    body = '' OR nth > 1 AS gone, CASE WHEN right(body, 1) IN ('.', '!', '?') THEN 0 ELSE 1 END AS cut FROM seen
),
-- From the last row to the first: the least (cost, initials) from each state.
walk AS (
  SELECT conv, max(i) + 1 AS i, {{'c': 0, 's': ''}} AS v0, {{'c': 4, 's': 'II'}} AS v1, {{'c': 2, 's': 'I'}} AS v2, {{'c': 0, 's': ''}} AS v3 FROM placed GROUP BY conv
  UNION ALL
  SELECT conv, i, {_least("r0", _paid("2", "I", "r2"), _paid("4", "II", "r3"))} AS v0, {_least("r1", _paid("2", "I", "r2"), _paid("4", "II", "r3"))} AS v1,
    {_least("r2", _paid("2", "I", "r3"))} AS v2, {_least("r3", _paid("2", "I", "r2"))} AS v3
  FROM (SELECT w.conv, m.i, {", ".join(f"{_row_sql(q)} AS r{q}" for q in range(4))} FROM walk w JOIN marked m ON m.conv = w.conv AND m.i = w.i - 1) x
),
edits AS (SELECT conv, v0.c AS cost, v0.s AS audit FROM walk WHERE i = 1),
ops AS (SELECT conv, unnest(string_split(audit, '')) AS op, generate_subscripts(string_split(audit, ''), 1) AS j FROM edits WHERE audit <> ''),
counted AS (
  SELECT *, count(*) FILTER (op <> 'I') OVER (PARTITION BY conv ORDER BY j) AS i, count(*) FILTER (op <> 'D') OVER (PARTITION BY conv ORDER BY j) AS o FROM ops
),
made AS (
  SELECT c.conv, c.j, c.o, c.op, m.role, CASE WHEN c.op = 'I' THEN '' ELSE m.text END AS text,
    max(CASE WHEN c.o = 1 AND c.op = 'K' AND m.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY c.conv) AS led
  FROM counted c LEFT JOIN marked m ON m.conv = c.conv AND m.i = c.i AND c.op <> 'I' WHERE c.op <> 'D'
),
repaired AS (
  SELECT conv, sha256(string_agg(CASE WHEN op = 'K' THEN role WHEN (o - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY j)) AS h
  FROM made GROUP BY conv
),
totals AS (
  SELECT conv, CASE WHEN count(turn) = 0 THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM marked GROUP BY conv
)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM ids LEFT JOIN totals USING (conv) LEFT JOIN edits USING (conv) LEFT JOIN repaired USING (conv)
"""


@query("op12_conversation_repair", OP12_SQL)
def op12_conversation_repair(spark, sf_dir):
    from pyspark.sql import functions as F

    from .repair import damage, repair_report

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    ids = turns.select("conv_id", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("conv")).distinct()
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    found = repair_report(damage(turns)).withColumn("has_rows", F.lit(True))
    filled = [F.when(F.col("has_rows"), F.col(c)).otherwise(F.lit(0)).cast("long").alias(c) for c in numbers]
    no_rows = F.sha2(F.lit(""), 256)
    return ids.join(found, "conv", "left").select(
        "conv_id", *filled, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", no_rows).alias("repaired_sha256")
    )


@query("op13_sharding")
def op13_sharding(spark, sf_dir):
    from pyspark.sql import functions as F

    from .sharding import shard_documents

    found = shard_documents(table(spark, sf_dir, "documents"))
    law, grown = F.lit("rows").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return found.select("doc_id", "size", "text_crc32", law, "shard", "slot", grown)
