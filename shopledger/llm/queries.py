"""One query per operator over the whole given tables, with the production parameters, and its SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import alignment, bpe, classifier, conversations, decontamination, embeddings, minhash, mixing, quality_rules, secrets, token_files, urls, warc
from .common import table

#: Where the public vocabularies lie.
TOKENIZERS = Path(public_tokenizers.path("byte_bpe_50k.json")).parent

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]):
    QUERIES[function.__name__] = function
    return function


@query
def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Base counts and verdict of every document; the trusted target is the documents labelled as good."""
    trusted = table(spark, folder, "labels").where("quality = 1")
    return quality_rules.judge(table(spark, folder, "documents"), trusted)


@query
def op2_minhash(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of documents that share four-word shingles."""
    return minhash.near_duplicates(table(spark, folder, "documents"), size=4)


ORACLE["op2_minhash"] = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
shingled AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS shingle
  FROM worded WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingled GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common
  FROM shingled a JOIN shingled b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * common >= 80 * (p.n + q.n - common)),
reach AS (
  SELECT doc_id AS start, doc_id AS at FROM documents
  UNION
  SELECT r.start, CASE WHEN l.x = r.at THEN l.y ELSE l.x END FROM reach r JOIN links l ON r.at IN (l.x, l.y))
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, min(r.at) AS component_id, d.doc_id = min(r.at) AS kept
FROM documents d JOIN reach r ON r.start = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
GROUP BY d.doc_id, s.n
"""


@query
def op3_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Quality score of every document, learned from the labels outside the held-out fold."""
    documents = table(spark, folder, "documents")
    return classifier.score(documents, classifier.fit(documents, table(spark, folder, "labels")))


@query
def op4_urls(spark: SparkSession, folder: str) -> DataFrame:
    """Host, path, rule and verdict of every page's URL."""
    return urls.judge(table(spark, folder, "pages"))


@query
def op5_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Place, number and checksum of the token ids of every document, as read back from the files."""
    found = token_files.filed(table(spark, folder, "documents"), str(TOKENIZERS / "byte_bpe_50k.json"))
    return found.select(
        "doc_id", "start", (F.length("ids") / 4).cast("bigint").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )


@query
def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    """The WARC records of all pages, converted from ARC records, as read back from the files."""
    found = warc.archived(table(spark, folder, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE["op6_warc"] = r"""
WITH paid AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS payload_digest FROM pages),
sized AS (SELECT *, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes FROM paid),
firsts AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY html) ELSE page_id END AS first FROM sized)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM firsts
"""


@query
def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Size, target and taken words of every document in the mix."""
    mixed = mixing.mix(table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("shards")).alias("taken"))


ORACLE["op7_mixing"] = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
sources AS (
  SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS source_no
  FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE source_no % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS cap FROM sources),
rising AS (
  SELECT *, row_number() OVER up AS place,
    CAST(sum(source_size) OVER () - sum(cap) OVER up + cap AS DOUBLE) / (sum(weight) OVER () - sum(weight) OVER up + weight)
      AS level
  FROM weighed
  WINDOW up AS (ORDER BY CAST(source_size AS DOUBLE) / weight, source_no)),
opened AS (SELECT place, level FROM rising WHERE NOT weight * level > cap ORDER BY place LIMIT 1),
targets AS (
  SELECT source, source_no, CAST(source_size AS BIGINT) AS source_size,
    CASE WHEN r.place < o.place THEN CAST(cap AS DOUBLE) ELSE weight * o.level END AS target
  FROM rising r, opened o),
planned AS (
  SELECT *, least(3, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END) AS passes,
    greatest(1, least(4096, CAST(ceil(source_size / 100000) AS BIGINT))) AS blocks
  FROM targets),
keyed AS (
  SELECT d.doc_id, d.size, p.*, target - passes * source_size AS extra,
    md5('mix:doc:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')) AS key
  FROM sized d JOIN planned p ON d.source IS NOT DISTINCT FROM p.source),
placed AS (SELECT *, CAST('0x' || left(key, 8) AS BIGINT) % blocks AS block FROM keyed),
per_block AS (
  SELECT source_no, block, sum(size) AS block_size, any_value(extra) AS extra FROM placed GROUP BY source_no, block),
rooms AS (
  SELECT *, extra - (sum(block_size) OVER (PARTITION BY source_no
    ORDER BY md5('mix:block:' || source_no || ':' || block)) - block_size) AS room FROM per_block),
ends AS (
  SELECT p.*, r.room, r.room > 0 AND r.room < r.block_size AS part,
    sum(p.size) OVER (PARTITION BY p.source_no, p.block ORDER BY p.key, p.doc_id, p.size ROWS UNBOUNDED PRECEDING) AS done
  FROM placed p JOIN rooms r ON p.source_no = r.source_no AND p.block = r.block),
gaps AS (
  SELECT *, done <= room AS fits,
    room - coalesce(max(CASE WHEN done <= room THEN done END) OVER (PARTITION BY source_no, block), 0) AS gap FROM ends),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source_no, block ORDER BY fits, abs(gap - size), key, doc_id, size) AS best
  FROM gaps)
SELECT doc_id, size, source_size, target,
  CAST(size * (passes + CASE WHEN part THEN CASE WHEN fits OR best = 1 AND abs(gap - size) < gap THEN 1 ELSE 0 END
    WHEN room > 0 THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM ranked
"""


@query
def op8_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets in every document."""
    return secrets.scan(table(spark, folder, "documents"))


#: Places follow from the lengths of matches and of what lies between them.
ORACLE["op8_secret_scan"] = r"""
WITH rules(k, kind, pattern, least) AS (VALUES
  (0, 'assign', '(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 6),
  (1, 'access', 'AKIA[A-Z0-9]+', 20), (2, 'hex', '[0-9a-f]+', 24), (3, 'github', 'gh[pousr]_[A-Za-z0-9]+', 40),
  (4, 'jwt', 'eyJ[A-Za-z0-9_-][A-Za-z0-9_.-]*', 30),
  (5, 'pem', '(?s)-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----(?:.*?-----END.*?-----)?', 0)),
matched AS (
  SELECT doc_id, k, kind, least, regexp_extract_all(coalesce(text, ''), pattern) AS hits, string_split_regex(coalesce(text, ''), pattern) AS gaps,
    CASE k WHEN 0 THEN regexp_extract_all(coalesce(text, ''), pattern, 1) ELSE hits END AS contents
  FROM documents, rules),
single AS (
  SELECT doc_id, k, kind, least, unnest(hits) AS hit, unnest(gaps[:len(hits)]) AS gap, unnest(contents) AS content, generate_subscripts(hits, 1) AS i FROM matched),
placed AS (SELECT *, sum(len(gap) + len(hit)) OVER (PARTITION BY doc_id, k ORDER BY i) AS stop FROM single),
spans AS (
  SELECT doc_id, k, stop - len(hit) AS start, kind || ':' || (stop - len(hit)) || ':' || stop AS span FROM placed
  WHERE len(content) >= least AND (k <> 4 OR len(hit) - len(replace(hit, '.', '')) = 2)),
joined AS (
  SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
    string_agg(span, ',' ORDER BY start, k) FILTER (k < 3) AS base, string_agg(span, ',' ORDER BY start, k) AS spans
  FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN joined USING (doc_id)
"""


@query
def op9_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Number and hashes of the token ids of every document, and the hash of the text decoded from them."""
    coded = bpe.encode(table(spark, folder, "documents"), str(TOKENIZERS / "word_bpe_49k.json"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op10_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of vectors of equal labels with a cosine of 0.93 or more."""
    return embeddings.near_duplicates(table(spark, folder, "embeddings"))


ORACLE["op10_embeddings"] = r"""
WITH RECURSIVE vectors AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda v: v IS NOT NULL AND isfinite(v)))
    AND list_bool_or(list_transform(embedding, lambda v: v <> 0))),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM vectors a JOIN vectors b
    ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (
  SELECT vec_id AS start, vec_id AS here FROM embeddings
  UNION
  SELECT r.start, l.y FROM reach r JOIN links l ON r.here = l.x),
smallest AS (SELECT start, min(here) AS component_id FROM reach GROUP BY start),
direct AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT e.vec_id, coalesce(d.n, 0) AS n_links, s.component_id, e.vec_id = s.component_id AS kept
FROM embeddings e JOIN smallest s ON s.start = e.vec_id LEFT JOIN direct d ON d.x = e.vec_id
"""


@query
def op11_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Words and items of the benchmark in every document."""
    found = decontamination.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


ORACLE["op11_decontamination"] = r"""
WITH split AS (
  SELECT 0 AS side, row_number() OVER () AS r, doc_id AS id, text FROM documents UNION ALL
  SELECT 1, row_number() OVER (), item_id, text FROM benchmark),
worded AS (
  SELECT side, r, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM split),
lengths AS (SELECT DISTINCT least(len(w), 10) AS n FROM worded WHERE side = 1 AND len(w) > 0),
windows AS (
  SELECT side, r, id, n, unnest(range(1, len(w) - n + 2)) AS begins, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS passage
  FROM worded, lengths WHERE len(w) >= n AND (side = 0 OR n = least(len(w), 10))),
items AS (SELECT DISTINCT coalesce(CAST(id AS VARCHAR), 'null') AS item, n, passage FROM windows WHERE side = 1),
places AS (
  SELECT r, count(DISTINCT place) AS n_hit
  FROM (SELECT r, unnest(range(begins, begins + n)) AS place FROM windows w WHERE side = 0 AND passage IN (SELECT passage FROM items))
  GROUP BY r),
named AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS found
  FROM (SELECT DISTINCT r, item FROM windows w JOIN items i ON w.passage = i.passage WHERE side = 0) GROUP BY r)
SELECT id AS doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(found, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM worded LEFT JOIN places USING (r) LEFT JOIN named USING (r) WHERE side = 0
"""


@query
def op12_conversations(spark: SparkSession, folder: str) -> DataFrame:
    """Faults and the cheapest repair of every conversation after damage."""
    return conversations.digests(conversations.repaired(conversations.damaged(table(spark, folder, "conversations")), "present"))


#: A step of the recursion takes one turn: at most two inserts, then delete, keep or change it; of equal states the least stays.
ORACLE["op12_conversations"] = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))) AS t),
kinds AS (
  SELECT row_number() OVER () AS nr, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)],
      list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda s: CAST(ascii(s) AS BIGINT))),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 20 AS kind
  FROM conversations, crc),
rows AS (
  SELECT dense_rank() OVER (ORDER BY conv_id) AS c, nr, conv_id, turn, kind, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM kinds),
copied AS (SELECT *, 0 AS copy FROM rows WHERE kind <> 0 UNION ALL SELECT *, 1 FROM rows WHERE kind = 3),
placed AS (
  SELECT *, row_number() OVER w AS i, left(role, 1) AS initial, lag(left(role, 1)) OVER w AS previous,
    row_number() OVER (PARTITION BY c, role, text ORDER BY turn NULLS FIRST, nr, copy) > 1 AS again,
    right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last
  FROM copied WINDOW w AS (PARTITION BY c ORDER BY turn NULLS FIRST, role, text, nr, copy)),
turns AS (
  SELECT *, CASE WHEN last = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM placed),
counted AS (
  SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (i > 1 AND previous || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM turns GROUP BY c),
inserts(q, edits, q1, body) AS (VALUES
  (0, '', 0, []), (0, 'I', 2, ['user:']), (0, 'II', 3, ['user:', 'assistant:']), (1, '', 1, []), (1, 'I', 2, ['user:']), (1, 'II', 3, ['user:', 'assistant:']),
  (2, '', 2, []), (2, 'I', 3, ['assistant:']), (2, 'II', 2, ['assistant:', 'user:']), (3, '', 3, []), (3, 'I', 2, ['user:']), (3, 'II', 3, ['user:', 'assistant:'])),
moves(q1, edit, initial, q2, wanted) AS (
  SELECT q, 'D', CAST(NULL AS VARCHAR), q, CAST(NULL AS VARCHAR) FROM range(4) r(q) UNION ALL
  VALUES (0, 'K', 's', 1, NULL), (0, 'K', 'u', 2, NULL), (1, 'K', 'u', 2, NULL), (2, 'K', 'a', 3, NULL), (3, 'K', 'u', 2, NULL),
    (0, 'R', NULL, 2, 'user'), (1, 'R', NULL, 2, 'user'), (2, 'R', NULL, 3, 'assistant'), (3, 'R', NULL, 2, 'user')),
steps AS (
  SELECT DISTINCT c, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS q, CAST(0 AS BIGINT) AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS body FROM rows
  UNION ALL
  SELECT s.c, t.i, CAST(m.q2 AS BIGINT),
    CAST(s.cost + 3 * len(n.edits) + CASE m.edit WHEN 'D' THEN 4 ELSE CASE m.edit WHEN 'R' THEN 3 ELSE 0 END + CASE t.fault WHEN 'truncated' THEN 3 ELSE 0 END END AS BIGINT) AS paid,
    s.audit || n.edits || m.edit AS letters,
    list_concat(s.body, CAST(n.body AS VARCHAR[]), CASE m.edit WHEN 'D' THEN [] ELSE [coalesce(m.wanted, t.role) || ':' || t.text] END)
  FROM steps s JOIN turns t ON t.c = s.c AND t.i = s.i + 1 JOIN inserts n ON n.q = s.q JOIN moves m ON m.q1 = n.q1
  WHERE (m.edit = 'D' OR t.fault NOT IN ('blank', 'duplicate')) AND (m.edit <> 'K' OR m.initial = t.initial)
  QUALIFY row_number() OVER (PARTITION BY s.c, m.q2 ORDER BY paid, letters) = 1),
ended AS (
  SELECT s.c, s.cost + 3 * len(n.edits) AS cost, s.audit || n.edits AS audit, list_concat(s.body, CAST(n.body AS VARCHAR[])) AS body,
    row_number() OVER (PARTITION BY s.c ORDER BY s.cost + 3 * len(n.edits), s.audit || n.edits) AS best
  FROM steps s LEFT JOIN counted k ON k.c = s.c JOIN inserts n ON n.q = s.q
  WHERE s.i = coalesce(k.n, 0) AND n.q1 IN (0, 3))
SELECT r.conv_id, coalesce(k.gaps, 0) AS gaps, coalesce(k.blank, 0) AS blank, coalesce(k.duplicate, 0) AS duplicate, coalesce(k.truncated, 0) AS truncated,
  coalesce(k.illegal, 0) AS illegal, e.cost, e.audit, sha256(array_to_string(e.body, chr(10))) AS repaired_sha256
FROM (SELECT DISTINCT c, conv_id FROM rows) r JOIN ended e ON e.c = r.c AND e.best = 1 LEFT JOIN counted k ON k.c = r.c
"""


@query
def op13_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """How two tokenizers' ids of every document align, and how common the linked pairs are."""
    byte_level, pieces = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return alignment.aligned(table(spark, folder, "documents"), byte_level, pieces).drop("groups")
