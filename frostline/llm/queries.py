"""The registered queries of the corpus operators, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frostline.llm import (
    chat,
    filter_audit,
    jaccard_join,
    lexical_search,
    mixing,
    nearest,
    packing,
    pii,
    quality_rules,
    secret_scans,
    toxicity,
    url_filters,
    warc_store,
)
from frostline.sources.shared import scratch_dir

URL_RULES = url_filters.Rules(
    (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _digest(text):
    return F.sha2(text, 256)


def op1_host_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filters.judge(_table(spark, sf_dir, "pages"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5))
    model = toxicity.train(documents.where(fold != 0), labels.where(fold != 0))
    return toxicity.scored(documents, model).select(
        "doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op3_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    model = secret_scans.train(secret_scans.labelled_samples(documents))
    found = secret_scans.scanned(documents, model)
    of = lambda rank: F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("long")
    return found.select(
        "doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"),
        _digest(secret_scans.written_out(F.filter("spans", lambda s: s["rank"] < 3))).alias("base_sha256"),
        secret_scans.written_out(F.col("spans")).alias("spans"),
    )


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(_table(spark, sf_dir, "documents"))


def op6_collision_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.apply_rules(_table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_entropy_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix(_table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    found = pii.scanned(documents, pii.train(documents))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(
        "doc_id", *[of(kind).alias(f"n_{kind}") for kind in pii.KINDS],
        _digest(joined(F.filter("spans", lambda s: s["kind"].isin(*pii.KINDS)))).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def op10_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(_table(spark, sf_dir, "conversations"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    return filter_audit.audit(filter_audit.masked(documents, labels))


def op13_warc_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = scratch_dir(spark, "archive")
    warc_store.deposit(_table(spark, sf_dir, "pages"), archive)
    return warc_store.restored(spark, archive).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    q.__name__: q for q in (
        op1_host_trust, op2_toxicity, op3_length_buckets, op4_secrets, op5_jaccard_join, op6_collision_search,
        op7_host_rules, op8_entropy_balance, op9_personal_data, op10_snapshot_collapse,
        op11_lexical_search, op12_filter_audit, op13_warc_store,
    )
}


def _host_trust_sql(rounds: int = 40, damping: float = 0.7) -> str:
    walks = []
    for name, source, target in (("t", "source", "target"), ("d", "target", "source")):
        seed = {"t": "allowed", "d": "blocked"}[name]
        walks.append(f"{name}_share AS (SELECT {source} AS s, {target} AS g, "
                     "weight / sum(weight) OVER (PARTITION BY source) AS share FROM links)")
        walks.append(f"{name}0 AS (SELECT host, {seed} AS mass FROM seeds)")
        for i in range(1, rounds + 1):
            walks.append(f"{name}{i} AS MATERIALIZED (SELECT g AS host, sum(mass * share * {damping}) AS mass "
                         f"FROM {name}{i - 1} JOIN {name}_share ON s = host GROUP BY g)")
        union = " UNION ALL ".join(f"SELECT * FROM {name}{i}" for i in range(rounds + 1))
        walks.append(f"{name}_all AS (SELECT host, sum(mass) AS score FROM ({union}) GROUP BY host)")
    host = "translate(regexp_extract({0}, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    link = "CASE WHEN starts_with(link, '//') THEN 'x:' || link ELSE link END"
    return f"""
WITH parted AS (
  SELECT page_id, html, {host.format("coalesce(url, '')")} AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM parted),
acted AS (
  SELECT *, CASE WHEN rule IN ('example.com/de/', 'net/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS action FROM ruled),
seeds AS (
  SELECT host, avg(CASE WHEN action = 'allow' THEN 1.0 ELSE 0.0 END) AS allowed,
    avg(CASE WHEN action = 'block' THEN 1.0 ELSE 0.0 END) AS blocked FROM acted WHERE host <> '' GROUP BY host),
found AS (
  SELECT host AS source, unnest(regexp_extract_all(html, '(?i)href\\x20*=\\x20*["'']?\\x20*([^"''\\x20>]+)', 1)) AS link FROM acted),
links AS (
  SELECT source, target, count(*) AS weight FROM (
    SELECT source, {host.format(link)} AS target FROM found
    WHERE regexp_matches(link, '^([A-Za-z][A-Za-z0-9+.-]*:)?//'))
  WHERE source <> '' AND target <> '' AND source <> target GROUP BY 1, 2),
{", ".join(walks)}
SELECT page_id, a.host, path, rule, coalesce(action, CASE WHEN coalesce(d.score, 0) >= 0.5
  AND coalesce(d.score, 0) > coalesce(t.score, 0) THEN 'block' ELSE 'allow' END) AS verdict
FROM acted a LEFT JOIN t_all t ON a.host = t.host LEFT JOIN d_all d ON a.host = d.host"""


HOST_RULES_SQL = r"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
worded AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM texts),
windows AS (
  SELECT r, i, array_to_string(words[i:i + 4], ' ') AS w FROM worded, unnest(range(1, len(words) - 3)) AS t(i)),
again AS (SELECT r, i, count(*) OVER (PARTITION BY r, w) AS n FROM windows),
covered AS (
  SELECT r, count(DISTINCT i + o) AS n FROM again, range(0, 5) AS t(o) WHERE n > 1 GROUP BY r),
measured AS (
  SELECT doc_id, source, len(words)::BIGINT AS n_words,
    coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM worded LEFT JOIN covered USING (r)),
failed AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM measured),
hosts AS (SELECT source, count(*) AS n, sum(base_failed::INT) AS f FROM failed GROUP BY source),
sums AS (SELECT count(*) AS h, sum(n) AS n, sum(f) / sum(n) AS m, sum(f * f / n) / sum(n) AS sq FROM hosts),
prior AS (
  SELECT m, CASE WHEN sq - m * m - (h - 1) * m * (1 - m) / n > 1e-12
    THEN least(greatest(m * (1 - m) / (sq - m * m - (h - 1) * m * (1 - m) / n) - 1, 1.0), 1e6) ELSE 1e6 END AS k FROM sums),
verdicts AS (SELECT source, (f + k * m) / (n + k) <= 0.5 AS host_kept FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND host_kept) AS kept
FROM failed JOIN verdicts ON failed.source IS NOT DISTINCT FROM verdicts.source"""

JACCARD_SQL = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS words FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 2], ' ') AS s
  FROM worded, unnest(range(1, greatest(2, len(words) - 1))) AS t(i) WHERE len(words) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * common.n >= 90 * (p.n + q.n - common.n)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION SELECT reach.doc_id, both_ways.y FROM reach JOIN both_ways ON reach.other = both_ways.x)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(other) AS component_id
FROM documents d JOIN reach USING (doc_id) LEFT JOIN sizes USING (doc_id) GROUP BY 1, 2"""

SNAPSHOT_SQL = """
WITH turns AS (
  SELECT DISTINCT conv_id, turn, role, text, md5(coalesce('r' || role, '') || '/' || md5(coalesce('t' || text, ''))) AS h FROM conversations),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS place FROM turns),
logged AS (SELECT conv_id, count(*) AS n_turns, string_agg(h, ',' ORDER BY place) || ',' AS whole FROM placed GROUP BY conv_id),
kept AS (
  SELECT min(conv_id) AS conv_id, n_turns, count(*) AS n_copies FROM logged l
  WHERE NOT EXISTS (SELECT 1 FROM logged o WHERE o.n_turns > l.n_turns AND starts_with(o.whole, l.whole))
  GROUP BY whole, n_turns)
SELECT conv_id, (place - 1) // 1024 AS part, n_turns, n_copies,
  string_agg('<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10), '' ORDER BY place) AS rendered
FROM placed JOIN kept USING (conv_id) GROUP BY conv_id, part, n_turns, n_copies"""

LEXICAL_SQL = r"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
totals AS (SELECT count(*) AS docs, sum(len(terms))::BIGINT AS words FROM texts WHERE len(terms) > 0),
measured AS (
  SELECT r, doc_id, 75 + ((25 * len(terms) * docs) // words) AS m FROM texts, totals WHERE len(terms) > 0),
postings AS (SELECT r, term, count(*) AS tf FROM texts, unnest(terms) AS t(term) GROUP BY 1, 2),
weights AS (
  SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM postings, totals GROUP BY term),
asked AS (
  SELECT DISTINCT item_id, coalesce(text, '') AS text FROM benchmark),
wanted AS (
  SELECT item_id, text, term, count(*) AS q FROM asked, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t(term) GROUP BY 1, 2, 3),
scored AS (
  SELECT item_id, text, r, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM wanted JOIN weights USING (term) JOIN postings USING (term) JOIN measured USING (r) GROUP BY ALL),
ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST))::INT AS rank
  FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20"""

FILTER_AUDIT_SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
said AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
failing AS (
  SELECT t.part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (CASE WHEN len(words) < 50 THEN 'A' ELSE '' END)
    || (CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 'B' ELSE '' END)
    || (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) THEN 'C' ELSE '' END)
    || (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END)
    || (CASE WHEN t.doc_id > min(t.doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END) AS fails
  FROM texts t LEFT JOIN said USING (doc_id)),
counted AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failing GROUP BY 1, 2),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (
  SELECT filter_order, step::INT AS step, filter_order[step:step] AS f, filter_order[1:step - 1] AS earlier
  FROM orders, range(1, 6) AS t(step)),
met AS (
  SELECT part, filter_order, step, f, n, good, toxic, contains(fails, f) AS hit, fails = f AS only_this,
    earlier <> '' AND regexp_matches(fails, '[' || (CASE WHEN earlier = '' THEN 'x' ELSE earlier END) || ']') AS gone
  FROM counted, steps),
summed AS (
  SELECT part, filter_order, step, f,
    coalesce(sum(n) FILTER (WHERE NOT gone AND NOT hit), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (WHERE NOT gone AND hit), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (WHERE gone AND hit), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (WHERE only_this), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (WHERE NOT gone AND hit), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (WHERE NOT gone AND hit), 0)::BIGINT AS toxic_lost
  FROM met GROUP BY 1, 2, 3, 4)
SELECT * EXCLUDE (f), (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM summed"""

WARC_SQL = """
WITH bodies AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
measured AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha256(body) AS payload_digest FROM bodies),
ranked AS (
  SELECT *, row_number() OVER w AS place, first_value(page_id) OVER w AS first_id FROM measured
  WINDOW w AS (PARTITION BY payload_digest ORDER BY page_id NULLS LAST))
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND place > 1 THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND place > 1 THEN first_id END AS refers_to
FROM ranked"""

ORACLES: dict[str, str] = {
    "op1_host_trust": _host_trust_sql(),
    "op5_jaccard_join": JACCARD_SQL,
    "op7_host_rules": HOST_RULES_SQL,
    "op10_snapshot_collapse": SNAPSHOT_SQL,
    "op11_lexical_search": LEXICAL_SQL,
    "op12_filter_audit": FILTER_AUDIT_SQL,
    "op13_warc_store": WARC_SQL,
}
