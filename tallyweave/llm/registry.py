"""Queries of the operators over the driver's tables, and their SQL twins for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyweave.llm import hard_negatives, line_dedup, mixing, ngram_quality, page_text, positional, probminhash, quality, secret_forest, spelling, token_files, url_lists, warc_zip
from tallyweave.llm.common import LAST_ID, table


def _vocabulary(name: str) -> str:
    try:
        import public_tokenizers
    except ImportError:
        return f"/opt/tokenizers/{name}"
    return public_tokenizers.path(name)


#: Tokenizer file; it must lie at the same path on every machine.
TOKENIZER = _vocabulary("byte_bpe_50k.json")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_WORD = r"[^\x20\x09-\x0D]+"
_UP, _LOW = line_dedup.UPPER, line_dedup.UPPER.lower()


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return deco


#: The mix over a table ``base(doc_id, source, size)``.
MIX_SQL = """, per AS (SELECT source, length(CAST(size AS VARCHAR)) AS v, sum(size)::BIGINT AS words FROM base GROUP BY ALL),
 named AS (SELECT source, sum(words)::BIGINT AS source_size FROM per GROUP BY source),
 placed AS (SELECT source, source_size, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM named),
 capped AS (SELECT *, 2 * source_size AS cap, (2 * source_size)::DOUBLE / weight AS full_at FROM placed),
 lines AS (SELECT ((SELECT sum(source_size) FROM capped)::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER w, 0)::DOUBLE)
   / ((SELECT sum(weight) FROM capped) - coalesce(sum(weight) OVER w, 0))::DOUBLE AS level
   FROM capped WINDOW w AS (ORDER BY full_at, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 targets AS (SELECT source, source_size, least(cap::DOUBLE, (SELECT max(level) FROM lines) * weight) AS target FROM capped),
 steps AS (SELECT source, v, words, words * v AS pull FROM per WHERE words > 0),
 pulls AS (SELECT steps.source, (target - 2::DOUBLE * coalesce(sum(words) OVER w, 0)::DOUBLE)
   / (sum(pull) OVER (PARTITION BY steps.source) - coalesce(sum(pull) OVER w, 0))::DOUBLE AS level
   FROM steps JOIN targets t ON t.source IS NOT DISTINCT FROM steps.source
   WINDOW w AS (PARTITION BY steps.source ORDER BY v DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 ready AS (SELECT t.source, t.source_size, target, coalesce(level, 0)::DOUBLE AS level FROM targets t
   LEFT JOIN (SELECT source, max(level) AS level FROM pulls GROUP BY source) p ON p.source IS NOT DISTINCT FROM t.source),
 e AS (SELECT b.*, source_size, target, least(2::DOUBLE, level * length(CAST(size AS VARCHAR))::DOUBLE) AS expected,
   (CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT)::DOUBLE + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
   FROM base b JOIN ready r ON r.source IS NOT DISTINCT FROM b.source),
 f AS (SELECT *, floor(expected + 1e-9::DOUBLE) AS whole, expected - floor(expected + 1e-9::DOUBLE) AS part FROM e),
 g AS (SELECT *, CASE WHEN part > 1e-9::DOUBLE AND size > 0 THEN (u / (1 - u)) / (part / (1 - part)) END AS rnk FROM f),
 rest AS (SELECT source, min(target) - sum(whole * size) AS rest FROM g GROUP BY source),
 ranked AS (SELECT source, rnk, doc_id, size, sum(size) OVER (PARTITION BY source ORDER BY rnk, doc_id NULLS LAST, size) AS upto,
   sum(size) OVER (PARTITION BY source, rnk, doc_id, size) AS grp FROM g WHERE rnk IS NOT NULL),
 ins AS (SELECT DISTINCT k.source, k.rnk, k.doc_id, k.size FROM ranked k JOIN rest r ON r.source IS NOT DISTINCT FROM k.source
   WHERE upto - grp + grp / 2.0::DOUBLE <= rest),
 mix AS (SELECT g.doc_id, g.source, g.size, source_size, target, CASE WHEN g.size = 0 THEN 0 ELSE whole::BIGINT + (i.rnk IS NOT NULL)::BIGINT END AS copies
   FROM g LEFT JOIN ins i ON i.source IS NOT DISTINCT FROM g.source AND i.rnk = g.rnk AND i.doc_id IS NOT DISTINCT FROM g.doc_id AND i.size = g.size)
"""


@query("op1_pareto_mix", rf"""WITH base AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{_WORD}')), 0)::BIGINT AS size FROM documents){MIX_SQL}
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM mix""")
def _(spark, sf_dir):
    mix = mixing.plan_mix(table(spark, sf_dir, "documents"))
    return mix.decide(mix.sizes).select(F.col("_raw").alias("doc_id"), "size", "source_size", "target", "taken", "copies")


_KEY = f"translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UP}', '{_LOW}')"


@query("op3_line_dedup", f"""WITH rows AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text FROM documents),
 lines AS (SELECT doc_id, r, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM rows),
 keyed AS (SELECT *, {_KEY} AS key FROM lines),
 owned AS (SELECT key, min(coalesce(doc_id, 9223372036854775807)) AS owner FROM keyed WHERE length(key) >= 10 GROUP BY key),
 marked AS (SELECT k.*, coalesce(coalesce(doc_id, 9223372036854775807) > owner, false) AS gone FROM keyed k LEFT JOIN owned o USING (key))
 SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM marked GROUP BY r""")
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


#: Judgement of a table ``docs(r, doc_id, host, text)``, r unique.
QUALITY_SQL = rf""", w AS (SELECT r, doc_id, host, text, coalesce(regexp_extract_all(text, '{_WORD}'), []) AS words FROM docs),
 base AS (SELECT r, doc_id, host, text, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
   coalesce(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')), 0) AS n_symbols FROM w),
 grams AS (SELECT r, i, words[i:i + 4] AS g FROM (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) > 5)),
 again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM grams) WHERE n > 1),
 cover AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM again, (SELECT unnest(range(5)) AS k) GROUP BY r),
 l AS (SELECT r, doc_id, host, text, line, regexp_extract_all(lower(line), '{_WORD}') AS lw
   FROM (SELECT r, doc_id, host, text, unnest(string_split(text, chr(10))) AS line FROM docs)),
 dups AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE len(lw) > 0 GROUP BY r),
 k AS (SELECT r, doc_id, host, text, array_to_string(lw, ' ') AS key, len(lw) AS n FROM l WHERE len(lw) > 0),
 hosts AS (SELECT host, count(DISTINCT coalesce(text, '')) AS texts FROM docs GROUP BY host),
 often AS (SELECT host, key, count(DISTINCT text) AS n, min(coalesce(doc_id, 9223372036854775807)) AS first FROM k GROUP BY host, key),
 gone AS (SELECT r, sum(k.n)::BIGINT AS removed_words FROM k JOIN often o ON o.host IS NOT DISTINCT FROM k.host AND o.key = k.key
   JOIN hosts h ON h.host IS NOT DISTINCT FROM k.host
   WHERE o.n > 20 AND o.n > h.texts * 0.01::DOUBLE AND coalesce(doc_id, 9223372036854775807) > first GROUP BY r),
 stats AS (SELECT base.r, base.doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
   coalesce(removed_words, 0) AS removed_words FROM base LEFT JOIN cover USING (r) LEFT JOIN dups USING (r) LEFT JOIN gone USING (r)),
 judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
   removed_words > 0 AND (n_words - removed_words < 10 OR n_words - removed_words < n_words * 0.3::DOUBLE) AS depleted FROM stats)"""


@query("op2_line_frequency", f"""WITH docs AS (SELECT row_number() OVER () AS r, doc_id, source AS host, text FROM documents){QUALITY_SQL}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT depleted AS kept, removed_words FROM judged""")
def _(spark, sf_dir):
    return quality.judge(table(spark, sf_dir, "documents")).select(
        F.col("_raw").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")


#: Hits over a table ``docs(r, doc_id, text)``, r unique, with the view ``benchmark``.
HITS_SQL = rf""", dw AS (SELECT r, coalesce(regexp_extract_all(translate(text, '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words FROM docs),
 bw AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(text, '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
 bl AS (SELECT item_id, words, least(len(words), 13) AS n FROM bw WHERE len(words) > 0),
 bg AS (SELECT DISTINCT item_id, n, words[i:i + n - 1] AS g FROM (SELECT item_id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM bl)),
 ns AS (SELECT DISTINCT n FROM bl),
 dg AS (SELECT r, i, n, words[i:i + n - 1] AS g FROM (SELECT r, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM dw, ns WHERE len(words) >= n)),
 m AS (SELECT DISTINCT r, i, n, item_id FROM dg JOIN bg USING (n, g)),
 hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM m) GROUP BY r),
 its AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM m GROUP BY r),
 found AS (SELECT d.r, d.doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
   coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated FROM docs d JOIN dw USING (r) LEFT JOIN hit USING (r) LEFT JOIN its USING (r))"""


@query("op10_positional_index", f"""WITH docs AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents){HITS_SQL}
SELECT doc_id, n_words, n_hit, n_items, items_sha256, contaminated FROM found""")
def _(spark, sf_dir):
    found = positional.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("_raw").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


#: Near-duplicate classes of a table ``docs(r, doc_id, text)``, r unique: exact similarity of all texts that share a shingle.
CLASSES_SQL = rf""", nt AS (SELECT md5(coalesce(text, '')) AS t, any_value(text) AS text FROM docs GROUP BY ALL),
 nw AS (SELECT t, regexp_extract_all(translate(text, '{_UP}', '{_LOW}'), '{_WORD}') AS words FROM nt),
 ng AS (SELECT DISTINCT t, array_to_string(words[i:i + 4], ' ') AS g FROM (SELECT t, words, unnest(range(1, greatest(1, len(words) - 4) + 1)) AS i FROM nw WHERE len(words) > 0)),
 nc AS (SELECT t, count(*) AS n FROM ng GROUP BY t),
 np AS (SELECT x.t AS a, y.t AS b, count(*) AS common FROM ng x JOIN ng y ON x.g = y.g AND x.t < y.t GROUP BY ALL),
 nl AS (SELECT a, b FROM np JOIN nc x ON x.t = a JOIN nc y ON y.t = b WHERE common::DOUBLE / (x.n + y.n - common) >= 0.8::DOUBLE),
 ne AS (SELECT a, b FROM nl UNION ALL SELECT b, a FROM nl),
 reach(a, b) AS (SELECT t, t FROM nt UNION SELECT r.a, e.b FROM reach r JOIN ne e ON e.a = r.b),
 root AS (SELECT a AS t, min(b) AS root FROM reach GROUP BY a),
 dr AS (SELECT r, doc_id, root FROM docs JOIN root ON t = md5(coalesce(text, ''))),
 classed AS (SELECT r, doc_id, min(doc_id) OVER w AS class_id, count(*) OVER w AS class_size FROM dr WINDOW w AS (PARTITION BY root))"""


@query("op8_probminhash", f"""WITH RECURSIVE docs AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents){CLASSES_SQL}
SELECT doc_id, class_id, class_size FROM classed""")
def _(spark, sf_dir):
    return probminhash.classes(table(spark, sf_dir, "documents")).select(F.col("_raw").alias("doc_id"), "class_id", "class_size")


@query("op7_elias_fano")
def _(spark, sf_dir):
    return token_files.token_files(table(spark, sf_dir, "documents"), TOKENIZER)


_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_CHARS = ", ".join(f"substr('{_B32}', ((n >> {15 - 5 * i}) & 31) + 1, 1)" for i in range(4))


@query("op6_zip_warc", f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
 d AS (SELECT page_id, strlen(html) AS payload_bytes,
   array_to_string(list_transform(list_transform(range(8), lambda k: CAST('0x' || substr(sha1(html), 5 * k + 1, 5) AS BIGINT)), lambda n: concat({_CHARS})), '') AS payload_digest FROM p),
 f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
 SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM f""")
def _(spark, sf_dir):
    return warc_zip.archived(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def captures(pages: DataFrame) -> DataFrame:
    """Pages with a fetch day of 2024 that follows from their number."""
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 37, F.lit(366)).cast("int")).alias("fetched"))


def dated_lists(pages: DataFrame) -> DataFrame:
    """Dated list entries over the hosts and domains of ``pages``: about a fifth of them, each added and removed up to twice in 2024."""
    draw = lambda tail: F.conv(F.substring(F.md5(F.concat("entry", F.lit(tail))), 1, 6), 16, 10).cast("long")
    hosts = pages.select(url_lists.host_of("url").alias("host")).dropna().distinct()
    names = hosts.select("host", F.array_join(F.slice(F.split("host", r"\."), -2, 2), ".").alias("domain"))
    entries = names.select(F.col("host").alias("entry")).union(names.select("domain")).distinct().where(draw("") % 5 == 0)
    events = entries.select("entry", draw("/list").alias("which"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    day = F.conv(F.substring(F.md5(F.concat("entry", F.lit("/"), F.col("k").cast("string"))), 1, 6), 16, 10).cast("long") % 366
    return events.select(
        F.element_at(F.array(F.lit("adult"), F.lit("malware"), F.lit("spam")), (F.col("which") % 3 + 1).cast("int")).alias("list"), "entry",
        F.date_add(F.lit("2024-01-01").cast("date"), day.cast("int")).alias("day"), F.when(F.col("k") % 2 == 0, url_lists.ADD).otherwise(url_lists.REMOVE).alias("action"))


@query("op9_temporal_lists", r"""WITH c AS (SELECT page_id, url, DATE '2024-01-01' + CAST((page_id * 37) % 366 AS INT) AS fetched,
   nullif(rtrim(regexp_extract(lower(url), '^https?://(?:[^/?#@]*@)?([^/:?#]+)', 1), '.'), '') AS host FROM pages),
 names AS (SELECT DISTINCT host FROM c WHERE host IS NOT NULL),
 e AS (SELECT host AS entry FROM names UNION SELECT array_to_string(string_split(host, '.')[-2:], '.') FROM names),
 picked AS (SELECT entry, ['adult', 'malware', 'spam'][CAST('0x' || substr(md5(entry || '/list'), 1, 6) AS BIGINT) % 3 + 1] AS list
   FROM e WHERE CAST('0x' || substr(md5(entry), 1, 6) AS BIGINT) % 5 = 0),
 ev AS (SELECT list, entry, DATE '2024-01-01' + CAST(CAST('0x' || substr(md5(entry || '/' || k), 1, 6) AS BIGINT) % 366 AS INT) AS day, bool_or(k % 2 = 0) AS turned
   FROM picked, range(4) r(k) GROUP BY ALL),
 states AS (SELECT *, lead(day) OVER (PARTITION BY list, entry ORDER BY day) AS upto FROM ev),
 runs AS (SELECT *, sum(CASE WHEN turned THEN 0 ELSE 1 END) OVER (PARTITION BY list, entry ORDER BY day) AS run FROM states),
 spans AS (SELECT list, entry, min(day) AS since, CASE WHEN bool_or(upto IS NULL) THEN NULL ELSE max(upto) END AS until FROM runs WHERE turned GROUP BY list, entry, run),
 hit AS (SELECT page_id, s.list, since FROM c JOIN spans s ON (host = entry OR ends_with(host, '.' || entry)) AND since <= fetched AND (until IS NULL OR fetched < until)),
 agg AS (SELECT page_id, count(*) AS n, array_to_string(list_sort(list_distinct(list(list))), ',') AS lists, min(since) AS listed_since FROM hit GROUP BY page_id)
 SELECT page_id, host, fetched, n IS NOT NULL AS blocked, coalesce(n, 0) AS n_entries, coalesce(lists, '') AS lists, listed_since FROM c LEFT JOIN agg USING (page_id)""")
def _(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return url_lists.as_of(captures(pages), dated_lists(pages)).drop("url")


@query("op5_min_cut_text")
def _(spark, sf_dir):
    return page_text.main_text(table(spark, sf_dir, "pages"))


@query("op4_secret_forest")
def _(spark, sf_dir):
    found = secret_forest.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "start", F.char_length("run").cast("long").alias("n_chars"), F.sha2("run", 256).alias("run_sha256"), "probability", "is_secret")


@query("op12_ftrl_ngrams")
def _(spark, sf_dir):
    return ngram_quality.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: A checksum of bytes is the exclusive or of what each byte alone gives at its place (``zt``) and of what as many zero bytes give (``zc``).
_CRC_SQL = """ct AS (SELECT i AS b, list_reduce([i] || list_value(0, 0, 0, 0, 0, 0, 0, 0)::BIGINT[], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS t
   FROM range(256) r(i)),
 zt(k, b, z) AS (SELECT 0, b, t FROM ct UNION ALL SELECT k + 1, zt.b, xor(ct.t, z >> 8) FROM zt JOIN ct ON ct.b = z & 255 WHERE k < (SELECT max(strlen(s)) FROM asked)),
 zc(n, s) AS (SELECT 0, 4294967295::BIGINT UNION ALL SELECT n + 1, xor(t, s >> 8) FROM zc JOIN ct ON b = s & 255 WHERE n < (SELECT max(strlen(s)) FROM asked)),
 bytes AS (SELECT s, strlen(s) AS n, CAST('0x' || substr(hex(encode(s)), 2 * i + 1, 2) AS INT) AS b, strlen(s) - 1 - i AS k FROM (SELECT s, unnest(range(strlen(s))) AS i FROM asked)),
 crc AS (SELECT bytes.s, xor(xor(any_value(zc.s), 4294967295), bit_xor(z)) AS h FROM bytes JOIN zt USING (k, b) JOIN zc ON zc.n = bytes.n GROUP BY bytes.s)"""


@query("op11_trie_frontier", f"""WITH RECURSIVE runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), '{_UP}', '{_LOW}') AS run FROM documents),
 per AS (SELECT concat(doc_id, ':', run) AS s, run, count(*) AS c FROM runs WHERE length(run) >= 5 GROUP BY ALL),
 asked AS (SELECT DISTINCT s FROM per), {_CRC_SQL},
 made AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM per JOIN crc USING (s)),
 v AS (SELECT word, sum(c)::BIGINT AS n FROM made WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
 gaps AS (SELECT word, i, left(word, i - 1) || substr(word, i + 1) AS k FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
 one AS (SELECT gaps.word AS a, v.word AS b FROM gaps JOIN v ON v.word = k),
 near AS (SELECT a, b FROM one UNION SELECT b, a FROM one UNION SELECT x.word, y.word FROM gaps x JOIN gaps y ON x.i = y.i AND x.k = y.k AND x.word <> y.word),
 ranked AS (SELECT a, b, v.n AS bn, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY v.n DESC, b) AS place FROM near JOIN v ON v.word = b),
 formed AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN bn >= 2 * n THEN b END AS form, CASE WHEN bn >= 2 * n THEN bn END AS form_n
   FROM v LEFT JOIN ranked ON a = word AND place = 1),
 walk(word, here, step) AS (SELECT word, word, 0 FROM v UNION ALL SELECT walk.word, form, step + 1 FROM walk JOIN formed ON formed.word = walk.here WHERE form IS NOT NULL)
 SELECT f.word, form, root, n, n_near, form_n FROM formed f JOIN (SELECT word, max_by(here, step) AS root FROM walk GROUP BY word) w USING (word)""")
def _(spark, sf_dir):
    return spelling.variants(table(spark, sf_dir, "documents"))


@query("op13_packed_rtree", """WITH valid AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
   list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
   FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 met AS (SELECT a.id AS anchor_id, a.label AS anchor_label, b.id, b.label, list_inner_product(a.v, b.v)::BIGINT AS score FROM valid a, valid b WHERE a.id % 50 = 0),
 pos AS (SELECT * FROM (SELECT anchor_id, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS place
   FROM met WHERE label = anchor_label AND id <> anchor_id) WHERE place <= 5)
 SELECT * FROM (SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INT AS rank, id AS negative_id, positive_score, score AS negative_score
   FROM pos JOIN met USING (anchor_id) WHERE label <> anchor_label AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score) WHERE rank <= 3""")
def _(spark, sf_dir):
    label = F.when((F.col("_id") % 7 == 0) & (F.col("_id") != LAST_ID), (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("_id") % 50 == 0, label)
