"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontam, langid, media, neardup, packing, phrases, quality, shards, simhash, turns, urlfilter, warc
from .common import in_fold, materialise, scratch_path

SHARDS = 24
#: The rules that the contract of the URL filter gives: verdict, host, path.
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages -> ARC archives -> WARC files -> rows."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    records = warc.mark_revisits(warc.convert_pages(pages).where("record_type != 'warcinfo'"))
    path = scratch_path(spark, "warc")
    warc.write_warc(records, path)
    return warc.read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(~in_fold("doc_id")))
    return langid.predict(docs.select("doc_id", "text", in_fold("doc_id").alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = phrases.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    machine = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs.withColumn("held_out", in_fold("doc_id")), machine).select("doc_id", "held_out", "score", "predicted")


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "media")
    media.store(table(spark, sf_dir, "documents"), path)
    return media.features(media.load(spark, path))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), "contaminated")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shards.shard(table(spark, sf_dir, "documents"), SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "class_size")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [(v, h, p) for v, h, p in RULES]
    return urlfilter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.pieces(table(spark, sf_dir, "documents"), *packing.public_paths())
    return packing.pack(cut).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op11_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, repaired = turns.repair(turns.damage(table(spark, sf_dir, "conversations")))
    done = turns.digests(repaired).withColumnRenamed("conv", "of")
    empty = F.sha2(F.lit("").cast("binary"), 256)
    out = found.join(done, F.col("conv").eqNullSafe(F.col("of")), "left")
    return out.select(F.col("conv").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("sha256", empty).alias("repaired_sha256"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``n_near`` counts the neighbours of the documents whose id is divisible by 100."""
    found = materialise(simhash.edited(table(spark, sf_dir, "documents").select("doc_id", "text")), "fingerprints")
    return simhash.with_neighbours(found, F.col("doc_id") % 100 == 0)


QUERIES = {
    "op1_warc": op1_warc,
    "op2_language_id": op2_language_id,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_quality": op4_quality,
    "op5_media_columns": op5_media_columns,
    "op6_decontamination": op6_decontamination,
    "op7_sharding": op7_sharding,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_url_filter": op9_url_filter,
    "op10_packing": op10_packing,
    "op11_turns": op11_turns,
    "op12_collocations": op12_collocations,
    "op13_fingerprints": op13_fingerprints,
}



def _best(*ways: str) -> str:
    return f"list_min([{', '.join(ways)}])"


def _way(state: int, when: str, cost: str, edits: str, lines: str = "''") -> str:
    """The way to a state of the conversation pattern from a state before a row."""
    return f"CASE WHEN s{state} IS NOT NULL AND {when} THEN {{'c': s{state}.c + {cost}, 'a': s{state}.a || '{edits}', 'r': s{state}.r || {lines}}} END"


def _to(state: int, role: str, before: list[tuple[int, str]]) -> str:
    """The least way to the state after ``role``: a deletion in it, or a kept or renamed row from those before, perhaps after an insertion."""
    out = [_way(state, "true", "2", "D")]
    for source, inserted in before:
        more, edit = (5, "I") if inserted else (0, "")
        put = f"'{inserted}:' || chr(10) || " if inserted else ""
        out.append(_way(source, f"stays AND starts_with(role, '{role[0]}')", f"{more} + extra", edit + "K", f"{put}role || ':' || text || chr(10)"))
        out.append(_way(source, "stays", f"{more + 1} + extra", edit + "R", f"{put}'{role}:' || text || chr(10)"))
    return _best(*out)


SQL = {
    "op12_collocations": r"""
        WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\f\r]')) AS p FROM documents),
        words AS (SELECT lang, regexp_extract_all(p, '[^ \t]+') AS w FROM pieces),
        grams AS (SELECT lang, s, array_to_string(w[i : i + s - 1], ' ') AS g FROM (SELECT lang, w, s, unnest(range(1, CAST(len(w) - s + 2 AS BIGINT))) AS i FROM words, range(1, 6) r(s))),
        f AS (SELECT lang, s, g, count(*) AS f FROM grams GROUP BY lang, s, g),
        n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE s = 1 GROUP BY lang),
        c AS (SELECT lang, s, g, f AS a, string_split(g, ' ') AS w FROM f WHERE s > 1 AND f >= 100),
        cuts AS (SELECT lang, g, a, k, array_to_string(w[1 : k], ' ') AS lg, array_to_string(w[k + 1 : s], ' ') AS rg FROM (SELECT *, unnest(range(1, s)) AS k FROM c)),
        scores AS (SELECT cuts.*, l.f AS l, r.f AS r, n, CAST(CAST(1000 AS HUGEINT) * a * n // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
                   FROM cuts JOIN f l ON l.lang = cuts.lang AND l.g = lg JOIN f r ON r.lang = cuts.lang AND r.g = rg JOIN n ON n.lang = cuts.lang),
        best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
        inner_ AS (SELECT lang, array_to_string(w[i : i + z - 1], ' ') AS g, max(a) AS most
                   FROM (SELECT *, unnest(range(1, CAST(s - z + 2 AS BIGINT))) AS i FROM (SELECT *, unnest(range(2, s)) AS z FROM c)) GROUP BY ALL),
        kept AS (SELECT best.* FROM best LEFT JOIN inner_ i ON i.lang = best.lang AND i.g = best.g WHERE most IS NULL OR 100 * most < 100 * a)
        SELECT lang, rank, g AS phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank FROM kept) WHERE rank <= 2000""",
    "op11_turns": rf"""
        WITH RECURSIVE poly(i, k, c) AS (
            SELECT i, 0, CAST(i AS BIGINT) FROM range(0, 256) r(i)
            UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM poly WHERE k < 8),
        crc AS (SELECT list(c ORDER BY i) AS t FROM poly WHERE k = 8),
        named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, hex(encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))) AS h FROM conversations),
        kinds AS (SELECT conv_id, turn, role, text, xor(4294967295, list_reduce(list_transform(range(1, CAST(length(h) AS BIGINT), 2), lambda i: CAST(('0x' || substr(h, i, 2)) AS BIGINT)), lambda c, b: xor(t[1 + (xor(c, b) & 255)], c >> 8), 4294967295)) % 20 AS kind FROM named, crc),
        harmed AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                          unnest(CASE WHEN kind = 0 THEN [] WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy FROM kinds),
        line AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen FROM harmed),
        faults AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'b' WHEN seen > 1 THEN 'd' WHEN NOT regexp_matches(text, '[.!?][ 	-
]*$') THEN 't' ELSE '' END AS fault,
                          lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) || substr(role, 1, 1) AS pair FROM line),
        rows AS (SELECT *, fault NOT IN ('b', 'd') AS stays, CASE WHEN fault = 't' THEN 5 ELSE 0 END AS extra FROM faults),
        none AS (SELECT {{'c': 0, 'a': '', 'r': ''}} AS z),
        walk(conv_id, i, s0, s1, s2, s3) AS (
            SELECT DISTINCT conv_id, CAST(0 AS BIGINT), z, CASE WHEN false THEN z END, CASE WHEN false THEN z END, CASE WHEN false THEN z END FROM conversations, none
            UNION ALL
            SELECT w.conv_id, rows.i, {_best(_way(0, "true", "2", "D"))},
                   {_best(_way(1, "true", "2", "D"), _way(0, "stays AND starts_with(role, 's')", "extra", "K", "role || ':' || text || chr(10)"))},
                   {_to(2, "user", [(0, ""), (1, ""), (3, ""), (2, "assistant")])},
                   {_to(3, "assistant", [(2, ""), (0, "user"), (1, "user"), (3, "user")])}
            FROM walk w JOIN rows ON rows.conv_id IS NOT DISTINCT FROM w.conv_id AND rows.i = w.i + 1),
        ends AS (SELECT conv_id, arg_max({_best(_way(0, "true", "0", ""), _way(3, "true", "0", ""), _way(2, "true", "5", "I", "'assistant:' || chr(10)"), _way(1, "true", "10", "II", "'user:' || chr(10) || 'assistant:' || chr(10)"))}, i) AS e FROM walk GROUP BY conv_id),
        sums AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
                        count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM rows GROUP BY conv_id)
        SELECT ends.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
               CAST(e.c AS BIGINT) AS cost, e.a AS audit, sha256(CASE WHEN e.r = '' THEN '' ELSE left(e.r, length(e.r) - 1) END) AS repaired_sha256
        FROM ends LEFT JOIN sums ON sums.conv_id IS NOT DISTINCT FROM ends.conv_id""",
    "op1_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
        d AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha256(b) AS payload_digest FROM p),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
        FROM f""",
    "op3_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t\n\x{0B}\f\r]+') AS w FROM documents),
        grams AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, CAST(len(w) - 11 AS BIGINT))) AS i FROM d WHERE len(w) >= 13)),
        firsts AS (SELECT *, min(doc_id) OVER (PARTITION BY g) AS first FROM grams),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM firsts WHERE first < doc_id),
        words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, CAST(len(w) + 1 AS BIGINT))) AS k FROM d),
        kept AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.k) AS t FROM words ANTI JOIN gone ON words.doc_id = gone.doc_id AND words.k = gone.k GROUP BY words.doc_id),
        n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id LEFT JOIN n ON d.doc_id = n.doc_id""",
    "op6_decontamination": r"""
        WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
        bw AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
        grams AS (
            SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS g
            FROM (SELECT item, w, least(len(w), 13) AS n, unnest(range(1, CAST(len(w) - least(len(w), 13) + 2 AS BIGINT))) AS i FROM bw WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT n FROM grams),
        spots AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
               FROM (SELECT doc_id, w, n, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS i FROM dw, sizes WHERE len(w) >= n)),
        hits AS (SELECT doc_id, s.n, i, item FROM spots s JOIN grams ON s.g = grams.g AND s.n = grams.n),
        hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, CAST(i + n AS BIGINT))) AS k FROM hits) GROUP BY doc_id),
        items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM hits GROUP BY doc_id)
        SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
               sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM dw LEFT JOIN hit ON dw.doc_id = hit.doc_id LEFT JOIN items ON dw.doc_id = items.doc_id""",
    "op7_sharding": """
        WITH RECURSIVE poly(i, k, c) AS (
            SELECT i, 0, CAST(i AS BIGINT) FROM range(0, 256) r(i)
            UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM poly WHERE k < 8),
        crc AS (SELECT list(c ORDER BY i) AS t FROM poly WHERE k = 8),
        d AS (SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
        c AS (SELECT doc_id, n + 8 AS size, xor(4294967295, list_reduce(list_transform(range(1, 2 * n, 2), lambda i: CAST(('0x' || substr(h, i, 2)) AS BIGINT)), lambda c, b: xor(t[1 + (xor(c, b) & 255)], c >> 8), 4294967295)) AS text_crc32 FROM d, crc),
        b AS (SELECT *, sum(size) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - size AS b, sum(size) OVER () AS total FROM c),
        p AS (SELECT *, CAST((b * 24) // total AS INTEGER) AS shard FROM b)
        SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM p""",
    "op9_url_filter": r"""
        WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                          regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
        rules(verdict, h, q) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'), ('allow', 'example.net', '/de/8'), ('block', 'org', '/es/')),
        fits AS (SELECT page_id, max_by(h || q, length(h || q)) AS rule, max_by(verdict, length(h || q)) AS verdict
                 FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY page_id)
        SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN fits ON p.page_id = fits.page_id""",
}
