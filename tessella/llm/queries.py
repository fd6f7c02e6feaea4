"""The registered queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from . import chat_tools, conversation_repair, decontaminate, divergence, license_scan, packing, quality, secret_scan, simhash, substring_dedup, suffix_dedup, voronoi_knn, warc
from .common import table
from .license_texts import DIGESTS, KNOWN


def op1_license_scan(spark, sf_dir):
    """The licence that a whole document is, and the one-line notices among its lines (of all rows of a repeated doc_id)."""
    docs, known = table(spark, sf_dir, "documents"), license_scan.known_licenses(spark)
    notices = license_scan.scan_lines(docs, known).groupBy(F.col("doc_id").alias("noticed")).agg(F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("notices"))
    out = license_scan.scan(docs, known)
    return out.join(notices, F.col("doc_id").eqNullSafe(F.col("noticed")), "left").drop("noticed")


def op2_warc_round_trip(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("url", "block")


def op3_substring_dedup(spark, sf_dir):
    return substring_dedup.substring_dedup_digests(table(spark, sf_dir, "documents"))


TOOL = '{"tools":[{"type":"function","function":{"name":"answer","parameters":{"type":"object","additionalProperties":false,"properties":{"about":{"type":"object","properties":{"turn":{"type":"integer"}},"required":["turn"]},"question":{"type":["string","null"]}},"required":["question"]}}}]}'


def tool_turns(conversations):
    """Every conversation told again with a tool (conv_id -1 - conv_id): a user's turn is a call, the turn after it the
    result, a system's turn the offer of the tool. A call depends on the user's next turn, so calls are ordered backwards;
    every third gives its turn as a string, and those of every fifth conversation an argument that is not allowed."""
    r, turn = F.col("role"), F.col("turn").cast("long")
    name = lambda t: F.concat(F.lit("c"), t.cast("string"))
    about = F.concat(F.lit('{"turn":'), F.when(turn % 3 == 2, F.concat(F.lit('"'), turn.cast("string"), F.lit('"'))).otherwise(turn.cast("string")), F.lit("}"))
    quoted = F.expr("coalesce(substr(to_json(array(text)), 2, length(to_json(array(text))) - 2), 'null')")
    extra = F.when(F.col("conv_id") % 5 == 0, '"extra":1,').otherwise("")
    call = F.concat(F.lit('{"tool_calls":[{"type":"function","id":"'), name(turn), F.lit('","depends_on":["'), name(turn + 2), F.lit('"],"function":{"name":"answer","arguments":{"question":'), quoted, F.lit(","), extra, F.lit('"about":'), about, F.lit("}}}]}"))
    result = F.concat(F.lit('{"content":'), quoted, F.lit(',"tool_call_id":"'), name(turn - 1), F.lit('"}'))
    text = F.when(r == "user", call).when(r == "system", F.lit(TOOL)).otherwise(result)
    role = F.when(r == "user", "assistant").when(r == "system", "system").otherwise("tool")
    return conversations.select((-1 - F.col("conv_id")).alias("conv_id"), "turn", role.alias("role"), text.alias("text"))


def op4_chat_tools(spark, sf_dir):
    """The conversations as they are and, as they hold no calls, told again with calls (`tool_turns`)."""
    try:  # a table (name, schema) of tools, where there is one
        tools = table(spark, sf_dir, "tools").select("name", "schema")
    except AnalysisException:
        tools = None
    told = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    out = chat_tools.link_tool_calls(told.unionByName(tool_turns(told)), tools)
    return out.withColumn("errors", F.array_join("errors", "; "))


def op5_decontaminate(spark, sf_dir):
    return decontaminate.contaminated_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, quality.learnable(table(spark, sf_dir, "labels")))
    out = quality.score(docs, model)
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_simhash(spark, sf_dir):
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark, sf_dir):
    return suffix_dedup.suffix_dedup_digests(table(spark, sf_dir, "documents"))


def op10_voronoi_knn(spark, sf_dir):
    rows = voronoi_knn.integer_vectors(table(spark, sf_dir, "embeddings"))
    return voronoi_knn.knn_join(rows, F.col("vec_id") % 50 == 0)


def op11_conversation_repair(spark, sf_dir):
    return conversation_repair.repair_digests(conversation_repair.damage(table(spark, sf_dir, "conversations")))


def op12_secret_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return secret_scan.span_digests(secret_scan.secret_spans(docs, secret_scan.fit(docs)))


def op13_divergence(spark, sf_dir):
    return divergence.divergence_audit(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_warc_round_trip, op3_substring_dedup, op4_chat_tools, op5_decontaminate, op6_quality, op7_packing, op8_simhash, op9_suffix_dedup, op10_voronoi_knn, op11_conversation_repair, op12_secret_scan, op13_divergence)}

_known = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted(KNOWN.items()))
_digests = ", ".join(f"('{k}', '{v}')" for k, v in sorted(DIGESTS.items()))

ORACLE = {
    "op1_license_scan": f"""
        WITH known AS (
            SELECT canonical_sha256, min(license_id) AS license_id FROM (
                SELECT license_id, sha256({license_scan.canonical_sql("license_text")}) AS canonical_sha256 FROM (VALUES {_known}) AS k(license_id, license_text)
                UNION ALL SELECT license_id, canonical_sha256 FROM (VALUES {_digests}) AS k(license_id, canonical_sha256)) GROUP BY 1),
        docs AS (SELECT doc_id, text, sha256({license_scan.canonical_sql("text")}) AS canonical_sha256 FROM documents),
        lines AS (SELECT DISTINCT doc_id, line FROM (SELECT doc_id, unnest(string_split(replace(text, chr(13), chr(10)), chr(10))) AS line FROM documents) WHERE regexp_matches(lower(line), 'licen[cs]e')),
        notices AS (SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices
                    FROM (SELECT doc_id, sha256({license_scan.canonical_sql("line")}) AS canonical_sha256 FROM lines) JOIN known USING (canonical_sha256) GROUP BY 1)
        SELECT d.doc_id, d.canonical_sha256, license_id, notices FROM docs AS d LEFT JOIN known USING (canonical_sha256) LEFT JOIN notices AS n ON n.doc_id IS NOT DISTINCT FROM d.doc_id""",
    "op2_warc_round_trip": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS payload_digest, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages),
        f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY 1)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN first_id < page_id THEN first_id END AS refers_to
        FROM p LEFT JOIN f USING (payload_digest)""",
    "op3_substring_dedup": r"""
        WITH d AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\x09-\x0D ]+') IF x <> ''] AS w FROM documents),
        s AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
        f AS (SELECT k, min(doc_id) AS m FROM s GROUP BY k),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM s JOIN f USING (k) WHERE m < doc_id),
        word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d),
        kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)""",
    # holds where conversations hold no calls of their own and no (conv_id, turn) twice, as in all given tables
    "op4_chat_tools": """
        WITH RECURSIVE t AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, role, text FROM conversations),
        u AS (SELECT t.*, a.turn AS answer_turn FROM t LEFT JOIN t AS a ON a.conv_id = t.conv_id AND a.turn = t.turn + 1 AND a.role NOT IN ('user', 'system') WHERE t.role = 'user'),
        walk AS (
            SELECT conv_id, turn AS start, turn AS cur, CAST(0 AS BIGINT) AS steps, turn AS top FROM u
            UNION ALL
            SELECT w.conv_id, w.start, u.turn, w.steps + 1, greatest(w.top, u.turn, coalesce(u.answer_turn, u.turn)) FROM walk AS w JOIN u ON u.conv_id = w.conv_id AND u.turn = w.cur + 2),
        calls AS (SELECT u.*, d.steps AS after, d.top AS before_turn FROM u JOIN (SELECT conv_id, start, max(steps) AS steps, max(top) AS top FROM walk GROUP BY 1, 2) AS d ON d.conv_id = u.conv_id AND d.start = u.turn),
        offered AS (SELECT DISTINCT conv_id FROM t WHERE role = 'system'),
        plain AS (
            SELECT conv_id, turn, role, text AS said FROM t
            UNION ALL SELECT -1 - conv_id, turn, 'system', '{"tools":[{"type":"function","function":{"name":"answer","parameters":{"type":"object","additionalProperties":false,"properties":{"about":{"type":"object","properties":{"turn":{"type":"integer"}},"required":["turn"]},"question":{"type":["string","null"]}},"required":["question"]}}}]}' FROM t WHERE role = 'system')
        SELECT conv_id, turn, CAST(0 AS BIGINT) AS pos, role, 'message' AS kind, CAST(NULL AS VARCHAR) AS call_id, turn AS order_turn, CAST(0 AS BIGINT) AS depth, 'ok' AS status,
               CAST(NULL AS BOOLEAN) AS known_tool, '' AS errors, CAST(to_json({'content': said, 'role': role}) AS VARCHAR) AS canonical FROM plain
        UNION ALL
        SELECT -1 - conv_id, turn, 0, 'assistant', 'call', 'c' || turn, before_turn, 2 * after, CASE WHEN answer_turn IS NULL THEN 'unanswered' ELSE 'ok' END, o.conv_id IS NOT NULL,
               CASE WHEN o.conv_id IS NULL THEN '' ELSE concat_ws('; ', CASE WHEN turn % 3 = 2 THEN 'about.turn: wrong type' END, CASE WHEN c.conv_id % 5 = 0 THEN 'extra: not allowed' END) END,
               '{"arguments":{"about":{"turn":' || CASE WHEN turn % 3 = 2 THEN '"' || turn || '"' ELSE CAST(turn AS VARCHAR) END || '}' || CASE WHEN c.conv_id % 5 = 0 THEN ',"extra":1' ELSE '' END
               || ',"question":' || coalesce(CAST(to_json(text) AS VARCHAR), 'null') || '},"depends_on":["c' || (turn + 2) || '"],"id":"c' || turn || '","name":"answer","role":"assistant"}'
        FROM calls AS c LEFT JOIN offered AS o USING (conv_id)
        UNION ALL
        SELECT -1 - r.conv_id, r.turn, 0, 'tool', 'result', 'c' || (r.turn - 1), greatest(r.turn, coalesce(c.before_turn, r.turn)), CASE WHEN c.turn IS NULL THEN 0 ELSE 2 * c.after + 1 END,
               CASE WHEN c.turn IS NULL THEN 'orphan' ELSE 'ok' END, NULL, '', '{"content":' || coalesce(CAST(to_json(r.text) AS VARCHAR), 'null') || ',"role":"tool","tool_call_id":"c' || (r.turn - 1) || '"}'
        FROM (SELECT * FROM t WHERE role NOT IN ('user', 'system')) AS r LEFT JOIN calls AS c ON c.conv_id = r.conv_id AND c.turn = r.turn - 1""",
    "op10_voronoi_knn": """
        WITH v AS (SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        s AS (SELECT q.vec_id AS query_id, d.vec_id AS vec_id, CAST(list_inner_product(q.v, d.v) AS BIGINT) AS score
              FROM v AS q JOIN v AS d ON q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
    "op11_conversation_repair": r"""
        WITH RECURSIVE crc AS (SELECT 0 AS j, range AS x, range AS i FROM range(256) UNION ALL SELECT j + 1, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, i FROM crc WHERE j < 8),
        tab AS (SELECT list(x ORDER BY i) AS tab FROM crc WHERE j = 8),
        src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name, row_number() OVER () AS id FROM conversations),
        hash AS (SELECT id, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST(ord(c) AS BIGINT) FOR c IN string_split(name, '')]), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) % 20 AS what FROM src, tab),
        hurt AS (SELECT conv_id, turn, CASE WHEN what = 4 THEN 'user' ELSE role END AS role, CASE WHEN what = 1 THEN '' WHEN what = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE what WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
                 FROM src JOIN hash USING (id)),
        ids AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) AS c FROM (SELECT DISTINCT conv_id FROM conversations)),
        placed AS (SELECT c, turn, role, text, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, left(text, 64), sha256(text), copy) AS i FROM hurt JOIN ids ON hurt.conv_id IS NOT DISTINCT FROM ids.conv_id),
        faults AS (SELECT *, left(role, 1) AS ini, lag(left(role, 1)) OVER (PARTITION BY c ORDER BY i) AS prev, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
                   row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 AS again, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS cut FROM placed),
        rws AS (SELECT *, blank OR again AS gone, CAST(cut AS INT) AS t, count(*) OVER (PARTITION BY c) AS n FROM faults),
        cnt AS (SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
                count(*) FILTER (cut AND NOT gone) AS truncated, count(*) FILTER (prev || ini NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM rws GROUP BY c),
        go AS (SELECT c, n + 1 AS i, [0, 4, 2, 0] AS v FROM (SELECT c, coalesce(n, 0) AS n FROM ids LEFT JOIN cnt USING (c)) UNION ALL
               SELECT c, i, [least(b[1], 2 + b[3], 4 + b[4]), least(b[2], 2 + b[3], 4 + b[4]), least(b[3], 2 + b[4]), least(b[4], 2 + b[3])] FROM (
               SELECT r.c, r.i, CASE WHEN gone THEN [3 + v[1], 3 + v[2], 3 + v[3], 3 + v[4]] ELSE [
                 least(3 + v[1], 2 + t + v[3], CASE ini WHEN 's' THEN t + v[2] WHEN 'u' THEN t + v[3] END), least(3 + v[2], 2 + t + v[3], CASE WHEN ini = 'u' THEN t + v[3] END),
                 least(3 + v[3], 2 + t + v[4], CASE WHEN ini = 'a' THEN t + v[4] END), least(3 + v[4], 2 + t + v[3], CASE WHEN ini = 'u' THEN t + v[3] END)] END AS b FROM go JOIN rws AS r ON r.c = go.c AND r.i = go.i - 1)),
        walk AS (SELECT c, CAST(1 AS BIGINT) AS i, 1 AS q, '' AS audit, CAST([] AS VARCHAR[]) AS kept FROM ids UNION ALL
               SELECT c, CASE WHEN e = 'I' THEN i ELSE i + 1 END, CASE e WHEN 'D' THEN q WHEN 'K' THEN CASE ini WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END ELSE CASE q WHEN 3 THEN 4 ELSE 3 END END, audit || e,
                 CASE e WHEN 'D' THEN kept WHEN 'K' THEN list_append(kept, role || ':' || text) ELSE list_append(kept, CASE q WHEN 3 THEN 'assistant' ELSE 'user' END || ':' || CASE e WHEN 'I' THEN '' ELSE text END) END FROM (
               SELECT w.c, w.i, q, audit, kept, r.ini, r.role, r.text, CASE WHEN h.v[q] = 3 + g.v[q] THEN 'D' WHEN h.v[q] = 2 + h.v[CASE q WHEN 3 THEN 4 ELSE 3 END] THEN 'I'
                 WHEN NOT gone AND h.v[q] = t + g.v[CASE WHEN q = 1 AND ini = 's' THEN 2 WHEN q <> 3 AND ini = 'u' THEN 3 WHEN q = 3 AND ini = 'a' THEN 4 END] THEN 'K'
                 WHEN NOT gone AND h.v[q] = 2 + t + g.v[CASE q WHEN 3 THEN 4 ELSE 3 END] THEN 'R' END AS e
               FROM walk AS w JOIN go AS h ON h.c = w.c AND h.i = w.i LEFT JOIN go AS g ON g.c = w.c AND g.i = w.i + 1 LEFT JOIN rws AS r ON r.c = w.c AND r.i = w.i) WHERE e IS NOT NULL),
        done AS (SELECT c, arg_max(audit, length(audit)) AS audit, arg_max(array_to_string(kept, chr(10)), length(audit)) AS told FROM walk GROUP BY c)
        SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
               CAST(go.v[1] AS BIGINT) AS cost, audit, sha256(told) AS repaired_sha256
        FROM ids LEFT JOIN cnt USING (c) JOIN go ON go.c = ids.c AND go.i = 1 JOIN done ON done.c = ids.c""",
    "op13_divergence": r"""
        WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
        t AS (SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
        k AS (SELECT lang, term, count(*) AS total FROM t GROUP BY 1, 2 HAVING count(DISTINCT id) >= 30),
        g AS (SELECT DISTINCT lang, source FROM d),
        c AS (SELECT g.lang, g.source, k.term, k.total, coalesce(n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM t GROUP BY 1, 2, 3) AS u ON u.lang = g.lang AND u.source = g.source AND u.term = k.term),
        p AS (SELECT lang, source, term, n, CAST(1 + CAST(1000000000 AS HUGEINT) * (n + 5) // (sum(n) OVER s + 5 * count(*) OVER s) AS BIGINT) AS p,
                     CAST(1 + CAST(1000000000 AS HUGEINT) * (total + 5) // (sum(total) OVER s + 5 * count(*) OVER s) AS BIGINT) AS q FROM c WINDOW s AS (PARTITION BY lang, source)),
        r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(v, 0) AS value FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source
              LEFT JOIN (SELECT x.lang, x.source, y.source AS other, CAST(sum(abs(x.p - y.p)) AS BIGINT) AS v FROM p AS x JOIN p AS y ON x.lang = y.lang AND x.term = y.term GROUP BY 1, 2, 3) AS f
              ON f.lang = a.lang AND f.source = a.source AND f.other = b.source
              UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
        SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
        WHERE part = 'pair' OR rank <= 50""",
}
