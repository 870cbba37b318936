"""Queries over texts: digests, parsing, grading, prompts, projections."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import grading as G
from ..functions import text as T
from ..operators import contracts, fixtures, memory, observations, retail
from ..sources.derive import MESSAGES, TOOL_MESSAGES, messages, table, tool_messages
from .registry import query
from .trajectory import observation_lines

MARK = f"'{T.TRUNCATION_MARKER}'"
R6 = lambda c: F.round(c, 6)


def cut_sql(x, head, tail):
    return f"CASE WHEN length({x}) <= {head + tail + len(T.TRUNCATION_MARKER)} THEN {x} ELSE left({x}, {head}) || {MARK} || right({x}, {tail}) END"


@query(f"SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN '<empty>' ELSE {cut_sql('text', 300, 300)} END AS digest FROM documents")
def q_digest_rule(spark, d):
    text = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").select("doc_id", F.when(text == "", "<empty>").otherwise(T.rule_digest(text)).alias("digest"))


@query(f"SELECT page_id, to_json({{'title': url, 'text_excerpt': {cut_sql('html', 800, 400)}, 'full_length_chars': length(html)}})::VARCHAR AS digest FROM pages")
def q_digest_page(spark, d):
    return table(spark, d, "pages").select("page_id", T.page_digest(F.col("url"), F.col("html")).alias("digest"))


OBS_TEXT = """ob AS (SELECT session_id, msg_idx AS seq, '- 2024-01-' || lpad((msg_idx % 28 + 1)::VARCHAR, 2, '0') || ' (' || ['high', 'med', 'low'][(msg_idx % 3 + 1)::INT] || ') ' || text AS line FROM m WHERE role = 'user'),
    ot AS (SELECT session_id, 0::BIGINT AS source_turn, string_agg(regexp_replace(line, '[\\r\\n]', ' ', 'g') || chr(10) || '  - detail ' || seq, chr(10) ORDER BY seq) || chr(10) || '- 2024/02/01 (sure) odd' || chr(10) || '- 1700000000 (low) numbered' AS text FROM ob GROUP BY 1),
    ln AS (SELECT session_id, source_turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM ot),
    mk AS (SELECT *, split_part(line, ' ', 1) = '-' AS headed, split_part(line, ' ', 2) AS ts, split_part(line, ' ', 3) AS lv FROM ln WHERE trim(line) <> ''),
    pa AS (SELECT *, headed AND lv IN ('(high)', '(med)', '(low)') AS is_obs FROM mk),
    pb AS (SELECT *, sum(is_obs::INT) OVER (PARTITION BY session_id, source_turn ORDER BY pos) AS parent,
        ltrim(substr(line, length('- ' || ts || ' ' || lv) + 1)) AS st FROM pa),
    po AS (SELECT session_id, source_turn, parent::BIGINT AS seq, max(CASE WHEN is_obs THEN CASE WHEN contains(ts, '-') THEN epoch(ts::DATE)::BIGINT ELSE ts::BIGINT END END) AS timestamp,
            max(trim(lv, '()')) FILTER (is_obs) AS confidence, max(st) FILTER (is_obs) AS statement, count(*) FILTER (starts_with(line, '  - '))::BIGINT AS n_details, NULL::VARCHAR AS reason FROM pb WHERE parent > 0 GROUP BY 1, 2, 3
        UNION ALL SELECT session_id, source_turn, NULL, NULL, NULL, line, 0, 'unknown confidence' FROM pb WHERE headed AND NOT is_obs AND starts_with(lv, '('))"""


def parsed_observations(spark, d):
    clean = F.concat(F.regexp_replace("line", "[\\r\\n]", " "), F.lit("\n  - detail "), F.col("seq").cast("string"))
    lines = observation_lines(spark, d).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("seq", clean.alias("line")))).alias("l"))
    text = F.concat(F.array_join(F.col("l")["line"], "\n"), F.lit("\n- 2024/02/01 (sure) odd\n- 1700000000 (low) numbered"))
    return observations.parse(lines.select("session_id", F.lit(0).cast("long").alias("source_turn"), text.alias("text")))


@query(f"WITH {MESSAGES}, {OBS_TEXT} SELECT * FROM po")
def q_observation_parse(spark, d):
    return parsed_observations(spark, d)


@query(f"""WITH {MESSAGES}, {OBS_TEXT}, nn AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY timestamp, source_turn, seq) AS i FROM po WHERE reason IS NULL)
    SELECT session_id, '## Observations from prior turns' || chr(10) || string_agg('- obs#' || i || ' ts=' || timestamp || ' (' || confidence || ') ' || statement, chr(10) ORDER BY i) AS note FROM nn GROUP BY 1""")
def q_observation_note(spark, d):
    return observations.note(parsed_observations(spark, d))


ANSWER = "CASE doc_id % 4 WHEN 0 THEN text || ' So. Final answer: ' || text WHEN 1 THEN text || 'Final answer: no. Final answer:** ' || n_chars WHEN 2 THEN 'Final answer:** ' || text || ' Final answer: x' ELSE text END"


def answers(spark, d):
    k, text = F.col("doc_id") % 4, F.col("text")
    response = (
        F.when(k == 0, F.concat(text, F.lit(" So. Final answer: "), text))
        .when(k == 1, F.concat(text, F.lit("Final answer: no. Final answer:** "), F.col("n_chars").cast("string")))
        .when(k == 2, F.concat(F.lit("Final answer:** "), text, F.lit(" Final answer: x")))
        .otherwise(text)
    )
    return table(spark, d, "documents").select("doc_id", "n_chars", response.alias("response"))


FINAL = "CASE WHEN contains(response, 'Final answer:**') THEN trim(list_last(string_split(response, 'Final answer:**'))) WHEN contains(response, 'Final answer:') THEN trim(list_last(string_split(response, 'Final answer:'))) ELSE trim(response) END"


@query(f"SELECT doc_id, {FINAL} AS answer FROM (SELECT doc_id, {ANSWER} AS response FROM documents)")
def q_final_answer(spark, d):
    return answers(spark, d).select("doc_id", G.final_answer(F.col("response")).alias("answer"))


BARE = lambda x: f"regexp_replace(lower({x}), '[\\s\\p{{P}}]', '', 'g')"
VALUE = lambda x: f"try_cast(trim(translate({x}, '$,%', '')) AS DOUBLE)"


@query(f"""WITH a AS (SELECT doc_id, n_chars, source, CASE doc_id % 4 WHEN 0 THEN n_chars::VARCHAR WHEN 1 THEN lang || ', ' || n_chars || '; ' || source ELSE text END AS truth,
        CASE doc_id % 4 WHEN 0 THEN CASE WHEN doc_id % 3 = 0 THEN (n_chars + 1)::VARCHAR ELSE '$' || n_chars || '.0' END WHEN 1 THEN CASE WHEN doc_id % 5 = 0 THEN lang || ',' || source || ',' || n_chars ELSE upper(lang) || ',' || n_chars || '.0,' || source || '!' END
            WHEN 2 THEN ' ' || replace(text, ' ', ' - ') || ' ?!' ELSE text || ' and more' END AS answer FROM documents)
    SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN {VALUE("answer")} = n_chars WHEN 1 THEN {VALUE("split_part(answer, ',', 2)")} IS NOT DISTINCT FROM n_chars AND {BARE("split_part(answer, ',', 3)")} = {BARE("source")} AND {BARE("split_part(answer, ',', 1)")} = {BARE("split_part(truth, ',', 1)")}
        WHEN 2 THEN {BARE("answer")} = {BARE("truth")} ELSE {BARE("answer")} = {BARE("truth")} END AS correct FROM a""")
def q_answer_score(spark, d):
    """Numbers, lists and whole texts of the documents, each against a right or a wrong reply made from the same row."""
    kind, n = F.col("doc_id") % 4, F.col("n_chars").cast("string")
    truth = F.when(kind == 0, n).when(kind == 1, F.concat("lang", F.lit(", "), n, F.lit("; "), "source")).otherwise(F.col("text"))
    as_number = F.when(F.col("doc_id") % 3 == 0, (F.col("n_chars") + 1).cast("string")).otherwise(F.concat(F.lit("$"), n, F.lit(".0")))
    as_list = F.when(F.col("doc_id") % 5 == 0, F.concat_ws(",", "lang", "source", n)).otherwise(F.concat(F.upper("lang"), F.lit(","), n, F.lit(".0,"), "source", F.lit("!")))
    as_text = F.when(kind == 2, F.concat(F.lit(" "), F.replace(F.col("text"), F.lit(" "), F.lit(" - ")), F.lit(" ?!"))).otherwise(F.concat("text", F.lit(" and more")))
    answer = F.when(kind == 0, as_number).when(kind == 1, as_list).otherwise(as_text)
    # a whole text that holds a comma is a list to the grader, so texts go without
    plain = lambda x: F.when(kind > 1, F.translate(x, ",;", "")).otherwise(x)
    return table(spark, d, "documents").select("doc_id", G.grade(plain(answer), plain(truth)).alias("correct"))


@query("""SELECT doc_id, word = 'yes' AS starts_yes, CASE word WHEN 'yes' THEN true WHEN 'no' THEN false END AS yes_no, contains(lower(reply), 'yes') AS loose_yes, CASE WHEN doc_id % 4 = 2 THEN (n_chars % 3) / 2.0 WHEN doc_id % 4 = 3 THEN NULL END::DOUBLE AS level
    FROM (SELECT *, regexp_extract(lower(trim(reply)), '^[a-z0-9_]*') AS word FROM (SELECT doc_id, n_chars, text, CASE doc_id % 4 WHEN 0 THEN ' Yes, ' || text WHEN 1 THEN 'No: ' || text WHEN 2 THEN 'verdict {"score": ' || (n_chars % 3) / 2.0 || '} of ' || n_chars ELSE replace(text, '{', '(') END AS reply FROM documents))""")
def q_judge_parse(spark, d):
    """Replies made from the documents' whole texts; the last kind has no JSON object."""
    kind, text = F.col("doc_id") % 4, F.col("text")
    verdict = F.format_string('verdict {"score": %.1f} of %d', (F.col("n_chars") % 3) / 2.0, "n_chars")
    reply = F.when(kind == 0, F.concat(F.lit(" Yes, "), text)).when(kind == 1, F.concat(F.lit("No: "), text)).when(kind == 2, verdict).otherwise(F.replace(text, F.lit("{"), F.lit("(")))
    r = table(spark, d, "documents").select("doc_id", reply.alias("reply"))
    yes = G.yes_no(F.col("reply"))
    return r.select("doc_id", F.coalesce(yes, F.lit(False)).alias("starts_yes"), yes.alias("yes_no"), F.contains(F.lower("reply"), F.lit("yes")).alias("loose_yes"), G.three_level(F.col("reply")).alias("level"))


@query("""WITH n AS (SELECT doc_id AS task_id, ['all', 'any', 'mean'][(doc_id % 3 + 1)::INT] AS rule, unnest([quality, 1 - toxic, (doc_id % 2)::INT]) AS score FROM labels)
    SELECT task_id, any_value(rule) AS rule, CASE any_value(rule) WHEN 'all' THEN min(score)::DOUBLE WHEN 'any' THEN max(score)::DOUBLE ELSE round(avg(score), 6) END AS score FROM n GROUP BY 1""")
def q_composite_score(spark, d):
    rule = F.element_at(F.array(F.lit("all"), F.lit("any"), F.lit("mean")), (F.col("doc_id") % 3 + 1).cast("int"))
    leaves = F.array(F.col("quality"), 1 - F.col("toxic"), (F.col("doc_id") % 2).cast("int"))
    n = table(spark, d, "labels").select(F.col("doc_id").alias("task_id"), rule.alias("rule"), F.explode(leaves).alias("score"))
    s = F.when(F.col("rule") == "all", F.col("lo")).when(F.col("rule") == "any", F.col("hi")).otherwise(F.col("mean"))
    return n.groupBy("task_id", "rule").agg(F.min("score").cast("double").alias("lo"), F.max("score").cast("double").alias("hi"), R6(F.avg("score")).alias("mean")).select("task_id", "rule", s.alias("score"))


@query(f"""WITH {TOOL_MESSAGES}, rq(tool_name) AS (VALUES ('web_search'), ('python_exec')), seen AS (SELECT DISTINCT session_id, tool_name FROM t WHERE part_type = 'tool_use'), s AS (SELECT DISTINCT session_id FROM t)
    SELECT s.session_id, count(seen.tool_name)::BIGINT AS required_called, count(*)::BIGINT AS required_total, count(seen.tool_name) = count(*) AS pass FROM s, rq LEFT JOIN seen ON seen.session_id = s.session_id AND seen.tool_name = rq.tool_name GROUP BY 1""")
def q_tool_coherence(spark, d):
    required = ["web_search", "python_exec"]
    called = F.array_intersect(F.collect_set(F.when(F.col("part_type") == "tool_use", F.col("tool_name"))), F.array(*map(F.lit, required)))
    s = tool_messages(spark, d).groupBy("session_id").agg(F.size(called).cast("long").alias("required_called"), F.lit(len(required)).cast("long").alias("required_total"))
    return s.withColumn("pass", F.col("required_called") == F.col("required_total"))


@query("""WITH a AS (SELECT o_orderkey AS order_id, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'delivered' ELSE 'processed' END AS status, list_sort(list_distinct(list(l_partkey))) AS items, any_value(o_custkey) AS user_id FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)
    SELECT user_id, min(CASE WHEN order_id % 5 = 0 AND status <> 'delivered' THEN 0 WHEN order_id % 7 = 0 AND len(items) <> 1 THEN 0 ELSE 1 END)::INT AS reward FROM a GROUP BY 1""")
def q_reward(spark, d):
    """Expectations: every fifth order delivered, every seventh with its first item alone, the rest as they are."""
    actual = orders_with_items(spark, d)
    status = F.when(F.col("order_id") % 5 == 0, "delivered")
    items = F.when(F.col("order_id") % 7 == 0, F.slice(F.array_sort(F.array_distinct("items")), 1, 1))
    expected = actual.select("order_id", "user_id", status.alias("status"), items.alias("items"))
    return retail.task_reward(retail.order_reward(actual.drop("user_id"), expected), "user_id")


def status_of():
    return F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "delivered").otherwise("processed")


def orders(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("user_id"), status_of().alias("status"), F.col("o_totalprice").alias("paid"))


def orders_with_items(spark, d):
    items = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("order_id")).agg(F.collect_list("l_partkey").alias("items"))
    return orders(spark, d).drop("paid").join(items, "order_id")


@query("""SELECT o_orderkey AS order_id, CASE WHEN o_orderkey % 11 = 0 THEN 'removed' ELSE 'changed' END AS change FROM orders WHERE o_orderkey > 0 AND (o_orderkey % 11 = 0 OR (o_orderkey % 3 = 0 AND o_orderstatus = 'O'))
    UNION ALL SELECT -o_orderkey, 'added' FROM orders WHERE o_orderkey > 0 AND o_orderkey % 13 = 0""")
def q_env_diff(spark, d):
    before = orders(spark, d).filter("order_id > 0").select("order_id", "status")
    cancelled = F.when((F.col("order_id") % 3 == 0) & (F.col("status") == "pending"), "cancelled").otherwise(F.col("status"))
    after = before.filter("order_id % 11 <> 0").select("order_id", cancelled.alias("status"))
    after = after.unionByName(before.filter("order_id % 13 = 0").select((-F.col("order_id")).alias("order_id"), "status"))
    return retail.env_diff(before, after, "order_id")


@query("""SELECT o_orderkey AS order_id, round(sum(l_extendedprice), 2) AS refund, count(*)::BIGINT AS n_items FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' AND l_partkey % 2 = 0 GROUP BY 1""")
def q_return_refund(spark, d):
    items = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("item_id"), F.col("l_extendedprice").alias("price"))
    wanted = items.filter("item_id % 2 = 0").select("order_id", "item_id").distinct()
    done = retail.return_items(orders(spark, d), items, wanted).filter("error is null")
    return done.select("order_id", F.round("refund", 2).alias("refund"), "n_items")


@query("""SELECT o_orderkey AS order_id, CASE WHEN o_orderstatus = 'O' THEN 'cancelled' WHEN o_orderstatus = 'F' THEN 'delivered' ELSE 'processed' END AS new_status, CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE 0 END AS refund,
    CASE WHEN o_orderstatus <> 'O' THEN 'order ' || o_orderkey || ' not pending (status=' || CASE WHEN o_orderstatus = 'F' THEN 'delivered' ELSE 'processed' END || ')' END AS error FROM orders""")
def q_cancel_refund(spark, d):
    return retail.cancel(orders(spark, d))


USERS = "u AS (SELECT c_custkey AS user_id, lower(split_part(c_name, '#', 1)) || c_custkey || '@example.com' AS email, split_part(c_name, '#', 1) AS first_name, split_part(c_name, '#', 2) AS last_name, lpad(c_nationkey::VARCHAR, 5, '0') AS zip FROM customer)"


def users(spark, d):
    name = F.split("c_name", "#")
    first, last = F.get(name, F.lit(0)), F.get(name, F.lit(1))
    email = F.concat(F.lower(first), F.col("c_custkey").cast("string"), F.lit("@example.com"))
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("user_id"), email.alias("email"), first.alias("first_name"), last.alias("last_name"), F.lpad(F.col("c_nationkey").cast("string"), 5, "0").alias("zip")
    )


@query(f"WITH {USERS}, a AS (SELECT CASE WHEN user_id % 10 = 0 THEN 'nobody' || user_id || '@example.com' ELSE email END AS email FROM u) SELECT a.email, coalesce(u.user_id::VARCHAR, 'user_id_not_found') AS answer FROM a LEFT JOIN u USING (email)")
def q_user_by_email(spark, d):
    u = users(spark, d)
    email = F.when(F.col("user_id") % 10 == 0, F.concat(F.lit("nobody"), F.col("user_id").cast("string"), F.lit("@example.com"))).otherwise(F.col("email"))
    return retail.find_user_by_email(u, u.select(email.alias("email")))


@query(f"WITH {USERS}, a AS (SELECT first_name, last_name, CASE WHEN user_id % 7 = 0 THEN '99999' ELSE zip END AS zip FROM u) SELECT a.*, coalesce(u.user_id::VARCHAR, 'user_id_not_found') AS answer FROM a LEFT JOIN u USING (first_name, last_name, zip)")
def q_user_lookup(spark, d):
    u = users(spark, d)
    wrong = F.when(F.col("user_id") % 7 == 0, "99999").otherwise(F.col("zip"))
    return retail.find_user_by_name_zip(u, u.select("first_name", "last_name", wrong.alias("zip")))


@query("""WITH o AS (SELECT 'order' AS kind, CASE WHEN o_orderkey % 9 = 0 THEN -o_orderkey ELSE o_orderkey END AS id, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderstatus END AS found FROM orders),
    p AS (SELECT 'product', CASE WHEN p_partkey % 9 = 0 THEN -p_partkey ELSE p_partkey END, CASE WHEN p_partkey % 9 <> 0 THEN p_name END FROM part),
    us AS (SELECT 'user', CASE WHEN c_custkey % 9 = 0 THEN -c_custkey ELSE c_custkey END, CASE WHEN c_custkey % 9 <> 0 THEN c_name END FROM customer)
    SELECT kind, id, found, CASE WHEN found IS NULL THEN kind || ' not found: ' || id END AS error FROM (SELECT * FROM o UNION ALL SELECT * FROM p UNION ALL SELECT * FROM us)""")
def q_retail_details(spark, d):
    """Orders, products and users by id; every ninth request names an id that is not there."""
    out = []
    for kind, name, key, shown in (("order", "orders", "o_orderkey", "o_orderstatus"), ("product", "part", "p_partkey", "p_name"), ("user", "customer", "c_custkey", "c_name")):
        have = table(spark, d, name).filter(f"{key} > 0").select(F.col(key).alias(f"{kind}_id"), F.col(shown).alias("shown"))
        asked = table(spark, d, name).select(F.when(F.col(key) % 9 == 0, -F.col(key)).otherwise(F.col(key)).alias(f"{kind}_id"))
        out.append(retail.details(have, asked, kind).select(F.lit(kind).alias("kind"), F.col(f"{kind}_id").cast("long").alias("id"), F.col("details.shown").alias("found"), "error"))
    return out[0].unionAll(out[1]).unionAll(out[2])


COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@query(f"""SELECT query_id, vec_id, rank FROM (SELECT b.vec_id AS query_id, a.vec_id, row_number() OVER (PARTITION BY b.vec_id ORDER BY round({COS}, 5) DESC, a.vec_id)::BIGINT AS rank FROM embeddings a, embeddings b WHERE b.vec_id % 20 = 0 AND a.vec_id <> b.vec_id) WHERE rank <= 20""")
def q_memory_topk(spark, d):
    """Top 20 by cosine for the stated queries (ids divisible by 20), against all vectors."""
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    return memory.nearest(v, v.filter("vec_id % 20 = 0"), 20)


@query("""SELECT event_id, substr(sha256('{"k":' || (props->>'k') || '}'), 1, 16) AS config_id FROM events""")
def q_config_hash(spark, d):
    return table(spark, d, "events").select("event_id", T.config_id(F.col("props")).alias("config_id"))


@query("SELECT doc_id, substr(text, 1, 8000) AS capped, length(text) > 8000 AS was_cut FROM documents")
def q_text_caps(spark, d):
    return table(spark, d, "documents").select("doc_id", F.substring("text", 1, 8000).alias("capped"), (F.length("text") > 8000).alias("was_cut"))


@query("SELECT page_id, regexp_extract(url, '^(https?)://', 1) AS scheme, regexp_extract(url, '://([^/?#]+)', 1) AS host, list_last(string_split(regexp_extract(url, '://[^/?#]+([^?#]*)', 1), '/')) AS leaf FROM pages")
def q_url_extract(spark, d):
    u = F.col("url")
    leaf = F.element_at(F.split(F.regexp_extract(u, "://[^/?#]+([^?#]*)", 1), "/"), -1)
    return table(spark, d, "pages").select("page_id", F.regexp_extract(u, "^(https?)://", 1).alias("scheme"), F.regexp_extract(u, "://([^/?#]+)", 1).alias("host"), leaf.alias("leaf"))


FIELDS = ["tags", "kind", "nothing", "gone", "deep"]


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN '{' || '"tags":' || CASE WHEN n > 5 THEN '[0,"t1",{"z":2,"a":[2]},0,"t4","…"]' ELSE '[' || array_to_string(list_transform(generate_series(0, n - 1), lambda i: CASE i % 3 WHEN 0 THEN '0' WHEN 1 THEN '"t' || i || '"' ELSE '{"z":' || i || ',"a":[' || i || ']}' END), ',') || ']' END
        || ',"kind":"' || event_type || '","gone":null,"deep":{"b":' || n || ',"a":"x"}}' WHEN 1 THEN '{"kind":' || n || '}' WHEN 2 THEN '{}' ELSE event_type END AS digest FROM (SELECT event_id, event_type, event_id % 7 + 1 AS n FROM events)""")
def q_schema_digest(spark, d):
    """Objects with short and long arrays, with one field, arrays, and text that is no JSON."""
    n = (F.col("event_id") % 7 + 1).cast("int")
    entry = lambda i: F.when(i % 3 == 0, "0").when(i % 3 == 1, F.concat(F.lit('"t'), i.cast("string"), F.lit('"'))).otherwise(F.concat(F.lit('{"z":'), i.cast("string"), F.lit(',"a":['), i.cast("string"), F.lit("]}")))
    tags = F.concat(F.lit("["), F.array_join(F.transform(F.sequence(F.lit(0), n - 1), entry), ","), F.lit("]"))
    full = F.concat(F.lit('{"other":1,"gone":null,"kind":"'), F.col("event_type"), F.lit('","tags":'), tags, F.lit(',"deep":{"b":'), n.cast("string"), F.lit(',"a":"x"}}'))
    kind = F.col("event_id") % 4
    output = F.when(kind == 0, full).when(kind == 1, F.concat(F.lit('{"kind":'), n.cast("string"), F.lit("}"))).when(kind == 2, tags).otherwise(F.col("event_type"))
    return table(spark, d, "events").select("event_id", T.schema_digest(output, FIELDS).alias("digest"))


@query("""SELECT l_orderkey AS order_id, array_to_string(list(l_partkey ORDER BY l_extendedprice DESC, l_linenumber)[1:5], ',') || CASE WHEN count(*) > 5 THEN ',…' ELSE '' END AS top FROM lineitem GROUP BY 1""")
def q_top_results(spark, d):
    """Prices without a number first, none last; lines that are equal by price and number stand as the table's files have them."""
    price, number = F.col("l_extendedprice"), F.col("l_linenumber")
    order = [price.isNull(), ~F.isnan(price), -price, number.isNull(), number, F.col("_metadata.file_name"), F.col("_metadata.row_index")]
    ranked = F.array_sort(F.collect_list(F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)), "l_partkey")))
    top = F.array_join(F.transform(F.slice(ranked, 1, 5), lambda x: x["l_partkey"].cast("string")), ",")
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("order_id")).agg(F.concat(top, F.when(F.count(F.lit(1)) > 5, ",…").otherwise("")).alias("top"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN (props->>'k')::BIGINT = event_id % 10 WHEN 1 THEN true WHEN 2 THEN false ELSE (props->>'k')::BIGINT <> 3 END AS fits FROM events""")
def q_json_subset(spark, d):
    """Whether wanted arguments occur in a call's: flat values, nested objects in another key order, a missing key, nested values that differ."""
    k, n = F.get_json_object("props", "$.k"), F.col("event_id")
    call = F.format_string('{"k": %s, "at": {"x": [%s, 2], "y": {"z": null}}, "more": true}', k, k)
    wanted = (
        F.when(n % 4 == 0, F.format_string('{"k": %d}', n % 10))
        .when(n % 4 == 1, F.format_string('{"more": true, "at": {"y": {"z": null}, "x": [%s, 2]}}', k))
        .when(n % 4 == 2, F.format_string('{"k": %s, "absent": null}', k))
        .otherwise(F.format_string('{"at": {"x": [%s, 2], "y": {"z": null}}}', F.when(k == "3", "4").otherwise(k)))
    )
    return table(spark, d, "events").select("event_id", fixtures.is_subset(wanted, call).alias("fits"))


@query("""WITH a AS (SELECT l_orderkey AS k, list_sort(list_distinct(list(l_linestatus))) AS s, list_sort(list_distinct(list(l_returnflag))) AS f FROM lineitem GROUP BY 1)
    SELECT k AS order_id, s = list_value('F', 'O') AS both_states, len(f)::BIGINT AS n_flags FROM a""")
def q_set_equality(spark, d):
    s = F.array_sort(F.collect_set("l_linestatus"))
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("order_id")).agg((s == F.array(F.lit("F"), F.lit("O"))).alias("both_states"), F.size(F.collect_set("l_returnflag")).cast("long").alias("n_flags"))


@query("""SELECT user_id, string_agg(event_type, ',' ORDER BY first_at, event_type) AS kinds FROM (SELECT user_id, event_type, min(event_id) AS first_at FROM events GROUP BY 1, 2) GROUP BY 1""")
def q_ordered_distinct(spark, d):
    firsts = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first_at"))
    ordered = F.array_sort(F.collect_list(F.struct("first_at", "event_type")))
    return firsts.groupBy("user_id").agg(ordered.alias("l")).select("user_id", F.array_join(F.col("l")["event_type"], ",").alias("kinds"))


@query("""SELECT item_id, CASE WHEN item_id % 10 = 0 THEN 'abstention' ELSE ['fact', 'temporal', 'preference'][(item_id % 3 + 1)::INT] END AS kind, 'Judge whether the answer is right.' || chr(10) || 'Question: ' || text || chr(10) || 'Answer yes or no.' AS prompt FROM benchmark""")
def q_judge_prompt(spark, d):
    question_id = F.concat(F.lit("q"), F.col("item_id").cast("string"), F.when(F.col("item_id") % 10 == 0, "_abs").otherwise(""))
    kind = F.when(F.endswith(question_id, F.lit("_abs")), "abstention").otherwise(F.element_at(F.array(F.lit("fact"), F.lit("temporal"), F.lit("preference")), (F.col("item_id") % 3 + 1).cast("int")))
    return table(spark, d, "benchmark").select("item_id", kind.alias("kind"), F.format_string("Judge whether the answer is right.\nQuestion: %s\nAnswer yes or no.", "text").alias("prompt"))


@query("SELECT doc_id, regexp_matches(text, '(?i)license') AS matches, lower(lang) = 'en' AS exact FROM documents")
def q_regex_grade(spark, d):
    return table(spark, d, "documents").select("doc_id", F.col("text").rlike("(?i)license").alias("matches"), (F.lower("lang") == "en").alias("exact"))


@query("SELECT doc_id, regexp_matches(note, '\\[session-[0-9]+, turn-[0-9]+\\]') AS cited FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '[session-' || doc_id || ', turn-1] fact' ELSE 'fact [session, turn]' END AS note FROM documents)")
def q_citation_check(spark, d):
    note = F.when(F.col("doc_id") % 3 == 0, F.format_string("[session-%d, turn-1] fact", "doc_id")).otherwise("fact [session, turn]")
    return table(spark, d, "documents").select("doc_id", note.rlike(r"\[session-[0-9]+, turn-[0-9]+\]").alias("cited"))


@query("""SELECT doc_id, regexp_matches(source, '(^src1)|(_src1($|_))') AS looks_on, starts_with(source, 'src1') AS prefix_match, source = 'src1' AS exact_match, coalesce(text, '') IN ('', 'null', '""', '[]', '{}') AS is_empty, CASE WHEN lang IN ('en', 'de') THEN 'text/html' ELSE 'image/png' END LIKE 'text/%' AS mime_ok FROM documents""")
def q_name_filters(spark, d):
    mime = F.when(F.col("lang").isin("en", "de"), "text/html").otherwise("image/png")
    return table(spark, d, "documents").select(
        "doc_id", F.col("source").rlike("(^src1)|(_src1($|_))").alias("looks_on"), F.startswith("source", F.lit("src1")).alias("prefix_match"), (F.col("source") == "src1").alias("exact_match"),
        F.coalesce("text", F.lit("")).isin("", "null", '""', "[]", "{}").alias("is_empty"), F.startswith(mime, F.lit("text/")).alias("mime_ok"),
    )


@query("""SELECT item_id, model, CASE WHEN starts_with(model, 'vendor/') THEN substr(model, 8) ELSE model END AS model_for_request, CASE WHEN starts_with(model, 'vendor/') THEN 'proxy' WHEN starts_with(model, 'direct-') THEN 'direct' ELSE 'router' END AS provider,
    regexp_replace('run ' || item_id || '/x', '[^A-Za-z0-9_-]', '_', 'g') AS safe_id FROM (SELECT item_id, ['vendor/m1', 'direct-m2', 'm3'][(item_id % 3 + 1)::INT] AS model FROM benchmark)""")
def q_pricing_routes(spark, d):
    model = F.element_at(F.array(F.lit("vendor/m1"), F.lit("direct-m2"), F.lit("m3")), (F.col("item_id") % 3 + 1).cast("int"))
    b = table(spark, d, "benchmark").select("item_id", model.alias("model"))
    provider = F.when(F.startswith("model", F.lit("vendor/")), "proxy").when(F.startswith("model", F.lit("direct-")), "direct").otherwise("router")
    return b.select("item_id", "model", F.regexp_replace("model", "^vendor/", "").alias("model_for_request"), provider.alias("provider"), F.regexp_replace(F.format_string("run %d/x", "item_id"), "[^A-Za-z0-9_-]", "_").alias("safe_id"))


@query(f"""WITH {MESSAGES} SELECT session_id, msg_idx, tokens AS input_tokens, CASE WHEN msg_idx % 3 = 0 THEN tokens // 2 END AS cache_read, coalesce(CASE WHEN msg_idx % 3 = 0 THEN tokens // 2 END, 0) AS cache_read_or_zero, ['router', 'direct', 'sdk'][(msg_idx % 3 + 1)::INT] AS shape FROM m""")
def q_usage_normalise(spark, d):
    """Three provider shapes to one: a counter that a provider leaves out stays null until it is summed."""
    cache = F.when(F.col("msg_idx") % 3 == 0, F.expr("tokens div 2"))
    shape = F.element_at(F.array(F.lit("router"), F.lit("direct"), F.lit("sdk")), (F.col("msg_idx") % 3 + 1).cast("int"))
    return messages(spark, d).select("session_id", "msg_idx", F.col("tokens").alias("input_tokens"), cache.alias("cache_read"), F.coalesce(cache, F.lit(0)).alias("cache_read_or_zero"), shape.alias("shape"))


@query(f"""WITH {MESSAGES} SELECT session_id, count(*)::BIGINT AS turns, sum(tokens)::BIGINT AS input_tokens, nullif(sum(CASE WHEN msg_idx % 3 = 0 THEN tokens // 2 ELSE 0 END), 0)::BIGINT AS cache_read, 0::BIGINT AS n_events FROM m WHERE role = 'assistant' GROUP BY 1""")
def q_turn_record(spark, d):
    none = F.array().cast("array<string>")
    turns = messages(spark, d).filter("role = 'assistant'").select("session_id", F.struct("tokens", F.when(F.col("msg_idx") % 3 == 0, F.expr("tokens div 2")).otherwise(0).alias("cache"), none.alias("events")).alias("t"))
    return turns.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("turns"), F.sum("t.tokens").alias("input_tokens"), F.nullif(F.sum("t.cache"), F.lit(0)).alias("cache_read"), F.sum(F.size("t.events")).cast("long").alias("n_events")
    )


WORDS = "len(regexp_extract_all(text, '[^ ]+'))"


def words(text):
    return F.coalesce(F.size(F.regexp_extract_all(text, F.lit("[^ ]+"), F.lit(0))), F.lit(0)).cast("long")


@query(f"SELECT conv_id AS session_id, sum({WORDS})::BIGINT AS tokens, max({WORDS})::BIGINT AS most FROM conversations GROUP BY 1")
def q_counted_by_words(spark, d):
    """Messages under another token counter."""
    return messages(spark, d, words).groupBy("session_id").agg(F.sum("tokens").alias("tokens"), F.max("tokens").alias("most"))


@query(f"""WITH t AS (SELECT conv_id AS task_id, turn, text, conv_id % 4 AS kind, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1 AS is_last, min(CASE WHEN conv_id % 3 = 0 AND turn > 0 THEN turn END) OVER (PARTITION BY conv_id) AS failed_at FROM conversations),
    c AS (SELECT * FROM t WHERE failed_at IS NULL OR turn <= failed_at)
    SELECT task_id, 7 AS seed, CASE WHEN any_value(failed_at) IS NULL THEN arg_max(text, turn) END AS response, CASE WHEN any_value(failed_at) IS NULL AND any_value(kind) < 2 THEN 1 ELSE 0 END::DOUBLE AS score, count(*) AS n_turns, count(*) FILTER (turn = failed_at) AS n_errors,
        sum({WORDS})::BIGINT AS input_tokens, coalesce(sum({WORDS}) FILTER (failed_at IS NULL OR turn < failed_at), 0)::BIGINT AS output_tokens, round((2.0::DOUBLE * sum({WORDS}) + 8.0::DOUBLE * coalesce(sum({WORDS}) FILTER (failed_at IS NULL OR turn < failed_at), 0)) / 1e6, 9) AS cost_usd FROM c GROUP BY 1""")
def q_echo_baseline(spark, d):
    """The stub runner and grader over conversations: it fails in every third one behind its first turn; what is expected of
    the last turn is its text, the same in capitals, another one, or nothing."""

    def tasks(seed):
        c = table(spark, d, "conversations").select(F.col("conv_id").alias("task_id"), F.col("turn").alias("turn_index"), F.col("text").alias("prompt"))
        last = F.col("turn_index") == F.max("turn_index").over(Window.partitionBy("task_id"))
        kind = F.col("task_id") % 4
        wanted = F.when(kind == 0, F.col("prompt")).when(kind == 1, F.concat(F.lit(" "), F.translate("prompt", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))).when(kind == 2, F.concat("prompt", F.lit(" and more")))
        return c.withColumn("expected", F.when(last, wanted))

    fails = lambda turns: turns.withColumn("response", F.when(~((F.col("task_id") % 3 == 0) & (F.col("turn_index") > 0)), F.col("prompt")))
    done = contracts.Bench(tasks, fails, counter=words, rate_in=2.0, rate_out=8.0).run(7)
    return done.withColumn("cost_usd", F.round("cost_usd", 9))
