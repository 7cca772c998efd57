"""Sampling, splits and conversion to chat examples."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatloom.functions import images
from chatloom.operators import convert, evaluation, sampling
from chatloom.plans.materialize import scratch_path
from chatloom.sources import files
from chatloom.sources.files import spread
from workload.tables import documents, flat_messages, table

TEMPLATE = "Summarise the following {lang} text: {text}"

WS = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"


def ws(expr: str) -> str:
    return WS.format(expr)


def _docs(spark, sf):
    return table(spark, sf, "documents")


def sample_exact(spark, sf):
    return sampling.sample_exact(_docs(spark, sf), 150, "doc_id").select("doc_id", "lang", "n_chars")


def shuffle(spark, sf):
    """The rows with the places they really have after the shuffle."""
    return sampling.with_position(sampling.shuffle(_docs(spark, sf).select("doc_id", "lang"), "doc_id"))


def split_manual(spark, sf):
    return sampling.train_test_split(_docs(spark, sf), 0.2, "doc_id").select("doc_id", "split")


def sample_then_split(spark, sf):
    return sampling.sample_then_split(_docs(spark, sf), 120, 0.25, "doc_id").select("doc_id", "split")


def head(spark, sf):
    return sampling.head(_docs(spark, sf).select("doc_id", "text"), 50, "doc_id")


def sample_results(spark, sf):
    return sampling.sample_results(_docs(spark, sf).select("doc_id", "text"), 3, "doc_id")


def sample_with_replacement(spark, sf):
    docs = _docs(spark, sf).select("doc_id", "lang")
    n = docs.count()
    return sampling.sample_with_replacement(docs, n // 2, "doc_id", rows=n)


def fewshot_samples(spark, sf):
    docs = _docs(spark, sf).select("doc_id", "lang")
    return sampling.fewshot_samples(docs, 40, "doc_id").withColumn("example", F.col("example").cast("bigint"))


def chat_lm(spark, sf):
    docs = documents(spark, sf)
    mappings = {
        "user_field": {"type": "template", "value": TEMPLATE},
        "assistant_field": {"type": "column", "value": "text"},
    }
    return flat_messages(convert.to_chat(docs, "language_modeling", mappings, keep=["doc_id"]), "messages", "doc_id")


def chat_lm_system(spark, sf):
    docs = documents(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left")
    mappings = {
        "system_field": {"type": "template", "value": "Source  {source}, quality {quality:>4}|{{raw}}"},
        "user_field": {"type": "column", "value": "text"},
        "assistant_field": {"type": "column", "value": "quality"},
    }
    return flat_messages(convert.to_chat(docs, "language_modeling", mappings, keep=["doc_id"]), "messages", "doc_id")


def chat_list_user(spark, sf):
    events = spread(table(spark, sf, "events"))
    mappings = {
        "user_field": [
            {"type": "template", "value": "User {user_id} did {event_type} at {ts}: {value}"},
            {"type": "template", "value": "{no_such_column}"},
            {"type": "column", "value": "props"},
        ],
        "assistant_field": {"type": "template", "value": "{event_type:.3}{nothing}"},
    }
    return flat_messages(
        convert.to_chat(events, "language_modeling", mappings, keep=["event_id"]), "messages", "event_id"
    )


def chat_prompt_only(spark, sf):
    customer = table(spark, sf, "customer")
    mappings = {
        "system_field": {"type": "column", "value": "c_mktsegment"},
        "user_field": {"type": "template", "value": "Who is {c_name} of nation {c_nationkey:03}?"},
        "answer": {"type": "column", "value": "c_name"},
        "reasoning": {"type": "template", "value": "balance  {c_acctbal}"},
    }
    chat = convert.to_chat(customer, "prompt_only", mappings, keep=["c_custkey"])
    return flat_messages(chat, "prompt", "c_custkey", "answer", "reasoning")


def chat_preference(spark, sf):
    """One example per benchmark item: the first good and the first bad labelled document of its group."""
    n_items = table(spark, sf, "benchmark").count()
    side = (
        table(spark, sf, "labels")
        .join(_docs(spark, sf).select("doc_id", "text"), "doc_id")
        .groupBy(F.pmod("doc_id", F.lit(n_items)).alias("item_id"))
        .agg(
            F.min_by("text", F.when(F.col("quality") == 1, F.col("doc_id"))).alias("good"),
            F.min_by("text", F.when(F.col("quality") == 0, F.col("doc_id"))).alias("bad"),
        )
    )
    rows = table(spark, sf, "benchmark").join(side, "item_id", "left")
    mappings = {
        "system_field": {"type": "template", "value": "ignored in this mode"},
        "user_field": {"type": "column", "value": "text"},
        "chosen_field": {"type": "column", "value": "good"},
        "rejected_field": {"type": "column", "value": "bad"},
    }
    chat = convert.to_chat(rows, "preference", mappings, keep=["item_id"])
    return chat.select(
        "item_id",
        F.col("prompt")[0]["content"][0]["text"].alias("prompt"),
        F.size("prompt").cast("bigint").alias("n_prompt"),
        F.size("chosen").cast("bigint").alias("n_chosen"),
        F.size("rejected").cast("bigint").alias("n_rejected"),
        F.get(F.col("chosen"), F.lit(0))["content"][0]["text"].alias("chosen"),
        F.get(F.col("rejected"), F.lit(0))["content"][0]["text"].alias("rejected"),
    )


def chat_preformatted_json(spark, sf):
    """Turns as JSON text: two thirds are messages, the rest has its keys the other way round and stays text."""
    turns = table(spark, sf, "conversations")
    as_message = F.to_json(F.struct("role", F.col("text").alias("content")))
    reversed_keys = F.to_json(F.struct(F.col("text").alias("content"), "role"))
    rows = turns.select(
        "conv_id", "turn", F.when(F.pmod("turn", F.lit(3)) < 2, as_message).otherwise(reversed_keys).alias("msg")
    )
    chat = convert.to_chat(rows, "prompt_only", {"user_field": {"type": "column", "value": "msg"}}, keep=["conv_id", "turn"])
    return flat_messages(chat, "prompt", "conv_id", "turn")


def chat_struct_message(spark, sf):
    """Turns as structs: their contents a list of two parts, or of plain texts."""
    turns = table(spark, sf, "conversations")
    part = lambda text: F.struct(F.lit("text").alias("type"), text.alias("text"))
    listed = F.struct("role", F.array(part(F.col("text")), part(F.lit("more"))).alias("content"))
    plain = F.struct("role", F.array(F.col("text"), F.col("role")).alias("content"))
    rows = turns.select("conv_id", "turn", listed.alias("listed"), plain.alias("plain"))
    parts = []
    for column in ("listed", "plain"):
        chat = convert.to_chat(rows, "prompt_only", {"user_field": {"type": "column", "value": column}}, keep=["conv_id", "turn"])
        parts.append(flat_messages(chat, "prompt", "conv_id", "turn").withColumn("shape", F.lit(column)))
    return parts[0].unionByName(parts[1])


def chat_json_parts(spark, sf):
    """Turns as JSON messages whose contents are lists of an object, a text and a number."""
    turns = table(spark, sf, "conversations")
    body = F.concat(
        F.lit('{"role":"'), F.col("role"), F.lit('","content":[{"type":"text","text":'), F.to_json(F.struct("text")).substr(F.lit(9), F.length(F.to_json(F.struct("text"))) - 9),
        F.lit('},"plain",'), F.col("turn").cast("string"), F.lit("]}"),
    )
    rows = turns.select("conv_id", "turn", body.alias("msg"))
    chat = convert.to_chat(rows, "prompt_only", {"user_field": {"type": "column", "value": "msg"}}, keep=["conv_id", "turn"])
    return flat_messages(chat, "prompt", "conv_id", "turn")


def _pictures(spark, sf):
    """Events with a payload that has a picture's signature, but every fifth, which has none."""
    signature = F.when(F.col("event_id") % 5 != 0, F.unhex(F.lit("89504E470D0A1A0A"))).otherwise(F.encode(F.lit("none"), "utf-8"))
    payload = F.concat(signature, F.encode("props", "utf-8"))
    rows = spread(table(spark, sf, "events")).select("event_id", "event_type", payload.alias("img"))
    mappings = {
        "user_field": [{"type": "image", "value": "img"}, {"type": "template", "value": "What is {event_id}?"}],
        "assistant_field": {"type": "column", "value": "event_type"},
    }
    return convert.to_chat(rows, "language_modeling", mappings, keep=["event_id"])


def chat_vision(spark, sf):
    parts = _pictures(spark, sf).select("event_id", F.col("messages")[0]["content"].alias("content"))
    flat = parts.select("event_id", F.posexplode("content").alias("pos", "p"))
    return flat.select("event_id", F.col("pos").cast("bigint").alias("pos"), "p.type", "p.text", F.sha2("p.image.bytes", 256).alias("picture"))


def render_images(spark, sf):
    shown = _pictures(spark, sf).select("event_id", convert.render_images(F.col("messages")).alias("m"))
    urls = F.filter(F.flatten(F.transform("m", lambda m: F.transform(m["content"], lambda p: p["image"]))), lambda u: u.isNotNull())
    return shown.select("event_id", F.array_join(urls, " ").alias("urls"))


def extract_images(spark, sf):
    done = evaluation.extract_images(_pictures(spark, sf), required=False)
    return done.select("event_id", F.array_join(F.transform("images", lambda b: F.sha2(b, 256)), " ").alias("pictures"))


def read_images(spark, sf):
    """Files of any kind below a folder as payloads: together they hold every line that was written."""
    path = scratch_path(spark, "files")
    table(spark, sf, "events").select("props").write.text(path)
    found = files.read_images(spark, path + "/*.txt")
    return found.agg(F.sum(F.length("bytes")).alias("n_bytes"), F.min(F.col("path").startswith("/")).alias("rooted"))


def drop_failed(spark, sf):
    """Documents whose conversion has a reply: those with a label."""
    docs = _docs(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left")
    rows = docs.select(
        "doc_id",
        F.when(F.col("quality").isNotNull(), F.array("text")).otherwise(F.array().cast("array<string>")).alias("messages"),
    )
    return convert.drop_failed(rows, "messages").select("doc_id")


def normalize_ws(spark, sf):
    from chatloom.functions.text import normalize_ws as tidy

    return documents(spark, sf, "doc_id", "text").select("doc_id", tidy(F.col("text")).alias("text"))


def base64_image_check(spark, sf):
    docs = documents(spark, sf, "doc_id", "text").select("doc_id", "text", F.base64(F.encode("text", "utf-8")).alias("b64"))
    return docs.select(
        "doc_id",
        images.is_base64_image(F.col("b64")).alias("encoded"),
        images.is_base64_image(F.concat(F.lit("data:image/png;base64,"), "b64")).alias("data_url"),
        images.is_base64_image(F.col("text")).alias("plain"),
    )


QUERIES = {
    "shuffle": shuffle,
    "sample_exact": sample_exact,
    "split_manual": split_manual,
    "sample_then_split": sample_then_split,
    "head": head,
    "sample_results": sample_results,
    "sample_with_replacement": sample_with_replacement,
    "fewshot_samples": fewshot_samples,
    "chat_lm": chat_lm,
    "chat_lm_system": chat_lm_system,
    "chat_list_user": chat_list_user,
    "chat_prompt_only": chat_prompt_only,
    "chat_preference": chat_preference,
    "chat_preformatted_json": chat_preformatted_json,
    "chat_struct_message": chat_struct_message,
    "chat_json_parts": chat_json_parts,
    "chat_vision": chat_vision,
    "render_images": render_images,
    "extract_images": extract_images,
    "read_images": read_images,
    "drop_failed": drop_failed,
    "normalize_ws": normalize_ws,
    "base64_image_check": base64_image_check,
}

U60 = "('0x' || substr(md5({}), 1, 15))::BIGINT"

_RANKED = "ranked AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 AS row_index FROM documents)"

ORACLES = {
    "shuffle": "SELECT doc_id, lang, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 AS position FROM documents",
    "sample_exact": "SELECT doc_id, lang, n_chars FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 150",
    "split_manual": f"""WITH {_RANKED}
        SELECT doc_id, CASE WHEN row_index < CAST(floor((SELECT count(*) FROM documents) * (1 - 0.2::DOUBLE)) AS BIGINT)
               THEN 'train' ELSE 'test' END AS split FROM ranked""",
    "sample_then_split": f"""WITH {_RANKED}
        SELECT doc_id, CASE WHEN row_index < 90 THEN 'train' ELSE 'test' END AS split FROM ranked WHERE row_index < 120""",
    "head": "SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 50",
    "sample_results": "SELECT doc_id, text FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 3",
    "sample_with_replacement": f"""WITH {_RANKED}, n AS (SELECT count(*) AS n FROM documents),
        draws AS (SELECT d AS draw, {U60.format("'42:draw:' || d")} % n AS row_index
                  FROM n, range((SELECT count(*) // 2 FROM documents)) t(d))
        SELECT draw, doc_id, lang FROM draws JOIN ranked USING (row_index)""",
    "fewshot_samples": f"""WITH {_RANKED}, n AS (SELECT count(*) AS n FROM documents),
        picks AS (SELECT b AS batch, e AS example, ({U60.format("'42:batch:' || b")} + e - 1) % n AS row_index
                  FROM n, range(40) t(b), range(1, 4) s(e))
        SELECT batch, example, doc_id, lang FROM picks JOIN ranked USING (row_index)""",
    "chat_lm": f"""WITH t AS (SELECT doc_id, {ws("'Summarise the following ' || lang || ' text: ' || text")} AS u,
                              {ws("text")} AS a FROM documents)
        SELECT doc_id, 0::BIGINT AS pos, 'user' AS role, 0::BIGINT AS part_pos, 'text' AS part_type, u AS text
        FROM t WHERE a <> ''
        UNION ALL SELECT doc_id, 1, 'assistant', 0, 'text', a FROM t WHERE a <> ''""",
    "chat_lm_system": f"""WITH t AS (SELECT d.doc_id, 'Source  ' || source || ', quality ' ||
                lpad(coalesce(quality::VARCHAR, ''), 4, ' ') || '|{{raw}}' AS s,
                {ws("text")} AS u, quality::VARCHAR AS a
              FROM documents d JOIN labels l USING (doc_id))
        SELECT doc_id, 0::BIGINT AS pos, 'system' AS role, 0::BIGINT AS part_pos, 'text' AS part_type, s AS text
        FROM t WHERE u <> ''
        UNION ALL SELECT doc_id, 1, 'user', 0, 'text', u FROM t WHERE u <> ''
        UNION ALL SELECT doc_id, 2, 'assistant', 0, 'text', a FROM t WHERE u <> ''""",
    "chat_list_user": """SELECT event_id, 0::BIGINT AS pos, 'user' AS role, 0::BIGINT AS part_pos, 'text' AS part_type,
          'User ' || user_id || ' did ' || event_type || ' at ' ||
          CASE WHEN date_part('microsecond', ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
               ELSE strftime(ts, '%Y-%m-%d %H:%M:%S.%f') END || ': ' || value AS text FROM events
        UNION ALL SELECT event_id, 0, 'user', 1, 'text', props FROM events
        UNION ALL SELECT event_id, 1, 'assistant', 0, 'text', '{event_type:.3}{nothing}' FROM events""",
    "chat_prompt_only": """WITH t AS (SELECT c_custkey, c_name AS answer, 'balance ' || c_acctbal AS reasoning, c_mktsegment AS s,
          'Who is ' || c_name || ' of nation ' || rpad(c_nationkey::VARCHAR, greatest(3, length(c_nationkey::VARCHAR))::INTEGER, '0') || '?' AS u
          FROM customer)
        SELECT c_custkey, answer, reasoning, 0::BIGINT AS pos, 'system' AS role, 0::BIGINT AS part_pos, 'text' AS part_type, s AS text FROM t
        UNION ALL SELECT c_custkey, answer, reasoning, 1, 'user', 0, 'text', u FROM t""",
    "chat_preference": f"""WITH side AS (
          SELECT doc_id % (SELECT count(*) FROM benchmark) AS item_id,
                 arg_min(text, doc_id) FILTER (quality = 1) AS good, arg_min(text, doc_id) FILTER (quality = 0) AS bad
          FROM labels JOIN documents USING (doc_id) GROUP BY 1),
        t AS (SELECT item_id, {ws("b.text")} AS prompt, nullif({ws("good")}, '') AS chosen, nullif({ws("bad")}, '') AS rejected
              FROM benchmark b LEFT JOIN side USING (item_id))
        SELECT item_id, prompt, 1::BIGINT AS n_prompt, (chosen IS NOT NULL)::BIGINT AS n_chosen,
               (rejected IS NOT NULL)::BIGINT AS n_rejected, chosen, rejected FROM t WHERE prompt <> ''""",
    "chat_preformatted_json": """SELECT conv_id, turn, 0::BIGINT AS pos,
          CASE WHEN turn % 3 < 2 THEN role ELSE 'user' END AS role, 0::BIGINT AS part_pos, 'text' AS part_type,
          CASE WHEN turn % 3 < 2 THEN text
               ELSE '{"content":' || to_json(text)::VARCHAR || ',"role":"' || role || '"}' END AS text
        FROM conversations""",
    "chat_struct_message": """SELECT conv_id, turn, 0::BIGINT AS pos, role, k AS part_pos, 'text' AS part_type, shape,
          CASE WHEN k = 0 THEN text WHEN shape = 'listed' THEN 'more' ELSE role END AS text
        FROM conversations, range(2) p(k), (VALUES ('listed'), ('plain')) s(shape)""",
    "chat_json_parts": """SELECT conv_id, turn, 0::BIGINT AS pos, role, k AS part_pos, 'text' AS part_type,
          CASE k WHEN 0 THEN text WHEN 1 THEN 'plain' ELSE turn::VARCHAR END AS text
        FROM conversations, range(3) p(k)""",
    "chat_vision": """SELECT event_id, 0::BIGINT AS pos, 'image' AS type, NULL::VARCHAR AS text,
          sha256(unhex('89504E470D0A1A0A') || encode(props)) AS picture FROM events WHERE event_id % 5 <> 0
        UNION ALL SELECT event_id, (event_id % 5 <> 0)::BIGINT, 'text', 'What is ' || event_id || '?', NULL FROM events""",
    "render_images": """SELECT event_id, CASE WHEN event_id % 5 <> 0
          THEN 'data:image/png;base64,' || to_base64(unhex('89504E470D0A1A0A') || encode(props)) ELSE '' END AS urls FROM events""",
    "extract_images": """SELECT event_id, CASE WHEN event_id % 5 <> 0
          THEN sha256(unhex('89504E470D0A1A0A') || encode(props)) ELSE '' END AS pictures FROM events""",
    "read_images": "SELECT sum(strlen(props) + 1)::BIGINT AS n_bytes, true AS rooted FROM events",
    "drop_failed": "SELECT d.doc_id FROM documents d JOIN labels l USING (doc_id)",
    "normalize_ws": f"SELECT doc_id, {ws('text')} AS text FROM documents",
    "base64_image_check": r"""WITH t AS (SELECT doc_id, text, base64(encode(text)) AS b FROM documents)
        SELECT doc_id, length(b) > 100 AND octet_length(encode(text)) > 100 AS encoded, true AS data_url,
               length(text) > 100 AND length(text) = octet_length(encode(text)) AND coalesce(octet_length(TRY(from_base64(
                 regexp_replace(regexp_replace(text, '[^A-Za-z0-9+/=]', '', 'g'), '=+([^=])', '\1', 'g')))) > 100, false) AS plain FROM t""",
}
