"""The operators applied to the test tables, and the results expected where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.llm import chat, divergence, fingerprints, html_text, langid, mixing, pii, pivots, quality, simhash, warc, whitening
from logspark.llm.decontaminate import contaminated


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, read back from the normalised archives."""
    read = warc.read_records(warc.archive_pages(_table(spark, sf_dir, "pages")), with_payload=False)
    page = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]+)>$", 1)
    number = lambda c: F.when(page(c) != "", page(c).cast("long"))
    return read.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                       number("refers_to").alias("refers_to"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document: its own evidence, its site's posteriors, and the decision."""
    docs = _table(spark, sf_dir, "documents")
    return quality.score_quality(docs, _table(spark, sf_dir, "labels"), columns=["doc_id"])


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: base findings, and all spans."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = pii.find_spans(docs, pii.fit_trees(docs))
    base = {k: F.col(f"sure_{k}") for k in pii.KINDS}
    return spans.select(
        "doc_id", *[F.size(c).cast("long").alias(f"n_{k}") for k, c in base.items()],
        F.sha2(pii.span_text(base), 256).alias("base_sha256"),
        pii.span_text({k: F.col(f"all_{k}") for k in pii.KINDS}).alias("spans"))


def conversation_records(turns: DataFrame) -> DataFrame:
    """(conv_id, record): conversations as JSON in the layouts that chat data comes in.

    One question and its answer are a prompt and its completion, with a system message
    an instruction and its output; longer ones are lists of messages of either kind.
    """
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
                        F.coalesce("text", F.lit("")).alias("text")).groupBy("conv_id").agg(ordered.alias("t"))
    roles = F.transform("t", lambda t: t["role"])
    is_ = lambda *names: roles == F.array(*map(F.lit, names))
    text = lambda i: F.col("t")[i]["text"]
    plain = F.forall(roles, lambda r: r.isin("user", "assistant", "system"))
    spoken = lambda r: F.when(r == "user", "human").when(r == "assistant", "gpt").otherwise(r)
    messages = F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content")))
    said = F.transform("t", lambda t: F.struct(spoken(t["role"]).alias("from"), t["text"].alias("value")))
    record = (
        F.when(is_("user", "assistant"), F.to_json(F.struct(text(0).alias("prompt"), text(1).alias("completion"))))
        .when(is_("system", "user", "assistant"), F.to_json(F.struct(
            text(0).alias("system"), text(1).alias("instruction"), text(2).alias("output"))))
        .when(plain & (F.pmod(F.xxhash64("conv_id"), F.lit(2)) == 0), F.to_json(F.struct(said.alias("conversations"))))
        .otherwise(F.to_json(F.struct(messages.alias("messages")))))
    return rows.select("conv_id", record.alias("record"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations in the template, and what is read back from it."""
    says = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(says).alias("text"))
    columns = ["conv_id", "turn", "role", "text"]
    records = conversation_records(_table(spark, sf_dir, "conversations").select(*columns).unionByName(extra))
    parsed = records.select("conv_id", chat.parse(F.col("record")).alias("parsed"))
    marked = parsed.withColumn("layout", chat.select_layout(chat.fingerprint(F.col("parsed"))))
    turns = marked.select("conv_id", "layout", chat.turns(F.col("parsed"), F.col("layout")).alias("turns"))
    done = turns.select("conv_id", "layout", chat.format_turns(F.col("turns")).alias("formatted"),
                        chat.loss_mask(F.col("turns")).alias("mask"))
    read = done.select("conv_id", "layout", F.length("formatted").cast("long").alias("formatted_chars"),
                       chat.read_turns(F.col("formatted")).alias("turns"),
                       F.array_join(chat.read_loss(F.col("formatted"), F.col("mask")), "").alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                       "formatted_chars")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents mixed by tempered source weights, with their copies and places."""
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, by a model of those not held out."""
    docs = _table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~held_out(F.col("doc_id"))))
    return langid.predict(docs, model, "doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, and the shingles they share."""
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best vectors for every query vector."""
    return pivots.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article of every page."""
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding in the first 32 whitened components."""
    out = whitening.whiten(_table(spark, sf_dir, "embeddings"))
    return out.withColumn("deviation", F.col("deviation").cast("long"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the sources of every language differ, and in which terms."""
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprints.fingerprints(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents through all stages of the corpus pipeline."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_warc, op2_quality, op3_pii, op4_chat, op5_mixing, op6_simhash, op7_language,
                            op8_decontamination, op9_search, op10_html, op11_whitening,
                            op12_divergence, op13_fingerprints, pipeline)}

_ESCAPED = """regexp_replace(regexp_replace(replace({0}, '\\', '\\e'), '<(\\||/?s>|</?SYS>>)', '\\\\l\\1', 'g'),
    '\\[(/?INST\\])', '\\\\o\\1', 'g')"""

ORACLES: dict[str, str] = {
    "op1_warc": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
                          sha1(coalesce(html, '')) AS payload_digest FROM pages),
        k AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS kept FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id <> kept THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id <> kept THEN kept END AS refers_to FROM k""",
    "op4_chat": f"""
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]'
                   FROM range(2) r(i))
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(17 + length({_ESCAPED.format('role')}) + length({_ESCAPED.format('text')}))::BIGINT AS formatted_chars
        FROM t GROUP BY conv_id""",
    "op5_mixing": """
        WITH s AS (SELECT source, count(*)::DOUBLE AS n FROM documents GROUP BY source),
        r AS (SELECT source, sqrt(n) * (SELECT sum(n) FROM s) / (SELECT sum(sqrt(n)) FROM s) / n AS rate FROM s),
        p AS (SELECT source, k, exp(-rate + k * ln(rate) - CASE k WHEN 0 THEN 0 ELSE lgamma(k + 1.0) END) AS p
              FROM r, range(400) g(k)),
        c AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS cdf FROM p),
        u AS (SELECT *, ('0x' || substr(md5('42:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT / 281474976710656.0 AS u
              FROM documents),
        n AS (SELECT u.*, (SELECT count(*) FROM c WHERE c.source IS NOT DISTINCT FROM u.source AND c.cdf <= u.u) AS n FROM u)
        SELECT doc_id, text, lang, source, n_chars, copy::INT AS copy,
               ('0x' || substr(md5('43:' || coalesce(doc_id::VARCHAR, '') || ':' || copy), 1, 12))::BIGINT
               / 281474976710656.0 AS shuffle_key
        FROM n, LATERAL (SELECT unnest(range(1, n.n + 1)) AS copy)""",
    "op8_decontamination": r"""
        WITH t AS (SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark),
        w AS (SELECT side, id, list_filter(regexp_split_to_array(
                  translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
                  lambda x: x <> '') AS w FROM t),
        g AS (SELECT DISTINCT side, id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1),
                  lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM w WHERE len(w) > 0),
        n AS (SELECT id, count(*) AS n FROM g WHERE side = 'i' GROUP BY id)
        SELECT d.id AS doc_id, i.id AS item_id, count(*) AS shared, any_value(n.n) AS item_shingles
        FROM g d JOIN g i ON d.g = i.g AND d.side = 'd' AND i.side = 'i' JOIN n ON n.id = i.id
        GROUP BY d.id, i.id HAVING count(*) >= 0.8 * any_value(n.n)""",
    "op9_search": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
              FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
        SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
        FROM s QUALIFY rank <= 5""",
    "op12_divergence": r"""
        WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                          regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                              'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
        w AS (SELECT doc, lang, source, unnest(words) AS term FROM d),
        kept AS (SELECT lang, term, count(*) AS lang_n FROM w GROUP BY ALL HAVING count(DISTINCT doc) >= 10),
        v AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY lang),
        g AS (SELECT DISTINCT lang, source FROM d),
        c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
        t AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
        p AS (SELECT lang, g.source, term, coalesce(n, 0) AS n, lang_n, lang_total,
                     (1 + (1000000000::HUGEINT * (coalesce(n, 0) + 2)) // (coalesce(total, 0) + 2 * v))::BIGINT AS p,
                     (1 + (1000000000::HUGEINT * (lang_n + 2)) // (lang_total + 2 * v))::BIGINT AS q
              FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN t USING (lang, source)
              LEFT JOIN c USING (lang, source, term)),
        pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
                  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL)
        SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(value, 0)::BIGINT AS value,
               (row_number() OVER (PARTITION BY g.lang, g.source ORDER BY coalesce(value, 0) DESC, h.source))::INT AS rank
        FROM g JOIN g h ON g.lang = h.lang AND g.source <> h.source
        LEFT JOIN pairs ON pairs.lang = g.lang AND pairs.source = g.source AND pairs.item = h.source
        UNION ALL
        SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT AS value,
               (row_number() OVER (PARTITION BY lang, source ORDER BY (p - q) * (p - q) // (p + q) DESC, term))::INT AS rank
        FROM p WHERE n > 0 AND p > q QUALIFY rank <= 10""",
}
