"""WARC, chat, vector search, HTML and the pipeline on small tables."""

import gzip
import hashlib
import io
import json

import numpy as np
import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from logspark.llm import chat, html_text, pivots, queries, shared, warc
from tests.check_oracles import compare, connect

PAGES = "page_id long, url string, html string"


def test_archives_hold_every_page_and_are_read_by_offset(spark, tmp_path):
    big = "<p>é</p>" * 300
    pages = spark.createDataFrame(
        [(1, "http://a/ b", big), (2, None, big), (3, "http://c", None), (4, "http://d", ""), (5, "http://e", "<p>x"),
         (6, "http://f", "<p>x"), (None, "http://g", big), (7, "http://h", "y" * 5000), (7, "http://h", "y" * 5000)], PAGES)
    index = warc.archive_pages(pages.withColumn("record", F.lit("clash")), str(tmp_path / "warc"), archive_bytes=4000)
    read = warc.read_records(index).collect()
    assert len(read) == 9
    by = {}
    for r in read:
        by.setdefault(warc.page_of(r.record_id), []).append(r)
    assert by[1][0].record_type == by[None][0].record_type == "revisit" and by[1][0].refers_to == "<urn:page:2>"
    assert [r.record_type for p in (2, 3, 4, 5, 6, 7) for r in by[p]] == ["response"] * 7
    data = big.encode()
    for p in (1, 2, None):
        assert (by[p][0].payload_bytes, by[p][0].payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
    assert bytes(by[2][0].payload) == data and by[3][0].payload_bytes == 0
    assert warc.read_records(warc.archive_pages(pages.limit(0), str(tmp_path / "none"))).count() == 0
    # The sidecar beside an archive says the same as the index, and its members are gzip files of one record each.
    for archive, rows in ((a, [r for r in index.collect() if r.archive == a]) for a in {r.archive for r in index.collect()}):
        fs, path = pafs.FileSystem.from_uri(archive)
        lines = fs.open_input_stream(path + ".idx", compression=None).read().decode().splitlines()
        assert [json.loads(x)["offset"] for x in lines] == sorted(r.offset for r in rows)
        whole = fs.open_input_stream(path, compression=None).read()
        assert gzip.decompress(whole).count(b"WARC/1.1\r\n") == len(rows)
        for r in rows:
            assert gzip.decompress(whole[r.offset:r.offset + r.length]).startswith(b"WARC/1.1\r\n")


def test_a_cut_off_record_is_an_error():
    record = warc._record({"WARC-Type": "response", "WARC-Record-ID": "<x>"}, b"12345")
    assert [b for _, b in warc._records(io.BytesIO(record * 2))] == [b"12345"] * 2
    with pytest.raises(ValueError, match="cut off"):
        list(warc._records(io.BytesIO(record[:-6])))


LAYOUTS = [
    ({"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "q"}]}, "messages", [("system", "s"), ("user", "q")]),
    ({"messages": []}, None, None),
    ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": None}]}, "conversations", [("user", "q"), ("assistant", "")]),
    ({"prompt": "p", "completion": "c", "id": 4}, "prompt_completion", [("user", "p"), ("assistant", "c")]),
    ({"system": "s", "prompt": "p", "response": "c"}, "prompt_response", [("system", "s"), ("user", "p"), ("assistant", "c")]),
    ({"instruction": "i", "input": "x", "output": "o"}, "instruction", [("user", "i\n\nx"), ("assistant", "o")]),
    ({"context": "c", "question": "q", "answer": "a"}, "question", [("user", "c\n\nq"), ("assistant", "a")]),
    ({"prompt": "p"}, None, None), ({}, None, None), (None, None, None),
]


def test_a_fingerprint_selects_the_mapping(spark):
    rows = [(i, None if r is None else json.dumps(r)) for i, (r, _, _) in enumerate(LAYOUTS)]
    parsed = spark.createDataFrame(rows, "i int, r string").select("i", chat.parse(F.col("r")).alias("p"))
    got = parsed.withColumn("l", chat.select_layout(chat.fingerprint(F.col("p")))).select(
        "i", "l", chat.turns(F.col("p"), F.col("l")).alias("t"))
    for r in got.collect():
        assert (r.l, r.t and [tuple(t) for t in r.t]) == LAYOUTS[r.i][1:]


def test_no_two_mappings_share_a_fingerprint():
    every = [p for m in chat.MAPPINGS for p in m.paths()]
    assert len(every) == len(set(every))


TURNS = ["", "\\", "\\l<|end|>\n", "</s>[INST] ok [/INST]", "<<SYS>>x<</SYS>>", "<|turn|>user\nhi", "\\e\\\\o[[INST]", "é😀\n\n", "<<|"]


def test_escaping_is_reversed_and_leaves_no_control_string(spark):
    table = spark.createDataFrame([(t,) for t in TURNS], "t string")
    for r in table.select("t", chat.escape(F.col("t")).alias("e"), chat.escape_role(F.col("t")).alias("r")).select(
            "*", chat.unescape(F.col("e")).alias("u"), chat.unescape_role(F.col("r")).alias("v")).collect():
        assert r.u == r.t == r.v and "\n" not in r.r
        assert not any(c in r.e for c in ("<|", "[INST]", "[/INST]", "</s>", "<s>", "<<SYS>>", "<</SYS>>"))


def test_conversations_come_back_from_the_template(spark, tmp_path):
    rows = [(1, i, r, t) for i, (r, t) in enumerate(zip(["user", "assistant", "odd\nrole", None] * 3, TURNS + TURNS[:3], strict=True))]
    rows += [(2, 0, "user", None), (2, 1, "assistant", None), (None, 0, "assistant", "x" * 50_000), (2, 1, "assistant", None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn(
        "record", F.lit("clash")).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in queries.op4_chat(spark, str(tmp_path)).collect()}
    for conv in (1, 2, None):
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1], r[2] or "", r[3] or ""))
        said = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in own)
        loss = "".join(t or "" for _, _, r, t in own if r == "assistant")
        assert got[conv].n_turns == len(own) and got[conv].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[-7].n_turns == 2 and got[-7].loss_chars == 21


def slow_top(rows, k):
    out = {}
    fine = [(i, np.floor(256 * np.array(v, float))) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()]
    for i, v in fine:
        if i % 50 == 0:
            scores = sorted(((-int(v @ w), j) for j, w in fine if j != i))[:k]
            out[i] = [(r + 1, j, -s) for r, (s, j) in enumerate(scores)]
    return out


def test_search_is_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).astype(float).tolist()) for i in range(1200)]
    rows += [(2000 + i, rows[7][1]) for i in range(700)]  # a hot vector, larger than a block
    rows += [(3000, None), (3050, [1.0, None] * 4), (3100, [float("nan")] * 8), (None, [1.0] * 8), (3150, [0.0] * 8)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit("clash"))
    got = {}
    for r in pivots.top_k(table, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert got == slow_top(rows, 5)
    few = table.where("vec_id <= 2")
    assert pivots.top_k(few, F.col("vec_id") == 0).count() == 2
    assert pivots.top_k(table.limit(0), F.col("vec_id") == 0).count() == 0


def test_clusters_are_searched_without_the_other_clusters(spark, caplog):
    """Of 40 narrow clusters each query visits few blocks; of vectors in all directions, nearly all."""
    rng = np.random.default_rng(7)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True) * 3
    centres = unit(rng.normal(size=(40, 16)))
    tables = {"clustered": unit((centres[:, None] + rng.normal(size=(40, 150, 16)) * 0.05).reshape(-1, 16)),
              "scattered": unit(rng.normal(size=(6000, 16)))}
    shares = {}
    for name, x in tables.items():
        rows = [(i, v) for i, v in enumerate(rng.permutation(x).tolist())]
        caplog.clear()
        with caplog.at_level("INFO", "logspark.llm.pivots"):
            found = pivots.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0)
        got = {}
        for r in found.orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
        assert got == slow_top(rows, 5)
        visited, pairs = caplog.records[-1].args
        shares[name] = visited / pairs
    assert shares["clustered"] < 0.2 and shares["scattered"] > 0.9


def test_scores_that_would_not_be_exact_are_refused(spark):
    table = spark.createDataFrame([(0, [1e6, 1.0]), (1, [1e6, 1.0]), (2, [])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="2\\*\\*53"):
        pivots.top_k(table, F.col("vec_id") == 0)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<header><a href="/">Site</a></header><nav><ul><li><a href="/a">One</a></li></ul></nav><!-- <p>no</p> -->
<div class="cookie-notice">We use cookies, please agree.</div><div class="ad">Buy this, now.</div>
<article><h1>Head &amp; line</h1><p>First  <b>bold</b>
 text, with marks.<br>And &eacute;&#233; more.<p>Second, unclosed.</p><ul><li>item, one</li></ul>
<form><input><label>Name</label></form><div class="share"><a href="#">Share</a></div></article>
<aside>Related, things.</aside><div id="comments"><p>A reader says, long words here and there.</p></div>
<footer>&copy; Site, all rights.</footer></body>"""


def test_the_article_is_kept_and_the_rest_left_out():
    assert html_text.main_text(PAGE) == "Head & line\nFirst bold text, with marks. And éé more.\nSecond, unclosed.\nitem, one"
    plain = "<html><body><div><div>Menu</div><div><p>Some long, full sentences, here.</p><p>And more of them, too.</p></div></div>"
    assert html_text.main_text(plain).endswith("Some long, full sentences, here.\nAnd more of them, too.")


def test_odd_pages_have_defined_texts(spark):
    deep = "<div>" * 3000 + "deep, text." + "</div>" * 3000
    rows = [(1, "u", None), (2, None, ""), (3, "u", "just text, no markup"), (4, "u", "<p>a"), (4, "u", "<p>a"), (5, "u", "<"),
            (6, "u", "<!-- open <p>x"), (7, "u", deep), (None, "u", "<script>x"), (8, "u", "<p>" + "wörd, " * 100_000)]
    table = spark.createDataFrame(rows, PAGES).withColumn("text", F.lit("clash"))
    got = html_text.extract(table).collect()
    by = {r.page_id: r.text for r in got}
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert (by[1], by[2], by[3], by[4], by[6], by[7], by[None]) == ("", "", "just text, no markup", "a", "", "deep, text.", "")
    assert len(by[8]) == 6 * 100_000 - 1
    assert html_text.extract(table.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_agree_with_their_sql(spark, name):
    assert compare(spark, connect("/root/testdata/sf0.01"), name, "/root/testdata/sf0.01") is None


def test_scratch_tables_go_and_results_stay(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shared, "shared_folder", lambda spark: str(tmp_path))

    def make():
        inner = shared.landed_apart(spark, lambda: shared.land(spark.range(3), "a").union(shared.land(spark.range(4), "b")), "inner")
        return shared.land(inner, "c")

    out = shared.landed_apart(spark, make, "outer")
    assert out.count() == 7 and [p.name.split("-")[0] for p in tmp_path.iterdir()] == ["outer"]
    with pytest.raises(ValueError), shared.scratch(spark):
        shared.land(spark.range(2), "d")
        raise ValueError
    assert len(list(tmp_path.iterdir())) == 1 and not shared._SCRATCH


def test_the_pipeline_keeps_clean_documents_and_drops_what_it_should(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == [*docs.columns, "copy", "shuffle_key"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, sf_dir)
        assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert ids and not [i for i in ids if labels.get(i) == 0]
    assert {r.doc_id for r in out.select("doc_id").collect()} <= ids
    assert queries.contaminated(kept, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).count() == 0
