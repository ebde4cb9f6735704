"""Mixing, chat formatting, WARC archives and near-duplicate vectors."""

import base64
import hashlib
import io
import math

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import chat, common, mixing, vectors, warc
from tessera.llm.common import join_heavy, scratch_path, written

from .helpers import AWKWARD, documents, prose


def mix_rows(spark):
    rows = [(i, prose(i, 1 + i * 37 % 90)) for i in range(300)]
    return documents(spark, rows).withColumn("source", F.when(F.col("doc_id") < 40, "a").when(F.col("doc_id") < 290, "b"))


def test_mix_reaches_targets(spark):
    docs = mix_rows(spark)
    source = {r.doc_id: r.source for r in docs.collect()}
    got = mixing.drawn_rows(docs).collect()
    size, target, taken = {}, {}, {}
    for r in got:
        k = source[r.doc_id]
        size[k], target[k] = r.source_size, r.target
        taken[k] = taken.get(k, 0) + r.taken
        assert r.taken % r.size == 0 and r.taken <= 3 * r.size
    free = {k: w for k, w in (("a", 5), ("b", 2), (None, 1))}
    want, left = {}, sum(size.values())
    while True:  # cap what is over, share the rest
        level = left / sum(free.values())
        over = [k for k, w in free.items() if level * w > 3 * size[k]]
        if not over:
            break
        for k in over:
            want[k] = 3 * size[k]
            left -= want[k]
            del free[k]
    want |= {k: level * w for k, w in free.items()}
    assert target == pytest.approx(want)
    assert all(abs(taken[k] - target[k]) <= 0.02 * target[k] for k in want)
    again = mixing.drawn_rows(docs.repartition(7)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))
    out = mixing.mixed(docs)
    copies = {}
    for r in out.collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert copies == {r.doc_id: r.taken // r.size for r in got if r.taken} and out.columns == docs.columns


def test_mix_of_awkward_rows(spark):
    docs = documents(spark, AWKWARD)
    got = mixing.drawn_rows(docs).collect()
    assert len(got) == len(AWKWARD) and all((r.taken == 0) == (r.first_position is None) for r in got) and {(r.size, r.taken) for r in got if r.doc_id in (1, 2, 3)} == {(0, 0)}
    assert len({(r.taken, r.first_position) for r in got if r.doc_id == 5}) == 1  # repeated rows are drawn alike
    assert mixing.drawn_rows(docs.limit(0)).collect() == [] and mixing.mixed(docs.limit(0)).collect() == []
    nothing = docs.where("doc_id <= 3")
    assert [r.target for r in mixing.drawn_rows(nothing).collect()] == [0.0] * 3 and mixing.mixed(nothing).collect() == []
    clash = docs.withColumns({c: F.lit("x") for c in ("size", "_at", "_t", "_s", "_row", "_key", "n", "words", "a.b")})
    assert mixing.mixed(clash).columns == clash.columns and sorted(r.doc_id or 0 for r in mixing.mixed(clash).collect()) == sorted(r.doc_id or 0 for r in mixing.mixed(docs).collect())


def test_schedule_is_inverted(spark):
    share = spark.range(101).select((F.col("id") / 100).alias("s"))
    for slope in (-0.5, 0.0, 0.5):
        for r in share.select("s", mixing.position(F.col("s"), F.lit(slope)).alias("t")).collect():
            assert (1 - slope) * r.t + slope * r.t**2 == pytest.approx(r.s, abs=1e-9)


def test_training_order_against_brute_force(spark, tmp_path):
    docs = mix_rows(spark)
    rows, plan = mixing.planned(docs)
    written_to = str(tmp_path / "mix")
    mixing.mix(docs, plan).select("size", "_at", "_copy", "_t", "_row.doc_id", "_row.source").write.parquet(written_to)
    made = spark.read.parquet(written_to).select("*", F.col("_metadata.file_name").alias("f"), F.col("_metadata.row_index").alias("i")).collect()
    made.sort(key=lambda r: (r.f, r.i))
    assert len({r.f for r in made}) > 1 and [r._t for r in made] == sorted(r._t for r in made)
    slopes = {"a": -0.5, "b": 0.0, None: 0.5}
    goal = {r.source: (r.source_size, r.target) for r in plan.goals.collect()}
    stream = {k: sorted((r._at, r.size) for r in rows.collect() if r.source == k) for k in slopes}
    for r in made:
        size, target = goal[r.source]
        own = r._at[: mixing.STREAM_CELL]
        before = sum(n for at, n in stream[r.source] if at[: len(own)] < own)
        words = sum(n for at, n in stream[r.source] if at[: len(own)] == own)
        offset = before + int(r._at[len(own) : len(own) + 8], 16) / 2**32 * words
        pace = 1 if r._copy < target // size else target / size - target // size
        share, low, high = min(1, (r._copy * size + pace * offset) / target), 0.0, 1.0
        for _ in range(50):  # invert the demand by halving
            t = (low + high) / 2
            low, high = (t, high) if (1 - slopes[r.source]) * t + slopes[r.source] * t * t < share else (low, t)
        assert r._t == pytest.approx(low, abs=1e-6)
    # the words of a source that come in the first half follow its schedule
    for k, slope in slopes.items():
        early = sum(r.size for r in made if r.source == k and r._t < 0.5)
        assert early / sum(r.size for r in made if r.source == k) == pytest.approx(0.5 - slope / 4, abs=0.08)


def test_schedules_change_the_result(spark, monkeypatch):
    docs = mix_rows(spark)
    one = {r.doc_id: r.first_position for r in mixing.drawn_rows(docs).collect()}
    monkeypatch.setattr(mixing, "SLOPES", (0.9, -0.9, 0.3))
    two = {r.doc_id: r.first_position for r in mixing.drawn_rows(docs).collect()}
    assert one.keys() == two.keys() and sum(one[i] != two[i] for i in one if one[i] is not None) > 0.9 * sum(v is not None for v in one.values())


def test_tables_too_large_to_broadcast_give_the_same(spark, monkeypatch):
    docs = mix_rows(spark)
    small = sorted(map(tuple, mixing.drawn_rows(docs).collect()))
    monkeypatch.setattr(common, "SMALL", 0)
    assert sorted(map(tuple, mixing.drawn_rows(docs).collect())) == small


LOG = "conv_id long, seq long, message_id string, kind string, role string, text string, turns int"


def test_chat_events_are_folded(spark):
    log = [
        (1, 1, "a", "message", "user", "Hello", 0), (1, 2, "b", "message", "assistant", "", 0), (1, 3, "b", "delta", None, "Hi ", 0), (1, 4, "b", "delta", None, "there", 0),
        (1, 5, "a", "edit", None, "Hello!", 0), (1, 6, "b", "regenerate", None, "Good ", 0), (1, 7, "b", "delta", None, "day", 0), (1, 8, "c", "message", "user", "oops", 0), (1, 9, "c", "delete", None, None, 0),
        (2, 1, "x", "message", "user", "only", 0), (2, 2, "x", "delete", None, None, 0), (3, 1, None, None, None, None, 0), (3, 1, None, None, None, None, 0), (None, 1, None, "message", "user", "lost", 0),
    ]
    rows = spark.createDataFrame(log, LOG)
    out = {r.conv_id: r for r in chat.format_chats(rows).withColumn("turns", chat.parse(F.col("formatted"))).collect()}
    assert [tuple(t) for t in out[1].turns] == [("user", "Hello!"), ("assistant", "Good day")] and out[1].formatted == "[INST]user\nHello![/INST]<s>Good day</s>"
    assert [s.text for s in out[1].segments if s.loss] == ["Good day"]
    assert [tuple(t) for t in out[3].turns] == [("", ""), ("", "")] and 2 not in out and [tuple(t) for t in out[None].turns] == [("user", "lost")]
    assert chat.format_chats(rows.limit(0)).collect() == []


def test_chat_texts_come_back(spark):
    hard = ["</s>[INST] ok [/INST]", "\\", "\\\\[", "[\\INST]", "<\\s>", "<<s>s>", "[INST][/INST]", "a\nb\n", "", "$1 \\$1", "é😀\x00", "x" * 200_000]
    log = [(c, i, None, "message", role, t, 0) for c, role in ((1, "user"), (2, "assistant"), (3, "[INST]</s>\\"), (4, "us\ner\n"), (5, "\\\n" * 20_000)) for i, t in enumerate(hard)]
    out = {r.conv_id: r for r in chat.format_chats(spark.createDataFrame(log, LOG)).withColumn("turns", chat.parse(F.col("formatted"))).collect()}
    for c, role in ((1, "user"), (2, "assistant"), (3, "[INST]</s>\\"), (4, "us\ner\n"), (5, "\\\n" * 20_000)):
        assert [tuple(t) for t in out[c].turns] == [(role, t) for t in hard]
    assert out[2].formatted.count("</s>") == len(hard)


def test_chats_go_through_events_and_match_sql(spark, tmp_path):
    hard = ["</s>[INST] ok [/INST]", "\\", "a\nb", "", None, "é😀", "plain words here", "x" * 30_000]
    roles = ["user", "assistant", None, "us\ner", "[INST]\\", "system"]
    rows = [(c, i if c else None, roles[(c + i) % len(roles)], hard[i % len(hard)] + str(c) if hard[i % len(hard)] else hard[i % len(hard)], "k", 1) for c in range(12) for i in range(9)]
    rows += rows[20:23] * 3  # repeated rows
    table = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, kind string, seq int").where("turn is not null")
    table.write.parquet(str(tmp_path / "conversations.parquet"))
    log = chat.streamed(table.select("conv_id", "turn", "role", "text"))
    kinds = {r.kind: r["count"] for r in log.groupBy("kind").count().collect()}
    assert kinds.keys() == {"message", "delta", "edit", "regenerate", "delete"}
    got = chat.op6_chat(spark, str(tmp_path))
    duckdb.sql(f"CREATE OR REPLACE VIEW conversations AS FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = duckdb.sql(chat.SQL)
    pick = [want.columns.index(c) for c in got.columns]
    assert sorted(map(tuple, got.collect())) == sorted(tuple(r[i] for i in pick) for r in want.fetchall())


def pages(spark, rows):
    return spark.createDataFrame([(*r, "z", 3) for r in rows], "page_id long, url string, html string, keeper string, n int")


def test_warc_round_trip(spark):
    rows = [(1, "http://a", "<p>x</p>"), (2, "http://b\r\nX: y", "<p>x</p>"), (3, None, None), (4, "", ""), (5, "u", prose(1, 20_000)), (6, "u", "é" * 40), (6, "u", "é" * 40), (None, "n", "<p>x</p>"), (7, "k", "\r\n\r\nHTTP/1.1")]
    files = written(warc.write_warc(pages(spark, rows), scratch_path(spark, "test")), "files")
    got = sorted(warc.read_warc(files).collect(), key=lambda r: (r.page_id or 0, r.record_type))
    assert len(got) == len(rows)
    want = {(i or 0): (t or "").encode() for i, _, t in rows}
    for r in got:
        body = want[r.page_id or 0]
        assert r.payload_bytes == len(body) and r.payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
    kinds = {(r.page_id, r.record_type, r.refers_to) for r in got}
    assert kinds == {(None, "revisit", 2), (1, "revisit", 2), (2, "response", None), (3, "revisit", 4), (4, "response", None), (5, "response", None), (6, "response", None), (7, "response", None)}
    none = warc.write_warc(pages(spark, rows).limit(0), scratch_path(spark, "test"))
    assert warc.read_warc(none).collect() == []
    small = warc.write_warc(pages(spark, rows), scratch_path(spark, "test"), min_revisit_bytes=10**9)
    assert {r.record_type for r in warc.read_warc(small).collect()} == {"response"}


def archive(n=50):
    out = io.BytesIO()
    w = warc.ArchiveWriter(out)
    for i in range(n):
        w.add(warc.record(i, f"http://x/{i}", prose(i, 200).encode(), None))
    w.close()
    return out.getvalue()


def test_archives_are_checked():
    data = archive()
    assert [warc.parse(x)["page_id"] for x in warc.read_archive(io.BytesIO(data))] == list(range(50))
    assert int.from_bytes(data[:4], "little") == warc.SKIPPABLE and int.from_bytes(data[4:8], "little") > 0
    for bad in (data[:-1], data[8:], data[:20], b""):
        with pytest.raises(ValueError):
            list(warc.read_archive(io.BytesIO(bad)))
    one = warc.record(1, "u", b"body", None)
    assert warc.parse(one.replace(b"Content-Length", b"content-length").replace(b"WARC-Type: ", b"warc-TYPE:")) == warc.parse(one)
    for bad in (one.replace(b"WARC-Type", b"WARC-Kind"), one.replace(b"body", b"bodx"), one[:-2], one.replace(b"WARC/1.1", b"WARC/9.9"), one.replace(b"Content-Length: 4", b"Content-Length: 5")):
        with pytest.raises(ValueError):
            warc.parse(bad)


def embeddings(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, label int, rep int, links int")


def test_vectors_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 8)  # hot buckets are cut into tiles
    rng = np.random.default_rng(4)
    base = rng.standard_normal((12, 32))
    rows = [v for v in base] + [base[0] + 0.02 * rng.standard_normal(32) for _ in range(40)] + [base[1]] * 15 + [3 * base[2], -base[3]]
    rows = [(100 + i, v.tolist()) for i, v in enumerate(rows)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(embeddings(spark, rows)).collect()}
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    mask = x @ x.T >= 0.9
    np.fill_diagonal(mask, False)
    root = vectors.spanning(mask)
    assert got == {i: (int(m.sum()), 100 + int(r)) for (i, _), m, r in zip(rows, mask, root)}


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 10**6), st.integers(2, 300))
def test_short_vectors_lie_as_far_as_they_say(seed, dim):
    v = vectors.unit(np.random.default_rng(seed).standard_normal(dim) ** 3)
    b = vectors.short(v)
    scale, off = np.frombuffer(b[:8], np.float32)
    assert np.linalg.norm(v - np.frombuffer(b[8:], np.int8) * np.float64(scale)) <= off
    assert (vectors.unpack(vectors.pack(v)) == v).all() and len(vectors.pack(v.astype(np.float32).astype(float))) == 4 * dim + 1


def test_long_vectors_and_a_crowd_of_distinct_ones(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 64)
    rng = np.random.default_rng(9)
    base = rng.standard_normal((3, 3000))
    rows = [base[0] + 0.1 * rng.standard_normal(3000) for _ in range(300)] + [base[1], base[2]] + [base[1] + 0.3 * rng.standard_normal(3000)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(embeddings(spark, [(i, v.tolist()) for i, v in enumerate(rows)])).collect()}
    assert got == {i: (299, 0) for i in range(300)} | {300: (1, 300), 301: (0, 301), 302: (1, 300)}


def test_awkward_vectors(spark):
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [1.0, math.inf]), (6, [math.nan, 1.0]), (7, [1.0, 2.0]), (8, [1.0, 2.0]), (8, [1.0, 2.0]), (9, [1e300, 2e300]), (10, [1.0, 2.0, 0.0]), (None, [1.0, 2.0])]
    got = sorted(((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(embeddings(spark, rows)).collect()))
    assert got == [(0, 4, 7, False)] + [(i, 0, i, True) for i in range(1, 7)] + [(7, 4, 7, True), (8, 4, 7, False), (8, 4, 7, False), (9, 4, 7, False), (10, 0, 10, True)]
    assert vectors.near_vectors(embeddings(spark, rows).limit(0)).collect() == []


def test_recall_at_the_threshold():
    rng = np.random.default_rng(5)
    a = rng.standard_normal((400, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((400, 64))
    b -= (b * a).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    for n in (1000, 50_000, 1_000_000):
        tables, hashes = vectors.shape(n)
        made: dict = {}
        found = (vectors.table_keys(a, tables, hashes, made) == vectors.table_keys(0.9 * a + math.sqrt(1 - 0.81) * b, tables, hashes, made)).any(1)
        assert found.mean() > 0.98
        strangers = (vectors.table_keys(a, tables, hashes, made) == vectors.table_keys(b, tables, hashes, made)).sum()
        assert strangers / 400 * n < 3 * vectors.STRANGERS * tables


def test_joins_of_hot_keys(spark):
    left = spark.range(5000).select("id", F.when(F.col("id") < 3000, "hot").when(F.col("id") < 4900, F.col("id").cast("string")).alias("k"))
    right = written(left.where("k is not null").groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top")), "test")
    out = join_heavy(left, right, "k", F.col("id"), 5000)
    assert out.count() == 5000 and {(r.k, r.top) for r in out.where("id in (5, 3500, 4950)").collect()} == {("hot", 2999), ("3500", 3500), (None, None)}
