"""Sharding, mixing, token files, WARC and chat windows: round trips and laws."""

import base64
import hashlib
import io
import random
import zlib

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from patternloom.llm import chat_format, mixing, sharding, token_files, warc
from patternloom.llm.common import rolling, workspace


@given(st.integers(1, 5000), st.integers(0, 9))
def test_feistel_is_a_permutation(n, seed):
    p = sharding.Feistel(n, seed)
    out = p.forward(np.arange(n))
    assert sorted(out) == list(range(n)) and (p.inverse(out) == np.arange(n)).all()


def test_shards(docs, texts, nothing):
    got = sharding.feistel_shards(docs, 8).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(texts)))
    for r in got:
        t = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(t) + 1, zlib.crc32(t))
    slots = {s: sorted(r.slot for r in got if r.shard == s) for s in range(8)}
    assert all(x == list(range(len(x))) for x in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = sharding.feistel_shards(docs.repartition(5), 8).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    assert sharding.feistel_shards(nothing).count() == 0


def test_shards_of_repeated_rows(spark):
    df = spark.createDataFrame([(i % 3, "a" if i % 2 else None, i) for i in range(50)] + [(None, "b", 0)] * 5, "doc_id long, text string, place long").repartition(4)
    got = sharding.feistel_shards(df, 4).collect()
    assert sorted(r.row_number for r in got) == list(range(55))
    for s in range(4):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(14 if s < 3 else 13))


def test_repeated_ids_in_files(spark):
    rows = [(1, "b c"), (1, "a"), (1, "b c"), (0, "z")]
    manifest = token_files.write_tokens(spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, start long").repartition(3), workspace(spark, "t"), token_files.vocabulary())
    back = token_files.read_tokens(spark, manifest).orderBy("start").collect()
    assert [r.doc_id for r in back] == [0, 1, 1, 1] and bytes(back[2].tokens) == bytes(back[3].tokens) and len(back[1].tokens) < len(back[2].tokens)
    pages = spark.createDataFrame([(1, "u", "x", "d", 0), (2, "u", "x", "d", 0), (2, "u", "x", "d", 0), (3, "v", "y" * 200_000, "d", 0)], "page_id long, url string, html string, digest string, n long").repartition(3)
    got = sorted((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.read_warc(spark, warc.write_warc(pages, workspace(spark, "w"))).collect())
    assert got == [(1, "revisit", 2, 1), (2, "response", None, 1), (2, "response", None, 1), (3, "response", None, 200_000)]


def test_targets():
    assert mixing.fill_targets([100, 100, 100], [5, 2, 1], 450, 2) == [200.0, 500 / 3, 250 / 3]
    assert mixing.fill_targets([10, 0], [5, 2], 15, 2) == [15.0, 0.0]
    assert mixing.fill_targets([], [], 0, 2) == []


@pytest.mark.parametrize("slots", [1 << 18, 7])
def test_mixing(docs, texts, slots, nothing):
    documents, schedule = mixing.low_discrepancy_mix(docs, slots=slots)
    got = documents.collect()
    assert sorted(r.doc_id for r in got) == list(range(len(texts)))
    by = {}
    for r in got:
        assert r["size"] == len((texts[r.doc_id] or "").encode().split()) and 0 <= r.taken <= 2 * r["size"]
        by.setdefault(r.source, []).append(r)
    for own in by.values():
        assert sum(r["size"] for r in own) == own[0].source_size and abs(sum(r.taken for r in own) - own[0].target) <= 1
    assert abs(sum(x[0].target for x in by.values()) - 1.5 * sum(x[0].source_size for x in by.values())) < 1e-6
    assert schedule.groupBy("slot").count().where("count > 1").count() == 0
    assert sorted((r.doc_id, r.taken) for r in mixing.low_discrepancy_mix(docs.repartition(7), slots=slots)[0].collect()) == sorted((r.doc_id, r.taken) for r in got)
    if slots > 7:
        assert mixing.low_discrepancy_mix(nothing)[0].count() == 0
        copies = mixing.mixed(docs)
        assert copies.columns == docs.columns and copies.groupBy("doc_id").count().where("count > 2").count() == 0


def test_mixing_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b", None), (1, "a b", None), (None, None, "x"), (None, None, "x"), (2, "c", "x")], "doc_id long, text string, source string")
    got = mixing.low_discrepancy_mix(df)[0].collect()
    assert len(got) == 5 and sum(r.taken for r in got) == 8  # 1.5 * 5 words, by source: 2 and 5.5, rounded


def test_token_files(spark, docs, texts, nothing):
    from tokenizers import Tokenizer

    path = token_files.vocabulary()
    plain = Tokenizer.from_file(path)
    manifest = token_files.write_tokens(docs, workspace(spark, "t"), path)
    got = token_files.read_tokens(spark, manifest, docs_per_task=7).orderBy("start").collect()
    start = 0
    for i, r in enumerate(got):
        ids = [*plain.encode(texts[i] or "", add_special_tokens=False).ids, 1]
        assert (r.doc_id, r.start) == (i, start) and np.frombuffer(r.tokens, "<u4").tolist() == ids
        start += len(ids)
    assert len(got) == len(texts)
    empty = token_files.write_tokens(nothing, workspace(spark, "t"), path)
    assert token_files.read_tokens(spark, empty).count() == 0
    nulls = spark.createDataFrame([(None, "b"), (5, None), (None, "a")], "doc_id long, text string")
    back = token_files.read_tokens(spark, token_files.write_tokens(nulls, workspace(spark, "t"), path)).orderBy("start").collect()
    assert [r.doc_id for r in back] == [None, None, 5]


def test_pieces_equal_whole_texts():
    from tokenizers import Tokenizer

    path = token_files.vocabulary()
    plain, own = Tokenizer.from_file(path), token_files.PieceEncoder(path, "<u4")
    own.LIMIT = 5
    odd = ["It's \"fine\", isn't it?!", "Ångstrom Å é̀", "<|endoftext|> x<|startoftext|>y <|ENDOFTEXT|>", "́ a b c", "12,345.67 abc... x_y-z (q)", "日本語 text😀!", "\x00\x1c\x85 a", "ΑΣ İI", "1st, 2nd. ...", ""]
    for t in odd * 2:
        assert np.frombuffer(own.encode([t.encode()])[0], "<u4").tolist() == plain.encode(t, add_special_tokens=False).ids, t


def test_other_vocabularies_encode_whole_texts():
    from tokenizers import Tokenizer

    path = token_files.vocabulary("byte_bpe_50k.json")
    plain, own = Tokenizer.from_file(path), token_files.PieceEncoder(path, "<u2")
    assert not own.by_piece and token_files.PieceEncoder(token_files.vocabulary(), "<u2").by_piece
    for t in ["It's fine  , isn't it", " a\n\nb ", "", "日本語 text"]:
        assert np.frombuffer(own.encode([t.encode()])[0], "<u2").tolist() == plain.encode(t, add_special_tokens=False).ids


def test_warc_of_others():
    import gzip

    data = b"".join(
        gzip.compress(b"WARC/1.0\r\n" + head + b"\r\n\r\n" + body + b"\r\n\r\n")
        for head, body in [
            (b"WARC-Type: warcinfo\r\nContent-Type: application/warc-fields\r\nContent-Length: 11", b"a: b\r\n\r\nc: "),
            (b"WARC-Type: resource\r\nWARC-Target-URI: http://\xff/\r\nContent-Length: odd", b"some bytes"),
            (b"WARC-Type: response\r\nContent-Type: application/http; msgtype=response", b"HTTP/1.1 200 OK\r\nContent-Length: x\r\n\r\nhello"),
        ]
    )
    got = [(f["warc-type"], payload) for _, f, _, payload in warc.records(io.BytesIO(data), len(data), 0, len(data))]
    assert got == [("warcinfo", b"a: b\r\n\r\nc: "), ("resource", b"some bytes"), ("response", b"hello")]


def test_mixed_keeps_clashing_columns(spark):
    df = spark.createDataFrame([(i, "a b c", "s", i, i, i, i) for i in range(6)], "doc_id long, text string, source string, h long, g long, copies long, copy long")
    got = mixing.mixed(df)
    assert got.columns == df.columns and all(r.h == r.doc_id == r.copies == r.copy == r.g for r in got.collect())


PAGES = [(1, "http://a/", "<p>one</p>"), (2, None, "<p>one</p>"), (3, "http://b/ c\r\n", "<p>two</p>" * 5000), (4, "http://d/é", None), (5, "http://e/", ""), (None, "http://f/", "<p>two</p>" * 5000), (6, "http://g/", "WARC/1.1\r\n\r\n\x1f\x8b\x08")]


@pytest.mark.parametrize("split", [32 << 20, 50])
def test_warc(spark, split):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1)
    manifest = warc.write_warc(pages, workspace(spark, "w"))
    got = sorted(warc.read_warc(spark, manifest, split).collect(), key=lambda r: r.page_id or 0)
    assert [(r.page_id, r.record_type, r.refers_to) for r in got] == [(None, "revisit", 3), (1, "revisit", 2), (2, "response", None), (3, "response", None), (4, "revisit", 5), (5, "response", None), (6, "response", None)]
    for r, (_, _, html) in zip(got, sorted(PAGES, key=lambda p: p[0] or 0)):
        data = (html or "").encode()
        assert r.payload_bytes == len(data) and r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert r.payload is None if r.record_type == "revisit" else r.payload == data
    assert warc.read_warc(spark, warc.write_warc(pages.limit(0), workspace(spark, "w"))).count() == 0


def test_warc_ranges_cut_anywhere():
    inner = warc.member(99, "u", b"inside", False, None)
    data = b"".join([warc.member(1, "u", b"x" * 100, False, None), warc.member(2, "u", inner[:-3], False, None), warc.member(3, "u", b"", True, 1)])
    whole = [(at, f["warc-record-id"]) for at, f, _, _ in warc.records(io.BytesIO(data), len(data), 0, len(data))]
    assert [i for _, i in whole] == ["<urn:page:1>", "<urn:page:2>", "<urn:page:3>"]
    for step in (1, 7, 100):
        assert [(at, f["warc-record-id"]) for s in range(0, len(data), step) for at, f, _, _ in warc.records(io.BytesIO(data), len(data), s, s + step)] == whole


@given(st.text(alphabet="<|\\>ab%\n", max_size=12))
def test_escape_is_reversible(text):
    assert chat_format.unescape(chat_format.escape(text)) == text and "<|" not in chat_format.escape(text)


def test_warc_reader_copies_little(monkeypatch):
    """What a window hands out is in proportion to the file, however many records follow each other in it."""
    handed, piece = [], warc._Window.piece
    monkeypatch.setattr(warc._Window, "piece", lambda *a: handed.append(len(out := piece(*a))) or out)
    data = b"".join(warc.member(i, "u", random.Random(i).randbytes(3000), False, None) for i in range(400))
    got = [(f["warc-record-id"], payload) for _, f, _, payload in warc.records(io.BytesIO(data), len(data), 0, len(data))]
    assert got == [(warc.urn(i), random.Random(i).randbytes(3000)) for i in range(400)]
    assert sum(handed) < 3 * len(data)


@pytest.mark.parametrize("budget,history,stretch", [(1024, 256, 1 << 16), (30, 10, 1 << 16), (30, 12, 40), (1, 0, 3)])
def test_chat(spark, budget, history, stretch):
    long = [(7, i, "system" if i == 0 else "user" if i % 2 else "assistant", f"turn {i} <|im_end|> {'w ' * (i % 9)}") for i in range(25)]
    turns = [*long, (8, 0, "user", None), (8, 1, "assistant", "<|im_start|>"), (9, None, None, "x"), (None, 1, "ro\nle<|%", "a"), (None, 1, "assistant", "b"), (10, 5, "assistant", "z" * 5000)]
    df = spark.createDataFrame([(*t, "k") for t in turns], "conv_id long, turn long, role string, text string, kind string").repartition(4)
    windows = chat_format.format_conversations(df, budget, history, stretch).cache()
    got = {r.conv_id: r for r in chat_format.read_back(windows).collect()}
    for conv in {t[0] for t in turns}:
        own = sorted(((t[1] is not None, t[1] or 0, t[2] or "", t[3] or "") for t in turns if t[0] == conv))
        text = "".join(f"{r}\n{x}\n" for _, _, r, x in own)
        loss = "".join(x for _, _, r, x in own if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(own), hashlib.sha256(text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for w in windows.where("conv_id = 7").collect():
        assert "turn 0 <" in w.text  # the system turn is in every window
        assert w.tokens <= budget or w.turns - w.repeated <= 1
        assert w.text.count("system\n") == 1
    # windows follow the order of the turns, not their numbers
    apart = df.withColumn("turn", F.expr("turn * turn * 5000 + turn"))
    again = chat_format.format_conversations(apart, budget, history, stretch)
    assert sorted(map(str, again.collect())) == sorted(map(str, windows.collect()))
    assert chat_format.read_back(chat_format.format_conversations(df.limit(0))).count() == 0


def test_rolling_hashes():
    words = np.arange(1, 60, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in (1, 2, 5, 18, 35):
        out = rolling(words, k)
        assert len(out) == 60 - k and len(set(out.tolist())) == 60 - k
        assert out[3] == rolling(words[3 : 3 + k], k)[0]
