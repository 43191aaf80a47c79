import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import DATA
from tidewatch.llm import encoding, packing

ODD = ["", None, " ", "\n\n", "a\r\nb\rc", "don't  you're", "<|endoftext|>", "​ x\x1c\x85", "\U0001f600\U0001f468‍\U0001f469", "数据 稀缺", "x" * 20_000, "1234567890" * 50, "á", "\t\tif (x) {\n"]


def test_ids_equal_direct_encoding(spark, monkeypatch):
    monkeypatch.setattr(encoding, "BLOCK_DOCS", 3)
    monkeypatch.setattr(encoding, "BROADCAST_ROWS", 5)
    rows = list(enumerate(ODD)) + [(3, "twice"), (None, "no key")]
    df = spark.createDataFrame([(*r, 1, [2], "w") for r in rows], "doc_id long, text string, block int, ids array<int>, word string")
    got = sorted(((r.doc_id, list(r.ids)) for r in encoding.encode(df).collect()), key=repr)
    enc = encoding.encoder()
    assert got == sorted(((k, enc.encode_ordinary(t or "")) for k, t in rows), key=repr)
    counts = sorted(((r.doc_id, r.n_tokens) for r in encoding.token_counts(df).collect()), key=repr)
    assert counts == sorted(((k, len(enc.encode_ordinary(t or ""))) for k, t in rows), key=repr)
    assert encoding.encode(df.limit(0)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_words_cover_text_and_encode_alike(text):
    text = encoding._valid(text)
    words = encoding.splitter().findall(text)
    enc = encoding.encoder()
    assert "".join(words) == text
    assert [i for w in words for i in enc._encode_single_piece(w.encode())] == enc.encode_ordinary(text)


def test_round_trip(spark):
    docs = spark.read.parquet(str(DATA / "sf0.001" / "documents.parquet")).select("doc_id", "text")
    back = {r.doc_id: r.text for r in encoding.decode(encoding.encode(docs)).collect()}
    assert back == {r.doc_id: r.text or "" for r in docs.collect()}
    bad = spark.createDataFrame([(1, [999_999]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in encoding.decode(bad).collect()} == {1: None, 2: None, 3: ""}


def test_packing_keeps_everything(spark):
    r = random.Random(7)
    sizes = [(i, r.choice([0, 1, 5, 63, 64, 65, 200, r.randrange(1, 64)])) for i in range(3000)] + [(None, 10), (5, 7), (9001, None), (9002, -4)]
    df = spark.createDataFrame([(*x, 3, "c") for x in sizes], "doc_id long, n_tokens long, part int, container string")
    got = packing.pack(df, capacity=64, shard_docs=700).collect()
    again = packing.pack(df.repartition(9), capacity=64, shard_docs=700).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    total = sum(max(n or 0, 0) for _, n in sizes)
    assert sum(x.n_tokens for x in got) == total
    fill = {}
    for x in got:
        if x.container is not None:
            fill.setdefault(x.container, []).append((x.begins_at, x.n_tokens))
    for parts in fill.values():
        at = 0
        for begin, n in sorted(parts):  # no overlap, no gap
            assert begin == at
            at += n
        assert at <= 64
    assert total / (64 * len(fill)) > 0.97
    split = {x.doc_id for x in got if x.part > 0}
    assert split <= {k for k, n in sizes if n and n > 64}
    assert packing.pack(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, capacity=0)


def test_sum_of_squares_rule():
    p = packing.SumOfSquares(10)
    levels = {}
    r = random.Random(8)
    for _ in range(500):
        s = r.randrange(1, 12)
        before = p.count.copy()
        _, at = p.place(s)
        if s < 10:
            def change(h):
                c = before.copy()
                if h:
                    c[h] -= 1
                if h + s < 10:
                    c[h + s] += 1
                return int((c**2).sum() - (before**2).sum())

            options = [0] + [h for h in range(1, 10 - s + 1) if before[h]]
            assert change(at) == min(map(change, options))
        levels[at] = levels.get(at, 0) + 1


def test_containers_of_the_test_texts_are_full(spark):
    """sf0.1: at least 99.5 % of the room of all containers is used."""
    from tests.conftest import DATA
    from tidewatch.llm import queries_b

    r = queries_b.p9_fill(spark, f"{DATA}/sf0.1").first()
    print(r)
    assert r.share > 0.995 and r.containers * packing.CAPACITY >= r.tokens


def test_fill_of_nothing(spark):
    r = packing.fill(packing.pack(spark.createDataFrame([], "doc_id long, n_tokens long"))).first()
    assert (r.containers, r.tokens, r.share) == (0, 0, None)
