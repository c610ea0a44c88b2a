"""SentencePiece: the library's unigram search, a plain dynamic program and exact round trips."""

import random
import struct

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from freshet.llm import pieces


@pytest.fixture(scope="module")
def table():
    return pieces.load()


@pytest.fixture(scope="module")
def codec(table):
    return pieces.Codec(table)


def plain_segmentation(table, text):
    """Every piece at every place, by a dictionary; longer last pieces first among equals."""
    known = {t: (i, s) for i, (t, s) in enumerate(zip(table.texts, table.scores)) if t is not None}
    unknown = min(s for _, s in known.values()) - pieces.UNKNOWN_COST
    best, ids = [0.0], [[]]
    for end in range(1, len(text) + 1):
        top, found = float("-inf"), None
        for start in range(max(0, end - 20), end):
            piece = known.get(text[start:end])
            if piece and best[start] + piece[1] > top:
                top, found = best[start] + piece[1], ids[start] + [piece[0]]
        if text[end - 1] not in known and best[end - 1] + unknown > top:
            raw = text[end - 1].encode("utf-8", "surrogateescape")
            top, found = best[end - 1] + unknown, ids[end - 1] + [table.byte_ids[b] for b in raw]
        best.append(top)
        ids.append(found)
    return ids[-1]


def random_texts(n, seed):
    r = random.Random(seed)
    words = "the of and thontion Étion schön niño 漢字 a1b2 .com foo.bar x_y ### 12.5 \n \t é☃ 😀 eau.".split(" ")
    return [" ".join(r.choice(words) for _ in range(r.randrange(0, 40))).replace("a1", " " * r.randrange(4)) for _ in range(n)]


def test_segmentation_is_the_best_one(table, codec):
    for text in random_texts(150, 1):
        spaced = (" " + text).replace(" ", pieces.SPACE)
        expected = plain_segmentation(table, spaced) if text else []
        assert codec.encode(text.encode()).tolist() == expected
        assert not text or codec.segment(spaced) == expected  # whole, without cuts into words


def test_library_finds_the_same_pieces(table, codec, tmp_path):
    """The model file, with these scores and the kind set to unigram, in the library's own search."""
    raw = open(pieces.MODEL, "rb").read()
    scores = np.array(table.scores, np.float32)
    out, at, i = bytearray(), 0, 0

    def varint(at):
        value = shift = 0
        while True:
            value |= (raw[at] & 127) << shift
            shift, at = shift + 7, at + 1
            if raw[at - 1] < 128:
                return value, at

    while at < len(raw):
        tag = raw[at]
        size, begin = varint(at + 1)
        body = raw[begin : begin + size]
        if tag == 0x0A:  # a piece: its text, its score, its kind
            length = 2 + body[1]
            body = body[:length] + b"\x15" + struct.pack("<f", scores[i]) + body[length + 5 :]
            i += 1
        if tag == 0x12:  # the trainer's settings: field 3 is the kind of model
            body = body.replace(b"\x18\x02", b"\x18\x01", 1)
        out += bytes([tag]) + (bytes([size]) if size < 128 else bytes([size & 127 | 128, size >> 7])) + body
        at = begin + size
    path = tmp_path / "unigram.model"
    path.write_bytes(bytes(out))
    library = sentencepiece.SentencePieceProcessor(model_file=str(path))
    texts = [t for t in random_texts(300, 2) if pieces.SPACE not in t]
    same = sum(codec.encode(t.encode()).tolist() == library.encode(t) for t in texts)
    assert same >= 0.99 * len(texts)  # the library sums in single precision, which may turn a near tie


@pytest.mark.parametrize(
    "raw", [b"", b" ", b"   a  b ", "▁x ▁▁ y▁".encode(), b"\xff\xfe ok \x80", "\x00\x01é漢字😀".encode(), b"w" * 70_000, ("the " * 30_000).encode()]
)
def test_round_trip(codec, raw):
    ids = codec.encode(raw)
    assert codec.decode(ids) == raw
    assert not raw or len(ids)


def test_forgetting_changes_nothing(table, monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 3)
    small, texts = pieces.Codec(table), random_texts(50, 3)
    fresh = [pieces.Codec(table).encode(t.encode()).tolist() for t in texts[:5]]
    assert [small.encode(t.encode()).tolist() for t in texts][:5] == fresh


def test_scores(table):
    chances = np.exp([s for t, s in zip(table.texts, table.scores) if t is not None])
    assert chances.sum() == pytest.approx(1)
    with pytest.raises(ValueError):
        pieces.load(scores="other")


def test_columns(spark, table, codec):
    rows = [(1, "the eau"), (2, None), (3, ""), (3, ""), (4, "▁ 😀")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    encoded, decoded = pieces.codec_columns(docs, table)
    coded = docs.select("doc_id", "text", encoded().alias("coded")).select("doc_id", "text", "coded.*")
    found = coded.select("doc_id", "text", "ids", F.col("back").cast("string").alias("back"), decoded("ids").alias("again")).collect()
    found.sort(key=lambda r: r["doc_id"])
    assert [r["text"] for r in found] == [r["back"] for r in found] == [r["again"] for r in found]
    assert found[0]["ids"] == codec.encode(b"the eau").tolist() and found[1]["ids"] is None and found[2]["ids"] == []
    empty = docs.where("doc_id > 9")
    assert empty.select(encoded().alias("coded")).select("coded.*").select(decoded("ids"), F.size("ids")).collect() == []
