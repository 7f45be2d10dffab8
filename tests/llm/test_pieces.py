import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gavelworks.llm import pieces

from frames import no_documents, odd_documents

spm = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load_pieces()


@pytest.fixture(scope="module")
def library(vocabulary):
    """The same pieces and scores as a unigram model of the library."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(pieces.MODEL, "rb") as file:
        model.ParseFromString(file.read())
    for i, score in zip(vocabulary.ids, vocabulary.scores):
        model.pieces[i].score = score
    model.trainer_spec.model_type = model.trainer_spec.UNIGRAM
    return spm.SentencePieceProcessor(model_proto=model.SerializeToString())


def texts(data):
    import pyarrow.parquet as pq

    return pq.read_table(f"{data}/documents.parquet", columns=["text"])["text"].combine_chunks()


def test_as_good_as_the_library(vocabulary, library, data):
    score = dict(zip(vocabulary.ids.tolist(), vocabulary.scores))
    total = lambda ids: sum(score.get(i, 0.0) for i in ids)
    some = [t[:3000] for t in texts(data).to_pylist() if t] + ["a\n\n\tb  c", "   x ", "漢 é😀𝒳", "  ", "\x00"]
    same = 0
    for text, own in zip(some, pieces.tokens_of(vocabulary, pa.array(some)).to_pylist()):
        theirs = library.encode(text)
        # The library adds in single precision, so ways of equal score may differ.
        assert own == theirs or abs(total(own) - total(theirs)) < 1e-2
        same += own == theirs
    assert same > 0.9 * len(some)


def test_a_plain_search_finds_the_same(vocabulary):
    names = {bytes(vocabulary.bytes[a:b]).decode("utf-8", "ignore"): s for a, b, s in (
        (vocabulary.offsets[i], vocabulary.offsets[i + 1], s) for i, s in zip(vocabulary.ids, vocabulary.scores))}
    rng = random.Random(1)
    for _ in range(150):
        word = " " + "".join(rng.choices("abcdethins ü漢\u00ad", k=rng.randint(1, 12))).replace(" ", "")
        best = [0.0] + [-np.inf] * len(word)
        for end in range(1, len(word) + 1):
            for begin in range(max(0, end - 16), end):
                part = word[begin:end]
                s = names.get(part, vocabulary.unknown if end - begin == 1 else -np.inf)
                best[end] = max(best[end], best[begin] + s)
        (ids,) = pieces.tokens_of(vocabulary, pa.array([word[1:]])).to_pylist()
        score = dict(zip(vocabulary.ids.tolist(), vocabulary.scores))
        unknown = sum(c not in names for c in word)
        assert abs(sum(score.get(i, 0.0) for i in ids) + unknown * vocabulary.unknown - best[-1]) < 1e-9


def test_every_text_comes_back(vocabulary, data):
    rng = random.Random(2)
    made = ["".join(chr(rng.choice([32, 32, 10, 97, 233, 0x2581, 0x1F600, 0x7F, 0])) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    made += [None, "", " ", "x" * 20_000, " " * 5000, "é" * 9000]
    column = pa.array(made)
    assert pieces.texts_of(vocabulary, pieces.tokens_of(vocabulary, column)).to_pylist() == [t or "" for t in made]
    column = texts(data)
    assert pieces.texts_of(vocabulary, pieces.tokens_of(vocabulary, column)).to_pylist() == [t or "" for t in column.to_pylist()]


def test_no_utf8(vocabulary):
    ids = pa.array([[int(vocabulary.of_byte[0xFF])], [], None], pa.list_(pa.int32()))
    assert pieces.texts_of(vocabulary, ids).to_pylist() == ["\ufffd", "", ""]


def test_odd_frames(spark):
    frame = odd_documents(spark)
    both = pieces.decode(pieces.encode(frame))
    assert set(both.columns) == {*frame.columns, "decoded"}
    rows = both.collect()
    assert len(rows) == 11 and all(r.decoded == (r.text or "") for r in rows)
    assert all(r.tokens == [] for r in rows if not r.text)
    assert pieces.decode(pieces.encode(no_documents(spark))).count() == 0
    nothing = frame.select("doc_id", F.lit(None).cast("array<int>").alias("tokens"))
    assert {r.decoded for r in pieces.decode(nothing).collect()} == {""}


def test_small_slices_have_the_same_tokens(spark):
    frame = spark.createDataFrame([(i, f"slice {i} of some text " * (i % 5)) for i in range(60)], "doc_id long, text string")
    whole, small = ({r.doc_id: r.tokens for r in df.collect()} for df in (pieces.encode(frame), pieces.encode(frame, most=50)))
    assert whole == small and len(small) == 60


def test_checked_in_one_pass(spark):
    """The same as encoding, decoding and comparing, by one Python step."""
    frame = odd_documents(spark)
    out = pieces.encode_checked(frame, most=50)
    assert set(out.columns) == {*frame.columns, "tokens", "lossless"} - {"text"}
    want = sorted((repr(r.doc_id), r.tokens) for r in pieces.encode(frame).collect())
    rows = out.collect()
    assert sorted((repr(r.doc_id), r.tokens) for r in rows) == want and all(r.lossless for r in rows)
    broken = spark.createDataFrame([(1, b"a\xff"), (2, b"a")], "doc_id long, b binary")
    broken = pieces.encode_checked(broken.select("doc_id", F.expr("cast(b as string)").alias("text")))
    assert {r.doc_id: r.lossless for r in broken.collect()} == {1: False, 2: True}
    assert pieces.encode_checked(no_documents(spark)).count() == 0
