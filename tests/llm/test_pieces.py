import hashlib
import random

import pytest
import sentencepiece

from barlake.llm import pieces
from edge_rows import EDGE, LONG, frame

SMALL = "/root/testdata/sf0.001"
PARTS = ["a", "B", " ", "  ", "▁", "\n", "é", "中", "\U0001f600", "the", " the", ".", "\t", "\x00", "<s>", "<0x0A>", "\x85", "ing", "123"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def whole(library, doc_id, text):
    ids = library.encode(text or "", num_threads=1)
    return doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))


def test_query_equals_the_library_on_whole_texts(spark, library):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = pieces.op12_piece_digests(spark, SMALL)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(whole(library, d.doc_id, d.text) for d in docs)


@pytest.mark.parametrize("budget", [7, 4_000_000])
def test_chunks_in_blocks_of_any_size(library, budget):
    rng = random.Random(12)
    several = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 15))) for _ in range(4000)]
    table = pieces.chunk_table(pieces.default_model())
    ids, texts = [[] for _ in several], ["" for _ in several]
    for k, own in pieces.encoded(several, table, budget):
        ids[k] += [int(i) for one, _, _ in own for i in one.split(",")]
        texts[k] += "".join(t for _, _, t in own)
        assert sum(n for _, n, _ in own) == sum(one.count(",") + 1 for one, _, _ in own)
    for text, i, t in zip(several, ids, texts):
        assert i == library.encode(text, num_threads=1)
        assert t[1:] == library.decode(i)


def test_distinct_chunks_are_segmented_once_and_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(pieces, "HELD", 50)
    table = pieces.ChunkTable(pieces.default_model())
    asked = []
    library = table.library

    class Counting:
        def encode(self, chunks, num_threads):
            asked.extend(chunks)
            return library.encode(chunks, num_threads=num_threads)

        decode = staticmethod(library.decode)

    table.library = Counting()
    list(pieces.encoded(["one two one two three"] * 20, table))
    list(pieces.encoded(["three two"], table))
    assert sorted(asked) == ["one", "three", "two"]
    for lo in range(0, 400, 20):
        list(pieces.encoded([" ".join(f"w{k}" for k in range(lo, lo + 20))], table))
        assert len(table.young) <= 70 and len(table.old) <= 70


def test_edges(spark, library):
    got = sorted((tuple(r) for r in pieces.digests(frame(spark), pieces.default_model()).collect()), key=repr)
    assert got == sorted((whole(library, r[0], r[1]) for r in EDGE), key=repr)
    assert pieces.digests(frame(spark, []), pieces.default_model()).collect() == []


def test_encode_keeps_columns_and_round_trips(spark, library):
    docs = frame(spark)
    got = pieces.encode(docs, pieces.default_model())
    assert got.columns == [*docs.columns, "ids", "decoded"]
    for r in got.collect():
        assert r.ids == library.encode(r.text or "", num_threads=1) and r.decoded == (r.text or "") and r.score == 1.5
    assert LONG in {r.decoded for r in got.collect()}
    with pytest.raises(ValueError, match="spans"):
        pieces.encode(docs, pieces.default_model(), ids="spans")
