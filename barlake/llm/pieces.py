"""SentencePiece ids and decoded texts through tables of distinct chunks.

Spaces become the mark U+2581 and a text begins with one. A chunk is a run of marks and the characters up to the next
mark. Where no piece of the vocabulary has a mark behind another character, no merge crosses from one chunk into
the next, so the ids of a text are the ids of its chunks in order. The same holds for decoding: a chunk's first
piece begins with a mark, so no sequence of byte pieces runs over a chunk's end.

Each block of texts, some `CHARS_AT_ONCE` characters, has a table of its distinct chunks: the library segments and
decodes each of them once, and the results are joined back in the order of the positions. A longer text spans
several blocks, cut between chunks, and its digests go on from block to block, so memory is bounded by the block, not
by the text. What lately seen blocks have segmented is kept for the next ones, up to two tables of `HELD` chunks.
The table is not made for the whole corpus at once: distinct words grow with the corpus, and sending all positions to one
table and back would shuffle several times the input, while segmenting what a block has not seen takes a
second or two per million new chunks. Nothing is shuffled and a task that is run again gives the same rows.

Null and empty texts have no ids and decode to the empty text. Repeated rows and null ids are rows of their own.
An empty table gives an empty result. `encode` keeps all other columns as they are.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from barlake.llm.common import rows, table, texts

MARK = "\u2581"
CHARS_AT_ONCE = 4_000_000
HELD = 250_000

DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

_chunk = re.compile(f"{MARK}+[^{MARK}]*")
_edge = re.compile(f"[^ {MARK}](?=[ {MARK}])")
_crossing = re.compile(f"[^{MARK}]{MARK}")


def default_model() -> str:
    """The public 32k piece vocabulary of the installed vocabulary files."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class ChunkTable:
    """A row per distinct chunk: its ids joined by commas, their number, the decoded chunk.

    The key is the chunk without its first mark, which is what the library takes and puts the mark in front of.
    Raises ValueError for a vocabulary whose pieces cross marks, or that drops white space.
    """

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [lib.id_to_piece(i) for i in range(lib.get_piece_size())]
        probe = lib.encode(" a  b", num_threads=1)
        if any(_crossing.search(p) for p in pieces) or lib.decode(probe) != " a  b" or not pieces[probe[0]].startswith(MARK):
            raise ValueError("the pieces of this vocabulary do not end at white space marks")
        self.mark_id = lib.piece_to_id(MARK)
        self.young: dict[str, tuple[str, int, str]] = {}
        self.old: dict[str, tuple[str, int, str]] = {}

    def rows_of(self, chunks: list[str]) -> dict[str, tuple[str, int, str]]:
        """The table of a block's chunks."""
        found, new = {}, []
        for c in set(chunks):
            row = self.young.get(c) or self.old.get(c)
            if row:
                found[c] = row
            else:
                new.append(c)
        ids = [i or [self.mark_id] for i in self.library.encode(new, num_threads=1)]
        # a decoded text lacks its first mark
        back = self.library.decode(ids)
        found.update((c, (",".join(map(str, i)), len(i), " " + t)) for c, i, t in zip(new, ids, back, strict=True))
        if len(self.young) + len(found) > HELD:
            self.young, self.old = {}, self.young
        if len(found) <= HELD:
            self.young.update(found)
        return found


_tables: dict[str, ChunkTable] = {}


def chunk_table(path: str) -> ChunkTable:
    """The worker's table for a vocabulary; Python workers are used again by later tasks."""
    if path not in _tables:
        _tables[path] = ChunkTable(path)
    return _tables[path]


def portions(text: str, budget: int = CHARS_AT_ONCE) -> Iterator[str]:
    """A text in parts of about the budget, cut between chunks; each part's first mark is left out."""
    at = 0
    while len(text) - at > budget and (edge := _edge.search(text, at + budget - 1)):
        yield text[at : edge.end()]
        at = edge.end() + 1
    if text:
        yield text[at:]


def chunks_of(part: str) -> list[str]:
    """The chunks of a part of a text, each without its first mark."""
    if "  " in part or MARK in part or part.startswith(" "):
        return [c[1:] for c in _chunk.findall((MARK + part).replace(" ", MARK))]
    return part.split(" ")


def encoded(several: list[str], chunk_rows: ChunkTable, budget: int = CHARS_AT_ONCE) -> Iterator[tuple[int, list[tuple[str, int, str]]]]:
    """(text, the rows of its chunks in order) for each part of each text."""
    chunks: list[str] = []
    owners: list[tuple[int, int]] = []
    size = 0

    def joined() -> Iterator[tuple[int, list[tuple[str, int, str]]]]:
        found = chunk_rows.rows_of(chunks)
        at = 0
        for k, n in owners:
            yield k, [found[c] for c in chunks[at : at + n]]
            at += n

    for k, text in enumerate(several):
        for part in portions(text, budget):
            own = chunks_of(part)
            chunks += own
            owners.append((k, len(own)))
            size += len(part)
            if size >= budget:
                yield from joined()
                chunks, owners, size = [], [], 0
    if owners:
        yield from joined()


def digests(docs: DataFrame, model_path: str) -> DataFrame:
    """Per document the number of its ids, the digest of the ids joined by commas, and the digest of the decoded text."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk_rows = chunk_table(model_path)
        for b in batches:
            several = texts(b, "text")
            n_tokens = [0] * len(several)
            of_ids = [hashlib.sha256() for _ in several]
            of_text = [hashlib.sha256() for _ in several]
            for k, own in encoded(several, chunk_rows):
                ids, sizes, back = zip(*own, strict=True)
                first = n_tokens[k] == 0
                of_ids[k].update((("" if first else ",") + ",".join(ids)).encode())
                of_text[k].update("".join(back)[1 if first else 0 :].encode())
                n_tokens[k] += sum(sizes)
            yield rows({"doc_id": b.column("doc_id").to_pylist(), "n_tokens": n_tokens, "ids_sha256": [d.hexdigest() for d in of_ids], "decoded_sha256": [d.hexdigest() for d in of_text]}, schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, DIGESTS)


def encode(docs: DataFrame, model_path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """All columns of the documents with the ids of the text and the decoded text, under the given names.

    Raises ValueError if the documents have a column of one of these names.
    """
    if clash := {ids, decoded} & set(docs.columns):
        raise ValueError(f"the documents have a column {min(clash)}")
    wide = StructType([*docs.schema.fields, StructField(ids, ArrayType(IntegerType())), StructField(decoded, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk_rows = chunk_table(model_path)
        for b in batches:
            several = texts(b, "text")
            of_ids: list[list[int]] = [[] for _ in several]
            of_text: list[list[str]] = [[] for _ in several]
            for k, own in encoded(several, chunk_rows):
                of_ids[k].extend(int(i) for one, _, _ in own for i in one.split(","))
                of_text[k].extend(t for _, _, t in own)
            found = [pa.array(of_ids, pa.list_(pa.int32())), pa.array(["".join(t)[1:] for t in of_text], pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns, *found], names=[*b.schema.names, ids, decoded])

    return docs.mapInArrow(run, wide)


def op12_piece_digests(spark, sf_dir: str) -> DataFrame:
    """The contract's counts and digests of all documents."""
    return digests(table(spark, sf_dir, "documents"), default_model())
