"""Sum-of-squares packing of tokenised documents into sequences.

Longest first, a document goes into the open sequence that makes the squared counts of open
sequences, summed over residual gaps, smallest (of equals, the fullest); where none has room a new
one opens. Pieces are dealt evenly into packing groups of bounded size, each of which packs on its
own; a group leaves a few sequences unfilled, whatever its size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import ByWord, encoder, tokenizer_path
from .common import giving_back, id_and_text, read, real_id, with_fields

PIECES = pa.schema([("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])


def pack(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each length (1 to capacity), placed longest first."""
    number, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    count = np.zeros(capacity + 1, np.int64)  # open sequences by residual gap; 0 counts none
    bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    made = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        # change of the sum when a gap g shrinks to g - n: 2 * (count[g - n] - count[g]) + 2, with gap 0 uncounted
        change = 2 * (count[: capacity + 1 - n] - count[n:]) + 2
        change[0] = 1 - 2 * count[n]
        change[count[n:] == 0] = 1 << 40
        best = int(change.argmin())
        if change[best] < 1 << 40:
            gap = best + n
            at = bins[gap].pop()
            count[gap] -= 1
        else:
            gap, at = capacity, made
            made += 1
        number[i], offset[i] = at, capacity - gap
        if gap > n:
            bins[gap - n].append(at)
            count[gap - n] += 1
    return number, offset


def token_pieces(docs: DataFrame, path: str, capacity: int = 2048, end: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most `capacity` tokens: id, piece, start, length, ids (little-endian unsigned 32-bit).

    A document is its text's ids and then the id `end`; only longer ones are cut. Null is the empty text. Rows may repeat;
    an empty table gives no rows; other columns are ignored.
    """

    def run(batches):
        enc = encoder(ByWord, path)
        last = np.array([end], "<u4").tobytes()
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, len(batch), 500)):
                out = []
                for own, text in zip(part["id"].to_pylist(), part["text"].to_pylist(), strict=True):
                    ids = enc.encode(text) + last
                    for piece, a in enumerate(range(0, len(ids), 4 * capacity)):
                        cut = ids[a : a + 4 * capacity]
                        out.append((own, piece, a // 4, len(cut) // 4, cut))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(map(list, zip(*out, strict=True)), PIECES, strict=True)], schema=PIECES)

    return id_and_text(docs, id_col, text_col).mapInArrow(giving_back(run), "id long, piece int, start long, length long, ids binary")


def pack_pieces(pieces: DataFrame, capacity: int, groups: int) -> DataFrame:
    """Adds sequence_id and offset to rows with a length from 1 to capacity; an empty table gives no rows.

    Rows are dealt into groups by identifier, place and content, so one identifier for many rows, or none, does no harm.
    """
    schema = with_fields(pieces.schema, sequence_id="long", offset="long")
    pieces = pieces.withColumn("_g", F.pmod(F.xxhash64(*[c for c in pieces.columns if c in ("id", "piece", "start", "length", "ids_crc32")]), F.lit(groups)).cast("int"))

    def of_group(key, table):
        number, offset = pack(table["length"].to_numpy(), capacity)
        table = table.drop_columns(["_g"])
        return table.append_column("sequence_id", pa.array(number + (key[0].as_py() << 36))).append_column("offset", pa.array(offset))

    return pieces.groupBy("_g").applyInArrow(of_group, schema)


def packed_documents(docs: DataFrame, path: str, capacity: int = 2048, end: int = 0, per_group: int = 100_000, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """All documents as pieces with their place: id_col, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    Null texts count as empty and still have the end token. Rows with one identifier are documents of their own. An
    empty table gives no rows; other columns are ignored. per_group bounds the documents that one task packs, about.
    """
    groups = max(1, -(-docs.count() // per_group))
    pieces = token_pieces(docs, path, capacity, end, id_col, text_col).withColumn("ids_crc32", F.crc32("ids"))
    if not keep_ids:
        pieces = pieces.drop("ids")
    out = pack_pieces(pieces, capacity, groups)
    return out.select(real_id().alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * keep_ids)


def op2_sum_of_squares_packing(spark, sf_dir):
    return packed_documents(read(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))
