"""Byte-pair encoding and decoding with public tokenizer files.

Texts are cut where the tokenizer's own rules cut them, and each distinct piece is encoded once per
worker. A long piece that these rules leave whole is encoded by tree concatenation: both halves on
their own, then a growing window around the join until the window's outermost tokens on both sides
are the ones that were there before. Byte-pair merging is decided by neighbours: a sequence is the
encoding if every two neighbouring tokens are the encoding of their bytes, so agreement at both
ends makes the whole exact.
"""

from __future__ import annotations

import json
import struct
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import giving_back, id_and_text, read, real_id, with_fields

#: Pieces of more bytes than this are encoded as trees.
LONG = 512
#: Distinct pieces that a worker remembers, of each sort: so many new ones, and as many met before them.
REMEMBERED = 175_000
#: The same for whole words, of which texts have more.
WORDS = 220_000

_VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_REST = [b for b in range(256) if b not in set(_VISIBLE)]
#: Byte-level alphabet: visible bytes stand for themselves, the others for code points from 256 on.
LETTER = {b: chr(b) for b in _VISIBLE} | {b: chr(256 + i) for i, b in enumerate(_REST)}
BYTE = {c: b for b, c in LETTER.items()}
_LETTERS = [LETTER[b] for b in range(256)]


def tree_encode(encode, data: bytes, most: int = LONG, pool: ThreadPoolExecutor | None = None) -> list[bytes]:
    """The tokens (as bytes) of an unsplit piece. encode: bytes -> list of tokens as bytes."""
    if len(data) <= most:
        return encode(data)
    halves = (data[: len(data) // 2], data[len(data) // 2 :])
    if pool is not None:
        left, right = (f.result() for f in [pool.submit(tree_encode, encode, h, most) for h in halves])
    else:
        left, right = (tree_encode(encode, h, most) for h in halves)
    return join(encode, left, right)


def join(encode, left: list[bytes], right: list[bytes]) -> list[bytes]:
    n = 4
    while True:
        a, b = left[-n:], right[:n]
        window = encode(b"".join(a) + b"".join(b))
        whole_left, whole_right = n >= len(left), n >= len(right)
        if (whole_left or window[0] == a[0]) and (whole_right or window[-1] == b[-1]):
            return left[: max(0, len(left) - n)] + window + right[n:]
        n *= 2


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _lettered(data: bytes) -> str:
    """Bytes in the byte-level alphabet."""
    return "".join([_LETTERS[b] for b in data])


def _lettered_run(run: str) -> str:
    """The same for a text without white space and control characters."""
    return run if run.isascii() else _lettered(run.encode())


class Pieces(dict):
    """Piece -> its ids as little-endian 32-bit integers; filled as pieces come. Full, it becomes the older generation, from which pieces met again come back."""

    def __init__(self, encode, size: int = REMEMBERED) -> None:
        self.encode_bytes, self.size = (lambda piece: _packed(encode(piece))), size
        self.older: dict = {}

    def __missing__(self, piece):
        if len(self) >= self.size:
            self.older = dict(self)
            self.clear()
        got = self.older.get(piece)
        if got is None:
            got = self.encode_bytes(piece)
        self[piece] = got
        return got


class ByteLevel:
    """A byte-level tokenizer file with its usual pre-tokenisation."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        spec = json.loads(t.to_str())
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.find = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
        vocab = spec["model"]["vocab"]
        self.bytes = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in vocab.items():
            self.bytes[i] = bytes(BYTE[c] for c in token)
        self.id = {b: i for i, b in enumerate(self.bytes)}
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.pieces = Pieces(self._encode_piece)
        #: Characters that the two libraries may put into different classes.
        self.odd = regex.compile(r"[^\x09-\x0d\x20-\x7e -ɏͰ-ϿЀ-џ‐-‧ぁ-ゖァ-ヺ一-龥가-힣]").search

    def _tokens(self, data: bytes) -> list[bytes]:
        return [self.bytes[x.id] for x in self.tokenizer.model.tokenize(_lettered(data))]

    def _encode_piece(self, piece: str) -> list[int]:
        data = piece.encode()
        if len(data) <= LONG:
            return [x.id for x in self.tokenizer.model.tokenize(_lettered(data))]
        if len(data) <= 64 * LONG:
            return [self.id[b] for b in tree_encode(self._tokens, data)]
        with ThreadPoolExecutor(2) as pool:
            return [self.id[b] for b in tree_encode(self._tokens, data, pool=pool)]

    def _split(self, text: str) -> list[str]:
        if self.odd(text):
            return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        return self.find(text)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers."""
        get = self.pieces.__getitem__
        if self.cut is None or not self.cut.search(text):
            return b"".join(map(get, self._split(text)))
        out = []
        for part in self.cut.split(text):
            out.append(np.array([self.special[part]], "<u4").tobytes() if part in self.special else b"".join(map(get, self._split(part))))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class ByWord:
    """A lower-casing tokenizer file whose rules never reach over ASCII white space.

    Distinct words are remembered, and so are the runs of letters and of marks that they are made of. Words of ASCII and
    Latin letters are cut and lower-cased here, as the file's rules do it; the library does all others.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        self.special = regex.compile("|".join(regex.escape(x["content"]) for x in json.loads(t.to_str())["added_tokens"]) or "(?!)").search
        self.plain = regex.compile("[\x21-\x7e\u00c0-\u012f\u0131-\u0148\u014a-\u017e]+").fullmatch
        self.find = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
        tokens = t.model.tokenize
        self.runs = Pieces(lambda run: [x.id for x in tokens(_lettered_run(run))], WORDS)
        self.pieces = Pieces(None, WORDS)
        self.pieces.encode_bytes = self._word

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        core = text.rstrip(_MARKS)
        if core.isalpha() and (core.isascii() or self.plain(core)) and not self.special(text):
            ids = self.runs[core.lower()]
            return ids if len(core) == len(text) else ids + self.runs[text[len(core) :]]
        if self.plain(text) and not self.special(text):
            return b"".join(map(self.runs.__getitem__, self.find(text.lower())))
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, text.encode().split()))


_ENCODERS: dict[tuple, object] = {}


def encoder(kind: type, path: str):
    """One encoder per worker process and file."""
    if (kind, path) not in _ENCODERS:
        _ENCODERS[kind, path] = kind(path)
    return _ENCODERS[kind, path]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


ENCODED = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row: id_col, n_tokens, ids (little-endian 32-bit integers), as the file's library encodes the text.

    No special tokens are added, but their strings in a text become them; nothing is truncated or padded. Null is the
    empty text, which has no tokens. Rows may repeat; an empty table gives no rows; other columns are ignored.
    """

    def run(batches):
        enc = encoder(ByteLevel, path)
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, len(batch), 500)):
                ids = [enc.encode(t) for t in part["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays([part["id"], pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], schema=ENCODED)

    out = id_and_text(docs, id_col, text_col).mapInArrow(giving_back(run), "id long, n_tokens long, ids binary")
    return out.select(real_id().alias(id_col), "n_tokens", "ids")


def bpe_decode(encoded: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds the text of ids; special tokens stay, bytes that are no UTF-8 become U+FFFD. Null ids give null."""
    schema = with_fields(encoded.schema, **{out_col: "string"})

    def run(batches):
        enc = encoder(ByteLevel, path)
        for batch in batches:
            for part in (batch.slice(i, 500) for i in range(0, len(batch), 500)):
                texts = [None if x is None else enc.decode(x) for x in part[ids_col].to_pylist()]
                yield part.append_column(out_col, pa.array(texts, pa.string()))

    return encoded.mapInArrow(giving_back(run), schema)


def with_ids_sha256(encoded: DataFrame) -> DataFrame:
    """ids becomes ids_sha256: of the decimal ids, joined by commas."""
    import hashlib

    names = [c for c in encoded.columns if c != "ids"]
    schema = with_fields(encoded.select(*names).schema, ids_sha256="string")

    def run(batches):
        decimal: list[str] = []
        for batch in batches:
            got = []
            for x in batch["ids"].to_pylist():
                ids = np.frombuffer(x, "<u4")
                if len(ids) and (top := int(ids.max())) >= len(decimal):
                    decimal.extend(map(str, range(len(decimal), top + 1)))
                got.append(hashlib.sha256(",".join(map(decimal.__getitem__, ids.tolist())).encode()).hexdigest())
            yield batch.select(names).append_column("ids_sha256", pa.array(got, pa.string()))

    return encoded.mapInArrow(giving_back(run), schema)


def op3_tree_bpe(spark, sf_dir):
    from pyspark.sql import functions as F

    path = tokenizer_path("byte_bpe_50k.json")
    decoded = bpe_decode(bpe_encode(read(spark, sf_dir), path), path)
    return with_ids_sha256(decoded.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256")))
