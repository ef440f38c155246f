"""SentencePiece encoding that keeps every piece's source bytes, and decoding.

The normaliser's compiled character map (a double-array trie and a pool of replacements) is read from
the model. Normalising takes the longest prefix that the trie knows, else one code point, and notes for
every normalised byte the source bytes it stands for; dummy prefix, white-space collapsing and escaping
follow the model's settings. The library segments; its pieces tile the normalised text, so each piece's
normalised bytes project to a source span.

Defined cases: a null text is empty (its ids are the end id alone); invalid ids raise; repeated rows are
each encoded; an empty table gives no rows; whole texts are encoded whatever their length."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, LongType

from .common import bounded_batches

SPACE = "▁".encode()


class CharMap:
    """A compiled character map: 4 bytes of trie size, the trie's units, then replacements ended by NUL."""

    def __init__(self, blob: bytes):
        n = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{n // 4}I", blob, 4) if n else ()
        self.pool = blob[4 + n :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(source bytes, replacement) of the longest known prefix of data[at:], None if there is none."""
        units, found = self.units, None
        if not units:
            return None
        node = 0
        node ^= self.offset(units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & ((1 << 31) | 0xFF) != data[i]:
                break
            node ^= self.offset(unit)
            if unit >> 8 & 1:
                start = units[node] & ((1 << 31) - 1)
                found = i - at + 1, self.pool[start : self.pool.index(b"\0", start)]
        return found

    @staticmethod
    def offset(unit: int) -> int:
        return (unit >> 10) << ((unit & (1 << 9)) >> 6)


class Normalizer:
    def __init__(self, spec):
        self.map = CharMap(spec.precompiled_charsmap)
        self.prefix, self.collapse, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces

    def pieces(self, data: bytes) -> Iterator[tuple[bytes, int, int]]:
        """(replacement, source start, source end) in order."""
        at, n = 0, len(data)
        while at < n:
            if hit := self.map.longest(data, at):
                yield hit[1], at, at + hit[0]
                at += hit[0]
                continue
            lead = data[at]
            size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            yield data[at : at + size], at, at + size
            at += size

    def __call__(self, text: str) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and for each of them and one past the last, where its source starts."""
        data, space = text.encode(), SPACE if self.escape else b" "
        if not self.map.units and not self.collapse:  # code points stay; only blanks widen
            if not data:
                return b"", np.zeros(1, np.int64)
            times = np.where(np.frombuffer(data, np.uint8) == 32, len(space), 1)
            head = np.zeros(len(space) if self.prefix else 0, np.int64)
            align = np.concatenate([head, np.repeat(np.arange(len(data)), times), [len(data)]])
            return (space if self.prefix else b"") + data.replace(b" ", space), align
        parts = [(r, a, b) for r, a, b in self.pieces(data)]
        if self.collapse:
            while parts and parts[0][0] == b" ":
                parts.pop(0)
            while parts and parts[-1][0].rstrip(b" ") == b"":
                parts.pop()
        if not parts:
            return b"", np.zeros(1, np.int64)
        out, align = bytearray(), []
        if self.prefix:
            out += space
            align += [parts[0][1]] * len(space)
        blank = self.collapse
        for r, a, z in parts:
            same = r == data[a:z]  # a kept code point aligns byte by byte
            cut = len(r) - len(r.lstrip(b" ")) if blank and self.collapse else 0
            for i, c in enumerate(r[cut:], cut):
                x = space if c == 32 else bytes([c])
                out += x
                align += [a + i if same else a] * len(x)
            r = r[cut:]
            if r:
                blank = r.endswith(b" ")
        end = parts[-1][2]
        if self.collapse:
            while out.endswith(space):
                del out[-len(space) :], align[-len(space) :]
        return bytes(out), np.array([*align, end])


class Encoder:
    """A model, given as the bytes of its file."""

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        self.lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.normalize = Normalizer(proto.normalizer_spec)
        kinds = type(proto.pieces[0])
        self.unknown = self.lib.unk_id()
        self.decimal = [str(i) for i in range(len(proto.pieces))]
        # normalised bytes that a piece covers: byte pieces 1, control pieces none
        self.width = np.array([1 if p.type == kinds.BYTE else 0 if p.type in (kinds.CONTROL, kinds.UNKNOWN) else len(p.piece.encode()) for p in proto.pieces])

    def ids(self, text: str | None) -> np.ndarray:
        return self.lib.encode(text or "", add_eos=True, return_type="numpy")

    def joined(self, ids: np.ndarray) -> str:
        """Decimal ids, one space between."""
        return " ".join(map(self.decimal.__getitem__, ids.tolist()))

    def spans(self, text: str | None, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Source byte starts and stops of every id; the end id's span is empty and stands at the end.

        Where the model gives unknown pieces, their widths come from the library's own pieces."""
        normal, align = self.normalize(text or "")
        widths = self.width[ids]
        if (ids == self.unknown).any():
            names = self.lib.encode(text or "", out_type=str, add_eos=True)
            widths = np.array([len(s.encode()) if i == self.unknown else w for s, i, w in zip(names, ids, widths, strict=True)])
        ends = np.cumsum(widths)
        if ends[-1] != len(normal):
            raise ValueError(f"pieces cover {ends[-1]} of {len(normal)} normalised bytes")
        return align[ends - widths], align[ends]

    def decode(self, ids: np.ndarray | list[int]) -> str:
        return self.lib.decode(ids)


@lru_cache(maxsize=2)
def encoder(model: bytes) -> Encoder:
    """One per Python worker."""
    return Encoder(model)


def shipped(df: DataFrame, model_path: str) -> Broadcast:
    """The model's bytes (a few MB whatever the corpus), read by the driver: executors need not see the file."""
    with open(model_path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*parts, np.zeros(0, np.int32)]), kind))


def encode(documents: DataFrame, model_path: str) -> DataFrame:
    """documents' rows as (doc_id, ids, starts, stops): piece ids and their source byte spans."""
    bounded_batches(documents.sparkSession, 64)
    rows, model = documents.select("doc_id", "text"), shipped(documents, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(model.value)
        for b in batches:
            texts = [t.as_py() for t in b.column(1)]
            ids = [e.ids(t) for t in texts]
            spans = [e.spans(t, i) for t, i in zip(texts, ids, strict=True)]
            columns = [lists(ids, pa.int32()), lists([a for a, _ in spans], pa.int64()), lists([z for _, z in spans], pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["doc_id", "ids", "starts", "stops"])

    return rows.mapInArrow(run, rows.select("doc_id").schema.add("ids", ArrayType(IntegerType())).add("starts", ArrayType(LongType())).add("stops", ArrayType(LongType())))


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); null ids give null."""
    bounded_batches(encoded.sparkSession, 64)
    rows, model = encoded.select("doc_id", "ids"), shipped(encoded, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(model.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if i is None else e.decode(i) for i in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return rows.mapInArrow(run, rows.select("doc_id").schema.add("text", "string"))


def digests(documents: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, n_bytes, spans_sha256): what encode and decode give, as digests.

    Every text's pieces are projected to source spans, which must tile it: n_bytes sums their lengths, and
    spans_sha256 is the digest of all starts, then all stops, as little-endian 64-bit numbers."""
    bounded_batches(documents.sparkSession, 64)
    rows, model = documents.select("doc_id", "text"), shipped(documents, model_path)
    schema = rows.select("doc_id").schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string").add("n_bytes", "long").add("spans_sha256", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(model.value)
        for b in batches:
            n, a, d, covered, spans = [], [], [], [], []
            for t in b.column(1):
                text = t.as_py()
                ids = e.ids(text)
                n.append(len(ids))
                a.append(sha256(e.joined(ids).encode()).hexdigest())
                d.append(sha256(e.decode(ids).encode()).hexdigest())
                starts, stops = e.spans(text, ids)
                covered.append(int((stops - starts).sum()))
                spans.append(sha256(starts.astype("<i8").tobytes() + stops.astype("<i8").tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string()), pa.array(covered, pa.int64()), pa.array(spans, pa.string())], schema.names)

    return rows.mapInArrow(run, schema)
