"""SentencePiece encoding and decoding with source alignment.

Encoding has two steps.  *Normalisation* walks the text with the model's
compiled character map (a double-array trie over UTF-8 followed by its
replacement strings): at each place the longest key is replaced, else one
character is kept; white space is trimmed or escaped and the leading mark is
added as the model asks.  Every output byte records the source byte that it
came from.  Where the map is empty and nothing is trimmed, the same result and
alignment are computed for all bytes at once.  *Segmentation* cuts the normalised text before each run of space
marks and around line feeds, where no piece of the vocabulary can reach across
(checked when the model is loaded; a model that fails the check gets whole
texts), and encodes each different segment once with the library.  Pieces are
projected through the alignment to spans of source bytes: a begin and an end
for each piece, without the begin and end ids.

Only a cache of segments is held between texts, at most ``CACHE`` entries of at
most ``LONGEST`` characters each; longer segments are encoded where they stand.

Edge cases: a null text encodes like an empty one (begin and end ids only);
repeated rows give a row each; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StringType, StructType

from blockwright.llm import _text
from blockwright.llm._session import quoted, ship

CACHE = 100_000
LONGEST = 64
MARK = "▁"
_SEGMENT = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")


class CharacterMap:
    """The compiled character map of a model; an empty one maps nothing."""

    def __init__(self, blob: bytes):
        self.units: array = array("I")
        self.strings = b""
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units.frombytes(blob[4 : 4 + size])
            self.strings = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """(source length, replacement) of the longest key at a place."""
        units, found = self.units, None
        if not units:
            return None
        unit = units[0]
        node = (unit >> 10) << ((unit & 0x200) >> 6)
        for i in range(at, len(text)):
            node ^= text[i]
            unit = units[node]
            if unit & 0x800000FF != text[i]:
                break
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if unit >> 8 & 1:
                found = i + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        end = self.strings.index(b"\0", found[1])
        return found[0], self.strings[found[1] : end]


class Codec:
    """A model, its normaliser and its segment cache."""

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        spec = proto.normalizer_spec
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.prefix, self.trim = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.escape = spec.escape_whitespaces
        self.suffix = proto.trainer_spec.treat_whitespace_as_suffix
        texts = [p.piece for p in proto.pieces if p.type in (1, 4)]
        apart = not any(re.search(f"[^{MARK}]{MARK}|\n", t) for t in texts) and not any(p.type == 4 for p in proto.pieces)
        #: Segments can be encoded alone, and normalisation keeps bytes as they are.
        self.cuts = apart and self.escape and not self.suffix and not self.trim and not self.map.units
        # The normaliser has run by then: this copy takes segments as they are.
        proto.normalizer_spec.ClearField("precompiled_charsmap")
        proto.normalizer_spec.name = "identity"
        proto.normalizer_spec.add_dummy_prefix = False
        proto.normalizer_spec.remove_extra_whitespaces = False
        self.plain = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.cache: dict[str, bytes] = {}
        #: Normalised bytes of each piece; 0: one character, whichever it is.
        self.sizes = np.array([1 if self.library.is_byte(i) else 0 if self.library.is_unknown(i) else len(self.library.id_to_piece(i).encode()) for i in range(self.library.get_piece_size())], dtype=np.int64)

    def normalise(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised UTF-8 and, for each of its bytes and its end, the source byte."""
        if self.map.units or self.trim or self.suffix:
            normal, source = self._walk(text)
            return normal, np.array(source, dtype=np.int64)
        space = MARK.encode() if self.escape else b" "
        data = np.frombuffer(text, dtype=np.uint8)
        lead = space if self.prefix and text else b""
        source = np.repeat(np.arange(data.size), np.where(data == 32, len(space), 1))
        return lead + text.replace(b" ", space), np.concatenate((np.zeros(len(lead), dtype=np.int64), source, [data.size]))

    def _walk(self, text: bytes) -> tuple[bytes, list[int]]:
        """The same for any model, place by place."""
        space = MARK.encode() if self.escape else b" "
        out, source, at = bytearray(), [], 0

        def put(piece: bytes, origin: int) -> None:
            out.extend(piece)
            source.extend([origin] * len(piece))

        chunks: list[tuple[int, int, bytes]] = []
        while at < len(text):
            if match := self.map.longest(text, at):
                length, piece = match
            else:
                lead = text[at]
                length = 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                piece = text[at : at + length]
            chunks.append((at, at + length, piece))
            at += length
        if self.trim:
            while chunks and not chunks[0][2].strip(b" "):
                chunks.pop(0)
            while chunks and not chunks[-1][2].strip(b" "):
                chunks.pop()
        if chunks and self.prefix and not self.suffix:
            put(space, chunks[0][0])
        previous = self.trim
        for start, _, piece in chunks:
            for i in range(len(piece)):
                byte = piece[i : i + 1]
                if byte == b" ":
                    if not (self.trim and previous):
                        put(space, start)
                    previous = True
                else:
                    put(byte, start + i if len(piece) == chunks_length(text, start) else start)
                    previous = False
        if chunks and self.prefix and self.suffix:
            put(space, chunks[-1][1])
        source.append(chunks[-1][1] if chunks else len(text))
        return bytes(out), source

    def segments(self, normal: str) -> list[str]:
        return _SEGMENT.findall(normal) if self.cuts else [normal] if normal else []

    def ids_of(self, normal: str) -> bytes:
        """Ids of a normalised text as little-endian unsigned 32-bit integers."""
        if not self.cuts:
            return array("I", self.plain.encode(normal)).tobytes() if normal else b""
        parts = _SEGMENT.findall(normal)
        cache = self.cache
        long = {s: array("I", self.plain.encode(s)).tobytes() for s in set(parts) if len(s) > LONGEST}
        missing = [s for s in set(parts) if s not in cache and s not in long]
        if missing:
            if len(cache) + len(missing) > CACHE:
                cache.clear()
                missing = [s for s in set(parts) if s not in long]
            self._fill(missing)
        return b"".join([long[s] if s in long else cache[s] for s in parts] if long else map(cache.__getitem__, parts))

    def _fill(self, missing: list[str]) -> None:
        """Encode segments in one call, parted by line feeds, which stay alone."""
        if not hasattr(self, "feed"):
            self.feed = array("I", self.plain.encode("\n"))
            self.feed = self.feed[0] if len(self.feed) == 1 else None
        if self.feed is None or len(missing) < 8:
            for s, ids in zip(missing, self.plain.encode(missing), strict=True):
                self.cache[s] = array("I", ids).tobytes()
            return
        own = [s for s in missing if s != "\n"]
        if len(own) < len(missing):
            self.cache["\n"] = array("I", [self.feed]).tobytes()
        ids = array("I", self.plain.encode("\n".join(own)))
        start = 0
        for s in own:
            try:
                end = ids.index(self.feed, start)
            except ValueError:
                end = len(ids)
            self.cache[s] = ids[start:end].tobytes()
            start = end + 1

    def aligned(self, text: str) -> tuple[bytes, np.ndarray]:
        """All ids, with begin and end, packed; and for each piece between
        those the first and the end byte in the source text."""
        normal, source = self.normalise(text.encode())
        inner = self.ids_of(normal.decode())
        size = self.sizes[np.frombuffer(inner, dtype=np.uint32)]
        end = np.cumsum(size)
        if not size.all():  # unknown pieces: as long as the character that stands there
            at = 0
            for k, n in enumerate(size.tolist()):
                at += n or chunks_length(normal, at)
                end[k] = at
        edge = source[np.concatenate(([0], end))]
        packed = struct.pack("<I", self.library.bos_id()) + inner + struct.pack("<I", self.library.eos_id())
        return packed, np.stack((edge[:-1], edge[1:]), axis=1)

    def encode(self, text: str) -> bytes:
        """All ids, with begin and end, packed."""
        return self.aligned(text)[0]

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(id, first byte, end byte) of each piece in the source text."""
        packed, spans = self.aligned(text)
        ids = np.frombuffer(packed, dtype=np.uint32)[1:-1].tolist()
        return [(i, first, end) for i, (first, end) in zip(ids, spans.tolist(), strict=True)]

    def decode(self, packed: bytes) -> str:
        ids = array("I")
        ids.frombytes(packed)
        return self.library.decode(ids.tolist())


def chunks_length(text: bytes, at: int) -> int:
    lead = text[at]
    return 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4


@functools.lru_cache(maxsize=2)
def _codec(model: bytes) -> Codec:
    return Codec(model)


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_digests(docs: DataFrame, model_path: str, with_ids: bool = False) -> DataFrame:
    """Number and digest of the ids, digest of the decoded text and digest of the
    source spans, per document; on request the packed ids and spans too.  Spans
    are packed as little-endian signed 32-bit begin and end of each piece."""
    model = ship(docs.sparkSession).sparkContext.broadcast(read_model(model_path))
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("spans_sha256", pa.string())])
    if with_ids:
        schema = schema.append(pa.field("ids", pa.binary())).append(pa.field("spans", pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model.value)
        for batch in _text.small(batches):
            counts, ids, decoded, aligned, all_packed, all_spans = [], [], [], [], [], []
            for text in batch.column("text"):
                packed, spans = codec.aligned(text.as_py() or "")
                spans = spans.astype("<i4").tobytes()
                counts.append(len(packed) // 4)
                if with_ids:
                    all_packed.append(packed)
                    all_spans.append(spans)
                ids.append(hashlib.sha256(packed).hexdigest())
                decoded.append(hashlib.sha256(codec.decode(packed).encode()).hexdigest())
                aligned.append(hashlib.sha256(spans).hexdigest())
            columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), *(pa.array(c, pa.string()) for c in (ids, decoded, aligned))]
            yield pa.record_batch(columns + [pa.array(all_packed, pa.binary()), pa.array(all_spans, pa.binary())] * with_ids, schema=schema)

    return docs.select("doc_id", "text").mapInArrow(_text.frees(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string" + ", ids binary, spans binary" * with_ids)


def encode_documents(docs: DataFrame, model_path: str, keep: list[str], spans: bool = False) -> DataFrame:
    """The columns ``keep`` plus ``ids`` (packed) and, on request, source ``spans``."""
    model = ship(docs.sparkSession).sparkContext.broadcast(read_model(model_path))
    schema = docs.select([quoted(k) for k in keep]).schema.add("ids", BinaryType())
    if spans:
        schema = schema.add("spans", ArrayType(StructType().add("id", IntegerType()).add("first", IntegerType()).add("end", IntegerType())))
    carried = [quoted(k) for k in dict.fromkeys([*keep, "text"])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model.value)
        kind = pa.list_(pa.struct([("id", pa.int32()), ("first", pa.int32()), ("end", pa.int32())]))
        for batch in _text.small(batches):
            texts = [t.as_py() or "" for t in batch.column("text")]
            columns = [batch.column(k) for k in keep] + [pa.array([codec.encode(t) for t in texts], pa.binary())]
            names = [*keep, "ids"]
            if spans:
                columns.append(pa.array([[{"id": i, "first": a, "end": b} for i, a, b in codec.spans(t)] for t in texts], kind))
                names.append("spans")
            yield pa.record_batch(columns, names=names)

    return docs.select(carried).mapInArrow(_text.frees(run), schema)


def decode_documents(encoded: DataFrame, model_path: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` plus the decoded ``text`` of packed ``ids``."""
    model = ship(encoded.sparkSession).sparkContext.broadcast(read_model(model_path))
    schema = encoded.select([quoted(k) for k in keep]).schema.add("text", StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model.value)
        for batch in _text.small(batches):
            texts = [codec.decode(i.as_py() or b"") for i in batch.column("ids")]
            yield pa.record_batch([*(batch.column(k) for k in keep), pa.array(texts, pa.string())], names=[*keep, "text"])

    return encoded.select(*map(quoted, keep), "ids").mapInArrow(_text.frees(run), schema)
