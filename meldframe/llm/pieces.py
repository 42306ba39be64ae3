"""SentencePiece encoding that knows where each piece comes from, and decoding.

The normaliser is our own: the longest prefix found in the model's compiled character map (a double-array trie of UTF-8 bytes)
is replaced, and the source bytes of each normalised byte are recorded. The normalised text falls into chunks, each a run of
word marks and what follows it; no piece of the vocabulary crosses a chunk's edge (this is verified on loading), so chunks are
segmented by the library once per distinct chunk. A model with other pieces is segmented a text at a time. Either way the pieces tile the
normalised text, and the normaliser's record of origins projects each to its bytes of the source.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded

MARK = "\u2581"


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = varint() if kind == 2 else 8 if kind == 1 else 4
            yield tag >> 3, data[at : at + n]
            at += n


class CharacterMap:
    """The compiled map: uint32 size of the trie in bytes, the trie's units, then the zero-ended replacements."""

    def __init__(self, blob: bytes = b"") -> None:
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4) if blob else ()
        self.texts = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[bytes, int]:
        """Replacement of the longest key at this place and that key's length; without one, a character as it is."""
        found, length = -1, 0
        if self.units:
            step = lambda unit: (unit >> 10) << ((unit & 0x200) >> 6)
            node = step(self.units[0])
            for i in range(at, len(data)):
                node ^= data[i]
                unit = self.units[node]
                if unit & 0x800000FF != data[i]:
                    break
                node ^= step(unit)
                if unit & 0x100:
                    found, length = self.units[node] & 0x7FFFFFFF, i + 1 - at
        if length:
            return self.texts[found : self.texts.index(b"\0", found)], length
        n = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
        return data[at : at + n], n


class Normalizer:
    """Normalised bytes and, for each of them and their end, the source byte they come from."""

    def __init__(self, blob: bytes = b"", prefix: bool = True, squeeze: bool = True, escape: bool = True) -> None:
        self.map, self.prefix, self.squeeze, self.escape = CharacterMap(blob), prefix, squeeze, escape
        #: Nothing but the mark for spaces, one before the text.
        self.plain = not blob and prefix and not squeeze and escape

    def __call__(self, text: str) -> tuple[bytes, np.ndarray]:
        if self.plain and MARK not in text:
            return self._plain(text)
        data, out, origin = text.encode("utf-8", "surrogatepass"), bytearray(), []
        space = MARK.encode() if self.escape else b" "
        at = 0
        if self.squeeze:
            while at < len(data):
                to, n = self.map.longest(data, at)
                if to != b" ":
                    break
                at += n
        if at == len(data):
            return b"", np.array([at])
        if self.prefix:
            out += space
            origin += [at] * len(space)
        spaced = self.squeeze
        while at < len(data):
            to, n = self.map.longest(data, at)
            while spaced and to.startswith(b" "):
                to = to[1:]
            if to:
                to_out = to.replace(b" ", space)
                out += to_out
                origin += range(at, at + n) if to_out == data[at : at + n] else [at] * len(to_out)
                spaced = self.squeeze and to.endswith(b" ")
            at += n
        if self.squeeze:
            while out.endswith(space):
                del out[-len(space) :]
                at = origin[len(out)]
                del origin[len(out) :]
        return bytes(out), np.array([*origin, at])

    def _plain(self, text: str) -> tuple[bytes, np.ndarray]:
        """The same without a map: no key is a prefix of anything, so that each character is its own, and spaces are marks."""
        if not text:
            return b"", np.zeros(1, np.int64)
        data = np.frombuffer(f" {text}".encode("utf-8", "surrogatepass"), np.uint8)
        times = np.where(data == 32, len(MARK.encode()), 1)
        return f" {text}".replace(" ", MARK).encode("utf-8", "surrogatepass"), np.append(np.maximum(np.repeat(np.arange(len(data)) - 1, times), 0), len(data) - 1)


class Codec:
    """One model: encode() gives ids and byte spans in the source, decode() the text of ids."""

    def __init__(self, path: str, cached: int = 200_000) -> None:
        import sentencepiece

        with open(path, "rb") as f:
            model = f.read()
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        spec = {3: 1, 4: 1, 5: 1, 2: b""} | next((dict(_fields(v)) for k, v in _fields(model) if k == 3), {})
        self.normalize = Normalizer(spec[2], bool(spec[3]), bool(spec[4]), bool(spec[5]))
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        byte = [self.sp.is_byte(i) for i in range(len(pieces))]
        #: Bytes of a piece in the normalised text.
        self.width = np.array([1 if b else len(p.encode()) for p, b in zip(pieces, byte, strict=True)], np.int64)
        plain = [p for i, p in enumerate(pieces) if not byte[i] and not self.sp.is_control(i) and not self.sp.is_unknown(i)]
        self.chunked = self.normalize.plain and all(MARK not in p.lstrip(MARK) for p in plain) and all(byte[self.sp.piece_to_id(f"<0x{b:02X}>")] for b in range(256))
        self.eos, self.mark = self.sp.eos_id(), self.sp.piece_to_id(MARK)
        self.cache: dict[str, np.ndarray] = {}
        self.cached = cached

    _CHUNK = re.compile(" +[^ ]*")

    def _chunks(self, parts: list[list[str]]) -> None:
        """Segments those chunks that are not known yet."""
        new = {c for p in parts for c in p if c not in self.cache}
        if len(self.cache) + len(new) > self.cached:
            self.cache = {}
            new = {c for p in parts for c in p}
        chunks = list(new)
        for c, ids in zip(chunks, self.sp.encode([c[1:] for c in chunks], num_threads=1), strict=True):
            self.cache[c] = np.array(ids if c != " " else [self.mark], np.int32)

    def encode(self, texts: list[str | None], eos: bool = True) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per text ids, starts and ends (bytes of the source). Nulls are empty; the end id stands at the end of the text."""
        whole = ["" if t is None else t for t in texts]
        parts = [self._CHUNK.findall(" " + t) if self.chunked and t and MARK not in t else [] for t in whole]
        if self.chunked:
            self._chunks(parts)
        out = []
        for t, p in zip(whole, parts, strict=True):
            n = len(t.encode("utf-8", "surrogatepass"))
            if p:
                ids = np.concatenate([self.cache[c] for c in p])
                origin = self.normalize(t)[1]
                end = origin[np.cumsum(self.width[ids])]
                start = np.concatenate([[0], end[:-1]])
            else:
                ids, start, end = self._whole(t)
            if eos:
                ids, start, end = np.append(ids, self.eos), np.append(start, n), np.append(end, n)
            out.append((ids.astype(np.int32), np.maximum(start, 0).astype(np.int32), np.maximum(end, 0).astype(np.int32)))
        return out

    def _whole(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids = np.array(self.sp.encode(text), np.int64)
        norm, origin = self.normalize(text)
        surface = np.where(ids == self.sp.unk_id(), 0, self.width[ids]) if len(ids) else np.zeros(0, np.int64)
        for i in np.flatnonzero(ids == self.sp.unk_id()) if len(ids) else ():  # an unknown run spans what the others leave
            at = int(surface[:i].sum())
            follow = next((self.sp.id_to_piece(int(j)).encode() for j in ids[i + 1 :] if j != self.sp.unk_id()), None)
            to = norm.find(follow, at + 1) if follow else len(norm)
            surface[i] = (to if to > 0 else len(norm)) - at
        end = np.minimum(np.cumsum(surface), len(norm))
        start = np.concatenate([[0], end[:-1]]).astype(np.int64)[: len(ids)]
        return ids, origin[start] if len(ids) else start, origin[end] if len(ids) else end

    def decode(self, ids: np.ndarray) -> str:
        return self.sp.decode(ids.tolist())


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


SPANS = "doc_id long, ids array<int>, starts array<int>, ends array<int>"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
SPAN_DIGESTS = f"{DIGESTS}, spans_sha256 string, tiled boolean"


def encoded(rows: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[pa.RecordBatch, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]]:
    """Each batch (with a column text) and the encodings of its texts."""
    c = codec(path)
    for batch in bounded(rows):
        yield batch, c.encode(batch.column("text").to_pylist())


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32)))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, ids with an end id, and each id's byte span in the text's UTF-8.

    Null and empty texts give the end id alone. Texts are taken whole; repeated rows are encoded each; ids may be null;
    other columns are ignored; no rows give no rows.
    """
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(
        lambda it: (pa.RecordBatch.from_arrays([b.column("doc_id"), *(_lists([e[j] for e in es]) for j in range(3))], names=["doc_id", "ids", "starts", "ends"]) for b, es in encoded(it, path)), SPANS
    )


def digests(docs: DataFrame, path: str, aligned: bool = False) -> DataFrame:
    """Per row of docs: doc_id, the number and digest of its encoded ids, and the digest of the text decoded from them; if aligned, also that of the ids' source
    spans (starts, then ends, as little-endian 32-bit integers), and whether the spans in a row are the whole source. Odd rows as encode() has them."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for batch, es in encoded(rows, path):
            ids = [e[0].tolist() for e in es]
            back = codec(path).sp.decode(ids) if ids else []
            columns = [batch.column("doc_id"), pa.array([len(i) for i in ids], pa.int64()), pa.array([sha(" ".join(map(str, i))) for i in ids], pa.string()), pa.array([sha(b) for b in back], pa.string())]
            if not aligned:
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in DIGESTS.split(", ")])
                continue
            spans = [hashlib.sha256(s.astype("<i4").tobytes() + e.astype("<i4").tobytes()).hexdigest() for _, s, e in es]
            sizes = [0 if t is None else len(t.encode("utf-8", "surrogatepass")) for t in batch.column("text").to_pylist()]
            tiled = [bool(s[0] == 0 and e[-1] == n and (s[1:] == e[:-1]).all()) for (_, s, e), n in zip(es, sizes, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, pa.string()), pa.array(tiled, pa.bool_())], names=[x.split()[0] for x in SPAN_DIGESTS.split(", ")])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, SPAN_DIGESTS if aligned else DIGESTS)
