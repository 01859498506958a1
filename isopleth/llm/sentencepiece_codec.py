"""SentencePiece encoding with offsets, and decoding (operator 5).

A model file carries a compiled character map: a double array of prefixes and the strings that they become. The
normaliser takes, again and again, the longest prefix that the map knows (or one character as it is) and notes,
for each byte that it writes, the source bytes it came from. Pieces are made from the normalised text, so each is a run
of normalised bytes, and the notes project it to a span of the original text: `begins` and `ends`, in UTF-8 bytes.

Byte-pair models with byte pieces are segmented from the normalised text: the pair of neighbours that makes the best-scored
piece is merged first, the leftmost of equal ones, until none is left; a character that is no piece becomes its bytes.
Where no piece of the model has a space mark behind another character, no merge crosses the place before a run of
marks; normalised texts are cut there, and a task segments each chunk that it meets once (the store is bounded).
Where the normaliser does no more than mark spaces, the sentencepiece library makes the merges of a chunk, which is
faster, else they are made here. Models of other kinds are segmented by the library, from the original text.

Defined cases: a null text counts as empty: begin and end ids only; texts of any length are encoded whole;
repeated rows are encoded alike; an empty table gives no rows; only the columns in `keep` are carried along, as they are,
and one that has the name of a result is replaced.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from array import array

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._base import small_batches, table, utf8, with_made

MARK = "▁"
_CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_MARK_BYTES = MARK.encode()


class CharsMap:
    """The compiled character map: longest-prefix search in its double array."""

    def __init__(self, blob: bytes):
        self.units: tuple[int, ...] = ()
        self.strings = b""
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
            self.strings = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes taken, what they become) of the longest known prefix of data[at:]."""
        units = self.units
        if not units:
            return None
        best, node = None, 0
        node ^= self._offset(units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                best = (i + 1 - at, units[node] & 0x7FFFFFFF)
        if best is None:
            return None
        taken, where = best
        return taken, self.strings[where : self.strings.index(b"\0", where)]

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def starts(self) -> set[int]:
        """Bytes with which a known prefix can start."""
        return {b for b in range(256) if self.units and (n := self._offset(self.units[0]) ^ b) < len(self.units) and self.units[n] & 0x800000FF == b}


class Normalizer:
    """Normalised bytes with, for each, the source span it came from."""

    def __init__(self, spec, user_symbols: tuple[str, ...] = (), suffix: bool = False):
        self.map = CharsMap(spec.precompiled_charsmap)
        self.starts = self.map.starts()
        self.dummy, self.squeeze, self.escape, self.suffix = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces, suffix
        self.user = sorted((s.encode() for s in user_symbols), key=len, reverse=True)

    def _next(self, data: bytes, at: int) -> tuple[int, bytes, bool]:
        """(bytes taken, output, whether the output is the source itself)."""
        for s in self.user:
            if data.startswith(s, at):
                return len(s), s, True
        if data[at] in self.starts and (found := self.map.longest(data, at)):
            return found[0], found[1], False
        lead = data[at]
        n = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return n, data[at : at + n], True

    def __call__(self, data: bytes, prefix: bool = True) -> tuple[bytes, np.ndarray, np.ndarray]:
        if not data:
            return b"", np.zeros(0, np.int32), np.zeros(0, np.int32)
        space = _MARK_BYTES if self.escape else b" "
        out, lo, hi = bytearray(), [], []

        def put(piece: bytes, begin: int, end: int, same: bool) -> None:
            for j, b in enumerate(piece):
                a, z = (begin + j, begin + j + 1) if same else (begin, end)
                if b == 0x20:
                    out.extend(space)
                    lo.extend([a] * len(space))
                    hi.extend([z] * len(space))
                else:
                    out.append(b)
                    lo.append(a)
                    hi.append(z)

        at, before_space = 0, self.squeeze
        if self.squeeze:
            while at < len(data):
                n, piece, _ = self._next(data, at)
                if piece != b" ":
                    break
                at += n
            if at == len(data):
                return b"", np.zeros(0, np.int32), np.zeros(0, np.int32)
        if self.dummy and prefix and not self.suffix:
            put(b" ", at, at, False)
        while at < len(data):
            n, piece, same = self._next(data, at)
            skip = 0
            while before_space and piece[skip : skip + 1] == b" ":
                skip += 1
            piece = piece[skip:]
            if piece:
                put(piece, at + (skip if same else 0), at + n, same)
                before_space = piece.endswith(b" ")
            at += n
            if not self.squeeze:
                before_space = False
        if self.squeeze:
            while out.endswith(space):
                del out[-len(space) :], lo[-len(space) :], hi[-len(space) :]
        if self.dummy and prefix and self.suffix:
            put(b" ", len(data), len(data), False)
        return bytes(out), np.array(lo, dtype=np.int32), np.array(hi, dtype=np.int32)


class Codec:
    """encode(text) gives ids and the spans of the original bytes; decode(ids) is the library's."""

    def __init__(self, model: bytes, chunk_chars: int = 48, most: int = 200_000):
        import sentencepiece as spm
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.sp = spm.SentencePieceProcessor(model_proto=model)
        proto = pb.ModelProto()
        proto.ParseFromString(model)
        kind, types = proto.trainer_spec, pb.ModelProto.SentencePiece
        self.user = sorted((p.piece for p in proto.pieces if p.type == types.USER_DEFINED), key=len, reverse=True)
        self.normalizer = Normalizer(proto.normalizer_spec, tuple(self.user), kind.treat_whitespace_as_suffix)
        self.lengths = np.array([1 if p.type == types.BYTE else len(p.piece.encode()) for p in proto.pieces], dtype=np.int64)
        self.unk, self.bos, self.eos = self.sp.unk_id(), self.sp.bos_id(), self.sp.eos_id()
        self.pieces = {p.piece: (-p.score, i) for i, p in enumerate(proto.pieces) if p.type in (types.NORMAL, types.USER_DEFINED)}
        self.bytes_ids = [i for i, p in enumerate(proto.pieces) if p.type == types.BYTE]
        self.own = kind.model_type == kind.BPE and len(self.bytes_ids) == 256 and not any(p.type == types.UNUSED for p in proto.pieces)
        self.cuts = not self.user and not any(MARK in p.piece.lstrip(MARK) for p in proto.pieces)
        norm = self.normalizer
        #: Without a map, and with nothing squeezed, the normaliser only turns spaces into marks, which needs no search.
        self.plain = norm.dummy and norm.escape and not norm.squeeze and not norm.suffix and not self.user and not norm.map.units
        self.chunk_chars, self.most = chunk_chars, most
        self.known: dict[str, bytes] = {}

    def _symbols(self, text: str) -> tuple[list[str], list[bool]]:
        """The characters, and the user's own symbols whole, which take no part in merges."""
        if not self.user:
            return list(text), [False] * len(text)
        out, fixed, at = [], [], 0
        while at < len(text):
            hit = next((u for u in self.user if text.startswith(u, at)), None)
            out.append(hit or text[at])
            fixed.append(hit is not None)
            at += len(out[-1])
        return out, fixed

    def _merged(self, text: str) -> bytes:
        """Ids of a run of normalised text, as bytes of unsigned 32-bit numbers."""
        sym, fixed = self._symbols(text)
        pieces, n = self.pieces, len(sym)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(left: int, right: int) -> None:
            if not (fixed[left] or fixed[right]):
                both = sym[left] + sym[right]
                hit = pieces.get(both)
                if hit:
                    heapq.heappush(heap, (hit[0], left, right, both))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, left, right, both = heapq.heappop(heap)
            if not sym[left] or not sym[right] or len(sym[left]) + len(sym[right]) != len(both):
                continue
            sym[left], sym[right] = both, ""
            nxt = after[left] = after[right]
            if nxt < n:
                before[nxt] = left
                offer(left, nxt)
            if before[left] >= 0:
                offer(before[left], left)
        ids: list[int] = []
        for s in sym:
            if s:
                hit = pieces.get(s)
                if hit:
                    ids.append(hit[1])
                else:
                    ids += [self.bytes_ids[b] for b in s.encode()]
        return array("I", ids).tobytes()

    def _segment(self, normal: str) -> bytes:
        """The ids of a normalised text, chunk by chunk where no merge can cross."""
        if not self.cuts:
            return self._merged(normal)
        known = self.known
        if len(known) > self.most:
            known.clear()
        chunks = _CHUNK.findall(normal)
        try:
            return b"".join(map(known.__getitem__, chunks))
        except KeyError:
            new = [c for c in set(chunks) if c not in known]
            made = {c: self._merged(c) for c in new if not self.plain or c == MARK}
            if self.plain:  # the library puts a mark before what it is given, and makes marks of spaces
                whole = [c for c in new if c != MARK]
                got = self.sp.encode([c[1:].replace(MARK, " ") for c in whole], num_threads=1)
                made.update((c, array("I", ids).tobytes()) for c, ids in zip(whole, got, strict=True))
            long = [c for c in made if len(c) > self.chunk_chars]
            known.update(made)
            out = b"".join(map(known.__getitem__, chunks))
            for c in long:  # rarely met again
                del known[c]
            return out

    def normalize(self, data: bytes) -> tuple[str, np.ndarray, np.ndarray]:
        """The normalised text; for each of its bytes where the source bytes it came from begin and end."""
        if not data:
            return "", np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not self.plain:
            out, lo, hi = self.normalizer(data)
            return out.decode(), lo, hi
        n = len(data)
        times = np.ones(n + 1, dtype=np.int64)
        times[0] = len(_MARK_BYTES)
        times[1:][np.frombuffer(data, dtype=np.uint8) == 0x20] = len(_MARK_BYTES)
        lo = np.repeat(np.arange(-1, n), times)
        hi = lo + 1
        lo[: len(_MARK_BYTES)] = 0
        return MARK + data.decode().replace(" ", MARK), lo, hi

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids with begin and end ids; begins and ends of each id in the text's bytes (empty spans for those two)."""
        data = utf8(text)
        normal, lo, hi = self.normalize(data)
        if self.own:
            body = np.frombuffer(self._segment(normal), dtype="<u4")
            sizes = self.lengths[body]
        else:
            got = self.sp.encode(data.decode(), out_type="immutable_proto").pieces if data else []
            body = np.array([p.id for p in got], dtype="<u4")
            sizes = np.array([self.lengths[p.id] if p.id != self.unk else len(p.piece.encode()) for p in got], dtype=np.int64)
        stops = np.cumsum(sizes)
        if (int(stops[-1]) if len(stops) else 0) != len(lo):
            raise ValueError("pieces and normalised text differ in length")
        ids = np.concatenate([[self.bos], body, [self.eos]]).astype("<u4")
        begins = np.concatenate([[0], lo[stops - sizes], [len(data)]]).astype(np.int64)
        ends = np.concatenate([[0], hi[stops - 1], [len(data)]]).astype(np.int64)
        return ids, begins, ends

    def decode(self, ids: np.ndarray) -> str:
        return self.sp.decode(ids.tolist())


def model_bytes(path: str | None = None) -> bytes:
    """The model file; by default the public 32k byte-fallback BPE."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


_KINDS = {"ids": "array<int>", "begins": "array<long>", "ends": "array<long>", "decoded": "string", "n_tokens": "long", "n_pieces_bytes": "long", "ids_sha256": "string", "decoded_sha256": "string"}


def encode(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), emit: tuple[str, ...] = ("ids", "begins", "ends"), model_path: str | None = None) -> DataFrame:
    """The columns in keep with those in emit: ids, begins, ends, decoded (the text from decode(ids)), n_tokens, n_pieces_bytes (source bytes that spans cover), ids_sha256, decoded_sha256."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model_bytes(model_path))  # one model file, of bounded size
    made = ", ".join(f"{c} {_KINDS[c]}" for c in emit)

    def start():
        codec = Codec(sent.value)

        def work(texts: list) -> list:
            rows = []
            for t in texts:
                ids, begins, ends = codec.encode(t)
                got: dict = {"ids": ids.astype(np.int32), "begins": begins, "ends": ends, "n_tokens": len(ids), "ids_sha256": hashlib.sha256(ids.tobytes()).hexdigest()}
                if "n_pieces_bytes" in emit:
                    got["n_pieces_bytes"] = int(np.maximum(0, ends - np.maximum(begins, np.concatenate([[0], ends[:-1]]))).sum())
                if "decoded" in emit or "decoded_sha256" in emit:
                    got["decoded"] = codec.decode(ids)
                    got["decoded_sha256"] = hashlib.sha256(got["decoded"].encode("utf-8", "replace")).hexdigest()
                rows.append([got[c] for c in emit])
            return list(zip(*rows, strict=True)) if rows else [[] for _ in emit]

        return work

    return with_made(docs, keep, [F.col(f"`{text}`")], made, start)


def op5_sentencepiece(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, emit=("n_tokens", "ids_sha256", "decoded_sha256", "n_pieces_bytes"))


QUERIES = {"op5_sentencepiece": op5_sentencepiece}
ORACLES: dict[str, str] = {}
