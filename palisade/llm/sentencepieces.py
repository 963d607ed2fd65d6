"""SentencePiece encoding that keeps source offsets, and decoding.

Normalisation walks the compiled character map of the model file by longest prefix
and records, for each normalised byte, where its source begins and ends; so every
piece of the library's encoding is projected to a span of the original bytes. The
ids are the library's own. Text is encoded a unit at a time (a run of spaces with
what follows it), each unit once a worker, where no piece of the vocabulary can reach
over the start of a unit; a model for which that does not hold is given whole texts.

Defined results: a null text is empty and gives the begin and end ids alone; rows
are encoded each on its own; other columns are ignored; an empty table stays empty.
"""

from __future__ import annotations

import re
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import text_of
from palisade.llm.encode import slices

SPACE_MARK = "▁"
#: Units that a worker keeps (about 260 bytes each) before it starts again.
KEPT_UNITS = 500_000
#: Field numbers of the model file's messages.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
CHARACTER_MAP, DUMMY_PREFIX, REMOVE_SPACES, ESCAPE_SPACES = 2, 3, 4, 5
SUFFIX_SPACES = 24
BYTE_PIECE = 6


def fields(message: bytes):
    """(number, value) of a serialised message: integers, or bytes for all else."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        n = {1: 8, 5: 4}.get(key & 7)
        n = varint() if n is None else n
        yield key >> 3, message[at : at + n]
        at += n


class CharacterMap:
    """The compiled character map: a double array trie over UTF-8, then the
    replacements, each ended by a zero byte."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.texts = blob[4 + size :] if blob else b""
        #: The bytes that mapped strings begin with: all others are left as they are.
        self.heads = frozenset(b for b in range(256) if self.units and self._child(self._offset(self.units[0]), b) is not None)

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def _child(self, node: int, byte: int) -> int | None:
        """The place of the unit that byte leads to, if it does."""
        place = node ^ byte
        return place if place < len(self.units) and self.units[place] & 0x800000FF == byte else None

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """What replaces the longest mapped prefix of data[at:], and its length."""
        if not self.units:
            return None
        node, found = self._offset(self.units[0]), None
        for end in range(at, len(data)):
            place = self._child(node, data[end])
            if place is None:
                break
            unit = self.units[place]
            node = place ^ self._offset(unit)
            if unit & 0x100:
                found = self.units[node] & 0x7FFFFFFF, end + 1 - at
        if found is None:
            return None
        return self.texts[found[0] : self.texts.index(b"\0", found[0])], found[1]


class Model:
    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        with open(path, "rb") as file:
            message = file.read()
        self.library = SentencePieceProcessor(model_file=path)
        self.is_byte, pieces, normalizer, trainer = [], [], {}, {}
        for number, value in fields(message):
            if number == PIECES:
                piece = dict(fields(value))
                pieces.append(piece[1].decode())
                self.is_byte.append(piece.get(3) == BYTE_PIECE)
            elif number == NORMALIZER:
                normalizer |= dict(fields(value))
            elif number == TRAINER:
                trainer |= dict(fields(value))
        self.lengths = [len(p.encode()) for p in pieces]
        self.map = CharacterMap(normalizer.get(CHARACTER_MAP, b""))
        self.prefix = bool(normalizer.get(DUMMY_PREFIX, 1))
        self.remove, self.escape = bool(normalizer.get(REMOVE_SPACES, 1)), bool(normalizer.get(ESCAPE_SPACES, 1))
        suffix = bool(trainer.get(SUFFIX_SPACES, 0))
        joined = any(re.search(f"[^{SPACE_MARK}]{SPACE_MARK}", p) for p in pieces)
        #: Whether units can be encoded apart: then a unit's first space is the dummy prefix.
        self.by_unit = self.prefix and self.escape and not (self.remove or suffix or joined or self.map.units)
        if suffix:
            raise ValueError("models that mark spaces as suffixes are not supported")

    def normalise(self, text: str) -> tuple[bytes, list[int], list[int]]:
        """Normalised bytes with, for each, the first byte of its source and the byte after it."""
        data, mark = text.encode(), SPACE_MARK.encode() if self.escape else b" "
        if not self.remove and self.map.heads.isdisjoint(data):
            return self._unmapped(text, data, mark)
        out, begins, ends = bytearray(), [], []

        def put(new: bytes, begin: int, end: int) -> None:
            out.extend(new)
            begins.extend([begin] * len(new))
            ends.extend([end] * len(new))

        def mapped(at: int) -> tuple[bytes, int]:
            found = self.map.longest(data, at) if data[at] in self.map.heads else None
            n = _width(data[at])
            return found or (data[at : at + n], n)

        at, spaced, started = 0, self.remove, False
        while at < len(data):
            new, n = mapped(at)
            if not started and not (self.remove and new == b" "):
                # The dummy prefix stands before the first character that is no space, even one that goes.
                started = True
                if self.prefix:
                    put(mark, at, at)
            if started:
                kept = new.lstrip(b" ") if spaced else new
                put(kept.replace(b" ", mark), at, at + n)
                if kept:
                    spaced = self.remove and kept.endswith(b" ")
            at += n
        if self.remove:
            while out.endswith(mark) and out:
                del out[-len(mark) :], begins[-len(mark) :], ends[-len(mark) :]
        return bytes(out), begins, ends

    def _unmapped(self, text: str, data: bytes, mark: bytes) -> tuple[bytes, list[int], list[int]]:
        """normalise() where the map has nothing for the text: only spaces change."""
        head = len(mark) if self.prefix and data else 0
        begins, ends = [0] * head, [0] * head
        if text.isascii() and " " not in text:
            return mark[:head] + data, begins + list(range(len(data))), ends + list(range(1, len(data) + 1))
        at = 0
        while at < len(data):
            n = _width(data[at])
            size = len(mark) if data[at] == 32 else n
            begins += [at] * size
            ends += [at + n] * size
            at += n
        return mark[:head] + data.replace(b" ", mark), begins, ends

    def spans(self, text: str, ids: list[int]) -> tuple[list[int], list[int]]:
        """The begin and the end of each piece in the bytes of text."""
        unknown = self.library.unk_id()
        normal, begins, ends = self.normalise(text)
        first, last, at = [], [], 0
        for i, k in enumerate(ids):
            if self.is_byte[k]:
                n = 1
            elif k == unknown:
                # One unknown piece stands for what lies before the next known one.
                rest = self.library.id_to_piece(ids[i + 1]).encode() if i + 1 < len(ids) else None
                n = (normal.index(rest, at + 1) if rest else len(normal)) - at
            else:
                n = self.lengths[k]
            first.append(begins[at])
            last.append(ends[at + n - 1])
            at += n
        return first, last


def _width(lead: int) -> int:
    """Bytes of the character that begins with this one."""
    return 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4


_MARKED = re.compile(" *[^ ]+(?: +\\Z)?| +")


class OffsetEncoder:
    """ids, begins and ends of whole texts, each as little-endian unsigned 32-bit integers."""

    def __init__(self, model: Model, kept: int = KEPT_UNITS):
        self.model, self.kept = model, kept
        self._forget()

    def _forget(self) -> None:
        """Units are numbered; pools hold their pieces, one unit after the other."""
        self.number: dict[str, int] = {}
        self.counts, self.sizes, self.offsets = (np.empty(0, np.int64) for _ in range(3))
        self.pools = [np.empty(0, "<u4") for _ in range(3)]

    def _units(self, text: str) -> list[str]:
        """The texts that the library is given; the space that a later unit starts with is its dummy prefix."""
        if not self.model.by_unit or SPACE_MARK in text:
            return [text]
        first, *rest = _MARKED.findall(text) or [""]
        return [first, *(unit[1:] for unit in rest)]

    def _learn(self, units: list[str]) -> None:
        encoded = self.model.library.encode(units, num_threads=1)
        spans = [self.model.spans(u, ids) for u, ids in zip(units, encoded)]
        counts = np.fromiter(map(len, encoded), np.int64, len(units))
        sizes = np.fromiter((len(u.encode()) for u in units), np.int64, len(units))
        self.number.update(zip(units, range(len(self.counts), len(self.counts) + len(units))))
        self.offsets = np.concatenate([self.offsets, len(self.pools[0]) + np.cumsum(counts) - counts])
        self.counts, self.sizes = np.concatenate([self.counts, counts]), np.concatenate([self.sizes, sizes])
        for k, lists in enumerate((encoded, *zip(*spans))):
            flat = np.fromiter((x for one in lists for x in one), "<u4", counts.sum())
            self.pools[k] = np.concatenate([self.pools[k], flat])

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes, bytes]]:
        split = [self._units(t) for t in texts]
        if len(self.number) > self.kept:
            self._forget()
        if new := list(set().union(*split).difference(self.number)):
            self._learn(new)
        n_units = np.fromiter(map(len, split), np.int64, len(split))
        units = np.fromiter((k for one in split for k in map(self.number.__getitem__, one)), np.int64, n_units.sum())
        heads = np.cumsum(n_units) - n_units  # each text's first unit
        later = np.ones(len(units), np.int64)
        later[heads] = 0
        # A later unit lies one byte, its space, behind the one before it.
        ends_at = np.cumsum(self.sizes[units] + later)
        begins_at = ends_at - self.sizes[units]
        begins_at -= np.repeat(begins_at[heads], n_units)
        counts = self.counts[units]
        place = np.cumsum(counts) - counts
        pick = np.repeat(self.offsets[units] - place, counts) + np.arange(counts.sum())
        ids, first, last = (pool[pick] for pool in self.pools)
        shift = np.repeat(begins_at, counts).astype("<u4")
        first, last = first + shift, last + shift
        first[place[later == 1]] -= 1  # the first piece of a later unit begins at its space
        cuts = [*place[heads].tolist(), len(ids)]
        bos, eos = self.model.library.bos_id(), self.model.library.eos_id()
        wrap = lambda a, x, b: np.concatenate([[a], x, [b]]).astype("<u4").tobytes()
        out = []
        for text, a, b in zip(texts, cuts, cuts[1:]):
            size = len(text.encode())
            out.append((wrap(bos, ids[a:b], eos), wrap(0, first[a:b], size), wrap(0, last[a:b], size)))
        return out


@lru_cache(maxsize=1)
def offset_encoder(model_path: str) -> OffsetEncoder:
    """Kept for all tasks of a worker."""
    return OffsetEncoder(Model(model_path))


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids with begin and end ids, and the byte span (begins, ends) of every id,
    each as little-endian unsigned 32-bit integers."""

    def run(batches):
        encoder = offset_encoder(model_path)
        for batch in batches:
            at = 0
            for texts in slices(batch.column(1).to_pylist()):
                ids, begins, ends = zip(*encoder.encode(texts))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), *(pa.array(x, pa.binary()) for x in (ids, begins, ends))],
                    names=["doc_id", "ids", "begins", "ends"],
                )
                at += len(texts)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary, begins binary, ends binary")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """encoded with the library's decoded text of its ids as column decoded."""
    from pyspark.sql.types import StringType, StructField, StructType

    schema = StructType([*(f for f in encoded.schema.fields if f.name != "decoded"), StructField("decoded", StringType())])

    def run(batches):
        from sentencepiece import SentencePieceProcessor

        library = SentencePieceProcessor(model_file=model_path)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("ids"))
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lists = [np.frombuffer(x, "<u4").tolist() for x in ids.slice(at, 256).to_pylist()]
                texts = library.decode(lists, num_threads=1)
                columns = [part.column(part.schema.get_field_index(f.name)) for f in schema.fields[:-1]]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())], names=schema.names)

    return encoded.mapInArrow(run, schema)
