"""SentencePiece merge models: reading the model file, exact encoding by backtracking, decoding."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MEMO = 300_000  # entries a worker's memo tables may hold before the later ones are dropped
LASTING = 100_000  # entries that stay: what comes first is what comes often
MEMO_CHARS = 48  # longer chunks are encoded without being remembered
ROWS_OUT = 256  # rows of one Arrow batch on the way out


def shorten(memo: dict) -> None:
    """Drop all but the first ``LASTING`` entries of a full table."""
    if len(memo) >= MEMO:
        for key in list(islice(memo, LASTING, None)):
            del memo[key]


def model_bytes(spark: SparkSession, path: str) -> bytes:
    """The model file through Spark's reader, so any path that Spark can open will do."""
    path = path if "://" in path else f"file://{path}"
    return bytes(spark.read.format("binaryFile").load(path).first()["content"])


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of one protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            if byte < 0x80:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}[kind] if kind != 2 else varint()
        yield key >> 3, data[at : at + size]
        at += size


class PieceModel:
    """Pieces, ranks and settings of a merge-type model file.

    Only merge models with the identity normaliser and kept white space are read; any other is refused, since its
    encodings would not be exact.
    """

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        trainer: dict[int, int | bytes] = {}
        normaliser: dict[int, int | bytes] = {}
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode("utf-8"))
                scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normaliser = dict(_fields(value))
        if trainer.get(3, 1) != 2:
            raise ValueError("not a merge-type model")
        if normaliser.get(1, b"identity") != b"identity" or normaliser.get(2) or normaliser.get(4, 1):
            raise ValueError("only the identity normaliser with kept white space is exact here")
        self.dummy_prefix = bool(normaliser.get(3, 1))
        self.byte_fallback = bool(trainer.get(35, 0))
        if USER_DEFINED in self.kinds or UNUSED in self.kinds:
            raise ValueError("user-defined and unused pieces are not supported")
        self.unknown_surface = trainer.get(44, " ⁇ ".encode()).decode()
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] == NORMAL}
        places = {score: place for place, score in enumerate(sorted({scores[i] for i in self.ids.values()}, reverse=True))}
        #: Lower merges first; pieces of one score share a rank, and then the leftmost pair merges.
        self.rank = [places[scores[i]] if self.kinds[i] == NORMAL else len(places) for i in range(len(self.pieces))]
        self.unknown = self.kinds.index(UNKNOWN)
        self.control = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] == CONTROL}
        self.begin, self.end = self.control.get("<s>"), self.control.get("</s>")
        self.bytes = [self.pieces.index(f"<0x{b:02X}>") for b in range(256)] if self.byte_fallback else []
        self.byte_of = {i: b for b, i in enumerate(self.bytes)}
        self.sizes = [len(p) for p in self.pieces]
        self.back = [n - 1 for n in self.sizes]  # from the last character of a piece to its first
        #: What each piece reads as; None for bytes, which are read together.
        self.spellings = [p.replace(SPACE, " ") if k == NORMAL else "" for p, k in zip(self.pieces, self.kinds)]
        self.spellings[self.kinds.index(UNKNOWN)] = self.unknown_surface
        for i in self.bytes:
            self.spellings[i] = None
        spelt = [bytes([self.byte_of[i]]) if t is None else t.encode("utf-8") for i, t in enumerate(self.spellings)]
        #: The same in UTF-8, and after all pieces each once more as the first of a text, without the prefix's space.
        opens = [self.dummy_prefix and p.startswith(SPACE) and k != CONTROL for p, k in zip(self.pieces, self.kinds)]
        self.written = pa.array(spelt + [t[1:] if o else t for t, o in zip(spelt, opens)], pa.large_binary())
        self.is_control, self.is_byte = np.array(self.kinds) == CONTROL, np.array(self.kinds) == BYTE
        self.known = frozenset(p for p in self.ids if len(p) == 1)
        #: No piece runs over the start of a word, so words are encoded on their own.
        self.splits_words = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids)
        #: The longest piece that is a proper prefix of a piece.
        self.shorter = [-1] * len(self.pieces)
        for p, i in self.ids.items():
            self.shorter[i] = next((self.ids[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in self.ids), -1)
        self.matcher = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.matcher.add_word(p, i)
        self.matcher.make_automaton()
        self._fit: dict[int, bool] = {}

    def merge(self, text: str) -> list[str]:
        """Plain merging: always the best-ranked pair, the leftmost of equals. For short texts."""
        parts, ids, rank = list(text), self.ids, self.rank
        while True:
            best, at = len(self.ids) + 1, -1
            for i in range(len(parts) - 1):
                made = ids.get(parts[i] + parts[i + 1])
                if made is not None and rank[made] < best:
                    best, at = rank[made], i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def fits(self, left: int, right: int) -> bool:
        """Whether two pieces can stand side by side: merging their joined text gives them back.

        ``left`` -1 is the start of a segment.
        """
        key = left * len(self.pieces) + right
        found = self._fit.get(key)
        if found is None:
            shorten(self._fit)
            a, b = self.pieces[left] if left >= 0 else "", self.pieces[right]
            found = self._fit[key] = self.merge(a + b) == ([a, b] if a else [b])
        return found

    def segment(self, text: str) -> list[int]:
        """Pieces of a text of known characters: longest match first, going back where no piece fits.

        ``failed`` has a bit for every position from which no valid rest was reached with a fitting piece before it.
        """
        size, sizes, fits, shorter, first = len(text), self.sizes, self.fits, self.shorter, self.back
        known_fit, width, left = self._fit.get, len(self.pieces), -1
        longest = [0] * size
        for end, i in self.matcher.iter(text):
            longest[end - first[i]] = i  # ends rise, so the last one kept is the longest
        made: list[int] = []
        failed, marked, at, token = bytearray(size // 8 + 1), False, 0, longest[0]
        while at < size:
            end = at + sizes[token]
            if not (marked and failed[end >> 3] >> (end & 7) & 1) and (
                fits(left, token) if (fit := known_fit(left * width + token)) is None else fit
            ):
                made.append(token)
                at, left = end, token
                if at < size:
                    token = longest[at]
                continue
            token = shorter[token]
            while token < 0:
                failed[at >> 3] |= 1 << (at & 7)
                marked = True
                back = made.pop()
                left = made[-1] if made else -1
                at -= sizes[back]
                token = shorter[back]
        return made

    def chunk(self, text: str, spelt: dict[str, list[int]] | None = None) -> list[int]:
        """Pieces of one chunk, unknown characters as bytes (or one unknown id for a run of them).

        ``spelt`` remembers the bytes' ids of short runs.
        """
        if self.known.issuperset(text):
            return self.segment(text)
        strange = set(text) - self.known
        made: list[int] = []
        for part in re.split(f"([{re.escape(''.join(strange))}]+)", text):
            if not part:
                continue
            if part[0] not in strange:
                made += self.segment(part)
            elif self.byte_fallback:
                ids = spelt.get(part) if spelt is not None else None
                if ids is None:
                    ids = [self.bytes[b] for b in part.encode("utf-8")]
                    if spelt is not None and len(part) <= MEMO_CHARS:
                        shorten(spelt)
                        spelt[part] = ids
                made += ids
            else:
                made.append(self.unknown)
        return made

    def chunks(self, text: str) -> list[str]:
        """The text with marked spaces, cut before every word (an empty text has none)."""
        if not text:
            return []
        marked = (SPACE if self.dummy_prefix else "") + text.replace(" ", SPACE)
        if not self.splits_words:
            return [marked]
        return re.findall(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", marked)

    def decode(self, ids: Iterable[int]) -> str:
        """Text of ids: pieces with spaces restored, runs of bytes as UTF-8, controls left out.

        A byte that is no part of a character becomes U+FFFD, as in the model's own library.
        """
        ids = list(ids)
        text = self._spell(ids)
        first = next((self.pieces[i] for i in ids if self.kinds[i] != CONTROL), "")
        return text[1:] if self.dummy_prefix and first.startswith(SPACE) else text

    def decode_rows(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """``decode`` of many rows at once; row ``n`` has the ids from ``ends[n]`` to ``ends[n + 1]``.

        Every id is looked up, and what the ids of a row write is that row's text.
        """
        shown = np.flatnonzero(~self.is_control[ids])
        byte = self.is_byte[ids[shown]]
        if not (byte[:-1] & byte[1:] & (np.diff(shown) > 1)).any():  # no control stands between two bytes
            first = np.append(shown, len(ids))[np.searchsorted(shown, ends[:-1])]
            which = ids.astype(np.int64)
            which[first[first < ends[1:]]] += len(self.pieces)
            written = self.written.take(pa.array(which))
            _, places, data = written.buffers()
            places = np.frombuffer(places, np.int64, len(ids) + 1, written.offset * 8)[ends]
            texts = pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(places), data)
            try:
                texts.validate(full=True)
                return texts.cast(pa.string())
            except pa.ArrowInvalid:  # bytes that are no characters
                pass
        return pa.array([self.decode(ids[a:b].tolist()) for a, b in zip(ends, ends[1:])], pa.string())

    def _spell(self, ids: Iterable[int]) -> str:
        spelt = [self.spellings[i] for i in ids]
        if None not in spelt:
            return "".join(spelt)
        out: list[str] = []
        run = bytearray()
        for i, text in zip(ids, spelt):
            if text is None:
                run.append(self.byte_of[i])
                continue
            out.append(_utf8(bytes(run)) + text)
            run.clear()
        return "".join(out) + _utf8(bytes(run))


def _utf8(data: bytes) -> str:
    """Characters of a byte run; every byte outside a valid character is one U+FFFD."""
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(data):
            for size in (1, 2, 3, 4):
                try:
                    out.append(data[at : at + size].decode("utf-8"))
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                size = 1
            at += size
        return "".join(out)


class Encoder(dict):
    """Chunk -> ids, filled as chunks are met. ``spelt`` has the bytes' ids of runs of unknown characters."""

    def __init__(self, model: PieceModel):
        super().__init__()
        self.model = model
        self.spelt: dict[str, list[int]] = {}
        self._ints = list(range(len(model.pieces))).__getitem__  # one object for each id, however often it is stored

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        ids = tuple(map(self._ints, self.model.chunk(chunk, self.spelt)))
        if len(chunk) <= MEMO_CHARS:
            self[chunk] = ids
        return ids

    def ids(self, text: str) -> list[int]:
        """Ids of a whole text."""
        shorten(self)
        return list(chain.from_iterable(map(self.__getitem__, self.model.chunks(text))))

    def encode(self, text: str) -> tuple[list[int], str]:
        """Ids of a whole text, and the text that they decode to."""
        ids = self.ids(text)
        return ids, self.model.decode(ids)


_models: dict[int, PieceModel] = {}
_encoders: dict[int, Encoder] = {}


def model_of(data: bytes) -> PieceModel:
    """The parsed model, once per Python worker."""
    key = hash(data)
    if key not in _models:
        _models[key] = PieceModel(data)
    return _models[key]


def encoder_of(data: bytes) -> Encoder:
    key = hash(data)
    if key not in _encoders:
        _encoders[key] = Encoder(model_of(data))
    return _encoders[key]


def encode_pieces(
    df: DataFrame,
    model: str,
    text: str = "text",
    ids: str = "ids",
    decoded: str = "decoded",
    begin_id: bool = False,
    end_id: bool = True,
) -> DataFrame:
    """Add ``ids`` (array of int) and ``decoded`` (what the ids decode to) for every row; no shuffle.

    Exact for merge-type models: Aho-Corasick finds the longest piece at each position, a piece is taken if merging
    it with its left neighbour gives the two back, and positions that led nowhere are marked so that none is tried
    twice. ``decoded`` is read back from the ids alone, without the text. Work is linear in the text; a task holds one
    batch and memo tables of bounded size.

    A null or empty text has no ids but the begin and end ids asked for and decodes to ''. All other columns stay;
    columns already named ``ids`` or ``decoded`` are replaced. Rows keep their number and repeats.
    """
    spark = df.sparkSession
    data = spark.sparkContext.broadcast(model_bytes(spark, model))
    kept = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in (ids.lower(), decoded.lower())])
    source = text if text in kept.columns else "__text"
    if source == "__text":
        kept = kept.withColumn("__text", df[text])
    schema = T.StructType([f for f in kept.schema if f.name != "__text"])
    schema = schema.add(ids, T.ArrayType(T.IntegerType(), False), False).add(decoded, T.StringType(), False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(data.value)
        first = [encoder.model.begin] if begin_id else []
        last = [encoder.model.end] if end_id else []
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS_OUT):
                batch = whole.slice(start, ROWS_OUT)
                flat, ends = [], [0]
                for value in batch.column(source).to_pylist():
                    flat.append(np.array(first + encoder.ids(value or "") + last, dtype=np.int32))
                    ends.append(ends[-1] + len(flat[-1]))
                made, ends = np.concatenate(flat), np.array(ends, dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(made))
                columns = [batch.column(c) for c in schema.names[:-2]]
                yield pa.RecordBatch.from_arrays([*columns, lists, encoder.model.decode_rows(made, ends)], schema.names)

    return kept.mapInArrow(run, schema)
