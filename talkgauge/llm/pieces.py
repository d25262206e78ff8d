"""Encode and decode texts with a sentencepiece BPE model, without its library.

A text is cut where no piece reaches across: before each run of spaces and around line breaks.  The
distinct parts of a batch are encoded together by the table of last tokens (``bpe.Merges``), and ids
are recovered backwards.  Spaces before a part that no piece joins to it follow the model's pieces of
spaces only; these share one score, so the leftmost pair is joined first.

Defined results: a null or empty text has no ids and decodes to the empty text; repeated rows are
answered one by one; other columns stay, but a result column replaces one of its name.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from talkgauge.llm import bpe
from talkgauge.llm.frames import fresh, without
from talkgauge.llm.text import batches, column_bytes, gather, word_hashes

_SPACE, _MARK = 0x20, "▁"
_BATCH = 4 << 20


def _fields(data: bytes) -> list[tuple[int, int | bytes]]:
    """The fields of one protocol buffer message: (number, varint or bytes)."""
    out, i = [], 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            b = data[i]
            i += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while i < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            out.append((key >> 3, varint()))
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            out.append((key >> 3, data[i : i + size]))
            i += size
    return out


@dataclass
class PieceModel:
    """What encoding needs of a model file: a BPE model with byte fallback and no normalisation."""

    pieces: list[str]
    merges: bpe.Merges
    bytes_from: int
    runs: list[list[int]] = field(default_factory=list)  # ids of 0 to 31 spaces in a row
    longest_run: int = 1

    @classmethod
    def load(cls, path: str) -> PieceModel:
        """Read a model file; its own form, a few fields of one message, is public."""
        with open(path, "rb") as file:
            message = _fields(file.read())
        pieces, scores, kinds = [], [], []
        for number, value in message:
            if number == 1:
                parts = dict(_fields(value))
                pieces.append(parts[1].decode())
                scores.append(float(np.frombuffer(parts.get(2, b"\0\0\0\0"), "<f4")[0]))
                kinds.append(parts.get(3, 1))
        plain = [i for i, kind in enumerate(kinds) if kind == 1]
        spaces = {len(pieces[i]): i for i in plain if set(pieces[i]) == {_MARK}}
        tokens = {
            i: tuple(_SPACE if c == _MARK else ord(c) for c in pieces[i])
            for i in plain
            if i == spaces.get(1) or set(pieces[i]) != {_MARK}
        }
        by_rank = sorted((i for i in tokens if len(tokens[i]) > 1), key=lambda i: -scores[i])
        model = cls(pieces, bpe.Merges(tokens, bpe.all_splits(tokens, by_rank)), kinds.index(6))
        model.longest_run = max(spaces, default=1)
        model.runs = [_space_run(n, spaces) for n in range(2 * model.longest_run)]
        return model

    def run(self, n: int) -> list[int]:
        """Ids of n spaces in a row: runs of the longest piece, then the rest."""
        full, rest = divmod(n, self.longest_run)
        return self.runs[self.longest_run] * full + self.runs[rest]

    def encode_parts(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts in a row and their n + 1 offsets; a part is spaces, then other characters."""
        n_spaces = _leading(data == _SPACE, at)
        words = at[1:] > at[:-1] + n_spaces
        keep = np.where(words, np.minimum(n_spaces, 1), 0)  # the last space may join the word
        body, body_at = gather(data, np.where(words, at[:-1] + n_spaces - keep, at[1:]), at[1:])
        points = np.frombuffer(body.tobytes().decode().encode("utf-32-le"), dtype="<u4").astype(np.int64)
        heads = np.concatenate(([0], np.cumsum((body & 0xC0) != 0x80)))
        points_at = heads[body_at]
        ids, ends = self.merges.encode(points, points_at)
        bounds = np.searchsorted(ends, points_at)
        low, high = bounds[:-1], bounds[1:]
        alone = self.runs[1][0]
        first = np.append(ids, -1)[low]
        odd = (low == high) | (n_spaces > 1) | ((n_spaces == 1) & (first == alone))
        odd[np.searchsorted(bounds, np.flatnonzero(ids < 0), side="right") - 1] = True
        rebuilt = {}
        for k in np.flatnonzero(odd).tolist():
            own = [t for j in range(low[k], high[k]) for t in self._or_bytes(int(ids[j]), int(points[ends[j]]))]
            spaces = int(n_spaces[k])
            if not own or (spaces and own[0] == alone):
                own = self.run(spaces) + own[1:]
            elif spaces > 1:
                own = self.run(spaces - 1) + own
            rebuilt[k] = own
        sizes = high - low
        for k, own in rebuilt.items():
            sizes[k] = len(own)
        out_at = np.concatenate(([0], np.cumsum(sizes)))
        out = np.empty(out_at[-1], dtype=np.int64)
        plain = np.flatnonzero(~odd)
        out[np.repeat(~odd, sizes)] = gather(ids, low[plain], high[plain])[0]
        for k, own in rebuilt.items():
            out[out_at[k] : out_at[k + 1]] = own
        return out, out_at

    def _or_bytes(self, token: int, point: int) -> list[int]:
        return [token] if token >= 0 else [self.bytes_from + b for b in chr(point).encode()]

    def piece_bytes(self) -> list[bytes]:
        """The bytes that each id stands for."""
        span = range(self.bytes_from, self.bytes_from + 256)
        return [bytes([i - span[0]]) if i in span else p.replace(_MARK, " ").encode() for i, p in enumerate(self.pieces)]


def _leading(inside: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many spaces each part begins with."""
    stops = np.flatnonzero(np.concatenate((~inside, [True])))
    first = stops[np.searchsorted(stops, at[:-1])]
    return np.minimum(first, at[1:]) - at[:-1]


def _space_run(n: int, spaces: dict[int, int]) -> list[int]:
    """Ids of n spaces: the leftmost pair whose joint length is a piece is joined until none is left."""
    sizes = [1] * n
    while (k := next((k for k in range(len(sizes) - 1) if sizes[k] + sizes[k + 1] in spaces), None)) is not None:
        sizes[k : k + 2] = [sizes[k] + sizes[k + 1]]
    return [spaces[s] for s in sizes]


def encode_texts(model: PieceModel, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of prepared texts: ids of the distinct parts and their offsets, part numbers and the texts' offsets."""
    data, at = column_bytes(texts)
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, np.zeros(1, np.int64), none, np.zeros(len(at), np.int64)
    space, line = data == _SPACE, data == 0x0A
    cut = np.ones(len(data) + 1, dtype=bool)
    cut[1:-1] = (space[1:] & ~space[:-1]) | line[1:] | line[:-1]
    cut[at] = True
    cuts = np.flatnonzero(cut)
    starts, ends = cuts[:-1], cuts[1:]
    _, first, part = np.unique(word_hashes(data, starts, ends, fold=False), return_index=True, return_inverse=True)
    ids, ids_at = model.encode_parts(*gather(data, starts[first], ends[first]))
    return ids, ids_at, part, np.searchsorted(starts, at)


class _Spelling:
    """Byte strings of ids, looked up for many ids at once."""

    def __init__(self, values: list[bytes]):
        self.data = np.frombuffer(b"".join(values), dtype=np.uint8)
        self.at = np.concatenate(([0], np.cumsum([len(v) for v in values])))

    def of(self, ids: np.ndarray, ids_at: np.ndarray) -> list[bytes]:
        flat, at = gather(self.data, self.at[ids], self.at[ids + 1])
        whole, cuts = flat.tobytes(), at[ids_at].tolist()
        return [whole[a:b] for a, b in zip(cuts, cuts[1:])]


def encode_pieces(docs: DataFrame, model_path: str, text: str = "text", with_ids: bool = False, with_text: bool = True) -> DataFrame:
    """Add ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``, and ``ids`` if asked for.

    ``ids_sha256`` is of the decimal ids joined by commas, ``decoded_sha256`` of the decoded text.
    The model's tables are bounded by its vocabulary and broadcast; the file is read on the driver.
    """
    added = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    if with_ids:
        added.add("ids", T.ArrayType(T.IntegerType()))
    value = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    # the model writes a space before every text and keeps its own sign for spaces as a space
    prepared = F.when(value == "", "").otherwise(F.concat(F.lit(" "), F.replace(value, F.lit(_MARK), F.lit(" "))))
    (ready,) = fresh([*docs.columns, *added.names], "_prepared")
    source = docs.withColumn(ready, prepared)
    source = without(source, added.names if with_text else [*added.names, text])
    shared = docs.sparkSession.sparkContext.broadcast(PieceModel.load(model_path))
    schema = T.StructType([f for f in source.schema.fields if f.name != ready] + added.fields)

    def run(arrivals):
        model = shared.value
        letters = _Spelling(model.piece_bytes())
        numbers = _Spelling([b"%d," % i for i in range(len(model.pieces))])
        for rows in batches(arrivals, ready, _BATCH):
            ids, ids_at, parts, at = encode_texts(model, rows[ready])
            shown, spelled, sizes = numbers.of(ids, ids_at), letters.of(ids, ids_at), np.diff(ids_at)
            totals = np.concatenate(([0], np.cumsum(sizes[parts])))
            counts, shas, backs, lists = totals[at[1:]] - totals[at[:-1]], [], [], []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                own = parts[a:b].tolist()
                shas.append(hashlib.sha256(b"".join([shown[k] for k in own])[:-1]).hexdigest())
                backs.append(hashlib.sha256(b"".join([spelled[k] for k in own])[1:]).hexdigest())
                if with_ids:
                    lists.append(gather(ids, ids_at[parts[a:b]], ids_at[parts[a:b] + 1])[0].astype(np.int32))
            columns = [pa.array(counts, pa.int64()), pa.array(shas, pa.string()), pa.array(backs, pa.string())]
            if with_ids:
                columns.append(pa.array(lists, pa.list_(pa.int32())))
            kept = rows.drop_columns([ready])
            for name, column in zip(added.names, columns):
                kept = kept.append_column(name, column)
            yield from kept.combine_chunks().to_batches()

    return source.mapInArrow(run, schema)


def decode_ids(model: PieceModel, ids: list[int]) -> str:
    """The text of a list of ids: pieces joined, bytes joined to characters, the first space dropped."""
    letters = model.piece_bytes()
    text = b"".join(letters[i] for i in ids).decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text
