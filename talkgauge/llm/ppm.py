"""Language-model scores: prediction by partial matching over bytes, and a word model as base line.

The byte model is a trie of contexts of up to ``ORDER`` bytes, with counts from all learning texts.  It has
every run of bytes that occurs in them, unless ``SHARE`` asks for a least share of all bytes; then the counts of
dropped runs are added to escapes.  A byte is coded in the longest context that the trie has.  Escapes are
estimated by method D; a context reached by an escape leaves out the bytes that the context before offered.
Texts begin behind the sign 255, which UTF-8 never uses, and end with it, so that the probabilities of all texts
sum to 1.

Counts of words and of byte runs are summed in Spark.  They are dealt to parts by their hash or code, and
what a task has counted travels as one row per part, not per word.  The commonest words, at most ``COMMON``, are
broadcast; the others meet their counts part by part, where they are summed per text.  A trie of few runs
is broadcast as it is.  Otherwise every run of ORDER + 1 bytes of any text, learnt or not, gets its probability
where the part of the trie that it asks lies: runs are dealt by the last ``LOW`` bytes before their last one, which
all longer contexts share; runs of at most ``LOW`` bytes are known everywhere.  The commonest probabilities, at most
``COMMON_RUNS``, are broadcast, the others met like the rarer words.

Defined results: a null or empty text is its end only; rows of equal id and text are answered as often as
they occur; without learning texts the base score is 0 and every byte has probability 1/256.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from talkgauge.llm.bpe import IntMap
from talkgauge.llm.frames import held_out, stored
from talkgauge.llm.text import LOWER, SPACED_BYTES, batches, column_bytes, texts_words

ORDER = 6
SHARE = 0.0
COMMON = 1 << 18
COMMON_RUNS = 1 << 20
TRIE_RUNS = 1 << 17  # different runs of ORDER + 1 bytes up to which the whole trie is broadcast
LOW = 3
_END = 255
_LONG = 8 * (ORDER + 1)
_BATCH = 1 << 18
_SCORED = 1 << 18  # bytes of text scored at once
_HELD = 1 << 21  # codes that a task sums before it passes them on
_SENT = 1 << 17  # sums in a batch of rows
_PART = 1 << 18  # logarithms in a part, about
_SPREAD = 1_000_003  # prime; what codes leave modulo this is dealt to parts
_PIECE = 1 << 17
_CHUNK = 1 << 16  # runs whose part of the trie is built at once, or one group, if larger
_ROOT = 0


def _mask(length: int) -> int:
    return (1 << 8 * length) - 1


def byte_runs(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The run of ORDER + 1 bytes that ends at each byte and at the end of each text, and their offsets."""
    n = len(at) - 1
    framed = np.full(len(data) + n * (ORDER + 1), _END, dtype=np.uint8)
    shift = np.repeat(np.arange(n) * (ORDER + 1) + ORDER, np.diff(at))
    framed[np.arange(len(data)) + shift] = LOWER[data]
    code = np.zeros(len(framed) - ORDER if n else 0, dtype=np.uint64)
    for k in range(ORDER + 1):
        code = code << np.uint64(8) | framed[k : k + len(code)]
    ends = at + np.arange(n + 1)
    keep = np.ones(len(code), dtype=bool)
    behind = at[1:-1] + np.arange(n - 1) * (ORDER + 1) + 1 if n > 1 else np.zeros(0, np.int64)
    keep[behind[:, None] + np.arange(ORDER)] = False  # runs that reach into the next text
    return code[keep], ends


@dataclass
class ByteModel:
    """Logarithms of a trained trie, by context."""

    runs: IntMap  # length and bytes of a run to its number
    contexts: IntMap
    log_count: np.ndarray
    total: np.ndarray  # of a context reached first
    escape: np.ndarray
    total_after: np.ndarray  # of the context one byte shorter than this one, reached by its escape
    escape_after: np.ndarray
    rest: float

    @classmethod
    def of(cls, length: np.ndarray, code: np.ndarray, count: np.ndarray, texts: int) -> ByteModel:
        """From the kept runs, of 1 to ORDER + 1 bytes, and the number of texts."""
        runs = IntMap(length << _LONG | code, np.arange(len(code)))
        inner = (length <= ORDER) & ((code & 255) != _END)
        starts = np.arange(1, ORDER + 1)
        own_length = np.concatenate(([0], starts, length[inner]))
        own_code = np.concatenate(([0], [_mask(k) for k in starts], code[inner])).astype(np.int64)
        every = count[length == 1].sum() if len(count) else 0
        seen = np.concatenate(([every], np.full(ORDER, texts), count[inner])).astype(float)
        contexts = IntMap(own_length << _LONG | own_code, np.arange(len(own_code)))
        home = contexts.get((length - 1) << _LONG | code >> 8)
        known = home >= 0
        n = len(own_code)
        kinds = np.bincount(home[known], minlength=n).astype(float)
        offered = np.bincount(home[known], weights=count[known], minlength=n)
        seen = np.maximum(seen, offered)
        # what a context's bytes count in the context one byte shorter
        shorter_run = runs.get((length - 1) << _LONG | code & ((1 << 8 * (length - 1)) - 1))
        linked = known & (length > 1)
        barred = np.bincount(home[linked], weights=count[shorter_run[linked]], minlength=n)
        up = np.full(n, _ROOT)
        deep = own_length > 0
        up[deep] = contexts.get((own_length[deep] - 1) << _LONG | own_code[deep] & ((1 << 8 * (own_length[deep] - 1)) - 1))
        up = np.maximum(up, _ROOT)
        dropped = seen - offered
        left = np.maximum(offered[up] - barred, 0)
        fresh = np.maximum(kinds[up] - kinds, 0)
        with np.errstate(divide="ignore"):
            total = 2 * seen
            after = 2 * (left + dropped[up])
            escape = np.where(total > 0, (kinds + 2 * dropped) / np.maximum(total, 1), 1)
            escape_after = np.where(after > 0, (fresh + 2 * dropped[up]) / np.maximum(after, 1), 1)
            return cls(
                runs, contexts, np.log10(np.maximum(2 * np.append(count, 1).astype(float) - 1, 1)), np.log10(np.maximum(total, 1)), np.log10(escape),
                np.log10(np.maximum(after, 1)), np.log10(escape_after), -np.log10(max(1, 256 - kinds[_ROOT]) if kinds[_ROOT] < 256 else 256),
            )

    def log_probability(self, codes: np.ndarray) -> np.ndarray:
        """Log10 of each last byte's probability behind the bytes before it."""
        codes = codes.astype(np.int64)
        context, out = codes >> 8, np.zeros(len(codes))
        before = np.full(len(codes), -1)
        live = np.arange(len(codes))
        for k in range(ORDER, -1, -1):
            own = context[live] & _mask(k)
            here = self.contexts.get(k << _LONG | own)
            run = self.runs.get((k + 1) << _LONG | codes[live] & _mask(k + 1))
            prior = before[live]
            reached = (here >= 0) | (prior >= 0)
            first = prior < 0
            hit = reached & (run >= 0)
            total = np.where(first, self.total[here], self.total_after[prior])
            escape = np.where(first, self.escape[here], self.escape_after[prior])
            out[live] += np.where(hit, self.log_count[run] - total, np.where(reached, escape, 0))
            before[live] = np.where(reached, here, prior)
            live = live[~hit]
        out[live] += self.rest
        return out


class Scorer:
    """Sums a model's logarithms over texts, with a table of recent answers."""

    def __init__(self, model: ByteModel):
        self.model = model
        self.keys = np.full(1 << 20, np.uint64(1 << 63), dtype=np.uint64)
        self.values = np.zeros(1 << 20)

    def score(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at) - 1)
        codes, ends = byte_runs(data, at)
        for a in range(0, len(codes), _PIECE):
            part = codes[a : a + _PIECE]
            slot = ((part * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)
            hit = self.keys[slot] == part
            value = self.values[slot]
            fresh, back = np.unique(part[~hit], return_inverse=True)
            if len(fresh):
                answer = self.model.log_probability(fresh)
                value[~hit] = answer[back]
                place = ((fresh * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)
                self.keys[place] = fresh  # of several for one slot the last one stays
                won = self.keys[place] == fresh
                self.values[place[won]] = answer[won]
            total = np.concatenate(([0.0], np.cumsum(value)))
            i, j = np.searchsorted(ends, a, side="right") - 1, np.searchsorted(ends, a + len(part))
            low, high = np.clip(ends[i:j] - a, 0, len(part)), np.clip(ends[i + 1 : j + 1] - a, 0, len(part))
            out[i:j] += total[high] - total[low]
        return out


@dataclass
class Answers:
    """Logarithms of the commonest runs of ORDER + 1 bytes."""

    runs: IntMap
    log: np.ndarray

    def score(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text the sum over its common runs; the text and the code of every other run."""
        out, texts, rare = np.zeros(len(at) - 1), [], []
        codes, ends = byte_runs(data, at)
        for a in range(0, len(codes), _PIECE):
            part = codes[a : a + _PIECE]
            text = np.searchsorted(ends, np.arange(a, a + len(part)), side="right") - 1
            place = self.runs.get(part.astype(np.int64))
            common = place >= 0
            out += np.bincount(text[common], weights=self.log[place[common]], minlength=len(out))
            texts.append(text[~common])
            rare.append(part[~common])
        return out, np.concatenate([np.zeros(0, np.int64), *texts]), np.concatenate([np.zeros(0, np.uint64), *rare])


def _totals(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different codes and the sums of their counts."""
    order = np.argsort(codes)
    codes, counts = codes[order], counts[order]
    heads = np.flatnonzero(np.concatenate((np.ones(min(1, len(codes)), bool), codes[1:] != codes[:-1])))
    return codes[heads], np.add.reduceat(counts, heads) if len(heads) else counts[:0]


def local_model(low: tuple[np.ndarray, np.ndarray, np.ndarray], codes: np.ndarray, counts: np.ndarray, texts: int, least: float) -> ByteModel:
    """The part of the trie that ``codes`` ask: runs of ORDER + 1 bytes, all with the same LOW bytes before the last one
    or none.  ``low`` holds length, code and count of the kept runs of at most LOW bytes."""
    lengths, runs, sums = ([x] for x in low)
    learnt = counts > 0
    codes, counts = codes[learnt], counts[learnt]
    inner = (codes >> 8 & 255) != _END  # contexts that are runs; their counts are those of all that follows them
    for length in range(LOW + 1, ORDER + 2):
        found = [_totals(codes & _mask(length), counts)]
        if length <= ORDER:
            found.append(_totals(codes[inner] >> 8 & _mask(length), counts[inner]))
        for run, n in found:
            kept = n >= least
            lengths.append(np.full(kept.sum(), length))
            runs.append(run[kept])
            sums.append(n[kept])
    length, run, n = (np.concatenate(x) for x in (lengths, runs, sums))
    _, first = np.unique(length << _LONG | run, return_index=True)
    return ByteModel.of(length[first], run[first], n[first], texts)


def _answered(counts: DataFrame, low: tuple[np.ndarray, np.ndarray, np.ndarray], texts: int, least: float) -> DataFrame:
    """The logarithm (value) of every run (code, n) of ORDER + 1 bytes."""
    shared = counts.sparkSession.sparkContext.broadcast(low)

    def answers(codes: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        model = local_model(shared.value, codes, n, texts, least)
        value = [model.log_probability(codes[a : a + _PIECE]) for a in range(0, len(codes), _PIECE)]
        return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n), pa.array(np.concatenate(value))], ["code", "n", "value"])

    def run(arrivals):
        held, size = [], 0
        for batch in arrivals:
            held.append([batch.column(c).to_numpy(zero_copy_only=False) for c in ("code", "n")])
            size += batch.num_rows
            if size >= _CHUNK:
                codes, n = (np.concatenate(x) for x in zip(*held))
                group = codes >> 8 & _mask(LOW)
                whole = int(np.searchsorted(group, group[-1]))  # the last group may go on
                if whole:
                    yield answers(codes[:whole], n[:whole])
                held, size = [[codes[whole:], n[whole:]]], 0
        if held:
            codes, n = (np.concatenate(x) for x in zip(*held))
            if len(codes):
                yield answers(codes, n)

    group = F.shiftright("code", 8).bitwiseAND(F.lit(_mask(LOW)))
    dealt = counts.select("code", "n").repartition(group).sortWithinPartitions(group)
    return stored(dealt.mapInArrow(run, "code bigint, n bigint, value double"), "lm-answers")


class _Sums:
    """Counts of codes, summed in a task while they are few."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, values: np.ndarray, weight: int = 1) -> None:
        if len(values):
            values = np.sort(values)
            heads = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
            self.put(values[heads], weight * np.diff(np.append(heads, len(values))))

    def put(self, codes: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((codes, counts))
        self.size += len(codes)

    def full(self) -> bool:
        """Whether there are too many codes even after those that are equal are summed."""
        if self.size > _HELD:
            self._sum()
        return 2 * self.size > _HELD

    def _sum(self) -> None:
        if len(self.parts) > 1:
            codes, counts = (np.concatenate(x) for x in zip(*self.parts))
            self.parts = []
            self.parts = [_totals(codes, counts)]
        self.size = sum(len(c) for c, _ in self.parts)

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        self._sum()
        codes, counts = self.parts[0] if self.parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.parts, self.size = [], 0
        return codes.view(np.int64), counts


def _parts(codes: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The part of each code in ascending order, and the order; codes of a part stay in their order."""
    part = (codes.view(np.int64) % _SPREAD % parts).astype(np.min_scalar_type(parts))
    order = np.argsort(part, kind="stable")
    return part[order].astype(np.int32), order


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where any of the columns begins a new value."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in columns])
    return np.flatnonzero(new)


def _lists(at: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values))


_DEALT = "kind tinyint, part int, codes array<bigint>, few array<tinyint>, many array<bigint>"


def _dealt(kind: int, codes: np.ndarray, counts: np.ndarray, parts: int):
    """A row for each part that has codes, and one for those that have codes with counts above 127."""
    for name, own, width in (("few", counts < 128, np.int8), ("many", counts >= 128, np.int64)):
        if own.any():
            part, order = _parts(codes[own], parts)
            heads = _starts(part)
            at = np.append(heads, len(part))
            columns = {name: _lists(at, counts[own].astype(width)[order])}
            columns = [columns.get(c, pa.nulls(len(heads), pa.list_(t))) for c, t in (("few", pa.int8()), ("many", pa.int64()))]
            kinds = pa.array(np.full(len(heads), kind, dtype=np.int8))
            yield pa.RecordBatch.from_arrays([kinds, pa.array(part[heads]), _lists(at, codes[own][order]), *columns], ["kind", "part", "codes", "few", "many"])


def _added(arrivals):
    """Sums over the rows of parts that a task gets; a code comes more than once if there are too many to hold."""

    def sent(kind: int, sums: _Sums):
        codes, counts = sums.take()
        for a in range(0, len(codes), _SENT):
            some = codes[a : a + _SENT]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), kind, dtype=np.int8)), pa.array(some), pa.array(counts[a : a + _SENT])], ["kind", "code", "n"])

    held: dict[int, _Sums] = {}
    for batch in arrivals:
        for kind in batch.column("kind").unique().to_pylist():
            rows = batch.filter(pc.equal(batch.column("kind"), kind))
            sums = held.setdefault(kind, _Sums())
            for name in "few", "many":
                own = rows.filter(rows.column(name).is_valid())
                if len(own):
                    codes, counts = (own.column(c).flatten().to_numpy() for c in ("codes", name))
                    sums.put(codes, counts.astype(np.int64))
            if sums.full():
                yield from sent(kind, sums)
    for kind, sums in held.items():
        yield from sent(kind, sums)


def _counted(rows: DataFrame) -> DataFrame:
    """Counts of word hashes (kind 0), byte runs (1), texts (2) and words (3) of the learning texts.

    Byte runs of the other texts come, too, and add nothing to the counts.
    """
    parts = _shuffled(rows)

    def run(arrivals):
        held = {0: _Sums(), 1: _Sums()}
        texts = words_seen = 0
        for whole in batches(arrivals, "text", _BATCH):
            part, other = whole.filter(whole["learnt"]), whole.filter(pc.invert(whole["learnt"]))
            words, at = texts_words(part["text"], SPACED_BYTES)
            texts, words_seen = texts + len(at) - 1, words_seen + len(words)
            held[0].add(words)
            held[1].add(byte_runs(*column_bytes(part["text"]))[0])
            held[1].add(byte_runs(*column_bytes(other["text"]))[0], weight=0)
            for kind, sums in held.items():
                if sums.full():
                    yield from _dealt(kind, *sums.take(), parts)
        for kind, sums in held.items():
            yield from _dealt(kind, *sums.take(), parts)
        yield from _dealt(2, np.zeros(1, np.int64), np.array([texts]), parts)
        yield from _dealt(3, np.zeros(1, np.int64), np.array([words_seen]), parts)

    dealt = rows.mapInArrow(run, _DEALT).repartition("part")
    return dealt.mapInArrow(_added, "kind tinyint, code bigint, n bigint").groupBy("kind", "code").agg(F.sum("n").alias("n"))


def _shuffled(rows: DataFrame) -> int:
    return int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))


@dataclass
class Models:
    bytes: ByteModel | None  # the whole trie, if it is small
    answers: Answers | None  # otherwise
    common: np.ndarray  # sorted hashes of the commonest words
    common_log: np.ndarray
    end_log: float
    train_tokens: int
    scale: float  # N + 0.1 (V + 1)
    parts: int  # to which the other words and as many to which the other runs are dealt


def _level() -> Column:
    """Eighths of a power of two of the counts n; -1 for 0."""
    return F.when(F.col("n") > 0, F.floor(F.log2("n") * 8).cast("int")).otherwise(-1)


def _least_level(rows: DataFrame, most: int) -> int:
    """The least level of those, from the highest, whose rows are at most ``most`` together."""
    least = 1 << 30
    for row in rows.groupBy("level").count().orderBy(F.desc("level")).collect():
        most -= row["count"]
        if most < 0:
            break
        least = row["level"]
    return least


def fit(texts: DataFrame) -> tuple[Models, DataFrame]:
    """Models of all rows of (text), and the logarithms (kind: 0 of words, 1 of runs, code, value) that are not broadcast.

    With a column ``learnt``, only the rows where it is true are learnt; the logarithms are those of all rows.
    """
    learnt = F.col("learnt") if "learnt" in texts.columns else F.lit(True)
    counts = stored(_counted(texts.select("text", learnt.alias("learnt"))), "lm-counts")
    distinct = F.count(F.when(F.col("n") > 0, 1))
    sums = {r.kind: r for r in counts.groupBy("kind").agg(F.sum("n").alias("n"), distinct.alias("distinct"), F.count("*").alias("rows")).collect()}
    n_texts = sums[2].n if 2 in sums else 0
    n_words = sums[3].n if 3 in sums else 0
    n_bytes = sums[1].n if 1 in sums else 0
    train = n_words + n_texts
    scale = train + 0.1 * ((sums[0].distinct if 0 in sums else 0) + (1 if n_texts else 0) + 1)
    parts = max(1, -(-max((r.rows for r in sums.values()), default=0) // _PART))
    runs = every = counts.where("kind = 1")
    least = max(1.0, SHARE * n_bytes)
    small = 1 not in sums or sums[1].rows <= TRIE_RUNS
    kept = None
    for length in range(ORDER + 1 if small else LOW, 0, -1):
        if length <= ORDER:
            runs = runs.groupBy(F.col("code").bitwiseAND(F.lit(_mask(length))).alias("code")).agg(F.sum("n").alias("n"))
        part = runs.where(F.col("n") >= F.lit(least)).select(F.lit(length).alias("length"), "code", "n")
        kept = part if kept is None else kept.unionAll(part)
    table = kept.toArrow()  # at most (ORDER + 1) * TRIE_RUNS rows, or the different runs of at most LOW bytes
    trie = tuple(table[c].to_numpy().astype(np.int64) for c in ("length", "code", "n"))
    words = counts.where("kind = 0").select("code", "n", _level().alias("level"))
    level = _least_level(words, COMMON)
    common = words.where(F.col("level") >= level).select("code", "n").toArrow()  # at most COMMON rows
    code = common["code"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(code)
    log = np.log10((common["n"].to_numpy().astype(float) + 0.1) / scale)
    end = float(np.log10((n_texts + 0.1) / scale))
    rarer = words.where(F.col("level") < level).select(F.lit(0).cast("tinyint").alias("kind"), "code", F.log10((F.col("n") + F.lit(0.1)) / F.lit(scale)).alias("value"))
    if small:
        return Models(ByteModel.of(*trie, n_texts), None, code[order], log[order], end, train, scale, parts), rarer
    answered = _answered(every, trie, n_texts, least).withColumn("level", _level())
    level = _least_level(answered, COMMON_RUNS)
    known = answered.where(F.col("level") >= level).select("code", "value").toArrow()  # at most COMMON_RUNS rows
    answers = Answers(IntMap(known["code"].to_numpy(), np.arange(len(known))), known["value"].to_numpy())
    rarer = rarer.unionAll(answered.where(F.col("level") < level).select(F.lit(1).cast("tinyint"), "code", "value"))
    return Models(None, answers, code[order], log[order], end, train, scale, parts), rarer


def _met(kind: int, text: np.ndarray, codes: np.ndarray, keys: np.ndarray, parts: int) -> dict[str, pa.Array]:
    """A row for each part: the keys of the texts that have codes there, how many each has, and the codes."""
    part, order = _parts(codes, parts)
    text, codes = text[order], codes[order]
    heads, first = _starts(part, text), _starts(part)
    at = np.append(first, len(part))
    among = np.searchsorted(heads, at)
    return {
        "part": pa.array(part[first] + np.int32(kind * parts)),
        "keys": _lists(among, keys[text[heads]]),
        "sizes": _lists(among, np.diff(np.append(heads, len(part))).astype(np.int32)),
        "codes": _lists(at, codes.view(np.int64)),
    }


def _scored(rows: DataFrame, models: Models) -> DataFrame:
    """Per text one row with what the task knows (info), and for the rarer words and runs of bytes of some texts
    together one row per part.  Parts of runs come after those of words."""
    shared = rows.sparkSession.sparkContext.broadcast(models)
    kind = rows.schema["doc_id"].dataType.simpleString()
    info = f"struct<doc_id: {kind}, n_tokens: bigint, known: bigint, base: double, score: double>"
    schema = f"part int, key bigint, keys array<bigint>, sizes array<int>, codes array<bigint>, info {info}"
    names = ["part", "key", "keys", "sizes", "codes", "info"]

    def run(arrivals):
        models = shared.value
        scorer = Scorer(models.bytes) if models.bytes else None
        for part in batches(arrivals, "text", _SCORED):
            words, at = texts_words(part["text"], SPACED_BYTES)
            n = len(at) - 1
            place = np.minimum(np.searchsorted(models.common, words), max(0, len(models.common) - 1))
            common = models.common[place] == words if len(models.common) else np.zeros(len(words), bool)
            text = np.repeat(np.arange(n), np.diff(at))
            value = np.zeros(len(words))
            value[common] = models.common_log[place[common]]
            base = np.bincount(text, weights=value, minlength=n) + models.end_log
            known = np.bincount(text[common], minlength=n) + (models.train_tokens > 0)
            runs = np.zeros(0, np.int64), np.zeros(0, np.uint64)
            if scorer:
                score = scorer.score(*column_bytes(part["text"]))
            else:
                score, *runs = models.answers.score(*column_bytes(part["text"]))
            key = part["key"].to_numpy()
            about = [part["doc_id"].combine_chunks(), pa.array(np.diff(at) + 1, pa.int64()), pa.array(known.astype(np.int64)), pa.array(base), pa.array(score)]
            info = pa.StructArray.from_arrays(about, ["doc_id", "n_tokens", "known", "base", "score"])
            own = {"part": pa.array((key % models.parts).astype(np.int32)), "key": pa.array(key), "info": info}
            lists = pa.list_(pa.int64())
            types = dict(zip(names, (pa.int32(), pa.int64(), lists, pa.list_(pa.int32()), lists, info.type)))
            for columns in own, _met(0, text[~common], words[~common], key, models.parts), _met(1, *runs, key, models.parts):
                size = len(columns["part"])
                if size:
                    yield pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(size, t)) for c, t in types.items()], names)

    return rows.mapInArrow(run, schema)


def _logarithms(known: DataFrame, parts: int) -> DataFrame:
    """The logarithms (kind, code, value) in rows of many codes of a part."""

    def run(arrivals):
        for some in batches(arrivals, "value", _BATCH):
            code, value, kind = (some[c].to_numpy() for c in ("code", "value", "kind"))
            for k in 0, 1:
                own = np.flatnonzero(kind == k)
                part, order = _parts(code[own], parts)
                if len(own):
                    heads = _starts(part)
                    at = np.append(heads, len(part))
                    lists = (_lists(at, x[own][order]) for x in (code, value))
                    yield pa.RecordBatch.from_arrays([pa.array(part[heads] + np.int32(k * parts)), *lists], ["part", "codes", "values"])

    return known.select("kind", "code", "value").mapInArrow(run, "part int, codes array<bigint>, values array<double>")


def _summed(met: DataFrame, models: Models) -> DataFrame:
    """Sums per text (key) over its words and runs that are in one part, and the rows of texts (info).  Of each part the
    logarithms come first."""
    parts, unknown = models.parts, float(np.log10(0.1 / models.scale))
    kind = met.schema["info"].dataType["doc_id"].dataType
    id_type = to_arrow_type(kind)
    schema = f"key bigint, rows bigint, doc_id {kind.simpleString()}, n_tokens bigint, known bigint, base double, score double"
    names = ["key", "rows", "doc_id", "n_tokens", "known", "base", "score"]

    def lists(rows: pa.RecordBatch, *columns: str):
        return (rows.column(c).flatten().to_numpy() for c in columns)

    def sums(part: int, table: tuple[np.ndarray, np.ndarray], keys: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> pa.RecordBatch:
        known, value = np.zeros(len(codes), np.int64), np.full(len(codes), unknown if part < parts else 0.0)
        if len(table[0]):
            place = np.minimum(np.searchsorted(table[0], codes), len(table[0]) - 1)
            hit = table[0][place] == codes
            known[hit], value[hit] = part < parts, table[1][place[hit]]
        first = np.cumsum(sizes) - sizes
        n, value = len(keys), np.add.reduceat(value, first)
        base, score = (value, np.zeros(n)) if part < parts else (np.zeros(n), value)
        columns = [keys, np.zeros(n, np.int64), pa.nulls(n, id_type), pa.nulls(n, pa.int64()), np.add.reduceat(known, first), base, score]
        return pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], names)

    def run(arrivals):
        mine, held, table = -1, [], None
        for batch in arrivals:
            part = batch.column("part").to_numpy()
            cuts = _starts(part)
            for a, b in zip(cuts, np.append(cuts[1:], len(part))):
                if part[a] != mine:
                    mine, held, table = int(part[a]), [], None
                own = batch.slice(a, b - a)
                texts = own.filter(own.column("info").is_valid())
                if len(texts):
                    about = texts.column("info").flatten()
                    yield pa.RecordBatch.from_arrays([texts.column("key"), pa.array(np.ones(len(texts), np.int64)), *about], names)
                logs = own.filter(own.column("values").is_valid())
                if len(logs):
                    held.append([x.copy() for x in lists(logs, "codes", "values")])
                asked = own.filter(own.column("keys").is_valid())
                if len(asked):
                    if table is None:
                        code, value = (np.concatenate(x) for x in zip(*held)) if held else (np.zeros(0, np.int64), np.zeros(0))
                        order = np.argsort(code)
                        table, held = (code[order], value[order]), []
                    yield sums(mine, table, *lists(asked, "keys", "sizes", "codes"))

    return met.repartition("part").sortWithinPartitions("part", F.col("values").isNull()).mapInArrow(run, schema)


def score_texts(docs: DataFrame, learn_parts: int = 10) -> DataFrame:
    """Scores of all documents (doc_id, text); those whose crc32 of the id leaves 0 modulo ``learn_parts`` are not learnt.

    Columns: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10).
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    models, rarer = fit(rows.select("text", (~held_out("doc_id", learn_parts)).alias("learnt")))
    scored = _scored(rows.withColumn("key", F.xxhash64("doc_id", "text")), models)
    met = scored.unionByName(_logarithms(rarer, models.parts), allowMissingColumns=True)
    summed = _summed(met, models).groupBy("key").agg(
        F.sum("rows").alias("rows"),
        F.max("doc_id").alias("doc_id"),
        F.max("n_tokens").alias("n_tokens"),
        *(F.sum(c).alias(c) for c in ("known", "base", "score")),
    )
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows")))
    return summed.select("*", each.alias("copy")).select(
        "doc_id",
        held_out("doc_id", learn_parts).alias("held_out"),
        "n_tokens",
        F.expr("known div rows").alias("n_known"),
        F.lit(models.train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") / F.col("rows")).alias("base_score"),
        (F.col("score") / F.col("rows")).alias("score"),
    )
