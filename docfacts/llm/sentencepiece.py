"""SentencePiece encoding and decoding with a fixed public vocabulary, as a relational lattice.

A text, with a space before it, falls into units: a run of letters, digits and
characters beyond ASCII, or a run of other marks, each with the one space before
it; any other white space is a unit by itself. Two neighbours that stand side by
side in some piece are never parted (runs of spaces, a mark and the carriage return
after it, some marks beside curly quotes), and a unit of over 64 bytes is cut
wherever its neighbours are in no piece. So no piece crosses units, and the best
segmentation of a text is that of its units.

1. The distinct units of all texts are counted.
2. Their substrings of bounded length are exploded and joined to the piece table;
   a character that is no piece gets an edge of its own. Edges are grouped by unit
   and a higher-order ``aggregate`` folds them into the best path (Viterbi: the
   largest sum of piece scores; on a tie the longest last piece).
   Units that are still over 64 bytes are left to step 3, which finds the best path
   of each in place, over its full length.
3. The lexicon of units is applied to the texts. It is broadcast while it has at
   most ``LEXICON_ROWS`` rows; beyond that its commonest units are, and the other
   units of each document are looked up by a join.

Decoding is exact: pieces give back their characters, byte pieces their bytes.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from docfacts.llm import vocabulary
from docfacts.llm.common import discard, few_tasks, saved, short_plans, small_batches
from docfacts.llm.wordhash import PIECE_BYTES, Places, Words, buffers, column, slices

#: Units whose segmentation is broadcast at most (about 25 bytes each); bytes of a unit in the lexicon.
LEXICON_ROWS, UNIT_BYTES = 6_000_000, 64
#: What a character that is no piece costs below the worst piece.
UNKNOWN_COST = 10.0

_CLASS = np.full(256, 2, np.uint8)  # 0 white space, 1 letters, digits and beyond ASCII, 2 other marks
_CLASS[[0x20, *range(0x09, 0x0E)]] = 0
_CLASS[0x80:] = _CLASS[0x30:0x3A] = _CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = 1
_SIZE = np.ones(256, np.int64)  # bytes of the character that begins with a byte
_SIZE[0xC0:0xE0], _SIZE[0xE0:0xF0], _SIZE[0xF0:] = 2, 3, 4


def _characters(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The bytes of the character that begins at each place, as one number."""
    size, out = _SIZE[data[at]], data[at].astype(np.uint64)
    for j in range(1, 4):
        more = np.flatnonzero(size > j)
        out[more] = out[more] << np.uint64(8) | data[at[more] + j]
    return out


class Neighbours:
    """Characters that stand side by side in some piece: a cut between two others parts no piece."""

    def __init__(self, pieces: list[str]):
        pairs = {p[j : j + 2] for p in pieces for j in range(len(p) - 1)}
        number = [[int.from_bytes(c.encode(), "big") for c in pair] for pair in sorted(pairs)]
        self.pairs = np.sort(np.array([a << 32 | b for a, b in number], np.uint64))
        self.bytes = np.zeros((256, 256), bool)  # last byte of the one, first byte of the other
        for a, b in pairs:
            self.bytes[a.encode()[-1], b.encode()[0]] = True

    def __call__(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether the characters before and after each place (the beginning of a character, not of ``data``) are such."""
        out = self.bytes[data[at - 1], data[at]]
        maybe = np.flatnonzero(out)
        after = at[maybe]
        before = after - 1
        for _ in range(3):
            before = before - (data[before] & 0xC0 == 0x80)
        key = _characters(data, before) << np.uint64(32) | _characters(data, after)
        found = np.searchsorted(self.pairs, key)
        out[maybe] = self.pairs[np.minimum(found, len(self.pairs) - 1)] == key if len(self.pairs) else False
        return out


class Units(Words):
    """Units of some texts, each of which begins with a space; ``long`` are those of over UNIT_BYTES bytes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, beside: Neighbours):
        self.data, self.offsets, self.rows = data, offsets, len(offsets) - 1
        kind = _CLASS[data]
        start = np.ones(len(data), bool)
        start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 0)
        begin = np.zeros(len(data) + 1, bool)
        begin[offsets] = True
        start |= begin[:-1]
        # A space is joined to the run after it.
        joined = np.zeros(len(data), bool)
        joined[1:] = start[1:] & (kind[1:] != 0) & (data[:-1] == 0x20) & ~begin[1:-1]
        start &= ~joined
        inner = np.flatnonzero(start & ~begin[:-1])
        start[inner[beside(data, inner)]] = False
        at = np.flatnonzero(start)
        end = np.append(at[1:], len(data)) if len(at) else at
        long = np.flatnonzero(end - at > UNIT_BYTES)
        if len(long):
            inner = np.concatenate([np.arange(s + 1, e) for s, e in zip(at[long].tolist(), end[long].tolist(), strict=True)])
            inner = inner[data[inner] & 0xC0 != 0x80]
            at = np.sort(np.concatenate((at, inner[~beside(data, inner)])))
            end = np.append(at[1:], len(data))
        self.start, self.end, self.long = at, end, end - at > UNIT_BYTES
        self.first = np.searchsorted(at, offsets)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(self.rows), self.counts)


class Walk:
    """Best paths of single units, one character after the other: those of ``lattice``, in time and memory that grow with the length."""

    def __init__(self, path: str):
        pieces = vocabulary.load(path)
        self.pieces = {p.replace(vocabulary.SPACE, " "): (float(s), i) for i, p, s in pieces}
        self.longest = max(map(len, self.pieces))
        self.unknown = min(s for _, _, s in pieces if s > -1e8) - UNKNOWN_COST
        self.octets = vocabulary.byte_ids(path)

    def __call__(self, unit: str) -> list[int]:
        pieces, best, back = self.pieces, [0.0], [(0, -1)]
        for e in range(1, len(unit) + 1):
            top, way = -np.inf, None
            for s in range(max(0, e - self.longest), e):  # the longest last piece first: it stays on a tie
                score, i = pieces.get(unit[s:e], (None, -1))
                if score is None:
                    if s < e - 1:
                        continue
                    score = self.unknown
                if best[s] + score > top:
                    top, way = best[s] + score, (s, i)
            best.append(top)
            back.append(way)
        ids, e = [], len(unit)
        while e:
            s, i = back[e]
            ids += [i] if i >= 0 else [self.octets[b] for b in reversed(unit[s:e].encode())]
            e = s
        return ids[::-1]


def _pieces(texts: pa.Array, beside: Neighbours) -> Iterator[tuple[int, int, Units]]:
    for row, upto in slices(texts, PIECE_BYTES):
        part = pc.fill_null(texts.slice(row, upto - row), "")
        yield row, upto, Units(*buffers(pc.binary_join_element_wise("", part, " "), lower=False), beside)


def _neighbours(path: str) -> Neighbours:
    return Neighbours([p.replace(vocabulary.SPACE, " ") for _, p, _ in vocabulary.load(path)])


def distinct_units(docs: DataFrame, path: str = vocabulary.DEFAULT) -> DataFrame:
    """(h, unit, n) of a column ``text``: the hash, text and number of uses of each unit that is not long, saved."""
    beside = _neighbours(path)

    def put(found: list[tuple]) -> pa.RecordBatch:
        keys, n = (np.concatenate([f[i] for f in found]) for i in (0, 1))
        strings = [s for f in found for s in f[2]]
        keys, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(keys.view(np.int64)), pa.array([strings[i] for i in first], pa.binary()).cast(pa.string()), pa.array(np.bincount(inverse, n).astype(np.int64))], ["h", "unit", "n"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for batch in batches:
            for _, _, units in _pieces(column(batch, "text"), beside):
                short = np.flatnonzero(~units.long)
                keys, first, n = np.unique(units.hashes()[short], return_index=True, return_counts=True)
                first = short[first]
                raw = units.data.tobytes()
                found.append((keys, n, [raw[s:e] for s, e in zip(units.start[first].tolist(), units.end[first].tolist(), strict=True)]))
                held += len(keys)
                if held > 250_000:
                    yield put(found)
                    found, held = [], 0
        if found:
            yield put(found)

    return saved(docs.select("text").mapInArrow(run, "h long, unit string, n long").groupBy("h", "unit").agg(F.sum("n").alias("n")))


def shared_hashes(units: DataFrame) -> np.ndarray:
    """Hashes that several units share, ascending: their units are walked in place. About n^2 / 2^65 of n units have one, so they are few at any size.

    Two that meet in one batch of ``distinct_units`` first go unseen: a chance of 2e-9 a batch.
    """
    found = units.groupBy("h").agg(F.count("*").alias("m")).filter("m > 1").select("h").collect()
    return np.sort(np.array([r["h"] for r in found], np.int64).view(np.uint64))


def lattice(units: DataFrame, path: str = vocabulary.DEFAULT) -> DataFrame:
    """``units`` (h, unit, n) to (h, unit, n, ids, score): the best path of each unit, of at most UNIT_BYTES bytes, through its lattice.

    Units are dealt by ``h`` once; the exploded substrings stay where they are, and an
    edge is one long (end, start, piece), so grouping them moves and sorts little.
    """
    spark = units.sparkSession
    pieces = vocabulary.load(path)
    worst = min(s for _, _, s in pieces if s > -1e8)
    longest = max(len(p) for _, p, _ in pieces)
    scores = [worst - UNKNOWN_COST] + [0.0] * (max(i for i, _, _ in pieces) + 1)  # by id + 1; 0 is a character that is no piece
    for i, _, s in pieces:
        scores[i + 1] = float(s)
    score_of = F.from_json(F.lit(json.dumps(scores)), "array<double>")  # folded into one constant
    table = spark.createDataFrame([(p.replace(vocabulary.SPACE, " "), i) for i, p, _ in pieces], "piece string, id int")
    dealt = units.repartition(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), "h")  # a unit has some hundred substrings
    spans = (
        dealt.withColumn("s", F.explode(F.sequence(F.lit(1), F.length("unit"))))
        .withColumn("k", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("unit") - F.col("s") + 1))))
        .select("h", "s", "k", F.substring("unit", F.col("s"), F.col("k")).alias("piece"))
    )
    edges = spans.join(F.broadcast(table), "piece", "left").filter("id is not null or k = 1")  # the table has some 32 thousand rows
    end, start = (F.col("s") + F.col("k") - 1).cast("long"), (F.col("s") - 1).cast("long")
    edge = F.shiftleft(end, 40).bitwiseOR(F.shiftleft(start, 32)).bitwiseOR((F.coalesce("id", F.lit(-1)) + 1).cast("long"))
    grouped = edges.select("h", edge.alias("edge")).groupBy("h").agg(F.collect_list("edge").alias("edges")).join(dealt, "h")

    # Edges by end: ways to the end at hand compete for ``best``; when the end moves on, the best one joins the chart.
    def step(state: Column, x: Column) -> Column:
        e, s, i = F.shiftright(x, 40).cast("int"), F.shiftright(x, 32).bitwiseAND(F.lit(255)).cast("int"), x.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")
        more = e == state["end"]
        before = F.when(more | (s < state["end"]), F.element_at(state["chart"], s + 1)["score"]).otherwise(state["best"]["score"])
        way = F.struct((before + F.element_at(score_of, i + 1)).alias("score"), (-s).alias("back"), (i - 1).alias("id"))
        return F.when(more, F.struct(e.alias("end"), state["chart"].alias("chart"), F.greatest(state["best"], way).alias("best"))).otherwise(
            F.struct(e.alias("end"), F.concat(state["chart"], F.array(state["best"])).alias("chart"), way.alias("best"))
        )

    none = F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("back"), F.lit(-1).alias("id"))
    state = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<score:double,back:int,id:int>>").alias("chart"), none.alias("best"))
    chart = F.aggregate(F.sort_array("edges"), state, step, lambda s: F.concat(s["chart"], F.array(s["best"])))
    folded = grouped.select("h", "unit", "n", chart.alias("chart"))
    octets = F.array(*map(F.lit, vocabulary.byte_ids(path)))

    def spelled(at: Column, step: Column) -> Column:
        """The piece of a step back, or the byte pieces of its character."""
        hexed = F.hex(F.encode(F.substring("unit", at, F.lit(1)), "utf-8"))
        each = F.transform(F.sequence(F.lit(1), F.length(hexed), F.lit(2)), lambda i: F.element_at(octets, (F.conv(F.substring(hexed, i, F.lit(2)), 16, 10).cast("int") + 1)))
        return F.when(step["id"] >= 0, F.array(step["id"])).otherwise(each)

    def back(state: Column, _: Column) -> Column:
        step = F.element_at("chart", state["at"] + 1)
        return F.when(state["at"] > 0, F.struct((-step["back"]).alias("at"), F.concat(spelled(state["at"], step), state["ids"]).alias("ids"))).otherwise(state)

    zero = F.struct(F.length("unit").alias("at"), F.array().cast("array<int>").alias("ids"))
    ids = F.aggregate(F.sequence(F.lit(1), F.length("unit")), zero, back)["ids"]
    return folded.select("h", "unit", "n", ids.alias("ids"), F.element_at("chart", -1)["score"].alias("score"))


class Lexicon:
    """Units by hash: where each one's pieces begin in ``flat`` and how many they are."""

    def __init__(self, hashes: list[np.ndarray], lists: list[pa.Array]):
        begin, lens, flat, at = [], [], [], 0
        for x in lists:
            size = np.asarray(x.value_lengths().to_numpy(zero_copy_only=False), np.int32)
            begin.append((np.cumsum(size, dtype=np.int64) - size + at).astype(np.int32))
            lens.append(size.astype(np.uint8))  # a unit of UNIT_BYTES bytes has no more pieces than bytes
            flat.append(x.flatten().to_numpy())
            at += len(flat[-1])
        none = [np.zeros(0, np.int16)]
        keys = np.concatenate(hashes or [np.zeros(0, np.uint64)])
        order = np.argsort(keys)
        self.flat = np.concatenate(flat or none)
        self.keys, self.begin, self.lens = keys[order], np.concatenate(begin or none)[order], np.concatenate(lens or none)[order]


def _loaded(words: DataFrame) -> Lexicon:
    """On the driver, at most LEXICON_ROWS rows."""
    with short_plans(words.sparkSession):
        t = words.select("h", "ids").toArrow()
    found = Lexicon([c.to_numpy().view(np.uint64) for c in t["h"].chunks], t["ids"].chunks)
    del t
    pa.default_memory_pool().release_unused()
    return found


def lexicon(units: DataFrame, path: str = vocabulary.DEFAULT) -> DataFrame:
    """``units`` (h, unit, n) with ``ids`` and ``score``; ids in 16 bits if they fit."""
    words = lattice(units, path)
    small = max(i for i, _, _ in vocabulary.load(path)) < 1 << 15 and max(vocabulary.byte_ids(path)) < 1 << 15
    return words.withColumn("ids", F.col("ids").cast("array<smallint>")) if small else words


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = vocabulary.DEFAULT, most: int = LEXICON_ROWS, carry: dict[str, Column] | None = None) -> DataFrame:
    """(id, ids, exact): the piece ids of each text, and whether decoding them gives the text back; then ``carry``, columns by name, as they are.

    Defined cases: a null text has null ids; an empty text is one space mark; a
    null id is an id; rows that repeat an id are rows of their own; an empty table
    gives no rows; other columns are ignored, whatever their names.
    """
    spark = df.sparkSession
    small_batches(spark)
    docs = df.select(F.col(key).cast("long").alias("id"), F.xxhash64(F.col(text)).alias("th"), F.col(text).alias("text"), F.struct(F.lit(0).alias("_"), *[c.alias(name) for name, c in (carry or {}).items()]).alias("carry"))
    units = distinct_units(docs, path)
    twice = shared_hashes(units)
    words = lexicon(units.filter(~F.col("h").isin(twice.view(np.int64).tolist())) if len(twice) else units, path)
    beside = _neighbours(path)
    if units.count() <= most:
        shared = spark.sparkContext.broadcast(_loaded(words))
        discard(units)
        rows = docs.withColumn("rare", F.lit(None).cast(T.ArrayType(T.StructType([words.schema["h"], words.schema["ids"]]))))
    else:
        words = saved(words)
        # The commonest units that fit: all those used more often than some number of times.
        sizes = words.groupBy(F.log2("n").cast("int").alias("k")).agg(F.count("*").alias("m")).orderBy(F.desc("k")).collect()
        least, held = 63, 0
        for r in sizes:
            if held + r["m"] > most:
                break
            least, held = r["k"], held + r["m"]
        shared = spark.sparkContext.broadcast(_loaded(words.filter(F.log2("n").cast("int") >= least)))
        known = words.filter(F.log2("n").cast("int") < least).select("h", "ids")

        def missing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            have = shared.value
            places = Places(have.keys, 0)
            for batch in batches:
                for a, _, units in _pieces(column(batch, "text"), beside):
                    h = units.hashes()
                    hit = (places(h) >= 0) | units.long | np.isin(h, twice)
                    pairs = np.unique(np.stack((units.doc[~hit].astype(np.uint64), h[~hit])), axis=1)
                    rows_ = pa.array(pairs[0].astype(np.int64) + a)
                    yield pa.RecordBatch.from_arrays([column(batch, "id").take(rows_), column(batch, "th").take(rows_), pa.array(pairs[1].view(np.int64))], ["id", "th", "h"])

        asked = docs.mapInArrow(missing, "id long, th long, h long").distinct()
        told = asked.join(known, "h").groupBy("id", "th").agg(F.collect_list(F.struct("h", "ids")).alias("rare"))
        same = (F.col("d.id").eqNullSafe(F.col("t.id"))) & (F.col("d.th") == F.col("t.th"))
        rows = docs.alias("d").join(told.alias("t"), same, "left").select("d.id", "d.text", "d.carry", "t.rare")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = shared.value
        spelling, common, walk = spell.value, Places(have.keys, 0), None
        for batch in batches:
            texts, rare = column(batch, "text"), column(batch, "rare")
            null = texts.is_null()
            for a, b, units in _pieces(texts, beside):
                h = units.hashes()
                walked_ = units.long | np.isin(h, twice) if len(twice) else units.long
                places, lens, begins, flat = common, have.lens, have.begin, have.flat
                own = rare.slice(a, b - a).flatten()
                if len(own):
                    more = Lexicon([own.field("h").to_numpy().view(np.uint64)], [own.field("ids")])
                    begins = np.concatenate((begins, more.begin + len(flat)))
                    keys, lens, flat = np.concatenate((have.keys, more.keys)), np.concatenate((lens, more.lens)), np.concatenate((flat, more.flat))
                    order = np.argsort(keys, kind="stable")
                    places, lens, begins = Places(keys[order], 0), lens[order], begins[order]
                short = ~walked_
                at = places(h[short])
                if (at < 0).any():
                    raise ValueError("a unit is not in the lexicon")
                size, begin = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
                size[short], begin[short] = lens[at], begins[at]
                walked = {}
                if walked_.any():
                    walk = walk or Walk(path)
                    for j in np.flatnonzero(walked_).tolist():
                        key = bytes(units.data[units.start[j] : units.end[j]])
                        if key not in walked:
                            walked[key] = np.array(walk(key.decode()), np.int32)
                        size[j] = len(walked[key])
                ends = np.concatenate(([0], np.cumsum(size)))
                ids = np.empty(ends[-1], np.int32)
                known, index = np.repeat(short, size), np.repeat(begin - ends[:-1], size) + np.arange(ends[-1])
                ids[known] = flat[index[known]]
                for j in np.flatnonzero(walked_).tolist() if walked else []:
                    ids[ends[j] : ends[j + 1]] = walked[bytes(units.data[units.start[j] : units.end[j]])]
                lists = pa.ListArray.from_arrays(pa.array(ends[units.first].astype(np.int32)), pa.array(ids), mask=null.slice(a, b - a))
                data, cuts = _decoded(spelling, ids, ends[units.first])
                same = [bytes(data[x:y]) == bytes(units.data[o:p]) for x, y, o, p in zip(cuts[:-1], cuts[1:], units.offsets[:-1], units.offsets[1:], strict=True)]
                exact = pa.array(same, pa.bool_(), mask=null.slice(a, b - a).to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([column(batch, "id").slice(a, b - a), lists, exact, column(batch, "carry").slice(a, b - a)], ["id", "ids", "exact", "carry"])

    spell = spark.sparkContext.broadcast(_spelling(path))
    # Each task loads the lexicon and indexes it, so it should have some text.
    done = few_tasks(rows.select("id", "text", "rare", "carry"), df).mapInArrow(run, f"id long, ids array<int>, exact boolean, carry {rows.schema['carry'].dataType.simpleString()}")
    return done.select(F.col("id").alias(key), "ids", "exact", *[F.col("carry")[name].alias(name) for name in carry or {}])


def _spelling(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Where each piece's bytes begin (one more at the end), and all bytes end to end."""
    spelled = {i: p.replace(vocabulary.SPACE, " ").encode() for i, p, _ in vocabulary.load(path)} | {i: bytes([b]) for b, i in enumerate(vocabulary.byte_ids(path))}
    n = max(spelled) + 1
    lens = np.array([len(spelled.get(i, b"")) for i in range(n)])
    return np.concatenate(([0], np.cumsum(lens))), np.frombuffer(b"".join(spelled.get(i, b"") for i in range(n)), np.uint8)


def _decoded(spelling, ids: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of piece ids end to end, and where those of each row begin, for rows from ``edges`` to ``edges``."""
    at, data = spelling
    begin = at[ids]
    size = at[ids + 1] - begin
    ends = np.concatenate(([0], np.cumsum(size)))
    return data[np.repeat(begin - ends[:-1], size) + np.arange(ends[-1])], ends[edges]


def decoder(spark: SparkSession, path: str = vocabulary.DEFAULT):
    """A function from a column of piece ids to one of texts."""
    shared = spark.sparkContext.broadcast(_spelling(path))

    @arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            null = lists.is_null()
            lens = np.asarray(pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False), np.int64)
            flat = lists.flatten().to_numpy()
            edges = np.concatenate(([0], np.cumsum(lens)))
            parts = []
            row = 0
            while row < len(lens):  # some rows at a time
                upto = max(row + 1, int(np.searchsorted(edges, edges[row] + 500_000, "right")) - 1)
                data, cuts = _decoded(shared.value, flat[edges[row] : edges[upto]], edges[row : upto + 1] - edges[row])
                parts += [data[a + 1 : b].tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]  # without the space before the text
                row = upto
            yield pa.array(parts, pa.binary(), mask=null.to_numpy(zero_copy_only=False)).cast(pa.string())

    return decode


def op3(spark, sf_dir: str) -> DataFrame:
    """Every document's piece ids, with a check that decoding gives its text back."""
    from docfacts.llm.common import read

    coded = encode(read(spark, sf_dir, "documents"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", "exact")
