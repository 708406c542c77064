"""Best-fit packing of token sequences by a configuration linear program over the length histogram.

A configuration is a multiset of lengths that fits one sequence. The program asks for how often to use each so that
every length is covered as often as it occurs. Only the histogram (one count a length) goes to the driver. Multiplicative
weights solve it: each length has a price, which starts at its share of a sequence and falls exponentially with its
coverage; a knapsack dynamic program finds the configurations of the highest price, which cover some more; and the prices,
scaled to what a sequence can hold, bound the program from below. The solution is rounded down, and best fit packs what
that leaves. Where this plan is not within GAP of the bound, simplex steps among the same and further configurations
finish the program. Pieces then find their places by their rank within their length, which needs no plan but the
configurations.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import documents, spread, stage_table, text_of
from .kernel import blocks, tidied, utf8

CAPACITY = 2048
BLOCK = 2 << 20
#: Words without end marks whose ids a worker keeps at least.
MEMO_STEMS = 60_000
#: Marks at a word's end that are symbols to the tokenizer, and so never join a letter before them.
END_MARKS = ".,!?;:%&*$#|"
#: Stands between words that are encoded together; no word holds it.
BETWEEN = "\ue000"
#: Phases of the weights: how fast a price falls with coverage, and knapsacks at most; configurations traced from each
#: knapsack, and how much less than the best one may be worth.
RATES, TRACES, SLACK = ((0.1, 60), (0.03, 100), (0.01, 140)), 16, 1e-3
#: A plan is good where it is within GAP of the bound, and one sequence. Simplex steps end there, or after so many knapsacks;
#: how far their prices stay at the best bound's, and columns taken from a pool at a time.
GAP, KNAPSACKS, STAY, POOL = 0.001, 1000, 0.8, 64
#: Cells over which the pieces of a length are dealt, to be ranked.
SALTS = 64

Configuration = tuple[tuple[int, int], ...]


def _byte_letters() -> dict[int, int]:
    """The letter that byte-level tokenizers write for each byte: itself where it is visible, else one from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: b for b in visible} | {b: 256 + i for i, b in enumerate(hidden)}


def _gather(pool: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The runs of pool that begin at starts, one after the other."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return pool[np.arange(total) + np.repeat(starts - (ends - counts), counts)]


class WordIds:
    """Ids of texts by a tokenizer that never looks across white space; a word's ids are computed once a block.

    A word's end marks are looked up by themselves, as most words occur with some and without. Stems that were used last
    are kept with their ids, MEMO_STEMS at least and twice as many at most.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.between = np.array(self.tokenizer.encode(BETWEEN, add_special_tokens=False).ids, np.uint32)
        self.memo: dict[str, bytes] = {}
        self.former: dict[str, bytes] = {}
        self.ends: dict[str, bool] = {"": False}

    def _may_end(self, last: str) -> bool:
        """Whether a stem may end in this character: a letter, and one whose normal form ends in a letter.

        Of marks behind any other, the tokenizer could take some together with what stands before them.
        """
        if last not in self.ends:
            plain = self.tokenizer.normalizer.normalize_str(last)
            self.ends[last] = last.isalpha() and plain[-1:].isalpha()
        return self.ends[last]

    def _cut(self, words: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Each word as a stem and its end marks, which the tokenizer never joins; ASCII stems in lower case."""
        stems = pc.utf8_rtrim(words, characters=END_MARKS)
        last = pc.utf8_slice_codeunits(stems, start=-1).dictionary_encode()
        fit = pa.array([self._may_end(c) for c in last.dictionary.to_pylist()], pa.bool_()).take(last.indices)
        stems = pc.if_else(fit, stems, words)
        cut = pc.subtract(pc.binary_length(words), pc.binary_length(stems)).to_numpy()
        data, offsets = utf8(words)
        marks = _gather(data, offsets[1:] - cut, cut)
        at = np.concatenate([[0], np.cumsum(cut)]).astype(np.int32)
        marks = pa.StringArray.from_buffers(len(words), pa.py_buffer(at), pa.py_buffer(marks))
        # Special tokens, which begin with <, are found before letters are folded.
        plain = pc.and_(pc.string_is_ascii(stems), pc.invert(pc.match_substring(stems, "<")))
        return pc.if_else(plain, pc.ascii_lower(stems), stems), marks

    def _encode(self, some: list[str]) -> list[bytes]:
        """Ids of each of some strings, by one call for all, cut where the mark between them stands."""
        if not any(BETWEEN in s for s in some):
            ids = np.array(self.tokenizer.encode(f" {BETWEEN} ".join(some), add_special_tokens=False).ids, np.uint32)
            n = len(self.between)
            hit = np.ones(max(0, len(ids) - n + 1), bool)
            for k in range(n):
                hit &= ids[k : len(ids) - n + 1 + k] == self.between[k]
            at = np.flatnonzero(hit)
            if len(at) == len(some) - 1:
                raw, starts, ends = ids.tobytes(), [0, *(at + n)], [*at, len(ids)]
                return [raw[4 * a : 4 * b] for a, b in zip(starts, ends, strict=True)]
        return [np.array(e.ids, np.uint32).tobytes() for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]

    def _learn(self, fresh: list[str], found: dict[str, bytes]) -> None:
        tokenize, other = self.model.tokenize, []
        for stem in fresh:
            # Lower-case letters alone pass normalizing and splitting unchanged, and go to the merges at once.
            if stem.isalpha() and stem.lower() == stem and unicodedata.is_normalized("NFC", stem):
                raw = stem if stem.isascii() else stem.encode().decode("latin-1").translate(self.letters)
                found[stem] = b"".join([t.id.to_bytes(4, "little") for t in tokenize(raw)])
            else:
                other.append(stem)
        for lo in range(0, len(other), 5000):
            some = other[lo : lo + 5000]
            found.update(zip(some, self._encode(some), strict=True))

    def _pool(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of distinct strings one after the other, where each begins, how many it has)."""
        memo, former = self.memo, self.former
        got = [memo.get(s) for s in strings]
        found = {s: former.get(s) for s, ids in zip(strings, got, strict=True) if ids is None}
        self._learn([s for s, ids in found.items() if ids is None], found)
        ids = [found[s] if own is None else own for s, own in zip(strings, got, strict=True)]
        memo.update(found)
        if len(memo) > MEMO_STEMS:
            self.memo, self.former = {}, memo if len(memo) <= 2 * MEMO_STEMS else {}
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        return np.frombuffer(b"".join(ids), np.uint32), np.cumsum(sizes) - sizes, sizes

    def forget(self) -> None:
        self.memo, self.former = {}, {}

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets)."""
        parts = pc.ascii_split_whitespace(texts)
        coded = parts.flatten().dictionary_encode()
        stems, marks = (a.dictionary_encode() for a in self._cut(coded.dictionary))
        n = len(stems.dictionary)
        strings = stems.dictionary.to_pylist() + marks.dictionary.to_pylist()
        pool, begins, sizes = self._pool(list(dict.fromkeys(strings)))
        if len(begins) < len(strings):
            at = {s: i for i, s in enumerate(dict.fromkeys(strings))}
            order = np.fromiter((at[s] for s in strings), np.int64, len(strings))
            begins, sizes = begins[order], sizes[order]
        # A word's ids are those of its stem, then those of its marks.
        two = np.stack([stems.indices.to_numpy().astype(np.int64), marks.indices.to_numpy().astype(np.int64) + n], axis=1).ravel()
        pool = _gather(pool, begins[two], sizes[two])
        sizes = sizes[two].reshape(-1, 2).sum(axis=1)
        begins = np.cumsum(sizes) - sizes
        use = coded.indices.to_numpy()
        counts = sizes[use]
        bounds = parts.offsets.to_numpy().astype(np.int64) - parts.offsets[0].as_py()
        return _gather(pool, begins[use], counts), np.concatenate([[0], np.cumsum(counts)])[bounds]


@cache
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, key: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each text's ids and end_id, cut only where longer than capacity.

    path names a tokenizer file that every executor has. Null and empty texts give one piece of end_id. ids, if asked
    for, are little-endian unsigned 32-bit integers in a binary column. Repeated rows give repeated pieces, an empty
    table none; other columns of docs are not read.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_ids(path)
        # Workers outlive their tasks: what one learns it does not hold on to while others run.
        coder.forget()
        for batch in (s for b in batches for s in blocks(b, 1, BLOCK)):
            ids, offsets = coder(batch.column(1))
            rows, piece, start, length, crc, kept = [], [], [], [], [], []
            for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                own = np.append(ids[a:b], np.uint32(end_id)).astype("<u4")
                for at in range(0, len(own), capacity):
                    part = own[at : at + capacity].tobytes()
                    rows.append(row)
                    piece.append(at // capacity)
                    start.append(at)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if keep_ids:
                        kept.append(part)
            made = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32())]
            made += [pa.array(c, pa.int64()) for c in (start, length, crc)] + [pa.array(kept, pa.binary())] * keep_ids
            yield pa.record_batch(made, names=names)
        coder.forget()

    kind = docs.schema[key].dataType.simpleString()
    ddl = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return docs.select(F.col(key), text_of(text).alias("__text")).mapInArrow(tidied(run), ddl)


def _best_values(prices: np.ndarray, capacity: int) -> np.ndarray:
    """Highest price of lengths that fit in each room from 0 to capacity; prices[n] is that of length n, 0 if there is none."""
    best = np.zeros(capacity + 1)
    for room in range(1, capacity + 1):
        best[room] = max(best[room - 1], (best[room - 1 :: -1] + prices[1 : room + 1]).max())
    return best


def _trace(best: np.ndarray, prices: np.ndarray, capacity: int, slack: float, rng: np.random.Generator) -> Configuration:
    """A configuration whose price is within slack of the best, drawn among near ties."""
    room, used = capacity, defaultdict(int)
    while room > 0:
        worth = best[room - 1 :: -1] + prices[1 : room + 1]
        near = np.flatnonzero((worth >= best[room] - slack) & (prices[1 : room + 1] > 0)) + 1
        if not len(near):
            if best[room] <= 0:
                break
            room -= 1
            continue
        n = int(near[rng.integers(len(near))])
        slack -= max(0.0, best[room] - worth[n - 1])
        used[n] += 1
        room -= n
    return tuple(sorted(used.items(), reverse=True))


def _best_fit(left: np.ndarray, capacity: int) -> dict[Configuration, int]:
    """Best fit, longest first, over counts: bins of one content are handled together."""
    by_room: dict[int, dict[Configuration, int]] = defaultdict(dict)
    for n in range(capacity, 0, -1):
        todo = int(left[n])
        while todo:
            rooms = [r for r in by_room if r >= n and by_room[r]]
            if not rooms:
                each = capacity // n
                content, bins = ((n, min(each, todo)),), max(1, todo // each)
                todo -= bins * content[0][1]
                room = capacity - n * content[0][1]
                by_room[room][content] = by_room[room].get(content, 0) + bins
                continue
            room = min(rooms)
            content, bins = by_room[room].popitem()
            each = min(room // n, todo)
            fit = max(1, min(bins, todo // each))
            if bins > fit:
                by_room[room][content] = bins - fit
            grown = (*content, (n, each))
            by_room[room - n * each][grown] = by_room[room - n * each].get(grown, 0) + fit
            todo -= fit * each
    return {content: bins for same in by_room.values() for content, bins in same.items() if bins}


def _merged(packed: dict[Configuration, int]) -> dict[Configuration, int]:
    """Bins by content, whatever the order in which pieces came."""
    out: dict[Configuration, int] = defaultdict(int)
    for found, times in packed.items():
        each: dict[int, int] = defaultdict(int)
        for n, k in found:
            each[n] += k
        out[tuple(sorted(each.items(), reverse=True))] += times
    return out


def _multiplicative_weights(demand: np.ndarray, capacity: int, rng: np.random.Generator) -> tuple[dict[Configuration, float], float]:
    """(uses of configurations, bound): a fractional solution, which covers tokens as often as they occur.

    A length's price falls by a rate for each time that its demand is covered, in as many phases as there are RATES, each
    of which starts at the prices that the one before ended at, with nothing covered. Uses are those of the last phase over
    the share of tokens that they cover; they cover each length, once the weights have evened out. The bound is that of the
    best prices: no plan has fewer sequences.
    """
    sizes = np.flatnonzero(demand)
    wanted = demand[sizes].astype(float)
    at = {int(n): i for i, n in enumerate(sizes)}
    base, tokens = sizes / capacity, wanted @ sizes
    bound = tokens / capacity
    for rate, knapsacks in RATES:
        covered, used = np.zeros(len(sizes)), defaultdict(float)
        for _ in range(knapsacks):
            prices = np.zeros(capacity + 1)
            prices[sizes] = base * np.exp(rate * (covered.min() - covered))
            best = _best_values(prices, capacity)
            bound = max(bound, wanted @ prices[sizes] / best[capacity])
            for _ in range(TRACES):
                found = _trace(best, prices, capacity, SLACK * best[capacity], rng)
                own, k = [at[n] for n, _ in found], np.array([k for _, k in found], float)
                step = (wanted[own] / k).min()
                used[found] += step
                covered[own] += step * k / wanted[own]
            if sum(used.values()) <= covered.min() * bound * (1 + GAP):
                return {found: times / covered.min() for found, times in used.items()}, bound
        base = prices[sizes] / best[capacity]
    share = covered @ (wanted * sizes) / tokens
    return {found: times / share for found, times in used.items()}, bound


class _Program:
    """Revised simplex over configurations: a basis of as many as there are lengths, each length covered exactly."""

    def __init__(self, demand: np.ndarray, capacity: int):
        self.sizes, self.capacity = np.flatnonzero(demand), capacity
        self.at = {int(n): i for i, n in enumerate(self.sizes)}
        self.demand = demand[self.sizes].astype(float)
        each = capacity // self.sizes
        self.basis: list[Configuration] = [((int(n), int(k)),) for n, k in zip(self.sizes, each, strict=True)]
        self.inverse = np.diag(1.0 / each)
        self.times, self.duals = self.demand / each, 1.0 / each

    def enter(self, found: Configuration) -> bool:
        """Take a configuration into the basis if it is worth more than one sequence by the duals."""
        own = [self.at[n] for n, _ in found]
        k = np.array([k for _, k in found], float)
        if k @ self.duals[own] <= 1 + 1e-7:
            return False
        column = self.inverse[:, own] @ k
        positive = np.flatnonzero(column > 1e-9)
        ratios = self.times[positive] / column[positive]
        out, step = positive[ratios.argmin()], ratios.min()
        self.times = np.maximum(self.times - step * column, 0)
        row = self.inverse[out] / column[out]
        self.inverse -= np.outer(column, row)
        self.inverse[out], self.times[out], self.basis[out] = row, step, found
        self.duals = self.duals + row * (1 - column.sum())
        return True

    def solve(self, pool: list[Configuration], knapsacks: int, rng: np.random.Generator) -> None:
        held = np.zeros((len(pool), len(self.sizes)))
        for i, found in enumerate(pool):
            for n, k in found:
                held[i, self.at[n]] = k
        for _ in range(len(pool)):
            self.duals = self.inverse.sum(0)
            worth = held @ self.duals
            if not sum([self.enter(pool[i]) for i in np.argsort(-worth)[:POOL]]):
                break
        center, bound, stay = self.sizes / self.capacity, self.demand @ self.sizes / self.capacity, True
        for _ in range(knapsacks):
            if self.times.sum() <= bound * (1 + GAP):
                break
            self.duals = self.inverse.sum(0)
            real = np.maximum(self.duals, 0)
            # Prices near those of the best bound find better configurations; the duals themselves decide when none is left.
            stayed = stay
            used = STAY * center + (1 - STAY) * real if stayed else real
            prices = np.zeros(self.capacity + 1)
            prices[self.sizes] = used
            best = _best_values(prices, self.capacity)
            top = best[self.capacity]
            if self.demand @ used / top > bound:
                center, bound = used / top, self.demand @ used / top
            hits = sum([self.enter(f) for f in {_trace(best, prices, self.capacity, 0.01 * top, rng): 0 for _ in range(TRACES)}])
            if not hits and not stayed and top <= 1 + 1e-6:
                break
            stay = bool(hits) or not stayed


def _rounded(used: dict[Configuration, float], demand: np.ndarray, capacity: int, least: float) -> dict[Configuration, int]:
    """Uses rounded down, of configurations filled to least or more, and best fit for what that leaves."""
    left, chosen = demand.copy(), defaultdict(int)
    for found, part in sorted(used.items(), key=lambda f: (-sum(n * k for n, k in f[0]), f[0])):
        if sum(n * k for n, k in found) < least:
            break
        times = min(int(part + 1e-6), *(int(left[n]) // k for n, k in found))
        if times:
            chosen[found] += times
            for n, k in found:
                left[n] -= k * times
    for found, times in _merged(_best_fit(left, capacity)).items():
        chosen[found] += times
    return chosen


def solve_configurations(counts: dict[int, int], capacity: int = CAPACITY, seed: int = 0) -> list[tuple[Configuration, int]]:
    """[(configuration, times)] that use each length exactly as often as counts says. Runs on the driver, over lengths only.

    Of the plans made, the shortest is returned: the weights' solution, rounded; where that is not good, the finished program, rounded, and best fit alone.
    """
    demand = np.zeros(capacity + 1, np.int64)
    for n, c in counts.items():
        if not 1 <= n <= capacity:
            raise ValueError(f"length {n} does not fit {capacity}")
        demand[n] = c
    whole = {((capacity, 1),): int(demand[capacity])} if demand[capacity] else {}
    demand[capacity] = 0
    if not demand.any():
        return sorted(whole.items())
    rng = np.random.Generator(np.random.PCG64(seed))
    used, bound = _multiplicative_weights(demand, capacity, rng)
    tight = bound <= demand @ np.arange(capacity + 1) / capacity * (1 + GAP)
    plans = [_rounded(used, demand, capacity, (1 - GAP) * capacity if tight else 0)]
    if sum(plans[0].values()) > bound * (1 + GAP) + 1:
        plans.append(_merged(_best_fit(demand.copy(), capacity)))
        program = _Program(demand, capacity)
        program.solve([*used, *plans[1]], KNAPSACKS, rng)
        plans.append(_rounded(dict(zip(program.basis, program.times, strict=True)), demand, capacity, 0))
    return sorted((whole | min(plans, key=lambda p: sum(p.values()))).items())


def places(plan: list[tuple[Configuration, int]]) -> dict[str, np.ndarray]:
    """Columns by which rank r of length n finds its place: runs of ranks, sorted by (n, first)."""
    rows, taken, sequence = [], defaultdict(int), 0
    for found, times in plan:
        offset = 0
        for n, k in found:
            rows.append((n, taken[n], sequence, k, offset))
            taken[n] += k * times
            offset += n * k
        sequence += times
    columns = np.array(sorted(rows), np.int64).reshape(-1, 5).T
    return dict(zip(("length", "first", "sequence", "each", "offset"), columns, strict=True))


def rank_in_length(cells: DataFrame) -> DataFrame:
    """cells, pieces with a salt of their own in __salt, with rank, from 0 without gaps within each length."""
    sizes = cells.groupBy("length", "__salt").agg(F.count("*").alias("n"))
    before = sizes.selectExpr("length", "__salt", "sum(n) OVER (PARTITION BY length ORDER BY __salt) - n AS __before")
    own = F.row_number().over(Window.partitionBy("length", "__salt").orderBy("doc_id", "piece", "ids_crc32"))
    return cells.withColumn("__own", own).join(before, ["length", "__salt"]).withColumn("rank", F.col("__before") + F.col("__own") - 1).drop("__salt", "__own", "__before")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The columns of pieces, as token_pieces gives them, with sequence_id and offset.

    Every piece has one place; offsets within a sequence have no gaps, from 0. Pieces of one length take its places in
    any order, so ties and repeated rows need no rule. An empty table gives no rows.
    """
    salt = F.floor(F.rand(7) * SALTS).cast("int")
    stored = stage_table(pieces.withColumn("__salt", salt), "pieces")
    counts = {r["length"]: r["n"] for r in stored.groupBy("length").agg(F.count("*").alias("n")).collect()}
    where = places(solve_configurations(counts, capacity))
    ranked = rank_in_length(stored)
    columns = pieces.columns
    names = [*columns, "sequence_id", "offset"]
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = where["length"] << 44 | where["first"]
        for batch in batches:
            n, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            run_of = np.searchsorted(keys, n << 44 | rank, side="right") - 1
            inner = rank - where["first"][run_of]
            each = where["each"][run_of]
            made = [where["sequence"][run_of] + inner // each, where["offset"][run_of] + inner % each * n]
            yield pa.record_batch([*(batch.column(c) for c in columns), *(pa.array(m, pa.int64()) for m in made)], names=names)

    return ranked.mapInArrow(tidied(run), ddl)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(token_pieces(spread(documents(spark, sf_dir)), public_tokenizers.path("word_bpe_49k.json")))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
