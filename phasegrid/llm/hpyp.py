"""Language-model scoring with a hierarchical Pitman-Yor model.

Restaurants: one for each word that comes before a token (the context: a 40-bit hash of the whole word),
all sharing the unigram restaurant as parent, whose base measure has no atoms, so its new dishes are
unknown words. The seating is sampled by Gibbs: a sweep takes all customers of a (context, word) out and
seats them again given all others. As customers of a dish are exchangeable, only their number of tables
has to be drawn: its conditional is the generalized Stirling number of (customers, tables) times what the
context's and the parent's restaurant give for so many more tables. All dishes are drawn at once given the
sweep before (a synchronous sampler, as is usual for distributed Gibbs). For dishes of over EXACT customers
the Stirling numbers come from their saddle point approximation instead of a table.
Predictive probabilities are averaged over the last sweeps. Discounts come from the counts of ones and twos.

Data flow. Documents are dealt into slices by hash. A slice sends each partition of the words its distinct
(word, context) pairs with training counts, sorted, so that the answer needs no names. A partition holds
all contexts of its words; hot words (more than one token in HOT_SHARE; 1,000 at most) are split over
SPLIT partitions by context. What a partition must know of others are sums by name (tables of a context or
of a split word): it sends its own part to the names' owners, which answer with the totals, once a sweep.
At the end every slice gets a probability for each of its pairs. So every table and message grows with the
text's distinct pairs, and no task sees more than a bounded part: partitions and slices follow the bytes.

Defined results: null text is empty (its only token is the end); rows that repeat are scored and
counted each (those with one doc_id and text meet in one slice); a null doc_id learns; with nothing to
learn from, scores are 0. Only doc_id and text are read, other columns left out. Two contexts whose hashes
agree in 40 bits share a restaurant: one in 10,000 of 10^8 distinct words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasegrid.llm.blocks import runs_by_key
from phasegrid.llm.store import drop, settled
from phasegrid.llm.tokens import U64, Words, mix, slices, words_of

START = U64(0)
END = U64(0x5DEECE66D1234567)
BITS, MASK = U64(40), U64((1 << 40) - 1)
#: Bytes of text of a slice, and that a partition of the words stands for.
SLICE, PART_BYTES = 4 << 20, 12 << 20
HOT_SHARE, SPLIT = 1000, 16
SPLIT_NAME = U64(1 << 62)
#: Dishes of up to so many customers are drawn from their exact conditional.
EXACT = 256
BUS = "dest long, kind int, src long, blob binary"
#: Kinds of rows.
PAIRS, STATIC, PLACES, NAMES, TALLY, ADDRESS, TOTALS, TABLES, SUMS = range(9)


@dataclass(frozen=True)
class Settings:
    strength: float = 2.0
    root_strength: float = 10.0
    sweeps: int = 3
    averaged: int = 2
    seed: int = 5


def tokens_of(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, document row and context of every token, each document's end included."""
    n = np.diff(words.doc)
    h = words.hashes(31)
    total = words.count + len(n)
    own = np.ones(total, bool)
    own[words.doc[1:] + np.arange(len(n))] = False
    token = np.full(total, END, np.uint64)
    token[own] = h
    context = np.empty(total, np.uint64)
    context[np.flatnonzero(own) + 1] = (h & MASK) | U64(1)  # the place behind each word is in the same document
    context[words.doc[:-1] + np.arange(len(n))] = START
    return token, np.repeat(np.arange(len(n)), n + 1), context


def split_names(hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shares of all hot words, ascending, and the word of each."""
    share = mix(hot[:, None] ^ mix(np.arange(1, SPLIT + 1, dtype=np.uint64))[None, :]).ravel()
    order = np.argsort(share)
    return share[order], np.repeat(hot, SPLIT)[order]


def _among(x: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each x is in known (ascending), and whether it is there."""
    if not len(known):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(known, x), len(known) - 1)
    return at, known[at] == x


def pairs_of(token: np.ndarray, context: np.ndarray, parts: int, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct shares of words (a word that isn't hot is its own share) by partition and hash; the distinct pairs as
    share << 40 | context; the pair of each token; and the partition of each share."""
    share = token
    _, is_hot = _among(token, hot)
    if is_hot.any():
        share = np.where(is_hot, mix(token ^ mix(mix(context) % U64(SPLIT) + U64(1))), token)
    unique, inverse = np.unique(share, return_inverse=True)
    place = (mix(unique) % U64(parts)).astype(np.int64)
    order = np.lexsort((unique, place))
    rank = np.empty(len(order), np.uint64)
    rank[order] = np.arange(len(order), dtype=np.uint64)
    pairs, pair = np.unique(rank[inverse] << BITS | context, return_inverse=True)
    return unique[order], pairs, pair, place[order]


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of unsigned integers, compressed byte plane by byte plane: high bytes are mostly alike."""
    head = np.array([len(arrays), *(x for a in arrays for x in (a.dtype.itemsize, len(a)))], np.int64).tobytes()
    raw = head + b"".join(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes() for a in arrays)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(blob: bytes) -> list[np.ndarray]:
    raw = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    k = int(np.frombuffer(raw, np.int64, 1)[0])
    sizes = np.frombuffer(raw, np.int64, 2 * k, 8).reshape(k, 2)
    out, at = [], 8 + 16 * k
    for width, n in sizes.tolist():
        planes = np.frombuffer(raw, np.uint8, width * n, at).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view({1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}[width]).ravel())
        at += width * n
    return out


def _least(x: np.ndarray) -> np.ndarray:
    """Counts in the narrowest type that holds them."""
    top = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def _bytes40(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :5].T).ravel()


def _from40(raw: np.ndarray) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = raw.reshape(5, -1).T
    return out.ravel().view(np.uint64)


def _rows(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(4)], ["dest", "kind", "src", "blob"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[int, list[tuple[int, bytes]]]]]:
    """Each destination with the rows for it by kind, in the order of their sources."""
    for run in runs_by_key(batches, ["dest"]):
        by: dict[int, list[tuple[int, bytes]]] = {}
        for kind, src, blob in zip(run.column("kind").to_pylist(), run.column("src").to_pylist(), run.column("blob")):
            by.setdefault(kind, []).append((src, blob.as_py()))
        yield run.column("dest")[0].as_py(), by


def _sliced(run: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = [tokens_of(words_of(p.column("text"), lower=True)) for p in slices(run, "text")]
    base = np.cumsum([0] + [p.num_rows for p in slices(run, "text")])
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] + b for p, b in zip(parts, base)]), np.concatenate([p[2] for p in parts])


def _deal(parts: int, told):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs_by_key(batches, ["slice"]):
            token, row, context = _sliced(run)
            learns = ~run.column("held").to_numpy(zero_copy_only=False)
            share, pairs, pair, place = pairs_of(token, context, parts, told.value)
            count = np.bincount(pair, learns[row], len(pairs)).astype(np.int64)
            per = np.bincount((pairs >> BITS).astype(np.int64), minlength=len(share))
            edge = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1], [True]]))
            at = np.concatenate([[0], np.cumsum(per)])
            name = run.column("slice")[0].as_py()
            yield _rows([(int(place[a]), PAIRS, name, _pack(share[a:b], _least(per[a:b]), _bytes40(pairs[at[a] : at[b]] & MASK), _least(count[at[a] : at[b]]))) for a, b in zip(edge[:-1], edge[1:])])

    return work


def _gather(parts: int, told):
    """A partition's pairs with their counts, where each slice's pairs are among them, and its part of the sums by name."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shares, words = split_names(told.value)
        for p, by in _runs(batches):
            found = [_unpack(blob) for _, blob in by[PAIRS]]
            unique, inverse = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
            rank = np.repeat(inverse.astype(np.uint64), np.concatenate([f[1] for f in found]))
            pairs, at = np.unique(rank << BITS | np.concatenate([_from40(f[2]) for f in found]), return_inverse=True)
            c = np.bincount(at, np.concatenate([f[3] for f in found]), len(pairs)).astype(np.int64)
            del rank
            per = np.bincount((pairs >> BITS).astype(np.int64), minlength=len(unique))
            names, context = np.unique(pairs & MASK, return_inverse=True)
            i, hot = _among(unique, shares)
            own = words[i[hot]] >> U64(2) | SPLIT_NAME
            names = np.concatenate([names, np.unique(own)])
            owner = (mix(names + U64(77)) % U64(parts)).astype(np.int64)
            order = np.lexsort((names, owner))
            to = np.empty(len(order), np.int64)
            to[order] = np.arange(len(order))
            names, owner, context = names[order], owner[order], to[context]
            split = np.zeros(len(unique), np.int64)  # place of the word's name, plus one, where the word is split
            place = {int(names[k]): k + 1 for k in np.flatnonzero(names >= SPLIT_NAME)}
            split[hot] = [place[x] for x in own.tolist()]
            edge = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1], [True]]))
            static = (_least(per), _least(context), _least(c), _least(split), owner[edge[:-1]], edge.astype(np.uint32))
            yield _rows([(p, STATIC, p, _pack(*static))])
            word = np.repeat(np.arange(len(per)), per)
            first = _sums(context, word, split, len(names), c), _sums(context, word, split, len(names), (c > 0).astype(np.int64))
            yield _rows([(int(owner[a]), NAMES, p, _pack(names[a:b], *(_least(x[a:b]) for x in first))) for a, b in zip(edge[:-1], edge[1:])])
            begin = np.cumsum([0] + [len(f[3]) for f in found])
            yield _rows([(p, PLACES, src, _pack(_least(np.diff(at[a:b], prepend=0)))) for (src, _), a, b in zip(by[PAIRS], begin[:-1], begin[1:])])
            m = np.bincount(word, c > 0, len(per))[split == 0]
            tally = [(c == 1).sum(), (c == 2).sum(), c.sum(), (m > 0).sum(), (c > 0).sum(), (m == 1).sum(), (m == 2).sum()]
            yield _rows([(0, TALLY, p, np.array(tally, np.int64).tobytes())])

    return work


def _sums(context: np.ndarray, word: np.ndarray, split: np.ndarray, names: int, x: np.ndarray) -> np.ndarray:
    """x of every pair, added up by the names of the partition."""
    out = np.bincount(context, x, names)
    own = split[word]
    if own.any():
        out += np.bincount(own[own > 0] - 1, x[own > 0], names)
    return out.astype(np.int64)


def _address(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """An owner's names: which of them each partition has, and the first totals."""
    for q, by in _runs(batches):
        found = [_unpack(blob) for _, blob in by[NAMES]]
        unique, at = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
        totals = [np.bincount(at, np.concatenate([f[k] for f in found]), len(unique)).astype(np.int64) for k in (1, 2)]
        end = np.cumsum([0] + [len(f[0]) for f in found])
        for (p, _), a, b in zip(by[NAMES], end[:-1], end[1:]):
            yield _rows([(q, ADDRESS, p, _pack(_least(at[a:b]))), (p, TOTALS, q, _pack(*(_least(x[at[a:b]]) for x in totals)))])
        yield _rows([(0, TALLY, q, np.array([0, 0, 0, ((unique >= SPLIT_NAME) & (totals[0] > 0)).sum(), 0, 0, 0], np.int64).tobytes())])


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """An owner adds up a sweep's sums and tells each partition the totals of its names."""
    for q, by in _runs(batches):
        at = [_unpack(blob)[0].astype(np.int64) for _, blob in by[ADDRESS]]
        total = np.zeros(max(int(a.max()) for a in at) + 1, np.int64)
        for a, (_, blob) in zip(at, by[SUMS]):  # both in the order of partitions; a partition has a name once
            total[a] += _unpack(blob)[0].astype(np.int64)
        yield _rows([(p, TOTALS, q, _pack(_least(total[a]))) for a, (p, _) in zip(at, by[ADDRESS])])


@dataclass
class State:
    """What all partitions know at the start of a sweep: the number of tables and of known words, and the discounts."""

    tables: float
    known: float
    discount: float
    root_discount: float


@dataclass
class Part:
    """A partition's pairs: word and context (place among the names) of each, customers, and the words' names plus one where split."""

    word: np.ndarray
    context: np.ndarray
    c: np.ndarray
    split: np.ndarray
    owner: np.ndarray
    edge: np.ndarray

    @staticmethod
    def of(blob: bytes) -> "Part":
        per, context, c, split, owner, edge = _unpack(blob)
        return Part(np.repeat(np.arange(len(per)), per), context.astype(np.int64), c.astype(np.int64), split.astype(np.int64), owner.view(np.int64), edge.astype(np.int64))

    def by_word(self, x: np.ndarray, totals: np.ndarray) -> np.ndarray:
        """Sums of x by word; totals has those of split words."""
        out = np.bincount(self.word, x, len(self.split)).astype(np.int64)
        return np.where(self.split > 0, totals[self.split - 1], out)


def stirling(d: float, most: int) -> np.ndarray:
    """Logarithms of the generalized Stirling numbers S(c, t) of discount d, for c and t up to `most`."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0.0
    t = np.arange(most + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        for c in range(most):
            stay = np.where(t <= c, np.log(np.maximum(c - d * t, 1e-300)) + out[c], -np.inf) if c else np.full(most + 1, -np.inf)
            new = np.concatenate([[-np.inf], out[c, :-1]])
            out[c + 1] = np.logaddexp(stay, new)
    return out


def resample(c: np.ndarray, t: np.ndarray, in_context: np.ndarray, in_parent: np.ndarray, state: State, s: Settings, table: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The tables of every dish drawn anew. in_context, in_parent: tables of the context, customers of the word in the parent, the dish's own included."""
    d, d0 = state.discount, state.root_discount
    out = np.minimum(c, 1)
    rest, others = (in_context - t).astype(np.float64), (in_parent - t).astype(np.float64)
    order = np.argsort(c, kind="stable")
    sizes, begin = np.unique(c[order], return_index=True)
    all_rest = s.root_strength + max(state.tables - 1.0, 0.0)
    for k, a, b in zip(sizes.tolist(), begin.tolist(), [*begin[1:].tolist(), len(order)]):
        if k < 2 or k > EXACT:
            continue
        j = np.arange(k)
        step = max(1, (1 << 19) // k)
        for i in (order[x : min(x + step, b)] for x in range(a, b, step)):
            one = np.log(s.strength + d * (rest[i, None] + j))
            one += np.log(np.maximum(others[i, None] + j - d0, (1 - d0) * 0.5) / (all_rest + j))
            weight = np.cumsum(one, axis=1) + table[k, 1 : k + 1]
            out[i] = 1 + np.argmax(weight - np.log(rng.standard_exponential(weight.shape)), axis=1)
    many = np.flatnonzero(c > EXACT)
    if len(many):
        out[many] = _many(c[many].astype(float), rest[many], others[many], all_rest, d, d0, s.strength, rng)
    return out


def stirling_step(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """log S(c, t + 1) - log S(c, t) for many customers, by the saddle point of their generating function:
    S(c, t) = c! / (t! d^t) [z^c] (1 - (1 - z)^d)^t, so that a table more is a factor (1 - (1 - z)^d) / (d t) at the z of (c, t)."""
    x = np.minimum(np.log(t * d / c) / (1 - d), -1e-9)  # the logarithm of 1 - z
    for _ in range(12):
        y, yd = np.exp(x), np.exp(d * x)
        f = np.log(t * d / c) + np.log1p(-y) - (1 - d) * x - np.log1p(-yd)
        slope = -y / (1 - y) - (1 - d) + d * yd / (1 - yd)
        x = np.clip(x - f / slope, 4 * x - 1, np.maximum(x / 4, -1e9))
        x = np.minimum(x, -1e-9)
    return np.log1p(-np.exp(d * x)) - np.log(d * t)


def _many(c: np.ndarray, rest: np.ndarray, others: np.ndarray, all_rest: float, d: float, d0: float, strength: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes with many customers. The odds of t + 1 against t tables fall with t, and are even at the mode.
    Few tables are drawn from these odds; many from the normal distribution of that mode and of the odds' slope there."""

    def odds(t: np.ndarray, i: np.ndarray | slice = slice(None)) -> np.ndarray:
        col = (lambda x: x[i][:, None]) if t.ndim > 1 else (lambda x: x[i])
        return stirling_step(col(c), t, d) + np.log(strength + d * (col(rest) + t)) + np.log(np.maximum(col(others) + t - d0, 1e-9) / (all_rest + t))

    low, high = np.zeros(len(c)), np.log(c - 1.0)
    for _ in range(40):
        middle = (low + high) / 2
        up = odds(np.exp(middle)) > 0
        low, high = np.where(up, middle, low), np.where(up, high, middle)
    mode = np.exp(low) + 0.5
    above, below = np.minimum(mode * 1.02, c - 1e-3), mode * 0.98
    slope = (odds(above) - odds(below)) / (above - below)
    out = np.clip(np.rint(mode + rng.standard_normal(len(c)) / np.sqrt(np.maximum(-slope, 1e-12))), 1, c)
    few = np.flatnonzero(mode < 48)
    for i in (few[k : k + 4096] for k in range(0, len(few), 4096)):
        weight = np.zeros((len(i), 160))
        weight[:, 1:] = np.cumsum(odds(np.arange(1.0, 160.0)[None, :], i), axis=1)
        out[i] = 1 + np.argmax(weight - np.log(rng.standard_exponential(weight.shape)), axis=1)
    return out.astype(np.int64)


def chances(part: Part, t: np.ndarray, customers: np.ndarray, tables: np.ndarray, state: State, s: Settings) -> np.ndarray:
    """The predictive probability of every pair; customers and tables are the totals by name."""
    m = part.by_word(t, tables)
    d, d0, all_tables = state.discount, state.root_discount, s.root_strength + state.tables
    root = np.where(m > 0, (m - d0) / all_tables, (s.root_strength + d0 * state.known) / all_tables)[part.word]
    own = np.maximum(part.c - d * t, 0.0) + (s.strength + d * tables[part.context]) * root
    return own / (s.strength + customers[part.context])


def _discount(ones: float, twos: float) -> float:
    return min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5


def _hot_words(rows: DataFrame) -> np.ndarray:
    """Hashes of the tokens with over one in HOT_SHARE of all: fewer than that, and only for where work goes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                token = tokens_of(words_of(part.column("text"), lower=True))[0]
                h, n = np.unique(token, return_counts=True)
                often = n * 2 * HOT_SHARE > len(token)
                yield pa.RecordBatch.from_arrays([pa.array(np.append(h[often].view(np.int64), 0)), pa.array(np.append(n[often], 0).astype(np.int64)), pa.array(np.append(np.zeros(often.sum(), np.int64), len(token)))], ["h", "n", "total"])

    counts = rows.select("text").mapInArrow(work, "h long, n long, total long").groupBy("h").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    counts = settled(counts, "counts")
    total = counts.agg(F.sum("total")).first()[0] or 0
    return np.sort(np.array([r.h for r in counts.filter(F.col("n") * HOT_SHARE > total).collect()], np.int64).view(np.uint64))


def hpyp_scores(docs: DataFrame, settings: Settings = Settings(), part_bytes: int = PART_BYTES, slice_bytes: int = SLICE) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of docs (doc_id, text)."""
    spark, s = docs.sparkSession, settings
    size = docs.agg(F.sum(F.octet_length("text") + 8)).first()[0] or 0
    parts = max(1, -(-size // part_bytes))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held.alias("held"))
    hot = spark.sparkContext.broadcast(_hot_words(rows))  # at most HOT_SHARE hashes
    count = max(2 * n, -(-size // slice_bytes))
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("doc_id", "text"), F.lit(count)))
    width = max(n, -(-size // (8 * slice_bytes)))

    def met(*tables: DataFrame) -> DataFrame:
        """The rows of one destination together, by kind and source."""
        out = tables[0]
        for t in tables[1:]:
            out = out.unionAll(t)
        return out.repartition(max(n, parts), "dest").sortWithinPartitions("dest", "kind", "src")

    def kind(table: DataFrame, *kinds: int) -> DataFrame:
        return table.filter(F.col("kind").isin(*kinds))

    def tally(*tables: DataFrame) -> np.ndarray:
        total = np.zeros(7, np.int64)
        for t in tables:
            for r in kind(t, TALLY).select("blob").toLocalIterator():  # a few numbers a partition
                total += np.frombuffer(r.blob, np.int64)
        return total

    dealt = rows.select("slice", "held", "text").repartition(width, "slice").sortWithinPartitions("slice").mapInArrow(_deal(parts, hot), BUS)
    data = settled(met(dealt).mapInArrow(_gather(parts, hot), BUS), "hpyp")
    owners = settled(met(kind(data, NAMES)).mapInArrow(_address, BUS), "owners")
    ones, twos, train, known, tables, single, double = tally(data, owners).tolist()
    discount = _discount(ones, twos)
    stirlings = spark.sparkContext.broadcast(stirling(discount, EXACT))
    states = [State(tables, known, discount, _discount(single, double))]
    drawn: list[DataFrame] = []
    totals = [kind(owners, TOTALS)]

    def sweep(k: int, state: State):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for p, by in _runs(batches):
                part = Part.of(by[STATIC][0][1])
                told = np.concatenate([_unpack(blob)[-1] for _, blob in by[TOTALS]]).astype(np.int64)
                t = _unpack(by[TABLES][0][1])[0].astype(np.int64) if TABLES in by else np.minimum(part.c, 1)
                parent = part.by_word(t, told)[part.word]
                t = resample(part.c, t, told[part.context], parent, state, s, stirlings.value, np.random.default_rng([s.seed, k, p]))
                sums = _sums(part.context, part.word, part.split, len(told), t)
                m = np.bincount(part.word, t, len(part.split))[part.split == 0]
                found = [0, 0, 0, 0, t.sum(), (m == 1).sum(), (m == 2).sum()]
                yield _rows([(p, TABLES, p, _pack(_least(t))), (0, TALLY, p, np.array(found, np.int64).tobytes())])
                yield _rows([(int(q), SUMS, p, _pack(_least(sums[a:b]))) for q, a, b in zip(part.owner, part.edge[:-1], part.edge[1:])])

        return work

    use = range(s.sweeps - s.averaged + 1, s.sweeps + 1)
    for k in range(1, s.sweeps + 1):
        before = [kind(drawn[-1], TABLES)] if drawn else []
        drawn.append(settled(met(kind(data, STATIC), totals[-1], *before).mapInArrow(sweep(k, states[-1]), BUS), "tables"))
        totals.append(settled(met(kind(owners, ADDRESS), kind(drawn[-1], SUMS)).mapInArrow(_answer, BUS), "totals"))
        more = tally(drawn[-1])
        states.append(State(int(more[4]), known, discount, _discount(int(more[5]), int(more[6]))))
        if k > 1 and k - 1 not in use:  # what only the next sweep needed
            drop(drawn[k - 2])
            drop(totals[k - 1])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, by in _runs(batches):
            part, later = Part.of(by[STATIC][0][1]), {}
            customers = np.concatenate([_unpack(blob)[0] for _, blob in by[TOTALS]]).astype(np.int64)
            for k in use:
                later[k] = np.concatenate([_unpack(blob)[0] for _, blob in by[100 * k + TOTALS]]).astype(np.int64)
            chance = sum(chances(part, _unpack(by[100 * k + TABLES][0][1])[0].astype(np.int64), customers, later[k], states[k], s) for k in use)
            log_p = np.log10(chance / len(use)).astype(np.float32).view(np.uint32)
            c_word = part.by_word(part.c, customers)
            for src, blob in by[PLACES]:
                at = np.cumsum(_unpack(blob)[0], dtype=np.int64)
                word = part.word[at]
                yield _rows([(src, 1, by[STATIC][0][0], _pack(log_p[at], _least(c_word[word[np.concatenate([[True], word[1:] != word[:-1]])]])))])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs_by_key(batches, ["slice"]):
            is_doc = run.column("kind").to_numpy() == 0
            own, answers = run.slice(0, int(is_doc.sum())), [_unpack(x.as_py()) for x in run.column("blob").slice(int(is_doc.sum()))]
            token, row, context = _sliced(own)
            _, pairs, pair, _ = pairs_of(token, context, parts, hot.value)
            log_p = np.concatenate([a[0] for a in answers]).view(np.float32).astype(np.float64)
            c = np.concatenate([a[1] for a in answers]).astype(np.float64)[(pairs >> BITS).astype(np.int64)]
            docs_, tokens = own.num_rows, np.bincount(row, minlength=own.num_rows)
            base = np.bincount(row, np.log10(c + 1)[pair], docs_) - tokens * np.log10(train + known + 1)
            cols = [own.column("doc_id"), own.column("held"), pa.array(tokens), pa.array(np.bincount(row, (c > 0)[pair], docs_).astype(np.int64)), pa.array(np.full(docs_, train)), pa.array(base), pa.array(np.bincount(row, log_p[pair], docs_))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    late = [t.withColumn("kind", F.col("kind") + 100 * k) for k in use for t in (kind(drawn[k - 1], TABLES), totals[k])]
    scored = met(kind(data, STATIC, PLACES), totals[0], *late).mapInArrow(score, BUS)
    texts = rows.select("slice", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("src"), F.lit(None).cast("binary").alias("blob"), "doc_id", "text", "held")
    answers = scored.select(F.col("dest").alias("slice"), "kind", "src", "blob", F.lit(None).cast("long"), F.lit(None).cast("string"), F.lit(None).cast("boolean"))
    both = texts.unionAll(answers).repartition(width, "slice").sortWithinPartitions("slice", "kind", "src")
    return both.mapInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
