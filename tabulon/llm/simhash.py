"""SimHash near-duplicate links by the generalised pigeonhole principle.

Fingerprints link at `radius` or fewer differing bits. The 64 bits are grouped into m parts, correlated bits together. If the parts'
thresholds add up to radius - m + 1, any linked pair agrees to within its threshold on at least one part. A dynamic programme
allots the thresholds (-1 leaves a part out) by estimated rows sent and candidates met. Each distinct fingerprint is sent once to
its own value of each part and to the values within the threshold (from one side of a pair only); each bucket is verified exactly
and gives a spanning forest of its links instead of all its pairs, so a group of g near copies gives at most g edges a bucket.

`similar_groups` serves pipelines: near copies by Jaccard similarity of word shingles, exact. First, links of SimHash fingerprints of
each text's distinct words, reduced in every bucket to each one's nearest neighbours and a minimum spanning forest by differing bits
(linear in the texts), are verified on the whole shingle sets; they join most of each group. Then a prefix filter meets every pair that
may still join two groups: with the shingles of all texts in one order, two sets at the similarity share one of the first
n - ceil(similarity * n) + 1 of each. The order (shingles that a sample shows to be frequent stand last) is only for speed. Of what
meets, only pairs of different groups that pass exact bounds (sizes, places in the order, parities of the sets in 512 bits) are
verified, all of them. Buckets of more than _SMALL texts wait until smaller ones have joined what they can.

Defined results: null or empty text has fingerprint zero, which links like any other; repeated rows share a fingerprint; an empty
table gives an empty result; other columns of the input are ignored whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import Scratch
from ._text import LOWER, NOT_SPACE, lean, mix, slices, span_hashes, utf8, words
from .components import component_roots

#: Seed of the shingle hash.
SEED = 42
#: Ids (16 MB) up to which a set of them is broadcast; larger sets are joined by shuffle.
BROADCAST_IDS = 2_000_000
#: Nearest fingerprints that each one is compared with in any case, besides the minimum spanning forest.
NEIGHBOURS = 6
#: Shingles whose bits are counted at once.
_BLOCK = 1 << 15
#: Members of a prefix bucket up to which its pairs are formed before larger ones' are.
_SMALL = 64
#: Words of 64 bits of a set's parities.
_PARITY = 8
#: One of so many documents is sampled for frequent shingles; counts in the sample from which they are; how many are broadcast.
_SAMPLED, _OFTEN, _FREQUENT = 32, 4, 1_000_000
#: Members of a bucket up to which all its pairs are compared at once; larger ones are first split by further bits.
_DENSE = 4096


def simhash_values(texts: list[bytes], k: int) -> np.ndarray:
    """Unsigned fingerprints of whole texts over k-word shingles, repeats included."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    votes = np.zeros((len(texts), 64), np.int64)
    sizes = np.zeros(len(texts), np.int64)
    held: list[int] = []
    marks: list[tuple[int, int]] = []

    def flush() -> None:
        if held:
            bits = np.unpackbits(np.array(held, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            first = [at for _, at in marks if at < len(held)]
            rows = [r for r, at in marks if at < len(held)]
            np.add.at(votes, rows, np.add.reduceat(bits, first, axis=0, dtype=np.int64))
        held.clear()
        marks.clear()

    for row, text in enumerate(texts):
        parts = text.lower().split()  # bytes: A-Z only, white space U+0020 and U+0009 to U+000D
        if not parts:
            continue
        joined = b" ".join(parts)
        if len(parts) <= k:
            hashes = [digest(joined, SEED)]
        else:
            lengths = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
            ends = np.cumsum(lengths)
            starts = (ends - lengths)[: len(parts) - k + 1].tolist()
            hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, (ends[k - 1 :] - 1).tolist(), strict=True)]
        sizes[row] = len(hashes)
        for at in range(0, len(hashes), _BLOCK):
            marks.append((row, len(held)))
            held += hashes[at : at + _BLOCK]
            if len(held) >= _BLOCK:
                flush()
    flush()
    return np.packbits(votes * 2 > sizes[:, None], axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4) -> DataFrame:
    """(doc_id long, fp long: the fingerprint's bits as a signed number) of each row."""

    def run(batches):
        for batch in batches:
            fp = simhash_values(batch.column(1).to_pylist(), k).astype(np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


@dataclass(frozen=True)
class Probe:
    """One part: its bits as a mask, its threshold, and the masks of bits to flip (all but the empty one)."""

    mask: int
    threshold: int
    flips: tuple[int, ...]


def bit_moments(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how many have bits i and j both set (64 x 64), over all of them."""

    def run(batches):
        total, n = np.zeros((64, 64)), 0
        for batch in batches:
            bits = np.unpackbits(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            for at in range(0, len(bits), 1 << 16):
                total += bits[at : at + (1 << 16)].T @ bits[at : at + (1 << 16)]
            n += len(bits)
        if n:
            i, j = np.triu_indices(64)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(i, 64)), pa.array(np.append(j, 64)), pa.array(np.append(total[i, j], n).astype(np.int64))], ["i", "j", "n"])

    both, n = np.zeros((64, 64)), 0
    for i, j, c in fps.select("fp").mapInArrow(run, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n")).collect():  # 2,081 rows at most
        if i == 64:
            n = c
        else:
            both[i, j] = both[j, i] = c
    return n, both


def _groups(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m parts of nearly equal size; each starts with the bit least tied to those before it and takes the bits most correlated with it."""
    p = both.diagonal() / max(n, 1)
    cov = both / max(n, 1) - np.outer(p, p)
    dev = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    tied = np.abs(cov / np.outer(dev, dev))
    np.fill_diagonal(tied, 0)
    free, parts = list(range(64)), []
    for k in range(m):
        size = len(free) // (m - k)
        part = [max(free, key=lambda b: tied[b, free].sum())]
        free.remove(part[0])
        while len(part) < size:
            best = max(free, key=lambda b: tied[b, part].sum())
            part.append(best)
            free.remove(best)
        parts.append(part)
    return parts


def _chance(part: list[int], n: int, both: np.ndarray) -> np.ndarray:
    """Chance that two fingerprints differ in 0, 1, 2, ... bits of a part: bits are taken in adjacent pairs with their joint distribution, pairs as independent."""
    out, p = np.ones(1), both.diagonal() / max(n, 1)
    for a, b in zip(part[::2], [*part[1::2], None][: len(part[::2])], strict=False):
        if b is None:
            step = np.array([p[a] ** 2 + (1 - p[a]) ** 2, 2 * p[a] * (1 - p[a])])
        else:
            p11 = both[a, b] / max(n, 1)
            p10, p01 = p[a] - p11, p[b] - p11
            p00 = 1 - p11 - p10 - p01
            same, far = p00**2 + p01**2 + p10**2 + p11**2, 2 * (p00 * p11 + p01 * p10)
            step = np.array([same, max(0.0, 1 - same - far), far])
        out = np.convolve(out, step)
    return out


def allot(n: int, both: np.ndarray, radius: int, pair_cost: float = 0.002) -> list[Probe]:
    """Parts and thresholds of least estimated cost: rows sent, plus pair_cost for each candidate pair (a row takes some 3 us, a pair some 5 ns). Exact for every outcome."""
    best: tuple[float, list[Probe]] | None = None
    for m in range(1, radius + 2):
        parts, need = _groups(n, both, m), radius - m + 1
        costs = []
        for part in parts:
            at = np.cumsum(_chance(part, n, both))
            rows = np.cumsum([1.0, *(_choose(len(part), t) / 2 for t in range(1, min(3, len(part)) + 1))])
            costs.append([0.0, *(n * rows[t] + pair_cost * n * n / 2 * at[t] for t in range(len(rows)))])  # thresholds -1, 0, 1, ...
        table = {0: (0.0, [])}
        for cost in costs:
            after: dict[int, tuple[float, list[int]]] = {}
            for total, (spent, chosen) in table.items():
                for t, c in enumerate(cost):
                    if (s := total + t) not in after or spent + c < after[s][0]:
                        after[s] = (spent + c, [*chosen, t - 1])
            table = after
        if (need + m) in table and (best is None or table[need + m][0] < best[0]):
            spent, chosen = table[need + m]
            best = (spent, [_probe(part, t) for part, t in zip(parts, chosen, strict=True) if t >= 0])
    if best is None:
        raise ValueError(f"no allotment for a radius of {radius}")
    return best[1]


def _choose(n: int, k: int) -> int:
    out = 1
    for i in range(k):
        out = out * (n - i) // (i + 1)
    return out


def _probe(part: list[int], t: int) -> Probe:
    flips = tuple(sum(1 << b for b in c) for size in range(1, t + 1) for c in combinations(sorted(part), size))
    return Probe(sum(1 << b for b in part), t, flips)


def _entries(fps: DataFrame, probes: list[Probe]) -> DataFrame:
    """(key, fp, fine, node, probe): a fingerprint under its own value of each part (probe false), and under near values (probe true).

    Of two values that differ, only the one whose highest differing bit is set probes the other. fine and node are passed on.
    """

    def run(batches):
        for batch in batches:
            every = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            passed = [batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2)]
            for at in range(0, len(every), 1 << 13):
                fp = every[at : at + (1 << 13)]
                keys, rows, roles = [], [], []
                for k, p in enumerate(probes):
                    own, salt = fp & np.uint64(p.mask), np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
                    keys.append(mix(own + salt))
                    rows.append(np.arange(len(fp)))
                    roles.append(np.zeros(len(fp), bool))
                    for flip in p.flips:
                        on = np.flatnonzero(own & np.uint64(1 << (flip.bit_length() - 1)))
                        keys.append(mix((own[on] ^ np.uint64(flip)) + salt))
                        rows.append(on)
                        roles.append(np.ones(len(on), bool))
                row = np.concatenate(rows)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(fp[row].view(np.int64)), *(pa.array(x[at : at + (1 << 13)][row]) for x in passed), pa.array(np.concatenate(roles))], ["key", "fp", "fine", "node", "probe"])

    return fps.select("fp", "fine", "node").mapInArrow(run, "key long, fp long, fine long, node long, probe boolean")


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and edges (a, b): the least node of each one's component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        if (label[a] == low).all() and (label[b] == low).all():
            return label
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label[label] != label).any():
            label = label[label]


class _Rows:
    """Entries of some buckets; edges among them are 2 x e arrays of their places."""

    def __init__(self, fp: np.ndarray, fine: np.ndarray, node: np.ndarray, radius: int, neighbours: int):
        self.fp, self.fine, self.node, self.radius, self.neighbours = fp, fine, node, radius, neighbours

    def reduce(self, edges: np.ndarray) -> np.ndarray:
        """As many edges as the nodes, or a few times as many: what is kept of each bucket's links."""
        return self._nearest(edges) if self.neighbours else self._spanning(edges)

    def _spanning(self, edges: np.ndarray) -> np.ndarray:
        """Edges that span the components of the edges; their ends need not be linked themselves."""
        _, at, flat = np.unique(self.node[edges], return_index=True, return_inverse=True)
        place, flat = edges.ravel()[at], flat.reshape(edges.shape)
        label = forest(len(place), flat[0], flat[1])
        away = np.flatnonzero(label != np.arange(len(place)))
        return np.stack([place[away], place[label[away]]])

    def _nearest(self, edges: np.ndarray) -> np.ndarray:
        """Of the edges, those of a minimum spanning forest by differing bits (of fp and fine), and of each node those to its nearest ones."""
        nodes, flat = np.unique(self.node[edges], return_inverse=True)
        flat = flat.reshape(edges.shape)
        far = np.bitwise_count(self.fp[edges[0]] ^ self.fp[edges[1]]) + np.bitwise_count(self.fine[edges[0]] ^ self.fine[edges[1]])
        label = np.arange(len(nodes))
        # Once for each end: the edge's place among the end's edges by distance, then by the other end.
        end, other, which = np.concatenate([flat[0], flat[1]]), np.concatenate([flat[1], flat[0]]), np.tile(np.arange(edges.shape[1]), 2)
        order = np.lexsort((other, np.tile(far, 2), end))
        new = np.ones(len(order), bool)
        new[1:] = (end[order][1:] != end[order][:-1]) | (other[order][1:] != other[order][:-1])  # the same pair from several buckets
        order = order[new]
        begins = np.flatnonzero(np.concatenate([[True], end[order][1:] != end[order][:-1]]))
        nth = np.arange(len(order)) - np.repeat(begins, np.diff(np.append(begins, len(order))))
        chosen = [which[order[nth < self.neighbours]]]
        for d in np.unique(far):
            at = np.flatnonzero(far == d)
            while True:
                at = at[label[flat[0, at]] != label[flat[1, at]]]
                if not len(at):
                    break
                pick = np.unique(np.concatenate([at[np.unique(label[flat[side, at]], return_index=True)[1]] for side in (0, 1)]))
                chosen.append(pick)
                label = forest(len(nodes), np.append(flat[0, pick], np.arange(len(nodes))), np.append(flat[1, pick], label))
        return edges[:, np.unique(np.concatenate(chosen))]

    def links(self, own: np.ndarray, probing: np.ndarray, depth: int = 0) -> list[np.ndarray]:
        """Reduced links among own, and between own and probing (places). Memory is linear in the members."""
        if len(own) > _DENSE and depth < 3 and self.radius < 12:
            # Linked pairs agree on one of radius + 1 groups of bits at least: compare within equal groups only.
            found, width = [], 64 // (self.radius + 1)
            for g in range(self.radius + 1):
                bits = range(g * width + 7 * depth, g * width + 7 * depth + (width if g < self.radius else 64 - self.radius * width))
                both = np.concatenate([own, probing])
                key = self.fp[both] & np.uint64(sum(1 << (b % 64) for b in bits))
                order = np.argsort(key, kind="stable")
                for run in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
                    if len(run) > 1 and (inside := own[run[run < len(own)]]).size:
                        found += self.links(inside, both[run[run >= len(own)]], depth + 1 if len(run) < 0.9 * len(both) else 3)
            return found
        found = []
        for side, triangle in ((own, True), (probing, False)):
            for at in range(0, len(side), 512):
                near = np.bitwise_count(self.fp[side[at : at + 512], None] ^ self.fp[own][None, :]) <= self.radius
                i, j = np.nonzero(near)
                if triangle:
                    keep = i + at < j
                    i, j = i[keep], j[keep]
                if len(i):
                    found.append(self.reduce(np.stack([side[at + i], own[j]])))
        return found


def _links(batches, radius: int, neighbours: int):
    """Batches of _entries sorted by key to edges (a, b: nodes), the reduced links of each bucket."""
    held: list[list[np.ndarray]] = []

    def settle(key, fp, fine, node, probe):
        rows, edges = _Rows(fp.view(np.uint64), fine.view(np.uint64), node, radius, neighbours), []
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(starts, len(key)))
        bucket = np.repeat(np.arange(len(starts)), sizes)
        big = sizes > 64
        small = np.flatnonzero(~big[bucket])
        k, f, p = bucket[small], rows.fp[small], probe[small]
        for step in range(1, 64):  # neighbours step places apart in the same bucket
            if len(k) <= step:
                break
            same = k[step:] == k[:-step]
            if not same.any():
                break
            i = np.flatnonzero(same & ~(p[step:] & p[:-step]))
            i = i[np.bitwise_count(f[i] ^ f[i + step]) <= radius]
            if len(i):
                edges.append(small[np.stack([i, i + step])])
        for b in np.flatnonzero(big):
            part = np.arange(starts[b], starts[b] + sizes[b])
            edges += rows.links(part[~probe[part]], part[probe[part]])
        if edges:
            out = node[rows.reduce(np.concatenate(edges, axis=1))]
            yield pa.RecordBatch.from_arrays([pa.array(out[0]), pa.array(out[1])], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        last = np.searchsorted(now[0], now[0][-1])
        if last:
            held.append([x[:last] for x in now])
            if sum(len(h[0]) for h in held) >= 50_000:
                yield from settle(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held = []
        held.append([x[last:] for x in now])
    if held:
        yield from settle(*(np.concatenate(x) for x in zip(*held, strict=True)))


def fingerprint_edges(fps: DataFrame, radius: int, neighbours: int = 0) -> DataFrame:
    """Rows (fp, fine, node: all long) to edges (a, b: nodes). Without neighbours they span each bucket's links; else see _Rows._nearest."""
    n, both = bit_moments(fps)
    entries = _entries(fps, allot(n, both, radius)).repartition("key").sortWithinPartitions("key")
    return entries.mapInArrow(lambda it: _links(it, radius, neighbours), "a long, b long")


def linked_fingerprints(fps: DataFrame, radius: int, scratch: Scratch) -> DataFrame:
    """Distinct fingerprints (fp long) to (a, b: the component's least), with the components of all pairs at radius or fewer differing bits."""
    nodes = fps.select("fp", F.lit(0).cast("long").alias("fine"), F.col("fp").alias("node"))
    return component_roots(fingerprint_edges(nodes, radius), scratch)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id long, fingerprint string, component_id long: the least doc_id reachable over links) of each row."""
    scratch = Scratch(docs.sparkSession, "simhash")
    each = scratch.save(fingerprints(docs, id_col, text_col, k), "fingerprints")
    classes = scratch.save(each.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = linked_fingerprints(classes, radius, scratch)
    rooted = classes.join(roots.select(F.col("a").alias("fp"), F.col("b").alias("root")), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    member = rooted.join(least, "root").select("fp", "component_id")
    return each.join(member, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _shingles(data: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes and shingle hashes of lower-cased texts, with the row of each. Fewer than k words are one shingle."""
    low = LOWER[data]
    starts, ends, first = words(low, offs, NOT_SPACE)
    each = span_hashes(low, starts, ends)
    count = np.diff(first)
    row = np.repeat(np.arange(len(count)), count)
    n = max(len(each) - k + 1, 0)
    grams = np.zeros(n, np.uint64)
    for j in range(k):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + each[j : j + n]
    inside = row[:n] == row[k - 1 : k - 1 + n]
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        whole = np.array([int(np.bitwise_xor.reduce(mix(each[first[r] : first[r + 1]] * np.arange(1, 2 * count[r], 2, dtype=np.uint64)))) for r in short], np.uint64)
        return each, row, np.concatenate([mix(grams[inside]), whole]), np.concatenate([row[:n][inside], short])
    return each, row, mix(grams[inside]), row[:n][inside]


def _unique(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], row[new]


def _majority(h: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """For each of n rows the bits that are set in over half of its hashes, as a signed number. Hashes stand by row."""
    votes, count = np.zeros((n, 64), np.int64), np.bincount(row, minlength=n)
    for at in range(0, len(h), _BLOCK):  # blocks, so that bits take bounded memory
        r = row[at : at + _BLOCK]
        bits = np.unpackbits(h[at : at + _BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        begins = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
        np.add.at(votes, r[begins], np.add.reduceat(bits, begins, axis=0, dtype=np.int64))
    return np.packbits(votes * 2 > count[:, None], axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64).view(np.int64)


def _frequent(texts: DataFrame, k: int) -> np.ndarray:
    """Sorted hashes of shingles that many documents of a sample hold: at most _FREQUENT."""

    def run(batches):
        for batch in batches:
            for a, b, data, offs in slices(batch, 0):
                g, _ = _unique(*_shingles(data, offs, k)[2:])
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64))], ["g"])

    some = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(_SAMPLED)) == 0).select("text").mapInArrow(run, "g long")
    found = some.groupBy("g").count().where(F.col("count") >= _OFTEN).orderBy(F.desc("count"), "g").limit(_FREQUENT).select("g").toPandas()
    return np.sort(found["g"].to_numpy(np.int64).view(np.uint64))


def _prefix_size(n: np.ndarray, similarity: float) -> np.ndarray:
    """How many of the first of n ordered members must be met: a set as similar shares at least similarity * n of them."""
    return n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1


def _features(docs: DataFrame, k: int, similarity: float, least: int, frequent: np.ndarray) -> DataFrame:
    """(doc_id, n: distinct shingles, s1 and s2: digest of the shingle set, fp and fine: SimHashes of the distinct words and of the shingle set,
    prefix: the first shingles of sets of `least` or more in the common order, parity: of how many shingles fall on each of 64 * _PARITY bits)."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def ordered(g: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        """g, sorted by row and hash, with each row's frequent ones last."""
        often = shared.value
        if not len(often) or not len(g):
            return g
        at = np.searchsorted(often, g)
        at[at == len(often)] = 0
        late = often[at] == g
        begin, before = np.searchsorted(row, np.arange(n + 1)), np.concatenate([[0], np.cumsum(late)])
        late_before = before[:-1] - before[begin[row]]
        rare = (begin[1:] - begin[:-1]) - (before[begin[1:]] - before[begin[:-1]])
        out = np.empty_like(g)
        out[np.where(late, begin[row] + rare[row] + late_before, np.arange(len(g)) - late_before)] = g
        return out

    def run(batches):
        for batch in batches:
            out, prefixes, parities = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for a, b, data, offs in slices(batch, 1):
                each, row, grams, gram_row = _shingles(data, offs, k)
                g, r = _unique(grams, gram_row)
                size = np.bincount(r, minlength=b - a)
                s1, s2 = np.zeros(b - a, np.uint64), np.zeros(b - a, np.uint64)
                np.add.at(s1, r, mix(g))
                other = mix(g + np.uint64(0x632BE59BD9B4E019))
                np.bitwise_xor.at(s2, r, other)
                fp, fine = _majority(*_unique(each, row), b - a), _majority(g, r, b - a)
                for x in range(0, b - a, 4096):
                    own = slice(*np.searchsorted(r, [x, min(x + 4096, b - a)]))
                    rows = min(4096, b - a - x)
                    bit = (r[own] - x) * (64 * _PARITY) + (other[own] % np.uint64(64 * _PARITY)).astype(np.int64)
                    odd = np.bincount(bit, minlength=rows * 64 * _PARITY).astype(np.uint8) & 1
                    parities.append(np.packbits(odd, bitorder="little").view("<i8"))
                first = np.cumsum(size) - size
                take = np.where(size >= least, _prefix_size(size, similarity), 0)
                prefixes.append(ordered(g, r, b - a)[np.arange(len(g)) - first[r] < take[r]].view(np.int64))
                out.append((size, s1.view(np.int64), s2.view(np.int64), fp, fine, take))
            columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 6
            ends = pa.array(np.concatenate([[0], np.cumsum(columns.pop())]).astype(np.int32))
            parity = pa.ListArray.from_arrays(pa.array(np.arange(0, _PARITY * batch.num_rows + 1, _PARITY, dtype=np.int32)), pa.array(np.concatenate(parities)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c.astype(np.int64)) for c in columns), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(prefixes))), parity], ["doc_id", "n", "s1", "s2", "fp", "fine", "prefix", "parity"])

    return docs.mapInArrow(lean(run), "doc_id long, n long, s1 long, s2 long, fp long, fine long, prefix array<long>, parity array<long>")


def _buckets(batches):
    """Batches sorted by their first column to lists of columns that hold whole buckets."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [c.flatten().to_numpy(zero_copy_only=False).reshape(-1, _PARITY) if pa.types.is_list(c.type) else c.to_numpy(zero_copy_only=False) for c in batch.columns]
        last = np.searchsorted(now[0], now[0][-1])
        if last:
            held.append([x[:last] for x in now])
            if sum(len(h[0]) for h in held) >= 100_000:
                yield [np.concatenate(x) for x in zip(*held, strict=True)]
                held = []
        held.append([x[last:] for x in now])
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _may(x: np.ndarray, y: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets can be as similar that share a member, by sizes and places in the order (size << 32 | place)."""
    n, m, i, j = x >> 32, y >> 32, x & 0xFFFFFFFF, y & 0xFFFFFFFF
    shared = np.minimum(i, j) + 1 + np.minimum(n - i, m - j) - 1
    return shared * (1 + similarity) >= similarity * (n + m) - 1e-6


def _met(batches, similarity: float):
    """(key, node, root, at) sorted by key to pairs (a, b) of different roots from buckets of up to _SMALL, and the rows of larger ones (key, a: node, at)."""
    for key, node, root, at in _buckets(batches):
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(starts, len(key)))
        bucket = np.repeat(np.arange(len(starts)), sizes)
        several = np.minimum.reduceat(root, starts) != np.maximum.reduceat(root, starts)
        big = np.flatnonzero((several & (sizes > _SMALL))[bucket])
        small = np.flatnonzero((several & (sizes <= _SMALL))[bucket])
        found, own = [], bucket[small]
        for step in range(1, _SMALL):
            same = own[step:] == own[:-step]
            if not same.any():
                break
            i = np.flatnonzero(same)
            x, y = small[i], small[i + step]
            fit = (root[x] != root[y]) & _may(at[x], at[y], similarity)
            found.append(np.stack([np.minimum(node[x], node[y])[fit], np.maximum(node[x], node[y])[fit]]))
        pairs = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((2, 0), np.int64)
        none = lambda n: pa.nulls(n, pa.int64())
        if pairs.shape[1]:
            yield pa.RecordBatch.from_arrays([none(pairs.shape[1]), pa.array(pairs[0]), pa.array(pairs[1]), none(pairs.shape[1])], ["key", "a", "b", "at"])
        if len(big):
            yield pa.RecordBatch.from_arrays([pa.array(key[big]), pa.array(node[big]), none(len(big)), pa.array(at[big])], ["key", "a", "b", "at"])


def _met_large(batches, similarity: float):
    """(key, node, root, at, parity) sorted by key to pairs (a, b) of different roots that may be as similar. Members of a bucket's largest group are compared with the others only."""
    for key, node, root, at, parity in _buckets(batches):
        starts, parity = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])), parity.view(np.uint64)
        for lo, hi in zip(starts, np.append(starts[1:], len(key)), strict=True):
            _, group, count = np.unique(root[lo:hi], return_inverse=True, return_counts=True)
            if len(count) < 2:
                continue
            order = lo + np.argsort(group == count.argmax(), kind="stable")
            others = len(order) - count.max()
            step = max(1, (1 << 20) // len(order))
            for begin in range(0, others, step):
                rows = order[begin : min(begin + step, others)]
                rest = order[begin + 1 :]
                fit = (root[rows][:, None] != root[rest]) & (np.arange(len(rows))[:, None] <= np.arange(len(rest))) & _may(at[rows][:, None], at[rest], similarity)
                i, j = np.nonzero(fit)
                x, y = rows[i], rest[j]
                apart = np.zeros(len(x), np.int64)
                for w in range(_PARITY):
                    apart += np.bitwise_count(parity[x, w] ^ parity[y, w])
                fit = apart * (1 + similarity) <= (1 - similarity) * ((at[x] >> 32) + (at[y] >> 32)) + 1e-6
                if fit.any():
                    x, y = node[x[fit]], node[y[fit]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])


def _sets(docs: DataFrame, k: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            values, sizes = [], []
            for a, b, data, offs in slices(batch, 1):
                _, _, grams, row = _shingles(data, offs, k)
                g, r = _unique(grams, row)
                values.append(g.view(np.int64))
                sizes.append(np.bincount(r, minlength=b - a))
            flat = np.concatenate(values) if values else np.zeros(0, np.int64)
            ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]) if sizes else np.zeros(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))], ["doc_id", "s"])

    return docs.mapInArrow(lean(run), "doc_id long, s array<long>")


def _long_parities(batches):
    """(doc_id, s) to (doc_id, n, q): parities of the set on two bits a member or more, a power of two of them; larger ones fold to smaller ones."""
    for batch in batches:
        offs = batch.column(1).offsets.to_numpy(zero_copy_only=False)
        flat, q = batch.column(1).values.to_numpy(zero_copy_only=False).view(np.uint64), [np.zeros(0, np.int64)]
        for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
            bits = 64 << max(0, (b - a - 1) // 32).bit_length()
            odd = np.bincount((flat[a:b] & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1
            q.append(np.packbits(odd, bitorder="little").view("<i8"))
        ends = np.cumsum([0, *map(len, q[1:])]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offs).astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(q)))], ["doc_id", "n", "q"])


def _close(batches, similarity: float):
    """(x, y, n: of both sets, qx, qy) to the (x, y) whose parities do not rule the similarity out."""
    for batch in batches:
        n = batch.column(2).to_numpy(zero_copy_only=False)
        (a, at), (b, bt) = ((c.values.to_numpy(zero_copy_only=False).view(np.uint64), c.offsets.to_numpy(zero_copy_only=False)) for c in (batch.column(3), batch.column(4)))
        keep = np.zeros(len(n), bool)
        for i in range(len(n)):
            u, v = a[at[i] : at[i + 1]], b[bt[i] : bt[i + 1]]
            size = min(len(u), len(v))
            u, v = (np.bitwise_xor.reduce(w.reshape(-1, size), axis=0) for w in (u, v))
            keep[i] = int(np.bitwise_count(u ^ v).sum()) * (1 + similarity) <= (1 - similarity) * n[i] + 1e-6
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["x", "y"]).filter(pa.array(keep))


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, similarity: float = 0.8, radius: int = 8) -> DataFrame:
    """(doc_id, keep_id: the least doc_id of its group) of each row. Groups are the components of verified edges at that Jaccard similarity of k-word shingle sets.

    Texts of one shingle set (exact copies among them, and all texts without words) are one group before any pair is formed.
    """
    scratch = Scratch(docs.sparkSession, "groups")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text"))
    # Sets of fewer members are as similar as that only if they are equal.
    least = int(similarity / (1 - similarity) + 1e-9)
    each = scratch.save(_features(texts, k, similarity, least, _frequent(texts, k)), "features")
    reps = scratch.save(each.groupBy("s1", "s2").agg(F.min("doc_id").alias("node"), F.min("fp").alias("fp"), F.min("fine").alias("fine"), F.min("n").alias("n")), "reps")
    able = reps.where(F.col("node").isNotNull() & (F.col("n") >= least))

    def verified(edges: DataFrame, name: str) -> DataFrame:
        """Of saved edges (x, y), those at the similarity."""
        ends = edges.select(F.col("x").alias("doc_id")).union(edges.select("y")).distinct()
        sets = scratch.save(_sets(texts.join(_few(ends), "doc_id", "left_semi"), k).dropDuplicates(["doc_id"]), f"sets_{name}")
        # Sets are long: only pairs that their parities leave open meet them.
        q = scratch.save(sets.mapInArrow(_long_parities, "doc_id long, n long, q array<long>"), f"parities_{name}")
        both = edges.join(q.select(F.col("doc_id").alias("x"), F.col("n").alias("nx"), F.col("q").alias("qx")), "x").join(q.select(F.col("doc_id").alias("y"), F.col("n").alias("ny"), F.col("q").alias("qy")), "y")
        both = both.select("x", "y", (F.col("nx") + F.col("ny")).alias("n"), "qx", "qy")
        edges = scratch.save(both.mapInArrow(lean(lambda it: _close(it, similarity)), "x long, y long"), f"open_{name}")
        shared = F.size(F.array_intersect("sx", "sy"))
        good = edges.join(sets.select(F.col("doc_id").alias("x"), F.col("s").alias("sx")), "x").join(sets.select(F.col("doc_id").alias("y"), F.col("s").alias("sy")), "y").where(shared >= similarity * (F.size("sx") + F.size("sy") - shared))
        good = scratch.save(good.select(F.col("x").alias("a"), F.col("y").alias("b")), f"good_{name}")
        scratch.drop(f"sets_{name}")
        return good

    def grouped(good: DataFrame, name: str) -> DataFrame:
        return component_roots(good, Scratch(docs.sparkSession, f"roots_{name}"))

    def rooted_as(frame: DataFrame, roots: DataFrame) -> DataFrame:
        return frame.join(roots.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").withColumn("root", F.coalesce("root", "node"))

    edges = scratch.save(fingerprint_edges(able, radius, NEIGHBOURS).select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct(), "candidates")
    good = verified(edges, "links")
    roots = grouped(good, "links")
    # What shares a shingle of both prefixes, in different groups.
    prefixes = rooted_as(able.select("node", "s1", "s2"), roots).withColumnRenamed("node", "doc_id").join(each.select("doc_id", "s1", "s2", "n", "prefix"), ["doc_id", "s1", "s2"])
    rows = prefixes.select(F.col("doc_id").alias("node"), "root", "n", F.posexplode("prefix").alias("place", "key")).select("key", "node", "root", (F.shiftleft("n", 32) + F.col("place")).alias("at"))
    met = scratch.save(rows.repartition("key").sortWithinPartitions("key").mapInArrow(lean(lambda it: _met(it, similarity)), "key long, a long, b long, at long"), "met")
    # A node's parities; rows of one doc_id are one document.
    parities = each.select("doc_id", "n", "parity").dropDuplicates(["doc_id"])
    pairs = met.where("b is not null").select(F.col("a").alias("x"), F.col("b").alias("y")).distinct()
    both = pairs.join(parities.select(F.col("doc_id").alias("x"), F.col("n").alias("nx"), F.col("parity").alias("px")), "x").join(parities.select(F.col("doc_id").alias("y"), F.col("n").alias("ny"), F.col("parity").alias("py")), "y")
    apart = sum((F.bit_count(F.col("px")[i].bitwiseXOR(F.col("py")[i])) for i in range(_PARITY)), F.lit(0))
    pairs = scratch.save(both.where(apart * (1 + similarity) <= (1 - similarity) * (F.col("nx") + F.col("ny")) + 1e-6).select("x", "y"), "pairs")
    if pairs.limit(1).count():
        good = good.union(verified(pairs, "pairs"))
        roots = grouped(good, "pairs")
    large = met.where("b is null").select("key", F.col("a").alias("node"), "at")
    if large.limit(1).count():
        rows = rooted_as(large, roots).join(parities.select(F.col("doc_id").alias("node"), "parity"), "node").select("key", "node", "root", "at", "parity")
        found = rows.repartition("key").sortWithinPartitions("key").mapInArrow(lambda it: _met_large(it, similarity), "x long, y long").distinct()
        found = scratch.save(found, "large")
        if found.limit(1).count():
            good = good.union(verified(found, "large"))
            roots = grouped(good, "large")
    rooted = reps.join(roots.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").select("s1", "s2", F.coalesce("root", "node").alias("keep_id"))
    return each.join(rooted, ["s1", "s2"]).select("doc_id", "keep_id")


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, similarity: float = 0.8, radius: int = 8) -> DataFrame:
    """One row of each group of similar_groups: that of the least doc_id. Rows of one doc_id are one document: of those the row of the least text
    stays (null last), whatever order they come in. Rows without an id are kept, as they cannot be told apart."""
    scratch = Scratch(docs.sparkSession, "copies")
    groups = scratch.save(similar_groups(docs, id_col, text_col, k, similarity, radius), "groups")
    lost = groups.where("doc_id <> keep_id").select(F.col("doc_id").alias(id_col)).distinct()
    kept = docs.join(_few(lost), id_col, "left_anti").select(*docs.columns)
    again = groups.where("doc_id = keep_id").groupBy(F.col("doc_id").alias(id_col)).count().where("count > 1").select(id_col)
    if not again.limit(1).count():
        return kept
    again = scratch.save(again, "again")
    return kept.join(_few(again), id_col, "left_anti").select(*docs.columns).unionAll(_least_text(kept.join(_few(again), id_col, "left_semi").select(*docs.columns), id_col, text_col))


def _least_text(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Of rows that share an id the one of the least text."""
    whole = F.struct(*(F.col(f"`{c}`") for c in rows.columns))
    least = F.min_by(whole, F.struct(F.col(text_col).isNull(), F.col(text_col), F.to_json(whole)))
    return rows.groupBy(F.col(id_col).alias("_id")).agg(least.alias("_row")).select("_row.*")


def _few(ids: DataFrame) -> DataFrame:
    """ids with a broadcast hint if they are counted to be few."""
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids
