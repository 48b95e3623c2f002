"""SentencePiece encoding by sampled segmentations, without replacement, and decoding.

A text's lattice has an edge for every vocabulary piece that matches at a position (spaces are read as the piece
mark, one is put in front; characters without a piece become one edge of byte pieces).  Pieces have probabilities:
the model's own if it is a unigram model; BPE models only rank their pieces, and 1 / (rank + ``SHIFT``) stands for
them.  A segmentation's probability is the product over its pieces, normalised over the lattice.

For each text the k segmentations with the largest Gumbel-perturbed log-probabilities are emitted, which
is sampling without replacement.  The search is best-first on the lattice's prefixes: a prefix's perturbed value is the
maximum over all its completions, so the best prefix leads straight to the best segmentation, and the edges
that it left aside stay in the frontier, those of one position as one entry, whose value is a Gumbel
variable truncated at its parent's.  Backward sums make all of this exact.  ``threshold`` is the best value that is left
after k, and ``inclusion`` = 1 - exp(-exp(log_prob - threshold)) the probability that the segmentation is among the first k.

Lattices fall apart where no piece spans two neighbouring characters, so sums and cumulative choices are computed once for each
distinct part within a slice of texts, by array operations.  All random numbers are hashes of the row's key and
of the place where they are used: results don't depend on batches, partitions or retries.

Decoding joins the pieces' bytes, turns marks into spaces and takes the one in front away; it gives the text back, byte by byte.

Null and empty texts have one segmentation without pieces.  Texts with fewer than k segmentations
give all they have.  Long texts are searched whole: a slice holds ``CHARS`` characters or one text.  Repeated keys give equal rows for equal
texts; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import heapq
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from . import vectext as V

K, SHIFT = 2, 10
CHARS = 4_000_000
STRETCH = 384
MARK = "▁"
_U = np.uint64


class Vocabulary:
    """Pieces of a model as a trie over character classes."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.bytes = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        scores = np.array([sp.get_score(i) for i in plain])
        ranks = scores.size and bool(np.all(scores <= 0)) and bool(np.all(scores == np.round(scores)))
        logp = -np.log(-scores + SHIFT) if ranks else scores
        least = float(logp.min()) - 1.0
        total = np.log(np.exp(logp).sum() + 256 * np.exp(least))
        self.byte_logp = least - total
        alphabet = sorted({c for i in plain for c in self.pieces[i]})
        self.cls = np.zeros(0x110000, np.uint16)
        for k, c in enumerate(alphabet):
            self.cls[ord(c)] = k + 1
        self.width = len(alphabet) + 1
        self.cls[32] = self.cls[ord(MARK)]
        self.cls[ord(MARK)] = 0  # the mark itself, written in a text, is kept apart from spaces
        edges: dict[int, int] = {}
        node_id, node_lp = [-1], [0.0]
        pairs = set()
        self.longest = 1
        back = {c: k + 1 for k, c in enumerate(alphabet)}
        for i, lp in zip(plain, logp - total, strict=True):
            at, cs = 0, [back[c] for c in self.pieces[i]]
            self.longest = max(self.longest, len(cs))
            pairs.update(zip(cs, cs[1:], strict=False))
            for c in cs:
                key = at * self.width + c
                if key not in edges:
                    edges[key] = len(node_id)
                    node_id.append(-1)
                    node_lp.append(0.0)
                at = edges[key]
            node_id[at], node_lp[at] = i, lp
        self.node_id, self.node_lp = np.array(node_id, np.int32), np.array(node_lp)
        self.step_bits = 19
        keys, to = np.array(list(edges), np.int64).astype(_U), np.array(list(edges.values()), np.int32)
        self.tables = []
        for salt in range(1, 12):
            slot = self._slot(keys, salt)
            _, first = np.unique(slot, return_index=True)
            k, t = np.full(1 << self.step_bits, -1, np.int64), np.zeros(1 << self.step_bits, np.int32)
            k[slot[first]], t[slot[first]] = keys[first].astype(np.int64), to[first]
            self.tables.append((k, t))
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, to = keys[rest], to[rest]
            if not len(keys):
                break
        self.root = np.zeros(self.width, np.int32)
        for c in range(1, self.width):
            self.root[c] = edges.get(c, 0)
        self.pair = np.zeros(1 << 22, bool)
        p = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        self.pair[self._pair(p[:, 0], p[:, 1])] = True

    def _slot(self, keys: np.ndarray, salt: int) -> np.ndarray:
        return ((keys * V.MULT[salt]) >> _U(64 - self.step_bits)).astype(np.int64)

    @staticmethod
    def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((a.astype(_U) * _U(65536) + b.astype(_U)) * V.MULT[20] >> _U(42)).astype(np.int64)

    def step(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Next trie nodes, 0 where there is none."""
        key = state.astype(np.int64) * self.width + c
        out = np.zeros(len(key), np.int32)
        todo = np.arange(len(key))
        for salt, (keys, to) in enumerate(self.tables, 1):
            at = self._slot(key[todo].astype(_U), salt)
            hit = keys[at] == key[todo]
            out[todo[hit]] = to[at[hit]]
            todo = todo[~hit & (keys[at] >= 0)]
            if not len(todo):
                break
        return out


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Lattices:
    """The distinct parts of some texts: each position's edges, and the probability of each edge given its position.

    Positions are renumbered by their distance to the part's end, so that backward sums take one array operation for each distance.
    """

    def __init__(self, vocab: Vocabulary, cps: np.ndarray, first: np.ndarray, length: np.ndarray):
        """cps: characters of all parts; first, length: where each part lies."""
        cls = vocab.cls[cps]
        n = len(cps)
        left = np.repeat(first + length, length) - np.arange(n)  # characters to the part's end
        order = np.argsort(left, kind="stable")
        rank = np.empty(n + 1, np.int64)
        rank[order] = np.arange(n)
        rank[n] = n
        self.vocab, self.cps = vocab, cps
        found = []
        alive, state = np.arange(n), vocab.root[cls]
        for k in range(vocab.longest):
            if k:
                ok = (left[alive] > k) & (state > 0)
                alive = alive[ok]
                if not len(alive):
                    break
                state = vocab.step(state[ok], cls[alive + k])
            piece = vocab.node_id[state]
            good = (state > 0) & (piece >= 0)
            found.append((alive[good], k + 1, piece[good], vocab.node_lp[state[good]]))
            if not k:
                bare = alive[~good]  # spelled with bytes: one, or several (-2)
                size = 1 + (cps[bare] > 0x7F).astype(int) + (cps[bare] > 0x7FF) + (cps[bare] > 0xFFFF)
                found.append((bare, 1, np.where(cps[bare] < 128, vocab.bytes[np.minimum(cps[bare], 127)], -2), size * vocab.byte_logp))
        count = np.zeros(n, np.int64)
        for at, *_ in found:
            count[rank[at]] += 1
        start = np.concatenate([[0], np.cumsum(count)])
        m = int(start[-1])
        self.size, self.id, self.pos = np.empty(m, np.int64), np.empty(m, np.int32), np.empty(m, np.int64)
        lp, to = np.empty(m), np.empty(m, np.int64)
        fill = start[:-1].copy()
        for at, size, piece, logp in found:
            r = rank[at]
            e = fill[r]
            fill[r] += 1
            self.size[e], self.id[e], self.pos[e], lp[e] = size, piece, at, logp
            to[e] = np.where(left[at] == size, n, rank[np.minimum(at + size, n)])
        total = np.zeros(n + 1)  # log of the sum over all completions of a position within its part
        prob = np.empty(m)
        bounds = np.searchsorted(left[order], np.arange(1, (int(left.max()) if n else 0) + 2))
        for x, y in zip(bounds[:-1], bounds[1:], strict=True):
            s, e = start[x], start[y]
            own = start[x:y] - s
            v = lp[s:e] + total[to[s:e]]
            top = np.maximum.reduceat(v, own)
            v = np.exp(v - np.repeat(top, count[x:y]))
            z = np.add.reduceat(v, own)
            total[x:y] = top + np.log(z)
            prob[s:e] = v / np.repeat(z, count[x:y])
        cum = prob.copy()
        rows = np.arange(n)
        for k in range(1, int(count.max()) if n else 0):
            rows = rows[count[rows] > k]
            cum[start[rows] + k] += cum[start[rows] + k - 1]
        cum[start[1:] - 1] = 2.0  # the last edge takes what rounding leaves
        self.prob, self.log, self.cum, self.start, self.rank = prob, np.log(prob), cum, start, rank
        self.first, self.length, self.left = first, length, left


def uniform(seed: np.ndarray, *where) -> np.ndarray:
    """Numbers in (0, 1) from a key and a place."""
    x = np.atleast_1d(np.array(seed, _U))
    for k, p in enumerate(where):
        x = x + np.atleast_1d(np.asarray(p, np.int64)).view(_U) * V.MULT[40 + k]
    x = V.mix(x)
    return ((x >> _U(11)).astype(np.float64) + 0.5) / float(1 << 53)


def draw(lat: Lattices, part: np.ndarray, seed: np.ndarray, place: np.ndarray, round_: int):
    """One ancestral sample of every occurrence of a part: its edges in text order, and where each occurrence begins."""
    n = len(part)
    pos = lat.first[part]
    end = pos + lat.length[part]
    seed = seed + place.view(_U) * V.MULT[39]
    steps = []
    count = np.zeros(n, np.int64)
    who = np.arange(n)
    k = 0
    while len(who):
        u = uniform(seed, np.int64(round_ * 1_000_003 + k))
        e = lat.start[lat.rank[pos]]
        more = np.flatnonzero(u >= lat.cum[e])
        while len(more):
            e[more] += 1
            more = more[u[more] >= lat.cum[e[more]]]
        steps.append((who, e))
        count[who] += 1
        pos = pos + lat.size[e]
        on = pos < end
        who, pos, end, seed = who[on], pos[on], end[on], seed[on]
        k += 1
    begin = np.concatenate([[0], np.cumsum(count)])
    edges = np.empty(begin[-1], np.int64)
    for k, (who, e) in enumerate(steps):
        edges[begin[who] + k] = e
    return edges, begin


def _seed(keys: list) -> np.ndarray:
    out = [hash_key(k) for k in keys]
    return np.array(out, _U)


def hash_key(key) -> int:
    text = repr(key).encode()
    return (zlib.crc32(text) << 32) | zlib.crc32(text[::-1] + b"#")


def sample_texts(vocab: Vocabulary, keys: list, texts: list[str], k: int):
    """For each text its samples: list of (ids, log_prob, perturbed, threshold)."""
    out: list[list] = [[] for _ in texts]
    at, some, size = 0, [], 0
    for i, t in enumerate(texts):
        if not t:
            out[i] = [(np.zeros(0, np.uint16), 0.0, 0.0, -np.inf)]
            continue
        some.append(i)
        size += len(t) + 1
        if size >= CHARS or i == len(texts) - 1:
            _sample_slice(vocab, keys, texts, some, k, out)
            some, size = [], 0
    if some:
        _sample_slice(vocab, keys, texts, some, k, out)
    return out


def _sample_slice(vocab, keys, texts, rows, k, out):
    joined = "".join(" " + texts[i] for i in rows)
    cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    ends = np.cumsum([len(texts[i]) + 1 for i in rows])
    cls = vocab.cls[cps]
    cut = np.ones(len(cps), bool)
    cut[1:] = ~vocab.pair[vocab._pair(cls[:-1], cls[1:])]
    cut[ends[:-1]] = True
    first = np.flatnonzero(cut)
    length = np.diff(np.append(first, len(cps)))
    up, down = V._powers_to(len(cps) + 1)
    total = np.zeros(len(cps) + 1, _U)
    np.cumsum(V.mix((cps + 1).astype(_U)) * up[: len(cps)], out=total[1:])
    h = (total[first + length] - total[first]) * down[first]
    _, pick, part = np.unique(h, return_index=True, return_inverse=True)
    # Characters of the distinct parts, one part after another.
    plen = length[pick]
    pfirst = np.concatenate([[0], np.cumsum(plen)[:-1]])
    source = np.repeat(first[pick] - pfirst, plen) + np.arange(plen.sum())
    lat = Lattices(vocab, cps[source], pfirst, plen)
    doc_part = np.searchsorted(first, np.concatenate([[0], ends]))
    doc_of = np.repeat(np.arange(len(rows)), np.diff(doc_part))
    place = np.arange(len(first)) - doc_part[:-1][doc_of]
    seeds = _seed([keys[i] for i in rows])
    draws = []
    for r in range(k):
        draws.append(draw(lat, part, seeds[doc_of], place, r))
    for d, i in enumerate(rows):
        out[i] = _search(lat, part, doc_part[d], doc_part[d + 1], draws, int(seeds[d]), k)


def _search(lat, part, a, b, draws, seed, k):
    """Best-first search for the k largest perturbed segmentations of the text with parts a..b."""

    def opened(path, g, skip, used):
        """Frontier values of a path: its positions' other edges (the first ``skip`` belong to its parent)."""
        logs = lat.log[path]
        before = np.cumsum(logs) - logs
        value = np.full(len(path), -np.inf)
        # An edge left aside behind a prefix of small probability can't come first: prefixes are looked at in
        # stretches until even a least exponential number could not lift the rest over the k-th best value.
        rest = 1.0 - lat.prob[path]
        on = np.flatnonzero(rest > 1e-15)
        on = on[np.searchsorted(on, skip) :]
        for x in range(0, len(on), STRETCH):
            some = on[x : x + STRETCH]
            e = -np.log(uniform(seed, some, np.int64(7919 + used)))
            value[some] = -np.logaddexp(-g, np.log(e) - before[some] - np.log(rest[some]))
            if x + STRETCH < len(on):
                have = np.partition(value[on[: x + STRETCH]], -(k + 1))[-(k + 1)]
                # the rest's values are below before + 37: an exponential number below e**-37 does not occur in 53 bits
                if before[on[x + STRETCH]] + 37 < have:
                    break
        return before, value, float(logs.sum())

    def drawn(round_, start):
        edges, bounds = draws[round_]
        return edges[bounds[start] : bounds[b]]

    results, heap, used = [], [], 0

    def admit(path, g, skip):
        """A path's result, and the best of its entries for the frontier; only k + 1 of them can matter."""
        before, value, logp = opened(path, g, skip, used)
        results.append((path, logp, g))
        top = np.argpartition(-value, k + 1)[: k + 1] if len(value) > k + 1 else np.arange(len(value))
        for j in top.tolist():
            if value[j] > -np.inf:
                heapq.heappush(heap, (-float(value[j]), used, j, path, float(before[j]), (int(path[j]),)))

    admit(drawn(0, a), -np.log(-np.log(float(uniform(seed, np.int64(1))[0]))), 0)
    while len(results) < k and heap:
        used += 1
        minus, _, j, path, base, gone = heapq.heappop(heap)
        g = -minus
        at = int(lat.pos[path[j]])
        row = lat.rank[at]
        weights = lat.prob[lat.start[row] : lat.start[row + 1]].copy()
        weights[np.array(gone) - lat.start[row]] = 0
        u = uniform(seed, np.arange(2), np.int64(104729 + used))
        c = np.cumsum(weights)
        pick = min(int(np.searchsorted(c, u[0] * c[-1], "right")), int(np.flatnonzero(weights)[-1]))
        edge = int(lat.start[row]) + pick
        # The rest of the divergence's own entry, with one more edge taken out.
        weights[pick] = 0
        mass = weights.sum()
        if mass > 1e-15:
            left_over = -np.logaddexp(-g, np.log(-np.log(u[1])) - (base + np.log(mass)))
            heapq.heappush(heap, (-float(left_over), used, j, path, base, (*gone, edge)))
        new = [edge]
        pos, end = at + int(lat.size[edge]), at + int(lat.left[at])
        while pos < end:
            e = int(lat.start[lat.rank[pos]])
            v = float(uniform(seed, np.int64(15485863 + used), np.int64(len(new)))[0])
            while v >= lat.cum[e]:
                e += 1
            new.append(e)
            pos += int(lat.size[e])
        head = path[:j]
        done = int((lat.left[lat.pos[head]] == lat.size[head]).sum())  # parts that the kept pieces finish
        admit(np.concatenate([head, new, drawn(min(used, k - 1), a + done + 1)]), g, j + 1)
    threshold = -heap[0][0] if heap else -np.inf
    return [(_ids(lat, path), logp, g, threshold) for path, logp, g in results]


def _ids(lat, path):
    ids = lat.id[path]
    if (ids == -2).any():
        parts = []
        for i, e in zip(ids.tolist(), path.tolist(), strict=True):
            parts += [i] if i >= 0 else lat.vocab.bytes[list(chr(lat.cps[lat.pos[e]]).encode("utf-8", "surrogatepass"))].tolist()
        ids = np.array(parts)
    return ids.astype(np.uint16 if len(lat.vocab.pieces) <= 65536 else np.uint32)


@lru_cache(maxsize=2)
def _spelled(vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all ids one after another, and where each id's begin (one more entry than ids)."""
    out = [piece.replace(MARK, " ").encode() for piece in vocab.pieces]
    for b, i in enumerate(vocab.bytes.tolist()):
        out[i] = bytes([b])
    return np.frombuffer(b"".join(out), np.uint8), np.cumsum([0, *map(len, out)])


def decode_bytes(vocab: Vocabulary, ids: np.ndarray) -> bytes:
    """The text of a list of ids, in UTF-8."""
    flat, begin = _spelled(vocab)
    first = begin[ids]
    size = begin[ids.astype(np.int64) + 1] - first
    ends = np.cumsum(size)
    if not len(ids):
        return b""
    return flat[np.repeat(first - ends + size, size) + np.arange(ends[-1])].tobytes()[1:]


def decode(vocab: Vocabulary, ids) -> str:
    """The text of a list of ids."""
    return decode_bytes(vocab, np.asarray(ids, np.int64)).decode("utf-8", "surrogatepass")


def _encoded(batches, path, k):
    vocab = vocabulary(path)
    names = ["doc_id", "sample", "ids", "n_pieces", "log_prob", "perturbed", "threshold", "decoded_crc32"]
    for whole in batches:
        for i in range(0, whole.num_rows, 1500):
            batch = whole.slice(i, 1500)
            keys = batch.column("doc_id").to_pylist()
            found = sample_texts(vocab, keys, [t or "" for t in batch.column("text").to_pylist()], k)
            rows = [(r, s, *x) for r, own in enumerate(found) for s, x in enumerate(own, 1)]
            who = pa.array([r[0] for r in rows], pa.int64())
            cols = [batch.column("doc_id").take(who), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2].tobytes() for r in rows], pa.binary()), pa.array([len(r[2]) for r in rows], pa.int64())]
            decoded = pa.array([zlib.crc32(decode_bytes(vocab, r[2])) for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([*cols, *(pa.array([float(r[c]) for r in rows], pa.float64()) for c in (3, 4, 5)), decoded], names)


def sample_segmentations(docs: DataFrame, model: str, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, sample`` (from 1), ``ids`` (little-endian 16-bit numbers), ``n_pieces, log_prob, perturbed, threshold, inclusion``,
    and ``decoded_crc32`` of what the ids decode to.
    """
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = rows.mapInArrow(lambda it: _encoded(it, model, k), f"doc_id {kind}, sample int, ids binary, n_pieces long, log_prob double, perturbed double, threshold double, decoded_crc32 long")
    return found.withColumn("inclusion", 1 - F.exp(-F.exp(F.col("log_prob") - F.col("threshold"))))


def _decoded(batches, path):
    vocab = vocabulary(path)
    for batch in batches:
        kept = [c for c, n in zip(batch.columns, batch.schema.names, strict=True) if n != "ids"]
        names = [n for n in batch.schema.names if n != "ids"]
        texts = [None if b is None else decode(vocab, np.frombuffer(b, np.uint16)) for b in batch.column("ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string())], [*names, "text"])


def decode_rows(encoded: DataFrame, model: str, id_col: str = "doc_id") -> DataFrame:
    """``doc_id, text`` of rows with ``ids``."""
    ship(encoded.sparkSession)
    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(F.col(id_col).alias("doc_id"), "ids").mapInArrow(lambda it: _decoded(it, model), f"doc_id {kind}, text string")
