"""Exact near-duplicate classes by a grouped prefix join on Jaccard similarity.

A document's set holds its distinct five-word shingles as 64-bit hashes. Equal
sets are one node. The tokens of a set are put in a global order, frequent ones
last, and its prefix is indexed: two sets that link must share a token of their
prefixes. Nodes of one prefix and size are collapsed into a group, which stands
in a token's run once, however many members it has. Pairs of groups are filtered
by size and position; those that stay are expanded to pairs of members, which
are filtered by their sketches and verified on the whole sets. Members of one
group are paired where its first token is.

Runs and groups of more than ``SHORT_RUN`` nodes are not paired up at once. Their
nodes are first compared with a pivot of their size; the links found so far give
classes; and only where a run still holds several classes are nodes outside its
largest class compared with those of other classes, in blocks, again groups
first: a node's nearest few by sketch, and in the last round all that are left.
Runs of the same nodes count once. A pair is thus skipped only if both are in
one class already, so the classes are exact.

The list of frequent tokens (at most ``FREQUENT``) only chooses the order; any
list gives the same classes. Runs know a token by its bucket and 32 bits; tokens
that agree in both by chance only add pairs, which are not verified. A sketch
has a bit for each of as many classes of tokens as the set is large, about: sets
that differ in d tokens have sketches that differ in d bits at most, so a pair
beyond the largest difference of a link is no link. Only texts of pairs that
stay are fetched, by a fixed-size bitmap first.

Defined results: null texts and texts without words have an empty set, link
with nothing and are their own component; repeated rows and copies share a
node; rows with null doc_id take part, and a component of such rows alone has
a null id; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels
from .common import blocks, discard, mapped, stored, utf8

SHINGLE = 5
#: Links need 100 * intersection >= 75 * union; kept as a fraction.
NUMERATOR, DENOMINATOR = 3, 4
#: Tokens that are put last in the order, at most; which ones: those of most documents.
FREQUENT = 1 << 19
#: A token is reported by a task if it has it so often, and frequent if the reports add up to so much.
SEEN, OFTEN = 2, 6
#: Tokens that a task counts at a time.
COUNTED = 1 << 21
#: Bits of a sketch at least; a power of two, as all sketches' bits are.
SKETCH = 1024
SHORT_RUN = 8
#: Pairs of a node with other classes in each round; the last round takes all.
ROUNDS = (2, 16, None)
#: Index rows in a task, about, and nodes in a block of a long run.
INDEX_ROWS, RUN_BLOCK = 1_000_000, 512
#: Bits of the map that says which texts may be wanted; 4 MB for any input.
WANTED_BITS = 1 << 25
#: Sets that may share half of their 128-bit names; far more than chance gives.
SHARED = 10_000
#: Bytes of sketches that are compared at once.
COMPARED = 1 << 23

_SIGNED = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("hash", pa.int64()), ("check", pa.int64()), ("node", pa.int64()), ("twin", pa.int64()), ("n", pa.int64()), ("sketch", pa.binary())])


def token_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, ascending."""
    words, at = kernels.words_of(texts, kernels.SPACED_WORD)
    grams = kernels.shingle_hashes(words, SHINGLE)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= SHINGLE:
            own = np.sort(grams[a : b - SHINGLE + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        else:
            out.append(kernels.shingle_hashes(words[a:b], b - a) if b > a else grams[:0])
    return out


def names_of(tokens: np.ndarray) -> tuple[int | None, int | None]:
    """A set's name of 128 bits in two halves; None for the empty set."""
    if not len(tokens):
        return None, None
    digest = hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def node_of(tokens: np.ndarray, shared: frozenset[int] = frozenset()) -> int | None:
    """The first half of a set's name, or the second where sets are known to share the first."""
    node, twin = names_of(tokens)
    return twin if node in shared else node


def sketch_bits(n: int) -> int:
    """Bits of the sketch of a set of n."""
    return max(SKETCH, 1 << max(0, n - 1).bit_length())


def sketch_of(tokens: np.ndarray, bits: int = 1024) -> bytes:
    """A bit for each of so many classes of tokens: whether the set has an odd number of them."""
    held = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((held & 1).astype(bool)).tobytes()


def folded(sketches: np.ndarray, words: int) -> np.ndarray:
    """Rows of sketches cut to so many 64-bit words: classes that agree in their low bits become one."""
    while sketches.shape[1] > words:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def _unseen(seen: set, name) -> bool:
    """Whether a task meets a name for the first time, or so long after the last that it has forgotten."""
    if name is None or name in seen:
        return False
    if len(seen) >= 500_000:
        seen.clear()
    seen.add(name)
    return True


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kind 0: a row for each document, with the sketch once a node. Kind 1: tokens that this task has seen often (node: the token, n: how often)."""
    held, size, seen = [], 0, set()

    def often() -> pa.RecordBatch:
        token, count = np.unique(np.concatenate(held), return_counts=True)
        token, count = token[count >= SEEN], count[count >= SEEN]
        return pa.RecordBatch.from_arrays([pa.array(np.ones(len(token), np.int32)), pa.nulls(len(token), pa.int64()), pa.nulls(len(token), pa.int64()), pa.nulls(len(token), pa.int64()), pa.array(token.view(np.int64)), pa.nulls(len(token), pa.int64()), pa.array(count.astype(np.int64)), pa.nulls(len(token), pa.binary())], schema=_SIGNED)

    for batch in batches:
        texts = utf8(batch.column("text"))
        for part in blocks(map(len, texts)):
            sets = token_sets(texts[part])
            ids, hashes, checks = (batch.column(c).slice(part.start, len(sets)) for c in ("doc_id", "hash", "check"))
            names, sketches = [names_of(s) for s in sets], []
            for name, tokens in zip(names, sets):
                sketches.append(sketch_of(tokens, sketch_bits(len(tokens))) if _unseen(seen, None if name[0] is None else name) else None)
            nodes, twins = zip(*names)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(sets), np.int32)), ids, hashes, checks, pa.array(nodes, pa.int64()), pa.array(twins, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(sketches, pa.binary())], schema=_SIGNED)
            held += sets
            size += sum(map(len, sets))
            if size >= COUNTED:
                yield often()
                held, size = [], 0
    if size:
        yield often()


def prefix_length(n):
    """Tokens of a set of n that have to be indexed."""
    return n - (NUMERATOR * n + DENOMINATOR - 1) // DENOMINATOR + 1


def ordered(tokens: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Rare tokens by value, then frequent ones (``frequent``: ascending tokens, a class of each) by class and value."""
    listed, classes = frequent
    if not len(listed):
        return tokens
    at = np.minimum(np.searchsorted(listed, tokens), len(listed) - 1)
    late = listed[at] == tokens
    last = np.lexsort((tokens[late], classes[at[late]]))
    return np.concatenate([tokens[~late], tokens[late][last]])


def _small(numbers: np.ndarray) -> bytes:
    """Numbers from 0 in two bytes each where all fit, else in four."""
    return numbers.astype(np.uint16 if not len(numbers) or numbers.max() < 1 << 16 else np.uint32).tobytes()


def _numbers(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(blob, np.uint16 if len(blob) == 2 * n else np.uint32)


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for so many, then the same from starts[1], and so on."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + counts, counts)


def _index_rows(frequent, buckets: int, shared: frozenset[int] = frozenset()):
    """Blobs of index rows for each bucket of tokens: 32 bits of the token, position and group; and the groups with name, size and members."""

    def emit(rows: list[tuple[np.ndarray, int, int]]) -> Iterator[pa.RecordBatch]:
        place: dict[int, int] = {}
        prefixes, of = [], []
        for prefix, _, n in rows:
            name = int.from_bytes(hashlib.blake2b(prefix.tobytes() + n.to_bytes(8, "little"), digest_size=8).digest(), "little")
            if name not in place:
                place[name] = len(prefixes)
                prefixes.append((prefix, n))
            of.append(place[name])
        names, sizes = np.array(list(place), np.uint64), np.array([n for _, n in prefixes], np.uint32)
        by = np.argsort(of, kind="stable")
        members = np.array([r[1] for r in rows], np.int64)[by]
        counts = np.bincount(of, minlength=len(prefixes))
        starts = np.cumsum(counts) - counts
        token = np.concatenate([p for p, _ in prefixes])
        length = np.array([len(p) for p, _ in prefixes])
        group = np.repeat(np.arange(len(prefixes)), length)
        position = _ranges(np.zeros(len(prefixes), np.int64), length)
        bucket = (token % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((token, bucket))
        ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
        numbers, blobs = [], []
        for b in range(buckets):
            at = order[ends[b] : ends[b + 1]]
            if len(at):
                used, local = np.unique(group[at], return_inverse=True)
                numbers.append(b)
                blobs.append(((token[at] >> np.uint64(32)).astype(np.uint32).tobytes(), _small(position[at]), _small(local), names[used].tobytes(), sizes[used].tobytes(), _small(counts[used]), members[_ranges(starts[used], counts[used])].tobytes()))
        columns = list(zip(*blobs)) or [()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), *(pa.array(c, pa.binary()) for c in columns)], names=["bucket", "token", "position", "local", "grp", "size", "members", "node"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, seen = [], 0, set()
        for batch in batches:
            texts = utf8(batch.column("text"))
            for part in blocks(map(len, texts)):
                for tokens in token_sets(texts[part]):
                    n = len(tokens)
                    node = node_of(tokens, shared)
                    if _unseen(seen, node):
                        rows.append((ordered(tokens, frequent.value)[: prefix_length(n)], node, n))
                        held += prefix_length(n)
                if held >= 400_000:
                    yield from emit(rows)
                    rows, held = [], 0
        if rows:
            yield from emit(rows)

    return run


_INDEX = "bucket long, token binary, position binary, local binary, grp binary, size binary, members binary, node binary"
_FOUND = "kind int, run long, a long, b long, n long"


def may_link(n1, p1, n2, p2):
    """Size and position filters for two sets that share the token at p1 and p2."""
    least = -(-NUMERATOR * (n1 + n2) // (NUMERATOR + DENOMINATOR))
    small, large = np.minimum(n1, n2), np.maximum(n1, n2)
    return (DENOMINATOR * small >= NUMERATOR * large) & (p1 <= n1 - least) & (p2 <= n2 - least)


def _found(kind: int, run, a, b, n) -> pa.RecordBatch:
    size = len(a)
    fill = lambda x: pa.nulls(size, pa.int64()) if x is None else pa.array(np.asarray(x, np.int64))
    return pa.RecordBatch.from_arrays([pa.array(np.full(size, kind, np.int32)), fill(run), fill(a), fill(b), fill(n)], names=["kind", "run", "a", "b", "n"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kind 0: pairs of nodes to verify. Kind 1: the nodes (a) of long runs, with their groups (b) and sizes (n)."""
    parts = []
    for batch in batches:
        for row in batch.to_pylist():
            token, name = np.frombuffer(row["token"], np.uint32), np.frombuffer(row["grp"], np.uint64)
            parts.append((token, _numbers(row["position"], len(token)), _numbers(row["local"], len(token)), name, np.frombuffer(row["size"], np.uint32), _numbers(row["members"], len(name)), np.frombuffer(row["node"], np.int64)))
    if not parts:
        return
    # Groups of one name from several tasks are one, with the members of all.
    names, first, group_of = np.unique(np.concatenate([p[3] for p in parts]), return_index=True, return_inverse=True)
    size = np.concatenate([p[4] for p in parts])[first].astype(np.int64)
    before = np.cumsum([0, *(len(p[3]) for p in parts)])
    token, position = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]).astype(np.int64)
    group = np.concatenate([group_of[x + p[2]] for x, p in zip(before, parts)])
    owner, node = np.repeat(group_of, np.concatenate([p[5] for p in parts])), np.concatenate([p[6] for p in parts])
    del parts
    by = np.lexsort((node, owner))
    owner, node = owner[by], node[by]
    new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (node[1:] != node[:-1])])
    owner, node = owner[new], node[new]
    members = np.bincount(owner, minlength=len(names))
    at = np.cumsum(members) - members
    by = np.lexsort((position, group, token))
    token, position, group = token[by], position[by], group[by]
    new = np.concatenate([[True], (token[1:] != token[:-1]) | (group[1:] != group[:-1])])
    token, position, group = token[new], position[new], group[new]

    def expanded(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of members of pairs of groups."""
        count = members[a] * members[b]
        of, k = np.repeat(np.arange(len(a)), count), _ranges(np.zeros(len(a), np.int64), count)
        return node[at[a][of] + k // members[b][of]], node[at[b][of] + k % members[b][of]]

    pairs = []
    inner = np.unique(group[position == 0])
    inner = inner[members[inner] > 1]  # pairs within a group
    few = inner[members[inner] <= SHORT_RUN]
    pairs.append(expanded(few, few))
    start = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    length = np.diff(np.append(start, len(token)))
    weight = np.add.reduceat(members[group], start)
    kept = []
    for m in range(2, SHORT_RUN + 1):
        own = start[(length == m) & (weight <= SHORT_RUN)]
        if not len(own):
            continue
        i, j = np.triu_indices(m, 1)
        left, right = (own[:, None] + i).ravel(), (own[:, None] + j).ravel()
        ok = may_link(size[group[left]], position[left], size[group[right]], position[right])
        kept.append((group[left[ok]], group[right[ok]]))
        if sum(len(p[0]) for p in kept) > 2_000_000:
            kept = [_distinct(kept)]
    if kept:
        pairs.append(expanded(*_distinct(kept)))
    mark = np.add.reduceat(kernels.mix(node.view(np.uint64)), at)  # of a group, by its members
    long = (length > 1) & (weight > SHORT_RUN)
    name = np.add.reduceat(mark[group], start)[long]  # of a run, by its nodes
    _, once = np.unique(name, return_index=True)
    runs = [(run, group[s : s + m]) for run, s, m in zip(name[once].tolist(), start[long][once].tolist(), length[long][once].tolist())]
    runs += [(int(mark[g]), np.array([g])) for g in inner[members[inner] > SHORT_RUN].tolist()]
    for run, own in runs:
        inside = node[_ranges(at[own], members[own])]
        sizes, groups = (np.repeat(x[own], members[own]) for x in (size, names.view(np.int64)))
        pairs.append(_with_pivots(inside, sizes))
        yield _found(1, np.full(len(inside), run, np.uint64).view(np.int64), inside, groups, sizes)
        if sum(len(p[0]) for p in pairs) > 2_000_000:
            pairs = [_distinct(pairs)]
    a, b = _distinct(pairs)
    yield _found(0, None, a, b, None)


def _with_pivots(node: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node with the smallest of its band of sizes, and those of neighbouring bands with one another."""
    band = np.floor(np.log(size) / np.log(DENOMINATOR / NUMERATOR)).astype(np.int64)
    by = np.lexsort((node, band))
    node, size, band = node[by], size[by], band[by]
    first = np.flatnonzero(np.concatenate([[True], band[1:] != band[:-1]]))
    pivot = np.repeat(first, np.diff(np.append(first, len(band))))
    a, b = np.concatenate([pivot, first[:-1]]), np.concatenate([np.arange(len(node)), first[1:]])
    ok = may_link(size[a], 0, size[b], 0) & (a != b)
    return node[a[ok]], node[b[ok]]


def _distinct(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    a, b = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
    a, b = np.minimum(a, b), np.maximum(a, b)
    a, b = a[a != b], b[a != b]
    by = np.lexsort((b, a))
    a, b = a[by], b[by]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, bool)
    return a[new], b[new]


def _texts(wanted):
    """hash, check, packed: texts whose hash the map ``wanted`` may hold, compressed, once a task as a rule."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            place = batch.column("hash").to_numpy() & (len(wanted.value) * 8 - 1)
            held = pa.array((wanted.value[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1)
            hashes, checks, texts = batch.column("hash").filter(held).to_pylist(), batch.column("check").filter(held).to_pylist(), utf8(batch.column("text").filter(held))
            own = [i for i, h in enumerate(zip(hashes, checks)) if _unseen(seen, h)]
            yield pa.RecordBatch.from_pydict({"hash": pa.array([hashes[i] for i in own], pa.int64()), "check": pa.array([checks[i] for i in own], pa.int64()), "packed": pa.array([squeeze(texts[i]) for i in own], pa.binary())})

    return run


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose sets, made again from both texts, are similar enough."""
    unpack = zstandard.ZstdDecompressor().decompress
    known: dict[int, np.ndarray] = {}

    def tokens_of(nodes: list[int], packed: list[bytes]) -> list[np.ndarray]:
        fresh = {n: p for n, p in zip(nodes, packed) if n not in known}
        if sum(map(len, known.values())) > 1 << 21:
            known.clear()
            fresh = dict(zip(nodes, packed))
        known.update(zip(fresh, token_sets([unpack(p) for p in fresh.values()])))
        return [known[n] for n in nodes]

    for batch in batches:
        a, b, x, y = (batch.column(c).to_pylist() for c in ("a", "b", "x", "y"))
        keep = []
        for part in blocks(map(len, x), 1 << 17):
            both = tokens_of(a[part] + b[part], x[part] + y[part])
            half = len(both) // 2
            for one, two in zip(both[:half], both[half:]):
                if len(one) > len(two):
                    one, two = two, one
                shared = int((two[np.minimum(np.searchsorted(two, one), len(two) - 1)] == one).sum())
                keep.append(DENOMINATOR * shared >= NUMERATOR * (len(one) + len(two) - shared))
        keep = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_pydict({c: batch.column(c).filter(keep) for c in ("a", "b")})


def far_apart(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of sketches (rows) and sums of sizes: the bits that differ, and whether they are too many for a link.

    A link shares three sevenths of the sizes' sum at least, so the sets differ in a seventh of it at most.
    """
    differ = np.bitwise_count(x ^ y).sum(axis=1).astype(np.int64)
    return differ, differ * (NUMERATOR + DENOMINATOR) > (DENOMINATOR - NUMERATOR) * n


class Sketches:
    """Sketches of different lengths, by rows; compared pair by pair at the shorter length."""

    def __init__(self, sketches: list[bytes]):
        self.words = np.array([len(x) // 8 for x in sketches], np.int64)
        self.row = np.zeros(len(sketches), np.int64)  # among those of its length
        self.own: dict[int, np.ndarray] = {}
        for w in np.unique(self.words).tolist():
            rows = np.flatnonzero(self.words == w)
            self.row[rows] = np.arange(len(rows))
            self.own[w] = np.frombuffer(b"".join(sketches[i] for i in rows.tolist()), np.uint64).reshape(len(rows), w)
        self.cut: dict[tuple[int, int], np.ndarray] = {}

    def _at(self, length: int, words: int) -> np.ndarray:
        if (length, words) not in self.cut:
            self.cut[length, words] = folded(self.own[length], words)
        return self.cut[length, words]

    def far_apart(self, i: np.ndarray, j: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As above, for pairs of rows."""
        differ, far = np.zeros(len(i), np.int64), np.zeros(len(i), bool)
        lengths = np.stack([self.words[i], self.words[j]])
        for x, y in np.unique(lengths, axis=1).T.tolist():
            pairs = np.flatnonzero((lengths[0] == x) & (lengths[1] == y))
            least = min(x, y)
            one, two = self._at(x, least), self._at(y, least)
            for k in range(0, len(pairs), step := max(1, COMPARED // (8 * least))):
                part = pairs[k : k + step]
                differ[part], far[part] = far_apart(one[self.row[i[part]]], two[self.row[j[part]]], n[part])
        return differ, far


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, n = batch.column("x").to_pylist(), batch.column("n").to_numpy()
        keep = []
        for part in blocks(map(len, x), COMPARED):
            m = part.stop - part.start
            sketches = Sketches(x[part] + batch.column("y").slice(part.start, m).to_pylist())
            keep.append(~sketches.far_apart(np.arange(m), np.arange(m, 2 * m), n[part])[1])
        keep = pa.array(np.concatenate(keep) if keep else [], pa.bool_())
        yield pa.RecordBatch.from_pydict({c: batch.column(c).filter(keep) for c in ("a", "b")})


def both_sides(pairs: DataFrame, nodes: DataFrame, column: str) -> DataFrame:
    """Pairs (a, b) with ``column`` of both nodes as x and y. Always by a shuffle, so that the plan is the same at every size."""
    side = lambda end, name: nodes.select(F.col("node").alias(end), F.col(column).alias(name), F.col("n").alias(f"n{name}")).hint("merge")
    return pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")


def near_pairs(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs whose sketches allow a link."""
    met = both_sides(pairs, nodes, "sketch").select("a", "b", "x", "y", (F.col("nx") + F.col("ny")).alias("n"))
    return stored(met.transform(mapped, _near, "a long, b long"), "pairs")


def ends_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()


def texts_of(wanted: DataFrame, hashed: DataFrame) -> DataFrame:
    """node, packed, n: a text of each node of ``wanted`` (node, hash, check), from ``hashed`` (hash, check, text).

    The map of the wanted hashes has WANTED_BITS bits whatever their number; it lets few others through, and the join decides.
    """
    place = wanted.select((F.pmod("hash", F.lit(WANTED_BITS)) + 1).alias("p"))
    parts = place.groupBy(F.bitmap_bucket_number("p").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")).toArrow()
    bits = np.zeros(WANTED_BITS // 8, np.uint8)
    for part, own in zip(parts.column("part").to_pylist(), parts.column("bits").to_pylist()):
        bits[(part - 1) * len(own) : part * len(own)] = np.frombuffer(own, np.uint8)
    held = wanted.sparkSession.sparkContext.broadcast(bits)
    texts = hashed.select("hash", "check", "text").transform(mapped, _texts(held), "hash long, check long, packed binary").hint("merge").join(wanted, ["hash", "check"])
    return stored(texts.groupBy("hash", "check", "node").agg(F.min("packed").alias("packed")).select("node", "packed", F.lit(0).alias("n")), "texts")


def verify(pairs: DataFrame, nodes: DataFrame, hashed: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes that link, decided on the whole sets. ``nodes`` has node and its first row."""
    wanted = stored(ends_of(pairs).join(nodes.select("node", F.col("first.hash").alias("hash"), F.col("first.check").alias("check")).hint("merge"), "node"), "wanted")
    texts = texts_of(wanted, hashed)
    met = both_sides(pairs, texts, "packed").select("a", "b", "x", "y")
    links = stored(met.transform(mapped, _linked, "a long, b long"), "links")
    discard(wanted, texts)
    return links


def components(edges: DataFrame) -> DataFrame:
    """node, label: one label for all nodes that are connected, for the nodes of ``edges`` (a, b).

    Each round sends a node to the smallest neighbour of its smallest neighbour,
    renames the edges' ends and drops edges within a name, so that a star is gone
    after one round and a chain shrinks by a factor.
    """
    rest = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    names = None
    while True:
        near = rest.union(rest.select("b", "a")).groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("to"))
        step = stored(near.join(near.select(F.col("node").alias("to"), F.col("to").alias("label")), "to").select("node", "label"), "names")
        ends = [step.select(F.col("node").alias(c), F.col("label").alias(f"to_{c}")) for c in ("a", "b")]
        renamed = rest.join(ends[0], "a").join(ends[1], "b").where("to_a <> to_b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b"))
        left = stored(renamed.distinct(), "edges")
        if names is None:
            names = step
        else:
            last = names
            names = stored(last.join(step.select(F.col("node").alias("label"), F.col("label").alias("next")), "label", "left").select("node", F.coalesce("next", "label").alias("label")), "names")
            discard(last, step)
        discard(rest)
        rest = left
        if rest.isEmpty():
            discard(rest)
            return names


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key, which come one key after another; the last of a batch waits for the next."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch] if held is None else [*held.to_batches(), batch])
        if not len(table):
            continue
        columns = [table.column(k).to_numpy() for k in keys]
        cut = [0, *(np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1).tolist()]
        for x, y in zip(cut, cut[1:]):
            yield table.slice(x, y - x)
        held = table.slice(cut[-1]).combine_chunks()
    if held is not None:
        yield held


def _between(most: int | None):
    """Pairs of nodes of different classes that sizes and sketches allow to link, for each run and pair of blocks.

    ``most``: only so many for a node of a smaller class, those that differ least; None: all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = []
        for group in _groups(batches, ["run", "x", "y"]):
            pairs.append(_open_pairs(group, most))
            if sum(len(p[0]) for p in pairs) > 500_000:
                pairs = [_distinct(pairs)]
        if pairs:
            a, b = _distinct(pairs)
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _open_pairs(rows: pa.Table, most: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Nodes that ask, each with the block's own nodes of other classes. Groups are filtered by size before their members are paired."""
    label, node, n = (rows.column(c).to_numpy() for c in ("label", "a", "n"))
    asks = rows.column("asks").to_numpy(zero_copy_only=False)
    _, first, group = np.unique(rows.column("grp").to_numpy(), return_index=True, return_inverse=True)
    fits = may_link(n[first][:, None], 0, n[first], 0)
    sketches = Sketches(rows.column("sketch").to_pylist())
    own, asking = np.flatnonzero(~asks), np.flatnonzero(asks)
    out = [(node[:0], node[:0])]
    for part in np.array_split(asking, max(1, len(asking) // 64)):
        ok = fits[group[part]][:, group[own]] & (label[part][:, None] != label[own])
        i, j = np.nonzero(ok)
        i, j = part[i], own[j]
        differ, far = sketches.far_apart(i, j, n[i] + n[j])
        i, j, differ = i[~far], j[~far], differ[~far]
        if most is not None and len(i):
            by = np.lexsort((node[j], differ, i))
            i, j = i[by], j[by]
            start = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
            place = np.arange(len(i)) - np.repeat(start, np.diff(np.append(start, len(i))))
            i, j = i[place < most], j[place < most]
        out.append((node[i], node[j]))
    return _distinct(out)


def unresolved(long_runs: DataFrame, labels: DataFrame, nodes: DataFrame, most: int | None) -> DataFrame:
    """Pairs (a, b) between classes that still share a long run; ``nodes`` has node and sketch.

    A run's nodes are dealt into blocks, and those outside its largest class ask in every block, in portions of the same size.
    """
    named = long_runs.join(labels.withColumnRenamed("node", "a"), "a", "left").withColumn("label", F.coalesce("label", "a"))
    held = named.groupBy("run", "label").agg(F.count("*").alias("m")).groupBy("run").agg(F.max(F.struct("m", "label")).alias("main"), F.sum("m").alias("m"), F.count("*").alias("k"))
    open_runs = held.where("k > 1").select("run", F.col("main.label").alias("main"), F.ceil(F.col("m") / RUN_BLOCK).alias("blocks"), F.ceil((F.col("m") - F.col("main.m")) / RUN_BLOCK).alias("portions"))
    rows = named.join(open_runs, "run").join(nodes.select(F.col("node").alias("a"), "sketch").hint("merge"), "a")
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    block, portion = (F.pmod(F.xxhash64("a"), n) for n in ("blocks", "portions"))
    stands = F.transform(upto("portions"), lambda y: F.struct(block.alias("x"), y.alias("y"), F.lit(False).alias("asks")))
    asking = F.transform(upto("blocks"), lambda x: F.struct(x.alias("x"), portion.alias("y"), F.lit(True).alias("asks")))
    places = F.when(F.col("label") == F.col("main"), stands).otherwise(F.concat(stands, asking))
    dealt = rows.select("run", "a", "label", "grp", "n", "sketch", F.inline(places)).repartition("run", "x", "y").sortWithinPartitions("run", "x", "y")
    return stored(dealt.transform(mapped, _between(most), "a long, b long").distinct(), "pairs")


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``docs`` (doc_id, text)."""
    signed, nodes = _labelled(docs)
    least = nodes.groupBy("label").agg(F.min("first").alias("first"))
    nodes = nodes.join(least.select("label", F.col("first.doc_id").alias("component_id")), "label").select("node", "component_id")
    rows = signed.where("node IS NOT NULL").join(nodes, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return rows.union(signed.where("node IS NULL").select("doc_id", "n", F.col("doc_id").alias("component_id")))


def shared_halves(named: DataFrame) -> frozenset[int]:
    """First halves of names that sets with different second halves have; hardly any in a corpus of any size."""
    halves = named.where("node IS NOT NULL").groupBy("node").agg(F.min("twin").alias("low"), F.max("twin").alias("high")).where("low <> high")
    shared = frozenset(r["node"] for r in halves.limit(SHARED + 1).collect())
    if len(shared) > SHARED:
        raise ValueError("too many sets share half of their names")
    return shared


def _labelled(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id, hash of the text, node and n of each row; and label and first row (smallest doc_id, null last) of each node."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    hashed = docs.withColumn("hash", F.xxhash64("text")).withColumn("check", F.xxhash64(F.lit(1), "text"))
    made = stored(hashed.transform(mapped, _sign, "kind int, doc_id long, hash long, check long, node long, twin long, n long, sketch binary"), "signed")
    named = made.where("kind = 0")
    shared = shared_halves(named)
    if shared:
        named = named.withColumn("node", F.when(F.col("node").isin(*shared), F.col("twin")).otherwise(F.col("node")))
    signed = named.select("doc_id", "hash", "check", "node", "n")
    # At most FREQUENT tokens with their counts come to the driver and go to the tasks.
    often = made.where("kind = 1").groupBy("node").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "node").limit(FREQUENT).toArrow()
    listed, times = np.asarray(often.column("node"), np.int64).view(np.uint64), np.asarray(often.column("n"), np.float64)
    by = np.argsort(listed)
    frequent = spark.sparkContext.broadcast((listed[by], np.log2(times[by]).astype(np.int8)))
    tokens = signed.agg(F.sum("n")).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tokens // (DENOMINATOR * INDEX_ROWS)))
    index = docs.select("text").transform(mapped, _index_rows(frequent, tasks, shared), _INDEX).repartitionById(tasks, F.col("bucket").cast("int"))
    found = stored(index.transform(mapped, _runs, _FOUND), "candidates")
    nodes = stored(named.where("node IS NOT NULL").groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "hash", "check")).alias("first"), F.min("n").alias("n"), F.min("sketch").alias("sketch")), "nodes")
    pairs = near_pairs(found.where("kind = 0").select("a", "b").distinct(), nodes)
    runs = stored(found.where("kind = 1").select("run", "a", F.col("b").alias("grp"), "n").distinct(), "runs")
    links = verify(pairs, nodes, hashed)
    labels = components(links)
    discard(found, pairs, links)
    for most in ROUNDS:
        rest = unresolved(runs, labels, nodes, most)
        if rest.isEmpty():
            break
        # Labels stand for all the links before.
        last, links = labels, verify(rest, nodes, hashed)
        labels = components(last.select(F.col("node").alias("a"), F.col("label").alias("b")).union(links))
        discard(rest, links, last)
    discard(runs)
    return signed, nodes.select("node", "first").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def representatives(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component, the one with the smallest doc_id (null last), with all columns.

    A row is known by its doc_id and text; rows that repeat both count once. Rows without words are components of
    their own, so those with null doc_id all stay.
    """
    signed, nodes = _labelled(docs)
    first = nodes.groupBy("label").agg(F.min("first").alias("first")).select("first.doc_id", "first.hash", "first.check", F.lit(False).alias("own"))
    wordless = signed.where("node is null").select("doc_id", "hash", "check", F.col("doc_id").isNull().alias("own")).distinct()
    made = first.union(wordless).select(F.col("doc_id").alias("__corvane_id"), F.col("hash").alias("__corvane_hash"), F.col("check").alias("__corvane_check"), "own").withColumnRenamed("own", "__corvane_own")
    text = F.col("text").cast("string")
    rows = docs.withColumn("__corvane_text", F.xxhash64(text)).withColumn("__corvane_second", F.xxhash64(F.lit(1), text))
    named = rows.join(made, F.col("doc_id").cast("long").eqNullSafe(F.col("__corvane_id")) & (F.col("__corvane_text") == F.col("__corvane_hash")) & (F.col("__corvane_second") == F.col("__corvane_check")))
    named = named.withColumn("__corvane_row", F.when(F.col("__corvane_own"), F.monotonically_increasing_id()))
    return named.dropDuplicates(["doc_id", "__corvane_text", "__corvane_second", "__corvane_row"]).select(*[F.col(f"`{c}`") for c in docs.columns])
