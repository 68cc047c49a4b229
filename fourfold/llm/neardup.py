"""Near duplicates by a chosen-path set similarity join.

Each document is a set of word shingles, and the sets' minwise tokens (one for each of 128 hash functions) are what it
branches by. In every tree a document goes from a node to one or two children: the node's own hash picks a position of
the signature, and the token there names the child, so two documents of similarity s go the same way with probability
s. With 1 / threshold children on average a pair at the threshold survives any depth with a fair chance, and independent
trees raise the recall to 1 - (1 - chance)**trees. A node that is small is compared exhaustively, by sketches of one bit
a token that its rows carry. In a larger one links with a leader are confirmed first. A node whose members are in one
component by then has nothing more to say and goes; any other branches on in the same way, until its nodes are small, or
those of its members that are outside its largest component can be compared with all, block by block. Where sketches
leave few pairs these go on as candidates; in a dense node, where they leave many, full sets are compared in the blocks
themselves, and only the links that join components come out. Links are confirmed on the full sets of shingles, and
components are the smallest ids reachable.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, Words, as_bytes, cut, mix, ngram_hashes, slices, with_row_keys

SHINGLE = 5
PERCENT = 75
POSITIONS = 128
TREES = 16
NODE = 32
DEPTH = 2
#: A large node is compared exhaustively, too, where its members outside the largest component make so few pairs with
#: all of them. LAST: a node so deep that is still large (equal signatures of unlike sets) is compared exhaustively,
#: whatever its size. STEP: levels between two looks at the components.
FEW_PAIRS, LAST, STEP = 4_000_000, 40, 3
#: A node, or two blocks of one, is dense if sketches leave more pairs than this for each of its members.
SPARSE = 2
#: Members of a block whose sketches, and whose full sets, are compared together, and shingles of the latter.
BLOCK, BLOCK_SETS, BLOCK_SHINGLES = 4_000, 2_000, 1_000_000
#: Leaders whose links with a member are confirmed before its nodes branch on; those of its largest nodes.
LEADERS = 2
#: A pair is looked at in full if so many of the 128 tokens agree, and of their last bits: 4.5 standard deviations under
#: the threshold, both.
AGREE, BITS_AGREE = 74, 95
#: Rows of ids and labels that one partition holds, about.
ROWS = 50_000
_SALT = mix(np.arange(1, 2 * POSITIONS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_A, _B = _SALT[:POSITIONS] | np.uint64(1), _SALT[POSITIONS:]
_CHUNK = 4096


def shingle_sets(texts: list[bytes | None]) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words gives one for its whole sequence, one without words none."""
    words = Words(texts)
    hashes = words.hashes(fold=True)
    grams = ngram_hashes(hashes, SHINGLE)
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            yield np.unique(grams[a : b - SHINGLE + 1])
        elif b > a:
            yield mix(ngram_hashes(hashes[a:b], b - a) + np.uint64(b - a))
        else:
            yield np.empty(0, dtype=np.uint64)


def signature(tokens: np.ndarray) -> np.ndarray:
    """The minwise token of each hash function, as 16 bits."""
    least = np.full(POSITIONS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(tokens), _CHUNK):
        np.minimum(least, (tokens[None, at : at + _CHUNK] * _A[:, None] + _B[:, None]).min(axis=1), out=least)
    return (mix(least) & np.uint64(0xFFFF)).astype(np.uint16)


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text, doc_id) -> (key, doc_id, n_shingles, k1, k2, sig, s1, s2); s1 and s2: the last bits of the 128 tokens."""
    for batch in batches:
        for part in slices(batch, "text"):
            sets = shingle_sets(as_bytes(part.column(1)))
            n, k1, k2, sig, bits = [], [], [], [], []
            for s in sets:
                n.append(len(s))
                k1.append(int(mix(s).sum(dtype=np.uint64).view(np.int64)))
                k2.append(int(mix(s ^ _SALT[0]).sum(dtype=np.uint64).view(np.int64)))
                tokens = signature(s) if len(s) else None
                sig.append(None if tokens is None else tokens.tobytes())
                bits.append(np.zeros(2, dtype=np.int64) if tokens is None else np.packbits((tokens & 1).astype(bool)).view(np.int64))
            s1, s2 = (np.array([b[k] for b in bits], dtype=np.int64) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sig, pa.binary()), pa.array(s1), pa.array(s2)], names=["key", "doc_id", "n_shingles", "k1", "k2", "sig", "s1", "s2"])


def branch(path: np.ndarray, rows: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Children of nodes: path and the row of `tokens` for each way that a document goes on."""
    # 1 / threshold children on average: one, and a second in a third of the nodes.
    second = mix(path ^ _SALT[1]) < np.uint64((1 << 64) * (100 - PERCENT) // PERCENT)
    path = np.concatenate([path, path[second] ^ _SALT[2]])
    rows = np.concatenate([rows, rows[second]])
    at = (mix(path ^ _SALT[3]) % np.uint64(POSITIONS)).astype(np.int64)
    token = tokens[rows, at].astype(np.uint64) | (at.astype(np.uint64) << np.uint64(16))
    return mix(path ^ mix(token + _SALT[4])), rows


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(-1, POSITIONS)


def _first_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, s1, s2, sig) -> (path, rep, s1, s2) at the first depth, in all trees."""
    for whole in batches:
        for start in range(0, whole.num_rows, 2000):
            batch = whole.slice(start, 2000)
            tokens = _matrix(batch.column(3))
            for tree in range(TREES):
                path = np.full(len(tokens), mix(np.array([tree + 1], dtype=np.uint64) * _SALT[5])[0], dtype=np.uint64)
                rows = np.arange(len(tokens))
                for _ in range(DEPTH):
                    path, rows = branch(path, rows, tokens)
                yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), *[batch.column(c).take(pa.array(rows)) for c in range(3)]], names=["path", "rep", "s1", "s2"])


def _next_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, rep, s1, s2, comp, sig) -> (path, rep, s1, s2, comp) STEP levels deeper."""
    for batch in batches:
        if batch.num_rows:
            path, rows, tokens = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), np.arange(batch.num_rows), _matrix(batch.column(5))
            for _ in range(STEP):
                path, rows = branch(path, rows, tokens)
            yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), *[batch.column(c).take(pa.array(rows)) for c in range(1, 5)]], names=["path", "rep", "s1", "s2", "comp"])


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, sig_a, sig_b) -> (a, b, agree) where enough tokens agree."""
    for batch in batches:
        if batch.num_rows:
            same = (_matrix(batch.column(2)) == _matrix(batch.column(3))).sum(axis=1)
            keep = pa.array(same >= AGREE)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(same, pa.int32())], names=["a", "b", "agree"]).filter(keep)


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * shared >= PERCENT * (len(x) + len(y) - shared)


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, text_a, text_b) -> (a, b) where the full sets are similar."""
    for batch in batches:
        for half in slices(batch, "text_a"):
            for part in slices(half, "text_b"):
                both = zip(shingle_sets(as_bytes(part.column(2))), shingle_sets(as_bytes(part.column(3))), strict=True)
                yield part.select(["a", "b"]).filter(pa.array([similar(x, y) for x, y in both], pa.bool_()))


def _cut(df: DataFrame) -> DataFrame:
    """As cut, without df's estimated size: a checkpoint keeps it, and in a loop of joins its digits double each time, until planning stands still."""
    done, spark = cut(df), df.sparkSession
    return DataFrame(spark._jsparkSession.createDataFrame(done._jdf.toJavaRDD(), done._jdf.schema()), spark)


def _few(df: DataFrame, n: int) -> DataFrame:
    """df, of about n narrow rows, in as many partitions as these need: each step would else write as many files as the session has shuffle partitions."""
    return df.coalesce(max(1, -(-n // ROWS)))


def _kept(df: DataFrame) -> tuple[DataFrame, int]:
    """df written out, in partitions that fit its rows, and their number."""
    done = _cut(df)
    n = done.count()
    return _few(done, n), n


def _labelled(rows: DataFrame, of: str, part: DataFrame | None, name: str) -> DataFrame:
    """rows with the component, so far, of the document in column `of`."""
    if part is None:
        return rows.withColumn(name, F.col(of))
    return rows.join(part.select(F.col("id").alias(of), F.col("component").alias("_c")), of, "left").withColumn(name, F.coalesce("_c", of)).drop("_c")


def _apart(pairs: DataFrame, part: DataFrame | None) -> DataFrame:
    """The pairs whose ends are not in one component yet."""
    if part is None:
        return pairs
    return _labelled(_labelled(pairs, "a", part, "_ca"), "b", part, "_cb").filter("_ca <> _cb").select(*pairs.columns)


def _met(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """(a, b, agree): the pairs (a, b) of which enough tokens agree."""
    both = pairs.join(reps.select(F.col("rep").alias("b"), F.col("sig").alias("sig_b")), "b").join(reps.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a")), "a")
    return both.select("a", "b", "sig_a", "sig_b").mapInArrow(_agreeing, "a long, b long, agree int")


def _alike(x: Callable[[str], Column], y: Callable[[str], Column]) -> Column:
    """Whether enough of the last bits of two documents' tokens agree."""
    apart = F.bit_count(x("s1").bitwiseXOR(y("s1"))) + F.bit_count(x("s2").bitwiseXOR(y("s2")))
    return apart <= POSITIONS - BITS_AGREE


def _ordered() -> list[Column]:
    return [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]


def _all_pairs(small: DataFrame) -> DataFrame:
    """path, n, pairs: the pairs (a, b), a < b, of each small node whose bits are alike enough, where there are any."""

    def beside(x: Column) -> Column:
        fit = F.filter("m", lambda y: (y["rep"] > x["rep"]) & _alike(lambda c: x[c], lambda c: y[c]))
        return F.transform(fit, lambda y: F.struct(x["rep"].alias("a"), y["rep"].alias("b")))

    nodes = small.groupBy("path").agg(F.collect_list(F.struct("rep", "s1", "s2")).alias("m"))
    return nodes.select("path", F.size("m").alias("n"), F.flatten(F.transform("m", beside)).alias("pairs")).filter(F.size("pairs") > 0)


def _blocks(mixed: DataFrame, block: int, weight: Column | None = None, budget: int = 1) -> DataFrame:
    """mixed (path, rep, comp, top, all, rest, ...) with i, j, side: members outside a node's largest component (1) meet all members (0) in blocks (i, j) of bounded size; where a node is one block, these stand there once, for both (2). weight and budget bound the sum of a weight in a block, too."""
    parts = mixed.groupBy("path").agg(F.first("all").alias("_all"), F.first("rest").alias("_rest"), F.sum(weight if weight is not None else F.lit(0)).alias("_w"))
    heavy = F.ceil(F.col("_w") / budget)
    parts = parts.select("path", F.greatest(F.ceil(F.col("_all") / block), heavy, F.lit(1)).alias("_nj"), F.greatest(F.ceil(F.col("_rest") / block), F.ceil(heavy * F.col("_rest") / F.col("_all")), F.lit(1)).alias("_ni"))
    rows = mixed.join(parts, "path")
    h = F.xxhash64("rep")
    whole = (F.col("_ni") == 1) & (F.col("_nj") == 1)
    left = rows.filter(F.expr("comp <> top") & ~whole).withColumn("i", F.pmod(h, F.col("_ni"))).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_nj") - 1))).withColumn("side", F.lit(1))
    right = rows.withColumn("j", F.pmod(h, F.col("_nj"))).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_ni") - 1))).withColumn("side", F.when(whole & F.expr("comp <> top"), 2).otherwise(0))
    return left.unionByName(right).drop("_ni", "_nj")


def _sides(t: pa.Table) -> tuple[pa.Table, pa.Table, np.ndarray]:
    """Left and right rows of a block, and which pairs count: of two components, and once if both members are outside the largest."""
    side = t.column("side").to_numpy(zero_copy_only=False)
    a, b = t.filter(pa.array(side >= 1)), t.filter(pa.array(side != 1))
    ca, cb = a.column("comp").to_numpy(), b.column("comp").to_numpy()
    ra, rb = a.column("rep").to_numpy(), b.column("rep").to_numpy()
    counts = (ca[:, None] != cb[None, :]) & ((cb == b.column("top").to_numpy())[None, :] | (ra[:, None] < rb[None, :]))
    return a, b, counts


def _alike_in_block(t: pa.Table) -> pa.Table:
    """(path, a, b) of alike pairs in one block; one row with nulls if there are too many."""
    a, b, counts = _sides(t)
    bits = [[x.column(c).to_numpy().view(np.uint64) for c in ("s1", "s2")] for x in (a, b)]
    out_a, out_b, n = [], [], 0
    ra, rb = a.column("rep").to_numpy(), b.column("rep").to_numpy()
    for k in range(0, len(ra), 500):
        apart = sum((np.bitwise_count(x[k : k + 500, None] ^ y[None, :]).astype(np.int16) for x, y in zip(*bits, strict=True)), np.int16(0))
        i, j = np.nonzero((apart <= POSITIONS - BITS_AGREE) & counts[k : k + 500])
        out_a.append(ra[k + i])
        out_b.append(rb[j])
        n += len(i)
        if n > SPARSE * (len(ra) + len(rb)):
            return pa.table({"path": pa.array([t.column("path")[0].as_py()], pa.int64()), "a": pa.array([None], pa.int64()), "b": pa.array([None], pa.int64())})
    path = t.column("path")[0].as_py() if t.num_rows else 0
    return pa.table({"path": pa.array(np.full(n, path), pa.int64()), "a": pa.array(np.concatenate([*out_a, np.empty(0, dtype=np.int64)]), pa.int64()), "b": pa.array(np.concatenate([*out_b, np.empty(0, dtype=np.int64)]), pa.int64())})


def _links_in_block(t: pa.Table) -> pa.Table:
    """(a, b): links of full sets in one block that join components, as many as it takes and no more."""
    a, b, counts = _sides(t)
    sets = [list(shingle_sets(as_bytes(x.column("text").combine_chunks()))) for x in (a, b)]
    sizes = [np.array([len(s) for s in x], dtype=np.int64) for x in sets]
    _, number = np.unique(np.concatenate([*sets[0], *sets[1], np.empty(0, dtype=np.uint64)]), return_inverse=True)
    first = int(sizes[0].sum())
    # Right members by shingle; how many a left member shares with each is a count over its shingles' lists.
    owner = np.repeat(np.arange(len(sizes[1])), sizes[1])
    order = np.argsort(number[first:], kind="stable")
    ends = np.searchsorted(number[first:][order], np.arange(number.max() + 2 if len(number) else 1))
    owner = owner[order]
    root: dict[int, int] = {}

    def top(c: int) -> int:
        while root.get(c, c) != c:
            root[c] = root.get(root[c], root[c])
            c = root[c]
        return c

    out, at = [], 0
    ra, rb, ca, cb = (x.column(c).to_numpy() for c in ("rep", "comp") for x in (a, b))
    for i, n in enumerate(sizes[0].tolist()):
        own = number[at : at + n]
        at += n
        many = ends[own + 1] - ends[own]
        stops = np.cumsum(many)
        held = owner[np.arange(stops[-1] if n else 0) + np.repeat(ends[own] - (stops - many), many)]
        shared = np.bincount(held, minlength=len(sizes[1]))
        for j in np.flatnonzero((100 * shared >= PERCENT * (n + sizes[1] - shared)) & counts[i]).tolist():
            x, y = top(int(ca[i])), top(int(cb[j]))
            if x != y:
                root[max(x, y)] = min(x, y)
                out.append(sorted((int(ra[i]), int(rb[j]))))
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})


def _led(large: DataFrame, nodes: int) -> DataFrame:
    """(a, b): each member of large nodes beside the leaders, drawn by the nodes' own hashes, of its LEADERS largest nodes; those alike enough."""
    leads = large.groupBy("path").agg(F.min_by(F.struct("rep", "s1", "s2"), F.xxhash64("path", "rep")).alias("lead"))
    met = large.join(F.broadcast(leads) if nodes <= BROADCAST_KEYS else leads, "path").filter(F.col("rep") != F.col("lead.rep"))
    first = met.groupBy(F.col("rep").alias("a")).agg(F.slice(F.sort_array(F.collect_set(F.struct("n", "lead", "s1", "s2")), False), 1, LEADERS).alias("x"))
    each = first.select("a", F.explode("x").alias("x")).filter(_alike(lambda c: F.col(f"x.{c}"), lambda c: F.col(f"x.lead.{c}")))
    return each.select("a", F.col("x.lead.rep").alias("b")).select(*_ordered()).distinct()


def candidate_pairs(reps: DataFrame, texts: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame | None]:
    """(a, b, agree), a < b: documents (rep, n_shingles, s1, s2, sig) that share a node and aren't linked yet, and how many of their tokens agree, AGREE at least; and the components (id, component) of the links that are confirmed, if any.

    texts gives (id, text) for documents (id). A small node gives all its pairs. In a large one the members' links with
    leaders are confirmed; then only pairs inside a component go without being compared, as no such link changes a
    component. Members alike are linked at once, and of members less alike than the threshold fewer than one in
    1 / threshold goes the same way, so that the rows shrink from level to level.
    """
    level = reps.select("rep", "s1", "s2", "sig").mapInArrow(_first_nodes, "path long, rep long, s1 long, s2 long")
    found, part, depth = [], None, DEPTH

    def linked(links: DataFrame) -> None:
        nonlocal part
        links, n = _kept(links)
        if n:
            part = components(links, part)

    while True:
        # At first every document is a component of its own.
        ends = [] if depth == DEPTH else [F.min("comp").alias("lo"), F.max("comp").alias("hi")]
        sizes = level.groupBy("path").agg(F.count("*").alias("n"), *ends).filter("lo < hi" if ends else "n > 1").select("path", "n")
        nodes, _ = _kept(level.drop("comp").join(sizes, "path"))
        small, _ = _kept(_all_pairs(nodes.filter(F.col("n") <= NODE)))
        crowded = F.size("pairs") > SPARSE * F.col("n")
        found.append(small.filter(~crowded).select(F.explode("pairs").alias("p")).select("p.a", "p.b"))
        large = nodes.filter(F.col("n") > NODE)
        many = large.select("path").distinct().count()
        if many:
            led, _ = _kept(_apart(_led(large, many), part))
            linked(confirm(led, texts(led.select(F.explode(F.array("a", "b")).alias("id")).distinct())))
        heavy = large.unionByName(nodes.join(small.filter(crowded).select("path"), "path", "left_semi"))
        tagged, n = _kept(_labelled(heavy.drop("n"), "rep", part, "comp").select("path", "rep", "s1", "s2", "comp"))
        counts = tagged.groupBy("path", "comp").agg(F.count("*").alias("n")).groupBy("path").agg(F.max_by("comp", F.struct("n", "comp")).alias("top"), F.sum("n").alias("all"), (F.sum("n") - F.max("n")).alias("rest"))
        mixed, n = _kept(_few(tagged.join(counts.filter("rest > 0"), "path"), n))
        if not n:
            break
        done = (F.col("rest") * F.col("all") <= FEW_PAIRS) | F.lit(depth >= LAST)
        few, on = mixed.filter(done), mixed.filter(~done)
        alike, _ = _kept(_blocks(few, BLOCK).groupBy("path", "i", "j").applyInArrow(_alike_in_block, "path long, a long, b long"))
        dense, n_dense = _kept(alike.filter("a is null").select("path").distinct())
        found.append(alike.join(dense, "path", "left_anti").select(*_ordered()).distinct())
        if n_dense:
            full = few.join(dense, "path", "left_semi").join(reps.select("rep", "n_shingles"), "rep")
            full, _ = _kept(_blocks(full, BLOCK_SETS, F.col("n_shingles"), BLOCK_SHINGLES).select("path", "i", "j", "side", "rep", "comp", "top"))
            held = texts(full.select(F.col("rep").alias("id")).distinct()).withColumnRenamed("id", "rep")
            linked(full.join(held, "rep").groupBy("path", "i", "j").applyInArrow(_links_in_block, "a long, b long").distinct())
        if on.isEmpty():
            break
        below = on.select("path", "rep", "s1", "s2", "comp").join(reps.select("rep", "sig"), "rep").select("path", "rep", "s1", "s2", "comp", "sig")
        level = below.mapInArrow(_next_nodes, "path long, rep long, s1 long, s2 long, comp long")
        depth += STEP
    return _met(_apart(functools.reduce(DataFrame.unionByName, found).distinct(), part), reps), part


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets, made again from texts (id, text), are similar enough."""
    both = pairs.select("a", "b").join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    both = both.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(_confirmed, "a long, b long")


def components(edges: DataFrame, part: DataFrame | None = None) -> DataFrame:
    """(id, component) for all ends of the edges (a, b): the smallest id reachable, by spreading minima and skipping ahead.

    part: components from before, which the edges join further. The edges then count as such between components, equal
    ones once and those inside none, so that links found earlier, and many between the same two, aren't spread over again.
    """
    if part is not None:
        ends = _labelled(_labelled(edges, "a", part, "_ca"), "b", part, "_cb")
        between, n = _kept(ends.select(F.least("_ca", "_cb").alias("a"), F.greatest("_ca", "_cb").alias("b")).filter("a < b").distinct())
        if not n:
            return part
        joined = components(between)
        below = _labelled(part, "component", joined, "_top").select("id", F.col("_top").alias("component"))
        total = below.unionByName(joined.join(part, "id", "left_anti"))
        return _kept(total)[0]
    n = 2 * edges.count()
    ends = _few(edges.select("a", "b"), n)
    sym = cut(_few(ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), n))
    labels = cut(_few(sym.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("component")), n))
    total = labels.agg(F.sum(F.col("component").cast("decimal(38,0)")).alias("s")).first()["s"]
    while total is not None:
        near = _few(sym.join(labels, sym.b == labels.id), n).groupBy("a").agg(F.min("component").alias("near"))
        stepped = _few(labels.join(near, labels.id == near.a).select("id", F.least("component", "near").alias("step")), n)
        ahead = labels.select(F.col("id").alias("step"), F.col("component").alias("ahead"))
        labels = cut(_few(stepped.join(ahead, "step").select("id", F.least("step", "ahead").alias("component")), n))
        now = labels.agg(F.sum(F.col("component").cast("decimal(38,0)")).alias("s")).first()["s"]
        if now == total:  # labels only fall, so an equal sum means that none has changed
            break
        total = now
    return labels


def _named(found: DataFrame) -> DataFrame:
    """found (rep, least, component: the smallest key) with component_id, the smallest id: another one only where an id repeats or is null, for keys are ids elsewhere."""
    other = found.filter(~F.col("least").eqNullSafe(F.col("rep"))).groupBy("component").agg(F.min("least").alias("_m"), F.max(F.col("rep") == F.col("component")).alias("_own"))
    other = cut(other)
    n = other.count()
    if not n:
        return found.withColumn("component_id", F.col("component"))
    joined = found.join(F.broadcast(other) if n <= BROADCAST_KEYS else other, "component", "left")
    return joined.withColumn("component_id", F.when(F.col("_own"), F.col("_m")).otherwise(F.least("component", "_m"))).drop("_m", "_own")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs.

    Texts without words, empty and null ones are linked with nothing and kept. Rows with equal sets are one class,
    joined by its smallest row alone. Every row is a document of its own, whether or not its id repeats or is null; a
    component's id is the smallest id among its rows, null if none has one, and the rows that have it are kept. So rows
    that repeat an id and a text are all kept or none is: who wants one of them gives an id that is unique. Other
    columns of docs aren't read. An empty table gives an empty table.
    """
    keyed = with_row_keys(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), "doc_id", "key")
    facts = cut(keyed.select("key", "text", "doc_id").mapInArrow(_facts, "key long, doc_id long, n_shingles long, k1 long, k2 long, sig binary, s1 long, s2 long"))
    classes = cut(facts.filter("n_shingles > 0").groupBy("k1", "k2").agg(F.min("key").alias("rep"), F.min("doc_id").alias("least"), F.first("n_shingles").alias("n_shingles"), F.first("s1").alias("s1"), F.first("s2").alias("s2"), F.first("sig").alias("sig")))
    reps = classes.select("rep", "n_shingles", "s1", "s2", "sig")

    def texts_of(ids: DataFrame) -> DataFrame:
        """(id, text) of some documents, written out. Ids go to every task while they are few, so that texts stay where they are."""
        ids = cut(ids)
        if ids.count() <= BROADCAST_KEYS:
            ids = F.broadcast(ids)
        return cut(keyed.join(ids, keyed.key == ids.id, "left_semi").select(F.col("key").alias("id"), "text"))

    pairs, part = candidate_pairs(reps, texts_of)
    pairs, n = _kept(pairs)
    texts = texts_of(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    # First each document's best pair only: what those join needs no more of the pairs inside.
    best = _few(pairs.groupBy("b").agg(F.max_by("a", F.struct("agree", -F.col("a"))).alias("a")), n)
    edges, _ = _kept(confirm(best, texts))
    part = components(edges, part)
    rest, n = _kept(_apart(pairs, part).join(best, ["a", "b"], "left_anti"))
    more, n = _kept(confirm(rest, texts)) if n else (rest, 0)
    if n:
        part = components(more, part)
    found = classes.select("k1", "k2", "rep", "least").join(part.select(F.col("id").alias("rep"), "component"), "rep", "left")
    found = _named(found.withColumn("component", F.coalesce("component", "rep"))).select("k1", "k2", "component_id")
    out = facts.drop("sig", "s1", "s2").join(found, ["k1", "k2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op10_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """Every document's set size, component and whether it stays."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
