"""Source divergence: how far the sources of a language lie apart in their terms, by a quadtree over group-term counts.

Groups are (lang, source); the matrix of a language has a row for each of its groups and a column for each term it
keeps. It is cut into tiles of ROWS groups by about COLUMNS terms. A tile becomes a K-squared quadtree (K = 2) that has
nodes for quadrants with a count only. The trees' row pairs are walked together from the root down: where the quadrants
of both rows are empty every term there costs the same, the difference of two constants, and their number is all that is
needed; elsewhere the walk goes on, down to single cells of which one has a count. Columns stand by falling count, so
that empty quadrants are large. Tiles are tasks' groups of bounded size: sums meet by pair afterwards.
"""

from __future__ import annotations

import collections
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import as_bytes, slices, written

LEAST_DOCS, SMOOTH, SCALE, TOP = 30, 5, 1_000_000_000, 50
ROWS, COLUMNS = 128, 512
#: A task hands on its counts when they hold so many terms, or come from so many bytes of text.
HELD_TERMS, HELD_BYTES = 300_000, 64_000_000
#: Cells that one step of the walk looks at together.
STEP_CELLS = 1_000_000
#: ASCII other than letters ends a term; A-Z count as a-z.
_FOLD = bytes(c if c >= 0x80 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 0x20 for c in range(256))


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a text: runs of ASCII letters and of characters beyond ASCII, A-Z as a-z."""
    return (text or b"").translate(_FOLD).split()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) -> (lang, source, term, n, docs), summed over as much as a task holds at once."""
    held: dict[tuple[str, str], tuple[collections.Counter, collections.Counter]] = {}
    kinds = size = 0

    def rows() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            words = pa.array(list(n), pa.binary()).cast(pa.string())
            k = len(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * k, pa.string()), pa.array([source] * k, pa.string()), words, pa.array(n.values(), pa.int64()), pa.array([docs[t] for t in n], pa.int64())], names=["lang", "source", "term", "n", "docs"])

    for batch in batches:
        for part in slices(batch, "text"):
            for lang, source, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), as_bytes(part.column(2)), strict=True):
                if (lang, source) not in held:
                    held[lang, source] = (collections.Counter(), collections.Counter())
                    kinds += 1
                n, docs = held[lang, source]
                own, before = terms(text), len(n)
                n.update(own)
                docs.update(set(own))
                kinds, size = kinds + len(n) - before, size + len(text)
                if kinds > HELD_TERMS or size > HELD_BYTES:
                    yield from rows()
                    held.clear()
                    kinds = size = 0
    yield from rows()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, total) of the terms that each language keeps, from (lang, source, text) without nulls; total: the language's own count."""
    parts = docs.select("lang", "source", "text").mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    counts = parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_lang = W.partitionBy("lang", "term")
    counts = counts.withColumns({"docs": F.sum("docs").over(of_lang), "total": F.sum("n").over(of_lang)})
    return counts.filter(F.col("docs") >= LEAST_DOCS).select("lang", "source", "term", "n", "total")


def probability(n: Column, all_of: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (n + SMOOTH) / (all_of + SMOOTH * kept)), exactly; null without terms."""
    above = F.lit(SCALE).cast("decimal(10,0)") * (n + SMOOTH).cast("decimal(20,0)")
    return F.call_function("div", above, F.nullif((all_of + SMOOTH * kept).cast("decimal(20,0)"), F.lit(0))).cast("long") + 1


class Quadtree:
    """The K-squared tree of a set of cells. nodes[l]: codes of the quadrants of side 2**l with a cell, sorted; a code interleaves row and column."""

    def __init__(self, row: np.ndarray, column: np.ndarray, height: int):
        self.height = height
        code = interleaved(row.astype(np.int64), column.astype(np.int64), height)
        self.order = np.argsort(code)
        self.nodes = [code[self.order]]
        for _ in range(height):
            self.nodes.append(np.unique(self.nodes[-1] >> 2))

    def find(self, row: np.ndarray, column: np.ndarray, level: int) -> np.ndarray:
        """Place among nodes[level] of quadrants, -1 where empty."""
        nodes = self.nodes[level]
        code = interleaved(row, column, self.height - level)
        at = np.minimum(np.searchsorted(nodes, code), max(len(nodes) - 1, 0))
        return np.where(nodes[at] == code, at, -1) if len(nodes) else np.full(len(code), -1)


def interleaved(row: np.ndarray, column: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros(len(row), dtype=np.int64)
    for b in range(bits):
        out |= ((column >> b) & 1) << (2 * b) | ((row >> b) & 1) << (2 * b + 1)
    return out


def pair_sums(row: np.ndarray, column: np.ndarray, p: np.ndarray, empty: np.ndarray, left: np.ndarray, right: np.ndarray, columns: int) -> np.ndarray:
    """Sum over all columns of |p - q| for each row in `left` with each in `right`, as a matrix.

    p is given where a row has a count (row, column); elsewhere a row has its `empty`. Where left and right are the same
    rows only what lies above the diagonal is meant.
    """
    upper = np.array_equal(left, right)
    height = max(1, int(max(len(empty), columns, 2) - 1).bit_length())
    tree = Quadtree(row, column, height)
    p = p[tree.order]
    out = np.zeros((len(empty), len(empty)), dtype=np.int64)
    zeros = np.zeros((len(empty), len(empty)), dtype=np.int64)
    is_left, is_right = np.zeros(len(empty), dtype=bool), np.zeros(len(empty), dtype=bool)
    is_left[left] = is_right[right] = True
    frontier = [(height, np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while frontier:
        level, a, b, c = frontier.pop()
        if len(a) > STEP_CELLS >> 3 and level:
            half = len(a) // 2
            frontier += [(level, a[:half], b[:half], c[:half]), (level, a[half:], b[half:], c[half:])]
            continue
        x, y = tree.find(a, c, level), tree.find(b, c, level)
        none = (x < 0) & (y < 0)
        if not level:
            seen = ~none
            px = np.where(x[seen] >= 0, p[x[seen]], empty[a[seen]])
            py = np.where(y[seen] >= 0, p[y[seen]], empty[b[seen]])
            np.add.at(out, (a[seen], b[seen]), np.abs(px - py))
            np.add.at(zeros, (a[none], b[none]), 1)
            continue
        # Both quadrants are empty: so many columns, each at the same price, for every pair of their rows.
        side = 1 << level
        width = np.clip(columns - (c[none] << level), 0, side)
        for i, j, n in zip((a[none] << level).tolist(), (b[none] << level).tolist(), width.tolist(), strict=True):
            zeros[i : i + side, j : j + side] += n
        a, b, c = (2 * v[~none] for v in (a, b, c))
        parts = [(a + i, b + j, c + k) for i in (0, 1) for j in (0, 1) for k in (0, 1)]
        a, b, c = (np.concatenate(v) for v in zip(*parts, strict=True))
        low = level - 1
        inside = (a << low < len(empty)) & (b << low < len(empty)) & (c << low < columns)
        # Only quadrants that hold a row of `left` and one of `right`.
        some_left, some_right = (np.add.reduceat(m, np.arange(0, len(m), 1 << low)) > 0 for m in (is_left, is_right))
        a, b, c = a[inside], b[inside], c[inside]
        wanted = some_left[a] & some_right[b]
        if upper:
            wanted &= a <= b
        if wanted.any():
            frontier.append((low, a[wanted], b[wanted], c[wanted]))
    out += zeros * np.abs(empty[:, None] - empty[None, :])
    return out[np.ix_(np.flatnonzero(is_left), np.flatnonzero(is_right))]


def _tile(cells: pd.DataFrame, rows: int) -> pd.DataFrame:
    """The sums of a tile by pair of sources, and the terms that stand out in each, from its cells and one row for each source."""
    heads = cells[cells["term"].isna()].sort_values("place")
    own = cells[cells["term"].notna()]
    lang, (low, high) = heads["lang"].iloc[0], (heads["low"].iloc[0], heads["high"].iloc[0])
    place = heads["place"].to_numpy()
    sources, empty = heads["source"].to_numpy(), heads["p"].to_numpy()
    columns = own[["term", "total"]].drop_duplicates("term").sort_values(["total", "term"], ascending=[False, True])["term"].to_numpy()
    number = {t: k for k, t in enumerate(columns)}
    row = np.searchsorted(place, own["place"].to_numpy())
    column = np.array([number[t] for t in own["term"]], dtype=np.int64)
    left, right = np.flatnonzero(place // rows == low), np.flatnonzero(place // rows == high)
    # Terms that none of these sources has are columns, too.
    sums = pair_sums(row, column, own["p"].to_numpy(), empty, left, right, int(heads["width"].iloc[0]))
    a, b = np.repeat(left, len(right)), np.tile(right, len(left))
    found = [pd.DataFrame({"lang": lang, "source": sources[a], "part": "pair", "item": sources[b], "value": sums.ravel()})[a < b if low == high else slice(None)]]
    if low == high:
        out = own.assign(value=own["p"] - own["q"])
        out = out[out["value"] > 0].sort_values(["value", "term"], ascending=[False, True]).groupby("source").head(TOP)
        found.append(pd.DataFrame({"lang": lang, "source": out["source"], "part": "term", "item": out["term"], "value": out["value"]}))
    return pd.concat(found)


def divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank: what sets each source of a language apart.

    A language keeps the terms of LEAST_DOCS of its rows or more. A source's p of a kept term is the smoothed share of
    its counts, in parts of SCALE. part `pair`: every other source of the language, by the sum of |p - q| over all kept
    terms, all ranks; part `term`: the TOP terms that the source has and uses more than its language does, by p - q.
    Null texts, languages and sources count as empty ones; a group without terms has its pairs; repeated rows count each
    time; a language that keeps no term has pairs of value 0; a language of one source has no pairs. Ties go by the
    bytes of the item. An empty table gives an empty table.
    """
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    cells = written(term_counts(docs))
    all_groups = docs.groupBy("lang", "source").agg(F.count("*").alias("rows")).drop("rows")
    groups = all_groups.join(cells.groupBy("lang", "source").agg(F.sum("n").alias("size")), ["lang", "source"], "left")
    columns = cells.groupBy("lang", "term").agg(F.first("total").alias("total"))
    kept = columns.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("lang_size"))
    groups = groups.join(kept, "lang", "left").fillna(0, ["size", "kept", "lang_size"])
    groups = groups.withColumn("place", F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1)
    groups = groups.withColumn("blocks", F.floor((F.max("place").over(W.partitionBy("lang"))) / ROWS).cast("int") + 1)
    groups = written(groups.withColumn("tiles", F.ceil(F.col("kept") / COLUMNS).cast("int")))
    tile = F.pmod(F.xxhash64("term"), "tiles").cast("int").alias("tile")
    widths = columns.join(groups.select("lang", "tiles").distinct(), "lang").groupBy("lang", tile).agg(F.count("*").alias("width"))
    mine = F.floor(F.col("place") / ROWS).cast("int")

    def to_tiles(rows: DataFrame) -> DataFrame:
        """A row goes to each tile of rows that its block makes with another."""
        other = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        return other.select("lang", "tile", F.least(mine, "other").alias("low"), F.greatest(mine, "other").alias("high"), "source", "place", "term", "total", "p", "q", "width")

    nothing = F.lit(None)
    heads = groups.withColumns({"tile": F.explode(F.sequence(F.lit(0), F.greatest(F.col("tiles"), F.lit(1)) - 1)), "term": nothing.cast("string"), "total": nothing.cast("long"), "q": nothing.cast("long")})
    heads = heads.join(widths, ["lang", "tile"], "left").fillna(0, ["width"])
    heads = heads.withColumn("p", F.coalesce(probability(F.lit(0), F.col("size"), F.col("kept")), F.lit(0)))
    of_groups = groups.select("lang", "source", "place", "blocks", "tiles", "size", "kept", "lang_size")
    inner = cells.join(of_groups, ["lang", "source"]).withColumns({"tile": tile, "width": nothing.cast("long")})
    inner = inner.withColumns({"p": probability(F.col("n"), F.col("size"), F.col("kept")), "q": probability(F.col("total"), F.col("lang_size"), F.col("kept"))})
    tiles = to_tiles(heads).unionByName(to_tiles(inner)).groupBy("lang", "tile", "low", "high")
    rows_of_tile = ROWS

    def of_tile(cells: pd.DataFrame) -> pd.DataFrame:
        return _tile(cells, rows_of_tile)

    found = written(tiles.applyInPandas(of_tile, "lang string, source string, part string, item string, value long"))
    halves = found.filter("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = halves.unionByName(halves.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    both = pairs.withColumn("part", F.lit("pair")).unionByName(found.filter("part = 'term'"))
    ranked = both.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")))
    return ranked.filter((F.col("part") == "pair") | (F.col("rank") <= TOP)).select("lang", "source", "part", "item", "value", "rank")


def op13_source_divergence(spark, sf_dir: str) -> DataFrame:
    """The pairs of sources and the outstanding terms of all documents."""
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang", "source"))


OP13_SQL = rf"""
with d as (select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
t as (select id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
kept as (select lang, term, count(*)::hugeint as total from t group by lang, term having count(distinct id) >= {LEAST_DOCS}),
langs as (select lang, count(*)::hugeint as v, sum(total)::hugeint as size from kept group by lang),
groups as (select distinct lang, source from d),
counts as (select t.lang, t.source, t.term, count(*)::hugeint as n from t join kept using (lang, term) group by 1, 2, 3),
sizes as (select g.lang, g.source, coalesce(sum(c.n), 0)::hugeint as size from groups g left join counts c using (lang, source) group by 1, 2),
cells as (
  select s.lang, s.source, k.term, coalesce(c.n, 0) as n,
    1 + ({SCALE}::hugeint * (coalesce(c.n, 0) + {SMOOTH})) // (s.size + {SMOOTH} * l.v) as p, 1 + ({SCALE}::hugeint * (k.total + {SMOOTH})) // (l.size + {SMOOTH} * l.v) as q
  from sizes s join kept k on k.lang = s.lang join langs l on l.lang = s.lang left join counts c on c.lang = s.lang and c.source = s.source and c.term = k.term
),
sums as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from cells a join cells b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3),
pairs as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(s.value, 0)::bigint as value from groups a join groups b on a.lang = b.lang and a.source <> b.source left join sums s on s.lang = a.lang and s.source = a.source and s.item = b.source),
outstanding as (select lang, source, 'term' as part, term as item, (p - q)::bigint as value from cells where n > 0 and p > q),
ranked as (
  select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from (select * from pairs union all select * from outstanding)
)
select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= {TOP}
"""
