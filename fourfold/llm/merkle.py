"""A Merkle manifest of a dataset: a tree of digests for each source, one over the sources, and a proof for each row.

Rows are numbered within their source, and the digits of that number in base BRANCH are the path in the tree. A block
holds the BRANCH**LEVELS rows whose numbers differ in their last LEVELS digits only; it is dealt to one task, which
groups one digit away after another and nests the children as structs, so that a block ends as one row with its digest.
The digests of blocks are the rows of the next tier, and so on until each source has one; sources then make a tree in
the same way. Proofs come out by transforming a block's nested structs and exploding them. A tier's proofs meet the next
one's by block, one small row for each BRANCH**LEVELS; rows themselves are never joined, and no row holds more than a
block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fourfold.operators.numbering import numbered

from .common import written

BRANCH, LEVELS = 3, 6
BLOCK = BRANCH**LEVELS
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf_digest(*values: Column) -> Column:
    """Digest of the values in order, each as its number of UTF-8 bytes, a colon and itself, or a dash if null."""
    parts = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return digest(F.concat(*parts))


def _joined(kids: Column) -> Column:
    return F.array_join(F.transform(kids, lambda k: k["hash"]), "")


def rolled(nodes: DataFrame) -> DataFrame:
    """(group, block, size, hash, kids), one row a block, from (group, rank, size, hash, load); size: the nodes of the group."""
    digits = [((F.expr(f"rank div {BRANCH**j}")) % BRANCH).cast("int").alias(f"d{j}") for j in range(LEVELS)]
    at = nodes.select("group", "size", F.expr(f"rank div {BLOCK}").alias("block"), *digits, "hash", F.col("load").alias("kids"))
    at = at.repartition("group", "block")
    for j in range(LEVELS):
        kids = F.sort_array(F.collect_list(F.struct(F.col(f"d{j}").alias("digit"), "hash", "kids"))).alias("kids")
        at = at.groupBy("group", "size", "block", *[f"d{k}" for k in range(j + 1, LEVELS)]).agg(kids)
        # A level is there only where more than one node was left under it.
        at = at.withColumn("hash", F.when(F.col("size") > BRANCH**j, digest(_joined(F.col("kids")))).otherwise(F.col("kids")[0]["hash"]))
    return at.select("group", "block", "size", "hash", "kids")


def _unnested(kids: Column, level: int, above: Column) -> Column:
    """An array of (load, hash, proof) of the rows under `kids`; above: the proof from their parent on."""

    def one(kid: Column, i: Column) -> Column:
        left, right = F.slice(kids, F.lit(1), i), F.slice(kids, i + 2, F.lit(BRANCH))
        own = F.when(F.col("size") > BRANCH**level, F.array(F.struct(_joined(left).alias("left"), _joined(right).alias("right"))))
        proof = F.when(own.isNull(), above).otherwise(F.concat(own, above))
        if level:
            return _unnested(kid["kids"], level - 1, proof)
        return F.struct(kid["kids"].alias("load"), kid["hash"].alias("hash"), proof.alias("proof"))

    found = F.transform(kids, one)
    return F.flatten(found) if level else found


class Forest:
    """Trees over (group, rank, size, hash, load), one for each group; load: a struct that comes back with the proof."""

    def __init__(self, nodes: DataFrame):
        self.tiers = [written(rolled(nodes))]
        while (self.tiers[-1].agg(F.max("size")).first()[0] or 0) > BLOCK:
            below = self.tiers[-1]
            self.tiers.append(written(rolled(below.select("group", F.col("block").alias("rank"), F.ceil(F.col("size") / BLOCK).alias("size"), "hash", F.struct("block").alias("load")))))
        #: (group, hash)
        self.roots = self.tiers[-1].select("group", "hash")

    def proofs(self, above: DataFrame) -> DataFrame:
        """(group, load, hash, proof, ...) of all rows. above: (group, proof, ...), what follows the group's root; other columns go along."""
        more = [c for c in above.columns if c not in ("group", "proof")]
        on, out = ["group"], above
        for tier in reversed(self.tiers):
            blocks = tier.drop("hash").join(out, on)
            out = blocks.select("group", *more, F.explode(_unnested(F.col("kids"), LEVELS - 1, F.col("proof"))).alias("_x")).select("group", "_x.*", *more)
            if tier is not self.tiers[0]:
                on, out = ["group", "block"], out.select("group", F.col("load.block").alias("block"), "proof", *more)
        return out


def _ranked(rows: DataFrame, order: str) -> DataFrame:
    """rows with rank, from 0 within their group, and size, the rows of the group."""
    rows = written(rows)
    sizes = rows.groupBy("group").agg(F.count("*").alias("size"))
    return numbered(rows, "group", order, "rank").withColumn("rank", F.col("rank") - 1).join(sizes, "group")


def manifest(rows: DataFrame, group: Column, order: Column, leaf: Column, load: Column) -> tuple[DataFrame, str | None]:
    """(load, leaf, subroot, proof) of all rows, and the root.

    Within a group rows stand by `order`, nulls last, and where that is equal by their leaf; groups stand in the order of
    their bytes, null first. proof: an array of (left, right), the digests of the siblings on either side joined, from
    the leaf's level to the root's. A lone row is its group's root, a lone group's root is the root. Rows that repeat
    are leaves of their own. load: a struct that comes back with the row. An empty table gives no rows and no root.
    """
    # Null comes before any group, in a key that is never null itself.
    named = F.when(group.isNull(), F.lit("")).otherwise(F.concat(F.lit("s"), group.cast("string")))
    leaves = rows.select(named.alias("group"), F.struct(order.isNull().alias("none"), order.alias("own"), leaf.alias("leaf")).alias("place"), load.alias("load"))
    ranked = _ranked(leaves, "place")
    below = Forest(ranked.select("group", "rank", "size", F.col("place.leaf").alias("hash"), "load"))
    roots = below.roots.select(F.lit("").alias("group"), F.col("group").alias("place"), "hash")
    above = Forest(_ranked(roots, "place").select("group", "rank", "size", "hash", F.struct(F.col("place").alias("of"), F.col("hash").alias("subroot")).alias("load")))
    root = above.roots.first()
    nothing = F.array().cast("array<struct<left: string, right: string>>")
    tops = above.proofs(above.roots.select("group", nothing.alias("proof"))).select(F.col("load.of").alias("group"), "proof", "load.subroot")
    return below.proofs(tops).select("load", F.col("hash").alias("leaf"), "subroot", "proof"), root and root["hash"]


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda got, p: digest(F.concat(p["left"], got, p["right"])))


def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """Every document's leaf, its source's root, the root, the digest of its proof, and whether it holds after tampering.

    Documents whose id has an even checksum lose their line feeds before they are verified; a null id is not tampered with.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*LEAF_COLUMNS)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, leaf_digest(*[F.translate("text", "\n", "") if c == "text" else F.col(c) for c in LEAF_COLUMNS]))
    rows, root = manifest(docs, F.col("source"), F.col("doc_id"), leaf_digest(*map(F.col, LEAF_COLUMNS)), F.struct("doc_id", tampered.alias("tampered")))
    siblings = digest(F.array_join(F.transform("proof", lambda p: F.concat(p["left"], p["right"])), ""))
    out = rows.select("load.doc_id", "leaf", "subroot", F.lit(root).cast("string").alias("root"), siblings.alias("proof_sha256"), folded(F.coalesce("load.tampered", "leaf"), F.col("proof")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _leaf_sql(text: str) -> str:
    fields = [text if c == "text" else f"{c}::varchar" for c in LEAF_COLUMNS]
    return "sha256(concat(" + ", ".join(f"coalesce(strlen({f})::varchar || ':' || {f}, '-')" for f in fields) + "))"


#: The tampering of null ids and the order of rows that repeat an id are left out.
OP12_SQL = rf"""
with recursive docs as (
  select doc_id, coalesce('s' || source, '') as grp, {_leaf_sql("text")} as leaf, {_leaf_sql("replace(text, chr(10), '')")} as other,
    list_reduce(flatten(list_transform(string_split(doc_id::varchar, ''), lambda c: [ascii(c)::bigint, 0, 0, 0, 0, 0, 0, 0])),
      lambda crc, b: xor(xor(crc, b) >> 1, CASE WHEN xor(crc, b) & 1 = 1 THEN 3988292384 ELSE 0 END), 4294967295) as crc
  from documents
),
leaves as (
  select *, row_number() over (partition by grp order by doc_id, leaf) - 1 as place, count(*) over (partition by grp) as n from docs
),
lower_tree as (
  select grp, 0 as lvl, place, leaf as hash, n from leaves
  union all
  select grp, lvl + 1, place // 3, sha256(string_agg(hash, '' order by place)), (max(n) + 2) // 3 from lower_tree where n > 1 group by grp, lvl, place // 3
),
subroots as (select grp, hash as subroot, row_number() over (order by grp) - 1 as place, count(*) over () as n from lower_tree where n = 1),
upper_tree as (
  select 0 as lvl, place, subroot as hash, n from subroots
  union all
  select lvl + 1, place // 3, sha256(string_agg(hash, '' order by place)), (max(n) + 2) // 3 from upper_tree where n > 1 group by lvl, place // 3
),
steps as (
  select d.grp, d.place, t.lvl, coalesce(string_agg(t.hash, '' order by t.place) filter (t.place < d.place // (3 ** t.lvl)::bigint), '') as lefts,
    coalesce(string_agg(t.hash, '' order by t.place) filter (t.place > d.place // (3 ** t.lvl)::bigint), '') as rights
  from leaves d join lower_tree t on t.grp = d.grp and t.n > 1 and t.place // 3 = d.place // (3 ** (t.lvl + 1))::bigint group by 1, 2, 3
  union all
  select d.grp, d.place, 1000 + t.lvl, coalesce(string_agg(t.hash, '' order by t.place) filter (t.place < s.place // (3 ** t.lvl)::bigint), ''),
    coalesce(string_agg(t.hash, '' order by t.place) filter (t.place > s.place // (3 ** t.lvl)::bigint), '')
  from leaves d join subroots s on s.grp = d.grp join upper_tree t on t.n > 1 and t.place // 3 = s.place // (3 ** (t.lvl + 1))::bigint group by 1, 2, 3
),
turns as (select *, row_number() over (partition by grp, place order by lvl) as turn from steps),
fold as (
  select grp, place, 0::bigint as turn, case when crc % 2 = 1 then other else leaf end as hash from leaves
  union all
  select f.grp, f.place, t.turn, sha256(t.lefts || f.hash || t.rights) from fold f join turns t on t.grp = f.grp and t.place = f.place and t.turn = f.turn + 1
),
ended as (select grp, place, arg_max(hash, turn) as folded_root from fold group by 1, 2),
proofs as (select grp, place, string_agg(lefts || rights, '' order by lvl) as proof from steps group by 1, 2),
root as (select hash as root from upper_tree where n = 1)
select d.doc_id, d.leaf, s.subroot, r.root, sha256(coalesce(p.proof, '')) as proof_sha256, e.folded_root, e.folded_root = r.root as verified
from leaves d join subroots s on s.grp = d.grp cross join root r join ended e on e.grp = d.grp and e.place = d.place left join proofs p on p.grp = d.grp and p.place = d.place
"""
