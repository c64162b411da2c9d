"""Merkle manifest of a dataset: a tree of three-way runs over the rows of each source, and one over the sources.

Spark makes the leaves, numbers them by (source, doc_id) and deals them into aligned blocks of ``ARITY ** depth`` consecutive
leaves. A block engine (DuckDB, one connection for each Python worker) reduces the blocks that a task gets, all at once, by
level queries of ordered ``string_agg`` and ``sha256``. The blocks' roots are the nodes of the next round, so a source of n
rows takes log(n) / depth rounds and no task ever has a source. The outer proofs then meet the blocks again, and a
second pass of the engine gives every row its proof and the root that a changed row would lead to.

Defined results: null fields are ``-``. Rows of a source are ordered by doc_id, null ids first, then by leaf; repeated rows
are leaves of their own. Rows without a source form the first source. An empty table gives an empty result. Other columns
are never looked at.
"""

from __future__ import annotations

import functools

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furlong.llm import textbytes as tb
from furlong.llm.rowkey import numbered
from furlong.session import materialize, prepare

ARITY = 3
#: Levels of a block, which has ARITY ** DEPTH leaves.
DEPTH = 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf(values: list[Column]) -> Column:
    """sha256 of the fields, each with its length in bytes before it."""
    parts = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.sha2(F.concat(*parts), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, key (of the source, ordered like it with null first), h, and bad: the leaf after tampering, or null."""
    fields = [F.col(c) for c in FIELDS]
    changed = [*fields[:-1], F.replace(F.col("text"), F.lit("\n"), F.lit(""))]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    key = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit(""))
    return docs.select("doc_id", key.alias("key"), leaf(fields).alias("h"), F.when(hit, leaf(changed)).alias("bad"))


@functools.cache
def engine() -> duckdb.DuckDBPyConnection:
    con = duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""})
    con.execute("SET preserve_insertion_order = false")
    return con


def _reduce(con: duckdb.DuckDBPyConnection, nodes: pa.Table, depth: int, sides: bool) -> None:
    """Tables lvl0 .. lvl<depth> of the nodes of all blocks: key, block, i, total, h. A level holds for keys that have more than
    one node below it; others carry their root up. With ``sides`` also run0 ..: what stands before and after a node in its run."""
    con.register("given", nodes)
    con.execute(f"CREATE OR REPLACE TEMP TABLE lvl0 AS SELECT key, block, pos % {ARITY**depth} AS i, total, h FROM given")
    for j in range(depth):
        grows = f"total > {ARITY**j}"
        if sides:
            con.execute(f"""CREATE OR REPLACE TEMP TABLE run{j} AS SELECT key, block, i, {grows} AS grows,
              CASE WHEN {grows} THEN coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') ELSE '' END AS l,
              CASE WHEN {grows} THEN coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') ELSE '' END AS r
              FROM lvl{j} WINDOW w AS (PARTITION BY key, block, i // {ARITY} ORDER BY i)""")
        con.execute(f"""CREATE OR REPLACE TEMP TABLE lvl{j + 1} AS SELECT key, block, i // {ARITY} AS i, any_value(total) AS total,
          CASE WHEN any_value({grows}) THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h
          FROM lvl{j} GROUP BY key, block, i // {ARITY}""")
    con.unregister("given")


def _fetch(con: duckdb.DuckDBPyConnection, sql: str, schema: pa.Schema) -> pa.Table:
    return con.sql(sql).to_arrow_table().select(schema.names).cast(schema)


ROOTS = pa.schema([("key", pa.string()), ("pos", pa.int64()), ("total", pa.int64()), ("h", pa.string())])
STEP = pa.struct([("l", pa.string()), ("r", pa.string())])
PATHS = pa.schema([("key", pa.string()), ("pos", pa.int64()), ("steps", pa.list_(STEP)), ("top", pa.string())])


def _deals(n: int, depth: int) -> Column:
    return F.lit(max(1, -(-n // (4 * ARITY**depth))))


def _dealt(nodes: DataFrame, n: int, depth: int) -> DataFrame:
    """nodes with their block and the task group that it belongs to, about four blocks each."""
    made = nodes.withColumn("block", F.floor(F.col("pos") / ARITY**depth).cast("long"))
    return made.withColumn("deal", F.pmod(F.xxhash64("key", "block"), _deals(n, depth)))


def block_roots(nodes: DataFrame, n: int, depth: int = DEPTH) -> DataFrame:
    """key, pos (the block's number), total (the key's blocks) and h of every block. n: the number of nodes."""

    def run(table: pa.Table) -> pa.Table:
        con = engine()
        _reduce(con, table, depth, sides=False)
        return _fetch(con, f"SELECT key, block AS pos, CAST((total + {ARITY**depth - 1}) // {ARITY**depth} AS BIGINT) AS total, h FROM lvl{depth}", ROOTS)

    dealt = _dealt(nodes.select("key", "pos", "total", "h"), n, depth)
    return dealt.groupBy("deal").applyInArrow(tb.lean_group(run), "key string, pos long, total long, h string")


def paths(nodes: DataFrame, name: str, depth: int = DEPTH) -> DataFrame:
    """key, pos, steps (what stands left and right of it at each level) and top (the root of its key) of every node."""
    spark = nodes.sparkSession
    n = nodes.count()
    roots = materialize(spark, block_roots(nodes, n, depth), f"{name}-roots")
    outer = _outer(roots, name, depth)

    def run(table: pa.Table, above: pa.Table) -> pa.Table:
        con = engine()
        _reduce(con, table, depth, sides=True)
        con.register("above", above)
        joins = " ".join(f"JOIN run{j} ON run{j}.key = n.key AND run{j}.block = n.block AND run{j}.i = n.i // {ARITY**j}" for j in range(depth))
        own = ", ".join(f"CASE WHEN run{j}.grows THEN [{{'l': run{j}.l, 'r': run{j}.r}}] ELSE [] END" for j in range(depth))
        out = _fetch(con, f"SELECT n.key, n.block * {ARITY**depth} + n.i AS pos, list_concat({own}, above.steps) AS steps, above.top FROM lvl0 n {joins} JOIN above ON above.key = n.key AND above.pos = n.block", PATHS)
        con.unregister("above")
        return out

    left = _dealt(nodes.select("key", "pos", "total", "h"), n, depth)
    right = outer.withColumn("deal", F.pmod(F.xxhash64("key", "pos"), _deals(n, depth)))
    return left.groupBy("deal").cogroup(right.groupBy("deal")).applyInArrow(tb.lean_pair(run), "key string, pos long, steps array<struct<l:string,r:string>>, top string")


def _outer(roots: DataFrame, name: str, depth: int) -> DataFrame:
    """The paths of blocks: none where every key is one block, or those of a tree over the blocks."""
    if (roots.agg(F.max("total")).first()[0] or 0) <= 1:
        none = F.array().cast("array<struct<l:string,r:string>>")
        return roots.select("key", "pos", none.alias("steps"), F.col("h").alias("top"))
    return materialize(roots.sparkSession, paths(roots, f"{name}-up", depth), f"{name}-paths")


def manifest(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row."""
    spark = prepare(docs.sparkSession)
    rows = materialize(spark, numbered(leaves(docs), "merkle-leaves", "doc_id", "h"), "merkle-numbered")
    n = rows.count()
    roots = materialize(spark, block_roots(rows, n, depth), "merkle-blocks")
    inner = _outer(roots, "merkle", depth)

    # the tree over the sources, whose leaves are the subroots in the order of the keys
    tops = inner.where("pos = 0").select(F.lit("").alias("key"), F.col("key").alias("source"), F.col("top").alias("h"))
    tops = materialize(spark, numbered(tops, "merkle-sources", "source"), "merkle-tops")
    over = paths(tops, "merkle-sources", depth).select("pos", F.col("steps").alias("last"), F.col("top").alias("root"))
    over = tops.select("pos", F.col("source").alias("key")).join(over, "pos").drop("pos")
    outer = inner.join(over, "key").select("key", "pos", F.concat("steps", "last").alias("steps"), F.col("top").alias("subroot"), "root")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(table: pa.Table, above: pa.Table) -> pa.Table:
        con = engine()
        _reduce(con, table, depth, sides=True)
        con.register("above", above)
        con.register("given", table)
        con.execute(f"""CREATE OR REPLACE TEMP TABLE fold AS SELECT g.doc_id, g.key, g.block, g.pos % {ARITY**depth} AS i, g.h, coalesce(g.bad, g.h) AS f, '' AS proof,
          a.steps, a.subroot, a.root FROM given g JOIN above a ON a.key = g.key AND a.pos = g.block""")
        for j in range(depth):
            con.execute(f"""CREATE OR REPLACE TEMP TABLE fold AS SELECT fold.* REPLACE (CASE WHEN s.grows THEN sha256(s.l || f || s.r) ELSE f END AS f, proof || s.l || s.r AS proof)
              FROM fold JOIN run{j} s ON s.key = fold.key AND s.block = fold.block AND s.i = fold.i // {ARITY**j}""")
        deepest = con.execute("SELECT coalesce(max(len(steps)), 0) FROM above").fetchone()[0]
        for j in range(1, deepest + 1):
            con.execute(f"""CREATE OR REPLACE TEMP TABLE fold AS SELECT * REPLACE (CASE WHEN len(steps) >= {j} THEN sha256(steps[{j}].l || f || steps[{j}].r) ELSE f END AS f,
              CASE WHEN len(steps) >= {j} THEN proof || steps[{j}].l || steps[{j}].r ELSE proof END AS proof) FROM fold""")
        names = ["leaf", "subroot", "root", "proof_sha256", "folded_root"]
        schema = pa.schema([table.schema.field("doc_id"), *((c, pa.string()) for c in names), ("verified", pa.bool_())])
        out = _fetch(con, "SELECT doc_id, h AS leaf, subroot, root, sha256(proof) AS proof_sha256, f AS folded_root, f = root AS verified FROM fold", schema)
        for view in ("above", "given"):
            con.unregister(view)
        con.execute("DROP TABLE fold")
        return out

    left = _dealt(rows, n, depth)
    right = outer.withColumn("deal", F.pmod(F.xxhash64("key", "pos"), _deals(n, depth)))
    return left.groupBy("deal").cogroup(right.groupBy("deal")).applyInArrow(
        tb.lean_pair(run), f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    )


def _oracle(levels: int = 13) -> str:
    """The same in DuckDB, by one query for each level: enough for sources of ARITY ** levels rows."""
    part = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    of = lambda text: "sha256(" + " || ".join([*(part(c) for c in FIELDS[:-1]), part(text)]) + ")"
    bits = "list_reduce([CAST(i AS BIGINT)] || list_transform(range(8), lambda z: CAST(0 AS BIGINT)), lambda a, z: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)"
    crc = "xor(list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT)), lambda a, b: xor(a // 256, t[xor(a, b) % 256 + 1])), 4294967295)"
    sql = [f"crc_table AS (SELECT list(x ORDER BY i) AS t FROM (SELECT i, {bits} AS x FROM range(256) r(i)))"]
    sql.append(f"""leaves AS (SELECT doc_id, coalesce('s' || source, '') AS key, {of('text')} AS h,
      CASE WHEN {crc} % 2 = 0 THEN {of("replace(text, chr(10), '')")} END AS bad FROM documents, crc_table)""")
    sql.append("low0 AS (SELECT key AS k, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, h) - 1 AS i, h, count(*) OVER (PARTITION BY key) AS n FROM leaves)")
    sql.append("fold0 AS (SELECT doc_id, key AS k, h AS leaf, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, h) - 1 AS i, coalesce(bad, h) AS f, '' AS p FROM leaves)")

    def climb(low: str, fold: str) -> None:
        for j in range(levels):
            w = "PARTITION BY k, i // 3 ORDER BY i ROWS BETWEEN"
            sql.append(f"""{low}{j}s AS (SELECT k, i, n > 1 AS grows, coalesce(string_agg(h, '') OVER ({w} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
              coalesce(string_agg(h, '') OVER ({w} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {low}{j})""")
            sql.append(f"{low}{j + 1} AS (SELECT k, i // 3 AS i, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h, (any_value(n) + 2) // 3 AS n FROM {low}{j} GROUP BY k, i // 3)")
            keep = ", ".join(c for c in ("doc_id", "leaf", "source") if c != "source" or fold == "top")
            sql.append(f"""{fold}{j + 1} AS (SELECT {keep}, a.k, a.i // 3 AS i, CASE WHEN grows THEN sha256(l || f || r) ELSE f END AS f, CASE WHEN grows THEN p || l || r ELSE p END AS p
              FROM {fold}{j} a JOIN {low}{j}s b ON a.k = b.k AND a.i = b.i)""")

    climb("low", "fold")
    sql.append(f"high0 AS (SELECT '' AS k, k AS source, row_number() OVER (ORDER BY k) - 1 AS i, h, count(*) OVER () AS n FROM low{levels})")
    sql.append(f"top0 AS (SELECT doc_id, leaf, a.k AS source, '' AS k, b.i, f, p FROM fold{levels} a JOIN high0 b ON a.k = b.source)")
    climb("high", "top")
    return f"""WITH {', '.join(sql)}
      SELECT doc_id, leaf, s.h AS subroot, r.h AS root, sha256(p) AS proof_sha256, f AS folded_root, f = r.h AS verified FROM top{levels} t JOIN high0 s ON s.source = t.source, high{levels} r"""


ORACLE = _oracle()
